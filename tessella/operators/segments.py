"""Intervals on recordings: sub-segments, padding, overlaps, masks, components.

Where each decision depends on the one before, a recording is handled by itself in pandas; a recording is
bounded by its own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import placed, running_sums
from ..session import pinned
from .keyed import overlaps


def by_recording(rows: DataFrame, group: str, columns: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.select(group, *columns).groupBy(group).applyInPandas(run, schema)


def uniform(rows: DataFrame, keep: list[str], start: str, end: str, most: float, overlap: float, remaining: float, constant: bool = False) -> DataFrame:
    """Windows of `most` seconds that overlap, and the rest of a segment where it is longer than `remaining`.

    With constant, the rest becomes a full window that ends where the segment ends.
    """
    length, step = F.col(end) - F.col(start), most - overlap
    # Windows go on while more than most + remaining is left; the rest is then the last window.
    n = F.greatest(F.lit(0), F.floor((length - most - remaining) / step + 1e-9) + 1)
    rows = rows.select(*keep, F.col(start).alias("__s"), F.col(end).alias("__e"), n.cast("int").alias("__n"))
    out = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    at = F.col("__s") + F.col("__i") * step
    is_rest = F.col("__i") == F.col("__n")
    rest_end = F.least(at + most, F.col("__e")) if not constant else F.col("__e")
    rest_start = F.when(F.col("__n") > 0, F.greatest(F.col("__e") - most, F.col("__s"))).otherwise(at) if constant else at
    out = out.withColumn("sub_start", F.when(is_rest, rest_start).otherwise(at)).withColumn("sub_end", F.when(is_rest, F.greatest(rest_end, F.when(F.lit(constant), F.col("__e")).otherwise(F.col("__e")))).otherwise(at + most))
    return out.where(F.col("sub_end") > F.col("sub_start")).withColumn("piece", F.col("__i")).drop("__s", "__e", "__n", "__i")


def fixed_chunks(rows: DataFrame, keep: list[str], length: str, size: float) -> DataFrame:
    """Whole windows of `size`, and one at the end where more than half a window is left."""
    n = F.floor(F.col(length) / size).cast("int")
    full = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i * size).alias("start"), ((i + 1) * size).alias("end")))
    tail = F.when((n > 0) & (F.col(length) - n * size > size / 2), F.array(F.struct((F.col(length) - size).alias("start"), F.col(length).cast("double").alias("end"))))
    return rows.select(*keep, F.inline(F.concat(full, F.coalesce(tail, F.array().cast("array<struct<start: double, end: double>>")))))


def padded(rows: DataFrame, group: str, key: str, before: float, after: float) -> DataFrame:
    """Pad both sides within the recording, then part what overlaps at the midpoint, in the order of the centres.

    A midpoint lies between the padded sides of two neighbours, whatever becomes of their other sides, so windows say it all.
    """
    whole = Window.partitionBy(group)
    w = whole.orderBy(((F.col("start") + F.col("end")) / 2).asc_nulls_last(), F.col(key).asc_nulls_last())
    first, last = F.col("start") - before, F.col("end") + after
    rows = rows.select(group, key, "start", "end", F.max("end").over(whole).alias("__last"))
    rows = rows.select(group, key, "start", "end", F.when(first < 0, 0.0).otherwise(first).alias("__s"), F.when(last > F.col("__last"), F.col("__last")).otherwise(last).alias("__e"))
    rows = rows.select(group, key, "__s", "__e", F.lag("__e").over(w).alias("__before"), F.lead("__s").over(w).alias("__behind"))
    middle = lambda x, y: (F.col(x) + F.col(y)) / 2
    start = F.when(F.col("__s") < F.col("__before"), middle("__s", "__before")).otherwise(F.col("__s"))
    end = F.when(F.col("__behind") < F.col("__e"), middle("__e", "__behind")).otherwise(F.col("__e"))
    return rows.select(group, key, start.cast("double").alias("start"), end.cast("double").alias("end"))


def merged_speech(runs: DataFrame, group: str, label: str, speech: object, shortest: float, pad: float, gap: float, longest: float) -> DataFrame:
    """Speech runs (group, label, start, end) to segments: drop short ones, pad up to the neighbour, merge up to a length (I4)."""
    rows = runs.where((F.col(label) == speech) & (F.col("end") - F.col("start") >= shortest))
    kind = dict(rows.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        out: list[list[float]] = []
        limits = pdf["start"].tolist()[1:] + [float("inf")]
        for s, e, following in zip(pdf["start"], pdf["end"], limits):
            s = max(0.0, s - pad, out[-1][1] if out else 0.0)
            e = min(e + pad, following)
            if out and s - out[-1][1] <= gap and e - out[-1][0] <= longest:
                out[-1][1] = e
            else:
                out.append([s, e])
        return pd.DataFrame({group: pdf[group].iloc[0], "start": [a for a, _ in out], "end": [b for _, b in out]})

    return by_recording(rows, group, ["start", "end"], run, f"{group} {kind}, start double, end double")


def cut_overlaps(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Cut overlapping neighbours at the middle of their overlap; a segment inside the one before is dropped."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in pdf.sort_values(["start", "end", key]).to_dict("records"):
            if kept and r["start"] < kept[-1]["end"]:
                if r["end"] <= kept[-1]["end"]:
                    continue
                middle = (r["start"] + kept[-1]["end"]) / 2
                kept[-1]["end"] = r["start"] = middle
            kept.append(r)
        return pd.DataFrame(kept, columns=list(pdf.columns))

    return by_recording(rows, group, [key, "start", "end"], run, f"{group} {fields[group]}, {key} {fields[key]}, start double, end double")


def prefer_lower(rows: DataFrame, group: str, key: str, errors: str) -> DataFrame:
    """Of overlapping neighbours the one with the lower error rate keeps the overlap."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in pdf.sort_values(["start", "end", key]).to_dict("records"):
            while kept and r["start"] < kept[-1]["end"]:
                if kept[-1][errors] <= r[errors]:
                    r["start"] = kept[-1]["end"]
                    break
                kept[-1]["end"] = r["start"]
                if kept[-1]["end"] > kept[-1]["start"]:
                    break
                kept.pop()
            if r["end"] > r["start"]:
                kept.append(r)
        return pd.DataFrame(kept, columns=list(pdf.columns))

    return by_recording(rows, group, [key, "start", "end", errors], run, f"{group} {fields[group]}, {key} {fields[key]}, start double, end double, {errors} {fields[errors]}")


#: Lengths that differ by less are equal.
TINY = 1e-5


def grouped(durations: list[float], least: float) -> list[tuple[int, int]]:
    """Ranges of consecutive items that each last at least `least`, if all together do.

    From the last item back, a range that is too short takes in the one before it or the ranges behind it, until it is long enough: that
    side which makes it so, the shorter one if both do, and the right one if neither or both alike.
    """
    ranges: list[tuple[int, int, float]] = []  # those behind, the nearest last
    total, end = 0.0, len(durations)
    for i in range(len(durations) - 1, -1, -1):
        total, handed = durations[i] + total, False
        while total < least - TINY and (i or ranges):
            left, right = durations[i - 1] if i else None, ranges[-1][2] if ranges else None
            if right is None or (left is not None and left + total >= least - TINY and (right + total < least - TINY or left < right - TINY)):
                handed = True  # the item before goes on with it
                break
            _, end, more = ranges.pop()
            total += more
        if not handed:
            ranges.append((i, end, total))
            total, end = 0.0, i
    return [(a, b) for a, b, _ in reversed(ranges)]


def together(rows: DataFrame, within: list[str], name: str, least: float) -> DataFrame:
    """rows (chain, place, `name`, length) of chains with the name of the first row of each row's range, as combined, and the range's length, as total."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [*within, name]}
    chains = rows.groupBy(*within, "chain").agg(F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("name"), "length"))).alias("l")).select(*within, F.col("l.name").alias("names"), F.col("l.length").alias("lengths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own, first, total = [], [], [], []
            names, lengths = batch.column("names"), batch.column("lengths").to_pylist()
            offsets = names.offsets.to_pylist()
            for i, x in enumerate(lengths):
                for a, b in grouped(x, least):
                    at += [i] * (b - a)
                    own += range(offsets[i] + a, offsets[i] + b)
                    first += [offsets[i] + a] * (b - a)
                    total += [sum(x[a:b])] * (b - a)
            rows_at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows_at) for c in within], names.values.take(pa.array(own, pa.int64())), names.values.take(pa.array(first, pa.int64())), pa.array(total, pa.float64())], names=[*within, name, "combined", "total"])

    return chains.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in within], f"`{name}` {kinds[name]}", f"combined {kinds[name]}", "total double"]))


def combined(rows: DataFrame, group: str, key: str, length: str, least: float) -> DataFrame:
    """group, key, combined: which rows of a group to join so that each lasts long enough; named by the first.

    Between two rows that are long enough nothing is ever joined, so a group falls into chains there, and a chain is a row in an Arrow batch.
    """
    return in_groups(rows, group, key, length, least).drop("total")


def in_groups(rows: DataFrame, group: str, key: str, length: str, least: float) -> DataFrame:
    w = Window.partitionBy(group).orderBy(key)
    long = F.col("length") >= least - TINY
    rows = rows.select(group, key, F.col(length).cast("double").alias("length")).withColumn("place", F.row_number().over(w))
    rows = rows.withColumn("cut", long & F.coalesce(F.lag(long).over(w), F.lit(False)))
    chained = rows.withColumn("chain", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return together(chained, [group], key, least)


def combined_across(rows: DataFrame, group: str, key: str, length: str, least: float) -> DataFrame:
    """group, key, combined and leader (the group that gives most of the joined row): as `combined`, and then groups that are too short as a whole are joined with what stands beside them in the order of groups.

    The order over all groups comes from ranges, and neighbours by their place in it, so no task has it all.
    """
    inner = pinned(in_groups(rows, group, key, length, least))
    heads = placed(inner.groupBy(group, "combined").agg(F.first("total").alias("length")), [F.col(group), F.col("combined")], "place")
    heads = pinned(heads)
    before = heads.select((F.col("place") + 1).alias("place"), (F.col("length") >= least - TINY).alias("__long"))
    cut = heads.join(before, "place", "left").withColumn("__cut", ((F.col("length") >= least - TINY) & F.coalesce("__long", F.lit(False))).cast("int"))
    chained = running_sums(cut, [F.col("place")], {"chain": F.col("__cut")}).withColumn("__head", F.struct(F.col(group).alias("g"), F.col("combined").alias("k")))
    joined = together(chained.select("chain", "place", "__head", "length"), [], "__head", least).select(F.col("__head.g").alias(group), F.col("__head.k").alias("__k"), F.col("combined").alias("__to"))
    out = inner.join(joined, (inner[group].eqNullSafe(joined[group])) & (F.col("combined") == F.col("__k"))).select(inner[group], key, F.col("__to"))
    sizes = out.join(rows.select(group, key, F.col(length).alias("__n")), [group, key]).groupBy("__to", group).agg(F.sum("__n").alias("__n"))
    leader = sizes.groupBy("__to").agg(F.max_by(group, F.struct("__n", group)).alias("leader"))
    return out.join(leader, "__to").select(group, key, F.col("__to.k").alias("combined"), "leader")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label: the least node of its connected component.

    Contraction: each node goes to its least neighbour's least neighbour, if these are less, and links become links between what their
    ends go to, so that each round has fewer of them; they are written to the shared folder. The least node of a component never moves.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    linked = lambda rows: pinned(rows.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    moved = lambda rows, moves, c: rows.join(moves.select(F.col("node").alias("__node"), F.col("to").alias("__to")), F.col(c) == F.col("__node"), "left").withColumn(c, F.coalesce("__to", c)).drop("__node", "__to")
    left, steps = linked(both), []
    while left.limit(1).count():
        near = left.groupBy("u").agg(F.min("v").alias("to")).withColumnRenamed("u", "node")
        steps.append(pinned(moved(near, near, "to")))
        left = linked(moved(moved(left, steps[-1], "u"), steps[-1], "v"))
    labels = both.select(F.col("u").alias("node")).unionByName(both.select(F.col("v").alias("node"))).where("node is not null").distinct().withColumn("label", F.col("node"))
    if steps:
        whole = steps.pop()
        while steps:
            # Nodes of later rounds are those that none of an earlier one left.
            whole = moved(steps[-1], whole, "to").unionByName(whole.join(steps[-1].select("node"), "node", "left_anti"))
            steps.pop()
        labels = moved(labels, whole, "label")
    return labels


def nested(subs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Sub-segments placed on the recordings of their parents (J13, I11): start and end are moved by the parent's start."""
    p = parents.select(key, F.col("start").alias("__ps"), "reco")
    return subs.join(p, key).withColumn("start", F.col("start") + F.col("__ps")).withColumn("end", F.col("end") + F.col("__ps")).drop("__ps")


def clipped(first: Column, last: Column, frames: Column) -> Column:
    """A frame range cut to the frames that there are."""
    return F.struct(first.alias("first"), F.least(last, frames - 1).alias("last"))


def frame_mask(segments: DataFrame, recordings: DataFrame, key: str, frames: str, rate: float = 100.0) -> DataFrame:
    """key and mask: for each frame whether a segment covers it."""
    spans = segments.groupBy(key).agg(F.collect_list(F.struct(F.floor(F.col("start") * rate).alias("a"), F.floor(F.col("end") * rate).alias("b"))).alias("__spans"))
    joined = recordings.join(spans, key, "left")
    covered = lambda i: F.coalesce(F.exists("__spans", lambda s: (s["a"] <= i) & (i < s["b"])), F.lit(False)).cast("int")
    return joined.select(key, F.transform(F.sequence(F.lit(0), F.col(frames).cast("int") - 1), covered).alias("mask"))


def evaluation(found: DataFrame, reference: DataFrame, group: str, width: float) -> DataFrame:
    """Lengths of found, reference, overlapping, false and missed speech, and counts of short and long segments."""
    over = overlaps(found, reference, group, width).agg(F.coalesce(F.sum("overlap"), F.lit(0)).alias("overlap"))
    length = F.col("end") - F.col("start")
    f = found.agg(F.sum(length).alias("found"), F.count(F.when(length < 0.2, 1)).alias("n_short"), F.count(F.when(length > 60, 1)).alias("n_long"))
    r = reference.agg(F.sum(length).alias("reference"))
    one = F.broadcast(f).join(F.broadcast(r)).join(F.broadcast(over))  # a row each
    return one.select("found", "reference", "overlap", (F.col("found") - F.col("overlap")).alias("false_alarm"), (F.col("reference") - F.col("overlap")).alias("missed"), "n_short", "n_long")


def merged_targets(systems: list[Column], weights: list[float], confident: float = 0.5) -> Column:
    """Frame targets of several systems as a weighted sum; zeros where no class is confident or two systems differ on one (I16)."""
    total = F.array()
    size = F.size(systems[0])
    total = F.transform(F.sequence(F.lit(1), size), lambda i: sum(F.element_at(s, i) * w for s, w in zip(systems, weights)))
    tops = F.filter(F.array(*[F.when(F.array_max(s) > confident, F.array_position(s, F.array_max(s))) for s in systems]), lambda x: x.isNotNull())
    ok = (F.size(F.array_distinct(tops)) <= 1) & (F.array_max(total) > confident)
    return F.when(ok, total).otherwise(F.transform(total, lambda x: F.lit(0.0)))


def loud_windows(wave: Column, size: int, threshold: float) -> Column:
    """The windows of an array whose mean magnitude is above a threshold, joined."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(wave), F.lit(1)), F.lit(size))
    windows = F.transform(starts, lambda i: F.slice(wave, i, size))
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(w)
    return F.flatten(F.filter(windows, lambda w: mean(w) > threshold))


def voiced_frames(vad: Column) -> Column:
    """How many frames are voiced."""
    return F.aggregate(vad, F.lit(0), lambda a, x: a + x.cast("int"))


def default_segments(durations: DataFrame, key: str, length: str) -> DataFrame:
    """One segment for each recording."""
    return durations.select(F.col(key).alias("utt"), F.col(key).alias("reco"), F.lit(0.0).alias("start"), F.col(length).cast("double").alias("end"))


def frame_shift(rows: DataFrame, key: str, length: str, frames: str) -> DataFrame:
    """Seconds a frame from the first ten rows, 0.01 where it is nearly that."""
    shift = F.sum(length) / F.sum(frames)
    return rows.orderBy(key).limit(10).agg(F.when((shift > 0.01) & (shift < 0.0102), 0.01).otherwise(shift).alias("frame_shift"))


def whole_recordings(segments: DataFrame, text: str | None = None) -> DataFrame:
    """recording, utts (in order of start), start, end and, if asked for, the joined text: a table of segments as one of whole recordings, each its own speaker.

    segments: recording, utt, start, end and the text column.
    """
    row = F.struct("start", "utt", *([F.col(text).alias("text")] if text else []))
    rows = segments.groupBy("recording").agg(F.array_sort(F.collect_list(row)).alias("__l"), F.min("start").alias("start"), F.max("end").alias("end"))
    texts = [F.array_join(F.filter(F.transform("__l", lambda x: x["text"]), lambda x: x != ""), " ").alias("text")] if text else []
    return rows.select("recording", F.col("recording").alias("speaker"), F.transform("__l", lambda x: x["utt"]).alias("utts"), "start", "end", *texts)


def as_recordings(segments: DataFrame) -> DataFrame:
    """Each segment as a recording of its own: utt, recording (the utt), start 0, end, and the piece of the old one that it is."""
    return segments.select("utt", F.col("utt").alias("recording"), F.lit(0.0).alias("start"), (F.col("end") - F.col("start")).alias("end"), F.struct(F.col("recording").alias("of"), "start", "end").alias("piece"))


#: Frames of recordings that leave a task together.
FRAMES_AT_ONCE = 1 << 17


def targets_on_recordings(recordings: DataFrame, segments: DataFrame, default: list[float], shift: float = 0.01, tolerance: int = 4) -> DataFrame:
    """recording, targets (rows of numbers): targets of segments put onto their recordings.

    recordings: recording, frames. segments: recording, utt, start, end, targets. Frames outside segments have the default row. Where
    a segment overlaps what came before, the new one fades in linearly. A segment inside what came before, outside the recording, or
    whose targets are more than `tolerance` frames off its length, is left out. The segments of a task stream past behind their recording, which is held alone.
    """
    fields = {f.name: f.dataType.simpleString() for f in recordings.schema.fields}
    width, base = len(default), np.array(default, float)

    def add(out: np.ndarray, done: int, start: float, end: float, new: np.ndarray) -> int:
        """The end of what is done, once a segment has been added to the frames `out` of its recording."""
        first, last = int(start / shift + 0.5), int(end / shift + 0.5)
        if last <= first or abs(len(new) - (last - first)) > tolerance:
            return done
        n = min(min(last, len(out)) - first, len(new))
        last = first + n
        if n <= 0 or last < done:
            return done
        both = max(0, min(done, last) - first)
        if both:
            w = (np.arange(both) / (done - first))[:, None]
            out[first : first + both] = out[first : first + both] * (1 - w) + new[:both] * w
        out[first + both : last] = new[both:n]
        return last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, outs, held = [], [], 0
        of, out, done = (), None, 0

        def finished() -> pa.RecordBatch:
            upto = np.cumsum([0, *map(len, outs)])
            frames = pa.ListArray.from_arrays(pa.array(np.arange(upto[-1] + 1) * width, pa.int32()), pa.array(np.concatenate(outs).ravel()))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), frames)], names=["recording", "targets"])

        for batch in batches:
            sizes = batch.column("size").fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            rows = batch.column("targets").flatten().to_numpy(zero_copy_only=False).reshape(upto[-1], width)
            named = zip(*(batch.column(c).to_pylist() for c in ("recording", "frames", "utt", "start", "end")))
            for i, (recording, frames, utt, start, end) in enumerate(named):
                if frames is not None:
                    if recording == of:  # a recording that is listed again
                        continue
                    if out is not None:
                        outs.append(out)
                        held += len(out)
                    if held >= FRAMES_AT_ONCE:
                        yield finished()
                        ids, outs, held = [], [], 0
                    ids.append(batch.column("recording").slice(i, 1))
                    of, out, done = recording, np.tile(base, (frames, 1)), 0
                elif recording is not None and recording == of and utt is not None:
                    done = add(out, done, start, end, rows[upto[i] : upto[i + 1]])
        if out is not None:
            outs.append(out)
            yield finished()

    # Targets are shuffled as one list of numbers a segment, which takes fewer bytes than a list of lists.
    numbers = F.col("targets").cast("array<array<double>>")
    parts = segments.select("recording", F.lit(None).cast("int").alias("frames"), "utt", F.col("start").cast("double"), F.col("end").cast("double"), F.nullif(F.size(numbers), F.lit(-1)).alias("size"), F.flatten(numbers).alias("targets"))
    names = parts.schema
    heads = recordings.select("recording", F.coalesce(F.col("frames").cast("int"), F.lit(0)).alias("frames"), *[F.lit(None).cast(names[c].dataType).alias(c) for c in ("utt", "start", "end", "size", "targets")])
    ordered = heads.unionByName(parts).repartition("recording").sortWithinPartitions("recording", F.col("frames").asc_nulls_last(), F.col("start").asc_nulls_last(), F.col("utt").asc_nulls_last())
    return ordered.mapInArrow(run, f"recording {fields['recording']}, targets array<array<double>>")
