"""Segments out of per-frame decodes: speech with some silence around it, in pieces that are not too long."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import islands

SILENCE, NOISE, SPEECH = 0, 1, 2


def runs_of(frames: DataFrame) -> DataFrame:
    """recording, start, end (exclusive), label of the runs of equal labels in rows of recording, frame (from 0, without gaps), label."""
    return islands(frames, "recording", "frame", "label").select("recording", F.col("first").alias("start"), (F.col("last") + 1).alias("end"), "label")


def sounds(runs: DataFrame) -> DataFrame:
    """recording, k (from 1), start, end, frames (of the recording) and gap (silence before it) of each stretch without silence."""
    w = Window.partitionBy("recording").orderBy("start")
    rows = runs.withColumns({"__k": F.sum((F.col("label") == SILENCE).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "frames": F.max("end").over(Window.partitionBy("recording"))})
    found = rows.where(F.col("label") != SILENCE).groupBy("recording", "__k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("frames").alias("frames"))
    return found.select("recording", F.row_number().over(w).alias("k"), "start", "end", "frames", (F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0))).alias("gap"))


def widened(rows: DataFrame, silence: float) -> DataFrame:
    """`sounds` with starts and ends moved out, all at the same pace, until silence is that share of what is inside, or nothing is left to take.

    The ends around a gap share it, the earlier one takes an odd frame. As a boundary moves a frame a round until its share is
    used up, the number of rounds is the level up to which the sorted shares fill the budget; what is left
    after full rounds goes to the first boundaries that still can move.
    """
    w = Window.partitionBy("recording").orderBy("start")
    after = F.lead("gap").over(w)
    rows = rows.withColumns({"__before": F.when(F.col("k") == 1, F.col("gap")).otherwise(F.floor(F.col("gap") / 2)), "__after": F.when(after.isNull(), F.col("frames") - F.col("end")).otherwise(F.ceil(after / 2))})
    sound = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("recording"))
    rows = rows.withColumn("__budget", F.floor(sound / (1.0 - silence)) - sound)
    side = lambda place, room: F.struct((2 * F.col("k") + place).alias("at"), F.col(room).cast("long").alias("room"))
    ends = rows.select("recording", "k", F.col("__budget").alias("budget"), F.inline(F.array(side(0, "__before"), side(1, "__after"))))
    whole = Window.partitionBy("recording")
    rising = whole.orderBy("room", "at")
    # If all rounds stopped at this boundary's room, so many frames would be taken, and so many boundaries could go on.
    ends = ends.withColumns({"rank": F.row_number().over(rising), "count": F.count("*").over(whole), "smaller": F.sum("room").over(rising.rowsBetween(Window.unboundedPreceding, 0))})
    ends = ends.withColumn("taken", F.col("smaller") + (F.col("count") - F.col("rank")) * F.col("room"))
    full = F.max(F.when(F.col("taken") <= F.col("budget"), F.struct("room", "taken", "rank"))).over(whole)
    ends = ends.withColumn("full", full)
    ends = ends.withColumns({"room_full": F.coalesce("full.room", F.lit(0)), "rest": F.col("budget") - F.coalesce("full.taken", F.lit(0)), "more": F.nullif(F.col("count") - F.coalesce("full.rank", F.lit(0)), F.lit(0))})
    ends = ends.withColumns({"rounds": F.col("room_full") + F.coalesce(F.floor(F.col("rest") / F.col("more")), F.lit(0)), "last": F.coalesce(F.col("rest") % F.col("more"), F.lit(0))})
    open_ = F.col("room") > F.col("rounds")
    turn = F.sum(open_.cast("int")).over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    moved = ends.withColumn("moved", F.least("room", "rounds") + F.when(open_ & (turn <= F.col("last")), 1).otherwise(0))
    by_sound = moved.groupBy("recording", "k").agg(F.min_by("moved", "at").alias("__left"), F.max_by("moved", "at").alias("__right"))
    done = rows.join(by_sound, ["recording", "k"])
    return done.select("recording", "k", (F.col("start") - F.col("__left")).alias("start"), (F.col("end") + F.col("__right")).alias("end"), "gap")


def merged(starts: list[int], ends: list[int], gaps: list[int], most: float, shift: float) -> list[tuple[int, int]]:
    """Stretches that touch, put together in the order of the silence between them as long as they stay within `most` seconds."""
    first, last = list(range(len(starts))), list(range(len(starts)))  # of the stretch that ends, or begins, here
    joined = set()
    for i in sorted(range(1, len(starts)), key=gaps.__getitem__):
        a, b = first[i - 1], last[i]
        if (ends[b] - starts[a]) * shift <= most:
            first[b], last[a] = a, b
            joined.add(i)
    opens = [i for i in range(len(starts)) if i not in joined]
    return [(starts[i], ends[j - 1]) for i, j in zip(opens, [*opens[1:], len(starts)])]


def joined_up(rows: DataFrame, most: float, shift: float) -> DataFrame:
    """recording, start, end of `widened` stretches, merged where they touch. A chain of touching ones is one row in an Arrow batch; chains are
    cut beforehand where even two neighbours are too long together, as such a boundary never goes."""
    w = Window.partitionBy("recording").orderBy("start")
    can = (F.lag("end").over(w) == F.col("start")) & ((F.col("end") - F.lag("start").over(w)) * shift <= most)
    rows = rows.withColumn("__opens", ~F.coalesce(can, F.lit(False)))
    rows = rows.withColumn("chain", F.sum(F.col("__opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = ("start", "end", "gap")
    chains = rows.groupBy("recording", "chain").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in parts]))).alias("l"))
    chains = chains.select("recording", *[F.col(f"l.{c}").alias(c) for c in parts])
    kind = rows.schema["recording"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (s, e, g) in enumerate(zip(*(batch.column(c).to_pylist() for c in parts))):
                new = merged(s, e, g, most, shift)
                at += [i] * len(new)
                found += new
            yield pa.RecordBatch.from_arrays([batch.column("recording").take(pa.array(at, pa.int64())), pa.array([s for s, _ in found], pa.int64()), pa.array([e for _, e in found], pa.int64())], names=["recording", "start", "end"])

    return chains.mapInArrow(run, f"recording {kind}, start bigint, end bigint")


def with_speech(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """segments (recording, start, end) with speech: how many of their frames are. Speech up to a frame is looked up in the run that holds it, by one window over both."""
    w = Window.partitionBy("recording").orderBy("start")
    frames = F.when(F.col("label") == SPEECH, F.col("end") - F.col("start")).otherwise(0)
    upto = runs.select("recording", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("start").cast("long").alias("start"), (F.col("label") == SPEECH).alias("on"), (F.sum(frames).over(w) - frames).cast("long").alias("sum")).alias("run"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("of"))
    own = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    asked = segments.select("recording", F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(upto.schema["run"].dataType).alias("run"), own.alias("of"))
    along = Window.partitionBy("recording").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = upto.unionByName(asked).withColumn("__in", F.last("run", ignorenulls=True).over(along)).where("kind = 1")
    so_far = F.col("__in.sum") + F.when(F.col("__in.on"), F.col("at") - F.col("__in.start")).otherwise(0)
    return held.groupBy("recording", "of").agg((F.max(so_far) - F.min(so_far)).alias("speech")).select("recording", "of.start", "of.end", "speech")


def segments_from_decodes(runs: DataFrame, silence: float = 0.2, shift: float = 0.01, most: float = 15.0, hard_most: float = 30.0, noise_only: bool = False, separators: tuple[str, str] = ("-", "-")) -> DataFrame:
    """utt, recording, start, end (seconds) and speech (frames) of the segments of recordings given as runs (recording, start, end, label).

    Runs of label 0 (silence), 1 (noise) and 2 (speech) cover a recording from frame 0 on. Stretches without silence are widened to the
    share of silence, merged where they then touch, the least silence first, up to `most` seconds, and cut in equal parts
    above hard_most; those without speech go unless noise_only. Recordings of silence alone have no rows.
    """
    found = joined_up(widened(sounds(runs), silence), most, shift)
    limit = int(hard_most / shift)
    long = F.col("end") - F.col("start")
    parts = F.when(long > limit, F.ceil(long / limit)).otherwise(1).cast("long")
    cut = found.withColumns({"parts": parts, "each": F.floor(long / parts)}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cut = cut.select("recording", (F.col("start") + F.col("i") * F.col("each")).alias("start"), F.when(F.col("i") + 1 == F.col("parts"), F.col("end")).otherwise(F.col("start") + (F.col("i") + 1) * F.col("each")).alias("end"))
    rows = with_speech(cut, runs)
    rows = rows if noise_only else rows.where("speech > 0")
    hundredths = lambda c: F.round(F.col(c) * shift * 100).cast("long")
    last = F.max(hundredths("end")).over(Window.partitionBy("recording"))
    width = F.when(last > 1, 1 + F.length((last - 1).cast("string"))).otherwise(1)
    rows = rows.withColumn("__width", width)
    padded = lambda c: F.lpad(hundredths(c).cast("string"), F.col("__width"), F.lit("0"))
    utt = F.concat(F.col("recording").cast("string"), F.lit(separators[0]), padded("start"), F.lit(separators[1]), padded("end"))
    return rows.select(utt.alias("utt"), "recording", (hundredths("start") / 100).alias("start"), (hundredths("end") / 100).alias("end"), "speech")
