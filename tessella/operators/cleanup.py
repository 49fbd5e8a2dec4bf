"""Segments out of recordings whose words were aligned with a reference: where the two agree, with a margin, and little doubt inside (I8).

A table of edits has a row a word: utt, place, start, dur, hyp_word, ref_word, edit and tainted, as `edits.tainted` leaves it. All
steps are windows and groupings by utterance and segment; nothing is read in order by Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .keyed import small


@dataclass(frozen=True)
class Limits:
    """Seconds, unless said otherwise.

    least, least_new: shortest segment, and shortest one that is not its whole utterance. edge_silence, edge_unscored, inner_silence,
    inner_unscored: longest silences and words that do not count at the ends (cut off there) and inside (split there).
    padding: sound with an unknown word at an end that stands at an error. junk: largest share of padding and tainted rows.
    rest: shortest silence or word that does not count that an end full of junk is cut back to. deletions: how many words left out
    between two segments that are joined may stay in the text. frame: times come out as multiples of it.
    """

    least: float = 0.5
    least_new: float = 1.0
    edge_silence: float = 0.5
    edge_unscored: float = 0.5
    inner_silence: float = 2.0
    inner_unscored: float = 2.0
    padding: float = 0.05
    junk: float = 0.1
    rest: float = 0.1
    deletions: int = 1
    frame: float = 0.01


def no(x: Column) -> Column:
    return ~F.coalesce(x, F.lit(False))


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def lines(edits: DataFrame, unscored: DataFrame) -> DataFrame:
    """edits with n (place from 1), hyp_free and ref_free (words that do not count), utt_end, and gone: deletions up to the row."""
    words = small(unscored.select("word").distinct())
    rows = edits.select("utt", "place", "start", "dur", "hyp_word", "ref_word", "edit", yes(F.col("tainted")).alias("tainted"))
    for side in ("hyp", "ref"):
        rows = rows.join(words.select(F.col("word").alias("__w"), F.lit(True).alias(f"{side}_free")), F.col(f"{side}_word") == F.col("__w"), "left").drop("__w")
    w = Window.partitionBy("utt").orderBy("place")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        "utt", F.row_number().over(w).alias("n"), "start", "dur", "hyp_word", "ref_word", "edit", "tainted", yes(F.col("hyp_free")).alias("hyp_free"), yes(F.col("ref_free")).alias("ref_free"),
        F.last(F.col("start") + F.col("dur")).over(whole).alias("utt_end"), F.sum((F.col("edit") == "del").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gone"),
    )


def cores(rows: DataFrame) -> DataFrame:
    """The lines of each segment's core, and a tainted line beside it where it ends in a word that counts: rows with segment, once for each that a line is part of.

    A core is a run of lines that are right, silent or repaired and not tainted, with one at least whose words agree.
    """
    w = Window.partitionBy("utt").orderBy("n")
    agree = (F.col("edit") == "cor") & yes(F.col("hyp_word") == F.col("ref_word"))
    rows = rows.withColumn("agree", agree).withColumn("quiet", F.col("agree") | (~F.col("tainted") & F.col("edit").isin("cor", "sil", "fix")))
    rows = rows.withColumn("run", F.sum((~F.col("quiet")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("core", F.col("quiet") & yes(F.max(F.when(F.col("quiet"), F.col("agree"))).over(Window.partitionBy("utt", "run"))))
    spoken = F.col("core") & (F.col("edit") == "cor") & ~F.col("hyp_free")
    before = spoken & no(F.lag("core").over(w)) & yes(F.lag("tainted").over(w))
    after = spoken & no(F.lead("core").over(w)) & yes(F.lead("tainted").over(w))
    rows = rows.withColumns({"before": before, "after": after})
    part_of = F.array(F.when(F.lag("after").over(w), F.lag("run").over(w)), F.when(F.col("core"), F.col("run")), F.when(F.lead("before").over(w), F.lead("run").over(w)))
    return rows.withColumn("segments", F.array_compact(part_of)).select("*", F.explode("segments").alias("segment")).drop("segments", "run", "core", "before", "after", "quiet")


def pieces(rows: DataFrame, limits: Limits) -> DataFrame:
    """Segments split in the middle of long silences and of long words that do not count: a row a piece, with its first and last line and
    the first and last line inside that it may be cut back to, and the lines where words agree that count."""
    w = Window.partitionBy("utt", "segment").orderBy("n")
    inside = F.lag("n").over(w).isNotNull() & F.lead("n").over(w).isNotNull()
    long = ((F.col("edit") == "sil") & (F.col("dur") > limits.inner_silence)) | (F.col("ref_free") & (F.col("dur") > limits.inner_unscored))
    rows = rows.withColumn("halved", inside & long)
    rows = rows.withColumn("done", F.coalesce(F.sum(F.col("halved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("piece", F.explode(F.when(F.col("halved"), F.array("done", F.col("done") + 1)).otherwise(F.array("done")))).drop("done")
    w = Window.partitionBy("utt", "segment", "piece").orderBy("n")
    inside = F.lag("n").over(w).isNotNull() & F.lead("n").over(w).isNotNull()
    rest = inside & ((F.col("edit") == "sil") | ((F.col("edit") == "cor") & F.col("ref_free"))) & (F.col("dur") > limits.rest)
    rows = rows.withColumns({"rest": rest, "line": F.struct("n", "start", "dur", "edit", "ref_free", "tainted", "halved", "gone")})
    counts = F.col("agree") & ~F.col("ref_free")
    return rows.groupBy("utt", "segment", "piece").agg(
        F.first("utt_end").alias("utt_end"), F.min_by("line", "n").alias("first"), F.max_by("line", "n").alias("last"),
        F.min_by("line", F.when(F.col("rest"), F.col("n"))).alias("rest_first"), F.max_by("line", F.when(F.col("rest"), F.col("n"))).alias("rest_last"),
        F.array_sort(F.collect_list(F.when(counts, F.col("n")))).alias("scored"),
    )


def start_of() -> Column:
    return F.col("first.start") + F.col("first.dur") - F.col("pad_first") - F.col("first.dur") * F.col("keep_first")


def end_of() -> Column:
    return F.col("last.start") + F.col("last.dur") * F.col("keep_last") + F.col("pad_last")


def length_of() -> Column:
    return end_of() - start_of()


def trimmed(rows: DataFrame, limits: Limits) -> DataFrame:
    """pieces with keep_first and keep_last, the shares of their first and last lines that stay, and pad_first and pad_last.

    Long silences and words that do not count are cut at the ends, as far as the piece stays long enough; a piece that
    ends in a word that counts is padded, unless less than half the padding fits into the utterance.
    """

    def kept(side: str) -> Column:
        line = F.col(side)
        most = F.when((line["edit"] == "sil") & (line["dur"] > limits.edge_silence), limits.edge_silence).when(line["ref_free"] & (line["dur"] > limits.edge_unscored), limits.edge_unscored)
        # A halved line is the end of one piece and the start of the next.
        halved = line["halved"] & ((F.col("piece") > 0) if side == "first" else F.lit(True))
        return F.coalesce(most / line["dur"], F.when(halved, 0.5).otherwise(1.0))

    rows = rows.withColumns({"keep_first": kept("first"), "keep_last": kept("last"), "pad_first": F.lit(0.0), "pad_last": F.lit(0.0)})
    enough = max(limits.least, limits.least_new)
    rows = rows.withColumns({"cut_first": F.col("keep_first"), "cut_last": F.col("keep_last"), "short": length_of()})
    whole = lambda side: F.when(F.col(f"{side}.tainted"), F.col(f"cut_{side}")).otherwise(1.0)
    rows = rows.withColumns({"keep_first": whole("first"), "keep_last": whole("last")}).withColumn("long", length_of())
    a = (F.lit(enough) - F.col("long")) / (F.col("short") - F.col("long"))
    between = lambda side: F.when(F.col("short") >= enough, F.col(f"cut_{side}")).when(F.col("long") <= enough, F.col(f"keep_{side}")).otherwise(a * F.col(f"cut_{side}") + (1 - a) * F.col(f"keep_{side}"))
    rows = rows.withColumns({"keep_first": between("first"), "keep_last": between("last")}).drop("cut_first", "cut_last", "short", "long")
    room = {"first": F.col("first.start"), "last": F.col("utt_end") - (F.col("last.start") + F.col("last.dur"))}
    for side, space in room.items():
        fits = F.least(F.lit(limits.padding), space)
        spoken = (F.col(f"{side}.edit") == "cor") & ~F.col(f"{side}.ref_free")
        rows = rows.withColumn(f"pad_{side}", F.when(spoken & (fits >= 0.5 * limits.padding), fits).otherwise(0.0))
    return rows


def junk_at(side: str) -> Column:
    return F.col(f"pad_{side}") + F.when(F.col(f"{side}.tainted"), F.col(f"{side}.dur") * F.col(f"keep_{side}")).otherwise(0.0)


def judged(rows: DataFrame, limits: Limits) -> DataFrame:
    """Trimmed pieces, ends full of junk cut back to a rest inside, with dropped: null, or why the piece goes ('new', 'short', 'unscored', 'junk')."""
    entire = (F.abs(start_of()) < 0.001) & (F.abs(end_of() - F.col("utt_end")) < 0.001)
    # A thousandth is left to rounding.
    short = F.when(~entire & (length_of() < 0.999 * limits.least_new), "new").when(length_of() < 0.999 * limits.least, "short")
    rows = rows.withColumn("dropped", short)
    for side, rest, removed in (("first", "rest_first", F.col("rest_first.start") - start_of()), ("last", "rest_last", end_of() - (F.col("rest_last.start") + F.col("rest_last.dur")))):
        cut = (junk_at(side) > 0) & F.col(rest).isNotNull() & (junk_at(side) >= limits.junk * removed)
        if side == "last":
            cut &= F.col("rest_last.n") > F.col("first.n")
        rows = rows.withColumn("__cut", yes(cut))
        rows = rows.withColumns({side: F.when(F.col("__cut"), F.col(rest)).otherwise(F.col(side)), f"keep_{side}": F.when(F.col("__cut"), 1.0).otherwise(F.col(f"keep_{side}")), f"pad_{side}": F.when(F.col("__cut"), 0.0).otherwise(F.col(f"pad_{side}"))})
    rows = rows.drop("__cut")
    heard = F.exists("scored", lambda n: n.between(F.col("first.n"), F.col("last.n")))
    share = (junk_at("first") + junk_at("last")) / length_of()
    return rows.withColumn("dropped", F.coalesce("dropped", F.when(~heard, "unscored").when(share > limits.junk, "junk")))


def candidates(edits: DataFrame, unscored: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """utt, first, last (lines), start, end and dropped of every piece that was looked at, to see what the limits cost."""
    rows = judged(trimmed(pieces(cores(lines(edits, unscored)), limits), limits), limits)
    return rows.select("utt", F.col("first.n").alias("first"), F.col("last.n").alias("last"), start_of().alias("start"), end_of().alias("end"), "dropped")


def segments_from_edits(edits: DataFrame, unscored: DataFrame, limits: Limits = Limits(), unknown: str = "<unk>") -> DataFrame:
    """utt, segment (from 1), start, end (multiples of the frame), text, first and last (lines) of the segments of every utterance.

    Pieces that meet are joined; words left out between them stay in the text if they are few. Text is the reference, with
    `unknown` for each padding. Utterances without a segment have no rows; null words are none; an empty table gives an empty table.
    """
    base = lines(edits, unscored)
    # Pinned, as a filter on what the limits say would repeat all their expressions below it.
    kept = pinned(judged(trimmed(pieces(cores(base), limits), limits), limits)).where("dropped IS NULL")
    rows = kept.select("utt", "first", "last", start_of().alias("start"), end_of().alias("end"), "pad_first", "pad_last")
    w = Window.partitionBy("utt").orderBy(F.col("first.n"), F.col("last.n"))
    rows = rows.withColumn("prior", F.lag("last").over(w)).withColumn("meets", yes(F.lag("end").over(w) >= F.col("start")))
    low, high = F.least("prior.n", "first.n"), F.greatest("prior.n", "first.n")
    is_gone = lambda line: (line["edit"] == "del").cast("int")
    of = lambda want: F.when(F.col("prior.n") == want, F.col("prior")).otherwise(F.col("first"))
    lost = of(high)["gone"] - of(low)["gone"] + is_gone(of(low))
    rows = rows.withColumn("left_out", F.when(F.col("meets") & (lost > limits.deletions), F.struct(low.alias("low"), high.alias("high"))))
    rows = rows.withColumn("segment", F.sum((~F.col("meets")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy("utt", "segment").agg(
        F.min("first.n").alias("first"), F.max_by("last.n", F.col("first.n")).alias("last"), F.min_by("start", F.col("first.n")).alias("start"), F.max_by("end", F.col("first.n")).alias("end"),
        (F.min_by("pad_first", F.col("first.n")) != 0).alias("opens"), (F.max_by("pad_last", F.col("first.n")) != 0).alias("closes"), F.collect_list("left_out").alias("left_out"),
    )
    each = joined.select("utt", "segment", "left_out", F.explode(F.sequence("first", "last")).alias("n")).join(base.select("utt", "n", "ref_word", "edit"), ["utt", "n"])
    shown = F.col("ref_word").isNotNull() & ~((F.col("edit") == "del") & F.exists("left_out", lambda r: F.col("n").between(r["low"], r["high"])))
    words = each.where(shown).groupBy("utt", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "ref_word"))).alias("l"))
    unk = F.array(F.lit(unknown))
    none = F.array().cast("array<string>")
    text = F.concat(F.when(F.col("opens"), unk).otherwise(none), F.coalesce(F.transform("l", lambda x: x["ref_word"]), none), F.when(F.col("closes"), unk).otherwise(none))
    frames = lambda x: F.rint(F.col(x) / limits.frame) * limits.frame
    return joined.join(words, ["utt", "segment"], "left").select("utt", "segment", frames("start").alias("start"), frames("end").alias("end"), F.array_join(text, " ").alias("text"), "first", "last")


def words_lost(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """word, lost (share of its places outside all segments) and total of every reference word, the worst first by lost^3 times total."""
    w = Window.partitionBy("utt").orderBy("place")
    rows = edits.select("utt", F.row_number().over(w).alias("n"), F.col("ref_word").alias("word"))
    inside = segments.select("utt", F.explode(F.sequence("first", "last")).alias("n")).distinct().withColumn("__in", F.lit(True))
    counted = rows.join(inside, ["utt", "n"], "left").where("word IS NOT NULL").groupBy("word").agg(F.count_if(F.col("__in").isNull()).alias("__lost"), F.count("*").alias("total"))
    return counted.select("word", (F.col("__lost") / F.col("total")).alias("lost"), "total").orderBy(F.desc(F.pow("lost", F.lit(3)) * F.col("total")), "word")
