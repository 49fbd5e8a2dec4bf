"""Words with times and edits against a reference: outcomes, depths, taint, clean-up; soft counts of pronunciations.

A table of edits has a row a word: utt, place, hyp_word, ref_word, edit. Words that are not there are null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import small

#: Edits that are errors, and edits of rows without words that matter.
ERRORS = ("del", "sub", "ins")
QUIET = ("sil", "fix")


def with_outcomes(words: DataFrame, outcomes: DataFrame, utt: str = "utt", start: str = "start", word: str = "word") -> DataFrame:
    """words with the outcome (column op) of the same place in their utterance.

    outcomes: utt, place (from 0), op, hyp_word. The shorter of the two lists ends the pairing; utterances without
    outcomes go; a word that is not the outcome's raises.
    """
    placed = words.withColumn("__place", F.row_number().over(Window.partitionBy(utt).orderBy(start)) - 1)
    other = outcomes.select(F.col("utt").alias("__utt"), F.col("place").alias("__at"), "op", F.col("hyp_word").alias("__hyp"))
    met = placed.join(other, (F.col(utt) == F.col("__utt")) & (F.col("__place") == F.col("__at")))
    same = F.col(word).cast("string").eqNullSafe(F.col("__hyp").cast("string"))
    # The check is part of a column of the result, so that it is not left out.
    op = F.when(same, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("words differ: "), F.col(word).cast("string"))).cast("string"))
    return met.withColumn("op", op).drop("__place", "__utt", "__at", "__hyp")


def mean_over(values: Column, start: Column, length: Column, rate: float = 100.0) -> Column:
    """Mean of a per-frame array over an interval in seconds, edges rounded half to even; null where no frame is inside."""
    first, last = F.bround(rate * start, 0).cast("int"), F.bround(rate * (start + length), 0).cast("int")
    inside = F.slice(values, first + 1, F.greatest(last - first, F.lit(0)))
    return F.try_divide(F.aggregate(inside, F.lit(0.0), lambda a, x: a + x), F.size(inside))


def with_depth(words: DataFrame, depths: DataFrame, utt: str = "utt", start: str = "start", length: str = "dur", rate: float = 100.0) -> DataFrame:
    """words with log_depth, the log of the mean depth over their time; depths: utt, depth (an array with a value a frame)."""
    joined = words.join(depths.select(F.col("utt").alias("__utt"), F.col("depth").alias("__depth")), F.col(utt) == F.col("__utt"), "left")
    return joined.withColumn("log_depth", F.ln(mean_over(F.col("__depth"), F.col(start), F.col(length), rate))).drop("__utt", "__depth")


def tainted(edits: DataFrame, remove_deletions: bool = True) -> DataFrame:
    """edits with tainted: rows of silence, of repairs and of unknown words for real ones that stand next to an error, or in a run of such rows next to one.

    A deletion that taints a row goes, if asked for.
    """
    w = Window.partitionBy("utt").orderBy("place")
    can = F.col("edit").isin(*QUIET) | ((F.col("edit") == "cor") & ~F.col("hyp_word").eqNullSafe(F.col("ref_word")))
    rows = edits.withColumn("__can", can).withColumn("__stop", F.when(~F.col("__can"), F.col("edit").isin(*ERRORS)))
    before = F.last("__stop", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__stop", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(F.lag("__can").over(w), F.lit(False)) | F.coalesce(F.lead("__can").over(w), F.lit(False))
    rows = rows.withColumn("tainted", F.col("__can") & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))).withColumn("__near", near)
    if remove_deletions:
        rows = rows.where(~((F.col("edit") == "del") & F.col("__near")))
    return rows.drop("__can", "__stop", "__near")


def without_unscored(edits: DataFrame, unscored: DataFrame) -> DataFrame:
    """edits in which words that do not count (table: word) are no errors.

    An inserted one, or one for another of them, becomes the reference as a repair ('fix'); a deleted one goes.
    """
    words = small(unscored.select("word").distinct())
    marked = edits.join(words.select(F.col("word").alias("__h"), F.lit(True).alias("__hyp")), F.col("hyp_word") == F.col("__h"), "left")
    marked = marked.join(words.select(F.col("word").alias("__r"), F.lit(True).alias("__ref")), F.col("ref_word") == F.col("__r"), "left")
    hyp, ref = F.coalesce("__hyp", F.lit(False)), F.coalesce("__ref", F.lit(False))
    fixed = ((F.col("edit") == "ins") & hyp) | ((F.col("edit") == "sub") & hyp & ref)
    rows = marked.where(~((F.col("edit") == "del") & ref)).withColumn("__fixed", fixed)
    rows = rows.withColumn("ref_word", F.when(F.col("__fixed"), F.col("hyp_word")).otherwise(F.col("ref_word"))).withColumn("edit", F.when(F.col("__fixed"), "fix").otherwise(F.col("edit")))
    return rows.select(*edits.columns)


def repetitions_allowed(edits: DataFrame, unscored: DataFrame) -> DataFrame:
    """edits (utt, place, hyp_word, ref_word, edit) in which a word or a pair of words said twice, once rightly, is correct both times.

    Only rows with a word that counts are looked at. Pairs come first; a row is part of one repetition at most, so
    each utterance is read in order, in a task of its own.
    """
    words = small(unscored.select("word").distinct())
    flagged = edits.join(words.select(F.col("word").alias("__h"), F.lit(True).alias("__hyp")), F.col("hyp_word") == F.col("__h"), "left")
    flagged = flagged.join(words.select(F.col("word").alias("__r"), F.lit(True).alias("__ref")), F.col("ref_word") == F.col("__r"), "left")
    counts = (F.col("hyp_word").isNotNull() & F.col("__hyp").isNull()) | (F.col("ref_word").isNotNull() & F.col("__ref").isNull())
    # The right word for one that does not count is an insertion to this rule.
    edit = F.when((F.col("edit") == "sub") & F.col("__ref").isNotNull(), "ins").otherwise(F.col("edit"))
    rows = flagged.select("utt", "place", F.col("hyp_word").alias("hyp"), edit.alias("kind"), counts.alias("counts")).where("counts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        said, kinds, fix = pdf["hyp"].tolist(), pdf["kind"].tolist(), []
        for size in (2, 1):
            for i in range(len(said) - 2 * size + 1):
                once, twice = said[i : i + size], said[i + size : i + 2 * size]
                if once != twice or None in once or (size == 2 and once[0] == once[1]):
                    continue
                found = kinds[i : i + 2 * size]
                if found in (["cor"] * size + ["ins"] * size, ["ins"] * size + ["cor"] * size):
                    fix += range(i + size, i + 2 * size) if found[0] == "cor" else range(i, i + size)
                    kinds[i : i + 2 * size] = [None] * (2 * size)
        return pdf.iloc[fix][["utt", "place"]]

    types = {f.name: f.dataType.simpleString() for f in edits.schema.fields}
    fixes = rows.groupBy("utt").applyInPandas(run, f"utt {types['utt']}, place {types['place']}").withColumn("__fix", F.lit(True))
    out = edits.join(fixes, ["utt", "place"], "left")
    out = out.withColumn("ref_word", F.when(F.col("__fix"), F.col("hyp_word")).otherwise(F.col("ref_word"))).withColumn("edit", F.when(F.col("__fix"), "cor").otherwise(F.col("edit")))
    return out.select(*edits.columns)


def soft_counts(rows: DataFrame, mapping: DataFrame, word: str = "word", phones: str = "phones", count: str = "count", missing: str | None = None) -> DataFrame:
    """word, pron, count: soft counts summed by word and mapped phones (A21); mapping: phone, to. A phone without a mapping counts as `missing`, or keeps its name.

    Counts are summed by the phones first, so each different pronunciation is mapped once.
    """
    sums = rows.groupBy(F.col(word).alias("word"), F.col(phones).alias("__p")).agg(F.sum(count).alias("__c"))
    listed = sums.select("word", "__c", "__p", F.posexplode_outer("__p").alias("__i", "__phone"))
    named = listed.join(small(mapping.select(F.col("phone").alias("__of"), "to")), F.col("__phone") == F.col("__of"), "left")
    one = F.coalesce("to", F.lit(missing) if missing is not None else F.col("__phone"))
    again = named.groupBy("word", "__p").agg(F.first("__c").alias("__c"), F.array_sort(F.collect_list(F.struct("__i", one.alias("x")))).alias("__l"))
    pron = F.array_join(F.transform("__l", lambda x: x["x"]), " ")
    return again.groupBy("word", pron.alias("pron")).agg(F.sum("__c").alias("count"))


def variant_quota(words: DataFrame, lexicon: DataFrame, ratio: float = 1.0) -> DataFrame:
    """word, quota: ratio times the pronunciations that a lexicon (word, pron) has for it, or for an average word, rounded up, where it has none."""
    own = lexicon.select("word", "pron").distinct().groupBy("word").agg(F.count("*").alias("__own"))
    usual = own.agg(F.ceil(F.sum("__own") / F.count("*")).alias("__usual"))
    joined = words.select("word").distinct().join(own, "word", "left").join(F.broadcast(usual))  # usual: one row
    return joined.select("word", (F.lit(ratio) * F.coalesce("__own", "__usual")).alias("quota"))
