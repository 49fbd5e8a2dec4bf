"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

The sketch is a log-bucketed histogram (DDSketch): value v > 0 falls into bucket ceil(log_g(v)), so a
quantile is right to a relative error of ACCURACY, any two sketches merge by adding counts, and the
result does not depend on partitions or order. Here the merge is a plain groupBy().sum().
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, if_small, pinned, set_apart, texts

ACCURACY = 0.002
GROWTH = (1 + ACCURACY) / (1 - ACCURACY)
#: A group of n documents has a weight of n / (n + PRIOR) in its thresholds; the rest comes from its language, and likewise from all documents.
PRIOR = 100
MAX_BROADCAST_GROUPS = 100_000

#: What a document counts, by name; then the ratios that are held against thresholds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: ratio -> (side, quantile, reach, tie): the limit lies `reach` times the way from the median to that quantile beyond it, on one side or on both.
#: tie is what is added so that values that are all but equal to each other pass; it is far below the spread of real texts.
RULES = {
    "symbol_ratio": ("high", 0.90, 3.0, 0.02),
    "dup_line_ratio": ("high", 0.98, 2.0, 0.02),
    "repeat_ratio": ("high", 0.98, 3.0, 0.02),
    "mean_word_length": ("both", 0.75, 8.0, 0.05),
}
QUANTILES = tuple(sorted({0.5, *(q for _, q, _, _ in RULES.values()), *(1 - q for side, q, _, _ in RULES.values() if side == "both")}))


def count_text(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs of anything but the six ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, "#*$%&|<>")), len(lines), dup, repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of `width` words that the text holds at least twice."""
    windows = list(zip(*(words[i:] for i in range(width))))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < len(windows) else ()
    total, end = 0, 0
    if twice:
        for i, w in enumerate(windows):
            if w in twice:
                total += i + width - max(i, end)
                end = i + width
    return total


def counted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with a struct column __counts of COUNTS (null text: as empty)."""
    kept = [c for c in docs.columns if keep is None or c in keep]
    source = docs.select(*[docs[f"`{c}`"] for c in kept], docs[text].alias("__text"))
    schema = T.StructType([*docs.select(*[docs[f"`{c}`"] for c in kept]).schema.fields, T.StructField("__counts", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches):
        for batch in batches:
            rows = [count_text(x) for x in texts(batch, "__text")]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.StructArray.from_arrays(columns, names=list(COUNTS))], names=[*kept, "__counts"])

    return source.mapInArrow(run, schema)


def ratios(counts: str = "__counts") -> dict[str, Column]:
    c = lambda name: F.col(f"{counts}.{name}")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "symbol_ratio": over(c("n_symbols"), c("n_words")),
        "dup_line_ratio": over(c("n_dup_lines"), c("n_lines")),
        "repeat_ratio": over(c("n_repeat_words"), c("n_words")),
        "mean_word_length": over(c("word_chars"), c("n_words")),
    }


def base_failed(counts: str = "__counts", min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    c = lambda name: F.col(f"{counts}.{name}")
    return (c("n_words") < min_words) | (100 * c("n_repeat_words") > max_repeat_percent * c("n_words"))


def sketch(values: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of `values` (by..., rule, value, weight): a row a bucket with its count."""
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(GROWTH))).cast("int")
    return values.groupBy(*by, "rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """by..., rule, total and a column for each quantile (q50, ...)."""
    group = Window.partitionBy(*by, "rule")
    upto = F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))
    middle = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.lit(2.0) * F.pow(F.lit(GROWTH), F.col("bucket")) / (GROWTH + 1))
    rows = sketches.select(*by, "rule", upto.alias("upto"), F.sum("n").over(group).alias("total"), middle.alias("middle"))
    picks = [F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("middle"))).alias(f"q{round(100 * q)}") for q in at]
    return rows.groupBy(*by, "rule").agg(F.max("total").alias("total"), *picks)


def limits(found: DataFrame, by: list[str]) -> DataFrame:
    """by..., total, and for each rule a struct of low (null: none) and high."""
    q = lambda x: F.col(f"q{round(100 * x)}")
    out = []
    for name, (side, at, reach, tie) in RULES.items():
        high = q(at) + reach * (q(at) - q(0.5)) + tie
        low = q(1 - at) - reach * (q(0.5) - q(1 - at)) - tie if side == "both" else F.lit(None).cast("double")
        out.append(F.max(F.when(F.col("rule") == name, F.struct(low.alias("low"), high.alias("high")))).alias(name))
    return found.groupBy(*by).agg(F.max("total").alias("total"), *out)


def blended(n: Column, own: str, other: Column) -> Column:
    """The limits of a group of n documents, drawn towards those of a wider one."""
    weight = n / (n + PRIOR)
    return F.struct(*[(weight * F.col(f"{own}.{x}") + (1 - weight) * other[x]).alias(x) for x in ("low", "high")])


def thresholds(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """lang, source and (low, high) by rule, for every pair of the two that occurs.

    Only documents that pass the base rules are sketched. The sketches of a source merge into its
    language's and those into the whole corpus's, so the wider limits need no second reading.
    """
    by = ["lang", "source"]
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), value.alias("value")) for name, value in ratios().items()]))
    passed = counts.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("v")).select(*by, "v.rule", "v.value")
    groups = pinned(sketch(passed, by))
    langs = merge(groups, ["lang"])
    fine = limits(quantiles(groups, by), by)
    wide = limits(quantiles(langs, ["lang"]), ["lang"])
    whole = limits(quantiles(merge(langs, []), []), [])
    wide = wide.select(F.col("lang").alias("wide_lang"), F.col("total").alias("wide_total"), *[F.col(r).alias(f"wide_{r}") for r in RULES])
    whole = whole.select(*[F.col(r).alias(f"whole_{r}") for r in RULES])
    joined = fine.join(wide, F.col("lang").eqNullSafe(F.col("wide_lang"))).join(F.broadcast(whole))  # whole: one row
    choose = lambda r: blended(F.col("total"), r, blended(F.col("wide_total"), f"wide_{r}", F.col(f"whole_{r}")))
    return joined.select("lang", "source", *[choose(r).alias(r) for r in RULES])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with __counts, __base_failed and __kept.

    A document is kept if it passes the base rules and each of its ratios lies within the thresholds of
    its language and source. A null text counts as empty and fails; null languages and sources are groups
    of their own; an empty table gives an empty table; repeated rows are judged alike. Columns of docs whose names begin
    with two underscores may meet ours: kept_documents has no such limit.
    """
    # The counts are made twice, once for the sketches and once for the verdict: that is cheaper than moving whole texts.
    limit_rows = pinned(thresholds(counted(docs, text, keep=[lang, source]), lang, source))
    names = {c: f"__limit_{c}" for c in limit_rows.columns}
    limit_rows = if_small(limit_rows.withColumnsRenamed(names), limit_rows.count(), MAX_BROADCAST_GROUPS)
    rows = counted(docs, text, keep)
    joined = rows.join(limit_rows, rows[lang].eqNullSafe(F.col("__limit_lang")) & rows[source].eqNullSafe(F.col("__limit_source")), "left")
    within = F.lit(True)
    for name, value in ratios().items():
        within = within & F.coalesce(value >= F.col(f"__limit_{name}.low"), F.lit(True)) & F.coalesce(value <= F.col(f"__limit_{name}.high"), F.lit(True))
    failed = base_failed()
    return joined.withColumn("__base_failed", failed).withColumn("__kept", ~failed & within).drop(*names.values())


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names."""
    rows, names, back = set_apart(docs, text, lang, source)
    return back(judged(rows, *names).where("__kept"))
