"""Keyed text: mapping files, lists, segments, scores, egs tables. Explicit columns, no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mapping files of a data directory, with their value types; arrays are lists to the end of the line.
MAPPINGS = {
    "utt2spk": "string", "spk2utt": "array<string>", "text": "array<string>", "wav.scp": "string", "feats.scp": "string", "vad.scp": "string",
    "utt2dur": "double", "utt2num_frames": "int", "utt2sr": "int", "utt2spk_int": "int", "utt2chunk": "string", "spk2gender": "string", "utt2lang": "string", "utt2uniq": "string",
}
EGS = "`eg-id` string, `ark-path` string, `start-position` int, `end-position` int, `class-label` int, `eg-dur` double"
RAW_EGS = "`eg-id` string, `wav-path` string, `sample-rate` int, duration double, `eg-dur` double, `start-position` int, `end-position` int, `class-label` int"
SHARDS = "`eg-path` string, `eg-dur` double, `eg-num` int"


def fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_mapping(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """key and value, or values where the type is an array."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = fields(F.col("value"))
    if kind.startswith("array"):
        return lines.select(parts[0].alias("key"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).cast(kind).alias("values"))
    return lines.select(parts[0].alias("key"), F.try_element_at(parts, F.lit(2)).cast(kind).alias("value"))


def write_mapping(rows: DataFrame, path: str) -> None:
    """All columns of a row on a line, arrays spread out (S3)."""
    columns = [F.array_join(F.col(f.name).cast("array<string>"), " ") if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string") for f in rows.schema.fields]
    rows.select(F.concat_ws(" ", *columns)).write.text(path)


def read_data_dir(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """One wide table by utterance of the mapping files asked for (S2); a file that is missing raises."""
    out = None
    for name in expected:
        one = read_mapping(spark, f"{path}/{name}", MAPPINGS[name])
        one = one.withColumnRenamed("values" if "values" in one.columns else "value", name.replace(".scp", ""))
        out = one if out is None else out.join(one, "key", "left")
    return out


def write_data_dir(rows: DataFrame, path: str) -> None:
    """A mapping file for each column but the key (S3)."""
    for c in rows.columns:
        if c != "key":
            write_mapping(rows.select("key", c).where(F.col(c).isNotNull()), f"{path}/{c}")


def copied(rows: DataFrame, key: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """A copy with rewritten keys and the old ones as lineage."""
    return rows.withColumn("uniq", F.col(key)).withColumn(key, F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix)))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """utt, reco, start, end."""
    p = fields(F.col("value"))
    return spark.read.text(path).select(p[0].alias("utt"), p[1].alias("reco"), p[2].cast("double").alias("start"), p[3].cast("double").alias("end"))


def read_ctm(spark: SparkSession, path: str) -> DataFrame:
    """file, channel, start, duration, word, confidence (1.0 where it is left out) and, for edits, ref_word and edit."""
    p = fields(F.col("value"))
    at = lambda i: F.try_element_at(p, F.lit(i + 1))
    return spark.read.text(path).select(at(0).alias("file"), at(1).alias("channel"), at(2).cast("double").alias("start"), at(3).cast("double").alias("duration"), at(4).alias("word"), F.coalesce(at(5).cast("double"), F.lit(1.0)).alias("confidence"), at(6).alias("ref_word"), at(7).alias("edit"))


def write_rttm(segments: DataFrame, utt2spk: DataFrame, path: str) -> None:
    """Speaker lines of segments (utt, reco, start, end) with their speakers (utt, spk)."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA>", "reco", "start", F.col("end") - F.col("start"), "spk")
    segments.join(utt2spk, "utt").orderBy("reco", "start").select(line).write.text(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """enroll, test, score; lines that start with # are skipped."""
    p = fields(F.col("value"))
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.where(F.size(p) == 3).select(p[0].alias("enroll"), p[1].alias("test"), p[2].cast("double").alias("score"))


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix with a header of enroll names as rows enroll, test, score."""
    wide = spark.read.csv(path, sep=" ", header=True)
    first, *names = wide.columns
    return wide.select(F.col(first).alias("test"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).unpivot("test", names, "enroll", "score").where("score > double('-inf')")


def read_egs(spark: SparkSession, path: str, schema: str = EGS, columns: list[str] | None = None) -> DataFrame:
    """A chunk table with a header that must match."""
    rows = spark.read.csv(path, sep=" ", header=True, schema=schema, enforceSchema=False)
    return rows if columns is None else rows.select(*[f"`{c}`" for c in columns])


def write_egs(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep=" ", header=True)


def read_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of a pattern in the lines that match, with the file's name."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), *[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def list_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, utt (the name without its ending), and spk (the folder) of files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    return files.select("path", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("utt"), F.element_at(parts, -2).alias("spk"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Keyword hits of an XML list."""
    return spark.read.format("xml").option("rowTag", "detected_kwlist").load(path)


def noise_pieces(rows: DataFrame, key: str, length: str, most: float) -> DataFrame:
    """Clips cut into pieces of at most `most` seconds."""
    n = F.greatest(F.ceil(F.col(length) / most), F.lit(1)).cast("int")
    out = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("start", F.col("piece") * most).withColumn("duration", F.least(F.lit(most), F.col(length) - F.col("piece") * most))


def range_of(path: Column) -> Column:
    """path, offset and row range of an index entry such as 'a.ark:12[3:9]' (S4, F14)."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"^(.*?)(?::(\d+))?(?:\[(\d+):(\d+)\])?$", i), F.lit(""))
    return F.struct(part(1).alias("path"), part(2).cast("bigint").alias("offset"), part(3).cast("int").alias("row0"), part(4).cast("int").alias("row1"))


def refuse_pipes(index: DataFrame, path: str = "path") -> DataFrame:
    """Index entries that are shell commands are an error."""
    return index.where(F.when(F.col(path).endswith("|"), F.raise_error(F.concat(F.lit("a shell pipe is not read: "), F.col(path)))).otherwise(True))


def bracketed(line: Column) -> Column:
    """The contents of each [ ... ] of a line, as lists of words."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != ""))


def read_posteriors(spark: SparkSession, path: str) -> DataFrame:
    """key and frames, an array a frame of (id, weight), from lines 'key [ id weight id weight ] [ ... ]'; confusion networks have the same form."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    pairs = lambda f: F.transform(F.sequence(F.lit(1), F.size(f) - 1, F.lit(2)), lambda i: F.struct(F.element_at(f, i).cast("int").alias("id"), F.element_at(f, i + 1).cast("double").alias("weight")))
    none = F.array().cast("array<struct<id: int, weight: double>>")
    return lines.select(fields(F.col("value"))[0].alias("key"), F.transform(bracketed(F.col("value")), lambda f: F.when(F.size(f) > 1, pairs(f)).otherwise(none)).alias("frames"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """key and intervals (begin, end) from lines 'key begin end ; begin end ;' (S8)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rest = F.regexp_replace(F.trim("value"), r"^\S+\s*", "")
    parts = F.filter(F.transform(F.split(rest, ";"), lambda x: fields(x)), lambda x: F.size(x) == 2)
    return lines.select(fields(F.col("value"))[0].alias("key"), F.transform(parts, lambda x: F.struct(x[0].cast("double").alias("begin"), x[1].cast("double").alias("end"))).alias("intervals"))
