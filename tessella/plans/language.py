"""Text analytics over `documents`, `benchmark` and `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import words
from ..operators import phones
from ..operators import text as t
from ..session import table
from . import query

#: Shared SQL: the words of each document.
SQL_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents)"
SQL_TERMS = SQL_WORDS + """,
terms AS (
  SELECT doc_id, 1 AS n, unnest(w) AS term FROM w
  UNION ALL SELECT doc_id, 2, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
counts AS (SELECT doc_id, n, term, count(*) AS count FROM terms GROUP BY ALL)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))


@query(f"""WITH {SQL_WORDS}, n AS (SELECT doc_id, w, ceil(len(w) / 100.0)::INT AS n, ceil(len(w) / ceil(len(w) / 100.0))::INT AS size FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, i::INT AS part, w[i * size + 1:(i + 1) * size] AS words FROM n, unnest(range(n)) r(i))
SELECT doc_id, part, len(words)::INT AS n_words, md5(array_to_string(words, ' ')) AS digest FROM p WHERE len(words) > 0""")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.into_documents(docs(spark, sf_dir), "doc_id", F.col("w"), 100)
    return parts.select("doc_id", "part", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(f"WITH {SQL_TERMS} SELECT doc_id, n::INT AS n, term, count FROM counts")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.term_counts(docs(spark, sf_dir), "doc_id", F.col("w"))


def tfidf_sql(tf: str, idf: str) -> str:
    return f"""WITH {SQL_TERMS}, s AS (SELECT n, term, count(*) AS df, max(count) AS most FROM counts GROUP BY n, term), d AS (SELECT count(DISTINCT doc_id) AS docs FROM counts)
SELECT doc_id, n::INT AS n, term, round({tf} * {idf}, 6) AS tfidf FROM counts JOIN s USING (n, term), d"""


def with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many documents have a word."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).agg(F.countDistinct("doc_id"))


@query(tfidf_sql("count", "ln(docs / (1 + df))"))
def tfidf_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.text_tf_idf(docs(spark, sf_dir), "doc_id", F.col("w"), with_words(spark, sf_dir)).withColumn("tfidf", F.round("tfidf", 6))


@query(tfidf_sql("(0.5::DOUBLE + 0.5::DOUBLE * count / (1 + most))", "ln(1 + docs / (1 + df))"))
def tfidf_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.text_tf_idf(docs(spark, sf_dir), "doc_id", F.col("w"), with_words(spark, sf_dir), 2, "normalized", "log-smoothed").withColumn("tfidf", F.round("tfidf", 6))


SQL_SIMILARITY = f"""WITH {SQL_WORDS}, u AS (SELECT doc_id, unnest(w) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS c FROM u GROUP BY ALL),
s AS (SELECT term, count(*) AS df FROM c GROUP BY term), d AS (SELECT count(DISTINCT doc_id) AS docs FROM c),
i AS (SELECT doc_id, term, c * ln(docs / (1 + df)) AS x FROM c JOIN s USING (term), d)
SELECT a.doc_id AS query, b.doc_id AS source, round(sum(a.x * b.x), 4) AS score FROM i a JOIN i b USING (term) WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL"""


@query(SQL_SIMILARITY)
def document_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document against all, over all terms; documents are compared where they are read."""
    return t.text_similarity(docs(spark, sf_dir), "doc_id", F.col("w"), F.col("__key") % 20 == 0, with_words(spark, sf_dir), 4)


@query(SQL_SIMILARITY)
def document_similarity_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_similarity under its earlier name."""
    return document_similarity(spark, sf_dir)


@query(f"WITH {SQL_WORDS} SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM w) GROUP BY word ORDER BY count DESC, word LIMIT 50")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.top_words(docs(spark, sf_dir), F.col("w"), 50)


@query(f"WITH {SQL_WORDS}, c AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM w) GROUP BY word) SELECT word, count, round(count / (SELECT sum(count) FROM c), 9) AS p FROM c")
def unigram_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.unigrams(docs(spark, sf_dir), F.col("w")).withColumn("p", F.round("p", 9))


@query(rf"WITH {SQL_WORDS} SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS word FROM benchmark EXCEPT SELECT unnest(w) FROM w")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = docs(spark, sf_dir).select(F.explode("w").alias("word")).distinct()
    return t.unknown_words(table(spark, sf_dir, "benchmark"), words(F.col("text")), known)


@query(rf"""WITH b AS (SELECT list_concat(list_concat(['<s>'], regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), ['</s>']) AS w FROM benchmark),
g AS (SELECT n, w[i:i + n - 1] AS g FROM b, unnest([1, 2, 3]) o(n), unnest(range(1, len(w) - n + 2)) r(i))
SELECT n::INT AS n, array_to_string(g[1:n - 1], ' ') AS history, g[n] AS word, count(*) AS count FROM g WHERE n > 1 OR g[1] <> '<s>' GROUP BY ALL""")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.history_counts(table(spark, sf_dir, "benchmark"), words(F.col("text")), 3)


@query()
def kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = t.history_counts(table(spark, sf_dir, "benchmark"), words(F.col("text")), 3)
    rows = t.kneser_ney(counts, 3)
    return rows.select("n", "history", "word", F.round("f", 9).alias("f"), F.round("backoff", 9).alias("backoff"))


@query()
def sentence_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items under a bigram model of themselves: shares of counts, and a fixed back-off weight."""
    counts = t.history_counts(table(spark, sf_dir, "benchmark"), words(F.col("text")), 2)
    total = F.sum("count").over(Window.partitionBy("n", "history"))
    model = counts.select("history", "word", F.ln(F.col("count") / total).alias("logp"), F.when(F.col("n") == 1, F.lit(-0.5)).alias("backoff"))
    rows = t.sentence_logprob(table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w")), "item_id", F.col("w"), model, 2)
    return rows.withColumn("logprob", F.round("logprob", 5))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a turn against those of the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", words(F.col("text")).alias("hyp"))
    turns = turns.withColumn("ref", F.lag("hyp").over(w)).where("ref is not null")
    return turns.select(F.struct("conv_id", "turn").alias("pair"), "ref", "hyp")


@query()
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = t.aligned(turn_pairs(spark, sf_dir), "pair", F.col("ref"), F.col("hyp"))
    return t.word_errors(edits.withColumn("conv_id", F.col("pair.conv_id")), ["conv_id"]).withColumn("wer", F.round("wer", 6))


@query()
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.confusions(t.aligned(turn_pairs(spark, sf_dir), "pair", F.col("ref"), F.col("hyp")))


@query("""WITH c AS (SELECT p_brand AS word, p_type AS pron, count(*) AS count FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY count DESC, pron)::INT AS rank, count / max(count) OVER (PARTITION BY word) AS share FROM c)
SELECT word, pron, count, rank FROM r WHERE rank <= 3 AND share >= 0.5""")
def best_pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("word"), F.col("p_type").alias("pron")).agg(F.count("*").alias("count"))
    return t.best_prons(rows, 3, 0.5)


@query("""WITH r AS (SELECT p_brand AS word, p_type AS pron, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS source, count(*) AS count FROM part GROUP BY ALL),
e AS (SELECT *, CASE source WHEN 'a' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / count(*) OVER (PARTITION BY word, source) AS p FROM r),
q AS (SELECT *, p / sum(p) OVER (PARTITION BY word) AS prior FROM e)
SELECT word, pron, source, round(prior, 9) AS prior, round((10 * prior + count) / sum(10 * prior + count) OVER (PARTITION BY word), 9) AS posterior FROM q""")
def lexicon_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("p_size") % 2 == 0, "a").otherwise("b")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("word"), F.col("p_type").alias("pron"), source.alias("source")).agg(F.count("*").alias("count"))
    out = t.lexicon_posteriors(t.lexicon_priors(rows, {"a": 0.7, "b": 0.3}), 10.0)
    return out.select("word", "pron", "source", F.round("prior", 9).alias("prior"), F.round("posterior", 9).alias("posterior"))


@query("""WITH h AS (SELECT event_id, event_type AS kw, value / 200 AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY kw) AS n FROM h),
t AS (SELECT *, n / (720 * 3600 / 999.9::DOUBLE + 998.9::DOUBLE / 999.9::DOUBLE * n) AS t FROM n)
SELECT event_id, CASE WHEN s > t THEN 'YES' ELSE 'NO' END AS decision, round((1 - t) * s / ((1 - t) * s + (1 - s) * t), 6) AS normalised FROM t""")
def keyword_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kw"), (F.col("value") / 200).alias("score"))
    return t.keyword_decisions(hits, 720).select("event_id", "decision", F.round("normalised", 6).alias("normalised"))


@query()
def keyword_hits_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select(F.col("event_type").alias("kw"), F.col("user_id").alias("file"), F.lit("1").alias("channel"), F.unix_timestamp("ts").cast("double").alias("start"), F.col("value").alias("score"))
    return t.drop_near_hits(hits, 7200.0)


SQL_RULES = r"""SELECT doc_id, 'edges' AS rule FROM documents WHERE regexp_matches(text, '^\s|\s$') UNION ALL SELECT doc_id, 'empty' FROM documents WHERE trim(text) = '' UNION ALL SELECT doc_id, 'null' FROM documents WHERE text IS NULL
UNION ALL SELECT doc_id, 'control' FROM documents WHERE regexp_matches(text, '[\x00-\x08\x0E-\x1F]') UNION ALL SELECT doc_id, 'reserved' FROM documents WHERE regexp_matches(text, '(^|\s)(<s>|</s>|#0)(\s|$)')"""


@query(SQL_RULES)
def text_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rules."""
    return t.illegal_text(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(SQL_RULES)
def text_validation_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_validation under its earlier name."""
    return text_validation(spark, sf_dir)


@query(r"SELECT regexp_replace(url, '\d+', 'N', 'g') AS pattern, count(*) AS count FROM pages GROUP BY ALL")
def log_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.log_summary(table(spark, sf_dir, "pages"), "url")


@query("SELECT event_id, round(ln(p / (1 - p)), 6) AS logit, round(ln(length(event_type)), 6) AS log_length FROM (SELECT *, least(greatest(value / 200, 0), 1) * 0.998::DOUBLE + 0.001::DOUBLE AS p FROM events)")
def confidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", t.confidence_features(F.col("value") / 200, F.col("event_type")).alias("f"))
    return rows.select("event_id", F.round("f.logit", 6).alias("logit"), F.round("f.log_length", 6).alias("log_length"))


@query(rf"""WITH {SQL_WORDS}, m AS (SELECT * FROM (VALUES ('the', ['t1', 't2']), ('of', ['o']), ('and', []::VARCHAR[])) v(f, t)),
e AS (SELECT doc_id, unnest(w) AS f, generate_subscripts(w, 1) AS i FROM w)
SELECT doc_id, md5(coalesce(string_agg(x, ' ' ORDER BY i), '')) AS digest FROM (SELECT doc_id, i, CASE WHEN m.f IS NULL THEN e.f ELSE nullif(array_to_string(t, ' '), '') END AS x FROM e LEFT JOIN m ON e.f = m.f) GROUP BY doc_id
UNION ALL SELECT doc_id, md5('') FROM w WHERE len(w) = 0""")
def mapped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("the", ["t1", "t2"]), ("of", ["o"]), ("and", [])], "`from` string, to array<string>")
    return t.map_tokens(docs(spark, sf_dir), "w", mapping).select("doc_id", F.md5(F.array_join("w", " ")).alias("digest"))


@query()
def bpe_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty merges learnt from the benchmark's words, applied to all of them."""
    counts = table(spark, sf_dir, "benchmark").select(F.explode(words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    rules = t.learn_bpe(counts, 20)
    return counts.select("word", F.array_join(t.apply_bpe(F.col("word"), rules), " ").alias("symbols"))


@query()
def phone_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of the different words of all documents: which follows which three, in at most 400 n-grams above bigrams."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("w")).distinct()
    model = phones.pruned(phones.fitted(words, F.split("w", ""), 4, 2), 400, 4.0)
    return phones.as_table(model).select("history", "word", F.round("logp", 6).alias("logp"), F.round("backoff", 6).alias("backoff"))
