"""The queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, extract, lines, lm, mixing, quality, simhash, spelling, store, substring, warc, whitening
from .common import table

#: Fixed value: words for DuckDB.
SQL_WORD = r"[^\x20\x09-\x0D]+"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SQL_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn
  FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((rn - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS most FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open AS (SELECT arg_min(level, most / weight) AS level FROM levels WHERE level < most / weight),
plan AS (
  SELECT source, source_size, least(most, coalesce((SELECT level FROM open) * weight, most)) AS target FROM levels),
rounds AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM plan),
upto AS (
  SELECT s.*, source_size, target, rounds, target - rounds * source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY s.source, key) AS own
  FROM sized s JOIN rounds r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (rounds + CASE WHEN upto - own / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM upto
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(f"__counts.{c}").alias(c) for c in counts], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontam.scanned(docs, table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.col("__n_words").alias("n_words"), decontam.n_hit().alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__hits") > 0).alias("contaminated"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (key IN (SELECT key FROM frequent))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = warc.read(warc.write(pages))
    kind = pages.schema["page_id"].dataType
    return rows.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""


def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.preferences(chat.with_other_reply(chat.conversations(table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = [F.col("conv").alias("conv_id"), F.col("prompt_turns").cast("bigint").alias("prompt_turns"), F.sha2("prompt", 256).alias("prompt_sha256")]
    for side in ("chosen", "rejected"):
        out += [F.length(f"{side}_text").cast("bigint").alias(f"{side}_chars"), F.sha2(f"{side}_text", 256).alias(f"{side}_sha256"), spans(f"{side}_mask").alias(f"{side}_mask")]
    return rows.select(*out)


OP8_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS size FROM t),
other AS (SELECT xor(conv_id, 1) AS conv_id, role, text FROM n WHERE i = size),
sides AS (
  SELECT 'chosen' AS side, conv_id, i, role, text FROM n
  UNION ALL SELECT 'rejected', conv_id, i, role, text FROM n WHERE i < size
  UNION ALL SELECT 'rejected', conv_id, size, o.role, o.text FROM (SELECT DISTINCT conv_id, size FROM n) JOIN other o USING (conv_id)),
differs AS (
  SELECT conv_id, min(i) AS first FROM (
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i) AS i,
           a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
    FROM (FROM sides WHERE side = 'chosen') a FULL JOIN (FROM sides WHERE side = 'rejected') b ON a.conv_id = b.conv_id AND a.i = b.i)
  WHERE NOT same GROUP BY conv_id),
cut AS (
  SELECT s.*, coalesce(first, 1000000) AS first, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM sides s LEFT JOIN differs USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY side, conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM cut WHERE i >= first),
done AS (
  SELECT side, conv_id, sum(length(shown))::BIGINT AS chars, sha256(string_agg(shown, '' ORDER BY i)) AS sha,
         string_agg((begins + 13 + length(role)) || '-' || (begins + length(shown)), ',' ORDER BY i) FILTER (role = 'assistant') AS mask
  FROM placed GROUP BY side, conv_id),
prompts AS (
  SELECT conv_id, count(*) FILTER (i < first)::BIGINT AS prompt_turns, sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (i < first), '')) AS prompt_sha256
  FROM cut WHERE side = 'chosen' GROUP BY conv_id)
SELECT p.conv_id, prompt_turns, prompt_sha256,
       coalesce(c.chars, 0) AS chosen_chars, coalesce(c.sha, sha256('')) AS chosen_sha256, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.chars, 0) AS rejected_chars, coalesce(r.sha, sha256('')) AS rejected_sha256, coalesce(r.mask, '') AS rejected_mask
FROM prompts p LEFT JOIN (FROM done WHERE side = 'chosen') c USING (conv_id) LEFT JOIN (FROM done WHERE side = 'rejected') r USING (conv_id)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.clustered(table(spark, sf_dir, "documents"))
    return rows.select(F.col("ident").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents")).withColumnRenamed("ident", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.deduped(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(F.col("ident").alias("doc_id"), "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{SQL_WORD}'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
found AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM found),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (
  SELECT e.doc_id, count(g.i)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '') AS kept
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    written = store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return store.read(spark, written).withColumnRenamed("ident", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, "embedding", model) if model else None
    return whitening.whitened(vectors, model).select(F.col("ident").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 goes byte by byte through its table; words one edit apart are joined by what one deletion leaves.
OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
bytes AS (SELECT list(('0x' || x)::BIGINT) AS b, s FROM (
  SELECT s, unnest(regexp_extract_all(hex(encode(s)), '..')) AS x, generate_subscripts(regexp_extract_all(hex(encode(s)), '..'), 1) AS i FROM (
    SELECT DISTINCT coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7) ORDER BY s, i) GROUP BY s),
hashed AS (
  SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM runs JOIN hashed USING (s))
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS (SELECT DISTINCT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, (list({'less': -n, 'near': near} ORDER BY -n, encode(near)))[1] AS x FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -x.less >= 10 * w.n THEN x.near END AS form, CASE WHEN -x.less >= 10 * w.n THEN -x.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
way AS (
  SELECT word, word AS reached, 0 AS k FROM forms
  UNION ALL SELECT way.word, form, k + 1 FROM way JOIN forms f ON f.word = way.reached WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, k) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.extracted(table(spark, sf_dir, "pages"))
    return rows.select(F.col("ident").alias("page_id"), "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_lm_scores, op4_substring_dedup, op5_decontaminate, op6_line_dedup, op7_warc, op8_chat_preferences, op9_simhash, op10_token_store, op11_whitening, op12_spelling_variants, op13_main_text)}
ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op8_chat_preferences": OP8_SQL, "op12_spelling_variants": OP12_SQL}
