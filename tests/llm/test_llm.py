"""The training-data operators against brute force, round trips and odd input."""

import gzip
import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import chat, decontam, jaccard, lines, lm, mixing, passages, quality, queries, simhash, store, substring, warc
from tessella.llm.common import TO_LOWER

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_mixing_reaches_targets(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    got = mixing.taken(mixing.mix(rows)).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 12
        assert (g["taken"] <= 2 * g["size"]).all() and g["source_size"].iloc[0] == g["size"].sum()
    per = got.groupby("source").agg(target=("target", "first"), size=("source_size", "first"))
    assert per["target"].sum() == pytest.approx(1.5 * per["size"].sum())
    assert (per["target"] <= 2 * per["size"] + 1e-6).all()
    again = mixing.taken(mixing.mix(rows.repartition(7))).toPandas()
    assert dict(zip(got["doc_id"], got["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_mixing_odd_input(edge, none):
    got = mixing.taken(mixing.mix(edge)).collect()
    assert len(got) == edge.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.taken(mixing.mix(none)).count() == 0 and mixing.mixed_documents(none).count() == 0


# 2


def brute_repeats(w):
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_quality_counts(docs):
    got = by_id(quality.judged(docs))
    for r in docs.collect():
        w, t = words(r["text"]), r["text"] or ""
        earlier, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(line.strip(BLANKS)) and line in earlier
            earlier.add(line)
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, brute_repeats(w))
        c = got[r["doc_id"]]["__counts"]
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == want


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    kept = {(r["quality"], r["__kept"]): r["n"] for r in rows.where("not __base_failed").groupBy("quality", "__kept").agg(F.count("*").alias("n")).collect()}
    assert kept[1, True] > 0.98 * (kept[1, True] + kept.get((1, False), 0))
    assert kept.get((0, True), 0) < 0.1 * (kept.get((0, False), 0) + kept.get((0, True), 0))


def exact_limits(values, rule):
    """Limits of one rule from all values of a group, by exact quantiles, and the error that the sketch may have."""
    side, at, reach, tie = quality.RULES[rule]
    values = sorted(values)
    q = lambda x: values[max(0, math.ceil(x * len(values)) - 1)]
    high = q(at) + reach * (q(at) - q(0.5)) + tie
    low = q(1 - at) - reach * (q(0.5) - q(1 - at)) - tie if side == "both" else -math.inf
    return low, high, 1.1 * quality.ACCURACY * (q(at) + reach * (q(at) + q(0.5)))


def test_quality_by_exact_quantiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {r["doc_id"]: (r["lang"], r["source"], quality.count_text(r["text"] or "")) for r in docs.collect()}
    groups = defaultdict(lambda: defaultdict(list))
    value = {}
    for i, (lang, source, (n, chars, symbols, n_lines, dup, rep)) in counts.items():
        if n >= 50 and 100 * rep <= 50 * n:
            value[i] = {"symbol_ratio": symbols / n, "dup_line_ratio": dup / n_lines, "repeat_ratio": rep / n, "mean_word_length": chars / n}
            for g in ((lang, source), (lang,), ()):
                for rule, x in value[i].items():
                    groups[g][rule].append(x)
    got = {r["doc_id"]: r["__kept"] for r in quality.judged(docs).collect()}
    sure = 0
    for i, (lang, source, _) in counts.items():
        if i not in value:
            assert not got[i]
            continue
        verdict = []
        for rule, x in value[i].items():
            low, high, error = exact_limits(groups[()][rule], rule)
            for g in ((lang,), (lang, source)):
                w = len(groups[g][rule]) / (len(groups[g][rule]) + quality.PRIOR)
                own = exact_limits(groups[g][rule], rule)
                low, high, error = (w * a + (1 - w) * b if math.isfinite(b) else b for a, b in zip(own, (low, high, error)))
            verdict.append(None if min(abs(x - low), abs(x - high)) <= error else low <= x <= high)
        if False in verdict or None not in verdict:
            sure += 1
            assert got[i] == (False not in verdict), (i, verdict)
    assert sure > 0.75 * len(counts)


def test_limits_follow_the_source(spark):
    """A share of symbols that is usual in one source and not in another."""
    plain = [(i, " ".join(f"word{chr(97 + (i * 7 + k * k) % 26)}{(i + k) % 90}" for k in range(80)), "en", "prose") for i in range(300)]
    code = [(1000 + i, " ".join(("# " if (i + k) % (5 + i % 4) == 0 else "") + f"word{chr(97 + (i * 3 + k * k) % 26)}{(i + k) % 90}" for k in range(80)), "en", "code") for i in range(300)]
    odd = " ".join(("# " if k % 7 == 0 else "") + f"word{chr(97 + (k * k) % 26)}{k % 90}" for k in range(80))
    rows = spark.createDataFrame([*plain, *code, (5000, odd, "en", "prose"), (5001, odd, "en", "code")], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.kept_documents(rows).collect()}
    assert 5001 in kept and 5000 not in kept and len(kept) > 590
    found = {r["source"]: r["symbol_ratio"]["high"] for r in quality.thresholds(quality.counted(rows), "lang", "source").collect()}
    assert found["code"] > 2 * found["prose"]


def test_names_of_ours_may_be_theirs(spark, edge):
    """Columns of documents that have the names that operators use inside."""
    names = ("__text", "__counts", "__kept", "__base_failed", "__hits", "__items", "__n_words", "__ident", "__once", "__keys", "__lines", "__row", "c0", "c1", "copy", "rounds", "of")
    rows = edge.withColumns({c: F.lit(1) for c in names})
    bench = spark.createDataFrame([(1, "five six seven")], "item_id long, text string")
    assert quality.kept_documents(rows).columns == rows.columns and mixing.mixed_documents(rows).columns == rows.columns
    assert decontam.clean_documents(rows, bench).columns == rows.columns and decontam.without_spans(rows, bench).columns == rows.columns
    assert {r["__hits"] for r in decontam.clean_documents(rows, bench).collect()} == {1}
    assert simhash.first_documents(rows).columns == rows.columns
    assert lines.deduped(rows).columns == [*(c for c in rows.columns if c != "__kept"), "__n_lines", "__n_dropped", "__kept"]


def test_sketches_merge(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.lit("r").alias("rule"), (F.col("id") + 1.0).alias("value"))
    merged = quality.quantiles(quality.merge(quality.sketch(rows, ["g"]), []), []).first()
    for q in (25, 50, 75, 90, 98):
        assert merged[f"q{q}"] == pytest.approx(50 * q, rel=0.011)


def test_quality_odd_input(edge, none):
    got = quality.judged(edge)
    assert got.count() == edge.count() and by_id(got)[2]["__base_failed"]
    assert quality.kept_documents(edge).columns == edge.columns
    assert quality.judged(none).count() == 0 and quality.kept_documents(none).count() == 0


# 3


def test_lm_base_and_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    got = by_id(lm.scored(docs), "ident")
    tokens = {r["doc_id"]: [*lm.tokens(r["text"]), b""] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    # Held-out texts take far fewer bits than eight a byte, and training texts fewer still.
    bits = {h: np.mean([r["bits_per_byte"] for r in got.values() if r["held_out"] == h]) for h in (True, False)}
    assert bits[False] < bits[True] < 3.2


def naive_decisions(tree, tokens):
    """Token by token: its leaf and (node, bit, slots) of each of its decisions."""
    mask = (1 << 64) - 1
    mix = lambda x: (x + 1) * 0x9E3779B97F4A7C15 & mask
    b1 = b2 = lm.BRANCHES
    w1 = c1 = c2 = c3 = 0
    for word in tokens:
        leaf = tree.ids.get(word, tree.escape)
        contexts = [b1, mix(b1 * (lm.BRANCHES + 1) + b2), mix(w1), (c1 * 16 + c2) * 16 + c3]
        path = []
        for step in tree.steps[tree.place[leaf] : tree.place[leaf] + tree.depth[leaf]].tolist():
            node, bit = step >> 1, step & 1
            hashed = lambda k, c: ((c + node) * 0xD6E8FEB86659FD93 & mask) >> (64 - lm.TABLE_BITS[k])  # noqa: B023, E731
            path.append((node, bit, [contexts[0] * lm.BRANCHES + node, hashed(1, contexts[1]), hashed(2, contexts[2]), contexts[3] * lm.BRANCHES + node]))
        yield leaf, path
        b1, b2, w1, c1, c2, c3 = int(tree.branch[leaf]), b1, leaf + 1, int(tree.coarse[leaf]), c1, c2


def naive_score(tree, counts, spelled, start, tokens):
    each, delta, squares = [], np.zeros(lm.INPUTS), np.ones(lm.INPUTS)
    slope = np.zeros(lm.INPUTS)
    for i, (word, (leaf, path)) in enumerate(zip(tokens, naive_decisions(tree, tokens))):
        if i and i % lm.SEGMENT == 0:
            g = slope / lm.SEGMENT
            squares += g * g
            delta += lm.RATE * g / np.sqrt(squares)
            slope = np.zeros(lm.INPUTS)
        total = float(tree.fixed[leaf])
        if leaf == tree.escape and word:
            total += float(spelled[lm.letter_grams([word])[0]].sum())
        for node, bit, slots in path:
            seen = [(counts[k, s, 0], counts[k, s, 1]) for k, s in enumerate(slots)]
            trust = [sum(a + b >= t for t in (1, 16, 256)) for a, b in seen]
            x = np.array([float(tree.root[node]), *[math.log((b + 0.4) / (a + 0.4)) for a, b in seen], 0.3]) * (1 if bit else -1)
            gate = 16 * (node.bit_length() - 1) + 4 * trust[1] + trust[2]
            p = 1 / (1 + math.exp(-float(((start[gate] + delta) * x).sum())))
            total += math.log10(p)
            slope += (1 - p) * x
        each.append(total)
    return each


def naive_passages(tree, tokens):
    """(context, words, start, end) of each passage; cuts are taken from the same hash of two words."""
    name = {w: passages.mixed(np.array([(tree.ids[w] + 1) * int(passages.FACTOR) & (1 << 64) - 1], np.uint64)) if w in tree.ids else np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in tokens}
    starts = [0]
    for i in range(2, len(tokens)):
        if passages.mixed(name[tokens[i - 1]] * passages.FACTOR + name[tokens[i - 2]])[0] % passages.MEAN_WORDS == 0:
            starts.append(i)
    return [(tuple(tokens[max(0, i - passages.CONTEXT) : i]), tuple(tokens[i:j]), i, j) for i, j in zip(starts, [*starts[1:], len(tokens)])]


def naive_gain(followed, own, each, parts):
    """What the passages seen after each context add; own is 1 for a training text, which is left out of its counts."""
    gain = 0.0
    for context, words, i, j in parts:
        seen = followed[context] - Counter({words: own})
        n, t = sum(seen.values()), len(seen)
        if n:
            single = sum(each[i:j])
            gain += (math.log10(t / (n + t)) if not seen[words] else math.log10(t / (n + t) * 10**single + seen[words] / (n + t)) - single)
    return gain


def test_lm_scores_are_those_of_a_naive_scorer_whatever_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: [*lm.tokens(r["text"]), b""] for r in docs.collect()}
    training = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = Counter(w for t in training for w in t)
    words_ = [w for w, n in seen.items() if n >= 2 or not w]
    tree = lm.grow(words_, np.array([seen[w] for w in words_]), sum(n for w, n in seen.items() if n < 2 and w))
    grams = np.bincount(lm.letter_grams([w for w in seen if w])[0], minlength=lm.LETTERS**4)
    spelled = lm.spelling(grams)
    counts = Counter((k, s, bit) for t in training for _, path in naive_decisions(tree, t) for _, bit, slots in path for k, s in enumerate(slots))
    start = lm.Mixer(tree, np.zeros(int(lm.OFFSETS[-1]), np.float32), spelled).weights
    one = {r["ident"]: r["score"] for r in lm.scored(docs.coalesce(1)).collect()}
    seven = {r["ident"]: r["score"] for r in lm.scored(docs.repartition(7)).collect()}
    assert seven == pytest.approx(one, rel=1e-6)
    followed = defaultdict(Counter)
    for t in training:
        for context, words, _, _ in naive_passages(tree, t):
            followed[context][words] += 1
    gains = []
    for i in sorted(texts)[::9]:
        each = naive_score(tree, counts, spelled, start, texts[i])
        gains.append(naive_gain(followed, int(zlib.crc32(str(i).encode()) % 7 != 2), each, naive_passages(tree, texts[i])))
        assert one[i] == pytest.approx(sum(each) + gains[-1], rel=1e-4, abs=1e-3)
    assert min(gains) < 0 < max(gains)


def test_lm_texts_seen_elsewhere_score_apart(spark):
    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 3000, 400)) for _ in range(60)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(100 + k, texts[k]) for k in range(20)]
    got = by_id(lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), held_out=F.lit(False)), "ident")
    twice = [got[k]["bits_per_byte"] for k in range(20)]
    once = [got[k]["bits_per_byte"] for k in range(20, 60)]
    assert max(twice) < 0.5 * min(once)


def test_lm_passages_with_hot_contexts(spark, monkeypatch):
    """One context before a third of all passages; broadcast and shuffled joins give the same."""
    parts = [[(7, k % 5 if k % 2 else k, -20.0), (k, k, -30.0), (k % 3, 1, -400.0)] for k in range(300)]
    rows = spark.createDataFrame([(k, k % 4 == 0, p) for k, p in enumerate(parts)], f"row bigint, held_out boolean, passages {passages.PASSAGES}")
    hot = {r["row"]: r["gain"] for r in passages.gains(rows).collect()}
    monkeypatch.setattr(passages, "HOT_SHARE", 1.0)
    cold = {r["row"]: r["gain"] for r in passages.gains(rows).collect()}
    assert hot.keys() == cold.keys() == set(range(300)) and hot == pytest.approx(cold)


def test_lm_probabilities_sum_to_one():
    words_, n = [b"", b"the", b"of", b"cat"], np.array([5, 9, 7, 2])
    tree = lm.grow(words_, n, 3)
    mixer = lm.Mixer(tree, np.zeros(int(lm.OFFSETS[-1]), np.float32), lm.spelling(np.zeros(lm.LETTERS**4, np.uint32)))
    single = [mixer.score([[w] if w else []])[0][0] for w in words_]
    end = mixer.score([[]])[0][0]
    first = [10 ** (s - end) if w else 10**s for s, w in zip(single, words_)]
    assert 0 < sum(first) <= 1.0 + 1e-3
    grams = lm.spelling(np.random.default_rng(0).integers(0, 5, lm.LETTERS**4).astype(np.uint32)).reshape((lm.LETTERS,) * 4)
    assert np.allclose((10.0**grams * lm.SHARE).sum(-1), 1, atol=1e-3)


def test_lm_odd_input(edge, none):
    got = lm.scored(edge)
    assert got.count() == edge.count()
    empty = by_id(got, "ident")[2]
    assert empty["n_tokens"] == 1 and empty["bits_per_byte"] is None
    assert lm.scored(none).count() == 0


# 4


def brute_substring(rows, width=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize("limit", [0, 10**9])
def test_substring(docs, monkeypatch, limit):
    monkeypatch.setattr(substring, "MAX_FILTERED", limit)
    rows, texts = substring.deduped(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["ident"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in rows}
    assert got == brute_substring(list(texts.items()))
    # Every factor is a copy of its source, which comes before it.
    factors = [(r["ident"], f) for r in rows for f in r["factors"]]
    for i, f in factors:
        n = f["end"] - f["start"]
        assert f["source"] < i and n >= 13 and words(texts[i])[f["start"] : f["end"]] == words(texts[f["source"]])[f["at"] : f["at"] + n]
    assert len(factors) > 20 and {(i, w) for i, f in factors for w in range(f["start"], f["end"])} == {(r["ident"], w) for r in rows for s in r["removed"] for w in range(s["start"], s["end"])}


def test_substring_odd_input(edge, none):
    got = defaultdict(list)
    for r in substring.deduped(edge).collect():
        got[r["ident"]].append(r)
    assert len(got[7]) == 2 and all(not r["removed"] for r in got[7])
    assert got[6][0]["kept"] == "" and got[8][0]["kept"] == "zero fifteen" and not got[None][0]["removed"]
    assert substring.deduped(none).count() == 0


# 5


def brute_hits(text, items, width=10):
    w = decontam.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        x = decontam.words_of(t)
        n = min(width, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("size", [1 << 24, 800])
def test_decontamination(spark, sf_dir, docs, size):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "The of"), (901, None), (902, "")], "item_id long, text string"))
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = {r["doc_id"]: (r["__n_words"], r["n"], r["__items"]) for r in decontam.scanned(docs, bench, max_slice_bytes=size).withColumn("n", decontam.n_hit()).collect()}
    assert got == {r["doc_id"]: brute_hits(r["text"], items) for r in docs.collect()}


def test_decontamination_odd_input(spark, edge, none):
    bench = spark.createDataFrame([(1, "five six seven eight nine ten eleven twelve thirteen fourteen"), (None, "漢字 ½")], "item_id long, text string")
    clean = decontam.clean_documents(edge, bench)
    assert clean.columns == edge.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(map(str, (1, 2, 3, 4, 5, 6, None)))
    assert by_id(decontam.without_spans(edge, bench))[8]["text"] == "zero one two three four fifteen"
    assert decontam.clean_documents(edge, bench.where("false")).count() == edge.count() and decontam.scanned(none, bench).count() == 0


# 6


def test_lines_odd_input(spark, edge, none):
    got = by_id(lines.deduped(edge, min_docs=2))
    assert (got[2]["__n_lines"], got[2]["__n_dropped"], got[2]["__kept"]) == (1, 0, "")
    assert got[5]["__kept"] == "" and got[7]["__n_dropped"] == 1 and lines.deduped(none).count() == 0
    rows = spark.createDataFrame([(i, f" Same Line\t\n\nown {i}") for i in range(12)] + [(99, "same line\n")], "doc_id long, text string")
    assert {r["__kept"] for r in lines.deduped(rows).collect()} == {*(f"\nown {i}" for i in range(12)), ""}


def test_line_index_compacts(spark):
    index = lines.LineIndex(enough=3, fanout=2)
    for k in range(5):
        index.add(spark.createDataFrame([(1,), (10 + k,), (2,)] if k < 2 else [(1,), (10 + k,)], "key long"))
    assert sum(map(len, index.levels)) <= 3 and max(map(len, index.levels)) < 2
    assert [r["key"] for r in index.frequent().collect()] == [1]


# 7


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/\r\nb", big), (2, "u", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (5, "u", "small"), (6, "u", "é" * 200_000), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archives = warc.write(pages, archive_bytes=2000)
    got = sorted(((r["page"] or "-", r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(archives).collect()))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = h == big and i != 2
        want.append((str(i) if i else "-", len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", "2" if again else None))
    assert got == sorted(want) and archives.count() > 1
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_warc_framing():
    data = b"".join(warc.record(str(i), "u", b"p" * n, hashlib.sha1(b"p" * n).hexdigest(), None, "d") for i, n in enumerate((0, 1, 70_000)))
    assert [f["x-payload-length"] for f in warc.read_records(io.BytesIO(data))] == ["0", "1", "70000"]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(data[:-9])))
    wrong = gzip.compress(gzip.decompress(data).replace(b"p" * 10, b"q" * 10, 1))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(wrong)))


# 8


def test_preferences(spark):
    turn = "array<struct<role: string, text: string>>"
    a = [("user", "q"), ("assistant", "yes"), ("user", "more"), ("assistant", "ok")]
    rows = [(1, a, a[:3] + [("assistant", "no")]), (2, a, a), (3, None, a), (4, [("user", "x")], [("user", "y"), ("assistant", "z")])]
    got = by_id(chat.preferences(spark.createDataFrame(rows, f"id int, chosen {turn}, rejected {turn}").withColumn("prompt", F.lit("old"))), "id")
    show = lambda t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert got[1]["prompt"] == show(a[:3]) and got[1]["chosen_text"] == show(a[3:]) and got[1]["rejected_text"] == show([("assistant", "no")])
    (s,) = got[1]["chosen_mask"]
    assert got[1]["chosen_text"][s["start"] : s["end"]] == "ok<|im_end|>\n"
    assert (got[2]["prompt_turns"], got[2]["chosen_text"], got[2]["rejected_mask"]) == (4, "", [])
    assert got[3]["prompt"] == "" and got[3]["rejected_text"] == show(a) and len(got[3]["rejected_mask"]) == 2
    assert got[4]["prompt_turns"] == 0 and got[4]["chosen_mask"] == []
    turns = spark.createDataFrame([(1, 1, None, "b"), (1, 0, "user", None), (1, 1, None, "a")], "conv_id long, turn int, role string, text string")
    assert [tuple(t) for t in chat.conversations(turns).first()["turns"]] == [("user", ""), ("", "a"), ("", "b")]


# 9


def brute_print(text, width):
    w = (text or "").encode().translate(TO_LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), seed=42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, r=4):
    ids = list(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= r and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash(docs):
    rows = docs.limit(200).collect()
    prints = {r["doc_id"]: brute_print(r["text"], 4) for r in rows}
    label = brute_components(prints)
    got = {r["ident"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.clustered(docs).collect()}
    assert got == {i: (prints[i], label[i]) for i in prints}


@pytest.mark.parametrize("seed", range(4))
def test_links_keep_components(spark, seed):
    g = np.random.default_rng(seed)
    centres = g.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = set(g.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for c in centres:
        for _ in range(120):
            x = int(c)
            for b in g.integers(0, 64, g.integers(0, 5)):
                x ^= 1 << int(b)
            points.add(x)
    points = np.array(sorted(points), np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 4
    want = simhash.roots(len(points), *np.nonzero(near))
    assert np.array_equal(simhash.roots(len(points), *simhash.tree_links(points, 4)), want)
    df = spark.createDataFrame([(simhash.signed(int(x)),) for x in points], "fp long")
    found = {r["node"]: r["label"] for r in simhash.components(simhash.links(df)).collect()}
    groups = defaultdict(set)
    for i, x in enumerate(points):
        groups[want[i]].add(simhash.signed(int(x)))
    assert found == {x: min(m) for m in groups.values() if len(m) > 1 for x in m}


def test_simhash_odd_input(edge, none):
    got = simhash.clustered(edge).collect()
    by = {r["ident"]: r["component_id"] for r in got}
    assert len(got) == edge.count() and by[2] == by[3] == by[4] == 2 and by[6] == 5
    stay = simhash.first_documents(edge)
    ids = [r["doc_id"] for r in stay.collect()]
    assert stay.columns == edge.columns and len(ids) == len(set(ids)) and {2, 5, 7, None} <= set(ids) and not {3, 4, 6} & set(ids)
    assert simhash.clustered(none).count() == 0 and simhash.first_documents(none).count() == 0


def test_first_documents_tell_rows_apart(spark):
    """Different texts without an id, or under one id, are different documents; of copies the one with an id stays."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[4]), (9, texts[5]), (8, texts[5])]
    got = simhash.first_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_dedup_links_by_similarity(spark):
    """The stage keeps one document of each component of pairs of exact similarity 0.8 or more, and no less."""
    import corpus_pipeline

    g = np.random.default_rng(5)
    texts = []
    for c in range(12):
        base = [f"c{c}w{x}" for x in g.integers(0, 10_000, 150)]
        for _ in range(50 if c == 0 else 8):
            words = list(base)
            for k in g.integers(0, 150, g.integers(0, 9)):
                words[k] = f"x{g.integers(0, 1 << 40)}"
            texts.append(" ".join(words) + (" a line that many of the documents have in common" * (c % 2)))
    texts += ["", None, " ", "One Two", "one two", *texts[:3]]
    sets = [set(zip(*[w[k:] for k in range(5)])) or {tuple(w)} - {()} for w in ((t or "").lower().split() for t in texts)]
    link = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    label = simhash.roots(len(texts), *np.array(link).T)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == set(label.tolist()) and len(got) == len(set(label.tolist()))


def test_near_dedup_odd_input(edge, none):
    ids = [r["doc_id"] for r in simhash.first_documents(edge).collect()]
    assert len(ids) == len(set(ids)) and {2, 5, 7, 9, None} <= set(ids) and not {3, 4, 6, 8} & set(ids)
    assert simhash.first_documents(none).count() == 0 and simhash.first_documents(edge).columns == edge.columns


# 10


def test_pieces_give_the_tokenizers_ids():
    import random

    import public_tokenizers

    r = random.Random(0)
    parts = [" ", "  ", "\n", "\n\n", "a", "B", "é", ".", ",", "!", "'s", "it's", "12", "\t", "\r\n", "　", "漢字", "<|endoftext|>", "_", "\x1c", "​", "\u0085", "x.", "y,", "🙂"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(4000)] + ["", " ", "\n"]
    e = store.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids + [0] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 500):
        assert [x.tolist() for x in e.encode(texts[k : k + 500])] == want[k : k + 500]


def test_store_round_trip(spark, edge, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = store.encoder(path).tokenizer
    written = store.write(edge, path)
    rows = store.read(spark, written, with_ids=True).orderBy("start").collect()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in edge.collect()), key=lambda x: x[:2])
    want = [tok.encode(t or "", add_special_tokens=False).ids + [0] for _, _, t in texts]
    assert [r["ids"] for r in rows] == want and [r["ident"] for r in rows] == [i if known else None for known, i, _ in texts]
    assert [r["start"] for r in rows] == [sum(map(len, want[:k])) for k in range(len(want))]
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    # Copies add no bytes.
    chunks = spark.read.parquet(f"{written.path}/recipes").select(F.explode("chunks").alias("c")).select("c.*")
    assert chunks.select("pack", "at").distinct().count() == chunks.select("hash").distinct().count() < chunks.count()
    assert store.read(spark, store.write(none, path)).count() == 0


def test_store_finds_damage(spark, docs):
    import public_tokenizers
    from pyarrow import fs

    written = store.write(docs.limit(20), public_tokenizers.path("byte_bpe_50k.json"))
    files, base = fs.FileSystem.from_uri(f"{written.path}/packs")
    name = files.get_file_info(fs.FileSelector(base))[0].path
    data = bytearray(files.open_input_file(name).read())
    data[3] ^= 1
    with files.open_output_stream(name) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="does not match its recipe"):
        store.read(spark, written).collect()


def test_cuts_follow_content():
    g = np.random.default_rng(0)
    a = g.integers(0, 50_000, 30_000).astype("<u2")
    b = np.concatenate([g.integers(0, 50_000, 777).astype("<u2"), a])
    parts = lambda x: {x[i:j].tobytes() for i, j in zip([0, *store.cuts(x)], store.cuts(x))}
    assert store.cuts(a)[-1] == len(a) and len(parts(a) & parts(b)) > 0.8 * len(parts(a))
    assert max(np.diff([0, *store.cuts(np.zeros(50_000, "<u2"))])) <= store.MOST


# The pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
    tok = store.encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    want = sorted((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == want


def test_least_shared_of_prefixes_loses_no_link():
    """Every pair of sets of similarity 0.8 or more shares as many shingles of its prefixes as the filter asks for."""
    rng = np.random.default_rng(5)
    often = rng.integers(0, 4, 1 << jaccard.SLOTS).astype(np.int32)
    least, linked = Fraction(4, 5), 0
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        whole = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate([whole[rng.random(n) > rng.random() / 5], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)])) for _ in "ab")
        both = len(np.intersect1d(a, b))
        if both and 5 * both >= 4 * (len(a) + len(b) - both):
            linked += 1
            shared = len(np.intersect1d(jaccard.prefix(a, often, least), jaccard.prefix(b, often, least)))
            assert shared >= max(1, jaccard.least_shared(np.array([len(a)]), np.array([len(b)]), least)[0])
    assert linked > 500


def test_bounds_on_pairs_lose_no_link(monkeypatch):
    """Pairs of sets that share a hot passage, cut into small slices: every link between labels is among them, and few others are."""
    monkeypatch.setattr(jaccard, "STEP", 64)
    rng = np.random.default_rng(3)
    least, often = Fraction(4, 5), np.zeros(1 << jaccard.SLOTS, np.int32)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    passage, base = draw(30), draw(60)
    sets = [np.unique(np.concatenate([passage, draw(int(rng.integers(5, 90)))])) for _ in range(60)]
    sets += [np.unique(np.concatenate([base[rng.random(60) > rng.random() / 6], draw(int(rng.integers(0, 8)))])) for _ in range(60)]
    label = rng.integers(0, 50, len(sets))
    n = np.array([len(x) for x in sets])
    bits = np.stack([jaccard.bitmap(x) for x in sets]).view(np.uint64)
    heads = [jaccard.prefix(x, often, least) for x in sets]
    labels_of = defaultdict(set)
    for k, h in enumerate(heads):
        for token in h.tolist():
            labels_of[token].add(label[k])
    rows = []
    for k, h in enumerate(heads):
        held = [(i, t) for i, t in enumerate(h.tolist()) if len(labels_of[t]) > 1]
        rows += [(t, label[k], k, i, before, len(held)) for before, (i, t) in enumerate(held)]
    token, lab, at, place, before, held = map(np.array, zip(*sorted(rows)))
    found, slices = Counter(), 0
    for i, j in jaccard.near_pairs(n[at], bits[at], lab, token, place, before, held, least):
        slices += 1
        found.update({(min(a, b), max(a, b)) for a, b in zip(at[i].tolist(), at[j].tolist())})
        assert (lab[i] != lab[j]).all() and (token[i] == token[j]).all()
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if label[a] != label[b] and 5 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (n[a] + n[b] - both)}
    assert len(linked) > 50 and linked <= found.keys() and slices > 3
    assert len(found) < len(sets) * (len(sets) - 1) // 4


def test_like_texts_come_together_by_few_pairs(spark, monkeypatch):
    """Texts that are all alike are not compared all with all, and none is lost."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    texts = []
    for k in range(80):
        words = list(base)
        for at in rng.choice(200, 2, replace=False):
            words[at] = f"own{k}x{at}"
        texts.append((k, " ".join(words)))
    seen, verified = [], jaccard.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame([*texts, (100, "quite another text")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in simhash.first_documents(docs).orderBy("doc_id").collect()] == [0, 100]
    assert sum(seen) <= 4 * len(texts)


def test_windows_are_kept_as_factors(spark):
    """A passage that a document copies is kept as one factor, not as a row for each of its windows."""
    text = " ".join(f"w{k}" for k in range(300))
    rows = spark.createDataFrame([(1, text), (2, f"before {text} behind"), (3, "none of it")], "ident bigint, text string")
    found = substring.duplicate_windows(rows, 13).collect()
    assert [(r["ident"], [tuple(x) for x in r["factors"]]) for r in found] == [(2, [(1, 301, 1, 0)])]
