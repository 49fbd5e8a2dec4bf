"""Operators without SQL against brute force, and edge cases of the others."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.operators import aggregates, keyed, metrics, ordered, sampling, segments, signal, text, trials, validate, vectors
from tessella.sources import archives, tables
from tessella.streaming import batches, live


def brute_eer(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    p, n = sum(y for _, y in rows), sum(not y for _, y in rows)
    fa, fr, last = n, 0, None
    for s, y in rows:
        fr, fa = (fr + 1, fa) if y else (fr, fa - 1)
        far, frr = fa / n, fr / p
        if far <= frr:
            if last is None or abs(far - frr) <= abs(last[0] - last[1]):
                return (far + frr) / 2, s
            return sum(last) / 2, s
        last = far, frr


def brute_dcf(rows, p_target=0.01):
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    p, n = sum(y for _, y in rows), sum(not y for _, y in rows)
    fr = fa = 0
    best = math.inf
    fa = n
    for _, y in rows:
        fr, fa = (fr + 1, fa) if y else (fr, fa - 1)
        best = min(best, p_target * fr / p + (1 - p_target) * fa / n)
    return best / min(p_target, 1 - p_target)


@pytest.mark.parametrize("seed", range(6))
def test_eer_and_dcf(spark, seed):
    r = random.Random(seed)
    ties = seed % 2
    rows = [(round(r.gauss(y * 1.0, 1), 1 if ties else 6), bool(y)) for y in (r.random() < 0.3 for _ in range(200))]
    df = spark.createDataFrame(rows, "score double, target boolean")
    got = metrics.eer(df).first()
    assert (got["eer"], got["threshold"]) == pytest.approx(brute_eer(rows))
    assert metrics.min_dcf(df).first()[0] == pytest.approx(brute_dcf(rows))


def test_eer_needs_both_kinds(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "score double, target boolean")
    assert metrics.eer(df).first()["eer"] is None
    first = spark.createDataFrame([(1.0, True), (2.0, False)], "score double, target boolean")
    assert metrics.eer(first).first()["eer"] == pytest.approx(brute_eer([(1.0, True), (2.0, False)])[0])


@given(st.lists(st.floats(0.01, 10), min_size=1, max_size=12), st.floats(0.1, 5))
@settings(max_examples=80, deadline=None)
def test_grouping(durations, least):
    ranges = segments.grouped(durations, least)
    assert [a for a, _ in ranges] + [len(durations)] == [0] + [b for _, b in ranges]
    if len(ranges) > 1:
        assert all(sum(durations[a:b]) >= least - 1e-4 for a, b in ranges)


@pytest.mark.parametrize(
    "least, durations, want",
    [(0.1, [5, 6, 7], [(0, 1), (1, 2), (2, 3)]), (0.5, [0.1, 6, 7], [(0, 2), (2, 3)]), (0.5, [6, 7, 0.1], [(0, 1), (1, 3)]), (0.5, [6, 0.1, 7], [(0, 2), (2, 3)]), (0.5, [7, 0.1, 6], [(0, 1), (1, 3)]), (1.0, [1, 0.5, 0.1, 6], [(0, 2), (2, 4)])],
)
def test_grouping_cases(least, durations, want):
    assert segments.grouped(durations, least) == want


def stacked(durations, least):
    """The rule with a stack of short items, the last one on top: each is joined to a neighbour until it is long enough or part of one before it."""
    of = [[i] for i in range(len(durations))]  # groups in order
    size = lambda g: sum(durations[i] for i in g)
    stack = [i for i, x in enumerate(durations) if x < least - 1e-5]
    while stack:
        k = next((k for k, g in enumerate(of) if g[0] == stack[-1]), None)
        if k is None or size(of[k]) >= least - 1e-5:
            stack.pop()
            continue
        left, right, own = of[k - 1] if k else None, of[k + 1] if k + 1 < len(of) else None, size(of[k])
        if not left and not right:
            break
        if not right or (left and size(left) + own >= least - 1e-5 and (size(right) + own < least - 1e-5 or size(left) < size(right) - 1e-5)):
            of[k - 1] += of.pop(k)
        else:
            of[k] += of.pop(k + 1)
    return [(g[0], g[-1] + 1) for g in of]


@given(st.lists(st.sampled_from([0.1, 0.2, 0.3, 0.5, 0.8, 1.1, 2.0]), min_size=1, max_size=14), st.sampled_from([0.25, 0.6, 1.0, 1.5]))
@settings(max_examples=400, deadline=None)
def test_grouping_in_order_of_a_stack(durations, least):
    assert segments.grouped(durations, least) == stacked(durations, least)


def test_combined_within_and_across_groups(spark):
    r = random.Random(11)
    lists = {f"g{i:02d}": [r.choice([1, 2, 3, 5, 9, 12]) / 10 for _ in range(r.choice([1, 1, 2, 9]))] for i in range(60)}
    rows = [(g, f"{g}-{i:02d}", x) for g, xs in lists.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, k string, n double").repartition(5)
    least, want, heads = 1.0, {}, []
    for g, xs in lists.items():
        for a, b in stacked(xs, least):
            want |= {(g, f"{g}-{i:02d}"): f"{g}-{a:02d}" for i in range(a, b)}
            heads.append((g, f"{g}-{a:02d}", sum(xs[a:b])))
    assert {(x["g"], x["k"]): x["combined"] for x in segments.combined(df, "g", "k", "n", least).collect()} == want
    to = {}
    for a, b in stacked([n for *_, n in heads], least):
        share = {}
        for g, _, n in heads[a:b]:
            share[g] = share.get(g, 0) + n
        most = max(share, key=lambda g: (round(share[g], 6), g))
        to |= {heads[i][:2]: (heads[a][1], most) for i in range(a, b)}
    got = {(x["g"], x["k"]): (x["combined"], x["leader"]) for x in segments.combined_across(df, "g", "k", "n", least).collect()}
    assert {k: v[0] for k, v in got.items()} == {(g, k): to[g, c][0] for (g, k), c in want.items()}
    assert sum(got[k][1] != to[k[0], c][1] for k, c in want.items()) <= 2 and len(set(v[0] for v in got.values())) < len(heads)  # leaders: sums that tie but for rounding
    assert segments.combined_across(df.where("false"), "g", "k", "n", least).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["label"] for x in segments.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == label


def test_padding_and_overlaps(spark):
    rows = spark.createDataFrame([("r", "a", 0.0, 30.0), ("r", "b", 25.0, 55.0), ("r", "c", 26.0, 29.0)], "reco string, key string, start double, end double")
    got = {x["key"]: (x["start"], x["end"]) for x in segments.cut_overlaps(rows.where("key <> 'c'"), "reco", "key").collect()}
    assert got == {"a": (0.0, 27.5), "b": (27.5, 55.0)}
    assert segments.cut_overlaps(rows, "reco", "key").count() == 2
    padded = sorted((x["start"], x["end"]) for x in segments.padded(spark.createDataFrame([("r", "a", 1.0, 2.0), ("r", "b", 3.0, 4.0)], rows.schema), "reco", "key", 2.0, 2.0).collect())
    assert padded == [(0.0, 2.5), (2.5, 4.0)]


def test_alignment():
    pairs = text.align(list("AGCACACA"), list("GCCAT"), 2, -1, -1)
    assert "".join(a or "" for a, _ in pairs) == "AGCACACA" and "".join(b or "" for _, b in pairs) == "GCCAT"

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(50):
        a, b = [[r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2)]
        assert sum(x != y for x, y in text.align(a, b, 0, -1, -1)) == distance(a, b)


def test_word_errors(spark):
    rows = spark.createDataFrame([(1, "a b c".split(), "a x c d".split()), (2, [], ["q"])], "k int, r array<string>, h array<string>")
    got = {x["k"]: (x["cor"], x["sub"], x["ins"], x["del"]) for x in text.word_errors(text.aligned(rows, "k", F.col("r"), F.col("h")), ["k"]).collect()}
    assert got == {1: (2, 1, 1, 0), 2: (0, 0, 1, 0)}


def brute_edits(a, b):
    """The fewest edits between two lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_turns_are_aligned_whole(spark, tmp_path):
    """word_errors and confusions count every word of a turn, not those of a prefix."""
    from tessella import plans

    r = random.Random(3)
    turns = [(c, k, " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 5, 40, 120])))) for c in range(4) for k in range(5)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["conv_id"]: x for x in plans.QUERIES["word_errors"](spark, str(tmp_path)).collect()}
    for c in range(4):
        texts = [t.split() for i, _, t in turns if i == c]
        assert got[c]["words"] == sum(map(len, texts[:-1]))
        assert got[c]["sub"] + got[c]["ins"] + got[c]["del"] == sum(map(brute_edits, texts, texts[1:]))
    rows = plans.QUERIES["confusions"](spark, str(tmp_path)).collect()
    assert sum(x["count"] for x in rows if x["ref_word"] is not None) == sum(x["words"] for x in got.values())


def test_kneser_ney_sums_to_one(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],), (["a", "b", "c"],), (["d"],)], "w array<string>")
    kn = text.kneser_ney(text.history_counts(rows, F.col("w"), 2), 2)
    sums = kn.where("n = 2").groupBy("history").agg((F.sum("f") + F.first("backoff")).alias("s")).collect()
    assert sums and all(x["s"] == pytest.approx(1.0) for x in sums)


def test_bpe(spark):
    counts = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "word string, count long")
    rules = text.learn_bpe(counts, 4)
    assert rules[0] == max([("e", "s"), ("s", "t</w>"), ("t", "</w>")][:1] + [("s", "t")]) or len(rules) == 4
    whole = counts.select("word", text.apply_bpe(F.col("word"), rules).alias("s")).collect()
    assert all("".join(x["s"]) == x["word"] + "</w>" for x in whole)


def test_map_tokens(spark):
    rows = spark.createDataFrame([(1, ["A", "B", "C"]), (2, [])], "k int, w array<string>")
    mapping = spark.createDataFrame([("A", ["a1", "a2"]), ("B", ["b"])], "`from` string, to array<string>")
    assert {x["k"]: x["w"] for x in text.map_tokens(rows, "w", mapping).collect()} == {1: ["a1", "a2", "b", "C"], 2: []}
    with pytest.raises(Exception, match="no mapping for C"):
        text.map_tokens(rows, "w", mapping, strict=True).collect()


def data(spark, n=300, dim=6, speakers=12):
    g = np.random.default_rng(0)
    centres = g.normal(size=(speakers, dim)) * 2
    rows = [(i, i % speakers, (centres[i % speakers] + g.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "utt long, spk int, vector array<double>"), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])


def test_whitening_lda_pca(spark):
    df, x, y = data(spark)
    white = np.array([r["vector"] for r in vectors.transformed(df, vectors.zca(df, centre=True)).orderBy("utt").collect()])
    assert np.allclose(np.cov(white.T), np.eye(6), atol=1e-6)
    s = vectors.class_scatter(df, "spk")
    within = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in set(y)) / len(x)
    assert np.allclose(s.within, within) and np.allclose(s.within + s.between, np.cov(x.T, bias=True))
    projected = np.array([r["vector"] for r in vectors.transformed(df, vectors.lda(df, "spk", 3)).orderBy("utt").collect()])
    ratio = [np.var([projected[y == k][:, j].mean() for k in set(y)]) / np.mean([projected[y == k][:, j].var() for k in set(y)]) for j in range(3)]
    assert ratio == sorted(ratio, reverse=True) and ratio[0] > 3
    p = np.array([r["vector"] for r in vectors.transformed(df, vectors.pca(df, 2, whiten=True)).orderBy("utt").collect()])
    assert np.allclose(np.cov(p.T, bias=True), np.eye(2), atol=1e-6)


def test_plda_separates(spark):
    df, x, y = data(spark)
    model = vectors.train_plda(df, "spk", 5)
    transform, psi = model.diagonal()
    assert np.allclose(transform @ model.within @ transform.T, np.eye(6), atol=1e-8)
    assert np.allclose(transform @ model.between @ transform.T, np.diag(psi), atol=1e-8)
    means = aggregates.mean_vectors(df, ["spk"], "vector").select(F.col("spk").alias("enroll"), F.col("mean").alias("vector"), "n")
    pairs = trials.generate(means.select("enroll"), df.select(F.col("utt").alias("test"), "spk"))
    tests = df.select(F.col("utt").alias("test"), "vector")
    for scored in (vectors.plda_scores(pairs, means, tests, model), vectors.quadratic_scores(pairs, means, tests, model)):
        assert metrics.eer(scored).first()["eer"] < 0.2
    mean, cov = vectors.in_domain(df)
    into = vectors.coral(model, mean, cov)
    assert np.allclose(into.within + into.between, cov, atol=1e-6)
    for m in (vectors.adapt(model, mean, cov), vectors.coral_plus(model, mean, cov), vectors.interpolate(model, into, regular=True), vectors.coral_interpolate(model, into, cov)):
        assert np.linalg.eigvalsh(m.within).min() > 0


def test_chain_names(spark):
    df, _, _ = data(spark)
    out = vectors.chain(df, "submean-lda3-norm", df)
    assert all(sum(v * v for v in r["vector"]) == pytest.approx(1) for r in out.take(5))
    with pytest.raises(ValueError, match="unknown step"):
        vectors.chain(df, "nothing", df)


def test_fusion(spark):
    r = random.Random(2)
    rows = [(str(i % 7), str(i), i % 3 == 0, r.gauss(i % 3 == 0, 1), r.gauss(2 * (i % 3 == 0), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "enroll string, test string, target boolean, a double, b double")
    systems = {c: df.select("enroll", "test", F.col(c).alias("score")) for c in "ab"}
    labels = df.select("enroll", "test", "target")
    metric = lambda s: metrics.eer(labels.join(s, ["enroll", "test"])).first()["eer"]
    weights, value = trials.greedy_fusion(systems, metric)
    assert value <= min(metric(s) for s in systems.values())
    w = trials.lda_weights(df, ["a", "b"])
    assert w[1] > w[0] > 0
    svm = trials.linear_fusion(df, ["a", "b"])
    assert svm["b"] > svm["a"]


def test_missing_scores(spark):
    t = spark.createDataFrame([("a", "b"), ("a", "c")], "enroll string, test string")
    s = spark.createDataFrame([("a", "b", 1.0)], "enroll string, test string, score double")
    assert trials.with_scores(t, s, "drop").count() == 1
    with pytest.raises(Exception, match="no score for a c"):
        trials.with_scores(t, s).collect()


def test_keys_are_not_joined_strings(spark):
    a = spark.createDataFrame([("ab", "c", 1.0), ("a", "bc", 2.0)], "enroll string, test string, score double")
    got = {(r["enroll"], r["test"]): r["score"] for r in trials.weighted_scores(a, a, ["enroll", "test"], 0.3, 0.7).collect()}
    assert got == pytest.approx({("ab", "c"): 1.0, ("a", "bc"): 2.0})


def test_zero_score_is_a_score(spark):
    s = spark.createDataFrame([("t", "x", 0.0)], "test string, enroll string, score double")
    row = keyed.pivot_scores(s, "test", "enroll", ["x", "y"]).first()
    assert row["x"] == 0.0 and row["y"] == float("-inf")


def test_dynamic_batches(spark):
    r = random.Random(3)
    rows = [("p", i, r.randrange(1, 50)) for i in range(60)]
    got = {x["i"]: x["batch"] for x in batches.dynamic_batches(spark.createDataFrame(rows, "p string, i int, n int"), "p", "i", "n", 100).collect()}
    sizes = {}
    for _, i, n in rows:
        sizes.setdefault(got[i], []).append(n)
    assert all(max(v) * len(v) <= 100 or len(v) == 1 for v in sizes.values())
    assert [got[i] for _, i, _ in rows] == sorted(got[i] for _, i, _ in rows)


def test_keyword_chain(spark):
    hits = [("k", "f", "1", t, 1.0) for t in (0.0, 0.4, 0.8, 1.1, 3.0)]
    got = sorted(x["start"] for x in text.drop_near_hits(spark.createDataFrame(hits, "kw string, file string, channel string, start double, score double"), 0.5).collect())
    assert got == [0.0, 0.8, 3.0]


def test_pseudo_groups(spark):
    rows = [("g", i, float(x)) for i, x in enumerate([3, 3, 3, 9, 1, 1, 1, 1])]
    got = [x["part"] for x in aggregates.pseudo_groups(spark.createDataFrame(rows, "g string, i int, x double"), "g", "i", "x", 3, 7.0).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 4]


def test_lists_are_inverse(spark):
    rows = spark.createDataFrame([("s1", "u1"), ("s1", "u2"), ("s2", "u3")], "spk string, utt string")
    lists = aggregates.to_lists(rows, "spk", "utt")
    assert validate.inverse(lists, rows, "spk", "utt").count() == 0
    assert validate.inverse(lists, rows.where("utt <> 'u3'"), "spk", "utt").count() == 1
    assert validate.chain_steps("mean-nothing-norm", {"test": {"mean", "norm"}}, "test") == ["nothing"]


def test_signal(spark):
    wave = [float(i % 5) for i in range(40)]
    df = spark.createDataFrame([(1, wave)], "k int, w array<double>")
    got = df.select(signal.frames(F.col("w"), 16, 8).alias("f"), signal.reflected(F.col("w"), 3, 2).alias("r"), F.size(signal.masked(F.col("w"), F.col("k"), 10, 1)).alias("m"), signal.fbank(F.col("w"), 1000, 5).alias("b")).first()
    assert got["f"] == [wave[i * 8 : i * 8 + 16] for i in range(4)]
    assert got["r"] == [2.0, 1.0, 0.0, *wave, 4.0, 3.0] and got["m"] == 40 and len(got["b"]) == 5
    assert spark.range(1).select(arrays.decibel_to_amplitude(F.lit(10.0))).first()[0] == pytest.approx(3.162, abs=1e-3)
    assert signal.window("hanning", 5)[2] == pytest.approx(1.0)


@pytest.mark.parametrize("samples, snip, want", [(399, True, 0), (400, True, 1), (560, True, 2), (80, False, 1), (79, False, 0), (240, False, 2)])
def test_num_frames(spark, samples, snip, want):
    assert spark.range(1).select(signal.num_frames(F.lit(samples), 400, 160, snip)).first()[0] == want


def test_targets(spark):
    def frame(a, b):
        row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(segments.merged_targets([F.col("a"), F.col("b")], [0.5, 0.5]).alias("t")).first()
        return [round(x, 3) for x in row["t"]]

    assert frame([1.0, 0.0, 0.0], [0.6, 0.0, 0.4]) == [0.8, 0.0, 0.2]
    assert frame([0.0, 0.4, 0.6], [1.0, 0.0, 0.0]) == [0.0, 0.0, 0.0]


def test_text_tables(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "s1"), ("u2", "s1")], "key string, value string")
    tables.write_mapping(rows, str(tmp_path / "utt2spk"))
    assert sorted(map(tuple, tables.read_mapping(spark, str(tmp_path / "utt2spk")).collect())) == [("u1", "s1"), ("u2", "s1")]
    (tmp_path / "x.ctm").write_text("f 1 0.5 0.2 hello\nf 1 0.7 0.1 you 0.9\n")
    assert [r["confidence"] for r in tables.read_ctm(spark, str(tmp_path / "x.ctm")).orderBy("start").collect()] == [1.0, 0.9]
    (tmp_path / "m").write_text("utt a b\nu1 1.5 -inf\nu2 0 2\n")
    assert sorted((r["test"], r["enroll"], r["score"]) for r in tables.read_score_matrix(spark, str(tmp_path / "m")).collect()) == [("u1", "a", 1.5), ("u2", "a", 0.0), ("u2", "b", 2.0)]
    entry = spark.createDataFrame([("a.ark:12[3:9]",), ("b.ark",)], "p string").select(tables.range_of(F.col("p")).alias("r")).collect()
    assert tuple(entry[0]["r"]) == ("a.ark", 12, 3, 9) and tuple(entry[1]["r"]) == ("b.ark", None, None, None)
    with pytest.raises(Exception, match="shell pipe"):
        tables.refuse_pipes(spark.createDataFrame([("cat x |",)], "path string")).collect()


def test_archives(spark, tmp_path):
    import struct

    v, m = np.array([1, 2, 3], "<f4"), np.arange(6, dtype="<f4").reshape(3, 2)
    data = b"k1 \0BFV " + b"\4" + struct.pack("<i", 3) + v.tobytes() + b"k2 \0BFM " + b"\4" + struct.pack("<i", 3) + b"\4" + struct.pack("<i", 2) + m.tobytes() + b"k3  [ 1.5 2.5 ]\n"
    (tmp_path / "a.ark").write_bytes(data)
    got = {r["key"]: (r["rows"], r["cols"], r["values"]) for r in archives.read_archives(spark, str(tmp_path / "a.ark")).collect()}
    assert got == {"k1": (1, 3, [1, 2, 3]), "k2": (3, 2, [0, 1, 2, 3, 4, 5]), "k3": (1, 2, [1.5, 2.5])}
    part = {r["key"]: r["values"] for r in archives.read_archives(spark, str(tmp_path / "a.ark"), 1, 2).collect()}
    assert part["k2"] == [2, 3, 4, 5]
    spark.dataSource.register(archives.ArchiveSource)
    assert spark.read.format("keyed-archive").load(f"file://{tmp_path}/a.ark").count() == 3
    frames = archives.frames_of(archives.read_archives(spark, str(tmp_path / "a.ark"))).where("key = 'k2'").orderBy("frame").collect()
    assert [r["feat"] for r in frames] == [[0, 1], [2, 3], [4, 5]]


def test_framed_stream(spark, tmp_path):
    pieces = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0]), ("a", 1, [4.0, 5.0, 6.0, 7.0]), ("b", 0, [1.0])], "k string, n int, x array<double>")
    pieces.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pieces.schema).parquet(str(tmp_path / "in"))
    q = live.framed_stream(stream, "k", "n", "x", 4, 2).writeStream.format("memory").queryName("frames").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["frame"], r["samples"]) for r in spark.table("frames").collect()) == [(0, [1, 2, 3, 4]), (1, [3, 4, 5, 6])]


def test_balanced_and_cropped(spark):
    rows = spark.createDataFrame([("g", "a", 100), ("g", "b", 100), ("h", "c", 30)], "g string, k string, n int")
    got = sampling.balanced_chunks(rows, "g", "k", "n", 20, 0.5, 1)
    counts = {r["g"]: r["c"] for r in got.groupBy("g").agg(F.count("*").alias("c")).collect()}
    assert counts["g"] == counts["h"] == 18
    assert got.join(rows, ["g", "k"]).where("first < 0 or last >= n").count() == 0
    short = spark.createDataFrame([(1, [1.0, 2.0])], "k int, v array<double>").select(sampling.crop(F.col("v"), F.col("k"), 5, 1).alias("v")).first()["v"]
    assert short == [1, 2, 1, 2, 1]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("g"))
    a = sorted(r["id"] for r in keyed.per_group_sample(rows.repartition(7), "id", "g", 5, 3).collect())
    b = sorted(r["id"] for r in keyed.per_group_sample(rows.coalesce(1), "id", "g", 5, 3).collect())
    assert a == b and len(a) == 35


def test_islands_of_one_label(spark):
    rows = spark.createDataFrame([("r", 1, None), ("r", 2, None), ("r", 3, "x")], "g string, t int, l string")
    assert sorted((r["first"], r["last"]) for r in ordered.islands(rows, "g", "t", "l").collect()) == [(1, 2), (3, 3)]
