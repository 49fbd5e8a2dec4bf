"""Edits, targets on recordings, score files and posterior readers on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import edits, segments, text, trials
from tessella.sources import tables
from tessella.streaming import batches

EDITS = "utt string, place int, hyp_word string, ref_word string, edit string"


def test_taint(spark):
    kinds = ["cor", "sil", "fix", "del", "sil", "cor", "sil", "cor", "ins"]
    rows = [("u", i, None if k in ("sil", "del") else "a", "a", k) for i, k in enumerate(kinds)]
    got = {r["place"]: r["tainted"] for r in edits.tainted(spark.createDataFrame(rows, EDITS)).collect()}
    assert got == {0: False, 1: True, 2: True, 4: True, 5: False, 6: False, 7: False, 8: False}
    assert edits.tainted(spark.createDataFrame(rows, EDITS), remove_deletions=False).count() == 9


def test_unscored_words_and_repetitions(spark):
    um = spark.createDataFrame([("um",), ("uh",)], "word string")
    rows = [("u", 0, "um", None, "ins"), ("u", 1, None, "uh", "del"), ("u", 2, "um", "uh", "sub"), ("u", 3, "a", "b", "sub")]
    got = [tuple(r)[1:] for r in edits.without_unscored(spark.createDataFrame(rows, EDITS), um).orderBy("place").collect()]
    assert got == [(0, "um", "um", "fix"), (2, "um", "um", "fix"), (3, "a", "b", "sub")]
    rows = [("u", 0, "i", "i", "cor"), ("u", 1, "am", "am", "cor"), ("u", 2, "um", None, "ins"), ("u", 3, "i", None, "ins"), ("u", 4, "am", "uh", "sub"), ("u", 5, "am", None, "ins"), ("v", 0, "x", None, "ins"), ("v", 1, "x", "x", "cor"), ("v", 2, "x", None, "ins")]
    got = {(r["utt"], r["place"]): (r["ref_word"], r["edit"]) for r in edits.repetitions_allowed(spark.createDataFrame(rows, EDITS), um).collect()}
    assert got["u", 3] == ("i", "cor") and got["u", 4] == ("am", "cor") and got["u", 5] == (None, "ins") and got["u", 2] == (None, "ins")
    assert got["v", 0] == ("x", "cor") and got["v", 2] == (None, "ins") and len(got) == len(rows)


def test_outcomes(spark):
    words = spark.createDataFrame([("u", 1.0, "a"), ("u", 0.5, "b"), ("u", 2.0, "c"), ("w", 0.0, "z")], "utt string, start double, word string")
    ops = lambda second: spark.createDataFrame([("u", 0, "C", "b"), ("u", 1, "S", second)], "utt string, place int, op string, hyp_word string")
    assert {(r["word"], r["op"]) for r in edits.with_outcomes(words, ops("a")).collect()} == {("b", "C"), ("a", "S")}
    with pytest.raises(Exception, match="words differ"):
        edits.with_outcomes(words, ops("q")).collect()
    depth = spark.createDataFrame([("u", [float(i) for i in range(1, 201)])], "utt string, depth array<double>")
    got = edits.with_depth(words.withColumn("dur", F.lit(0.1)), depth).orderBy("utt", "start").collect()
    assert got[0]["log_depth"] == pytest.approx(math.log(np.mean(range(51, 61)))) and got[2]["log_depth"] is None and got[3]["log_depth"] is None


def test_soft_counts_add_up(spark):
    rows = spark.createDataFrame([("w", ["a_B", "b_E"], 0.5), ("w", ["a_I", "b_E"], 0.25), ("w", ["b_E"], 1.0), ("v", None, 2.0)], "word string, phones array<string>, count double")
    names = spark.createDataFrame([("a_B", "a"), ("a_I", "a"), ("b_E", "b")], "phone string, to string")
    assert {(r["word"], r["pron"]): r["count"] for r in edits.soft_counts(rows, names).collect()} == {("w", "a b"): 0.75, ("w", "b"): 1.0, ("v", ""): 2.0}
    lexicon = spark.createDataFrame([("w", "a"), ("w", "b"), ("x", "c"), ("x", "c")], "word string, pron string")
    assert {r["word"]: r["quota"] for r in edits.variant_quota(spark.createDataFrame([("w",), ("n",)], "word string"), lexicon, 2.0).collect()} == {"w": 4.0, "n": 4.0}


def test_targets_on_recordings(spark):
    recordings = spark.createDataFrame([("r", 20), ("empty", 3)], "recording string, frames int")
    flat = lambda x, n: [[float(x)]] * n
    rows = [("r", "a", 0.0, 0.08, flat(1, 8)), ("r", "b", 0.04, 0.12, flat(3, 8)), ("r", "inside", 0.05, 0.07, flat(9, 2)), ("r", "short", 0.13, 0.19, flat(9, 1)), ("r", "late", 0.16, 0.25, flat(5, 9)), ("r", "outside", 0.3, 0.35, flat(9, 5))]
    segs = spark.createDataFrame(rows, "recording string, utt string, start double, end double, targets array<array<double>>")
    got = {r["recording"]: [x[0] for x in r["targets"]] for r in segments.targets_on_recordings(recordings, segs, [0.0]).collect()}
    assert got["empty"] == [0, 0, 0]
    assert got["r"] == pytest.approx([1, 1, 1, 1, 1, 1.5, 2, 2.5, 3, 3, 3, 3, 0, 0, 0, 0, 5, 5, 5, 5])
    back = segments.as_recordings(segs).where("utt = 'b'").first()
    assert (back["recording"], back["start"], back["piece"]["of"]) == ("b", 0.0, "r") and back["end"] == pytest.approx(0.08)


def test_score_files_and_rates(spark):
    files = spark.createDataFrame([("d/lda_a.score", 2.5), ("d/lda_b.score", None), ("d/cos_a.score", 1.0), ("d/lda_a.eer", 0.0)], "path string, eer double")
    assert [tuple(r) for r in trials.find_scores(files, ["lda"]).orderBy("path").collect()] == [("2.5#1", "d/lda_a.score", 2.5), ("#2", "d/lda_b.score", None)]
    assert [r["path"] for r in trials.find_scores(files, ["a"], ["lda"]).collect()] == ["d/cos_a.score"]
    runs = spark.createDataFrame([("x", 0.2), ("b", 0.1), ("a", 0.1)], "run string, wer double")
    assert text.best_run(runs, "run").first()["run"] == "a"


def test_posteriors_and_intervals(spark, tmp_path):
    (tmp_path / "post").write_text("u1 [ 1 0.5 2 0.5 ] [ ] [ 7 1 ]\n\nu2\n")
    got = {r["key"]: [[tuple(x) for x in f] for f in r["frames"]] for r in tables.read_posteriors(spark, str(tmp_path / "post")).collect()}
    assert got == {"u1": [[(1, 0.5), (2, 0.5)], [], [(7, 1.0)]], "u2": []}
    (tmp_path / "times").write_text("u1 0 0.5 ; 0.5 1.25 ;\nu2\n")
    got = {r["key"]: [tuple(x) for x in r["intervals"]] for r in tables.read_intervals(spark, str(tmp_path / "times")).collect()}
    assert got == {"u1": [(0.0, 0.5), (0.5, 1.25)], "u2": []}


def test_unknown_words_cost(spark):
    model = spark.createDataFrame([("", "a", -1.0, -0.5), ("", "<unk>", -3.0, None), ("", "</s>", -2.0, None), ("<s>", "a", -0.1, None)], "history string, word string, logp double, backoff double")
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "zzz"]), (3, [])], "k int, w array<string>")
    got = {r["k"]: r["logprob"] for r in text.sentence_logprob(rows, "k", F.col("w"), model, 2).collect()}
    assert got == pytest.approx({1: -0.1 - 0.5 - 2.0, 2: -0.1 - 0.5 - 3.0 - 2.0, 3: -2.0})
    bare = text.sentence_logprob(rows, "k", F.col("w"), model.where("word <> '<unk>'"), 2)
    assert {r["k"]: r["logprob"] for r in bare.collect()}[2] == pytest.approx(-0.1 - 0.5 + text.UNSEEN - 2.0)


def test_long_rows_are_cropped(spark):
    rows = spark.createDataFrame([(2, [1, 2]), (5, [1, 2, 3, 4, 5]), (1, [1])], "n int, v array<int>")
    assert sorted((r["n"], list(r["v"])) for r in batches.quota_filter(rows, "n", 2, 4, "v", 4).collect()) == [(2, [1, 2]), (4, [1, 2, 3, 4])]
