"""Operators that take each task's rows in order, not a group at a time, against what their groups give."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import aggregates, segments, text


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("local", [False, True])
def test_alignment_in_rows(monkeypatch, local):
    """The way back of a long pair is made again some rows at a time, with the same result."""
    r = random.Random(4)
    pairs = [[[r.choice("abc") for _ in range(r.randrange(40))] for _ in range(2)] for _ in range(60)]
    whole = [text.align(a, b, 1, -1, -1, local) for a, b in pairs]
    monkeypatch.setattr(text, "CELLS", 1)
    monkeypatch.setattr(text.math, "isqrt", lambda n: 3)
    assert [text.align(a, b, 1, -1, -1, local) for a, b in pairs] == whole


def test_aligned_leaves_in_slices(spark, monkeypatch):
    monkeypatch.setattr(text, "ALIGNED", 5)
    rows = spark.createDataFrame([(1, list("abcdef"), list("abxdef")), (2, [], []), (3, None, ["q"])], "k int, r array<string>, h array<string>")
    df = text.aligned(rows, "k", "r", "h")
    assert sorted((x["k"], x["place"], x["edit"]) for x in df.collect()) == [*[(1, i, "sub" if i == 2 else "cor") for i in range(6)], (3, 0, "ins")]
    assert "MapInArrow" in plan(df)


def test_targets_stream(spark):
    recordings = spark.createDataFrame([(i, i % 7) for i in range(30)] + [(None, 2), (99, None)], "recording int, frames int")
    rows = [(i, f"{i}", 0.0, 0.03, [[float(i), 1.0]] * 3) for i in range(40)]
    df = segments.targets_on_recordings(recordings, spark.createDataFrame(rows, "recording int, utt string, start double, end double, targets array<array<double>>"), [0.0, 0.5])
    got = {r["recording"]: r["targets"] for r in df.collect()}
    assert got == {i: [[float(i), 1.0] if k < 3 else [0.0, 0.5] for k in range(i % 7)] for i in range(30)} | {None: [[0.0, 0.5]] * 2, 99: []}
    assert "Join" not in plan(df) and "FlatMapGroups" not in plan(df)


def test_groups_stream(spark):
    hits = [("w", f, "1", t, s) for f in "ab" for t, s in [(0.0, 1.0), (0.3, 2.0), (0.9, 1.0), (0.9, 3.0), (2.0, 0.5)]]
    near = text.drop_near_hits(spark.createDataFrame(hits, "kw string, file string, channel string, start double, score double"), 0.5)
    assert sorted((r["file"], r["start"], r["score"]) for r in near.collect()) == [(f, *x) for f in "ab" for x in [(0.0, 1.0), (0.9, 3.0), (2.0, 0.5)]]
    parts = aggregates.pseudo_groups(spark.createDataFrame([(g, i, 3.0) for g in range(20) for i in range(5)], "g int, i int, x double"), "g", "i", "x", 3, 7.0)
    assert {(r["g"], r["i"]): r["part"] for r in parts.collect()} == {(g, i): i // 2 for g in range(20) for i in range(5)}
    rows = spark.createDataFrame([("r", 1, 1.0, 2.0), ("r", 2, 2.5, 3.0), ("r", 3, 3.1, 9.0), ("s", 1, 0.0, 1.0)], "g string, k int, start double, end double")
    padded = segments.padded(rows, "g", "k", 2.0, 2.0)
    got = {(r["g"], r["k"]): (r["start"], r["end"]) for r in padded.collect()}
    assert got == {("r", 1): (0.0, 2.25), ("r", 2): (2.25, 3.05), ("r", 3): (3.05, 9.0), ("s", 1): (0.0, 1.0)}
    assert not any("FlatMapGroups" in plan(df) for df in (near, parts, padded))


def test_tokens_are_mapped_inside(spark, monkeypatch):
    """A short mapping gives what the join gives, without a shuffle of tokens."""
    rows = spark.createDataFrame([(1, ["a", "b", None, "c", "a"]), (2, []), (3, None), (3, ["d"])], "k int, w array<string>")
    mapping = spark.createDataFrame([("a", ["y"]), ("a", ["x", "x"]), ("b", []), ("d", None), (None, ["n"])], "`from` string, to array<string>")
    inside = text.map_tokens(rows, "w", mapping)
    assert "Generate" not in plan(inside)
    monkeypatch.setattr(text, "MAPPED_INSIDE", 0)
    joined = sorted(text.map_tokens(rows, "w", mapping).collect(), key=str)
    assert sorted(inside.collect(), key=str) == joined and joined[0]["w"] == ["x", "x", "y", None, "c", "x", "x", "y"]


def test_components_contract(spark, monkeypatch):
    """Chains, loops and hubs; what is kept of links gets less each round."""
    kept = []
    monkeypatch.setattr(segments, "pinned", lambda df, pinned=segments.pinned: (kept.append((sorted(df.columns), df.count())), pinned(df))[1])
    r = random.Random(8)
    ways = list(range(100, 180))
    r.shuffle(ways)
    edges = [*zip(ways, ways[1:]), *[(7, k) for k in range(200, 230)], (1, 1), (2, 3), (3, 2), (None, 5), (6, None), *[(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(25)]]
    label = {x: x for e in edges for x in e if x is not None}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = segments.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((x["node"], x["label"]) for x in got) == sorted(label.items())
    links = [n for columns, n in kept if columns == ["u", "v"]]
    assert links == sorted(set(links), reverse=True) and links[-1] == 0
