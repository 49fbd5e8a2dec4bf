"""Segments from decodes, held against frames moved one by one."""

import random

import pytest

from tessella.operators import decodes


def walked(labels, silence, most, hard, noise_only, shift=0.01):
    """The steps on one recording, frame by frame."""
    n = len(labels)
    spans, at = [], 0
    while at < n:
        end = at
        while end < n and labels[end]:
            end += 1
        if end > at:
            spans.append([at, end])
        at = max(end, at + 1)
    if not spans:
        return []
    sound = sum(b - a for a, b in spans)
    gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:])]
    target, have, moved = int(sound / (1 - silence)), sound, True
    while have < target and moved:
        moved = False
        for i, s in enumerate(spans):
            if have < target and s[0] > (spans[i - 1][1] if i else 0):
                s[0], have, moved = s[0] - 1, have + 1, True
            if have < target and s[1] < (spans[i + 1][0] if i + 1 < len(spans) else n):
                s[1], have, moved = s[1] + 1, have + 1, True
    walls = set(range(1, len(spans)))
    for i in sorted((i for i in range(1, len(spans)) if spans[i][0] == spans[i - 1][1]), key=lambda i: gaps[i - 1]):
        a = max((w for w in walls if w < i), default=0)
        b = min((w for w in walls if w > i), default=len(spans))
        if (spans[b - 1][1] - spans[a][0]) * shift <= most:
            walls.remove(i)
    edges = [0, *sorted(walls), len(spans)]
    out = []
    for a, b in zip(edges, edges[1:]):
        start, end = spans[a][0], spans[b - 1][1]
        limit = int(hard / shift)
        parts = -(-(end - start) // limit) if end - start > limit else 1
        each = (end - start) // parts
        cuts = [start + k * each for k in range(parts)] + [end]
        out += [(x, y, labels[x:y].count(2)) for x, y in zip(cuts, cuts[1:])]
    return [x for x in out if x[2] or noise_only]


@pytest.mark.parametrize("silence, most, hard, noise_only", [(0.2, 0.6, 1.0, False), (0.5, 0.3, 0.5, True), (0.05, 1.0, 2.0, False), (0.9, 2.0, 2.0, False)])
def test_segments_from_decodes_against_frames(spark, silence, most, hard, noise_only):
    rng = random.Random(3)
    every = {}
    for k in range(80):
        labels = []
        while len(labels) < rng.randint(1, 400):
            labels += [rng.choice((0, 0, 1, 2, 2))] * rng.choice((1, 2, 3, 5, 20, 60))
        every[f"r{k}"] = labels
    every["quiet"], every["one"] = [0] * 50, [2]
    frames = spark.createDataFrame([(r, i, x) for r, labels in every.items() for i, x in enumerate(labels)], "recording string, frame int, label int")
    runs = decodes.runs_of(frames.repartition(3))
    got = {}
    for r in decodes.segments_from_decodes(runs, silence, 0.01, most, hard, noise_only).collect():
        got.setdefault(r["recording"], []).append((round(100 * r["start"]), round(100 * r["end"]), r["speech"], r["utt"]))
    want = {r: walked(labels, silence, most, hard, noise_only) for r, labels in every.items()}
    assert {r: sorted(x[:3] for x in v) for r, v in got.items()} == {r: v for r, v in want.items() if v}
    for r, v in got.items():
        end, width = max(x[1] for x in v), 1
        while 10 ** (width - 1) < end:
            width += 1
        assert {x[3] for x in v} == {f"{r}-{a:0{width}d}-{b:0{width}d}" for a, b, *_ in v}
    share = {r: (sum(b - a for a, b, *_ in v), sum(every[r][i] == 0 for a, b, *_ in v for i in range(a, b))) for r, v in got.items()}
    if noise_only:  # else segments that go take silence with them
        assert all(s <= silence * n + 1 for n, s in share.values()) and sum(s > silence * n - 2 for n, s in share.values()) > 30


def test_segments_from_decodes_odd_input(spark):
    empty = spark.createDataFrame([], "recording string, start int, end int, label int")
    assert decodes.segments_from_decodes(empty).count() == 0
    runs = spark.createDataFrame([(None, 0, 10, 0), (None, 10, 90, 2), (None, 90, 200, 0), ("n", 0, 30, 1)], empty.schema)
    assert [(r["recording"], r["start"], r["end"], r["speech"]) for r in decodes.segments_from_decodes(runs).collect()] == []
