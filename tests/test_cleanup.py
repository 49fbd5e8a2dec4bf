"""Segments from edits, held against a plain walk over each utterance."""

import random

import pytest

from tessella.operators import cleanup, edits

COLUMNS = "utt string, place int, start double, dur double, hyp_word string, ref_word string, edit string, tainted boolean"
FREE = {"um", "[noise]"}


def walked(rows, lim, unknown="<unk>"):
    """The segments of one utterance, line by line: (start, end, text, first, last), and why others went."""
    start, dur, hyp, ref, edit, bad = ([r[i] for r in rows] for i in (2, 3, 4, 5, 6, 7))
    n = len(rows)
    agree = [edit[i] == "cor" and hyp[i] == ref[i] for i in range(n)]
    quiet = [agree[i] or (not bad[i] and edit[i] in ("cor", "sil", "fix")) for i in range(n)]
    free = [r in FREE for r in ref]
    found = []
    i = 0
    while i < n:
        j = i
        while j < n and quiet[j]:
            j += 1
        if any(agree[i:j]):
            found.append([i, j - 1])
        i = max(j, i + 1)
    grown = []
    for a, b in found:
        def ends(k, hyp=hyp):
            return edit[k] == "cor" and hyp[k] not in FREE

        grown.append((a - (a > 0 and bad[a - 1] and ends(a)), b + (b + 1 < n and bad[b + 1] and ends(b))))
    cut = []
    for a, b in grown:
        at = [k for k in range(a + 1, b) if (edit[k] == "sil" and dur[k] > lim.inner_silence) or (free[k] and dur[k] > lim.inner_unscored)]
        edges = [a, *at, b]
        cut += [dict(a=x, b=y, ka=0.5 if x in at else 1.0, kb=0.5 if y in at else 1.0, pa=0.0, pb=0.0) for x, y in zip(edges, edges[1:])] if at else [dict(a=a, b=b, ka=1.0, kb=1.0, pa=0.0, pb=0.0)]

    begin = lambda s: start[s["a"]] + dur[s["a"]] - s["pa"] - dur[s["a"]] * s["ka"]
    end = lambda s: start[s["b"]] + dur[s["b"]] * s["kb"] + s["pb"]
    size = lambda s: end(s) - begin(s)
    over = start[-1] + dur[-1]
    kept, gone = [], []
    for s in cut:
        for k, line in (("ka", s["a"]), ("kb", s["b"])):
            most = lim.edge_silence if edit[line] == "sil" and dur[line] > lim.edge_silence else lim.edge_unscored if free[line] and dur[line] > lim.edge_unscored else None
            if most is not None:
                s[k] = most / dur[line]
        enough, short, old = max(lim.least, lim.least_new), size(s), dict(s)
        if short < enough:
            s["ka"], s["kb"] = (s["ka"] if bad[s["a"]] else 1.0), (s["kb"] if bad[s["b"]] else 1.0)
            if size(s) > enough:
                w = (enough - size(s)) / (short - size(s))
                s["ka"], s["kb"] = w * old["ka"] + (1 - w) * s["ka"], w * old["kb"] + (1 - w) * s["kb"]
        for p, line, room in (("pa", s["a"], start[s["a"]]), ("pb", s["b"], over - (start[s["b"]] + dur[s["b"]]))):
            if edit[line] == "cor" and not free[line] and min(lim.padding, room) >= 0.5 * lim.padding:
                s[p] = min(lim.padding, room)
        entire = abs(begin(s)) < 0.001 and abs(end(s) - over) < 0.001
        why = "new" if not entire and size(s) < 0.999 * lim.least_new else "short" if size(s) < 0.999 * lim.least else None
        rest = lambda k: (edit[k] == "sil" or (edit[k] == "cor" and free[k])) and dur[k] > lim.rest
        junk = lambda side: s["p" + side] + (dur[s[side]] * s["k" + side] if bad[s[side]] else 0.0)
        at = [k for k in range(s["a"] + 1, s["b"]) if rest(k)]
        if junk("a") and at and junk("a") >= lim.junk * (start[at[0]] - begin(s)):
            s.update(a=at[0], ka=1.0, pa=0.0)
        at = [k for k in range(s["a"] + 1, s["b"]) if rest(k)]
        if junk("b") and at and junk("b") >= lim.junk * (end(s) - (start[at[-1]] + dur[at[-1]])):
            s.update(b=at[-1], kb=1.0, pb=0.0)
        if why is None and not any(agree[k] and not free[k] for k in range(s["a"], s["b"] + 1)):
            why = "unscored"
        if why is None and (junk("a") + junk("b")) / size(s) > lim.junk:
            why = "junk"
        (gone if why else kept).append(why or s)
    out, hidden = [], set()
    for s in kept:
        if out and end(out[-1]) >= begin(s):
            t = out[-1]
            low, high = min(t["b"], s["a"]), max(t["b"], s["a"])
            lost = [k for k in range(low, high + 1) if edit[k] == "del"]
            if len(lost) > lim.deletions:
                hidden |= set(lost)
            t.update(b=s["b"], kb=s["kb"], pb=s["pb"])
        else:
            out.append(s)
    text = lambda s: " ".join([unknown] * (s["pa"] != 0) + [ref[k] for k in range(s["a"], s["b"] + 1) if ref[k] is not None and k not in hidden] + [unknown] * (s["pb"] != 0))
    return [(round(begin(s) / lim.frame), round(end(s) / lim.frame), text(s), s["a"] + 1, s["b"] + 1) for s in out], gone


def utterance(rng, name):
    """Edits in bursts: mostly right, with errors, silences of all lengths and words that do not count."""
    rows, at, errors = [], 0, rng.random() * 0.3
    for i in range(rng.randint(1, 40)):
        kind = rng.choices(("cor", "unk", "sil", "fix", "free", "del", "ins", "sub"), (6, 0.5, 1.5, 0.3, 0.5, 4 * errors, 2 * errors, 2 * errors))[0]
        word = rng.choice("abc")
        length = 0 if kind == "del" else rng.choice((5, 10, 20, 30, 60, 120, 250) if kind in ("sil", "free") else (3, 10, 20, 30, 50))
        hyp, ref = {"cor": (word, word), "unk": ("<unk>", word), "sil": (None, None), "fix": (word, word), "free": ("um", "um"), "del": (None, word), "ins": (word, None), "sub": (word, word + "x")}[kind]
        rows.append((name, i, at / 100, length / 100, hyp, ref, {"unk": "cor", "free": "cor"}.get(kind, kind)))
        at += length
    return rows


@pytest.mark.parametrize("limits", [cleanup.Limits(), cleanup.Limits(least=0.2, least_new=0.4, junk=0.3, deletions=0), cleanup.Limits(edge_silence=0.1, edge_unscored=0.05, inner_silence=0.5, inner_unscored=0.3, padding=0.2, junk=0.5, rest=0.05)])
def test_segments_from_edits_against_a_walk(spark, limits):
    rng = random.Random(7)
    rows = [r for u in range(300) for r in utterance(rng, f"u{u}")]
    free = spark.createDataFrame([(w,) for w in FREE], "word string")
    given = spark.createDataFrame(rows, COLUMNS.replace(", tainted boolean", ""))
    marked = edits.tainted(given, remove_deletions=False).select(*[c.split()[0] for c in COLUMNS.split(", ")]).toPandas().sort_values(["utt", "place"])
    marked = [tuple(None if x != x else x for x in r) for r in marked.itertuples(index=False)]
    table = spark.createDataFrame(marked, COLUMNS).repartition(5)
    by_utt = {}
    for r in marked:
        by_utt.setdefault(r[0], []).append(r)
    want, gone = {}, []
    for utt, own in by_utt.items():
        found, dropped = walked(own, limits)
        gone += dropped
        want |= {(utt, k + 1): s for k, s in enumerate(found)}
    got = {(r["utt"], r["segment"]): (round(r["start"] / limits.frame), round(r["end"] / limits.frame), r["text"], r["first"], r["last"]) for r in cleanup.segments_from_edits(table, free, limits).collect()}
    assert got == want and len(want) > 100
    assert sorted(r["dropped"] for r in cleanup.candidates(table, free, limits).collect() if r["dropped"]) == sorted(gone) and {"new", "junk"} <= set(gone)
    segments = cleanup.segments_from_edits(table, free, limits)
    lost = {}
    for utt, own in by_utt.items():
        inside = {k for (u, _), s in want.items() if u == utt for k in range(s[3], s[4] + 1)}
        for k, r in enumerate(own, 1):
            if r[5] is not None:
                x = lost.setdefault(r[5], [0, 0])
                x[0] += k not in inside
                x[1] += 1
    assert {r["word"]: (r["lost"], r["total"]) for r in cleanup.words_lost(table, segments).collect()} == {w: (a / b, b) for w, (a, b) in lost.items()}


def test_segments_from_edits_odd_input(spark):
    free = spark.createDataFrame([("um",)], "word string")
    empty = spark.createDataFrame([], COLUMNS)
    assert cleanup.segments_from_edits(empty, free).count() == 0
    rows = [("u", 0, 0.0, 2.0, "a", "a", "cor", None), ("v", 0, 0.0, 0.0, None, "b", "del", False), (None, 3, 0.0, 2.0, "c", "c", "cor", False)]
    got = {(r["utt"], r["start"], r["end"], r["text"]) for r in cleanup.segments_from_edits(spark.createDataFrame(rows, COLUMNS), free).collect()}
    assert got >= {("u", 0.0, 2.0, "a")} and not any(u == "v" for u, *_ in got)
