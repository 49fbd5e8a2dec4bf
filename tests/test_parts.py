"""Parts of whole groups with balanced boundaries against the rule on plain lists."""

import random

import pytest

from tessella.operators import sampling


def balanced(sizes, n):
    """Lists of places, moved one group at a time."""
    parts = [[] for _ in range(n)]
    for i in range(len(sizes)):
        parts[i * n // len(sizes)].append(i)
    total = lambda k: sum(sizes[i] for i in parts[k])
    changed = True
    while changed:
        changed = False
        for k in range(n):
            for to, take, put in ((k + 1, -1, 0), (k - 1, 0, None)):
                if 0 <= to < n and parts[k]:
                    own = sizes[parts[k][take]]
                    if abs((total(to) + own) - (total(k) - own)) < abs(total(to) - total(k)):
                        moved = parts[k].pop(take)
                        parts[to].insert(len(parts[to]) if put is None else put, moved)
                        changed = True
    return {i: k for k, part in enumerate(parts) for i in part}


@pytest.mark.parametrize("seed, groups, n, around", [(1, 40, 4, None), (2, 200, 7, 3), (3, 12, 12, 1), (4, 60, 1, None), (5, 300, 5, 10)])
def test_balanced_parts(spark, seed, groups, n, around):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, 10, 50, 200]) * (1 + 5 * (i > groups // 2)) for i in range(groups)]
    df = spark.createDataFrame([(f"g{i:04d}", x) for i, x in enumerate(sizes)], "g string, n int").repartition(3)
    got = {int(x["g"][1:]): x["part"] for x in sampling.balanced_parts(df, "g", "n", n, around).collect()}
    assert got == balanced(sizes, n)


def test_too_few_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "g string, n int")
    assert {x["g"]: x["part"] for x in sampling.balanced_parts(df, "g", "n", 2).collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError, match="3 parts"):
        sampling.balanced_parts(df, "g", "n", 3)
