"""Whitening of embeddings with exact arithmetic up to the components.

Entries become integers, so the scatter n * sum(x x') - S S' is a matrix of integers, added up exactly over Spark. Its characteristic
polynomial is found modulo many primes, each by reduction to Hessenberg form, and put together by Chinese remaindering. All its roots
are real, so Descartes' rule counts those above a bound exactly; bisection by that count isolates them. Components are null vectors of
(scatter - root), by inverse iteration in long decimals. Primes, roots and components are rows of small tables that Spark deals out;
the driver holds only matrices and lists of the dimension of the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned

#: What each entry is shifted by; it cancels out of every result but x itself.
SHIFT = 1_000_000
#: Bits of a root behind its leading one, and digits of the arithmetic that finds its vector.
ROOT_BITS = 224
DIGITS = 90
#: Roots of n^2 V are integers or irrational; what lies within 2^-FRACTION of another counts as equal to it.
FRACTION = 128


@dataclass(frozen=True)
class Model:
    """n vectors with sums S of x - SHIFT; roots of the scatter and their unit vectors (rows), of falling size; the scatter's trace."""

    n: int
    sums: list[int]
    values: list[Decimal]
    vectors: np.ndarray
    trace: int

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def scale(self) -> np.ndarray:
        """What takes n x - S, projected, to whitened values; NaN where the variance is 0."""
        return np.array([1 / np.sqrt(float(v)) if v else np.nan for v in self.values])

    @property
    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace else None for v in self.values]


# Integers


def integers(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x - SHIFT as int64 matrix) for each length of the vectors of a batch, without those that are null or hold null,
    non-finite or too large entries (64 times an entry must fit 62 bits)."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        flat = lists.take(pa.array(rows)).flatten()
        entries = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), d)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(64 * entries)
            good = (np.abs(scaled) < 2.0**62).all(axis=1)
        if good.any():
            yield rows[good], scaled[good].astype(np.int64)


def added(y: np.ndarray) -> np.ndarray:
    """The sum of the rows as Python's integers."""
    fits = int(np.abs(y).max()) * len(y) < 2**62
    return y.sum(axis=0).astype(object) if fits else y.astype(object).sum(axis=0)


def gram(y: np.ndarray) -> np.ndarray:
    """y' y exactly: by floating products where all sums stay below 2^53, else by Python's integers."""
    most = max(1, int(np.abs(y).max()))
    step = (2**53 - 1) // (most * most)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    if step:
        for i in range(0, len(y), step):
            block = y[i : i + step].astype(np.float64)
            out += (block.T @ block).astype(np.int64).astype(object)
    else:
        big = y.astype(object)
        out += big.T @ big
    return out


def scatter(vectors: DataFrame, column: str) -> tuple[int, list[int], list[list[int]]] | None:
    """n, S and n * sum(y y') - S S' of y = x - SHIFT, for the commonest length of vectors (ties: the longest); None if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, y in integers(batch, column):
                d = y.shape[1]
                n, s, g = sums.get(d, (0, np.zeros(d, object), np.zeros((d, d), object)))
                sums[d] = (n + len(y), s + added(y), g + gram(y))
        for d, (n, s, g) in sums.items():
            i, j = np.triu_indices(d)
            i, j = np.concatenate([[-2], np.full(d, -1), i]), np.concatenate([[0], np.arange(d), j])
            value = [n, *s, *g[np.triu_indices(d)]]
            # Digits of base 10^15, which Spark's decimals add up exactly.
            for digit in range(3):
                part = [v if digit == 2 else v % 10**15 for v in value]
                value = [v // 10**15 for v in value]
                if any(part):
                    yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "digit": pa.array([digit] * len(i), pa.int32()), "v": pa.array([Decimal(v) for v in part], pa.decimal128(38, 0))})

    parts = vectors.select(F.col(f"`{column}`")).mapInArrow(run, "d int, i int, j int, digit int, v decimal(38,0)")
    rows = pinned(parts.groupBy("d", "i", "j", "digit").agg(F.sum("v").cast("string").alias("v")))
    # The sizes first: only the table of one length comes to the driver.
    counted = rows.where("i = -2").groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)") * F.pow(F.lit(10.0), 15 * F.col("digit"))).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if counted is None:
        return None
    d = counted["d"]
    n, s, g = 0, [0] * d, [[0] * d for _ in range(d)]
    for r in rows.where(F.col("d") == d).collect():
        value = int(r["v"]) * 10 ** (15 * r["digit"])
        if r["i"] == -2:
            n += value
        elif r["i"] == -1:
            s[r["j"]] += value
        else:
            g[r["i"]][r["j"]] += value
    return n, s, [[n * g[min(i, j)][max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


# The characteristic polynomial


def is_prime(m: int) -> bool:
    """Miller's test with bases that decide below 2^32."""
    if m < 2 or m % 2 == 0:
        return m == 2
    odd, twos = m - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, m)
        if base % m and x != 1 and all((x := x if k == 0 else x * x % m) != m - 1 for k in range(twos)):
            return False
    return True


def primes(least_product: int) -> list[int]:
    """The largest primes below 2^31 whose product is at least that much."""
    out, product, m = [], 1, 2**31
    while product < least_product:
        m -= 1
        if is_prime(m):
            out.append(m)
            product *= m
    return out


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients (constant first) of det(t - matrix) modulo a prime below 2^31, by reduction to Hessenberg form."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + below[0]
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k, :-1]
        new = (new - h[k, k] * polys[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            new = (new - product * int(h[i, k]) % p * polys[i]) % p
        polys[k + 1] = new
    return polys[d].tolist()


def dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table, a row a task as far as there are cores twice over."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 2 * spark.sparkContext.defaultParallelism)))


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients (constant first) of det(t - matrix) for a matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The k-th elementary symmetric function of d values that are not negative is at most comb(d, k) (their mean)^k.
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    chosen = primes(2 * bound + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"p": frame["p"], "c": [polynomial_mod(matrix, int(p)) for p in frame["p"]]})

    found = dealt(spark, [(p,) for p in chosen], "p bigint").mapInPandas(run, "p bigint, c array<bigint>").collect()
    value, product = [0] * (d + 1), 1
    for r in found:
        inverse = pow(product, -1, r["p"])
        value = [v + product * ((c - v) * inverse % r["p"]) for v, c in zip(value, r["c"])]
        product *= r["p"]
    return [v - product if 2 * v > product else v for v in value]


# Roots


def above(poly: list[int], a: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only lie above a / 2^bits: the changes of sign of its coefficients about that point."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(poly: list[int], a: int, bits: int) -> int:
    """The sign of the polynomial at a / 2^bits."""
    d, value = len(poly) - 1, 0
    for k in range(d, -1, -1):
        value = value * a + (poly[k] << (bits * (d - k)))
    return (value > 0) - (value < 0)


def root(poly: list[int], k: int, trace: int) -> tuple[int, int, int, int]:
    """The k-th largest root as (value, bits): value / 2^bits lies at or below it, by less than one unit; and how many roots are larger, and not smaller.

    Bisection by the number of roots above, first in whole numbers, then, once one root is left in the interval, by the sign.
    Roots that share an interval of 2^-FRACTION count as one.
    """
    low, high, bits = -1, trace, 0
    larger, upto = 0, len(poly) - 1  # roots above high, roots above low
    while upto - larger > 1 and (high - low > 1 or bits < FRACTION):
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        count = above(poly, middle, bits)
        if count >= k:
            low, upto = middle, count
        else:
            high, larger = middle, count
    if upto - larger > 1:
        return low, bits, larger, upto
    more = max(0, ROOT_BITS - max(high, 1).bit_length() + 1)
    low, high, bits = low << more, high << more, bits + more
    at_high = sign_at(poly, high, bits)
    if not at_high:
        return high, bits, larger, upto
    while high - low > 1:
        middle = (low + high) // 2
        sign = sign_at(poly, middle, bits)
        if not sign:
            return middle, bits, larger, upto
        low, high = (low, middle) if sign == at_high else (middle, high)
    return low, bits, larger, upto


def largest_roots(spark: SparkSession, poly: list[int], most: int, trace: int) -> list[tuple[Decimal, int, int]]:
    """(root, how many are larger, how many are not smaller) of the `most` largest, each found by a task of its own."""
    numbers = [(k,) for k in range(1, min(most, len(poly) - 1) + 1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [root(poly, int(k), trace) for k in frame["k"]]
            yield pd.DataFrame({"k": frame["k"], "value": [str(v) for v, *_ in found], "bits": [b for _, b, *_ in found], "larger": [x for *_, x, _ in found], "upto": [x for *_, x in found]})

    rows = dealt(spark, numbers, "k int").mapInPandas(run, "k int, value string, bits int, larger int, upto int").collect()
    with localcontext(Context(prec=DIGITS)):
        return [(max(Decimal(0), Decimal(int(r["value"])) / Decimal(2) ** r["bits"]), r["larger"], r["upto"]) for r in sorted(rows, key=lambda r: r["k"])]


# Components


def solved(matrix: list[list[int]], value: Decimal, sides: list[list[Decimal]]) -> list[list[Decimal]]:
    """Solutions of (matrix - value) v = side, by elimination with partial pivoting; a pivot of zero gives way to a tiny one."""
    d = len(matrix)
    a = np.array([[Decimal(v) for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= value
    b = np.array(sides, object).T
    tiny = max(max(abs(v) for v in row) for row in a.tolist()) * Decimal(10) ** (8 - DIGITS) or Decimal(1)
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]], b[[k, at]] = a[[at, k]], b[[at, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        times = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] -= times[:, None] * a[k, k:]
        b[k + 1 :] -= times[:, None] * b[k]
    for k in range(d - 1, -1, -1):
        b[k] = (b[k] - a[k, k + 1 :] @ b[k + 1 :] if k + 1 < d else b[k]) / a[k, k]
    return b.T.tolist()


def orthonormal(vectors: list[list[Decimal]]) -> list[list[Decimal]]:
    out: list[list[Decimal]] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                dot = sum(x * y for x, y in zip(u, v))
                v = [y - dot * x for x, y in zip(u, v)]
            size = sum(x * x for x in v).sqrt()
            v = [x / size for x in v]
        out.append(v)
    return out


def null_vectors(matrix: list[list[int]], value: Decimal, count: int) -> list[list[float]]:
    """count orthonormal vectors that the matrix takes to value times themselves, by inverse iteration from fixed vectors; the largest entry is positive."""
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        start = lambda c, i: Decimal(int.from_bytes(hashlib.sha256(f"{c} {i}".encode()).digest()[:6])) / Decimal(2) ** 48 - Decimal("0.5")
        found = orthonormal([[start(c, i) for i in range(d)] for c in range(count)])
        for _ in range(2):
            found = orthonormal(solved(matrix, value, found))
        return [[float(x if max(v, key=abs) > 0 else -x) for x in v] for v in found]


def components(spark: SparkSession, matrix: list[list[int]], roots: list[tuple[Decimal, int, int]]) -> np.ndarray:
    """A unit vector for each root, as rows; equal roots share a task and have orthogonal vectors."""
    groups = {larger: (str(value), upto - larger) for value, larger, upto in reversed(roots)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(first + i, v) for first, value, count in frame.itertuples(index=False) for i, v in enumerate(null_vectors(matrix, Decimal(value), int(count)))]
            yield pd.DataFrame({"k": [k for k, _ in out], "v": [v for _, v in out]})

    rows = dealt(spark, [(larger, value, count) for larger, (value, count) in groups.items()], "larger int, value string, count int").mapInPandas(run, "k int, v array<double>").collect()
    by_place = {r["k"]: r["v"] for r in rows}
    return np.array([by_place[k] for k in range(len(roots))])


def fit(vectors: DataFrame, column: str = "embedding", most: int = 32) -> Model | None:
    """The model of all vectors: up to `most` components of the covariance of x = floor(64 c) + SHIFT, by falling variance.

    Rows whose vector is null, empty, of another length than the commonest, or holds null, non-finite or too large entries are left out; None if no row is left.
    """
    found = scatter(vectors, column)
    if found is None:
        return None
    spark = vectors.sparkSession
    n, sums, matrix = found
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    poly = characteristic_polynomial(spark, matrix)
    roots = largest_roots(spark, poly, most, trace)
    return Model(n, sums, [v for v, *_ in roots], components(spark, matrix, roots), trace)


# Applying it


def deviations(z: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row of integers; None if it does not fit a long."""
    if z.dtype != object and isqrt((2**63 - 1) // z.shape[1]) >= int(np.abs(z).max()):
        return (z * z).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in (sum(int(x) ** 2 for x in row) for row in z)]


def centred(y: np.ndarray, model: Model) -> np.ndarray:
    """n y - S, exactly."""
    most = model.n * int(np.abs(y).max()) + max(abs(s) for s in model.sums)
    kind = np.int64 if most < 2**62 else object
    return model.n * y.astype(kind) - np.array(model.sums, kind)


def projected(z: np.ndarray, model: Model) -> np.ndarray:
    return (z.astype(np.float64) @ model.vectors.T) * model.scale


def own_rows(batch: pa.RecordBatch, column: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(rows, n y - S) of a batch for the vectors of the model's length."""
    for rows, y in integers(batch, column):
        if y.shape[1] == model.dim:
            return rows, centred(y, model)
    return np.zeros(0, np.int64), np.zeros((0, model.dim), np.int64)


def merged(a: tuple | None, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of rows together (Chan, Golub and LeVeque, 1979)."""
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def identity_error(vectors: DataFrame, column: str, model: Model) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with a variance; None if there is none."""
    k = int(np.isfinite(model.scale).sum())
    schema = "g int, n bigint, mean array<double>, products array<double>"
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            rows, z = own_rows(batch, column, model)
            if len(rows):
                w = projected(z, model)[:, :k]
                mean = w.mean(axis=0)
                state = merged(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            g = TaskContext.get().partitionId() % 16
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([state[0]]), pa.array([state[1].tolist()]), pa.array([state[2].ravel().tolist()])], names=["g", "n", "mean", "products"])

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        state = None
        for r in frame.itertuples(index=False):
            state = merged(state, (r.n, np.array(r.mean), np.array(r.products).reshape(k, k)))
        return pd.DataFrame({"g": frame["g"][:1], "n": [state[0]], "mean": [state[1].tolist()], "products": [state[2].ravel().tolist()]})

    parts = vectors.select(F.col(f"`{column}`")).mapInArrow(run, schema)
    state = None
    for r in sorted(parts.groupBy("g").applyInPandas(together, schema).collect(), key=lambda r: r["g"]):
        state = merged(state, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    return float(np.abs(state[2] / state[0] - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Model | None, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """ident, component (from 1), n, deviation (exact sum of squares of n x - S; null if it does not fit a long), whitened and explained of each row that `fit` takes.

    A component without variance has a null in whitened; if all vectors are equal, explained is null too. Ids may be null or repeat:
    each row gives its own rows. Without a model there are no rows.
    """
    rows = vectors.select(vectors[f"`{ident}`"].alias("ident"), vectors[f"`{column}`"].alias("vector"))
    kind = rows.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        explained = pa.array(model.explained, pa.float64())
        for batch in batches:
            at, z = own_rows(batch, "vector", model)
            if not len(at):
                continue
            each = np.repeat(np.arange(len(at)), k)
            w = projected(z, model).ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("ident").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), model.n)), pa.array(deviations(z), pa.int64()).take(pa.array(each)), pa.array(w, mask=np.isnan(w)), explained.take(pa.array(np.tile(np.arange(k), len(at))))],
                names=["ident", "component", "n", "deviation", "whitened", "explained"],
            )

    return (rows if model else rows.where("false")).mapInArrow(run, f"ident {kind}, component int, n bigint, deviation bigint, whitened double, explained double")
