"""Embedding whitening by an exact characteristic polynomial.

Each entry ``c`` of a vector becomes the integer ``floor(256 * c)``. Fitted is the
list of distinct integer vectors: ``n`` of them, with sums ``S`` and scatter
``M`` (sums of products), both exact. ``n * M - S S'`` is an integer matrix ``C``
and the covariance is ``C / n^2``, so nothing is rounded before the components.

The characteristic polynomial of ``C`` is computed modulo primes below 2**31
(reduction to Hessenberg form, then the recurrence over its columns), each prime
in a row of a Spark table, and put together by the Chinese remainder theorem;
its coefficients are elementary symmetric functions of eigenvalues that are not
negative, which bounds them and says how many primes it takes. All roots are
real, so the sign changes of the shifted polynomial count the roots beyond any
point exactly: they isolate the largest roots, multiple ones included, and
signs alone refine them to ``ROOT_BITS`` bits. Components come from inverse
iteration on ``C`` minus the root in fixed-point integers: with a root this
exact it lands in the null space, and rounding to doubles comes last.

On Spark: distinct vectors by a partially aggregated grouping, sums as integer
limbs added by Spark, projections in Arrow batches, and the measured covariance
of the whitened fit list by two aggregates. The driver holds d * d integers and
works some d**3 steps, whatever the number of rows.

Defined results: vectors that are null, empty or hold null or non-finite entries
take no part; neither do those of another length than most have (ties: the
longer). Rows repeated or sharing an id are rows of their own, a null id is kept.
A component without variance has no rows, so a table of equal vectors, of one
vector or of none gives none. Equal eigenvalues give orthonormal components of
their space. Entries beyond the range of a long stop at its ends; a deviation
beyond it is null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, written

#: Fixed values of the contract.
SCALE, COMPONENTS = 256, 4

#: Bits to which roots are refined, relative to the root.
ROOT_BITS = 128
#: Fraction bits of the inverse iteration.
FIXED_BITS = 448
_LIMB, _ROWS = 22, 512
_WORD = 32
_LONG = (1 << 63) - 1


# ------------------------------------------------------------ exact moments

def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the vectors that take part."""
    entries = F.col("embedding").cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select("vec_id", entries.alias("embedding")).where(
        F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0))
    length = (rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), F.desc("d")).limit(1).first())
    return rows.where(F.size("embedding") == (length["d"] if length else 0)).select(
        "vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles that add up to ``x`` with weights 2**(22 k), so small that their
    products over ``_ROWS`` rows are exact."""
    out = []
    while max(int(x.max(initial=0)), -int(x.min(initial=0))) >= 1 << _LIMB:
        out.append((x & ((1 << _LIMB) - 1)).astype(np.float64))
        x = x >> _LIMB
    return [*out, x.astype(np.float64)]


def _integers(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64).astype(object)


def sums_and_products(x: np.ndarray) -> np.ndarray:
    """Exact ``[1 x]' [1 x]`` of integer rows, as Python integers."""
    d = x.shape[1] + 1
    total = np.zeros((d, d), object)
    for lo in range(0, len(x), _ROWS):
        limbs = _limbs(np.column_stack([np.ones(len(x[lo:lo + _ROWS]), np.int64), x[lo:lo + _ROWS]]))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += _integers(a.T @ b) << (_LIMB * (i + j))
    return total


@dataclass(frozen=True)
class Moments:
    """Number, sums and ``C = n * M - S S'`` of the fit list."""
    n: int
    sums: list[int]
    scatter: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(self.scatter[i][i] for i in range(len(self.sums)))


def moments(fit: DataFrame) -> Moments:
    """Exact moments of the integer vectors ``x``: tasks send signed 32-bit
    limbs, which Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = sums_and_products(_matrix(batch.column("x")))
                total = here if total is None else total + here
        if total is not None:
            out = []
            for i in range(len(total)):
                for j in range(i, len(total)):
                    rest, k = int(total[i, j]), 0
                    while rest:
                        # the last limb keeps the sign
                        last = -(1 << (_WORD - 1)) <= rest < 1 << (_WORD - 1)
                        out.append((i, j, k, rest if last else rest & ((1 << _WORD) - 1)))
                        rest, k = (0 if last else rest >> _WORD), k + 1
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["i", "j", "k", "part"])

    d = fit.select(F.size("x").alias("d")).limit(1).first()
    d = d["d"] + 1 if d else 1
    m = [[0] * d for _ in range(d)]
    for r in (fit.mapInArrow(run, "i int, j int, k int, part long").groupBy("i", "j", "k")
              .agg(F.sum("part").alias("part")).collect()):
        m[r["i"]][r["j"]] += r["part"] << (_WORD * r["k"])
    n, sums = m[0][0], m[0][1:]
    scatter = [[n * m[min(i, j) + 1][max(i, j) + 1] - sums[i] * sums[j] for j in range(d - 1)] for i in range(d - 1)]
    return Moments(n, sums, scatter)


# ------------------------------------------------- characteristic polynomial

def _is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2**31."""
    if p % 2 == 0:
        return p == 2
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (0, 1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product exceeds ``bound``."""
    out, product, p = [], 1, 1 << 31
    while product <= bound:
        p -= 1
        if _is_prime(p):
            out.append(p)
            product *= p
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p``, without entries below the
    first subdiagonal."""
    a = a.copy()
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        r = k + 1 + below[0]
        a[[k + 1, r]] = a[[r, k + 1]]
        a[:, [k + 1, r]] = a[:, [r, k + 1]]
        f = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - f[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * f % p).sum(axis=1)) % p
    return a


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of ``det(t I - a)`` modulo ``p``."""
    h, d = hessenberg(a % p, p), len(a)
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    down = np.zeros(d, np.int64)  # products of subdiagonal entries from a column to the present one
    for k in range(d):
        if k:
            down[k - 1] = 1
            down[:k] = down[:k] * h[k, k - 1] % p
        step = -h[k, k] * poly[k]
        step[1:] += poly[k, :-1]
        weight = h[:k, k] * down[:k] % p
        poly[k + 1] = (step - (weight[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d]


def elementary(spark, m: Moments) -> list[int]:
    """``e_0 .. e_d``: the exact elementary symmetric functions of the
    eigenvalues of ``C``; its polynomial is the sum of (-1)**k e_k t**(d-k)."""
    d, trace = len(m.sums), m.trace
    bound = max(-(-comb(d, k) * trace ** k // d ** k) for k in range(d + 1))
    primes, scatter = primes_beyond(bound), m.scatter

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["p"].tolist():
                a = np.array([[c % p for c in row] for row in scatter], np.int64)
                yield pd.DataFrame({"p": [p], "residues": [polynomial_modulo(a, p).tolist()]})

    rows = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
            .mapInPandas(run, "p long, residues array<long>").collect())
    value, modulus = [0] * (d + 1), 1
    for r in sorted(rows, key=lambda r: r["p"]):
        inverse = pow(modulus, -1, r["p"])
        value = [v + modulus * ((c - v) * inverse % r["p"]) for v, c in zip(value, r["residues"])]
        modulus *= r["p"]
    e = [(-c if k % 2 else c) % modulus for k, c in enumerate(reversed(value))]
    if e[0] != 1 or e[1] != trace:
        raise ArithmeticError("the polynomial contradicts the trace")
    return e


# -------------------------------------------------------------------- roots

@dataclass(frozen=True)
class Root:
    """A root in (low, high] / 2**bits, with its multiplicity."""
    low: int
    high: int
    bits: int
    times: int

    @property
    def value(self) -> Fraction:
        return Fraction(self.low + self.high, 2 << self.bits)


def _scaled(e: list[int], bits: int) -> list[int]:
    """Coefficients, leading first, of the polynomial whose roots are those
    of ``e`` times 2**bits."""
    return [(-c if k % 2 else c) << (bits * k) for k, c in enumerate(e)]


def roots_beyond(e: list[int], point: int, bits: int) -> int:
    """How many roots exceed ``point / 2**bits``: the sign changes of the
    polynomial shifted there, as all of its roots are real."""
    a = _scaled(e, bits)
    for end in range(len(a), 1, -1):
        for k in range(1, end):
            a[k] += point * a[k - 1]
    signs = [c > 0 for c in a if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(e: list[int], point: int, bits: int) -> int:
    value = 0
    for c in _scaled(e, bits):
        value = value * point + c
    return (value > 0) - (value < 0)


def _refined(e: list[int], low: int, high: int, bits: int, rising: int) -> Root:
    """The one root in (low, high]; ``rising`` is the sign right of it."""
    while (high - low) << ROOT_BITS > high:
        if high - low == 1:
            low, high, bits = low << 16, high << 16, bits + 16
        mid = (low + high) // 2
        s = _sign(e, mid, bits)
        if s == 0:
            return Root(mid, mid, bits, 1)
        low, high = (low, mid) if s == rising else (mid, high)
    return Root(low, high, bits, 1)


def largest_roots(e: list[int], k: int) -> list[Root]:
    """The ``k`` largest positive roots (more, if the last is multiple)."""
    out: list[Root] = []
    beyond_zero = roots_beyond(e, 0, 0)
    pieces = [(0, e[1], 0, 0, beyond_zero)]  # (low, high], bits, roots beyond high, beyond low
    while pieces and sum(r.times for r in out) < k:
        low, high, bits, above, beyond = pieces.pop()
        inside = beyond - above
        if not inside:
            continue
        if inside == 1:
            # the sign at infinity is positive and changes at each root
            out.append(_refined(e, low, high, bits, -1 if above % 2 else 1))
        elif (high - low) << ROOT_BITS <= high:
            out.append(Root(low, high, bits, inside))
        else:
            if high - low == 1:
                low, high, bits = low << 16, high << 16, bits + 16
            mid = (low + high) // 2
            at_mid = roots_beyond(e, mid, bits)
            pieces += [(low, mid, bits, at_mid, beyond), (mid, high, bits, above, at_mid)]
    return out


# --------------------------------------------------------------- components

def _factored(scatter: list[list[int]], root: Root) -> tuple[np.ndarray, list[int]]:
    """Elimination of ``C - root`` with row choice, in fixed-point integers."""
    d, one = len(scatter), 1 << FIXED_BITS
    a = np.array(scatter, object).reshape(d, d) << FIXED_BITS
    shift = (root.low + root.high) * one // (2 << root.bits)
    for i in range(d):
        a[i, i] -= shift
    rows = list(range(d))
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            rows[k], rows[best] = rows[best], rows[k]
        a[k, k] = a[k, k] or 1  # an exact root: the least change that can be solved
        if k + 1 < d:
            f = (a[k + 1:, k] << FIXED_BITS) // a[k, k]
            a[k + 1:, k + 1:] -= (f[:, None] * a[k, k + 1:]) >> FIXED_BITS
            a[k + 1:, k] = f
    return a, rows


def _solved(a: np.ndarray, rows: list[int], v: np.ndarray) -> np.ndarray:
    y = v[rows].copy()
    for k in range(len(y) - 1):
        y[k + 1:] -= (a[k + 1:, k] * y[k]) >> FIXED_BITS
    for k in range(len(y) - 1, -1, -1):
        y[k] = (y[k] << FIXED_BITS) // a[k, k]
        y[:k] -= (a[:k, k] * y[k]) >> FIXED_BITS
    return y


def _unit(v: np.ndarray) -> np.ndarray:
    length = isqrt(int((v * v).sum())) or 1
    return (v << FIXED_BITS) // length


def null_vectors(scatter: list[list[int]], root: Root) -> list[np.ndarray]:
    """Orthonormal vectors, in fixed point, of the root's null space."""
    a, rows = _factored(scatter, root)
    rng = np.random.default_rng(len(scatter))
    out: list[np.ndarray] = []
    for _ in range(root.times):
        v = rng.integers(1 << 20, 1 << 21, len(scatter)).astype(object) << (FIXED_BITS - 20)
        for _ in range(3):
            v = _unit(_solved(a, rows, _unit(v)))
            for _ in range(2):
                for u in out:
                    v = v - ((u * ((u * v).sum() >> FIXED_BITS)) >> FIXED_BITS)
                v = _unit(v)
        out.append(v)
    return out


@dataclass(frozen=True)
class Components:
    """Unit vectors (rows) with their eigenvalues and shares of the trace."""
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def components_of(spark, m: Moments, k: int = COMPONENTS) -> Components:
    """The ``k`` components of most variance, without those that have none."""
    found: list[tuple[np.ndarray, Root]] = []
    if m.n and m.trace:
        for root in largest_roots(elementary(spark, m), k):
            found += [(v, root) for v in null_vectors(m.scatter, root)]
    found = found[:k]
    one, trace = 1 << FIXED_BITS, m.trace
    return Components(
        np.array([[float(Fraction(int(c), one)) for c in v] for v, _ in found]).reshape(len(found), len(m.sums)),
        np.array([float(r.value / (m.n * m.n)) for _, r in found]),
        np.array([float(r.value / trace) for _, r in found]))


# ------------------------------------------------------------------ results

def _projected(x: np.ndarray, m: Moments, c: Components) -> tuple[np.ndarray, list[int | None] | np.ndarray]:
    """Whitened coordinates of integer rows, and their exact deviations."""
    sums = np.array(m.sums, object)
    reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * m.n + max(map(abs, m.sums), default=0)
    if reach * reach * len(m.sums) <= _LONG:
        y = x * m.n - sums.astype(np.int64)
        far: list[int | None] | np.ndarray = (y * y).sum(axis=1)
        centred = y / m.n
    else:
        y = x.astype(object) * m.n - sums
        far = [s if s <= _LONG else None for s in (y * y).sum(axis=1).tolist()]
        centred = np.array([[float(Fraction(v, m.n)) for v in row] for row in y.tolist()]).reshape(x.shape)
    return centred @ c.vectors.T / np.sqrt(c.values), far


def _whitened_fit(fit: DataFrame, m: Moments, c: Components) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w, _ = _projected(_matrix(batch.column("x")), m, c)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(w.shape[1])],
                                                 [f"w{i}" for i in range(w.shape[1])])

    return fit.mapInArrow(run, ", ".join(f"w{i} double" for i in range(len(c.values))))


def identity_error(fit: DataFrame, m: Moments, c: Components) -> float:
    """Largest absolute entry of the whitened fit list's measured covariance,
    minus the identity."""
    w = written(_whitened_fit(fit, m, c))
    names = w.columns
    mean = w.agg(*[F.avg(x).alias(x) for x in names]).first()

    def centred(x: str) -> Column:
        return F.col(x) - F.lit(mean[x])

    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    got = w.agg(*[F.avg(centred(x) * centred(y)) for x, y in pairs]).first()
    return max(abs(v - (x == y)) for v, (x, y) in zip(got, pairs))


def whiten(embeddings: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)`` for every row that takes part and each component."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    rows = written(integer_vectors(embeddings, scale))
    fit = written(rows.select("x").distinct())
    m = moments(fit)
    c = components_of(spark, m, k)
    error = identity_error(fit, m, c) if len(c.values) else 0.0
    n, held = m.n, len(c.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not held:
                continue
            w, far = _projected(_matrix(batch.column("x")), m, c)
            each = np.repeat(np.arange(batch.num_rows), held)
            size = len(each)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)),
                 pa.array(np.tile(np.arange(1, held + 1, dtype=np.int32), batch.num_rows)),
                 pa.array(np.full(size, n, np.int64)), pa.array(far, pa.int64()).take(pa.array(each)),
                 pa.array(w.ravel()), pa.array(np.tile(c.explained, batch.num_rows)),
                 pa.array(np.full(size, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")


def op12_whitening(embeddings: DataFrame) -> DataFrame:
    """Contract columns: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    return whiten(embeddings)
