"""Distances and vector projections as column expressions on array<float>.

They run inside Catalyst as higher-order functions: readable, and the check on the Arrow kernels, which are faster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def l2sq(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def ip(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def l1(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - ip(a, b) / scale))


def partial_l2sq(a: Column, b: Column, start: int, dims: int) -> Column:
    """Squared L2 over `dims` dimensions from `start` (from 0)."""
    return l2sq(F.slice(a, start + 1, dims), F.slice(b, start + 1, dims))


def l2sq_codes(a: Column, b: Column) -> Column:
    """Squared L2 of 8-bit codes, exact integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda total, x: total + x)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def flip_signs(a: Column, signs: Column) -> Column:
    return F.zip_with(a, signs, lambda x, s: x * s)


def quantize(a: Column, base: Column | float, scale: Column | float) -> Column:
    """8-bit codes: (x - base) * scale, rounded half away from zero and clamped to 0..255."""
    base, scale = (x if isinstance(x, Column) else F.lit(x) for x in (base, scale))
    return F.transform(a, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((x.cast("double") - base) * scale))).cast("smallint"))


def dequantize(code: Column, base: Column | float, scale: Column | float) -> Column:
    base, scale = (x if isinstance(x, Column) else F.lit(x) for x in (base, scale))
    return F.transform(code, lambda x: x / scale + base)


DISTANCES = {"l2sq": l2sq, "l1": l1, "cosine": cosine_distance, "ip": ip}


def valid(embedding: Column, dimensions: int) -> Column:
    """True for a vector of the right width without null or NaN."""
    return embedding.isNotNull() & (F.size(embedding) == dimensions) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x))


#: Vectors of up to so many components are compared in compiled code, component by component; longer code isn't compiled.
UNROLLED = 64


def _sum_text(terms: list[str]) -> str:
    """A sum in pairs, so that additions needn't wait for each other."""
    while len(terms) > 1:
        terms = [f"({' + '.join(terms[i : i + 2])})" for i in range(0, len(terms), 2)]
    return terms[0]


def _norm_text(v: str) -> str:
    return f"sqrt(aggregate(transform({v}, x -> CAST(x AS DOUBLE) * x), 0D, (t, x) -> t + x))"


def distance_text(metric: str, a: str, b: str) -> str:
    """SQL of a distance of two arrays."""
    total = f"aggregate(zip_with({a}, {b}, (x, y) -> %s), 0D, (t, x) -> t + x)"
    if metric == "cosine":
        scale = f"({_norm_text(a)} * {_norm_text(b)})"
        return f"CASE WHEN {scale} = 0 THEN 1D ELSE greatest(0D, 1 - {distance_text('ip', a, b)} / {scale}) END"
    one = {"l2sq": "(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)", "ip": "CAST(x AS DOUBLE) * y", "l1": "abs(CAST(x AS DOUBLE) - y)"}
    return total % one[metric]


def parts_text(embedding: str, name: str, width: int) -> list[str]:
    """SQL columns of a vector for key_text(): its components (NaN where there is none) and its length."""
    parts = [f"coalesce(CAST(get({embedding}, {i}) AS DOUBLE), double('NaN'))" for i in range(width if width <= UNROLLED else 0)]
    if parts:
        parts[0] = f"CASE WHEN size({embedding}) > {width} THEN raise_error('vectors must have {width} components') ELSE {parts[0]} END"
    return [*(f"{x} AS {name}{i}" for i, x in enumerate(parts)), f"coalesce({_norm_text(embedding)}, double('NaN')) AS {name}_norm"]


def key_text(metric: str, width: int) -> tuple[str, str]:
    """SQL of a key that is less for what is nearer, from parts_text() of q and e: the least and the most that it can be, as sums
    here are in another order than those of distance_text(). Beyond UNROLLED components from the arrays query and embedding."""
    if 0 < width <= UNROLLED:
        one = "abs(q{0} - e{0})" if metric == "l1" else "q{0} * e{0}"
        total = _sum_text([one.format(i) for i in range(width)])
    else:
        total = distance_text("l1" if metric == "l1" else "ip", "query", "embedding")
    if metric == "cosine":
        key, slack = f"CASE WHEN q_norm * e_norm = 0 THEN 1D ELSE greatest(0D, 1 - {total} / (q_norm * e_norm)) END", "1e-12"
    elif metric == "l2sq":
        squares = "(q_norm * q_norm + e_norm * e_norm)"
        key, slack = f"{squares} - 2 * {total}", f"{squares} * 1e-12"
    else:
        key, slack = (f"0 - {total}", "q_norm * e_norm * 1e-12") if metric == "ip" else (total, "(q_norm + e_norm) * 1e-11")
    return f"({key} - {slack})", f"({key} + {slack})"


#: Bits of a field of a packed code.
FIELD = 21


def most_code(width: int) -> int:
    return math.isqrt(((1 << FIELD) - 1) // (3 * -(-width // 3)))


def packed_text(embedding: str, width: int, low: float, step: float, turned: bool) -> tuple[str, list[str]]:
    """SQL of a vector's codes, (x - low) / step in whole numbers from 0 to a most, and SQL columns over `codes`: three codes to a
    long, the sum of their squares, and how far the vector is from its codes, in steps and rounded up.

    The product of a long and one that is `turned` has the sum of the three products of codes in its third field; the most code is
    such that no field of a sum of such products overflows. What is beyond the third field is lost, as longs wrap around."""
    longs, most = -(-width // 3), most_code(width)
    place = f"((CAST(x AS DOUBLE) - ({low!r}D)) / {step!r}D)"
    codes = f"transform({embedding}, x -> CAST(greatest(0D, least({most}D, rint({place}))) AS BIGINT))"
    code = [f"coalesce(get(codes, {i}), 0L)" for i in range(3 * longs)]
    columns = []
    for i in range(0, 3 * longs, 3):
        one, two, three = reversed(code[i : i + 3]) if turned else code[i : i + 3]
        columns.append(f"{one} + shiftleft({two}, {FIELD}) + shiftleft({three}, {2 * FIELD})")
    squares = "aggregate(codes, 0L, (t, c) -> t + c * c)"
    off = f"1e-6D + 1.000001D * sqrt(aggregate(zip_with({embedding}, codes, (x, c) -> ({place} - c) * ({place} - c)), 0D, (t, y) -> t + y))"
    return codes, [*columns, f"coalesce({squares}, 0L)", f"coalesce({off}, double('Infinity'))"]


def packed_l2sq_text(width: int) -> str:
    """SQL of the squared L2 of codes, in steps, from columns q0.., q_squares and e0.., e_squares; longs must wrap around."""
    total = _sum_text([f"q{i} * e{i}" for i in range(-(-width // 3))])
    return f"(q_squares + e_squares - 2L * (shiftrightunsigned({total}, {2 * FIELD}) & {(1 << FIELD) - 1}L))"


def register(spark: SparkSession) -> None:
    """SQL functions l2sq(a, b), ip(a, b), l1(a, b), cosine_distance(a, b), as session SQL functions over built-ins."""
    for metric in DISTANCES:
        name = {"cosine": "cosine_distance"}.get(metric, metric)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {distance_text(metric, 'a', 'b')}")
