"""Vector expressions over array columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def scaled(v: Column, by: Column) -> Column:
    return let(by, lambda b: F.transform(doubles(v), lambda x: x * b))


def normalised(v: Column) -> Column:
    return let(doubles(v), lambda d: let(norm(d), lambda size: F.when(size > 0, F.transform(d, lambda x: x / size)).otherwise(d)))


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    """Population variance, no scale and shift."""
    centred = let(total(doubles(v)) / F.size(v), lambda mean: F.transform(doubles(v), lambda x: x - mean))
    return let(centred, lambda c: let(F.sqrt(dot(c, c) / F.size(c) + epsilon), lambda spread: F.transform(c, lambda x: x / spread)))


def embedding_finish(v: Column, digits: int = 5) -> Column:
    """Layer norm, then unit length, then rounded."""
    return F.transform(normalised(layer_norm(v)), lambda x: F.round(x, digits))


def masked_mean(tokens: Column, mask: Column, width: int) -> Column:
    """Mean of token vectors under a 0/1 mask, divided by at least 1e-9."""
    zero = F.array_repeat(F.lit(0.0), width)
    pairs = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    sums = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, doubles(p["t"]), lambda x, y: x + y * p["m"]))
    return let(F.greatest(total(doubles(mask)), F.lit(1e-9)), lambda count: F.transform(sums, lambda x: x / count))


def clipped(v: Column, least: float = 1e-5) -> Column:
    return F.transform(doubles(v), lambda x: F.greatest(x, F.lit(least)))


def padded(v: Column, width: int) -> Column:
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), width)), 1, width)


def bpr_loss(margin: Column) -> Column:
    """-log(sigmoid(x)), stable for large negative x."""
    return F.when(margin >= 0, F.log1p(F.exp(-margin))).otherwise(-margin + F.log1p(F.exp(margin)))


def mean_by_position(v: Column, width: int) -> Column:
    """Aggregate: element-wise mean of vectors; one partial sum per position combines before the shuffle."""
    return F.array(*[F.avg(F.get(doubles(v), F.lit(i))) for i in range(width)])


def portable_hash(*parts: str | int | Column) -> Column:
    """60 bits of the md5 of the parts, joined by colons: any engine with md5 can repeat it."""
    joined = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def normals(key: Column, width: int, seed: int = 42) -> Column:
    """`width` values of N(0, 1) that depend on key and seed alone: two for each md5, by Box and Muller's transform of two 52-bit numbers."""
    share = lambda h, at: (F.conv(F.substring(h, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    digest = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")))
    radius, angle = lambda h: F.sqrt(-2 * F.log(share(h, 1))), lambda h: 2 * F.pi() * share(h, 14)
    pair = lambda i: let(digest(i), lambda h: F.array(radius(h) * F.cos(angle(h)), radius(h) * F.sin(angle(h))))
    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((width - 1) // 2)), pair)), 1, width)


def sum_by_position(v: Column | str, width: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise sum of (weighted) vectors; one partial sum per position combines before the shuffle. By a column's name it is built in one call."""
    if isinstance(v, str) and weight is None:
        return F.expr(f"array({', '.join(f'sum(get(`{v}`, {i}))' for i in range(width))})")
    at = [F.get(v, F.lit(i)) for i in range(width)]
    return F.array(*[F.sum(x if weight is None else x * weight) for x in at])
