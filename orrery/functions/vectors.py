"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def rounded(x: Column, places: int) -> Column:
    """x rounded as SQL does: what is negative stays so, down to -0.0."""
    return F.when(F.atan2(x, F.lit(-1.0)) < 0, -F.round(-x, places)).otherwise(F.round(x, places))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def complex_product(a: Column, b: Column) -> Column:
    """Products of complex numbers kept as (real half, imaginary half)."""
    n = F.size(a).cast("int")
    half = (n / 2).cast("int")
    index = F.sequence(F.lit(0), half - 1)
    re = F.transform(index, lambda i: F.get(a, i) * F.get(b, i) - F.get(a, i + half) * F.get(b, i + half))
    im = F.transform(index, lambda i: F.get(a, i) * F.get(b, i + half) + F.get(a, i + half) * F.get(b, i))
    return F.concat(re, im)


def hermitian(h: Column, r: Column, t: Column) -> Column:
    """Real part of sum h r conj(t) (ComplEx)."""
    return dot(complex_product(h, r), t)


def givens(rotation: Column, x: Column) -> Column:
    """Rotate pairs (x0, x1), (x2, x3), ... by the normalised pairs of ``rotation`` (RotE)."""
    pairs = F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1)

    def turn(i: Column) -> Column:
        c, s = F.get(rotation, 2 * i), F.get(rotation, 2 * i + 1)
        n = F.greatest(F.sqrt(c * c + s * s), F.lit(1e-15))
        a, b = F.get(x, 2 * i), F.get(x, 2 * i + 1)
        return F.array((c * a - s * b) / n, (s * a + c * b) / n)

    return F.flatten(F.transform(pairs, turn))


def givens_reflection(mirror: Column, x: Column) -> Column:
    """Reflect pairs of ``x`` by the normalised pairs of ``mirror`` (RefE)."""
    pairs = F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1)

    def turn(i: Column) -> Column:
        c, s = F.get(mirror, 2 * i), F.get(mirror, 2 * i + 1)
        n = F.greatest(F.sqrt(c * c + s * s), F.lit(1e-15))
        a, b = F.get(x, 2 * i), F.get(x, 2 * i + 1)
        return F.array((c * a + s * b) / n, (s * a - c * b) / n)

    return F.flatten(F.transform(pairs, turn))


def attended(candidates: list[Column], context: Column) -> Column:
    """Candidates summed by the softmax of their scaled products with a context (AttE, AttH, GIE)."""

    def weighed(s: Column) -> Column:
        names = [f"c{i}" for i in range(len(candidates))]
        scale = F.sqrt(F.size(s["x"]).cast("double"))
        logits = F.array(*[dot(s["x"], s[n]) / scale for n in names])
        return let(
            F.struct(s.alias("s"), let(logits, lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a)))).alias("e")),
            lambda t: let(
                total(t["e"]),
                lambda z: F.transform(
                    F.sequence(F.lit(0), F.size(t["s"]["x"]) - 1),
                    lambda i: sum((F.get(t["s"][n], i) * F.get(t["e"], k) for k, n in enumerate(names)), F.lit(0.0)) / z,
                ),
            ),
        )

    return let(F.struct(context.alias("x"), *[c.alias(f"c{i}") for i, c in enumerate(candidates)]), weighed)


def unit_phases(r: Column) -> Column:
    """Complex numbers (real half, imaginary half) scaled to modulus 1 (RotatE)."""
    half = (F.size(r) / 2).cast("int")
    index = F.sequence(F.lit(0), half - 1)
    size = lambda i: F.sqrt(F.get(r, i) * F.get(r, i) + F.get(r, i + half) * F.get(r, i + half))
    return F.concat(F.transform(index, lambda i: F.get(r, i) / size(i)), F.transform(index, lambda i: F.get(r, i + half) / size(i)))


def moduli(v: Column) -> Column:
    """Sizes of complex numbers kept as (real half, imaginary half)."""
    half = (F.size(v) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.sqrt(F.get(v, i) * F.get(v, i) + F.get(v, i + half) * F.get(v, i + half)))


def projected(x: Column, c: float) -> Column:
    """A point pulled back into the Poincare ball of curvature c if it lies too close to its border or beyond."""
    most = (1 - 1e-5) / c**0.5

    def pull(v: Column) -> Column:
        return let(F.greatest(norm(v), F.lit(1e-15)), lambda n: F.when(n > most, F.transform(v, lambda e: e / n * most)).otherwise(v))

    return let(x, pull)


def off_plane(x: Column, w: Column) -> Column:
    """What is left of x without its part along the normal w (HyTE)."""

    def off(s: Column) -> Column:
        k = dot(s["x"], s["w"]) / dot(s["w"], s["w"])
        return let(F.struct(s.alias("s"), k.alias("k")), lambda t: F.zip_with(t["s"]["x"], t["s"]["w"], lambda a, b: a - t["k"] * b))

    return let(F.struct(x.alias("x"), w.alias("w")), off)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def exp_map_zero(u: Column, c: float) -> Column:
    """Exponential map at the origin of the Poincare ball of curvature c."""

    def at(w: Column) -> Column:
        return let(
            F.greatest(norm(w), F.lit(1e-15)) * c**0.5, lambda n: let(F.tanh(n) / n, lambda k: F.transform(w, lambda x: x * k))
        )

    return let(u, at)


def mobius_add(x: Column, y: Column, c: float) -> Column:
    def add(s: Column) -> Column:
        p, q = s["x"], s["y"]
        parts = F.struct(dot(p, q).alias("xy"), dot(p, p).alias("xx"), dot(q, q).alias("yy"))

        def mixed(m: Column) -> Column:
            a = 1 + 2 * c * m["xy"] + c * m["yy"]
            b = 1 - c * m["xx"]
            d = F.greatest(1 + 2 * c * m["xy"] + c * c * m["xx"] * m["yy"], F.lit(1e-15))
            return F.zip_with(p, q, lambda i, j: (a * i + b * j) / d)

        return let(parts, mixed)

    return let(F.struct(x.alias("x"), y.alias("y")), add)


def hyperbolic_distance(x: Column, y: Column, c: float) -> Column:
    n = let(mobius_add(F.transform(x, lambda v: -v), y, c), norm)
    return F.lit(2 / c**0.5) * F.atanh(F.least(F.lit(c**0.5) * n, F.lit(1 - 1e-5)))
