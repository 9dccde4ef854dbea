"""Column functions over feature vectors (arrays of doubles), all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def clip(x: Column, low: float = -2.0, high: float = 2.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def reverse_bits(x: Column, bits: int = 8) -> Column:
    """The whole number whose binary digits, `bits` of them, are those of x backwards."""
    return F.conv(F.reverse(F.lpad(F.bin(x.cast("long")), bits, "0")), 2, 10).cast("long")


def wrapped_difference(a: Column, b: Column, modulus: int = 256) -> Column:
    """a - b as unsigned bytes subtract."""
    return F.pmod(a - b, F.lit(modulus))


def soft_target(distances: Column, alpha: float = 5.0, tiny: float = 1e-15) -> Column:
    """Shares that fall off exponentially with the distance relative to the least one."""
    raised = F.transform(distances, lambda d: F.exp(-d / (F.array_min(distances) + tiny) * alpha))
    return F.transform(raised, lambda e: e / total(raised))


def normalize_shifted(a: Column) -> Column:
    """Shift the least element to 0, then scale the sum to 1."""
    shifted = F.transform(a, lambda x: x - F.array_min(a))
    return F.transform(shifted, lambda x: x / total(shifted))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def magnitude(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of an RGB pixel; fixed weights."""
    return 0.2989 * r + 0.5870 * g + 0.1140 * b


def parse_ranges(text: Column) -> Column:
    """`0-2,5` as the array 0, 1, 2, 5."""
    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        return F.sequence(ends[0].cast("long"), F.element_at(ends, -1).cast("long"))

    return F.flatten(F.transform(F.split(text, ","), one))


def position_key(*parts: Column) -> Column:
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


def split_position_key(key: Column, names: tuple[str, ...] = ("k", "i", "j")) -> Column:
    parts = F.split(key, " ")
    return F.struct(*[parts[n].cast("long").alias(name) for n, name in enumerate(names)])


def power_mean_sum(values: list[Column], p: float = -1.0) -> Column:
    """(sum of x^p)^(-1/p); for p = -1 the reciprocal costs add up."""
    out = F.pow(values[0], F.lit(p))
    for v in values[1:]:
        out = out + F.pow(v, F.lit(p))
    return F.pow(out, F.lit(-1.0 / p))


def two_class_label(probabilities: Column, bins: int = 20) -> Column:
    """1 if the upper half of the bins weighs more than the lower half."""
    half = bins // 2
    return (total(F.slice(probabilities, half + 1, half)) > total(F.slice(probabilities, 1, half))).cast("int")


def sign_label(x: Column, negative: int = 0) -> Column:
    return F.when(x > 0, 1).otherwise(negative)


def arg_max(a: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def arg_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def root_abs_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.sqrt(F.abs(x)))


def std(a: Column) -> Column:
    """Population standard deviation of the elements."""
    return F.sqrt(total(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a)))) / F.size(a))


def subtract_mean(a: Column) -> Column:
    """Remove the row's own mean (its DC)."""
    return F.transform(a, lambda x: x - mean(a))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Index from 0 of the equal-width bin; the top value falls in the last bin, outside values at the ends."""
    raw = F.floor((x - low) / (high - low) * bins).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("long")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("double"))
