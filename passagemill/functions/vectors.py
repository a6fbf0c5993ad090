"""Vector operators as Column expressions, and bag-of-words embeddings that need no service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 1e-3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _over_norm(a: Column, kind: str) -> Column:
    """a / norm(a), the norm computed once a row and not once an element; null for a zero vector."""
    scaled = F.transform(F.array(norm(a)), lambda size: F.when(size > 0, F.transform(a, lambda x: (x.cast("double") / size).cast(kind))))
    return F.get(scaled, F.lit(0))


def normalize(a: Column) -> Column:
    """Unit length, 32-bit floats; null for a zero vector."""
    return _over_norm(a, "float")


def is_unit(a: Column, dimension: int, tolerance: float = NORM_TOLERANCE) -> Column:
    """Whether a stored vector has its build's dimension and unit length."""
    return F.coalesce((F.size(a) == dimension) & (F.abs(norm(a) - 1) <= tolerance), F.lit(False))


def word_bucket(word: Column, dimension: int) -> Column:
    """The place of a word in a hashed bag of words: first four bytes of its SHA-256, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(word.cast("binary"), 256), 1, 8), 16, 10).cast("long") % dimension).cast("int")


def bag_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
