"""Vector functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null for vectors of different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def lexical_features(text: Column) -> Column:
    """Words between blanks with weight 2 and character 2- and 3-grams of each word with weight 1, as structs."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    grams = lambda n: F.flatten(F.transform(F.filter(words, lambda w: F.char_length(w) >= n), lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - (n - 1)), lambda i: F.substring(w, i, n))))
    weigh = lambda a, x: F.transform(a, lambda t: F.struct(t.alias("token"), F.lit(x).alias("weight")))
    return F.concat(weigh(words, 2.0), weigh(grams(2), 1.0), weigh(grams(3), 1.0))


def hashed_bucket(token: Column, dims: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def hashed_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
