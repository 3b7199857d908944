"""Rules that rows must keep, as counts of those that don't. Null values keep every rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rules: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """of (the table), error and n for every rule that rows break; a rule is the condition that breaks it. One pass over each table."""
    out = []
    for of, (table, each) in rules.items():
        hits = F.filter(F.array(*[F.when(broken_, F.lit(name)) for name, broken_ in each.items()]), lambda x: x.isNotNull())
        out.append(table.select(F.lit(of).alias("of"), F.explode(hits).alias("error")).groupBy("of", "error").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionAll, out)


def repeated(keys: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """of, error and n (keys that several rows have) for every table with such keys."""
    out = []
    for of, (table, key) in keys.items():
        twice = table.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(F.lit(of).alias("of"), F.lit("key twice").alias("error"))
        out.append(twice.groupBy("of", "error").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionAll, out)
