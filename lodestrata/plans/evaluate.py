"""Answers against gold answers: multiset precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tally(df: DataFrame, name: str) -> DataFrame:
    row: Column = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    return df.groupBy(row.alias("row")).agg(F.count(F.lit(1)).alias(name))


def score(answer: DataFrame, gold: DataFrame) -> DataFrame:
    """matched, answered, expected, precision, recall, f1; columns are compared by position, rows as a bag."""
    both = _tally(answer, "a").join(_tally(gold, "g"), "row", "full_outer")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = both.agg(zero(F.least(F.coalesce("a", F.lit(0)), F.coalesce("g", F.lit(0)))).alias("matched"), zero("a").alias("answered"), zero("g").alias("expected"))
    # nothing expected and nothing answered is right
    part = lambda c: F.when((F.col("answered") == 0) & (F.col("expected") == 0), 1.0).otherwise(F.coalesce(F.try_divide("matched", c), F.lit(0.0)))
    t = t.withColumn("precision", part("answered")).withColumn("recall", part("expected"))
    return t.withColumn("f1", F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")), F.lit(0.0)))


def means(per_query: DataFrame) -> DataFrame:
    """Unweighted over queries."""
    return per_query.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("n_queries"))
