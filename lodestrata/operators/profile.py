"""Profiles of tables: counts, distinct values, samples, enumerated columns.

One scan serves all columns asked for; samples are ordered by key or hash, so they repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.iri import is_absolute


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: table, n_rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def non_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: column, n_rows, n_values; one scan."""
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_values")) for i, c in enumerate(columns)])
    return totals.select("n_rows", F.explode(pairs).alias("x")).select("x.column", "n_rows", "x.n_values")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Raw values that aren't null."""
    return df.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()


def trimmed_values(df: DataFrame, column: str) -> DataFrame:
    """As text, trimmed, without empty ones."""
    return df.select(F.trim(F.col(f"`{column}`").cast("string")).alias("value")).where("value <> ''").distinct()


def sample_rows(df: DataFrame, key: list[str], limit: int = 5) -> DataFrame:
    return df.orderBy(*key).limit(limit)


def enum_profile(df: DataFrame, column: str, max_values: int = 20) -> DataFrame:
    """value, n and complete: the first values in order, and whether there are no more than ``max_values``."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(max_values + 1)  # a report: one more than is shown
    numbered = first.withColumn("_i", F.row_number().over(Window.orderBy("value"))).withColumn("_n", F.max("_i").over(Window.partitionBy(F.lit(1))))
    return numbered.where(F.col("_i") <= max_values).select("value", "n", (F.col("_n") <= max_values).alias("complete"))


def enum_samples(df: DataFrame, column: str, key: str, per_value: int = 8, max_values: int = 20) -> DataFrame:
    """Up to ``per_value`` rows of each listed value, the same at every run.

    Only the values of the profile are looked at.  The best rows by a hash of the key are found by partial top-k
    aggregation, so a frequent value doesn't meet in one task.
    """
    listed = enum_profile(df, column, max_values).select(F.col("value").alias("_value"))
    order = F.struct(F.md5(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"))
    rows = df.select(F.col(column).cast("string").alias("value"), order.alias("o")).join(F.broadcast(listed), F.col("value") == F.col("_value"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("o.k"), F.lit(64)))
    best = salted.withColumn("_r", F.row_number().over(Window.partitionBy("value", "_salt").orderBy("o"))).where(F.col("_r") <= per_value)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("value").orderBy("o"))).where(F.col("rank") <= per_value)
    return ranked.select("value", F.col("o.k").alias(key), "rank")


def enum_diagnostics(df: DataFrame, columns: list[str], per_value: int = 8) -> DataFrame:
    """For each column: distinct, short_ratio, numeric_ratio, repeated_ratio and likely_enum, from its distinct values and how many rows a sample of ``per_value`` each would hold."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")
    counts = df.select(cells).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    short = ((F.length("value") <= 16) & ~F.contains("value", F.lit(" "))).cast("int")
    digits = F.col("value").rlike(r"^-?\d+$").cast("int")
    out = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum(F.least("n", F.lit(per_value))).alias("sample_rows"), F.sum(short).alias("short"), F.sum(digits).alias("digits"))
    ratio = lambda a, b: F.col(a) / F.col(b)
    spread = F.col("distinct") / F.greatest("sample_rows", "distinct")
    likely = F.col("distinct").between(2, 30) & (ratio("short", "distinct") >= 0.8) & ((ratio("digits", "distinct") >= 0.4) | ((spread <= 0.75) & (F.col("distinct") <= 10)))
    return out.select("column", "distinct", F.round(ratio("short", "distinct"), 4).alias("short_ratio"), F.round(ratio("digits", "distinct"), 4).alias("numeric_ratio"), F.round(F.greatest(F.lit(0.0), 1 - spread), 4).alias("repeated_ratio"), likely.alias("likely_enum"))


def iri_ratio(df: DataFrame, columns: list[str], threshold: float = 0.9) -> DataFrame:
    """For each column: distinct values (trimmed), the share of absolute IRIs among them, and whether it is an IRI column."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])).alias("x")
    values = df.select(cells).select("x.*").where("value <> ''").distinct()
    out = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum(is_absolute(F.col("value")).cast("int")).alias("iris"))
    share = F.col("iris") / F.col("distinct")
    return out.select("column", "distinct", "iris", F.round(share, 4).alias("ratio"), (share >= threshold).alias("is_iri"))


def counts_by_value(df: DataFrame, column: str, counted: list[str], key: str | None = None) -> DataFrame:
    """value (as text), rows, non-null values of each counted column, and distinct keys."""
    more: list[Column] = [F.count(f"`{c}`").alias(f"n_{c}") for c in counted]
    if key:
        more.append(F.count_distinct(f"`{key}`").alias("n_keys"))
    return df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), *more)
