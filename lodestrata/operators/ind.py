"""Inclusion dependencies, overlaps and match rates.

All pairs of columns are probed in one pass: every distinct (type, value) meets the set of its columns, and containment
counts come from the pairs in these sets.  The sets hold columns, not rows: their size is bounded by the schema.  Two
shuffles, one on values (distinct values only leave the scan) and one on column pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.names import AMBIGUOUS_COLUMNS
from lodestrata.functions.types import IND_EXCLUDED_COLUMNS, IND_EXCLUDED_TYPES
from lodestrata.operators.profile import trimmed_values
from lodestrata.sources.catalog import Catalog, ForeignKey

THRESHOLD = 0.95
_NESTED = ("array", "map", "struct", "binary")


def targets_and_sources(catalog: Catalog) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(table, column, type) of the single-column keys, and of the columns that may reference them."""
    targets = [(t, k[0], catalog.types(t)[k[0]]) for t, k in sorted(catalog.primary_keys.items()) if len(k) == 1]
    known = {(k.table, c) for k in catalog.foreign_keys for c in k.columns}
    sources = [
        (t, c, kind)
        for t in catalog.names()
        for c, kind in catalog.types(t).items()
        if (t, c) not in known and c.lower() not in IND_EXCLUDED_COLUMNS and kind not in IND_EXCLUDED_TYPES and not kind.startswith(_NESTED)
    ]
    return targets, sources


def _values(catalog: Catalog, columns: set[tuple[str, str, str]]) -> DataFrame:
    """Distinct (type, value, table, column): one scan for each table, whatever the number of its columns."""
    parts = []
    for table in sorted({t for t, _, _ in columns}):
        own = sorted((c, k) for t, c, k in columns if t == table)
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(c).alias("column")) for c, k in own]))
        parts.append(catalog.tables[table].select(cells.alias("x")).select("x.type", "x.value", F.lit(table).alias("table"), "x.column").where("value is not null"))
    return reduce(DataFrame.unionByName, parts).distinct()


def all_pairs_ind(catalog: Catalog, targets: list[tuple[str, str, str]] | None = None, sources: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """table, column, ref_table, ref_column, n_source, n_target, n_common, score for every source and target of equal type that share a value."""
    known_targets, known_sources = targets_and_sources(catalog)
    targets, sources = targets if targets is not None else known_targets, sources if sources is not None else known_sources
    kinds = {k for _, _, k in targets}
    sources = [s for s in sources if s[2] in kinds]
    spark = next(iter(catalog.tables.values())).sparkSession
    if not targets or not sources:
        return spark.createDataFrame([], "table string, column string, ref_table string, ref_column string, n_source long, n_target long, n_common long, score double")
    numbers = {c: i for i, c in enumerate(sorted({*targets, *sources}))}
    ids = F.broadcast(spark.createDataFrame([(t, c, i, (t, c, k) in set(targets), (t, c, k) in set(sources)) for (t, c, k), i in numbers.items()], "table string, column string, id int, is_target boolean, is_source boolean"))  # a row for each column of the schema
    tagged = _values(catalog, set(numbers)).join(ids, ["table", "column"])
    sets = tagged.groupBy("type", "value").agg(F.collect_set(F.when(F.col("is_source"), F.col("id"))).alias("s"), F.collect_set(F.when(F.col("is_target"), F.col("id"))).alias("t"))
    patterns = sets.groupBy(F.array_sort("s").alias("s"), F.array_sort("t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    sized_s = patterns.select(F.explode("s").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n_source"))
    sized_t = patterns.select(F.explode("t").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n_target"))
    common = patterns.select(F.explode("s").alias("source"), "t", "n").select("source", F.explode("t").alias("target"), "n").where("source <> target").groupBy("source", "target").agg(F.sum("n").alias("n_common"))
    a, b = ids.select(F.col("id").alias("source"), "table", "column"), ids.select(F.col("id").alias("target"), F.col("table").alias("ref_table"), F.col("column").alias("ref_column"))
    out = common.join(F.broadcast(sized_s.withColumnRenamed("id", "source")), "source").join(F.broadcast(sized_t.withColumnRenamed("id", "target")), "target").join(F.broadcast(a), "source").join(F.broadcast(b), "target")
    return out.select("table", "column", "ref_table", "ref_column", "n_source", "n_target", "n_common", (F.col("n_common") / F.col("n_source")).alias("score"))


def _first() -> list[Column]:
    return [F.desc("score"), F.asc("n_target"), F.asc("ref_table"), F.asc("ref_column")]


def ranked(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Dependencies that hold, with their rank for the source column: score first, then the smaller target."""
    per = Window.partitionBy("table", "column").orderBy(*_first())
    return scores.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(per))


def best_target(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return ranked(scores, threshold).where("rank = 1").drop("rank")


def nearest_targets(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All targets of the least size, for each source column."""
    per = Window.partitionBy("table", "column").orderBy("n_target")
    return scores.where(F.col("score") >= threshold).withColumn("_r", F.rank().over(per)).where("_r = 1").drop("_r")


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """How many dependencies and source columns there are at each threshold: all thresholds in one job."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    held = scores.select("*", levels).where(F.col("score") >= F.col("threshold"))
    return held.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("table", "column").alias("n_columns"))


def overlap(source: DataFrame, source_column: str, target: DataFrame, target_column: str) -> DataFrame:
    """One row: distinct counts of the trimmed values, intersection, union, both containments, Jaccard, and the kind of evidence."""
    a = trimmed_values(source, source_column).select("value", F.lit(1).alias("a"))
    b = trimmed_values(target, target_column).select("value", F.lit(1).alias("b"))
    counts = a.join(b, "value", "full_outer").agg(F.count("a").alias("source_distinct"), F.count("b").alias("target_distinct"), F.count(F.col("a") + F.col("b")).alias("intersection"), F.count(F.lit(1)).alias("union"))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    rated = counts.withColumn("source_in_target", share("intersection", "source_distinct")).withColumn("target_in_source", share("intersection", "target_distinct")).withColumn("jaccard", share("intersection", "union"))
    kind = (
        F.when((F.col("source_in_target") >= 0.95) & (F.col("target_in_source") >= 0.95), "equivalence_column")
        .when(F.col("source_in_target") >= 0.95, "inclusion_column_source_to_target")
        .when(F.col("jaccard") >= 0.8, "high_overlap_column")
        .otherwise("weak_overlap")
    )
    return rated.withColumn("evidence_type", kind)


def match_rates(catalog: Catalog, keys: list[ForeignKey]) -> DataFrame:
    """For each key: joined rows (a repeated target value counts each time), those with a match, and their share (0 if empty)."""
    parts = []
    for k in keys:
        left = catalog.tables[k.table].select(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(k.columns)])
        right = catalog.tables[k.ref_table].select(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(k.ref_columns)])
        # repeated targets are folded into a count before the join: same numbers, no fan-out
        folded = right.groupBy(*right.columns).agg(F.count(F.lit(1)).alias("m"))
        joined = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("n")).join(folded, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(k.columns))], "left")
        one = joined.agg(F.coalesce(F.sum(F.col("n") * F.coalesce("m", F.lit(1))), F.lit(0)).alias("n_joined"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n_matched"))
        parts.append(one.select(F.lit(k.table).alias("table"), F.lit(",".join(k.columns)).alias("columns"), F.lit(k.ref_table).alias("ref_table"), F.lit(",".join(k.ref_columns)).alias("ref_columns"), "n_joined", "n_matched"))
    rated = reduce(DataFrame.unionByName, parts)
    return rated.withColumn("match_rate", F.coalesce(F.try_divide("n_matched", "n_joined"), F.lit(0.0)))


def related_name(column: Column, table: Column) -> Column:
    """Generic column names (type, status, ...) must share a substring with the table; other names pass."""
    c, t = F.replace(F.lower(column), F.lit("_"), F.lit("")), F.replace(F.lower(table), F.lit("_"), F.lit(""))
    vague = reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in AMBIGUOUS_COLUMNS])
    return ~vague | F.contains(c, t) | F.contains(t, c)


def mergeable(found: DataFrame, known: DataFrame) -> DataFrame:
    """Discovered keys that may be added: not on a column that has one, not to the table itself, and not on a vague name."""
    new = found.join(known.select("table", "column").distinct(), ["table", "column"], "left_anti")
    return new.where((F.col("table") != F.col("ref_table")) & related_name(F.col("column"), F.col("ref_table")))


def drop_reciprocal(found: DataFrame, child_of: DataFrame) -> DataFrame:
    """Of ID -> ID in both directions, the one from parent to child goes; ``child_of``: child, parent (by table)."""
    both = found.where("column = 'ID' and ref_column = 'ID'").select(F.col("table").alias("ref_table"), F.col("ref_table").alias("table"))
    upward = child_of.select(F.col("parent").alias("table"), F.col("child").alias("ref_table"))
    wrong = both.join(upward, ["table", "ref_table"], "left_semi").withColumn("column", F.lit("ID")).withColumn("ref_column", F.lit("ID"))
    return found.join(wrong, ["table", "column", "ref_table", "ref_column"], "left_anti")


def discovered_keys(merged: DataFrame) -> list[ForeignKey]:
    """As catalog entries; a row for each key of the schema."""
    return [ForeignKey(r["table"], (r["column"],), r["ref_table"], (r["ref_column"],), source="IND") for r in merged.orderBy("table", "column", "ref_table").collect()]


def recovery(predicted: DataFrame, declared: DataFrame) -> DataFrame:
    """matched, missing, unmatched, precision, recall and f1 of predicted keys (table, column, ref_table, ref_column)."""
    on = ["table", "column", "ref_table", "ref_column"]
    p, d = predicted.select(*on).distinct().withColumn("p", F.lit(1)), declared.select(*on).distinct().withColumn("d", F.lit(1))
    c = p.join(d, on, "full_outer").agg(F.count(F.col("p") + F.col("d")).alias("matched"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("unmatched"))
    rate = lambda other: F.coalesce(F.try_divide("matched", F.col("matched") + F.col(other)), F.lit(0.0))
    c = c.withColumn("precision", rate("unmatched")).withColumn("recall", rate("missing"))
    return c.withColumn("f1", F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")), F.lit(0.0)))
