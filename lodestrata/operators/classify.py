"""Structural patterns of tables: entity (SE), subtype (SH) or relation (SR), from the catalog's metadata frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.types import family_column


def _facts(columns: DataFrame, pks: DataFrame, fks: DataFrame) -> DataFrame:
    """A row for each table: its columns, key, foreign columns and foreign-key groups as arrays."""
    cols = columns.groupBy("table").agg(F.collect_set("column").alias("cols"), F.map_from_entries(F.collect_list(F.struct("column", family_column(F.col("sql_type"))))).alias("families"))
    keys = pks.groupBy("table").agg(F.array_sort(F.collect_set("column")).alias("pk"))
    groups = fks.groupBy("table", "constraint").agg(F.array_sort(F.collect_set("column")).alias("group"), F.bool_or((F.col("column") == "ID") & (F.col("ref_column") == "ID") & (F.col("ref_table") != F.col("table"))).alias("id_parent"))
    refs = groups.groupBy("table").agg(F.collect_list("group").alias("groups"), F.bool_or("id_parent").alias("id_parent"))
    empty = F.array().cast("array<string>")
    t = cols.join(keys, "table", "left").join(refs, "table", "left")
    t = t.select("table", "cols", "families", F.coalesce("pk", empty).alias("pk"), F.coalesce("groups", F.array().cast("array<array<string>>")).alias("groups"), F.coalesce("id_parent", F.lit(False)).alias("id_parent"))
    return t.withColumn("fk", F.array_distinct(F.flatten("groups")))


def _same(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _tests() -> dict[str, Column]:
    cols, pk, fk, groups = F.col("cols"), F.col("pk"), F.col("fk"), F.col("groups")
    other = F.array_except(cols, fk)
    two_with_one = (F.size(cols) == 2) & _same(pk, cols) & (F.size(groups) == 1) & (F.size(F.array_intersect(fk, pk)) == 1) & (F.size(other) == 1)
    # text, dates and booleans are literals; what may be an identifier is not
    literal = F.coalesce(F.col("families")[F.get(other, F.lit(0))].isin("text", "temporal", "boolean", "binary"), F.lit(False))
    full = (F.size(cols) > 0) & _same(fk, cols) & (F.size(groups) == 2) & ((F.size(pk) == 0) | (F.size(F.array_except(pk, fk)) == 0))
    whole = F.exists(groups, lambda g: _same(g, pk))
    return {
        "is_sh": (F.size(pk) > 0) & (whole | (F.array_contains(pk, "ID") & F.col("id_parent"))),
        "is_sr": full | (two_with_one & ~literal),
        "is_value_attr": two_with_one & literal,
        "is_key_only": (F.size(cols) >= 2) & _same(pk, cols) & (F.size(groups) == 0),
    }


def classify(columns: DataFrame, pks: DataFrame, fks: DataFrame) -> DataFrame:
    """table, pattern, value_attr, key_only, n_groups.  SH is tested before SR."""
    t = _facts(columns, pks, fks)
    tests = _tests()
    pattern = F.when(tests["is_sh"], "SH").when(tests["is_sr"], "SR").otherwise("SE")
    se = pattern == "SE"
    return t.select("table", pattern.alias("pattern"), (se & tests["is_value_attr"]).alias("value_attr"), (se & tests["is_key_only"]).alias("key_only"), F.size("groups").alias("n_groups"))


def inferred_relations(pks: DataFrame, fks: DataFrame) -> DataFrame:
    """Entity tables that are also a binary relation: exactly two complete scalar foreign keys inside the key; else nothing.

    table, and for both ends column, ref_table, ref_column in constraint order.
    """
    keys = pks.select("table", "column", F.lit(True).alias("_in"))
    rows = fks.join(keys, ["table", "column"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    end = F.struct("constraint", "column", "ref_table", "ref_column")
    groups = rows.groupBy("table", "constraint").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("column").alias("d"), F.min("arity").alias("lo"), F.max("arity").alias("hi"), F.bool_and("_in").alias("all_in"), F.bool_or("_in").alias("any_in"), F.min(end).alias("end"))
    complete = (F.col("n") == F.col("d")) & (F.col("lo") == F.col("hi")) & (F.col("n") == F.col("lo")) & (F.col("all_in") == F.col("any_in"))
    t = groups.groupBy("table").agg(F.bool_and(complete).alias("ok"), F.count_if("all_in").alias("inside"), F.max(F.when(F.col("all_in"), F.col("n"))).alias("widest"), F.array_sort(F.collect_list(F.when(F.col("all_in"), F.col("end")))).alias("ends"))
    t = t.where("ok and inside = 2 and widest = 1").where(F.col("ends")[0]["column"] != F.col("ends")[1]["column"])
    return t.select("table", *[F.col("ends")[i][f].alias(f"{f}_{i + 1}") for i in (0, 1) for f in ("column", "ref_table", "ref_column")])


def differing(rule: DataFrame, agent: DataFrame) -> DataFrame:
    """Tables whose two labels differ (one may be missing): table, rule, agent."""
    r, a = rule.select("table", F.col("pattern").alias("rule")), agent.select("table", F.col("pattern").alias("agent"))
    return r.join(a, "table", "full_outer").where(~F.col("rule").eqNullSafe(F.col("agent")))


def arbitrate(rule: DataFrame, agent: DataFrame, rates: DataFrame | None = None, counts: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """table, pattern, reason: rule labels, except where the other judge may win.

    ``rule`` as from ``classify``; ``agent``: table, pattern; ``rates``: table, match_rate (of the keys the agent infers,
    averaged); ``counts``: table, n_rows.  A structural SH or SR stays, and so does an SE that has physical keys.  Else an
    empty table goes to the agent, and a match rate of ``least`` or more does; without any foreign key in the schema the
    agent is believed throughout.
    """
    j = rule.select("table", F.col("pattern").alias("rule"), "n_groups").join(agent.select("table", F.col("pattern").alias("agent")), "table", "left")
    j = j.join(rates.groupBy("table").agg(F.avg("match_rate").alias("rate")), "table", "left") if rates is not None else j.withColumn("rate", F.lit(None).cast("double"))
    j = j.join(counts.select("table", "n_rows"), "table", "left") if counts is not None else j.withColumn("n_rows", F.lit(None).cast("long"))
    none = rule.agg((F.coalesce(F.sum("n_groups"), F.lit(0)) == 0).alias("_none"))
    j = j.join(F.broadcast(none), F.lit(True))
    differs = F.col("agent").isNotNull() & (F.col("agent") != F.col("rule"))
    locked = F.col("rule").isin("SH", "SR") | (F.col("n_groups") > 0)
    reason = F.when(~differs, "agree").when(F.col("_none"), "no_keys").when(locked, "structure").when(F.col("n_rows") == 0, "empty").when(F.coalesce("rate", F.lit(0.0)) >= least, "match_rate").otherwise("rule")
    return j.select("table", F.when(reason.isin("no_keys", "empty", "match_rate"), F.col("agent")).otherwise(F.col("rule")).alias("pattern"), reason.alias("reason"))


def with_agent(tables: DataFrame, judge: Callable[[str], str | None]) -> DataFrame:
    """Labels of a pluggable judge, asked once for each table of the schema."""
    rows = [(r["table"], judge(r["table"])) for r in tables.select("table").distinct().orderBy("table").collect()]  # a row for each table
    return tables.sparkSession.createDataFrame(rows, "table string, pattern string").where("pattern is not null")
