"""Evidence grouped by the values of a discriminator column.

The tables that a value's rows refer to, or that refer to them, are reduced to distinct keys and joined once as a flag;
one aggregation by value then counts all values, and a relation costs one join whatever the number of values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.names import alphanumeric, jaccard, semantic_tokens, truth


def _flagged(df: DataFrame, columns: list[str], keys: DataFrame, key_columns: list[str], flag: str, as_text: bool = False) -> DataFrame:
    """``df`` with a boolean: its columns (none null) are among the keys."""
    kind = (lambda c: c.cast("string")) if as_text else (lambda c: c)
    there = keys.select(*[kind(F.col(f"`{k}`")).alias(f"_k{i}") for i, k in enumerate(key_columns)]).dropna().distinct().withColumn(flag, F.lit(True))
    on = [kind(df[f"`{c}`"]) == there[f"_k{i}"] for i, c in enumerate(columns)]
    return df.join(there, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop(*[f"_k{i}" for i in range(len(columns))])


def _ratio(part: str, whole: str) -> Column:
    return F.round(F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)), 4)


def coverage_outgoing(df: DataFrame, key: str, value_column: str, fk: str, target: DataFrame, target_key: str) -> DataFrame:
    """value, total, covered, ratio: of the distinct keys with the value, those whose foreign key leads to a row."""
    flagged = _flagged(df.select(key, value_column, fk), [fk], target, [target_key], "_hit")
    return _coverage(flagged, key, value_column)


def coverage_incoming(df: DataFrame, key: str, value_column: str, relation: DataFrame, relation_fk: str) -> DataFrame:
    """value, total, covered, ratio: of the distinct keys with the value, those that a row of the relation refers to."""
    flagged = _flagged(df.select(key, value_column), [key], relation, [relation_fk], "_hit")
    return _coverage(flagged, key, value_column)


def _coverage(flagged: DataFrame, key: str, value_column: str) -> DataFrame:
    rows = flagged.where(F.col(value_column).isNotNull())
    # keys first: two plain aggregations, so that a value with a third of all rows is still counted map-side
    keys = rows.groupBy(F.col(value_column).cast("string").alias("value"), key).agg(F.max("_hit").alias("_hit"))
    out = keys.groupBy("value").agg(F.count(key).alias("total"), F.count_if(F.col("_hit") & F.col(key).isNotNull()).alias("covered"))
    return out.withColumn("ratio", _ratio("covered", "total"))


def structure_signal(coverage: DataFrame) -> DataFrame:
    """One row: the strongest relation's (0.7 gap + 0.3 share of values at 0.2 or more) min(1, total / 20), round 4.  ``coverage``: relation, value, total, ratio."""
    per = coverage.where("total > 0").groupBy("relation").agg(F.count(F.lit(1)).alias("n"), (F.max("ratio") - F.min("ratio")).alias("gap"), F.avg((F.col("ratio") >= 0.2).cast("double")).alias("active"), F.sum("total").alias("total"))
    signal = F.least(F.lit(1.0), (F.lit(0.7) * F.col("gap") + F.lit(0.3) * F.col("active")) * F.least(F.lit(1.0), F.col("total") / 20))
    return per.where("n >= 2").agg(F.round(F.coalesce(F.max(signal), F.lit(0.0)), 4).alias("structure_signal"))


def subtype_evidence(df: DataFrame, key: list[str], value_column: str, subtype: DataFrame, subtype_key: list[str], subtype_name: str) -> DataFrame:
    """value, subtype, total, present, ratio: rows (not distinct keys) of each value that the subtype table also has."""
    flagged = _flagged(df.select(*key, value_column), key, subtype, subtype_key, "_hit").where(F.col(value_column).isNotNull())
    out = flagged.groupBy(F.col(value_column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("total"), F.count_if("_hit").alias("present"))
    return out.select("value", F.lit(subtype_name).alias("subtype"), "total", "present", _ratio("present", "total").alias("ratio"))


def relation_domain_evidence(df: DataFrame, value_column: str, fk: str, target: DataFrame, target_key: str) -> DataFrame:
    """value, n_rows, n_linked, n_filled, locks: whether all rows of the value are linked while all rows of the other values have no key at all.  Keys are compared as text."""
    flagged = _flagged(df.select(value_column, fk), [fk], target, [target_key], "_hit", as_text=True)
    by = flagged.groupBy(F.col(value_column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_hit").alias("n_linked"), F.count(fk).alias("n_filled")).where("value is not null")
    others = F.sum("n_filled").over(Window.partitionBy()) - F.col("n_filled")  # a row for each value
    peers = F.count(F.lit(1)).over(Window.partitionBy())
    return by.withColumn("locks", (F.col("n_linked") == F.col("n_rows")) & (others == 0) & (peers > 1))


def instance_context(df: DataFrame, key: str, relation: DataFrame, relation_fk: str, order: str, columns: list[str], per_row: int = 2) -> DataFrame:
    """key and context: for each row up to ``per_row`` rows of the relation that refer to it, as an array of structs."""
    rows = relation.select(F.col(relation_fk).alias("_fk"), order, *[c for c in columns if c != order])
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(order), F.lit(16)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_fk", "_s").orderBy(order))).where(F.col("_r") <= per_row)
    best = first.withColumn("_r", F.row_number().over(Window.partitionBy("_fk").orderBy(order))).where(F.col("_r") <= per_row)
    packed = best.groupBy("_fk").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("context"))
    return df.select(key).join(packed, F.col(key) == F.col("_fk"), "left").select(key, "context")


def boolean_support(df: DataFrame, value_column: str, columns: list[str]) -> DataFrame:
    """value, column, known, true_ratio for each column whose values read as true or false."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), truth(F.col(f"`{c}`")).alias("t")) for c in columns])).alias("x")
    rows = df.select(F.col(value_column).cast("string").alias("value"), cells).select("value", "x.*").where("value is not null and t is not null")
    return rows.groupBy("value", "column").agg(F.count(F.lit(1)).alias("known"), F.avg(F.col("t").cast("double")).alias("true_ratio"))


# Weights of the enum rule score.
PRIOR, TOKENS, CONTAINED = 0.28, (0.42, 0.58), 0.72
COLUMN_TOKENS, COLUMN_CONTAINED = (0.32, 0.46), 0.68
SUBTYPE_HIT, SUBTYPE_MISS, SUBTYPE_OTHER, SUBTYPE_STRONG = 1.05, 0.32, 0.18, 0.7
CONTRAST, CONTRAST_LOW, CONTRAST_HIGH, CONTRAST_MATCH = 0.42, 0.05, 0.70, 0.62
TRUE_EXACT, TRUE_ANCESTOR, NEAR_BOOL, NEAR_BOOL_NAME = 0.22, 0.34, (0.14, 0.24), 0.45
HIGH, HIGH_GAP, MEDIUM, MEDIUM_GAP, WEAK = 0.9, 0.14, 0.58, 0.04, 0.52


def enum_rule_scores(
    values: DataFrame,
    classes: DataFrame,
    column_name: str,
    subtype: DataFrame | None = None,
    coverage: DataFrame | None = None,
    hints: DataFrame | None = None,
    booleans: DataFrame | None = None,
    asserted: DataFrame | None = None,
) -> DataFrame:
    """value, uri, score: the weighted evidence that a value stands for a class.

    values: value.  classes: uri, local_name, base, is_descendant, is_current (and has_descendants).  subtype: value,
    uri, ratio.  coverage: relation, value, ratio.  hints: relation, kind (class or name), uri, name, score, edge.
    booleans: value, column, true_ratio (from ``boolean_support``).  asserted: column, uri, true_class, distance (0: the
    class itself) of columns that mark a class.  Each kind of evidence is a table of (value, uri, weight); they are
    added up by value and class.
    """
    pairs = values.select("value").distinct().join(F.broadcast(classes), F.lit(True))  # enumerated values and candidate classes: tens of each
    prior = (F.lit(0.25) + F.lit(0.75) * F.least("base", F.lit(1.0))) * F.when(F.col("is_descendant"), 1.06).otherwise(1.0) * F.when(F.col("is_current") & F.col("has_descendants"), 0.35).otherwise(1.0)
    tokens = semantic_tokens(F.col("local_name"))
    local, v = alphanumeric(F.col("local_name")), alphanumeric(F.col("value"))
    alike = jaccard(semantic_tokens(F.col("value")), tokens)
    column = jaccard(semantic_tokens(F.lit(column_name)), tokens)
    name = alphanumeric(F.lit(column_name))
    yes = F.coalesce(truth(F.col("value")), F.lit(False))
    own = (
        prior * PRIOR
        + F.when(alike > 0, F.lit(TOKENS[0]) + alike * TOKENS[1]).otherwise(0.0)
        + F.when((v != "") & (local != "") & F.contains(local, v), CONTAINED).otherwise(0.0)
        + F.when(yes & (column > 0), F.lit(COLUMN_TOKENS[0]) + column * COLUMN_TOKENS[1]).otherwise(0.0)
        + F.when(yes & (name != "") & (local != "") & (F.contains(local, name) | F.contains(name, local)), COLUMN_CONTAINED).otherwise(0.0)
    )
    parts = [pairs.select("value", "uri", own.alias("weight"))]
    if subtype is not None:
        s = subtype.select(F.col("value").alias("_v"), F.col("uri").alias("_u"), "ratio")
        both = pairs.join(s, F.col("value") == F.col("_v"))
        weight = F.when(F.col("uri") == F.col("_u"), F.when(F.col("ratio") > 0, F.col("ratio") * SUBTYPE_HIT).otherwise(-SUBTYPE_MISS)).when(F.col("ratio") >= SUBTYPE_STRONG, F.col("ratio") * -SUBTYPE_OTHER).otherwise(0.0)
        parts.append(both.select("value", "uri", weight.alias("weight")))
    if coverage is not None and hints is not None:
        peer = _peer_maximum(coverage)
        h = hints.select("relation", "kind", F.col("uri").alias("_u"), "name", "score", "edge")
        sim = jaccard(tokens, semantic_tokens(F.col("name")))
        match = F.when(F.col("kind") == "class", F.greatest(F.when(F.col("_u") == F.col("uri"), F.lit(0.72) + F.least("score", F.lit(1.0)) * 0.28).otherwise(0.0), F.when(sim > 0, F.lit(0.2) + sim * 0.55 + F.least("score", F.lit(1.0)) * 0.25).otherwise(0.0))).otherwise(F.when(sim > 0, F.lit(0.12) + sim * 0.58).otherwise(0.0))
        best = classes.join(h, F.lit(True)).groupBy("uri", "relation").agg(F.max(match).alias("match"), F.max("edge").alias("edge"))
        rel = peer.join(best, "relation")
        weight = F.when((F.col("ratio") > 0) & (F.col("match") > 0), F.col("ratio") * F.col("edge") * F.col("match")).otherwise(0.0) - F.when((F.col("ratio") <= CONTRAST_LOW) & (F.col("peer") >= CONTRAST_HIGH) & (F.col("match") >= CONTRAST_MATCH), F.col("edge") * F.col("match") * F.col("peer") * CONTRAST).otherwise(0.0)
        parts.append(rel.select("value", "uri", weight.alias("weight")))
    if booleans is not None:
        near = booleans.where("true_ratio >= 0.5").select(F.col("value").alias("_v"), "column", "true_ratio")
        both = pairs.join(near, F.col("value") == F.col("_v"))
        sim = jaccard(tokens, semantic_tokens(F.col("column")))
        weight = (F.when(sim > 0, F.lit(NEAR_BOOL[0]) + sim * NEAR_BOOL[1]).otherwise(0.0) + F.when(alphanumeric(F.col("column")) == local, NEAR_BOOL_NAME).otherwise(0.0)) * F.col("true_ratio")
        parts.append(both.select("value", "uri", weight.alias("weight")))
        if asserted is not None:
            marks = booleans.where("true_ratio > 0").join(asserted, "column")
            weight = F.when(F.col("distance") == 0, F.col("true_ratio") * TRUE_EXACT).otherwise(F.col("true_ratio") * TRUE_ANCESTOR / F.greatest(F.lit(1), F.col("distance")))
            marked = marks.select("value", "uri", weight.alias("weight")).join(F.broadcast(classes.select("uri")), "uri", "left_semi")
            parts.append(marked.select("value", "uri", "weight"))
    return reduce(DataFrame.unionByName, parts).groupBy("value", "uri").agg(F.sum("weight").alias("score"))


def _peer_maximum(coverage: DataFrame) -> DataFrame:
    """relation, value, ratio and the largest ratio of another value: the maximum, or the second where the value has the maximum itself."""
    rank = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("ratio"), "value"))  # a row for each value
    ordered = coverage.select("relation", "value", "ratio").withColumn("_r", rank)
    top = ordered.groupBy("relation").agg(F.max(F.when(F.col("_r") == 1, F.col("ratio"))).alias("_first"), F.max(F.when(F.col("_r") == 2, F.col("ratio"))).alias("_second"))
    return ordered.join(top, "relation").select("relation", "value", "ratio", F.coalesce(F.when(F.col("_r") == 1, F.col("_second")).otherwise(F.col("_first")), F.lit(0.0)).alias("peer"))


def enum_decisions(scores: DataFrame, numeric: bool = False) -> DataFrame:
    """value, uri, score, gap, level: high locks, medium and weak are tentative, none is nothing."""
    per = Window.partitionBy("value").orderBy(F.desc("score"), "uri")
    best = scores.withColumn("rank", F.row_number().over(per)).withColumn("gap", F.col("score") - F.coalesce(F.lead("score").over(per), F.lit(0.0))).where("rank = 1")
    weak = F.lit(not numeric) & (F.col("score") >= WEAK)
    level = F.when((F.col("score") >= HIGH) & (F.col("gap") >= HIGH_GAP), "high").when((F.col("score") >= MEDIUM) & (F.col("gap") >= MEDIUM_GAP), "medium").when(weak, "weak").otherwise("none")
    return best.select("value", "uri", "score", "gap", level.alias("level"))


def lexical_locks(scored: DataFrame, least: float = 0.90, gap: float = 0.14) -> DataFrame:
    """value, uri, score of the values with one clearly best class.  ``scored``: value, uri, score."""
    per = Window.partitionBy("value").orderBy(F.desc("score"), "uri")
    best = scored.withColumn("rank", F.row_number().over(per)).withColumn("_next", F.coalesce(F.lead("score").over(per), F.lit(0.0))).where("rank = 1")
    return best.where((F.col("score") >= least) & (F.col("score") - F.col("_next") > gap)).select("value", "uri", "score")


def literal_enum(scored: DataFrame, values: DataFrame, least: float = 0.82, gap: float = 0.14, max_values: int = 10) -> DataFrame:
    """The lexical locks, if the column has two to ten complete values and no free text (64 characters, six words); else nothing.  ``values``: value, complete."""
    ok = values.agg((F.count(F.lit(1)).between(2, max_values) & F.bool_and("complete") & (F.max(F.length("value")) <= 64) & (F.max(F.size(F.split(F.trim("value"), r"\s+"))) <= 6)).alias("ok"))
    return lexical_locks(scored, least, gap - 1e-9).join(F.broadcast(ok.where("ok")), F.lit(True)).drop("ok")


def strong_subtype(evidence: DataFrame, least: float = 0.95, gap: float = 0.20, entities: int = 3) -> DataFrame:
    """value, subtype, ratio where one subtype table has nearly all rows of the value, enough of them, and clearly more than the next."""
    per = Window.partitionBy("value").orderBy(F.desc("ratio"), "subtype")
    best = evidence.withColumn("rank", F.row_number().over(per)).withColumn("_next", F.coalesce(F.lead("ratio").over(per), F.lit(0.0))).where("rank = 1")
    return best.where((F.col("ratio") >= least) & (F.col("total") >= entities) & (F.col("ratio") - F.col("_next") >= gap)).select("value", "subtype", "ratio", "total")


def relation_locks(supported: DataFrame) -> DataFrame:
    """value and class of the values that evidence ties to exactly one class.  ``supported``: value, uri."""
    return supported.groupBy("value").agg(F.count_distinct("uri").alias("_n"), F.min("uri").alias("uri")).where("_n = 1").drop("_n")


def joined_context(coverage: DataFrame, identity: list[str], least: float = 0.95, entities: int = 3) -> DataFrame:
    """Values whose one non-identity relation covers nearly all of enough entities.  ``coverage``: relation, value, total, ratio."""
    strong = coverage.where(~F.col("relation").isin(*identity) & (F.col("ratio") >= least) & (F.col("total") >= entities)) if identity else coverage.where((F.col("ratio") >= least) & (F.col("total") >= entities))
    return strong.groupBy("value").agg(F.count(F.lit(1)).alias("_n"), F.min("relation").alias("relation")).where("_n = 1").drop("_n")


def residual_branch(values: DataFrame, locked: DataFrame, children: DataFrame) -> DataFrame:
    """value and uri of the one value and the one child class that are left, if exactly one of each is.  ``locked``: value, uri; ``children``: uri."""
    v = values.select("value").distinct().join(locked, "value", "left_anti").agg(F.count(F.lit(1)).alias("nv"), F.min("value").alias("value"))
    c = children.select("uri").distinct().join(locked, "uri", "left_anti").agg(F.count(F.lit(1)).alias("nc"), F.min("uri").alias("uri"))
    return v.join(c, F.lit(True)).where("nv = 1 and nc = 1").select("value", "uri")
