"""Rankings of classes and properties for schema names: window functions over candidate tables.

Scores are rounded to three places before they are compared; what is then equal goes by URI.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import names as N

TEXT_WEIGHT, DOMAIN_WEIGHT = 0.7, 0.3
HIGH, MEDIUM, EPSILON = (0.7, 0.2), (0.4, 0.1), 1e-9


def candidates(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """All pairs of schema names (name) and vocabulary entries (uri): sizes of a schema and an ontology, the smaller broadcast."""
    return queries.join(F.broadcast(vocabulary), F.lit(True)).withColumn("local_name", N.local_name(F.col("uri")))


def rank_classes(queries: DataFrame, classes: DataFrame, top_k: int = 5) -> DataFrame:
    """name, uri, local_name, score, syntax_score, token_score, rank."""
    c = candidates(queries.select("name"), classes.select("uri"))
    syntax, token = N.name_overlap(F.col("name"), F.col("local_name")), N.token_coverage(F.col("name"), F.col("local_name"))
    scored = c.select("*", syntax.alias("_s"), token.alias("_t")).select("name", "uri", "local_name", F.round(F.greatest("_s", "_t"), 3).alias("score"), F.round("_s", 3).alias("syntax_score"), F.round("_t", 3).alias("token_score"))
    return _top(scored, [F.desc("score"), F.asc("uri")], top_k)


def _top(scored: DataFrame, order: list[Column], top_k: int, per: str = "name") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= top_k)


def rank_object_properties(scored: DataFrame, top_k: int = 5) -> DataFrame:
    """name, uri, scores, both ranks, track and rank: a track by name and a track by meaning, both of whose heads stay.

    ``scored``: name, uri, syntax_score, domain_score, range_score (unrounded).
    """
    meaning = (F.col("domain_score") + F.col("range_score")) / 2
    s = scored.select("name", "uri", F.round("syntax_score", 3).alias("syntax_score"), F.round(meaning, 3).alias("semantic_score"), F.round("domain_score", 3).alias("domain_score"), F.round("range_score", 3).alias("range_score"), F.round(F.col("syntax_score") * 0.5 + meaning * 0.5, 3).alias("score"))
    per = Window.partitionBy("name")
    s = s.withColumn("syntax_rank", F.row_number().over(per.orderBy(F.desc("syntax_score"), F.desc("semantic_score"), F.desc("score"), "uri")))
    s = s.withColumn("semantic_rank", F.row_number().over(per.orderBy(F.desc("semantic_score"), F.desc("domain_score"), F.desc("range_score"), F.desc("syntax_score"), "uri")))
    in_s, in_m = F.col("syntax_rank") <= top_k, F.col("semantic_rank") <= top_k
    pool = s.where(in_s | in_m).withColumn("track", F.when(in_s & in_m, "both").when(in_s, "syntax").otherwise("semantic"))
    lead = F.when(F.col("syntax_rank") == 1, 0).when(F.col("semantic_rank") == 1, 1).otherwise(2)
    order = [lead, F.when(F.col("track") == "both", 0).otherwise(1), F.least("syntax_rank", "semantic_rank"), F.col("syntax_rank") + F.col("semantic_rank"), F.desc("semantic_score"), F.desc("syntax_score"), F.desc("score"), F.asc("uri")]
    return _top(pool, order, top_k)


def rank_datatype_properties(scored: DataFrame, top_k: int = 5) -> DataFrame:
    """name, uri, score = 0.7 name + 0.3 domain, rank.  ``scored``: name, uri, name_score, domain_score (unrounded)."""
    s = scored.withColumn("score", F.round(F.col("name_score") * TEXT_WEIGHT + F.col("domain_score") * DOMAIN_WEIGHT, 3))
    s = s.withColumn("name_score", F.round("name_score", 3)).withColumn("domain_score", F.round("domain_score", 3))
    return _top(s, [F.desc("score"), F.desc("name_score"), F.asc("uri")], top_k)


def identity_property(scored: DataFrame) -> DataFrame:
    """At most one property for each name: lexical 0.95, domain 0.85, and no rival within 0.05 lexical and 0.15 domain.  ``scored``: name, uri, lexical, domain_score."""
    ok = scored.where("lexical >= 0.95 and domain_score >= 0.85")
    per = Window.partitionBy("name").orderBy(F.desc("lexical"), F.desc("domain_score"), "uri")
    r = ok.withColumn("_r", F.row_number().over(per)).withColumn("_l", F.lead("lexical").over(per)).withColumn("_d", F.lead("domain_score").over(per))
    alone = F.col("_l").isNull() | (F.col("lexical") - F.col("_l") >= 0.05 - EPSILON) | (F.col("domain_score") - F.col("_d") >= 0.15 - EPSILON)
    return r.where((F.col("_r") == 1) & alone).select("name", "uri", "lexical", "domain_score")


def confidence(ranked: DataFrame) -> DataFrame:
    """name, uri, score, gap, confidence from the first two candidates of each name."""
    per = Window.partitionBy("name").orderBy("rank")
    first = ranked.withColumn("gap", F.col("score") - F.coalesce(F.lead("score").over(per), F.lit(0.0))).where("rank = 1")
    at = lambda level: (F.col("score") + EPSILON >= level[0]) & (F.col("gap") + EPSILON >= level[1])
    return first.select("name", "uri", "score", "gap", F.when(at(HIGH), "high").when(at(MEDIUM), "medium").otherwise("low").alias("confidence"))


def exact_first(scored: DataFrame, top_k: int = 5) -> DataFrame:
    """Ties broken by an equal name, then score, syntax, tokens, uri.  ``scored``: as from ``rank_classes``."""
    exact = (N.alphanumeric(F.col("name")) == N.alphanumeric(F.col("local_name"))).alias("exact")
    return _top(scored.drop("rank").select("*", exact), [F.desc("exact"), F.desc("score"), F.desc("syntax_score"), F.desc("token_score"), F.asc("uri")], top_k)


def resolve(scored: DataFrame, least: float = 0.65) -> DataFrame:
    """name, uri and how: exact, ambiguous_exact, fuzzy, ambiguous_fuzzy or unresolved (uri null unless exact or fuzzy)."""
    s = scored.drop("rank").withColumn("exact", N.alphanumeric(F.col("name")) == N.alphanumeric(F.col("local_name")))
    per = Window.partitionBy("name")
    s = s.withColumn("_exact", F.count_if("exact").over(per)).withColumn("_top", F.max(F.struct("score", "syntax_score", "token_score")).over(per))
    s = s.withColumn("_tied", F.count_if(F.struct("score", "syntax_score", "token_score") == F.col("_top")).over(per))
    s = s.withColumn("_r", F.row_number().over(per.orderBy(F.desc("exact"), F.desc("score"), F.desc("syntax_score"), F.desc("token_score"), "uri"))).where("_r = 1")
    how = F.when(F.col("_exact") == 1, "exact").when(F.col("_exact") > 1, "ambiguous_exact").when(F.col("score") < least, "unresolved").when(F.col("_tied") > 1, "ambiguous_fuzzy").otherwise("fuzzy")
    return s.select("name", F.when(how.isin("exact", "fuzzy"), F.col("uri")).alias("uri"), how.alias("how"))


def boolean_classes(ranked: DataFrame, top_k: int = 5) -> DataFrame:
    """Classes for a boolean column: max(0.6 base, token overlap), 1.2 for an equal name.  ``ranked``: name, uri, local_name, score."""
    mine = F.filter(N.semantic_tokens(F.col("name")), lambda t: ~t.isin(*N.BOOLEAN_STOP_TOKENS))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(mine, N.semantic_tokens(F.col("local_name")))), F.size(mine)), F.lit(0.0))
    exact = (N.alphanumeric(F.col("name")) != "") & (N.alphanumeric(F.col("name")) == N.alphanumeric(F.col("local_name")))
    score = F.round(F.greatest(F.col("score") * 0.6, share, F.when(exact, F.lit(1.2)).otherwise(0.0)), 3)
    return _top(ranked.select("name", "uri", "local_name", score.alias("score")), [F.desc("score"), F.asc("uri")], top_k)


def empty_fk_candidates(pairs: DataFrame, top_k: int = 20, least: float = 0.0) -> DataFrame:
    """Targets for columns without values, by names.  ``pairs``: table, column, ref_table."""
    score = F.round(F.greatest(N.name_overlap(F.col("column"), F.col("ref_table")), N.name_overlap(F.col("table"), F.col("ref_table"))), 3)
    per = Window.partitionBy("table", "column").orderBy(F.desc("score"), "ref_table")
    s = pairs.withColumn("score", score).where(F.col("score") >= least)
    return s.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= top_k)


def prune_general(scored: DataFrame, closure: DataFrame, margin: float = 0.05) -> DataFrame:
    """Candidates without those of which a strict subclass scores nearly as well.  ``scored``: name, uri, score; ``closure``: child, ancestor."""
    special = scored.select(F.col("name").alias("_n"), F.col("uri").alias("child"), F.col("score").alias("_s")).join(closure.where("child <> ancestor"), "child")
    beaten = scored.join(special, (F.col("name") == F.col("_n")) & (F.col("uri") == F.col("ancestor")) & (F.col("_s") >= F.col("score") - margin)).select("name", "uri").distinct()
    return scored.join(beaten, ["name", "uri"], "left_anti")


def deterministic_property(evidence: DataFrame) -> DataFrame:
    """The property for each relation by evidence alone.  ``evidence``: task, uri, direction, domain_match, range_match, declared, restriction, construction, exact_name, role_hits."""
    flag = lambda c, w: F.col(c).cast("int") * w
    score = (F.col("domain_match") + F.col("range_match")) * 5 + flag("declared", 1.2) + flag("restriction", 1.0) + flag("construction", 1.0) + flag("exact_name", 2.4) + F.col("role_hits") * 0.18
    per = Window.partitionBy("task").orderBy(F.desc("score"), N.local_name(F.col("uri")), "uri", "direction")
    return evidence.withColumn("score", score).withColumn("_r", F.row_number().over(per)).where("_r = 1").select("task", "uri", "direction", "score")
