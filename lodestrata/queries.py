"""One query for each operator over the driver's tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import demo
from lodestrata.functions import iri, names
from lodestrata.functions.types import IND_EXCLUDED_COLUMNS, IND_EXCLUDED_TYPES
from lodestrata.operators import classify, evidence, ind, ontology, profile, ranking
from lodestrata.plans import evaluate, materialize, pipeline, sparql
from lodestrata.plans.r2rml import Mapping, ObjectMap, PredicateObject, TriplesMap
from lodestrata.sources.catalog import Catalog, ForeignKey

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NS, RDF_TYPE = demo.NS, materialize.TYPE


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- profiles

_COUNTED = ["customer", "documents", "events", "labels", "lineitem", "nation", "orders", "part", "region", "supplier"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in _COUNTED))
def row_counts(spark, d):
    return profile.row_counts({t: _t(spark, d, t) for t in _COUNTED})


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_values FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_custkey FROM orders)" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")))
def non_null_counts(spark, d):
    o = _t(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return profile.non_null_counts(o, ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"])


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_values(spark, d):
    return profile.distinct_values(_t(spark, d, "customer"), "c_mktsegment")


@query("SELECT DISTINCT trim(l_orderkey::VARCHAR) AS value FROM lineitem WHERE trim(l_orderkey::VARCHAR) <> ''")
def trimmed_values(spark, d):
    return profile.trimmed_values(_t(spark, d, "lineitem"), "l_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_rows(spark, d):
    return profile.sample_rows(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 5)


def _profile_sql(table: str, column: str) -> str:
    return f"""WITH g AS (SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 21),
      r AS (SELECT value, n, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS c FROM g)
      SELECT value, n, c <= 20 AS complete FROM r WHERE i <= 20"""


@query(_profile_sql("customer", "c_mktsegment"))
def enum_profile_mktsegment(spark, d):
    return profile.enum_profile(_t(spark, d, "customer"), "c_mktsegment")


@query(_profile_sql("part", "p_brand"))
def enum_profile_truncated(spark, d):
    return profile.enum_profile(_t(spark, d, "part"), "p_brand")


@query("SELECT o_orderpriority AS value, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 8")
def enum_profile_sampled_rows(spark, d):
    return profile.enum_samples(_t(spark, d, "orders"), "o_orderpriority", "o_orderkey")


def _diagnostics_sql(columns: dict[str, str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::VARCHAR AS v FROM {t}" for c, t in columns.items())
    return f"""WITH c AS (SELECT col, v, count(*) AS n FROM ({cells}) WHERE v IS NOT NULL GROUP BY 1, 2),
      a AS (SELECT col, count(*) AS d, sum(least(n, 8)) AS s, count(*) FILTER (length(v) <= 16 AND NOT contains(v, ' ')) / count(*) AS sr, count(*) FILTER (regexp_full_match(v, '-?\\d+')) / count(*) AS nr FROM c GROUP BY 1)
      SELECT col AS "column", d AS "distinct", round(sr, 4) AS short_ratio, round(nr, 4) AS numeric_ratio, round(greatest(0.0, 1 - d / greatest(s, d)), 4)::DOUBLE AS repeated_ratio,
             d BETWEEN 2 AND 30 AND sr >= 0.8 AND (nr >= 0.4 OR (d / greatest(s, d) <= 0.75 AND d <= 10)) AS likely_enum FROM a"""


@query(_diagnostics_sql({"o_orderstatus": "orders", "o_orderpriority": "orders", "l_returnflag": "lineitem", "event_type": "events", "p_type": "part", "p_brand": "part", "p_size": "part"}))
def enum_discriminator_flags(spark, d):
    cols = {"orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag"], "events": ["event_type"], "part": ["p_type", "p_brand", "p_size"]}
    return reduce(DataFrame.unionByName, [profile.enum_diagnostics(_t(spark, d, t), c) for t, c in cols.items()])


@query("""WITH c AS (SELECT DISTINCT 'url' AS col, trim(url) AS v FROM pages UNION SELECT DISTINCT 'host', trim(split_part(url, '/', 3)) FROM pages),
  f AS (SELECT col, count(*) AS d, count(*) FILTER (regexp_matches(v, '^https?://[^\\s/?#]+\\S*$')) AS i FROM c WHERE v <> '' GROUP BY 1)
  SELECT col AS "column", d AS "distinct", i AS iris, round(i / d, 4) AS ratio, i / d >= 0.9 AS is_iri FROM f""")
def iri_ratio(spark, d):
    return profile.iri_ratio(_t(spark, d, "pages").select("url", F.split_part("url", F.lit("/"), F.lit(3)).alias("host")), ["url", "host"])


@query("SELECT o_orderstatus AS value, count(*) AS n_rows, count(nullif(o_orderpriority, '5-LOW')) AS n_o_orderpriority, count(DISTINCT o_custkey) AS n_keys FROM orders GROUP BY 1")
def counts_by_value(spark, d):
    o = _t(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return profile.counts_by_value(o, "o_orderstatus", ["o_orderpriority"], "o_custkey")


# ---------------------------------------------------------------- dependencies

_SCHEMA = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string")],
    "documents": [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "events": [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_returnflag", "string"), ("l_linestatus", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int")],
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int")],
}
_IND_KEYS = {t: demo.KEYS[t] for t in _SCHEMA if t in demo.KEYS}


def _ind_catalog(spark: SparkSession, d: str) -> Catalog:
    """Keys as declared, no references: these are to be found."""
    return Catalog({t: _t(spark, d, t).select(*[c for c, _ in cols]) for t, cols in _SCHEMA.items()}, _IND_KEYS)


def _ind_sql() -> str:
    targets = [(t, k[0], dict(_SCHEMA[t])[k[0]]) for t, k in _IND_KEYS.items()]
    sources = [(t, c, k) for t, cols in _SCHEMA.items() for c, k in cols if c not in IND_EXCLUDED_COLUMNS and k not in IND_EXCLUDED_TYPES]
    parts = [
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{rt}' AS ref_table, '{rc}' AS ref_column, (SELECT count(DISTINCT {c}) FROM {t}) AS n_source, (SELECT count(DISTINCT {rc}) FROM {rt}) AS n_target, (SELECT count(*) FROM (SELECT {c} AS v FROM {t} INTERSECT SELECT {rc} FROM {rt})) AS n_common"
        for t, c, k in sources
        for rt, rc, rk in targets
        if k == rk and (t, c) != (rt, rc)
    ]
    return f"SELECT *, n_common / n_source AS score FROM ({' UNION ALL '.join(parts)}) WHERE n_common > 0"


_IND = _ind_sql()


@query(_IND)
def ind_scores_all_pairs(spark, d):
    return ind.all_pairs_ind(_ind_catalog(spark, d))


@query(f'SELECT * FROM ({_IND}) WHERE score >= 0.95 QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY score DESC, n_target, ref_table, ref_column) = 1')
def ind_best_target(spark, d):
    return ind.best_target(ind.all_pairs_ind(_ind_catalog(spark, d)))


@query(f'SELECT * FROM ({_IND}) WHERE score >= 0.95 QUALIFY rank() OVER (PARTITION BY "table", "column" ORDER BY n_target) = 1')
def ind_nearest(spark, d):
    return ind.nearest_targets(ind.all_pairs_ind(_ind_catalog(spark, d)))


@query(f'SELECT threshold::DOUBLE AS threshold, count(*) AS n_pairs, count(DISTINCT ("table", "column")) AS n_columns FROM ({_IND}), (VALUES (0.5), (0.8), (0.95), (1.0)) x(threshold) WHERE score >= threshold GROUP BY 1')
def ind_threshold_sweep(spark, d):
    return ind.threshold_sweep(ind.all_pairs_ind(_ind_catalog(spark, d)), [0.5, 0.8, 0.95, 1.0])


_DECLARED = [(k.table, k.columns[0], k.ref_table, k.ref_columns[0]) for k in demo.REFERENCES]
_MERGED = f"""SELECT "table", "column", ref_table, ref_column FROM ({_IND}) WHERE score >= 0.95 AND "table" <> ref_table
  AND (NOT regexp_matches(replace(lower("column"), '_', ''), 'type|status|kind|category|flag|code|level') OR contains(replace(lower("column"), '_', ''), replace(lower(ref_table), '_', '')) OR contains(replace(lower(ref_table), '_', ''), replace(lower("column"), '_', '')))
  AND ("table", "column") <> ('orders', 'o_custkey')
  QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY score DESC, n_target, ref_table, ref_column) = 1"""


@query(_MERGED)
def ind_merged_keys(spark, d):
    best = ind.all_pairs_ind(_ind_catalog(spark, d)).where("table <> ref_table")
    known = spark.createDataFrame([("orders", "o_custkey")], "table string, column string")
    return ind.mergeable(ind.best_target(best), known).select("table", "column", "ref_table", "ref_column")


@query(f"""WITH p AS ({_MERGED}), g AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _DECLARED)}) v("table", "column", ref_table, ref_column)),
  c AS (SELECT (SELECT count(*) FROM (FROM p INTERSECT FROM g)) AS matched, (SELECT count(*) FROM (FROM g EXCEPT FROM p)) AS missing, (SELECT count(*) FROM (FROM p EXCEPT FROM g)) AS unmatched),
  r AS (SELECT *, matched / (matched + unmatched) AS "precision", matched / (matched + missing) AS recall FROM c)
  SELECT *, "precision" * recall * 2 / ("precision" + recall) AS f1 FROM r""")
def fk_recovery(spark, d):
    declared = spark.createDataFrame(_DECLARED, "table string, column string, ref_table string, ref_column string")
    return ind.recovery(ind_merged_keys(spark, d), declared)


def _overlap_sql(a: str, b: str) -> str:
    return f"""WITH a AS (SELECT DISTINCT trim(({a})::VARCHAR) AS v FROM {{0}}), b AS (SELECT DISTINCT trim(({b})::VARCHAR) AS v FROM {{1}}),
      x AS (SELECT v FROM a WHERE v <> ''), y AS (SELECT v FROM b WHERE v <> ''),
      c AS (SELECT (SELECT count(*) FROM x) AS source_distinct, (SELECT count(*) FROM y) AS target_distinct, (SELECT count(*) FROM (FROM x INTERSECT FROM y)) AS intersection, (SELECT count(*) FROM (FROM x UNION FROM y)) AS "union"),
      r AS (SELECT *, intersection / source_distinct AS source_in_target, intersection / target_distinct AS target_in_source, intersection / "union" AS jaccard FROM c)
      SELECT *, CASE WHEN source_in_target >= 0.95 AND target_in_source >= 0.95 THEN 'equivalence_column' WHEN source_in_target >= 0.95 THEN 'inclusion_column_source_to_target' WHEN jaccard >= 0.8 THEN 'high_overlap_column' ELSE 'weak_overlap' END AS evidence_type FROM r"""


@query(_overlap_sql("o_custkey", "c_custkey").format("orders", "customer"))
def overlap_metrics(spark, d):
    return ind.overlap(_t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer"), "c_custkey")


def _rate_sql(t: str, c: str, r: str, rc: str) -> str:
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"columns\", '{r}' AS ref_table, '{rc}' AS ref_columns, count(*) AS n_joined, count(b.{rc}) AS n_matched, coalesce(count(b.{rc}) / nullif(count(*), 0), 0.0) AS match_rate FROM {t} a LEFT JOIN {r} b ON a.{c} = b.{rc}"


@query(" UNION ALL ".join(_rate_sql(*x) for x in [("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "documents", "doc_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("labels", "doc_id", "supplier", "s_suppkey")]))
def fk_match_rate(spark, d):
    keys = [ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)), ForeignKey("events", ("user_id",), "documents", ("doc_id",)), ForeignKey("orders", ("o_orderkey",), "lineitem", ("l_orderkey",)), ForeignKey("labels", ("doc_id",), "supplier", ("s_suppkey",))]
    return ind.match_rates(demo.catalog(spark, d, references=False), keys)


# ---------------------------------------------------------------- evidence by value


@query("""SELECT o_orderstatus AS value, count(DISTINCT o_orderkey) AS total, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') THEN o_orderkey END) AS covered,
  round(covered / total, 4) AS ratio FROM orders GROUP BY 1""")
def coverage_outgoing(spark, d):
    return evidence.coverage_outgoing(_t(spark, d, "orders"), "o_orderkey", "o_orderstatus", "o_custkey", _t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), "c_custkey")


_INCOMING = """SELECT c_mktsegment AS value, count(DISTINCT c_custkey) AS total, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {0}) THEN c_custkey END) AS covered, round(covered / total, 4) AS ratio FROM customer GROUP BY 1"""


@query(_INCOMING.format("o_orderstatus = 'P'"))
def coverage_incoming(spark, d):
    return evidence.coverage_incoming(_t(spark, d, "customer"), "c_custkey", "c_mktsegment", _t(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@query(f"""WITH c AS (SELECT 'p' AS relation, * FROM ({_INCOMING.format("o_orderstatus = 'P'")}) UNION ALL SELECT 'urgent', * FROM ({_INCOMING.format("o_orderpriority = '1-URGENT' AND c_mktsegment < 'F'")})),
  s AS (SELECT relation, count(*) AS n, max(ratio) - min(ratio) AS gap, avg(CASE WHEN ratio >= 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS active, sum(total) AS total FROM c WHERE total > 0 GROUP BY 1)
  SELECT round(coalesce(max(least(1.0::DOUBLE, (0.7::DOUBLE * gap + 0.3::DOUBLE * active) * least(1.0::DOUBLE, total / 20))), 0.0), 4) AS structure_signal FROM s WHERE n >= 2""")
def enum_structure_signal(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    p = evidence.coverage_incoming(c, "c_custkey", "c_mktsegment", o.where("o_orderstatus = 'P'"), "o_custkey").withColumn("relation", F.lit("p"))
    early = c.where("c_mktsegment < 'F'").select(F.col("c_custkey").alias("o_custkey"))
    u = evidence.coverage_incoming(c, "c_custkey", "c_mktsegment", o.where("o_orderpriority = '1-URGENT'").join(early, "o_custkey", "left_semi"), "o_custkey").withColumn("relation", F.lit("urgent"))
    return evidence.structure_signal(p.unionByName(u))


@query("""SELECT role AS value, 'long_turns' AS subtype, count(*) AS total, count(*) FILTER (length(text) > 200) AS present, round(present / total, 4) AS ratio FROM conversations GROUP BY 1""")
def sh_value_evidence(spark, d):
    c = _t(spark, d, "conversations")
    return evidence.subtype_evidence(c, ["conv_id", "turn"], "role", c.where(F.length("text") > 200), ["conv_id", "turn"], "long_turns")


@query("""SELECT o_orderstatus AS value, count(*) AS n_rows, count(CASE WHEN k IN (SELECT c_custkey FROM customer) THEN 1 END) AS n_linked, count(k) AS n_filled,
  n_linked = n_rows AND sum(count(k)) OVER () = count(k) AND count(*) OVER () > 1 AS locks FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS k FROM orders) GROUP BY 1""")
def relation_domain_evidence(spark, d):
    o = _t(spark, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")))
    return evidence.relation_domain_evidence(o, "o_orderstatus", "o_custkey", _t(spark, d, "customer"), "c_custkey")


@query("""SELECT c_custkey, list_sort(list(o_orderkey::VARCHAR || ':' || o_orderstatus) FILTER (r <= 2)) [1] AS first_order, coalesce(count(*) FILTER (r <= 2), 0) AS n_context
  FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ON o_custkey = c_custkey GROUP BY 1""")
def instance_context(spark, d):
    found = evidence.instance_context(_t(spark, d, "customer"), "c_custkey", _t(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus"])
    texts = F.array_sort(F.transform("context", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])))
    return found.select("c_custkey", F.get(texts, F.lit(0)).alias("first_order"), F.coalesce(F.size("context"), F.lit(0)).cast("long").alias("n_context")).withColumn("n_context", F.greatest("n_context", F.lit(0)))


# ---------------------------------------------------------------- names and rankings

_NAMES = ["customer", "c_mktsegment", "orders", "o_orderpriority", "line_item", "isOrderOf", "ISBN_code", "nation", "placed-by"]
_CLASSES = ["Customer", "Order", "OrderPriority", "LineItem", "Nation", "MarketSegment", "hasISBN", "Region", "isPlacedBy"]
_VALUES = ", ".join(f"('{x}')" for x in _NAMES)
_VOCABULARY = ", ".join(f"('{NS}{x}')" for x in _CLASSES)
_TOKENS = "list_distinct(list_filter(list_transform(flatten(list_transform(regexp_split_to_array({0}, '[_\\-\\s]+'), lambda p: CASE WHEN length(p) > 1 AND p = upper(p) AND p <> lower(p) THEN [p] ELSE regexp_split_to_array(regexp_replace(p, '([A-Z])', ' \\1', 'g'), '\\s+') END)), lambda x: lower(x)), lambda x: x <> ''))"
_OVERLAP = f"""p AS (SELECT n.name, c.uri, split_part(c.uri, '#', 2) AS l FROM (VALUES {_VALUES}) n(name), (VALUES {_VOCABULARY}) c(uri)),
  q AS (SELECT *, lower(regexp_replace(name, '[_\\-\\s]+', '', 'g')) AS x, lower(regexp_replace(l, '[_\\-\\s]+', '', 'g')) AS y, {_TOKENS.format("name")} AS a, {_TOKENS.format("l")} AS b FROM p),
  s AS (SELECT name, uri, l, list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / greatest(length(x), length(y)) AS chars,
               len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS tokens FROM q)"""


def _name_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([(x,) for x in _NAMES], "name string"), spark.createDataFrame([(NS + x,) for x in _CLASSES], "uri string")


@query(f"WITH {_OVERLAP} SELECT name, uri, round(chars, 9) AS char_overlap, round(tokens, 9) AS token_jaccard, round(greatest(chars, tokens), 9) AS overlap FROM s")
def name_overlap_pairs(spark, d):
    c = ranking.candidates(*_name_frames(spark))
    n, l = F.col("name"), F.col("local_name")
    return c.select("name", "uri", F.round(names.char_overlap(n, l), 9).alias("char_overlap"), F.round(names.jaccard(names.tokenize(n), names.tokenize(l)), 9).alias("token_jaccard"), F.round(names.name_overlap(n, l), 9).alias("overlap"))


_STOP = "['hst', 'all', 'inc', 'npdid', 'ncs', 'totalt', 'poly', 'petreg', 'id']"
_RANKED = f"""WITH {_OVERLAP}, t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x))) AS ta,
    list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(l, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z\\d])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS tb FROM s),
  k AS (SELECT name, uri, l AS local_name, greatest(chars, tokens) AS ss, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_filter(ta, lambda x: len(list_filter(tb, lambda y: x = y OR (length(x) >= 4 AND length(y) >= 4 AND (starts_with(x, y) OR starts_with(y, x))))) > 0)) / len(ta) ELSE 0.0 END AS ts FROM t),
  r AS (SELECT name, uri, local_name, round(greatest(ss, ts), 3) AS score, round(ss, 3) AS syntax_score, round(ts, 3) AS token_score FROM k)"""


@query(f"{_RANKED} SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, uri)::INT AS rank FROM r QUALIFY rank <= 3")
def rank_classes_topk(spark, d):
    return ranking.rank_classes(*_name_frames(spark), top_k=3)


@query(f"""{_RANKED}, f AS (SELECT name, uri, score, score - coalesce(lead(score) OVER w, 0.0) AS gap, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY name ORDER BY score DESC, uri))
  SELECT name, uri, score, round(gap, 6) AS gap, CASE WHEN score + 1e-9 >= 0.7 AND gap + 1e-9 >= 0.2 THEN 'high' WHEN score + 1e-9 >= 0.4 AND gap + 1e-9 >= 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM f WHERE i = 1""")
def confidence_from_gap(spark, d):
    return ranking.confidence(ranking.rank_classes(*_name_frames(spark), top_k=9)).withColumn("gap", F.round("gap", 6))


# seven properties with given scores: name, uri, syntax, domain, range
_SCORED = [("writes", f"{NS}p{i}", s, a, b) for i, (s, a, b) in enumerate([(0.9, 0.0, 0.3), (0.2, 1.0, 1.0), (0.6, 0.85, 1.0), (0.6, 0.85, 1.0), (0.1, 0.0, 0.0), (0.75, 0.3, 0.3), (0.3, 0.5, 0.85)])]
_SCORED_SQL = ", ".join(f"('{n}', '{u}', {s}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for n, u, s, a, b in _SCORED)


@query(f"""WITH v AS (SELECT name, uri, round(s, 3) AS syntax_score, round((a + b) / 2, 3) AS semantic_score, round(a, 3) AS domain_score, round(b, 3) AS range_score, round(s * 0.5 + (a + b) / 2 * 0.5, 3) AS score FROM (VALUES {_SCORED_SQL}) x(name, uri, s, a, b)),
  w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY syntax_score DESC, semantic_score DESC, score DESC, uri)::INT AS syntax_rank, row_number() OVER (PARTITION BY name ORDER BY semantic_score DESC, domain_score DESC, range_score DESC, syntax_score DESC, uri)::INT AS semantic_rank FROM v),
  p AS (SELECT *, CASE WHEN syntax_rank <= 3 AND semantic_rank <= 3 THEN 'both' WHEN syntax_rank <= 3 THEN 'syntax' ELSE 'semantic' END AS track FROM w WHERE least(syntax_rank, semantic_rank) <= 3)
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN syntax_rank = 1 THEN 0 WHEN semantic_rank = 1 THEN 1 ELSE 2 END, CASE track WHEN 'both' THEN 0 ELSE 1 END, least(syntax_rank, semantic_rank), syntax_rank + semantic_rank, semantic_score DESC, syntax_score DESC, score DESC, uri)::INT AS rank FROM p QUALIFY rank <= 3""")
def rank_ops_dual_track(spark, d):
    return ranking.rank_object_properties(spark.createDataFrame(_SCORED, "name string, uri string, syntax_score double, domain_score double, range_score double"), 3)


@query(f"""WITH v AS (SELECT name, uri, round(s, 3) AS name_score, round(a, 3) AS domain_score, round(s * 0.7 + a * 0.3, 3) AS score FROM (VALUES {_SCORED_SQL}) x(name, uri, s, a, b))
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, name_score DESC, uri)::INT AS rank FROM v QUALIFY rank <= 5""")
def rank_dps(spark, d):
    rows = spark.createDataFrame([x[:4] for x in _SCORED], "name string, uri string, name_score double, domain_score double")
    return ranking.rank_datatype_properties(rows)


# ---------------------------------------------------------------- ontology

_EDGES = [("A", "B"), ("B", "C"), ("C", "D"), ("E", "C"), ("F", "G"), ("G", "F"), ("H", "D")]
_EDGE_SQL = ", ".join(str(e) for e in _EDGES)
_CLOSED = f"WITH RECURSIVE e AS (SELECT * FROM (VALUES {_EDGE_SQL}) v(child, parent)), c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.ancestor = e.child)"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM (VALUES {_EDGE_SQL}) v(child, parent)), w AS (SELECT child, parent AS ancestor, 1 AS distance FROM e UNION SELECT w.child, e.parent, w.distance + 1 FROM w JOIN e ON w.ancestor = e.child WHERE w.distance < 8)
  SELECT child, ancestor, min(distance)::INT AS distance FROM w GROUP BY 1, 2""")
def closure(spark, d):
    return ontology.closure(spark.createDataFrame(_EDGES, "child string, parent string"))


@query(f"{_CLOSED} SELECT ancestor, child AS leaf FROM c WHERE child NOT IN (SELECT ancestor FROM c)")
def leaf_descendants(spark, d):
    return ontology.leaves(closure(spark, d))


@query(f"""{_CLOSED}, f AS (SELECT ancestor AS top, child AS member FROM c UNION VALUES ('B', 'B'), ('E', 'E'), ('H', 'H'), ('G', 'G')),
  d AS (SELECT * FROM (VALUES ('B', 'E'), ('E', 'B'), ('H', 'G'), ('G', 'H')) v(a, b)) SELECT DISTINCT x.member AS a, y.member AS b FROM d JOIN f x ON x.top = d.a JOIN f y ON y.top = d.b""")
def incompatible_classes(spark, d):
    return ontology.incompatible(spark.createDataFrame([("B", "E"), ("H", "G")], "a string, b string"), closure(spark, d))


_ENDS = [("p1", "domain", "B"), ("p1", "range", None), ("p2", "domain", "E"), ("p2", "range", "D"), ("p3", "domain", "A"), ("p3", "domain", "H")]


@query(f"""{_CLOSED}, h AS (SELECT * FROM (VALUES ('A'), ('D'), ('H'), (NULL)) v(hint)), n AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in e) + ")" for e in _ENDS)}) v(uri, side, cls))
  SELECT hint, uri, side, max(CASE WHEN hint IS NULL OR cls IS NULL THEN 0.3::DOUBLE WHEN hint = cls THEN 1.0 WHEN EXISTS (SELECT 1 FROM c WHERE (child = hint AND ancestor = cls) OR (child = cls AND ancestor = hint)) THEN 0.85 ELSE 0.0 END) AS score FROM h, n GROUP BY ALL""")
def hint_match(spark, d):
    hints = spark.createDataFrame([("A",), ("D",), ("H",), (None,)], "hint string")
    return ontology.hint_match(hints, spark.createDataFrame(_ENDS, "uri string, side string, class string"), closure(spark, d))


# ---------------------------------------------------------------- patterns


@query("""SELECT * FROM (VALUES ('conversations', 'SE', false, true, 0), ('customer', 'SE', false, false, 1), ('documents', 'SE', false, false, 0), ('events', 'SE', false, false, 1), ('labels', 'SH', false, false, 1),
  ('lineitem', 'SR', false, false, 2), ('nation', 'SE', false, false, 1), ('orders', 'SE', false, false, 1), ('part', 'SE', false, false, 0), ('region', 'SE', false, false, 0), ('supplier', 'SE', false, false, 1), ('tags', 'SE', true, false, 1)) v("table", pattern, value_attr, key_only, n_groups)""")
def classify_tables(spark, d):
    """The star schema, with lineitem as a relation of orders and parts, and the flags of an order as a many-valued literal."""
    c = demo.catalog(spark, d, [t for t in demo.TABLES if t != "pages"])
    line = _t(spark, d, "lineitem")
    c.tables |= {"lineitem": line.select("l_orderkey", "l_partkey"), "tags": line.select("l_orderkey", "l_returnflag"), "conversations": c.tables["conversations"].select("conv_id", "turn")}
    c.primary_keys |= {"tags": ("l_orderkey", "l_returnflag")}
    c.foreign_keys = [k for k in c.foreign_keys if k.columns != ("l_suppkey",)] + [ForeignKey("tags", ("l_orderkey",), "orders", ("o_orderkey",))]
    return classify.classify(c.columns_frame(), c.pk_frame(), c.fk_frame())


# ---------------------------------------------------------------- triples

XSD = "http://www.w3.org/2001/XMLSchema#"


def _iri(table: str, *columns: str) -> str:
    return f"'{demo.BASE}{table}/' || " + " || '__' || ".join(f"{c}::VARCHAR" for c in columns)


def _triple(s: str, p: str, o: str, frm: str, literal: str | None = None) -> str:
    kind = f"'literal' AS o_kind, '{XSD}{literal}' AS datatype" if literal else "'iri' AS o_kind, NULL::VARCHAR AS datatype"
    return f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {kind} FROM {frm}"


def _graph(*parts: str) -> str:
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ") WHERE s IS NOT NULL AND o IS NOT NULL"


def _triples(spark: SparkSession, d: str, *maps: TriplesMap) -> DataFrame:
    return materialize.triples(demo.catalog(spark, d), demo.mapping(*maps))


_O, _C, _N = _iri("orders", "o_orderkey"), _iri("customer", "c_custkey"), _iri("nation", "n_nationkey")


@query(_graph(_triple(_O, RDF_TYPE, f"'{NS}Orders'", "orders"), _triple(_O, NS + "status", "o_orderstatus", "orders", "string"), _triple(_O, NS + "priority", "o_orderpriority", "orders", "string"), _triple(_O, NS + "placedOn", "strftime(o_orderdate, '%Y-%m-%d')", "orders", "date"), _triple(_O, NS + "placedBy", _iri("customer", "o_custkey"), "orders")))
def triples_se(spark, d):
    return _triples(spark, d, demo.ORDERS)


@query(_graph(_triple(_iri("documents", "doc_id"), RDF_TYPE, f"'{NS}Labels'", "labels"), _triple(_iri("documents", "doc_id"), NS + "quality", "quality::VARCHAR", "labels", "int")))
def triples_sh(spark, d):
    return _triples(spark, d, demo.LABELS)


@query(_graph(_triple(_iri("orders", "l_orderkey"), NS + "contains", _iri("part", "l_partkey"), "lineitem")))
def triples_sr(spark, d):
    return _triples(spark, d, demo.CONTAINS)


@query(_graph(_triple(_iri("orders", "l_orderkey"), NS + "flag", "l_returnflag", "lineitem", "string")))
def triples_value_attr(spark, d):
    return _triples(spark, d, demo.FLAGS)


@query(_graph(_triple(_O, RDF_TYPE, f"'{NS}OpenOrder'", "orders WHERE o_orderstatus = 'O'"), _triple(_O, RDF_TYPE, f"'{NS}FilledOrder'", "orders WHERE o_orderstatus = 'F'")))
def triples_type_enum(spark, d):
    return _triples(spark, d, demo.OPEN, demo.FILLED)


@query(_graph(_triple(_iri("documents", "doc_id"), RDF_TYPE, f"'{NS}GoodDocument'", "labels WHERE quality = 1")))
def triples_type_bool(spark, d):
    return _triples(spark, d, demo.GOOD)


_REPLY = TriplesMap("Reply", "replies", demo._template("reply", "conv_id", "reply_turn"), (), (PredicateObject(NS + "answers", ObjectMap(parent="Turn", joins=(("conv_id", "conv_id"), ("turn", "turn")))),))


@query(f"SELECT DISTINCT {_iri('reply', 'r.conv_id', '(r.turn + 1)')} AS s, '{NS}answers' AS p, {_iri('turn', 't.conv_id', 't.turn')} AS o, 'iri' AS o_kind, NULL::VARCHAR AS datatype FROM conversations r JOIN conversations t ON r.conv_id = t.conv_id AND r.turn = t.turn WHERE r.role <> 'system'")
def triples_composite_join(spark, d):
    c = demo.catalog(spark, d, ["conversations"])
    c.tables["replies"] = c.tables["conversations"].where("role <> 'system'").select("conv_id", "turn", (F.col("turn") + 1).alias("reply_turn"))
    return materialize.map_triples(c, Mapping([_REPLY, demo.TURN]), _REPLY).distinct()


@query(f"SELECT p, count(*) AS n FROM ({_graph(_triple(_N, RDF_TYPE, f'{chr(39)}{NS}Nation{chr(39)}', 'nation'), _triple(_N, NS + 'name', 'n_name', 'nation', 'string'), _triple(_N, NS + 'inRegion', _iri('region', 'n_regionkey'), 'nation'), _triple(_C, RDF_TYPE, f'{chr(39)}{NS}Customer{chr(39)}', 'customer'), _triple(_C, NS + 'name', 'c_name', 'customer', 'string'), _triple(_C, NS + 'segment', 'c_mktsegment', 'customer', 'string'), _triple(_C, NS + 'inNation', _iri('nation', 'c_nationkey'), 'customer'))}) GROUP BY 1")
def graph_by_predicate(spark, d):
    return _triples(spark, d, demo.NATION, demo.CUSTOMER).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23'), ' ', '%20') AS iri FROM pages")
def iri_encoding(spark, d):
    return _t(spark, d, "pages").select("page_id", iri.encode(F.col("url")).alias("iri"))


# ---------------------------------------------------------------- graph patterns

_PREFIX = f"PREFIX : <{NS}> "


def _ask(spark: SparkSession, d: str, text: str, *maps: TriplesMap, hierarchy: bool = False) -> DataFrame:
    m = demo.mapping(*maps) if maps else demo.FULL
    closed = demo.onto(spark).closed if hierarchy else None
    return sparql.run(sparql.MappedGraph(demo.catalog(spark, d), m, closed), _PREFIX + text)


@query("SELECT o_orderstatus AS s, o_orderpriority AS p FROM orders")
def bgp_star(spark, d):
    return _ask(spark, d, "SELECT ?s ?p WHERE { ?o a :Orders ; :status ?s ; :priority ?p }")


@query("SELECT c_name AS cn, n_name AS nn, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def bgp_path3(spark, d):
    return _ask(spark, d, "SELECT ?cn ?nn ?s WHERE { ?o :status ?s ; :placedBy ?c . ?c :name ?cn ; :inNation ?n . ?n a :Nation ; :name ?nn }")


@query("""SELECT DISTINCT c_name AS cn, s_name AS sn FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""")
def bgp_cyclic(spark, d):
    """Customers and suppliers of one nation joined by a part of an order: a cycle over five variables."""
    supplied = TriplesMap("SuppliedBy", "lineitem", demo._template("orders", "l_orderkey"), (), (demo._link("suppliedBy", "supplier", "l_suppkey"),))
    return _ask(spark, d, "SELECT DISTINCT ?cn ?sn WHERE { ?o :placedBy ?c ; :suppliedBy ?s . ?c a :Customer ; :name ?cn ; :inNation ?n . ?s a :Supplier ; :name ?sn ; :inNation ?n }", demo.ORDERS, demo.CUSTOMER, demo.SUPPLIER, supplied)


@query("SELECT c_name AS cn, o_orderkey_iri AS o FROM customer LEFT JOIN (SELECT o_custkey, " + _O + " AS o_orderkey_iri FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def bgp_optional(spark, d):
    return _ask(spark, d, 'SELECT ?cn ?o WHERE { ?c a :Customer ; :name ?cn . OPTIONAL { ?o :placedBy ?c ; :status "P" } }')


@query("SELECT n_name AS nn, c_name AS cn, oi AS o FROM nation LEFT JOIN (customer LEFT JOIN (SELECT o_custkey, " + _O + " AS oi FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey) ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'")
def bgp_nested_optional(spark, d):
    return _ask(spark, d, 'SELECT ?nn ?cn ?o WHERE { ?n a :Nation ; :name ?nn . OPTIONAL { ?c :inNation ?n ; a :Customer ; :name ?cn ; :segment "BUILDING" . OPTIONAL { ?o :placedBy ?c ; :priority "1-URGENT" } } }')


@query("SELECT c_name AS cn FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def bgp_not_exists(spark, d):
    return _ask(spark, d, 'SELECT ?cn WHERE { ?c a :Customer ; :name ?cn FILTER NOT EXISTS { ?o :placedBy ?c ; :status "P" } }')


def _two_names(spark: SparkSession, d: str) -> Catalog:
    """Customers with two columns of names, each null for some."""
    c = demo.catalog(spark, d, ["customer"])
    c.tables["customer"] = c.tables["customer"].withColumn("nick", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn("alt", F.when(F.col("c_nationkey") < 10, F.concat("c_mktsegment", F.lit("!"))))
    return c


@query("SELECT c_name AS x, coalesce(nullif(c_mktsegment, 'BUILDING'), CASE WHEN c_nationkey < 10 THEN c_mktsegment || '!' END) AS n FROM customer")
def bgp_optional_shared(spark, d):
    """A variable of two OPTIONALs: the second binds it where the first didn't."""
    m = TriplesMap("C", "customer", demo._template("customer", "c_custkey"), (NS + "Customer",), (demo._literal("name", "c_name"), demo._literal("nick", "nick"), demo._literal("alt", "alt")), key=("c_custkey",))
    return sparql.run(sparql.MappedGraph(_two_names(spark, d), demo.mapping(m)), _PREFIX + "SELECT ?x ?n WHERE { ?c a :Customer ; :name ?x . OPTIONAL { ?c :nick ?n } OPTIONAL { ?c :alt ?n } }")


_PRICED = [TriplesMap("O", "orders", demo._template("orders", "o_orderkey"), (), (demo._link("placedBy", "customer", "o_custkey"), demo._literal("total", "o_totalprice", "xsd:double")), key=("o_orderkey",)), TriplesMap("C", "customer", demo._template("customer", "c_custkey"), (NS + "Customer",), (demo._literal("name", "c_name"), demo._literal("balance", "c_acctbal", "xsd:double")), key=("c_custkey",))]


@query("SELECT c_name AS cn FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
def bgp_not_exists_filter(spark, d):
    """The condition within names a variable from outside."""
    return _ask(spark, d, "SELECT ?cn WHERE { ?c a :Customer ; :name ?cn ; :balance ?b FILTER NOT EXISTS { ?o :placedBy ?c ; :total ?t FILTER (?t > ?b * 40) } }", *_PRICED)


@query(f"SELECT o_orderstatus AS s, {_iri('customer', 'o_custkey')} AS c FROM orders WHERE o_orderkey = 5")
def bgp_point(spark, d):
    """An IRI in the query becomes a condition on the key that reaches the scan."""
    return _ask(spark, d, f"SELECT ?s ?c WHERE {{ <{demo.BASE}orders/5> :status ?s ; :placedBy ?c }}")


@query(f"SELECT {_O} AS o, o_orderstatus AS s FROM orders WHERE o_custkey = 7")
def bgp_point_object(spark, d):
    return _ask(spark, d, f"SELECT ?o ?s WHERE {{ ?o :placedBy <{demo.BASE}customer/7> ; :status ?s }}")


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name")
def bgp_theta(spark, d):
    return _ask(spark, d, "SELECT ?n1 ?n2 WHERE { ?a a :Nation ; :name ?n1 ; :inRegion ?r . ?b a :Nation ; :name ?n2 ; :inRegion ?r . FILTER (?n1 < ?n2) }")


@query("SELECT p_name AS n, p_size AS z FROM part WHERE p_size < 2 * 10 AND p_size <> 7")
def bgp_filter_arithmetic(spark, d):
    return _ask(spark, d, "SELECT ?n ?z WHERE { ?p a :Part ; :name ?n ; :size ?z FILTER (?z < 2 * 10 && ?z != 7) }")


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
def count_class(spark, d):
    """A class with its subclasses: agents are customers and suppliers."""
    return _ask(spark, d, "SELECT (COUNT(?x) AS ?n) WHERE { ?x a :Agent }", hierarchy=True)


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def count_pairs(spark, d):
    return _ask(spark, d, "SELECT (COUNT(*) AS ?n) WHERE { ?o :contains ?p }")


@query(f"SELECT DISTINCT {_iri('supplier', 'l_suppkey')} AS x, {_iri('part', 'l_partkey')} AS y FROM lineitem")
def property_pairs(spark, d):
    return _ask(spark, d, "SELECT ?x ?y WHERE { ?x :supplies ?y }")


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM (SELECT DISTINCT least(c_nationkey, s_nationkey) AS x, greatest(c_nationkey, s_nationkey) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) t JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y UNION SELECT b.n_name, a.n_name FROM (SELECT DISTINCT c_nationkey AS x, s_nationkey AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) t JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y UNION SELECT a.n_name, b.n_name FROM (SELECT DISTINCT c_nationkey AS x, s_nationkey AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) t JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y")
def symmetric_union(spark, d):
    """Nations that trade, in both directions: the union of two maps of one property."""
    line, orders, customer, supplier = (_t(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    pairs = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    c = demo.catalog(spark, d, ["nation"])
    c.tables["trade"] = pairs
    there, back = demo._link("tradesWith", "nation", "b"), demo._link("tradesWith", "nation", "a")
    m = demo.mapping(demo.NATION, TriplesMap("T1", "trade", demo._template("nation", "a"), (), (there,)), TriplesMap("T2", "trade", demo._template("nation", "b"), (), (back,)))
    return sparql.run(sparql.MappedGraph(c, m), _PREFIX + "SELECT ?n1 ?n2 WHERE { ?a a :Nation ; :name ?n1 ; :tradesWith ?b . ?b a :Nation ; :name ?n2 }")


@query("SELECT c_name AS cn, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def bgp_over_triples(spark, d):
    """The same language over a materialised graph."""
    graph = sparql.TripleGraph(_triples(spark, d, demo.ORDERS, demo.CUSTOMER))
    return sparql.run(graph, _PREFIX + 'SELECT ?cn ?s WHERE { ?o a :Orders ; :status ?s ; :placedBy [ :name ?cn ; :segment "BUILDING" ] }')


@query("""WITH a AS (SELECT o_orderstatus AS x, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1), g AS (SELECT o_orderstatus AS x, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
  t AS (SELECT coalesce(sum(least(coalesce(a.n, 0), coalesce(g.n, 0))), 0)::BIGINT AS matched, coalesce(sum(a.n), 0)::BIGINT AS answered, coalesce(sum(g.n), 0)::BIGINT AS expected FROM a FULL JOIN g ON a.x = g.x),
  r AS (SELECT *, matched / answered AS "precision", matched / expected AS recall FROM t) SELECT *, "precision" * recall * 2 / ("precision" + recall) AS f1 FROM r""")
def prf1(spark, d):
    o = _t(spark, d, "orders")
    return evaluate.score(o.where("o_orderpriority <> '1-URGENT'").select("o_orderstatus"), o.where("o_orderstatus <> 'P'").select("o_orderstatus"))


# what the rules and the default selector make of the twelve tables: table, key, class, properties in the columns' order
_GENERATED = [
    ("conversations", "conversations/{conv_id}__{turn}", "Customer", "segment=role,segment=text"),
    ("customer", "customer/{c_custkey}", "Customer", "name=c_name,segment=c_mktsegment,inNation=nation/{c_nationkey}"),
    ("documents", "documents/{doc_id}", "Documents", "language=lang,language=source,language=n_chars"),
    ("events", "events/{event_id}", "Agent", ""),
    ("labels", "documents/{doc_id}", "Labels", "language=quality"),
    ("lineitem", "lineitem/{l_orderkey}__{l_partkey}__{l_suppkey}", "Documents", "language=l_linenumber,language=l_quantity,language=l_extendedprice,language=l_discount,language=l_tax,language=l_returnflag,language=l_linestatus,language=l_shipdate"),
    ("nation", "nation/{n_nationkey}", "Nation", "name=n_name,inRegion=region/{n_regionkey}"),
    ("orders", "orders/{o_orderkey}", "Orders", "status=o_orderstatus,status=o_totalprice,status=o_orderdate,placedBy=customer/{o_custkey}"),
    ("pages", "pages/{page_id}", "Agent", ""),
    ("part", "part/{p_partkey}", "Part", "name=p_name,size=p_size,size=p_retailprice"),
    ("region", "region/{r_regionkey}", "Region", "name=r_name"),
    ("supplier", "supplier/{s_suppkey}", "Supplier", "name=s_name,inNation=nation/{s_nationkey}"),
]


@query(" UNION ALL ".join(f"SELECT '{t}Mapping' AS map, '{t}' AS \"table\", '{demo.BASE}{subject}' AS subject, '{NS}{cls}' AS classes, '{properties}' AS properties, {1 + properties.count('=')} * count(*) AS n_triples FROM {t}" for t, subject, cls, properties in _GENERATED))
def generated_mapping(spark, d):
    """Maps that the whole pipeline (discovery of keys included) makes for the star schema and the demonstration ontology, and how many triples each gives."""
    c = demo.catalog(spark, d)
    state = pipeline.Pipeline(spark).run(c, demo.onto(spark))
    said = lambda m: ",".join(f"{po.predicate.rpartition('#')[2]}={(po.object.column or po.object.template or po.object.parent).removeprefix(demo.BASE)}" for po in m.properties)
    parts = [materialize.map_triples(state.catalog, state.mapping, m).agg(F.count(F.lit(1)).alias("n_triples")).select(F.lit(m.name).alias("map"), F.lit(m.table).alias("table"), F.lit(m.subject).alias("subject"), F.lit(",".join(m.classes)).alias("classes"), F.lit(said(m)).alias("properties"), "n_triples") for m in state.mapping.maps]
    return reduce(DataFrame.unionByName, parts)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customers' names: one star on each of two tables, joined on the key."""
    return _ask(spark, d, "SELECT ?n ?s WHERE { ?o a :Orders ; :placedBy ?c ; :status ?s . ?c :name ?n }")
