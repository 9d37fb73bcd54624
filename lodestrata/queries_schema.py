"""Queries on names, types, rankings and decisions over schema and ontology, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import demo
from lodestrata.functions import iri, names, types
from lodestrata.operators import classify, evidence, ind, ontology, ranking
from lodestrata.plans import materialize, pipeline, r2rml
from lodestrata.queries import _CLOSED, _EDGES, NS, query
from lodestrata.sources import turtle
from lodestrata.sources.catalog import Catalog, ForeignKey


def _values(rows: list[tuple]) -> str:
    """Rows as SQL."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# ---------------------------------------------------------------- names

_FORMS = [("customer_id",), ("CustomerOrders",), ("hasAnAuthor",), ("is_Reviewer",), ("order-status",), ("TYPE",), ("cities",), ("address",), ("o_orderTypeEn",), ("HTTPServers",), (" Line Items ",), ("yes",), ("F",), ("the_inv_fk",)]
_SPACED = "regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
_SEMANTIC = "list_filter(regexp_split_to_array(lower(" + _SPACED + "), '[^a-z0-9]+'), lambda t: t <> '')"
_SEMANTIC = f"list_distinct(list_concat({_SEMANTIC}, list_transform(list_filter({_SEMANTIC}, lambda t: length(t) > 3 AND ends_with(t, 's')), lambda t: left(t, length(t) - 1))))"
_ALNUM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


def _joined(tokens):
    return F.array_join(F.array_sort(tokens), " ")


@query(f"""WITH n AS (SELECT * FROM ({_values(_FORMS)}) v(name)), b AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '-', '_', 'g'), '[_\\s]+', '_', 'g') AS base, replace(lower(name), '_', '') AS bare FROM n)
  SELECT name, {_ALNUM.format('name')} AS plain, CASE WHEN ends_with(base, 'ies') THEN left(base, length(base) - 3) || 'y' WHEN ends_with(base, 's') AND NOT ends_with(base, 'ss') THEN left(base, length(base) - 1) ELSE base END AS singular,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ('fk', 'id', 'uri', 'to', 'by', 'of', 'has', 'is', 'the', 'a', 'an', 'inv')))), ' ') AS role_tokens,
    array_to_string(list_sort({_SEMANTIC.format('name')}), ' ') AS semantic_tokens,
    bare IN ('type', 'kind', 'category', 'status', 'flag', 'discriminator') OR regexp_matches(bare, '(type|kind|level|typemain|typepart|typeen|typeno)$') AS discriminator,
    CASE WHEN lower(trim(name)) IN ('1', 't', 'true', 'y', 'yes') THEN true WHEN lower(trim(name)) IN ('0', 'f', 'false', 'n', 'no') THEN false END AS truth FROM b""")
def identifier_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return spark.createDataFrame(_FORMS, "name string").select(n, names.alphanumeric(n).alias("plain"), names.singular_lookup(n).alias("singular"), _joined(names.role_tokens(n)).alias("role_tokens"), _joined(names.semantic_tokens(n)).alias("semantic_tokens"), names.is_discriminator(n).alias("discriminator"), names.truth(n).alias("truth"))


_TABLES = [("Line Items",), ("conference__paper",), ("Co-author",), ("ORDERS",)]


@query(f"""SELECT name, regexp_replace(regexp_replace(lower(trim(name)), '\\s+', '_', 'g'), '_+', '_', 'g') AS iri_base, regexp_replace(name, '[^A-Za-z0-9]', '_', 'g') AS safe_id,
  CASE WHEN regexp_matches(name, '[-.\\s]') THEN '<{NS}' || name || '>' ELSE 'shop:' || name END AS predicate FROM ({_values(_TABLES)}) v(name)""")
def table_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, iri.iri_base(n), iri.safe_id(n), r2rml.predicate(NS + n, {"shop": NS})) for (n,) in _TABLES], "name string, iri_base string, safe_id string, predicate string")


_PROPERTIES = [("email", "hasEmail", "Person"), ("email", "has_an_email", "Person"), ("email", "personEmail", "Person"), ("email", "emailPerson", "Person"), ("site_URL", "hasAnSiteURL", "Paper"), ("name", "title", "Paper"), ("date", "has", "Paper"), ("author", "hasAuthor", "Paper")]
_ORDERED = "list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z\\d])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+'), lambda t: t <> ''), lambda t: lower(t))"
_BARE = "regexp_replace(regexp_replace(property, '^has_(?:(?:an|a|the)_)?', ''), '^has(?:An|A|The)?([A-Z])', '\\1')"


@query(f"""WITH p AS (SELECT *, {_ORDERED.format('col')} AS c, {_ORDERED.format('property')} AS t, {_ORDERED.format('class')} AS k FROM ({_values(_PROPERTIES)}) v(col, property, class)),
  q AS (SELECT *, CASE WHEN t[1] <> 'has' THEN t WHEN t[2] IN ('a', 'an', 'the') THEN t[3:] ELSE t[2:] END AS core FROM p)
  SELECT col, property, class, CASE WHEN len(c) = 0 OR len(core) = 0 THEN 0.0::DOUBLE WHEN core = c THEN 1.0 WHEN core = list_concat(k, c) OR core = list_concat(c, k) THEN 0.98 ELSE 0.0 END AS score,
    {_BARE} AS bare, {_ALNUM.format(_BARE)} = {_ALNUM.format('col')} OR {_ALNUM.format('property')} = {_ALNUM.format('col')} AS direct FROM q""")
def property_names(spark: SparkSession, d: str) -> DataFrame:
    c, p, k = F.col("col"), F.col("property"), F.col("class")
    return spark.createDataFrame(_PROPERTIES, "col string, property string, class string").select(c, p, k, names.identity_score(c, p, k).alias("score"), names.strip_wrapper(p).alias("bare"), names.names_directly(c, p).alias("direct"))


_STORED = [("solar", "SolarPowerAsset"), ("wind power", "WindPowerAsset"), ("ERU", "EmergencyResponseUnit"), ("true", "TrueThing"), ("12", "Class12"), ("Reviewer", "reviewer"), ("meta reviewers", "MetaReviewer"), ("ab", "Abstract"), ("power", "SolarPower")]
_TEXT, _CLASS = _SEMANTIC.format("value"), _SEMANTIC.format("class")


@query(f"""WITH s AS (SELECT *, {_ALNUM.format('value')} AS v, {_ALNUM.format('class')} AS c, regexp_replace(trim(value), '[^A-Za-z0-9]+', '', 'g') AS x, {_TEXT} AS a, {_CLASS} AS b,
    lower(array_to_string(list_transform(list_filter(regexp_split_to_array({_SPACED.format('class')}, '[^A-Za-z0-9]+'), lambda t: t <> ''), lambda t: left(t, 1)), '')) AS initials FROM ({_values(_STORED)}) w(value, class)),
  j AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS jac FROM s)
  SELECT value, class, round(CASE WHEN length(v) < 3 OR NOT regexp_matches(v, '[a-z]') OR v IN ('true', 'false', 'yes', 'no') OR c = '' THEN 0.0::DOUBLE WHEN v = c THEN 1.0 WHEN length(x) BETWEEN 3 AND 8 AND x = upper(x) AND (starts_with(c, v) OR v = initials) THEN 0.94
    WHEN contains(c, v) AND length(v) >= 5 AND length(v) / length(c) >= 0.35 THEN least(0.98, 0.72 + 0.26 * length(v) / length(c)) WHEN jac >= 0.75 THEN jac ELSE 0.0 END, 6) AS score FROM j""")
def value_class_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well stored values name classes; texts of two characters with punctuation are left to the tests."""
    return spark.createDataFrame(_STORED, "value string, class string").select("value", "class", F.round(names.value_class_score(F.col("value"), F.col("class")), 6).alias("score"))


_ENDS = [("HTTP_port", "httpPort"), ("order_id", "OrderKey"), ("part", "whole")]


@query(f"""WITH p AS (SELECT * FROM ({_values(_ENDS)}) v(a, b)), s AS (SELECT a, b, lower(regexp_replace(a, '[_\\-\\s]+', '', 'g')) AS x, lower(regexp_replace(b, '[_\\-\\s]+', '', 'g')) AS y FROM p),
  c AS (SELECT a, b, list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / greatest(length(x), length(y)) AS chars FROM s),
  t AS (SELECT * FROM (VALUES ('HTTP_port', 'httpPort', 'http port', 'http port', 1.0), ('order_id', 'OrderKey', 'id order', 'key order', 1 / 3), ('part', 'whole', 'part', 'whole', 0.0)) v(a, b, tokens_a, tokens_b, jac))
  SELECT a, b, tokens_a, tokens_b, round(chars, 4) AS char_overlap, round(jac, 4)::DOUBLE AS token_jaccard, round(greatest(chars, jac), 4) AS score FROM c JOIN t USING (a, b)""")
def similarity_explained(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame(_ENDS, "a string, b string").select(names.explain_similarity(F.col("a"), F.col("b")).alias("x")).select("x.*")
    return x.withColumn("tokens_a", F.array_join("tokens_a", " ")).withColumn("tokens_b", F.array_join("tokens_b", " "))


# ---------------------------------------------------------------- types

_SQL_TYPES = [("bigint",), ("datetime",), ("timestamp",), ("date",), ("DOUBLE PRECISION",), ("bool",), ("varchar(20)",), ("bytea",), ("money",)]
_XSD_TYPES = [("dateTime",), ("duration",), ("unsignedByte",), ("hexBinary",), ("boolean",), ("NCName",), ("string",), ("gMonth",)]
_FAMILY = "CASE WHEN contains(l, 'bool') THEN 'boolean' WHEN contains(l, 'date') OR contains(l, 'time') THEN 'temporal' WHEN regexp_matches(l, 'int|numeric|decimal|real|double|float') THEN 'numeric' WHEN regexp_matches(l, 'bytea|binary|blob') THEN 'binary' WHEN regexp_matches(l, 'char|text|string|json|xml|uuid') THEN 'text' ELSE 'unknown' END"
_XSD_FAMILY = "CASE WHEN x = 'boolean' THEN 'boolean' WHEN x IN ('dateTime', 'duration') THEN 'temporal' WHEN x = 'unsignedByte' THEN 'numeric' WHEN x = 'hexBinary' THEN 'binary' WHEN x IN ('NCName', 'string') THEN 'text' ELSE 'unknown' END"


@query(f"""WITH p AS (SELECT s AS sql_type, x AS xsd, {_FAMILY} AS sql_family, {_XSD_FAMILY} AS xsd_family, l FROM (SELECT *, lower(s) AS l FROM ({_values(_SQL_TYPES)}) v(s)), ({_values(_XSD_TYPES)}) w(x))
  SELECT sql_type, xsd, sql_family, xsd_family, sql_family = 'unknown' OR xsd_family IN ('unknown', 'text', sql_family) OR (sql_family = 'numeric' AND xsd_family = 'boolean') AS admits,
    xsd_family NOT IN ('numeric', 'boolean', 'temporal') OR sql_family IN (xsd_family, 'unknown') AS agrees,
    CASE WHEN contains(l, 'int') THEN 'xsd:int' WHEN l = 'date' THEN 'xsd:date' WHEN contains(l, 'timestamp') OR contains(l, 'datetime') THEN 'xsd:dateTime' WHEN regexp_matches(l, 'float|double|numeric|decimal') THEN 'xsd:decimal' WHEN contains(l, 'bool') THEN 'xsd:boolean' ELSE 'xsd:string' END AS own_xsd FROM p""")
def type_families(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s, x, types.family(s), types.xsd_family(types.XSD + x), types.admits(s, [types.XSD + x]), types.agrees(s, types.XSD + x), types.xsd_of(s)) for (s,) in _SQL_TYPES for (x,) in _XSD_TYPES]
    return spark.createDataFrame(rows, "sql_type string, xsd string, sql_family string, xsd_family string, admits boolean, agrees boolean, own_xsd string")


# ---------------------------------------------------------------- rankings and decisions

_IDENTITY = [("t.a", NS + "p1", 0.98, 1.0), ("t.a", NS + "p2", 0.96, 0.9), ("t.b", NS + "p1", 1.0, 0.85), ("t.b", NS + "p3", 0.95, 0.85), ("t.c", NS + "p4", 0.95, 1.0), ("t.c", NS + "p5", 0.95, 0.85), ("t.d", NS + "p6", 0.9, 1.0)]


@query(f"""WITH s AS (SELECT * FROM ({_values(_IDENTITY)}) v(name, uri, lexical, domain_score) WHERE lexical >= 0.95 AND domain_score >= 0.85),
  r AS (SELECT *, row_number() OVER w AS i, lead(lexical) OVER w AS l, lead(domain_score) OVER w AS m FROM s WINDOW w AS (PARTITION BY name ORDER BY lexical DESC, domain_score DESC, uri))
  SELECT name, uri, lexical, domain_score FROM r WHERE i = 1 AND (l IS NULL OR lexical - l >= 0.05 - 1e-9 OR domain_score - m >= 0.15 - 1e-9)""")
def identity_properties(spark: SparkSession, d: str) -> DataFrame:
    return ranking.identity_property(spark.createDataFrame(_IDENTITY, "name string, uri string, lexical double, domain_score double"))


_RANKED = [("order", NS + "Order", "Order", 0.8, 0.8, 0.5), ("order", NS + "Reorder", "Reorder", 0.9, 0.9, 0.0), ("order", NS + "OrderLine", "OrderLine", 0.8, 0.8, 0.5), ("isOpen", NS + "Open", "Open", 0.7, 0.6, 0.7), ("isOpen", NS + "OpenOrder", "OpenOrder", 0.7, 0.6, 0.7), ("misc", NS + "Thing", "Thing", 0.2, 0.2, 0.0)]
_RANKED_SCHEMA = "name string, uri string, local_name string, score double, syntax_score double, token_score double"
_RANKED_SQL = f"SELECT *, {_ALNUM.format('name')} = {_ALNUM.format('local_name')} AS exact FROM ({_values(_RANKED)}) v(name, uri, local_name, score, syntax_score, token_score)"


@query(f"SELECT *, row_number() OVER (PARTITION BY name ORDER BY exact DESC, score DESC, syntax_score DESC, token_score DESC, uri)::INT AS rank FROM ({_RANKED_SQL}) QUALIFY rank <= 2")
def rank_exact_first(spark: SparkSession, d: str) -> DataFrame:
    return ranking.exact_first(spark.createDataFrame(_RANKED, _RANKED_SCHEMA), 2)


@query(f"""WITH r AS (SELECT *, count(*) FILTER (exact) OVER p AS n_exact, count(*) OVER (PARTITION BY name, score, syntax_score, token_score) AS tied, row_number() OVER (PARTITION BY name ORDER BY exact DESC, score DESC, syntax_score DESC, token_score DESC, uri) AS i FROM ({_RANKED_SQL}) WINDOW p AS (PARTITION BY name)),
  h AS (SELECT *, CASE WHEN n_exact = 1 THEN 'exact' WHEN n_exact > 1 THEN 'ambiguous_exact' WHEN score < 0.65 THEN 'unresolved' WHEN tied > 1 THEN 'ambiguous_fuzzy' ELSE 'fuzzy' END AS how FROM r WHERE i = 1)
  SELECT name, CASE WHEN how IN ('exact', 'fuzzy') THEN uri END AS uri, how FROM h""")
def resolve_classes(spark: SparkSession, d: str) -> DataFrame:
    return ranking.resolve(spark.createDataFrame(_RANKED, _RANKED_SCHEMA))


@query(f"""WITH t AS (SELECT *, list_filter({_SEMANTIC.format('name')}, lambda t: t NOT IN ('is', 'has', 'flag', 'status', 'type')) AS a, {_SEMANTIC.format('local_name')} AS b FROM ({_RANKED_SQL})),
  s AS (SELECT name, uri, local_name, round(greatest(score * 0.6, coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0.0), CASE WHEN exact THEN 1.2 ELSE 0.0 END), 3) AS score FROM t)
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, uri)::INT AS rank FROM s QUALIFY rank <= 5""")
def boolean_class_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ranking.boolean_classes(spark.createDataFrame(_RANKED, _RANKED_SCHEMA))


_GENERAL = [("x", "A", 0.9), ("x", "B", 0.92), ("x", "C", 0.99), ("x", "D", 0.9), ("y", "D", 0.5), ("y", "H", 0.44)]


@query(f"""{_CLOSED}, s AS (SELECT * FROM ({_values(_GENERAL)}) v(name, uri, score))
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c JOIN s z ON z.uri = c.child WHERE c.ancestor = s.uri AND c.child <> c.ancestor AND z.name = s.name AND z.score >= s.score - 0.05)""")
def pruned_general_targets(spark: SparkSession, d: str) -> DataFrame:
    closed = ontology.closure(spark.createDataFrame(_EDGES, "child string, parent string"))
    return ranking.prune_general(spark.createDataFrame(_GENERAL, "name string, uri string, score double"), closed)


_RELATIONS = [("r1", NS + "a", "forward", 1.0, 0.78, True, False, False, False, 2), ("r1", NS + "b", "forward", 1.0, 0.52, False, True, False, True, 0), ("r1", NS + "b", "backward", 0.52, 1.0, False, True, False, True, 0), ("r2", NS + "c", "forward", 0.12, 0.12, False, False, True, False, 0)]


@query(f"""WITH e AS (SELECT *, (domain_match + range_match) * 5 + declared::INT * 1.2::DOUBLE + restriction::INT * 1.0::DOUBLE + construction::INT * 1.0::DOUBLE + exact_name::INT * 2.4::DOUBLE + role_hits * 0.18::DOUBLE AS score
    FROM ({_values(_RELATIONS)}) v(task, uri, direction, domain_match, range_match, declared, restriction, construction, exact_name, role_hits))
  SELECT task, uri, direction, round(score, 6) AS score FROM e QUALIFY row_number() OVER (PARTITION BY task ORDER BY score DESC, uri, direction) = 1""")
def deterministic_relations(spark: SparkSession, d: str) -> DataFrame:
    schema = "task string, uri string, direction string, domain_match double, range_match double, declared boolean, restriction boolean, construction boolean, exact_name boolean, role_hits int"
    return ranking.deterministic_property(spark.createDataFrame(_RELATIONS, schema)).withColumn("score", F.round("score", 6))


_EMPTY = [("review", "paper_id", t) for t in ("paper", "person", "papers", "review")] + [("review", "reviewer", t) for t in ("reviewer", "person")]


@query(f"""WITH p AS (SELECT * FROM ({_values(_EMPTY)}) v("table", "column", ref_table)), n AS (SELECT *, unnest([{{'a': "column", 'w': 0}}, {{'a': "table", 'w': 1}}]) AS u FROM p),
  s AS (SELECT "table", "column", ref_table, lower(regexp_replace(u.a, '[_\\-\\s]+', '', 'g')) AS x, lower(ref_table) AS y, regexp_split_to_array(lower(u.a), '_') AS ta FROM n),
  o AS (SELECT *, greatest(list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / greatest(length(x), length(y)), len(list_intersect(ta, [y])) / len(list_distinct(list_append(ta, y)))) AS o FROM s),
  m AS (SELECT "table", "column", ref_table, round(max(o), 3) AS score FROM o GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY score DESC, ref_table)::INT AS rank FROM m QUALIFY rank <= 3""")
def empty_key_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ranking.empty_fk_candidates(spark.createDataFrame(_EMPTY, "table string, column string, ref_table string"), 3)


_SCORES = [("solar", NS + "Solar", 0.95), ("solar", NS + "Wind", 0.2), ("wind", NS + "Wind", 0.96), ("wind", NS + "Solar", 0.9), ("grid", NS + "Grid", 0.6), ("grid", NS + "Solar", 0.55), ("x", NS + "Grid", 0.3)]
_BEST = f"SELECT *, score - coalesce(lead(score) OVER w, 0.0) AS gap, row_number() OVER w AS i FROM ({_values(_SCORES)}) v(value, uri, score) WINDOW w AS (PARTITION BY value ORDER BY score DESC, uri)"


@query(f"SELECT value, uri, score, round(gap, 6) AS gap, CASE WHEN score >= 0.9 AND gap >= 0.14 THEN 'high' WHEN score >= 0.58 AND gap >= 0.04 THEN 'medium' WHEN score >= 0.52 THEN 'weak' ELSE 'none' END AS level, score >= 0.9 AND gap > 0.14 AS locked FROM ({_BEST}) WHERE i = 1")
def enum_levels(spark: SparkSession, d: str) -> DataFrame:
    scores = spark.createDataFrame(_SCORES, "value string, uri string, score double")
    locked = evidence.lexical_locks(scores).select("value", F.lit(True).alias("_l"))
    return evidence.enum_decisions(scores).withColumn("gap", F.round("gap", 6)).join(locked, "value", "left").withColumn("locked", F.coalesce("_l", F.lit(False))).drop("_l")


_COVER = [("r1", "F", 10, 1.0), ("r1", "O", 10, 0.1), ("r2", "F", 10, 0.2), ("r2", "O", 2, 1.0), ("r3", "P", 5, 0.97), ("id", "P", 5, 1.0), ("r4", "Q", 9, 0.95), ("r5", "Q", 9, 0.96)]


@query(f"SELECT value, min(relation) AS relation FROM ({_values(_COVER)}) v(relation, value, total, ratio) WHERE relation <> 'id' AND ratio >= 0.95 AND total >= 3 GROUP BY 1 HAVING count(*) = 1")
def joined_contexts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.joined_context(spark.createDataFrame(_COVER, "relation string, value string, total int, ratio double"), ["id"])


@query(f"""WITH e AS (SELECT value, relation AS subtype, total, ratio FROM ({_values(_COVER)}) v(relation, value, total, ratio)), b AS (SELECT *, lead(ratio) OVER w AS n, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY value ORDER BY ratio DESC, subtype))
  SELECT value, subtype, ratio, total FROM b WHERE i = 1 AND ratio >= 0.95 AND total >= 3 AND ratio - coalesce(n, 0) >= 0.2""")
def strong_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.strong_subtype(spark.createDataFrame(_COVER, "subtype string, value string, total int, ratio double"))


@query("SELECT o_orderstatus AS value, min(o_orderpriority) AS uri FROM orders WHERE o_orderstatus <> 'O' AND (o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def relation_class_locks(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'O' and (o_orderstatus <> 'F' or o_orderpriority = '1-URGENT')")
    return evidence.relation_locks(o.select(F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("uri")))


@query("SELECT a.value, b.uri FROM (SELECT min(o_orderstatus) AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(DISTINCT o_orderstatus) = 1) a, (VALUES ('Pending')) b(uri)")
def residual_value(spark: SparkSession, d: str) -> DataFrame:
    values = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("value"))
    locked = spark.createDataFrame([("F", "Filled"), ("O", "Open")], "value string, uri string")
    return evidence.residual_branch(values, locked, spark.createDataFrame([("Filled",), ("Open",), ("Pending",)], "uri string"))


_RULE = [("a", "SE", 0), ("b", "SH", 1), ("c", "SE", 0), ("d", "SE", 1), ("e", "SE", 0)]
_AGENT = [("a", "SR"), ("b", "SE"), ("c", "SH"), ("d", "SR"), ("e", "SE")]


@query("SELECT * FROM (VALUES ('a', 'SR', 'empty'), ('b', 'SH', 'structure'), ('c', 'SH', 'match_rate'), ('d', 'SE', 'structure'), ('e', 'SE', 'agree')) v(\"table\", pattern, reason)")
def arbitrated_patterns(spark: SparkSession, d: str) -> DataFrame:
    frame = spark.createDataFrame
    return classify.arbitrate(frame(_RULE, "table string, pattern string, n_groups int"), frame(_AGENT, "table string, pattern string"), frame([("c", 0.9), ("c", 0.8), ("e", 1.0)], "table string, match_rate double"), frame([("a", 0), ("c", 5), ("d", 0)], "table string, n_rows long"))


@query(f"SELECT a.t AS \"table\", a.p AS \"rule\", b.p AS agent FROM (SELECT * FROM ({_values([r[:2] for r in _RULE])}) v(t, p)) a FULL JOIN (SELECT * FROM ({_values(_AGENT[:4])}) v(t, p)) b ON a.t = b.t WHERE a.p IS DISTINCT FROM b.p")
def differing_patterns(spark: SparkSession, d: str) -> DataFrame:
    frame = spark.createDataFrame
    return classify.differing(frame([r[:2] for r in _RULE], "table string, pattern string"), frame(_AGENT[:4], "table string, pattern string"))


_FOUND = [("paper", "ID", "document", "ID"), ("document", "ID", "paper", "ID"), ("review", "ID", "paper", "ID"), ("paper", "author", "person", "ID")]


@query(f"SELECT * FROM ({_values(_FOUND)}) v(\"table\", \"column\", ref_table, ref_column) WHERE NOT (\"table\" = 'document' AND ref_table = 'paper')")
def keys_without_reciprocals(spark: SparkSession, d: str) -> DataFrame:
    found = spark.createDataFrame(_FOUND, "table string, column string, ref_table string, ref_column string")
    return ind.drop_reciprocal(found, spark.createDataFrame([("paper", "document")], "child string, parent string"))


# ---------------------------------------------------------------- the ontology's parts

_ONTO = f"WITH RECURSIVE e AS (SELECT '{NS}' || a AS child, '{NS}' || b AS parent FROM (VALUES ('Agent', 'Thing'), ('Place', 'Thing'), ('Customer', 'Agent'), ('Supplier', 'Agent'), ('Nation', 'Place'), ('Region', 'Place'), ('Orders', 'Thing'), ('OpenOrder', 'Orders'), ('FilledOrder', 'Orders'), ('Part', 'Thing'), ('Documents', 'Thing'), ('Labels', 'Documents')) v(a, b)), c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.ancestor = e.child)"


@query(f"{_ONTO} SELECT child, ancestor FROM c")
def ontology_classes(spark: SparkSession, d: str) -> DataFrame:
    return demo.onto(spark).closed.select("child", "ancestor")


@query(f"SELECT '{NS}' || a AS a, '{NS}' || b AS b FROM (VALUES ('Agent', 'Place'), ('Orders', 'Part'), ('Documents', 'Orders'), ('Documents', 'Part')) v(a, b)")
def ontology_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return demo.onto(spark).disjoint


@query(f"""SELECT '{NS}' || u AS uri, side, '{NS}' || c AS class FROM (VALUES ('placedBy', 'domain', 'Orders'), ('placedBy', 'range', 'Customer'), ('inNation', 'domain', 'Customer'), ('inNation', 'domain', 'Supplier'), ('inNation', 'range', 'Nation'),
  ('inRegion', 'domain', 'Nation'), ('inRegion', 'range', 'Region'), ('contains', 'domain', 'Orders'), ('contains', 'range', 'Part')) v(u, side, c)""")
def ontology_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Unions of classes are expanded to their members."""
    onto = demo.onto(spark)
    return onto.endpoints.join(onto.properties.where("kind = 'object'"), "uri", "left_semi").select("uri", "side", "class")


@query(f"""{_ONTO}, p AS (SELECT '{NS}' || u AS uri, '{NS}' || c AS dom FROM (VALUES ('placedBy', 'Orders'), ('inNation', 'Customer'), ('inNation', 'Supplier'), ('inRegion', 'Nation'), ('contains', 'Orders'), ('status', 'Orders'), ('segment', 'Customer'), ('size', 'Part'), ('language', 'Documents'), ('flag', 'Orders'), ('name', NULL)) v(u, c)),
  s AS (SELECT '{NS}' || x AS subject FROM (VALUES ('Customer'), ('OpenOrder'), ('Labels')) v(x)) SELECT DISTINCT uri, subject FROM p, s WHERE dom IS NULL OR dom = subject OR EXISTS (SELECT 1 FROM c WHERE child = subject AND ancestor = dom)""")
def domain_compatible_properties(spark: SparkSession, d: str) -> DataFrame:
    onto = demo.onto(spark)
    subjects = spark.createDataFrame([(NS + x,) for x in ("Customer", "OpenOrder", "Labels")], "subject string")
    return ontology.domain_compatible(subjects, onto.endpoints, onto.closed)


@query(f"""{_ONTO}, f AS (SELECT child AS m, ancestor AS t FROM c UNION SELECT DISTINCT child, child FROM e UNION SELECT DISTINCT parent, parent FROM e), d AS (SELECT '{NS}' || a AS a, '{NS}' || b AS b FROM (VALUES ('Agent', 'Place'), ('Place', 'Agent'), ('Orders', 'Part'), ('Part', 'Orders'), ('Documents', 'Orders'), ('Orders', 'Documents'), ('Documents', 'Part'), ('Part', 'Documents')) v(a, b)),
  bad AS (SELECT DISTINCT x.m AS a, y.m AS b FROM d JOIN f x ON x.t = d.a JOIN f y ON y.t = d.b), h AS (SELECT n AS name, '{NS}' || h AS hint FROM (VALUES ('t1', 'Nation'), ('t2', 'OpenOrder'), ('t2', 'Customer'), ('t3', 'Labels')) v(n, h)), g AS (SELECT '{NS}' || u AS uri, '{NS}' || c AS dom FROM (VALUES ('inNation', 'Customer'), ('inNation', 'Supplier'), ('contains', 'Orders'), ('size', 'Part')) v(u, c))
  SELECT name, uri FROM h, g GROUP BY 1, 2 HAVING bool_and(EXISTS (SELECT 1 FROM bad WHERE bad.a = hint AND bad.b = dom))""")
def hard_disjoint_domains(spark: SparkSession, d: str) -> DataFrame:
    onto = demo.onto(spark)
    hints = spark.createDataFrame([(n, NS + h) for n, h in (("t1", "Nation"), ("t2", "OpenOrder"), ("t2", "Customer"), ("t3", "Labels"))], "name string, hint string")
    domains = spark.createDataFrame([(NS + u, NS + c) for u, c in (("inNation", "Customer"), ("inNation", "Supplier"), ("contains", "Orders"), ("size", "Part"))], "uri string, domain string")
    return ontology.hard_disjoint(hints, domains, ontology.incompatible(onto.disjoint, onto.closed))


_RESTRICTED = """@prefix : <http://shop.example/onto#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:A a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :X ] . :B a owl:Class ; rdfs:subClassOf :A , [ a owl:Restriction ; owl:onProperty :p ; owl:allValuesFrom :Y ] . :C a owl:Class ; rdfs:subClassOf :B .
:U a owl:Class ; owl:disjointUnionOf ( :V :W ) ."""


@query(f"SELECT '{NS}' || c AS class, '{NS}p' AS property, '{NS}' || f AS filler, n::INT AS distance FROM (VALUES ('A', 'X', 0), ('B', 'Y', 0), ('B', 'X', 1), ('C', 'Y', 1), ('C', 'X', 2)) v(c, f, n)")
def restriction_support(spark: SparkSession, d: str) -> DataFrame:
    return ontology.restriction_support(ontology.read(turtle.triples_frame(spark, turtle.parse(_RESTRICTED))))


@query(f"SELECT '{NS}' || a AS child, '{NS}' || b AS parent FROM (VALUES ('B', 'A'), ('C', 'B'), ('V', 'U'), ('W', 'U')) v(a, b)")
def disjoint_union_edges(spark: SparkSession, d: str) -> DataFrame:
    return ontology.read(turtle.triples_frame(spark, turtle.parse(_RESTRICTED))).edges


_MATCHES = [("A", "A"), ("B", "A"), ("D", "A"), ("A", "E"), (None, "A"), ("A", None), ("_:b", "A"), ("A", "D")]


@query(f"""{_CLOSED}, m AS (SELECT * FROM ({_values(_MATCHES)}) v(declared, actual)), k AS (SELECT declared, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN declared IS NULL THEN 'no-declared' WHEN starts_with(declared, '_:') THEN 'opaque' WHEN declared = actual THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM c WHERE child = actual AND ancestor = declared) THEN 'subclass' WHEN EXISTS (SELECT 1 FROM c WHERE child = declared AND ancestor = actual) THEN 'parent' ELSE 'conflict' END AS kind FROM m)
  SELECT *, CASE kind WHEN 'exact' THEN 1.0::DOUBLE WHEN 'subclass' THEN 0.78 WHEN 'parent' THEN 0.52 WHEN 'no-declared' THEN 0.12 WHEN 'opaque' THEN 0.12 ELSE 0.0 END AS weight FROM k""")
def class_match_kinds(spark: SparkSession, d: str) -> DataFrame:
    closed = ontology.closure(spark.createDataFrame(_EDGES, "child string, parent string"))
    up = closed.select(F.col("child").alias("actual"), F.col("ancestor").alias("declared"), F.lit(True).alias("_up"))
    down = closed.select(F.col("child").alias("declared"), F.col("ancestor").alias("actual"), F.lit(True).alias("_down"))
    m = spark.createDataFrame(_MATCHES, "declared string, actual string").join(up, ["declared", "actual"], "left").join(down, ["declared", "actual"], "left")
    kind = ontology.match_kind(F.col("declared"), F.col("actual"), F.coalesce("_up", F.lit(False)), F.coalesce("_down", F.lit(False)))
    return m.select("declared", "actual", kind.alias("kind"), ontology.kind_weight(kind).alias("weight"))


# ---------------------------------------------------------------- mappings as documents


@query("""SELECT * FROM (VALUES ('Orders', 'SELECT "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey" FROM "orders"'), ('OpenOrders', 'SELECT "o_orderkey", "o_orderstatus" FROM "orders" WHERE "o_orderstatus" = ''O'''),
  ('GoodDocuments', 'SELECT "doc_id", "quality" FROM "labels" WHERE "quality" = 1'), ('Flags', 'SELECT "l_orderkey", "l_returnflag" FROM "lineitem"')) v(name, sql)""")
def logical_tables(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m.name, r2rml.logical_table(m)) for m in (demo.ORDERS, demo.OPEN, demo.GOOD, demo.FLAGS)], "name string, sql string")


# ---------------------------------------------------------------- a whole graph

_PAPERS = """@prefix : <http://shop.example/onto#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Person a owl:Class . :Document a owl:Class . :Paper a owl:Class ; rdfs:subClassOf :Document . :Review a owl:Class ; rdfs:subClassOf :Document .
:writes a owl:ObjectProperty ; rdfs:domain :Person ; rdfs:range :Document . :hasReviewer a owl:ObjectProperty ; rdfs:domain :Review ; rdfs:range :Person .
:hasTitle a owl:DatatypeProperty ; rdfs:domain :Document ; rdfs:range xsd:string . :email a owl:DatatypeProperty ; rdfs:domain :Person ; rdfs:range xsd:string .
:hasEmail a owl:DatatypeProperty ; rdfs:domain :Person ; rdfs:range xsd:string ."""


def _papers(spark: SparkSession, d: str) -> Catalog:
    """Customers as people, documents as papers and reviews (subtypes with tables of their own), who writes what, and a table of values."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    docs = t("documents").select(F.col("doc_id").alias("ID"), F.col("lang").alias("title"), F.when(F.col("n_chars") > 500, "Paper").otherwise("Review").alias("doc_type"))
    people = t("customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("email"))
    tables = {
        "person": people,
        "document": docs,
        "paper": docs.where("doc_type = 'Paper'").select("ID"),
        "review": docs.where("doc_type = 'Review'").select("ID", (F.col("ID") % 100 + 1).alias("reviewer")),
        "writes": docs.select((F.col("ID") % 50 + 1).alias("person"), F.col("ID").alias("document")),
        "has_email": people.where("ID % 3 = 0").select(F.col("ID").alias("person"), F.concat("email", F.lit("@x")).alias("VALUE")),
    }
    keys = {n: ("ID",) for n in ("person", "document", "paper", "review")} | {"has_email": ("person", "VALUE")}
    ends = [("paper", "ID", "document"), ("review", "ID", "document"), ("review", "reviewer", "person"), ("writes", "person", "person"), ("writes", "document", "document"), ("has_email", "person", "person")]
    return Catalog(tables, keys, [ForeignKey(a, (c,), b, ("ID",)) for a, c, b in ends])


_DOC, _PERSON = "'http://example.com/document/' || doc_id", "'http://example.com/person/' || "
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@query(f"""WITH d AS (SELECT *, CASE WHEN n_chars > 500 THEN 'Paper' ELSE 'Review' END AS kind FROM documents),
  t AS (SELECT {_PERSON} c_custkey AS s, '{_TYPE}' AS p, '{NS}Person' AS o FROM customer UNION ALL SELECT {_PERSON} c_custkey, '{NS}email', c_name FROM customer UNION ALL SELECT {_PERSON} c_custkey, '{NS}hasEmail', c_name || '@x' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT {_DOC}, '{_TYPE}', '{NS}' || kind FROM d UNION ALL SELECT {_DOC}, '{NS}hasTitle', lang FROM d UNION ALL SELECT {_DOC}, '{NS}hasReviewer', {_PERSON} (doc_id % 100 + 1) FROM d WHERE kind = 'Review'
    UNION ALL SELECT {_PERSON} (doc_id % 50 + 1), '{NS}writes', {_DOC} FROM d)
  SELECT DISTINCT s, p, o FROM t WHERE o IS NOT NULL""")
def generated_graph(spark: SparkSession, d: str) -> DataFrame:
    """All triples that the pipeline's mapping gives: subtypes under their supertype's IRIs, classes by stored values, relations by tables and by columns, values as literals."""
    state = pipeline.Pipeline(spark, pipeline.Config(ind="off")).run(_papers(spark, d), ontology.read(turtle.triples_frame(spark, turtle.parse(_PAPERS))))
    return materialize.triples(state.catalog, state.mapping).select("s", "p", "o")


@query("""SELECT * FROM (VALUES ('document', 'SE', false), ('has_email', 'SE', true), ('paper', 'SH', false), ('person', 'SE', false), ('review', 'SH', false), ('writes', 'SR', false)) v("table", pattern, value_attr)""")
def pipeline_patterns(spark: SparkSession, d: str) -> DataFrame:
    state = pipeline.Pipeline(spark, pipeline.Config(ind="off")).run(_papers(spark, d), ontology.read(turtle.triples_frame(spark, turtle.parse(_PAPERS))), until="patterns")
    return spark.createDataFrame([(t, p, t in state.value_attrs) for t, p in state.patterns.items()], "table string, pattern string, value_attr boolean")


@query(f"SELECT name, \"table\", subject, n_properties FROM ({_values([(m.name, m.table, m.subject, len(m.properties)) for m in demo.FULL.maps])}) v(name, \"table\", subject, n_properties)")
def mapping_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The mapping written as an R2RML document and read again."""
    back = r2rml.read(r2rml.write(demo.FULL))
    return spark.createDataFrame([(m.name, m.table, m.subject, len(m.properties)) for m in back.maps], "name string, table string, subject string, n_properties int")
