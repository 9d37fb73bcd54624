"""What the stored values of a discriminator column say about classes.

For one column all evidence is gathered as small tables by value (names, subtype membership, coverage by each relation,
boolean columns), then decided in a fixed order: an only numeric code by a subtype table that has its rows; values that
name a class; values that a relation ties to one class; rules, if the column looks like an enumeration with structure;
the last value and the last class; and a selector for what is left.  The default selector abstains: then only locked
values are kept, and tentative ones if the caller accepts them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import names as N
from lodestrata.functions import types as T
from lodestrata.operators import evidence, profile, ranking
from lodestrata.operators import ontology as O
from lodestrata.plans.align import Abstain, Choice, Selector, TableAlignment, TypeAssertion, identity, key_of
from lodestrata.sources.catalog import Catalog

#: Limits of what is looked at, and thresholds of the rules.
MAX_VALUES, PER_VALUE, MAX_INCOMING = 20, 8, 8
SIGNAL, REPEATED, CODE_VALUES, DESCENDANT, BASE = 0.22, 0.45, 12, 0.55, 0.6
SURE, CLEAR, NAMED, BOOLEAN_LEAST = 0.95, 0.14, 0.90, 0.9


@dataclass
class Context:
    """Evidence for one column; frames have a row for each value and class, subtype or relation."""

    coverage: DataFrame | None = None  # relation, value, total, ratio
    hints: DataFrame | None = None  # relation, kind, uri, name, score, edge
    subtypes: DataFrame | None = None  # value, subtype, total, present, ratio
    subtype_classes: dict[str, str] = field(default_factory=dict)
    identity_relations: list[str] = field(default_factory=list)


def _family(onto: O.Ontology, uri: str | None) -> list[str]:
    if uri is None:
        return []
    return sorted(r["child"] for r in onto.closed.where(F.col("ancestor") == uri).select("child").distinct().collect())  # of ontology size


def gather(spark: SparkSession, catalog: Catalog, alignment: dict[str, TableAlignment], table: str, column: str) -> Context:
    """Coverage of each value by the relations around the table, what these are called, and the subtype tables' share of its rows."""
    key, df, out = key_of(catalog, table), catalog.tables[table], Context()
    hints, covers, shares = [], [], []
    if len(key) == 1:
        around = [k for k in catalog.foreign_keys if len(k.columns) == 1 and k.ref_table == table and k.ref_columns == key and k.table in catalog.tables]
        for k in around[:MAX_INCOMING]:
            relation = f"{k.table}.{k.columns[0]}"
            covers.append(evidence.coverage_incoming(df, key[0], column, catalog.tables[k.table], k.columns[0]).withColumn("relation", F.lit(relation)))
            a = alignment.get(k.table)
            if a and a.pattern == "SH" and set(catalog.primary_keys.get(k.table, ())) == set(k.columns):
                out.identity_relations.append(relation)
            edge = 1.0 if k.source == "physical" else 0.7
            if a and a.class_uri:
                hints.append((relation, "class", a.class_uri, a.class_uri.rpartition("#")[2], 1.0, edge))
            hints += [(relation, "name", None, n, 0.0, edge) for n in (k.table, k.columns[0])]
        for k in catalog.fks_of(table):
            if len(k.columns) == 1 and k.columns != key and k.ref_table in catalog.tables:
                relation = f"{table}.{k.columns[0]}"
                covers.append(evidence.coverage_outgoing(df, key[0], column, k.columns[0], catalog.tables[k.ref_table], k.ref_columns[0]).withColumn("relation", F.lit(relation)))
                hints.append((relation, "name", None, k.columns[0], 0.0, 1.0))
    for t, a in sorted(alignment.items()):
        if a.pattern == "SH" and t != table and a.class_uri and t in catalog.tables:
            root, columns = identity(catalog, alignment, t)
            if root == identity(catalog, alignment, table)[0] and len(columns) == len(key):
                shares.append(evidence.subtype_evidence(df, list(key), column, catalog.tables[t], list(columns), t))
                out.subtype_classes[t] = a.class_uri
    if covers:
        out.coverage = reduce(DataFrame.unionByName, covers).cache()
    if hints:
        out.hints = spark.createDataFrame(hints, "relation string, kind string, uri string, name string, score double, edge double")
    if shares:
        out.subtypes = reduce(DataFrame.unionByName, shares).cache()
    return out


def _gate(df: DataFrame, column: str, context: Context, n_classes: int) -> tuple[bool, float]:
    """Whether rules may speak: an enumeration whose relations differ by value, or short repeated codes over known subclasses."""
    d = profile.enum_diagnostics(df, [column], PER_VALUE).first()
    signal = evidence.structure_signal(context.coverage).first()[0] if context.coverage is not None else 0.0
    codes = d["short_ratio"] >= 0.8 and d["numeric_ratio"] >= 0.4 and d["repeated_ratio"] >= REPEATED and n_classes >= 1 and d["distinct"] <= CODE_VALUES
    return bool(d["likely_enum"] and (signal >= SIGNAL or codes)), signal


def map_enum(spark: SparkSession, catalog: Catalog, alignment: dict[str, TableAlignment], onto: O.Ontology, table: str, column: str, selector: Selector | None = None, accept_tentative: bool = False) -> TypeAssertion:
    """Value to class for one column; nothing is guessed where evidence is missing, tied or incomplete."""
    selector = selector or Abstain()
    a, df = alignment[table], catalog.tables[table]
    family = _family(onto, a.class_uri)
    values = profile.enum_profile(df, column, MAX_VALUES).cache()
    listed = [(r["value"], r["complete"]) for r in values.orderBy("value").collect()]  # at most MAX_VALUES
    every = [v for v, _ in listed]
    if not family or not every:
        return TypeAssertion(column, "enum", {}, [_stored(v) for v in every], confidence="low")
    numeric = all(v.lstrip("-").isdigit() for v in every)
    context = gather(spark, catalog, alignment, table, column)
    locked: dict[str, str] = {}
    tentative: dict[str, str] = {}
    ruled = 0

    strong = {r["value"]: context.subtype_classes[r["subtype"]] for r in evidence.strong_subtype(context.subtypes).collect()} if context.subtypes is not None else {}
    if len(every) == 1 and numeric:
        if every[0] in strong and strong[every[0]] in family:
            return TypeAssertion(column, "enum", {every[0]: [strong[every[0]]]}, confidence="high")
        joined = context.coverage is not None and evidence.joined_context(context.coverage, context.identity_relations).count() == 1
        direct = sorted(r["child"] for r in onto.edges.where(F.col("parent") == a.class_uri).collect())
        picked = selector.choose("enum", f"{table}.{column}={every[0]}", [Choice(u, BASE) for u in direct]) if joined and direct else None
        return TypeAssertion(column, "enum", {every[0]: [picked]} if picked in direct else {}, [] if picked in direct else [_stored(every[0])], confidence="medium" if picked in direct else "low")

    classes = spark.createDataFrame([(u, u.rpartition("#")[2] or u, DESCENDANT, True, False, True) for u in family] + [(a.class_uri, a.class_uri.rpartition("#")[2], BASE, False, True, True)], "uri string, local_name string, base double, is_descendant boolean, is_current boolean, has_descendants boolean").cache()
    scored = values.select("value").join(F.broadcast(classes), F.lit(True)).select("value", "uri", N.value_class_score(F.col("value"), F.col("local_name")).alias("score"))
    locked |= {r["value"]: r["uri"] for r in evidence.lexical_locks(scored, NAMED, CLEAR).collect()}
    locked |= _relation_locks(spark, catalog, onto, table, column, family)  # may overrule a name

    open_gate, _ = _gate(df, column, context, len(family))
    if open_gate:
        sub = None
        if context.subtypes is not None:
            named = spark.createDataFrame(list(context.subtype_classes.items()), "subtype string, uri string")
            sub = context.subtypes.join(F.broadcast(named), "subtype").select("value", "uri", "ratio")
        booleans = [c for c, k in catalog.types(table).items() if T.family(k) == "boolean"]
        support = evidence.boolean_support(df, column, booleans) if booleans else None
        asserted = _asserted(spark, a, onto)
        scores = evidence.enum_rule_scores(values, classes, column, sub, context.coverage, context.hints, support, asserted)
        for r in evidence.enum_decisions(scores, numeric).collect():
            ruled += r["level"] != "none"
            if r["level"] == "high" and r["value"] not in locked:
                locked[r["value"]] = r["uri"]
            elif r["level"] in ("medium", "weak"):
                tentative[r["value"]] = r["uri"]

    proven = {v: u for v, u in strong.items() if u in family}
    if len(every) - len(proven) == 1 and all(c for _, c in listed):
        rest = evidence.residual_branch(values, spark.createDataFrame(list(proven.items()), "value string, uri string"), spark.createDataFrame([(u,) for u in family], "uri string")).first() if proven else None
        if rest and rest["value"] not in locked:
            locked[rest["value"]] = rest["uri"]

    options = [Choice(u, DESCENDANT, u.rpartition("#")[2]) for u in family]
    final = dict(locked)
    for v in every:
        if v not in final:
            picked = selector.choose("enum", f"{table}.{column}={v}", options)
            if picked in family:
                final[v] = picked
            elif accept_tentative and v in tentative:
                final[v] = tentative[v]
    rest = [_stored(v) for v in every if v not in final]
    sure = not rest and (ruled >= len(every) - 1 or len(locked) == len(every))
    return TypeAssertion(column, "enum", {v: [u] for v, u in sorted(final.items())}, rest, confidence="high" if sure else "medium" if final else "low")


def _stored(value: str) -> str | int:
    return int(value) if value.isdigit() else value


def _relation_locks(spark: SparkSession, catalog: Catalog, onto: O.Ontology, table: str, column: str, family: list[str]) -> dict[str, str]:
    """Values whose rows are all linked by a foreign key that no other value's rows have, where the property of that name belongs to one class of the family."""
    supported = []
    for k in catalog.fks_of(table):
        if len(k.columns) != 1 or k.ref_table not in catalog.tables or k.columns == (column,):
            continue
        found = evidence.relation_domain_evidence(catalog.tables[table], column, k.columns[0], catalog.tables[k.ref_table], k.ref_columns[0]).where("locks")
        same = N.alphanumeric(N.strip_wrapper(N.local_name(F.col("uri")))) == N.alphanumeric(F.lit(k.columns[0]))
        owners = onto.endpoints.where(same & (F.col("side") == "domain") & F.col("class").isin(family)).select(F.col("class").alias("uri")).distinct()
        supported.append(found.select("value").join(F.broadcast(owners), F.lit(True)))
    if not supported:
        return {}
    return {r["value"]: r["uri"] for r in evidence.relation_locks(reduce(DataFrame.unionByName, supported)).collect()}


def _asserted(spark: SparkSession, a: TableAlignment, onto: O.Ontology) -> DataFrame | None:
    """column, uri, distance for boolean columns that mark a class: the class and its ancestors."""
    marks = [(x.column, x.true_class) for x in a.assertions if x.kind == "boolean" and x.true_class]
    if not marks:
        return None
    own = spark.createDataFrame(marks, "column string, true_class string")
    up = onto.closed.select(F.col("child").alias("true_class"), F.col("ancestor").alias("uri"), "distance")
    return own.select("column", F.col("true_class").alias("uri"), F.lit(0).alias("distance")).unionByName(own.join(up, "true_class").select("column", "uri", "distance"))


def map_boolean(spark: SparkSession, onto: O.Ontology, class_uri: str | None, column: str, selector: Selector | None = None) -> TypeAssertion:
    """The class that a true value stands for, by the column's name among the descendants of the table's class."""
    family = _family(onto, class_uri)
    if not family:
        return TypeAssertion(column, "boolean")
    bare = column.removeprefix("is_").removeprefix("has_")
    options = spark.createDataFrame([(u,) for u in family], "uri string")
    ranked = ranking.boolean_classes(ranking.rank_classes(spark.createDataFrame([(bare,)], "name string"), options, len(family))).cache()
    best = ranking.confidence(ranked).first()
    if best and best["score"] >= BOOLEAN_LEAST and best["gap"] > 0:
        return TypeAssertion(column, "boolean", true_class=best["uri"], confidence=best["confidence"])
    choices = [Choice(r["uri"], r["score"], r["local_name"]) for r in ranked.orderBy("rank").collect()]
    picked = (selector or Abstain()).choose("boolean", column, choices)
    return TypeAssertion(column, "boolean", true_class=picked if picked in family else None, confidence="medium" if picked in family else "low")


def assert_all(spark: SparkSession, catalog: Catalog, alignment: dict[str, TableAlignment], onto: O.Ontology, selector: Selector | None = None, accept_tentative: bool = False) -> None:
    """Booleans first, since they support the enumerations; an assertion without any class is left out."""
    for kind in ("boolean", "enum"):
        for t, a in sorted(alignment.items()):
            for c in a.columns.values():
                boolean = T.family(c.sql_type) == "boolean"
                if c.role != "discriminator" or boolean != (kind == "boolean") or a.class_uri is None:
                    continue
                x = map_boolean(spark, onto, a.class_uri, c.column, selector) if boolean else map_enum(spark, catalog, alignment, onto, t, c.column, selector, accept_tentative)
                if x.true_class or x.value_to_class:
                    a.assertions.append(x)
