"""From tables, patterns and an ontology to an alignment: a class for every table, a role and a property for every column.

Rankings run as window plans over schema x ontology; what comes back is a row for each candidate kept, and the rest is
bookkeeping over tables and columns.  A decision that the rankings leave open goes to a ``Selector``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import names as N
from lodestrata.functions import types as T
from lodestrata.operators import ontology as O
from lodestrata.operators import ranking
from lodestrata.sources.catalog import Catalog, ForeignKey


@dataclass(frozen=True)
class Choice:
    uri: str
    score: float
    local_name: str = ""


class Selector(Protocol):
    def choose(self, task: str, subject: str, candidates: list[Choice]) -> str | None:
        """One of the candidates' URIs, or None.  Anything else counts as the stated fallback of the task."""


class TopChoice:
    """The default: the first class, and the first property if its score reaches ``least``."""

    def __init__(self, least: float = 0.4):
        self.least = least

    def choose(self, task: str, subject: str, candidates: list[Choice]) -> str | None:
        if not candidates:
            return None
        return candidates[0].uri if task == "class" or candidates[0].score >= self.least else None


class Abstain:
    def choose(self, task: str, subject: str, candidates: list[Choice]) -> str | None:
        return None


@dataclass
class TypeAssertion:
    column: str
    kind: str  # enum or boolean
    value_to_class: dict[str, list[str]] = field(default_factory=dict)
    unmapped: list[str] = field(default_factory=list)
    true_class: str | None = None
    confidence: str = "low"


@dataclass
class ColumnAlignment:
    column: str
    role: str  # pk, fk_obj, data_attr, discriminator, sh_inherited_pk, fk_disabled
    property: str | None = None
    confidence: str = "low"
    candidates: list[Choice] = field(default_factory=list)
    sql_type: str = "string"
    datatype: str = "xsd:string"


@dataclass
class TableAlignment:
    table: str
    pattern: str
    class_uri: str | None = None
    class_confidence: str = "low"
    columns: dict[str, ColumnAlignment] = field(default_factory=dict)
    assertions: list[TypeAssertion] = field(default_factory=list)
    value_attr: bool = False
    key_only: bool = False


def roles(catalog: Catalog, table: str, pattern: str) -> dict[str, str]:
    """The role of each column by its pattern and keys; a discriminator's name goes before everything but keys."""
    pk = set(catalog.primary_keys.get(table, ()))
    fks = catalog.fks_of(table)
    in_fk = {c for k in fks for c in k.columns}
    inherited = {c for k in fks if set(k.columns) == pk for c in k.columns} if pattern == "SH" else set()
    out = {}
    for c in catalog.types(table):
        low = c.lower().replace("_", "")
        discriminator = low in N.DISCRIMINATOR_NAMES or low.endswith(N.DISCRIMINATOR_SUFFIXES)
        if c in inherited or (pattern == "SH" and c == "ID" and c in pk):
            out[c] = "sh_inherited_pk"
        elif c in in_fk:
            out[c] = "fk_obj"
        elif c in pk:
            out[c] = "pk"
        elif discriminator or T.family(catalog.types(table)[c]) == "boolean":
            out[c] = "discriminator"
        else:
            out[c] = "data_attr"
    return out


def _by_name(rows: DataFrame) -> dict[str, list[Choice]]:
    out: dict[str, list[Choice]] = {}
    for r in rows.orderBy("name", "rank").collect():  # top_k rows for each name of the schema
        out.setdefault(r["name"], []).append(Choice(r["uri"], r["score"], r["uri"].rpartition("#")[2]))
    return out


def _confidences(rows: DataFrame) -> dict[str, str]:
    return {r["name"]: r["confidence"] for r in ranking.confidence(rows).collect()}


def datatype_scores(spark: SparkSession, onto: O.Ontology, columns: list[tuple[str, str, str | None, str]]) -> DataFrame:
    """name, uri, name_score, domain_score of admissible properties.  ``columns``: name, column, class, SQL family."""
    c = spark.createDataFrame(columns, "name string, column string, hint string, family string")
    props = onto.properties.where("kind = 'datatype'").select("uri")
    pairs = c.join(F.broadcast(props), F.lit(True)).withColumn("name_score", N.name_overlap(F.col("column"), N.local_name(F.col("uri"))))
    domain = O.hint_match(c.select("hint"), onto.endpoints.where("side = 'domain'"), onto.closed).select(F.col("hint").alias("_h"), "uri", F.col("score").alias("domain_score"))
    pairs = pairs.join(domain, ["uri"]).where(F.col("hint").eqNullSafe(F.col("_h")))
    subjects = c.where("hint is not null").select(F.col("hint").alias("subject")).distinct()
    fits = O.domain_compatible(subjects, onto.endpoints, onto.closed).select("uri", F.col("subject").alias("hint"), F.lit(True).alias("_fits"))
    pairs = pairs.join(fits, ["uri", "hint"], "left").where(F.col("hint").isNull() | F.col("_fits"))
    ranges = onto.endpoints.where("side = 'range' and class is not null").groupBy("uri").agg(F.collect_set(_xsd_family(F.col("class"))).alias("_ranges"))
    pairs = pairs.join(ranges, "uri", "left")
    open_ = F.col("_ranges").isNull() | (F.col("family") == "unknown") | F.exists("_ranges", lambda r: r.isin("unknown", "text") | (r == F.col("family")) | ((r == "boolean") & (F.col("family") == "numeric")))
    return pairs.where(open_).select("name", "uri", "name_score", "domain_score")


def _xsd_family(uri):
    table = F.create_map(*[x for k, v in T.XSD_FAMILIES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(uri, "#", -1))), F.lit("unknown"))


def object_scores(spark: SparkSession, onto: O.Ontology, relations: list[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """name, uri, syntax_score, domain_score, range_score of object properties.  ``relations``: name, hint name, domain class, range class."""
    r = spark.createDataFrame(relations, "name string, hint_name string, domain string, range string")
    pairs = r.join(F.broadcast(onto.properties.where("kind = 'object'").select("uri")), F.lit(True)).withColumn("syntax_score", N.name_overlap(F.col("hint_name"), N.local_name(F.col("uri"))))
    for side in ("domain", "range"):
        match = O.hint_match(r.select(F.col(side).alias("hint")), onto.endpoints.where(F.col("side") == side), onto.closed)
        match = match.select(F.col("hint").alias("_h"), F.col("uri").alias("_u"), F.col("score").alias(f"{side}_score"))
        pairs = pairs.join(match, (F.col("uri") == F.col("_u")) & F.col(side).eqNullSafe(F.col("_h"))).drop("_h", "_u")
    return pairs.select("name", "uri", "syntax_score", "domain_score", "range_score")


def align(catalog: Catalog, patterns: dict[str, str], onto: O.Ontology, selector: Selector | None = None, value_attrs: set[str] = frozenset(), key_only: set[str] = frozenset(), top_k: int = 5, disabled: frozenset[str] = frozenset()) -> dict[str, TableAlignment]:
    """Classes first, then datatype properties under the chosen classes; a high confidence takes the first candidate, anything else the selector."""
    selector = selector or TopChoice()
    spark = onto.classes.sparkSession
    tables = [t for t in catalog.names() if patterns.get(t, "SE") not in disabled]
    scored = ranking.rank_classes(spark.createDataFrame([(t,) for t in tables], "name string"), onto.classes.where(~F.startswith("uri", F.lit(T.XSD))), 1_000_000)
    ranked = ranking.exact_first(scored, top_k).cache()
    choices, sure = _by_name(ranked), _confidences(ranked)
    out = {}
    for t in tables:
        a = TableAlignment(t, patterns.get(t, "SE"), value_attr=t in value_attrs, key_only=t in key_only)
        options = choices.get(t, [])
        if a.pattern != "SR" and not a.value_attr:
            picked = options[0].uri if sure.get(t) == "high" else selector.choose("class", t, options)
            a.class_uri = picked if picked in {o.uri for o in options} else (options[0].uri if options else None)
        a.class_confidence = sure.get(t, "low")
        own = roles(catalog, t, a.pattern)
        if a.value_attr:  # (entity, value): the value is an attribute of the entity, whatever the key says
            own |= {c: "data_attr" for c in own if c not in {x for k in catalog.fks_of(t) for x in k.columns}}
        a.columns = {c: ColumnAlignment(c, r, sql_type=catalog.types(t)[c]) for c, r in own.items()}
        out[t] = a
    owner = {t: out[k.ref_table].class_uri for t, a in out.items() if a.value_attr for k in catalog.fks_of(t) if k.ref_table in out}
    # a table of values is named for what it says; its column may be called anything
    wanted = [(f"{t}.{c.column}", t if a.value_attr else c.column, owner.get(t, a.class_uri), T.family(c.sql_type)) for t, a in out.items() for c in a.columns.values() if c.role == "data_attr"]
    if wanted:
        scored = ranking.rank_datatype_properties(datatype_scores(spark, onto, wanted), top_k).cache()
        choices, sure = _by_name(scored), _confidences(scored)
        ranges = {r["uri"]: r["class"] for r in onto.endpoints.where("side = 'range' and class is not null").collect()}
        for t, a in out.items():
            for c in a.columns.values():
                if c.role == "data_attr":
                    name = f"{t}.{c.column}"
                    c.candidates, c.confidence = choices.get(name, []), sure.get(name, "low")
                    picked = c.candidates[0].uri if c.confidence == "high" else selector.choose("data_property", name, c.candidates)
                    c.property = picked if picked in {o.uri for o in c.candidates} else None
                    c.datatype = T.xsd_of(c.sql_type, [ranges[c.property]] if c.property in ranges else [])
    return out


def low_confidence(alignment: dict[str, TableAlignment], least_columns: int = 3, share: float = 0.25) -> dict[str, dict]:
    """Tables to look at again: an unsure class, at least three or a quarter unsure columns, or an unsure type assertion."""
    report = {}
    for t, a in alignment.items():
        asked = [c for c in a.columns.values() if c.role in ("data_attr", "fk_obj")]
        low = [c.column for c in asked if c.confidence != "high"]
        table_low = a.class_confidence == "low"
        types_low = any(x.confidence == "low" or (x.kind == "enum" and not x.value_to_class) or (x.kind == "boolean" and not x.true_class) for x in a.assertions)
        if a.pattern == "SR":
            if table_low:
                report[t] = {"table_low": True, "columns_low": []}
        elif table_low or types_low or len(low) >= least_columns or (asked and len(low) / len(asked) >= share):
            report[t] = {"table_low": table_low, "columns_low": low}
    return report


def trim(report: dict[str, dict], most: int) -> dict[str, dict]:
    """The ``most`` worst tables; none if it is not positive."""
    ordered = sorted(report.items(), key=lambda x: (-x[1]["table_low"], -len(x[1]["columns_low"]), x[0]))
    return dict(ordered[:most]) if most > 0 else {}


def identity(catalog: Catalog, alignment: dict[str, TableAlignment], table: str) -> tuple[str, tuple[str, ...]]:
    """The table whose name makes a row's IRI, and the row's own key columns in that table's key order.

    A subtype follows the foreign key on its whole key, up to a table that isn't a subtype; a chain that breaks or
    comes back to itself falls back to the table itself.
    """
    key, at, seen = key_of(catalog, table), table, {table}
    columns = key
    while alignment[at].pattern == "SH" if at in alignment else False:
        own = catalog.primary_keys.get(at, ())
        up = [k for k in catalog.fks_of(at) if set(k.columns) == set(own) or (k.columns == ("ID",) and k.ref_columns == ("ID",))]
        up = [k for k in up if set(k.ref_columns) == set(catalog.primary_keys.get(k.ref_table, ())) and k.ref_table != at]
        if len({k.ref_table for k in up}) != 1 or up[0].ref_table in seen:
            return table, key
        link = up[0]
        order = dict(zip(link.ref_columns, link.columns, strict=True))
        own_order = own if set(link.columns) == set(own) else link.columns
        position = dict(zip(own_order, columns if len(columns) == len(own_order) else link.columns, strict=True))
        columns = tuple(position[order[c]] for c in catalog.primary_keys[link.ref_table])
        at = link.ref_table
        seen.add(at)
    return at, columns


def key_of(catalog: Catalog, table: str) -> tuple[str, ...]:
    """Primary key, else the foreign-key columns in table order, else columns that look like identifiers, else none."""
    if catalog.primary_keys.get(table):
        return tuple(catalog.primary_keys[table])
    in_fk = {c for k in catalog.fks_of(table) for c in k.columns}
    own = [c for c in catalog.types(table) if c in in_fk]
    if own:
        return tuple(own)
    return tuple([c for c in catalog.types(table) if c.lower() == "id" or c.lower().endswith(("_id", "id", "key"))][:1])


def is_identity(catalog: Catalog, alignment: dict[str, TableAlignment], k: ForeignKey) -> bool:
    """Whether a foreign key only says which row of the supertype this one is."""
    a = alignment.get(k.table)
    return bool(a and a.pattern == "SH" and (set(k.columns) == set(catalog.primary_keys.get(k.table, ())) or (k.columns == ("ID",) and k.ref_columns == ("ID",))))
