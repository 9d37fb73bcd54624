"""From a mapping and a catalog to triples.

Every map is one projection of its table; all its triples come from one scan (an array of structs per row, exploded).
Joins appear only for objects that name another map's rows.  A null in a template or column gives no triple.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.iri import expand
from lodestrata.plans.r2rml import Condition, Mapping, ObjectMap, TriplesMap
from lodestrata.sources.catalog import Catalog
from lodestrata.sources.turtle import RDF, XSD

SCHEMA = "s string, p string, o string, o_kind string, datatype string"
TYPE = RDF + "type"


def condition_column(df: DataFrame, condition: Condition) -> Column:
    kind = df.schema[condition.column].dataType
    value = condition.value
    if isinstance(value, str) and value.lstrip("-").isdigit() and kind.typeName() != "string":
        value = int(value)
    if not isinstance(value, bool) and isinstance(value, int) and kind.typeName() == "string":
        return F.expr(f"try_cast(`{condition.column}` as bigint)") == F.lit(value)  # digits compare as a number
    return F.col(f"`{condition.column}`") == F.lit(value).cast(kind)


def rows_of(catalog: Catalog, m: TriplesMap) -> DataFrame:
    df = catalog.tables[m.table]
    return df.where(condition_column(df, m.condition)) if m.condition else df


def subject_of(m: TriplesMap) -> Column:
    return F.col(f"`{m.subject.strip('{}')}`").cast("string") if m.subject_is_iri_column else expand(m.subject)


def lexical(df: DataFrame, column: str, datatype: str | None) -> Column:
    """The literal's lexical form: ISO for dates and times, true and false, and integral numbers without a fraction."""
    kind, c = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if datatype and datatype.endswith("date") and kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd")
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def _full(datatype: str | None) -> str:
    return (datatype or "xsd:string").replace("xsd:", XSD)


def _term(df: DataFrame, o: ObjectMap) -> tuple[Column, str, str | None]:
    """Value, kind and datatype of an object that needs no join."""
    if o.template:
        return expand(o.template), "iri", None
    if o.constant:
        return F.lit(o.constant), "iri", None
    if o.iri:
        return F.col(f"`{o.column}`").cast("string"), "iri", None
    return lexical(df, o.column, o.datatype), "literal", _full(o.datatype)


def map_triples(catalog: Catalog, mapping: Mapping, m: TriplesMap) -> DataFrame:
    df = rows_of(catalog, m)
    cell = lambda p, o, kind, datatype: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"))
    cells = [cell(TYPE, F.lit(c), "iri", None) for c in m.classes]
    cells += [cell(po.predicate, *_term(df, po.object)) for po in m.properties if not po.object.parent]
    parts = []
    if cells:
        flat = df.select(subject_of(m).alias("s"), F.explode(F.array(*cells)).alias("x")).select("s", "x.*")
        parts.append(flat.where("s is not null and o is not null"))
    for po in m.properties:
        if po.object.parent:
            parts.append(_joined(catalog, mapping, m, po.predicate, po.object))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], SCHEMA)


def _joined(catalog: Catalog, mapping: Mapping, m: TriplesMap, predicate: str, o: ObjectMap) -> DataFrame:
    parent = mapping.named(o.parent)
    child = rows_of(catalog, m).select(subject_of(m).alias("s"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, (c, _) in enumerate(o.joins)])
    there = rows_of(catalog, parent).select(subject_of(parent).alias("o"), *[F.col(f"`{p}`").alias(f"_p{i}") for i, (_, p) in enumerate(o.joins)])
    both = child.join(there, [F.col(f"_c{i}") == F.col(f"_p{i}") for i in range(len(o.joins))])
    out = both.select("s", F.lit(predicate).alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"))
    return out.where("s is not null and o is not null")


def triples(catalog: Catalog, mapping: Mapping, distinct: bool = True) -> DataFrame:
    """All triples; a graph is a set, so repeats go unless the caller knows that there are none."""
    all_maps = reduce(DataFrame.unionByName, [map_triples(catalog, mapping, m) for m in mapping.maps])
    return all_maps.distinct() if distinct else all_maps


def write(graph: DataFrame, path: str) -> None:
    """Parquet by predicate, so that a query reads the predicates that it names."""
    graph.write.partitionBy("p").parquet(path)
