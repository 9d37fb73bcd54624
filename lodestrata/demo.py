"""A catalog, an ontology and a mapping for the star schema of orders, on which the queries run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestrata.operators import ontology
from lodestrata.plans.r2rml import Condition, Mapping, ObjectMap, PredicateObject, TriplesMap
from lodestrata.sources import turtle
from lodestrata.sources.catalog import Catalog, ForeignKey

NS = "http://shop.example/onto#"
BASE = "http://example.com/"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations"]
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"),
}
REFERENCES = [
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ForeignKey("labels", ("doc_id",), "documents", ("doc_id",)),
    ForeignKey("events", ("user_id",), "customer", ("c_custkey",)),
]

ONTOLOGY = """
@prefix : <http://shop.example/onto#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Thing a owl:Class . :Agent a owl:Class ; rdfs:subClassOf :Thing . :Place a owl:Class ; rdfs:subClassOf :Thing .
:Customer a owl:Class ; rdfs:subClassOf :Agent . :Supplier a owl:Class ; rdfs:subClassOf :Agent .
:Nation a owl:Class ; rdfs:subClassOf :Place . :Region a owl:Class ; rdfs:subClassOf :Place .
:Orders a owl:Class ; rdfs:subClassOf :Thing . :OpenOrder a owl:Class ; rdfs:subClassOf :Orders . :FilledOrder a owl:Class ; rdfs:subClassOf :Orders .
:Part a owl:Class ; rdfs:subClassOf :Thing . :Documents a owl:Class ; rdfs:subClassOf :Thing . :Labels a owl:Class ; rdfs:subClassOf :Documents .
:Agent owl:disjointWith :Place . [] a owl:AllDisjointClasses ; owl:members ( :Orders :Part :Documents ) .
:placedBy a owl:ObjectProperty ; rdfs:domain :Orders ; rdfs:range :Customer .
:inNation a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( :Customer :Supplier ) ] ; rdfs:range :Nation .
:inRegion a owl:ObjectProperty ; rdfs:domain :Nation ; rdfs:range :Region .
:contains a owl:ObjectProperty ; rdfs:domain :Orders ; rdfs:range :Part .
:name a owl:DatatypeProperty ; rdfs:range xsd:string . :status a owl:DatatypeProperty ; rdfs:domain :Orders ; rdfs:range xsd:string .
:segment a owl:DatatypeProperty ; rdfs:domain :Customer ; rdfs:range xsd:string . :size a owl:DatatypeProperty ; rdfs:domain :Part ; rdfs:range xsd:int .
:language a owl:DatatypeProperty ; rdfs:domain :Documents ; rdfs:range xsd:string . :flag a owl:DatatypeProperty ; rdfs:domain :Orders .
"""


def _template(table: str, *columns: str) -> str:
    return f"{BASE}{table}/" + "__".join("{" + c + "}" for c in columns)


def _literal(name: str, column: str, datatype: str = "xsd:string") -> PredicateObject:
    return PredicateObject(NS + name, ObjectMap(column, datatype=datatype))


def _link(name: str, table: str, *columns: str) -> PredicateObject:
    return PredicateObject(NS + name, ObjectMap(template=_template(table, *columns)))


REGION = TriplesMap("Region", "region", _template("region", "r_regionkey"), (NS + "Region",), (_literal("name", "r_name"),), key=("r_regionkey",))
NATION = TriplesMap("Nation", "nation", _template("nation", "n_nationkey"), (NS + "Nation",), (_literal("name", "n_name"), _link("inRegion", "region", "n_regionkey")), key=("n_nationkey",))
CUSTOMER = TriplesMap("Customer", "customer", _template("customer", "c_custkey"), (NS + "Customer",), (_literal("name", "c_name"), _literal("segment", "c_mktsegment"), _link("inNation", "nation", "c_nationkey")), key=("c_custkey",))
SUPPLIER = TriplesMap("Supplier", "supplier", _template("supplier", "s_suppkey"), (NS + "Supplier",), (_literal("name", "s_name"), _link("inNation", "nation", "s_nationkey")), key=("s_suppkey",))
PART = TriplesMap("Part", "part", _template("part", "p_partkey"), (NS + "Part",), (_literal("name", "p_name"), _literal("size", "p_size", "xsd:int")), key=("p_partkey",))
ORDERS = TriplesMap("Orders", "orders", _template("orders", "o_orderkey"), (NS + "Orders",), (_literal("status", "o_orderstatus"), _literal("priority", "o_orderpriority"), _literal("placedOn", "o_orderdate", "xsd:date"), _link("placedBy", "customer", "o_custkey")), key=("o_orderkey",))
DOCUMENTS = TriplesMap("Documents", "documents", _template("documents", "doc_id"), (NS + "Documents",), (_literal("language", "lang"),), key=("doc_id",))
LABELS = TriplesMap("Labels", "labels", _template("documents", "doc_id"), (NS + "Labels",), (_literal("quality", "quality", "xsd:int"),), key=("doc_id",), pattern="SH")
CONTAINS = TriplesMap("Contains", "lineitem", _template("orders", "l_orderkey"), (), (_link("contains", "part", "l_partkey"),), pattern="SR")
SUPPLIES = TriplesMap("Supplies", "lineitem", _template("supplier", "l_suppkey"), (), (_link("supplies", "part", "l_partkey"),), pattern="SR")
FLAGS = TriplesMap("Flags", "lineitem", _template("orders", "l_orderkey"), (), (_literal("flag", "l_returnflag"),), pattern="SR")
OPEN = TriplesMap("OpenOrders", "orders", _template("orders", "o_orderkey"), (NS + "OpenOrder",), (), Condition("o_orderstatus", "O"), pattern="TYPE")
FILLED = TriplesMap("FilledOrders", "orders", _template("orders", "o_orderkey"), (NS + "FilledOrder",), (), Condition("o_orderstatus", "F"), pattern="TYPE")
GOOD = TriplesMap("GoodDocuments", "labels", _template("documents", "doc_id"), (NS + "GoodDocument",), (), Condition("quality", 1), pattern="TYPE")
TURN = TriplesMap("Turn", "conversations", _template("turn", "conv_id", "turn"), (NS + "Turn",), (_literal("role", "role"),), key=("conv_id", "turn"))


def mapping(*maps: TriplesMap) -> Mapping:
    return Mapping(list(maps), BASE, {"shop": NS})


FULL = mapping(REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, DOCUMENTS, LABELS, CONTAINS, SUPPLIES, FLAGS, OPEN, FILLED)


def catalog(spark: SparkSession, sf_dir: str, names: list[str] | None = None, references: bool = True) -> Catalog:
    names = names or TABLES
    fks = [k for k in REFERENCES if k.table in names and k.ref_table in names] if references else []
    return Catalog.from_parquet(spark, sf_dir, names, primary_keys={t: KEYS[t] for t in names if t in KEYS}, foreign_keys=fks)


def onto(spark: SparkSession) -> ontology.Ontology:
    return ontology.read(turtle.triples_frame(spark, turtle.parse(ONTOLOGY)))
