import pytest

from lodestrata.operators import ontology
from lodestrata.plans import realvalues as R
from lodestrata.plans.align import ColumnAlignment, TableAlignment
from lodestrata.sources import turtle
from lodestrata.sources.catalog import Catalog, ForeignKey

X = "http://x#"
TTL = """
@prefix : <http://x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:Document a owl:Class . :Paper a owl:Class ; rdfs:subClassOf :Document . :Review a owl:Class ; rdfs:subClassOf :Document . :Abstract a owl:Class ; rdfs:subClassOf :Document .
:reviewedBy a owl:ObjectProperty ; rdfs:domain :Paper .
"""


@pytest.fixture(scope="module")
def onto(spark):
    return ontology.read(turtle.triples_frame(spark, turtle.parse(TTL)))


def world(spark, rows, papers=(), reviews=(), written=(), extra="", fks=()):
    doc = spark.createDataFrame(rows, f"ID int, TYPE int{extra}")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "ID int")
    c = Catalog({"document": doc, "paper": ids(papers), "review": ids(reviews), "person": ids(range(100, 120)), "writtenBy": spark.createDataFrame([(i, 100) for i in written], "review int, person int")}, {"document": ("ID",), "paper": ("ID",), "review": ("ID",), "person": ("ID",)}, [])
    c.foreign_keys = [ForeignKey("paper", ("ID",), "document", ("ID",)), ForeignKey("review", ("ID",), "document", ("ID",)), ForeignKey("writtenBy", ("review",), "document", ("ID",)), *fks]
    a = {"document": TableAlignment("document", "SE", X + "Document"), "paper": TableAlignment("paper", "SH", X + "Paper"), "review": TableAlignment("review", "SH", X + "Review")}
    return c, a


def run(spark, onto, c, a, **kw):
    x = R.map_enum(spark, c, a, onto, "document", "TYPE", **kw)
    return {v: [u.removeprefix(X) for u in us] for v, us in x.value_to_class.items()}, x.unmapped, x.confidence


ROWS = [(i, 1 if i < 10 else 2 if i < 20 else 3) for i in range(30)]


def test_codes_are_mapped_by_subtypes_and_the_last_by_the_last_class(spark, onto):
    c, a = world(spark, ROWS, range(10), range(10, 20))
    assert run(spark, onto, c, a) == ({"1": ["Paper"], "2": ["Review"], "3": ["Abstract"]}, [], "high")


def test_codes_without_evidence_stay_unmapped(spark, onto):
    c, a = world(spark, ROWS)
    mapped, rest, level = run(spark, onto, c, a)
    assert mapped == {} and rest == [1, 2, 3] and level == "low"


def test_an_only_code_needs_a_subtype_with_its_rows(spark, onto):
    one = [(i, 7) for i in range(12)]
    c, a = world(spark, one, range(12))
    assert run(spark, onto, c, a) == ({"7": ["Paper"]}, [], "high")
    c, a = world(spark, one, range(6))
    assert run(spark, onto, c, a) == ({}, [7], "low")
    c, a = world(spark, [(0, 7), (1, 7)], range(2))  # too few
    assert run(spark, onto, c, a)[0] == {}


def test_the_selector_is_asked_only_for_what_is_open(spark, onto):
    asked = []

    class Reviewer:
        def choose(self, task, subject, candidates):
            asked.append(subject)
            return X + "Abstract" if subject.endswith("=3") else "http://elsewhere#x"

    c, a = world(spark, ROWS, range(10))
    mapped, rest, _ = run(spark, onto, c, a, selector=Reviewer())
    assert mapped["1"] == ["Paper"] and mapped["3"] == ["Abstract"] and 2 in rest and not any(s.endswith("=1") for s in asked)


def test_named_values_lock_without_rules(spark, onto):
    doc = spark.createDataFrame([(i, ["Paper", "REVIEW", "misc"][i % 3]) for i in range(9)], "ID int, kind string")
    c = Catalog({"document": doc}, {"document": ("ID",)}, [])
    x = R.map_enum(spark, c, {"document": TableAlignment("document", "SE", X + "Document")}, onto, "document", "kind")
    assert x.value_to_class == {"Paper": [X + "Paper"], "REVIEW": [X + "Review"]} and x.unmapped == ["misc"] and x.confidence == "medium"


def test_a_relation_that_only_one_value_has_locks_its_class(spark, onto):
    rows = [(i, 1 if i < 5 else 2, 100 + i if i < 5 else None) for i in range(10)]
    c, a = world(spark, rows, extra=", reviewedBy int", fks=[ForeignKey("document", ("reviewedBy",), "person", ("ID",))])
    assert run(spark, onto, c, a)[0] == {"1": ["Paper"]}
    leak = [*rows, (99, 2, 103)]
    c, a = world(spark, leak, extra=", reviewedBy int", fks=[ForeignKey("document", ("reviewedBy",), "person", ("ID",))])
    assert run(spark, onto, c, a)[0] == {}


def test_booleans_by_name(spark, onto):
    assert R.map_boolean(spark, onto, X + "Document", "is_Paper").true_class == X + "Paper"
    assert R.map_boolean(spark, onto, X + "Document", "is_zzz").true_class is None
    assert R.map_boolean(spark, onto, X + "Paper", "is_Paper").true_class is None  # no descendants


def test_all_columns_of_all_tables(spark, onto):
    c, a = world(spark, ROWS, range(10), range(10, 20))
    a["document"].columns = {"TYPE": ColumnAlignment("TYPE", "discriminator", sql_type="int"), "ID": ColumnAlignment("ID", "pk", sql_type="int")}
    R.assert_all(spark, c, a, onto)
    assert [x.column for x in a["document"].assertions] == ["TYPE"]
