import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import iri, names, types


def evaluate(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


PAIRS = [("has_a_paper_title", "hasTitle"), ("Paper", "paper"), ("has_an_ISBN", "isISBN"), ("orders", "Order"), ("", "x"), ("conf", "conference"), ("A-b C", "abC"), ("naïve", "Naive")]


def tokens(name):
    out = []
    for p in re.split(r"[_\-\s]+", name):
        out += [p] if p.isupper() and len(p) > 1 else re.sub("([A-Z])", r" \1", p).split()
    return {t.lower() for t in out if t}


def overlap(a, b):
    x, y = (re.sub(r"[_\-\s]+", "", n).lower() for n in (a, b))
    chars = sum((Counter(x) & Counter(y)).values()) / max(len(x), len(y)) if x and y else 0.0
    s, t = tokens(a), tokens(b)
    return max(chars, len(s & t) / len(s | t) if s and t else 0.0)


def test_name_overlap_agrees_with_multisets(spark):
    got = evaluate(spark, PAIRS, "a string, b string", names.name_overlap(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == pytest.approx([overlap(a, b) for a, b in PAIRS])


def test_tokens_keep_acronyms(spark):
    got = evaluate(spark, [("has_an_ISBN",), ("hasTitle",), ("URL of-X",)], "a string", names.tokenize(F.col("a")), names.camel_tokens(F.col("a")))
    assert [set(g[0]) for g in got] == [{"has", "an", "isbn"}, {"has", "title"}, {"url", "of", "x"}]


def test_table_names_are_lowered_before_they_are_split(spark):
    rows = [("PaperReview", "PaperReview"), ("paper_review", "PaperReview"), ("all_papers", "Paper"), ("id", "Paper")]
    got = evaluate(spark, rows, "a string, b string", names.token_coverage(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [1.0, 1.0, 1.0, 0.0]  # the first by its prefix; `all` and `id` are stop tokens


def test_lookup_names(spark):
    rows = [("Categories",), ("class",), ("Key-Words ",), ("bus",)]
    assert [g[0] for g in evaluate(spark, rows, "a string", names.singular_lookup(F.col("a")))] == ["category", "class", "key_word", "bu"]


def test_local_names(spark):
    rows = [("http://a/b#C",), ("http://a/b/",), ("http://a/b",)]
    assert [g[0] for g in evaluate(spark, rows, "a string", names.local_name(F.col("a")))] == ["C", "b", "b"]


def test_value_class_score(spark):
    rows = [("Formation", "Formation"), ("XML", "XMLArtifact"), ("ERU", "EmergencyResponseUnit"), ("DEVELOPMENT", "DevelopmentWellbore"), ("12", "Twelve"), ("yes", "Yes"), ("ab", "Abacus"), ("R&D", "ResearchDivision"), ("solar power assets", "SolarPowerAsset"), (None, "X")]
    got = [g[0] for g in evaluate(spark, rows, "v string, c string", names.value_class_score(F.col("v"), F.col("c")))]
    assert got == pytest.approx([1.0, 0.94, 0.94, 0.72 + 0.26 * 11 / 19, 0, 0, 0, 0.94, 0.75, 0])


def test_truth_and_discriminators(spark):
    assert evaluate(spark, [("Yes",), ("0",), ("maybe",), (None,)], "a string", names.truth(F.col("a"))) == [(True,), (False,), (None,), (None,)]
    assert evaluate(spark, [("TYPE",), ("wlbPurposeKind",), ("title",), ("is_flag",)], "a string", names.is_discriminator(F.col("a"))) == [(True,), (True,), (False,), (False,)]


def test_identity_needs_explicit_names(spark):
    rows = [("orcid", "hasORCID", "Person"), ("ID", "personID", "Person"), ("ID", "email", "Person"), ("ID", "submissionID", "Person")]
    got = evaluate(spark, rows, "c string, p string, k string", names.identity_score(F.col("c"), F.col("p"), F.col("k")))
    assert [g[0] for g in got] == [1.0, 0.98, 0.0, 0.0]


def test_wrapped_property_names(spark):
    rows = [("title", "has_a_title"), ("title", "hasTitle"), ("title", "has_subtitle"), ("hash", "hash")]
    assert [g[0] for g in evaluate(spark, rows, "c string, p string", names.names_directly(F.col("c"), F.col("p")))] == [True, True, False, True]


def test_explain_similarity(spark):
    r = evaluate(spark, [("has_an_ISBN", "has_an_isbn")], "a string, b string", names.explain_similarity(F.col("a"), F.col("b")))[0][0]
    assert r.tokens_a == ["an", "has", "isbn"] and r.token_jaccard == 1.0 and r.score == 1.0


@pytest.mark.parametrize("sql, want", [("boolean", "boolean"), ("timestamp without time zone", "temporal"), ("interval", "numeric"), ("point", "numeric"), ("bytea", "binary"), ("character varying(22)", "text"), ("array<float>", "numeric"), ("tsvector", "unknown")])
def test_families_are_tested_in_order(spark, sql, want):
    assert types.family(sql) == want
    assert evaluate(spark, [(sql,)], "t string", types.family_column(F.col("t"))) == [(want,)]


def test_type_compatibility():
    x = types.XSD
    assert types.admits("integer", [x + "boolean"]) and types.admits("date", [x + "string"]) and not types.admits("date", [x + "int"]) and types.admits("date", [])
    assert not types.agrees("character varying", x + "date") and types.agrees("integer", x + "int")
    assert types.xsd_of("integer") == "xsd:int" and types.xsd_of("integer", [x + "decimal"]) == "xsd:decimal" and types.xsd_of("timestamp") == "xsd:dateTime" and types.xsd_of("text") == "xsd:string"


def test_iri_templates(spark):
    t = iri.subject_template("my_table", ["a", "b"])
    assert t == "http://example.com/my_table/{a}__{b}" and iri.template_columns(t) == ["a", "b"] and iri.iri_base("My  Table_ x") == "my_table_x"
    got = evaluate(spark, [("x y~*/ü", 1), (None, 2)], "a string, b int", iri.expand(t))
    assert got == [("http://example.com/my_table/x%20y~%2A%2F%C3%BC__1",), (None,)]


def test_absolute_iris(spark):
    rows = [("http://a.org/x", True), ("http:/nohost", False), ("c:\\x", False), ("urn:isbn:1", True), ("urn:x", False), ("mailto:a@b", True), ("no scheme", False), ("a b:c", False), (None, False)]
    assert [g[0] for g in evaluate(spark, rows, "a string, w boolean", iri.is_absolute(F.col("a")))] == [w for _, w in rows]


def test_xsd_families_without_regard_to_case():
    from lodestrata.functions import types as T

    kinds = {"duration": "temporal", "dateTime": "temporal", "hexBinary": "binary", "base64Binary": "binary", "NCName": "text", "QName": "text", "unsignedByte": "numeric", "nonPositiveInteger": "numeric", "gMonth": "unknown"}
    assert {k: T.xsd_family(T.XSD + k) for k in kinds} == kinds
    assert T.xsd_of("datetime") == T.xsd_of("timestamp") == "xsd:dateTime" and T.xsd_of("date") == "xsd:date"
