import pytest
from pyspark.sql import functions as F

from lodestrata.sources import dump, qpair, turtle
from lodestrata.sources.catalog import Catalog, ForeignKey

TTL = """
@prefix : <http://x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @base <http://base/> .
# a comment
:A a owl:Class ; :label "one \\"two\\""@en , 'x' ; :n 5, 2.5, true .
<rel> :p [ a owl:Class ; owl:unionOf ( :A :B [ :q :r ] ) ] .
:d :v "2020-01-01"^^<http://www.w3.org/2001/XMLSchema#date> ; :long \"\"\"a
b\"\"\" .
"""


def test_turtle():
    t = {(s.value, p.value.split("#")[-1], o.value): o for s, p, o in turtle.parse(TTL)}
    assert ("http://x#A", "type", "http://www.w3.org/2002/07/owl#Class") in t and ("http://base/rel" in {s for s, _, _ in t})
    assert t["http://x#A", "label", 'one "two"'].lang == "en" and t["http://x#A", "n", "2.5"].datatype.endswith("decimal")
    assert t["http://x#d", "v", "2020-01-01"].datatype.endswith("date") and ("http://x#d", "long", "a\nb") in t
    assert sum(p == "first" for _, p, _ in t) == 3
    with pytest.raises(turtle.TurtleError):
        turtle.parse("nothing:declared a b .")


SQL = """CREATE SCHEMA demo;
CREATE TABLE demo.person (
    "ID" integer NOT NULL,
    name character varying(20),
    born date,
    ok boolean
);
CREATE TABLE demo."empty one" (
    a integer
);
COPY demo.person ("ID", name, born, ok) FROM stdin;
1\tAnn\\tLee\t2001-02-03\tt
2\t\\N\t\\N\tf
\\.
ALTER TABLE ONLY demo.person ADD CONSTRAINT person_pk PRIMARY KEY ("ID");
ALTER TABLE ONLY demo."empty one" ADD CONSTRAINT e_fk FOREIGN KEY (a) REFERENCES demo.person("ID");
"""


def test_dump(spark):
    c = dump.load_dump(spark, SQL)
    assert dump.schema_of(SQL) == "demo" and c.types("person") == {"ID": "int", "name": "string", "born": "date", "ok": "boolean"}
    rows = c.tables["person"].orderBy("ID").collect()
    assert rows[0].name == "Ann\tLee" and str(rows[0].born) == "2001-02-03" and rows[1].name is None and rows[1].ok is False
    assert c.primary_keys == {"person": ("ID",)} and c.foreign_keys[0].ref_columns == ("ID",) and c.tables["empty one"].count() == 0


def test_copy_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\tx\\\\y\n2\t\\N\n")
    rows = dump.read_copy_files(spark, str(tmp_path), ["a", "b"], {"a": "int"}).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "x\\y"), (2, None)]


PAIR = "name=Q1 (x)\norderNum=2\n\nsql=SELECT COUNT(*) \\n\\\nFROM \"a\"\n\nsparql=prefix : <http://x#> \\n\\\nSELECT (COUNT(?a) AS ?n) WHERE {?a a :A}\n\ncategories=class,1-1\n"


def test_query_pairs(tmp_path):
    q = qpair.parse_pair(PAIR)
    assert q.sql.split() == ["SELECT", "COUNT(*)", "FROM", '"a"'] and q.order == 2 and q.categories == ("class", "1-1") and not q.disabled
    spaced = qpair.parse_pair("     name = n\n     sql =   Select 1   \n     disabled = true\n")
    assert spaced.name == "n" and spaced.sql == "Select 1" and spaced.disabled
    folder = tmp_path / "s1" / "queries"
    folder.mkdir(parents=True)
    (folder / "a.qpair").write_text(PAIR)
    (folder / "b.qpair").write_text(PAIR + "disabled=true\n")
    assert len(qpair.load_pairs(folder)) == 1 and len(qpair.load_pairs(folder, disabled=True)) == 2
    found = qpair.scenarios(tmp_path)
    assert [s.name for s in qpair.choose(found, "s1, s1")] == ["s1"] and found[0].missing == ["dump.sql", "ontology.ttl"]
    with pytest.raises(KeyError):
        qpair.choose(found, "nope")
    with pytest.raises(FileNotFoundError):
        qpair.require_complete(found)


def test_catalog_frames_and_inferred_keys(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, None, 2)], "k int, v string, w int")
    c = Catalog({"a": a, "b": a.drop("k")}, foreign_keys=[ForeignKey("a", ("v", "w"), "b", ("v", "w"), "two")])
    assert c.infer_keys().primary_keys == {"a": ("k",)}
    members = [tuple(r) for r in c.fk_frame().orderBy("ordinal").select("constraint", "arity", "ordinal", "column", "ref_column").collect()]
    assert members == [("two", 2, 1, "v", "v"), ("two", 2, 2, "w", "w")]
    assert c.columns_frame().where(F.col("table") == "a").count() == 3
    assert [tuple(r) for r in Catalog({"a": a}, {"a": ("w", "k")}).pk_frame().orderBy("ordinal").collect()] == [("a", 1, "w"), ("a", 2, "k")]
