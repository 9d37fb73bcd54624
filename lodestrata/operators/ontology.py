"""Class hierarchy, unions, disjointness and property endpoints, as DataFrames over the triples of an ontology."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import names as N
from lodestrata.sources.turtle import RDF

RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
THING = OWL + "Thing"
#: Scores of a hint against a declared endpoint.
EXACT, RELATED, SIMILAR, UNDECLARED = 1.0, 0.85, 0.5, 0.3
#: Edges up to which a closure is made on the driver: at most a million pairs.
SMALL_GRAPH = 1000


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", max_rounds: int = 64) -> DataFrame:
    """child, ancestor, distance: all pairs joined by a path, with the shortest length; a node on a cycle reaches itself.

    Semi-naive with squared steps: each round joins the pairs found so far with themselves, so a chain of length n
    takes about log2 n rounds; a cycle ends when no pair is new or shorter.  Up to ``SMALL_GRAPH`` edges, as ontologies
    have, the paths are walked on the driver instead.
    """
    spark = edges.sparkSession
    step = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).dropna().distinct().withColumn("distance", F.lit(1))
    few = step.select("child", "ancestor").limit(SMALL_GRAPH + 1).collect()
    if len(few) <= SMALL_GRAPH:
        return spark.createDataFrame(_walked([tuple(r) for r in few]), step.schema)
    known, before = _checkpointed(step), -1
    for _ in range(max_rounds):
        size = known.agg(F.count(F.lit(1)), F.sum("distance")).first()
        if tuple(size) == before:
            return known
        before = tuple(size)
        right = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("distance").alias("_more"))
        longer = known.join(right, "ancestor").select("child", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        known = _checkpointed(known.unionByName(longer).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds on {spark.sparkContext.applicationId}")


def _walked(edges: list[tuple]) -> list[tuple]:
    up: dict = {}
    for a, b in edges:
        up.setdefault(a, []).append(b)
    out = []
    for start in up:
        far, front, distance = {}, up[start], 0
        while front:
            distance += 1
            front = [x for x in dict.fromkeys(front) if x not in far]
            far |= dict.fromkeys(front, distance)
            front = [y for x in front for y in up.get(x, ())]
        out += [(start, x, n) for x, n in far.items()]
    return out


def _checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or f"{tempfile.gettempdir()}/lodestrata-checkpoints")
    return df.checkpoint()


def leaves(closed: DataFrame) -> DataFrame:
    """ancestor, leaf: descendants that have no descendants themselves."""
    parents = closed.select(F.col("ancestor").alias("child")).distinct()
    return closed.join(parents, "child", "left_anti").select("ancestor", F.col("child").alias("leaf"))


def incompatible(disjoint: DataFrame, closed: DataFrame) -> DataFrame:
    """a, b: every pair from the families (a class and its descendants) of two disjoint classes, in both orders."""
    both = disjoint.select("a", "b").unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    family = closed.select(F.col("ancestor").alias("top"), F.col("child").alias("member")).unionByName(both.select(F.col("a").alias("top"), F.col("a").alias("member"))).distinct()
    left, right = family.select(F.col("top").alias("a"), F.col("member").alias("x")), family.select(F.col("top").alias("b"), F.col("member").alias("y"))
    return both.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def class_match(hint: Column, candidate: Column, related: Column) -> Column:
    """1 for the same URI or local name, 0.85 if ``related`` (an ancestor either way), 0.5 for similar names, else 0."""
    h, c = N.local_name(hint), N.local_name(candidate)
    return F.when((hint == candidate) | (F.lower(h) == F.lower(c)), EXACT).when(related, RELATED).when(N.name_overlap(h, c) > 0.6, SIMILAR).otherwise(0.0)


def hint_match(hints: DataFrame, endpoints: DataFrame, closed: DataFrame) -> DataFrame:
    """hint, uri, side, score: the best match of a hint (null allowed) with the declared classes of a property's side.

    ``hints``: hint.  ``endpoints``: uri, side, class, with union members already expanded and a null class where a side declares nothing.
    """
    up = closed.select(F.col("child").alias("_c"), F.col("ancestor").alias("_a")).distinct()
    related = up.unionByName(up.select(F.col("_a").alias("_c"), F.col("_c").alias("_a"))).distinct().withColumn("_related", F.lit(True))
    pairs = hints.select("hint").distinct().join(F.broadcast(endpoints.select("uri", "side", "class")), F.lit(True))
    joined = pairs.join(F.broadcast(related), (F.col("hint") == F.col("_c")) & (F.col("class") == F.col("_a")), "left")
    score = F.when(F.col("hint").isNull() | F.col("class").isNull(), UNDECLARED).otherwise(class_match(F.col("hint"), F.col("class"), F.coalesce("_related", F.lit(False))))
    return joined.groupBy("hint", "uri", "side").agg(F.max(score).alias("score"))


@dataclass
class Ontology:
    """The parts of an ontology that mapping needs; all are DataFrames of ontology size."""

    classes: DataFrame  # uri
    edges: DataFrame  # child, parent
    closed: DataFrame  # child, ancestor, distance
    properties: DataFrame  # uri, kind (object or datatype)
    endpoints: DataFrame  # uri, side (domain or range), class; a row with null where nothing named is declared
    disjoint: DataFrame  # a, b
    unions: DataFrame  # node, member
    restrictions: DataFrame  # class, property, filler
    inverses: DataFrame  # uri, inverse
    subproperties: DataFrame  # uri, parent
    labels: DataFrame  # uri, kind (label or comment), text


def read(triples: DataFrame) -> Ontology:
    """From triples as ``sources.turtle`` gives them."""
    t = triples.select("s", "p", "o", "o_kind")
    named = lambda c: ~F.startswith(F.col(c), F.lit("_:"))
    of = lambda p: t.where(F.col("p") == p).select("s", "o")
    members = _list_members(t)
    unions = _unions(t, members)

    split = of(OWL + "disjointUnionOf").join(members, F.col("o") == F.col("list")).select(F.col("member").alias("child"), F.col("s").alias("parent"))
    union_children = of(OWL + "unionOf").where(named("s")).join(members, F.col("o") == F.col("list")).where(named("member")).select(F.col("member").alias("child"), F.col("s").alias("parent"))
    direct = of(RDFS + "subClassOf").where(named("s") & named("o")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    edges = direct.unionByName(split.where(named("child") & named("parent"))).unionByName(union_children).distinct()

    typed = lambda k: t.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + k) & named("s")).select(F.col("s").alias("uri"))
    kinds = [typed("ObjectProperty").withColumn("kind", F.lit("object")), typed("DatatypeProperty").withColumn("kind", F.lit("datatype"))]
    properties = reduce(DataFrame.unionByName, kinds).distinct()
    sides = []
    for side in ("domain", "range"):
        declared = of(RDFS + side).join(unions, F.col("o") == F.col("node"), "left").select(F.col("s").alias("uri"), F.coalesce("member", "o").alias("class")).where(named("class"))
        sides.append(properties.select("uri").join(declared, "uri", "left").select("uri", F.lit(side).alias("side"), "class"))
    endpoints = reduce(DataFrame.unionByName, sides).distinct()

    pairs = of(OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    sets = t.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "AllDisjointClasses")).select("s").join(of(OWL + "members"), "s").join(members, F.col("o") == F.col("list")).select("s", "member")
    crossed = sets.alias("x").join(sets.alias("y"), "s").select(F.col("x.member").alias("a"), F.col("y.member").alias("b"))
    disjoint = pairs.unionByName(crossed).where(named("a") & named("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    uses = [typed("Class"), edges.select(F.col("child").alias("uri")), edges.select(F.col("parent").alias("uri")), endpoints.where("class is not null").select(F.col("class").alias("uri")), disjoint.select(F.col("a").alias("uri")), disjoint.select(F.col("b").alias("uri"))]
    classes = reduce(DataFrame.unionByName, uses).distinct()

    on = of(OWL + "onProperty").select(F.col("s").alias("r"), F.col("o").alias("property"))
    fillers = t.where(F.col("p").isin(OWL + "someValuesFrom", OWL + "allValuesFrom", OWL + "onClass")).select(F.col("s").alias("r"), F.col("o").alias("filler"))
    owners = of(RDFS + "subClassOf").unionByName(of(OWL + "equivalentClass")).where(named("s")).select(F.col("s").alias("class"), F.col("o").alias("r"))
    restrictions = owners.join(on, "r").join(fillers, "r").select("class", "property", "filler").distinct()
    inverse = of(OWL + "inverseOf").where(named("s") & named("o"))
    inverses = inverse.select(F.col("s").alias("uri"), F.col("o").alias("inverse")).unionByName(inverse.select(F.col("o").alias("uri"), F.col("s").alias("inverse"))).distinct()
    subproperties = of(RDFS + "subPropertyOf").where(named("s") & named("o")).select(F.col("s").alias("uri"), F.col("o").alias("parent")).distinct()
    labels = t.where(F.col("p").isin(RDFS + "label", RDFS + "comment")).select(F.col("s").alias("uri"), N.local_name(F.col("p")).alias("kind"), F.col("o").alias("text"))
    return Ontology(classes, edges, closure(edges), properties, endpoints, disjoint, unions, restrictions, inverses, subproperties, labels)


def _list_members(t: DataFrame) -> DataFrame:
    """list, member for every RDF list, whatever its length."""
    rest = t.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    first = t.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("member"))
    reach = closure(rest).select(F.col("child").alias("list"), F.col("ancestor").alias("cell")).unionByName(first.select(F.col("cell").alias("list"), "cell"))
    return reach.join(first, "cell").select("list", "member").distinct()


def _unions(t: DataFrame, members: DataFrame) -> DataFrame:
    """node, member: named classes in a union, nested unions expanded; intersections and complements stay opaque."""
    one = t.where(F.col("p") == OWL + "unionOf").select(F.col("s").alias("node"), F.col("o").alias("list")).join(members, "list").select("node", "member")
    reach = closure(one, "node", "member")
    return reach.where(~F.startswith("ancestor", F.lit("_:"))).select(F.col("child").alias("node"), F.col("ancestor").alias("member")).distinct()


def domain_compatible(subjects: DataFrame, endpoints: DataFrame, closed: DataFrame) -> DataFrame:
    """uri, subject of the properties that a subject class may have: no named domain, owl:Thing, the class itself or an ancestor of it."""
    domains = endpoints.where("side = 'domain'").select("uri", F.col("class").alias("domain"))
    up = closed.select(F.col("child").alias("subject"), F.col("ancestor").alias("domain")).unionByName(subjects.select("subject", F.col("subject").alias("domain"))).distinct()
    free = domains.where(F.col("domain").isNull() | (F.col("domain") == THING)).select("uri").distinct().join(F.broadcast(subjects), F.lit(True)).select("uri", "subject")
    return domains.join(up, "domain").join(subjects, "subject", "left_semi").select("uri", "subject").unionByName(free).distinct()


def hard_disjoint(hints: DataFrame, domains: DataFrame, bad: DataFrame) -> DataFrame:
    """name, uri where every hint is incompatible with every domain.  ``hints``: name, hint; ``domains``: uri, domain; ``bad``: a, b."""
    pairs = hints.join(F.broadcast(domains), F.lit(True)).join(F.broadcast(bad.withColumn("_bad", F.lit(True))), (F.col("hint") == F.col("a")) & (F.col("domain") == F.col("b")), "left")
    return pairs.groupBy("name", "uri").agg(F.bool_and(F.coalesce("_bad", F.lit(False))).alias("all")).where("all").select("name", "uri")


def restriction_support(ontology: Ontology, limit: int = 3) -> DataFrame:
    """class, property, filler under the hierarchy: a subclass inherits its ancestors' restrictions; nearest first, at most ``limit`` for each class and property."""
    down = ontology.closed.select(F.col("child").alias("sub"), F.col("ancestor").alias("class"), "distance")
    own = ontology.restrictions.select(F.col("class").alias("sub"), "property", "filler", F.lit(0).alias("distance"))
    inherited = ontology.restrictions.join(down, "class").select("sub", "property", "filler", "distance")
    per = Window.partitionBy("sub", "property").orderBy("distance", "filler")
    every = own.unionByName(inherited).withColumn("_r", F.row_number().over(per)).where(F.col("_r") <= limit)
    return every.select(F.col("sub").alias("class"), "property", "filler", "distance")


def match_kind(declared: Column, actual: Column, up: Column, down: Column) -> Column:
    """exact, subclass (the actual class is below), parent, no-declared, missing, opaque or conflict."""
    return F.when(actual.isNull(), "missing").when(declared.isNull(), "no-declared").when(F.startswith(declared, F.lit("_:")), "opaque").when(declared == actual, "exact").when(up, "subclass").when(down, "parent").otherwise("conflict")


#: Weights of the kinds of match.
KIND_WEIGHTS = {"exact": 1.0, "subclass": 0.78, "parent": 0.52, "no-declared": 0.12, "opaque": 0.12, "conflict": 0.0, "missing": 0.0}


def kind_weight(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, w in KIND_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])[kind], F.lit(0.0))
