"""Object properties for foreign keys and relation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import names as N
from lodestrata.operators import ontology as O
from lodestrata.operators import ranking
from lodestrata.plans.align import Choice, Selector, TableAlignment, is_identity
from lodestrata.sources.catalog import Catalog


@dataclass(frozen=True)
class Task:
    kind: str  # fk, composite_fk, sr, value_iri, inferred_sr
    key: str
    table: str
    source_columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    domain: str | None
    range: str | None
    name: str
    subject_table: str = ""
    subject_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Decision:
    task: Task
    property: str
    reverse: bool
    score: float


def tasks(catalog: Catalog, alignment: dict[str, TableAlignment], inferred: list[dict] = (), iri_columns: set[tuple[str, str]] = frozenset()) -> list[Task]:
    """Foreign keys of entities and subtypes (identity keys are consumed), the two ends of relation tables, value tables whose values are IRIs, and inferred relations."""
    out = []
    uri = lambda t: alignment[t].class_uri if t in alignment else None
    for t, a in sorted(alignment.items()):
        fks = catalog.fks_of(t)
        if a.pattern == "SR":
            if len(fks) == 2:
                for x, y, tag in ((fks[0], fks[1], ""),):
                    out.append(Task("sr", f"{t}{tag}", t, x.columns, y.ref_table, y.ref_columns, uri(x.ref_table), uri(y.ref_table), t, x.ref_table, y.columns))
            elif len(fks) == 1:
                other = tuple(c for c in catalog.types(t) if c not in fks[0].columns)
                out.append(Task("sr", t, t, fks[0].columns, "", (), uri(fks[0].ref_table), None, t, fks[0].ref_table, other))
            continue
        if a.value_attr:
            other = tuple(c for c in catalog.types(t) if c not in fks[0].columns)
            if (t, *other) not in iri_columns:
                continue  # literals belong to a datatype property
            out.append(Task("value_iri", t, t, fks[0].columns, "", (), uri(fks[0].ref_table), None, t, fks[0].ref_table, other))
            continue
        for k in fks:
            if is_identity(catalog, alignment, k):
                continue
            kind = "fk" if len(k.columns) == 1 else "composite_fk"
            key = f"{t}.{k.columns[0]}" if kind == "fk" else f"{t}.__fk__{k.constraint}"
            out.append(Task(kind, key, t, k.columns, k.ref_table, k.ref_columns, uri(t), uri(k.ref_table), k.columns[0] if kind == "fk" else k.constraint))
    for r in inferred:
        if r["table"] in alignment and alignment[r["table"]].pattern == "SE":
            out.append(Task("inferred_sr", f"{r['table']}.__sr__", r["table"], (r["column_1"],), r["ref_table_2"], (r["ref_column_2"],), uri(r["ref_table_1"]), uri(r["ref_table_2"]), r["table"], r["ref_table_1"], (r["column_2"],)))
    return out


def endpoint_evidence(spark: SparkSession, onto: O.Ontology, work: list[Task], bad: DataFrame | None = None) -> DataFrame:
    """One row per task, property and direction that evidence admits.

    A pair stays if both declared ends are compatible with the task's classes, or a restriction says so, or one end fits
    (none is disjoint), and the property's name shares a role token with the key's names.
    """
    rows = [(t.key, t.domain, t.range, t.name, " ".join([t.table, *t.source_columns, t.target, *t.target_columns])) for t in work]
    w = spark.createDataFrame(rows, "task string, domain string, range string, name string, words string")
    both = w.withColumn("direction", F.lit("normal")).unionByName(w.select("task", F.col("range").alias("domain"), F.col("domain").alias("range"), "name", "words").withColumn("direction", F.lit("reverse")))
    pairs = both.join(F.broadcast(onto.properties.where("kind = 'object'").select("uri")), F.lit(True))
    up = onto.closed.select(F.col("child").alias("_c"), F.col("ancestor").alias("_a")).distinct().withColumn("_up", F.lit(True))
    for side in ("domain", "range"):
        ends = onto.endpoints.where(F.col("side") == side).select("uri", F.col("class").alias("_end"))
        j = pairs.select("task", "direction", "uri", side).join(F.broadcast(ends), "uri")
        j = j.join(F.broadcast(up), (F.col(side) == F.col("_c")) & (F.col("_end") == F.col("_a")), "left").drop("_c", "_a")
        down = up.select(F.col("_c").alias("_a2"), F.col("_a").alias("_c2"), F.col("_up").alias("_down"))
        j = j.join(F.broadcast(down), (F.col(side) == F.col("_c2")) & (F.col("_end") == F.col("_a2")), "left")
        kind = O.match_kind(F.col("_end"), F.col(side), F.coalesce("_up", F.lit(False)), F.coalesce("_down", F.lit(False)))
        weight = j.withColumn("_w", O.kind_weight(kind)).groupBy("task", "direction", "uri").agg(F.max("_w").alias(f"{side}_match"), F.max(F.when(kind.isin("exact", "subclass", "parent"), True).otherwise(False)).alias(f"{side}_ok"))
        pairs = pairs.join(weight, ["task", "direction", "uri"])
    r = O.restriction_support(onto).select(F.col("class").alias("domain"), F.col("property").alias("uri"), F.col("filler").alias("_filler"))
    fits = pairs.join(r, ["domain", "uri"]).join(F.broadcast(up), (F.col("range") == F.col("_c")) & (F.col("_filler") == F.col("_a")), "left").where(F.col("_up") | (F.col("range") == F.col("_filler")))
    pairs = pairs.join(fits.select("task", "direction", "uri").distinct().withColumn("restriction", F.lit(True)), ["task", "direction", "uri"], "left").withColumn("restriction", F.coalesce("restriction", F.lit(False)))
    disjoint = F.lit(False)
    if bad is not None:
        hits = []
        for side in ("domain", "range"):
            ends = onto.endpoints.where(F.col("side") == side).select("uri", F.col("class").alias("_end"))
            hits.append(pairs.select("task", "direction", "uri", side).join(ends, "uri").join(F.broadcast(bad), (F.col(side) == F.col("a")) & (F.col("_end") == F.col("b"))).select("task", "direction", "uri"))
        pairs = pairs.join(hits[0].unionByName(hits[1]).distinct().withColumn("_bad", F.lit(True)), ["task", "direction", "uri"], "left")
        disjoint = F.coalesce("_bad", F.lit(False))
    local = N.local_name(F.col("uri"))
    hits = F.size(F.array_intersect(N.role_tokens(local), F.array_union(N.role_tokens(F.col("words")), N.role_tokens(F.col("name")))))
    declared = F.col("domain_ok") & F.col("range_ok")
    weak = ~declared & ~F.col("restriction") & ~disjoint & (F.col("domain_ok") | F.col("range_ok")) & (hits > 0)
    out = pairs.select("task", "uri", "direction", "domain_match", "range_match", declared.alias("declared"), "restriction", F.lit(False).alias("construction"), weak.alias("weak"), (N.alphanumeric(F.col("name")) == N.alphanumeric(local)).alias("exact_name"), hits.alias("role_hits"))
    return out.where("declared or restriction or construction or weak")


def decide(spark: SparkSession, onto: O.Ontology, work: list[Task], selector: Selector | None = None) -> list[Decision]:
    """The property of each task: by the selector among all candidates if there is one, else by the strongest evidence that isn't weak (one end and a name are enough for stored IRIs)."""
    if not work:
        return []
    bad = O.incompatible(onto.disjoint, onto.closed)
    found = endpoint_evidence(spark, onto, work, bad).cache()
    by_key = {t.key: t for t in work}
    out = []
    if selector is not None:
        scored: dict[str, list[tuple[Choice, str]]] = {}
        for r in found.orderBy("task", F.desc("domain_match"), F.desc("range_match"), "uri").collect():
            scored.setdefault(r["task"], []).append((Choice(r["uri"], r["domain_match"] + r["range_match"]), r["direction"]))
        for key, options in sorted(scored.items()):
            uri = selector.choose("object_property", key, [c for c, _ in options])
            hit = next(((c, d) for c, d in options if c.uri == uri), None)
            if hit:
                out.append(Decision(by_key[key], hit[0].uri, hit[1] == "reverse", hit[0].score))
        return out
    alone = [t.key for t in work if t.kind == "value_iri"]  # an IRI has no table, so only one end can be known
    strong = found.where(~F.col("weak") | F.col("task").isin(*alone)) if alone else found.where("not weak")
    for r in ranking.deterministic_property(strong).orderBy("task").collect():  # a row for each task
        out.append(Decision(by_key[r["task"]], r["uri"], r["direction"] == "reverse", r["score"]))
    return out
