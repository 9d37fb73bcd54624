"""Mapping generation end to end: keys, patterns, alignment, real values, relations, mapping."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import classify, ind, profile
from lodestrata.operators import ontology as O
from lodestrata.plans import align, generate, realvalues, relations
from lodestrata.plans.r2rml import Mapping
from lodestrata.sources.catalog import Catalog, ForeignKey


@dataclass(frozen=True)
class Config:
    ind: str = "auto"  # on, off, auto: with at most ``ind_most_fks`` declared keys
    ind_most_fks: int = 5
    ind_threshold: float = 0.95
    top_k: int = 5
    disabled: frozenset[str] = frozenset()
    real_values: bool = True
    low_confidence_tables: int = 1_000
    inferred_relations: bool = True
    accept_tentative: bool = False
    base: str = "http://example.com/"


#: Named variations for ablation runs.
PRESETS = {
    "full": {},
    "without_ind": {"ind": "off"},
    "without_patterns": {"disabled": frozenset({"SH", "SR"})},
    "without_real_values": {"real_values": False},
    "without_inferred_relations": {"inferred_relations": False},
}


@dataclass
class State:
    catalog: Catalog
    ontology: O.Ontology
    patterns: dict[str, str] = field(default_factory=dict)
    value_attrs: set[str] = field(default_factory=set)
    key_only: set[str] = field(default_factory=set)
    inferred: list[dict] = field(default_factory=list)
    alignment: dict[str, align.TableAlignment] = field(default_factory=dict)
    report: dict[str, dict] = field(default_factory=dict)
    decisions: list[relations.Decision] = field(default_factory=list)
    mapping: Mapping | None = None


class Pipeline:
    """Stages in a fixed order; ``run(until=...)`` stops after one.  Each stage's outcome can be kept as JSON."""

    def __init__(self, spark: SparkSession, config: Config | None = None, selector: align.Selector | None = None, keep: str | None = None, reviewer: align.Selector | None = None):
        self.spark, self.config, self.selector, self.keep, self.reviewer = spark, config or Config(), selector, keep, reviewer
        self.stages: list[tuple[str, Callable[[State], None]]] = [("keys", self.keys), ("patterns", self.patterns), ("alignment", self.alignment), ("real_values", self.real_values), ("relations", self.relations), ("mapping", self.mapping)]

    def run(self, catalog: Catalog, ontology: O.Ontology, until: str | None = None, resume: bool = False) -> State:
        """With ``resume``, stages whose outcome is kept under the same signature are read instead of run, up to the first that isn't."""
        state, mark = State(catalog, ontology), signature(catalog, self.config, ontology, (self.selector, self.reviewer)) if self.keep else ""
        for name, stage in self.stages:
            path = Path(self.keep) / f"{name}.json" if self.keep else None
            kept = json.loads(path.read_text()) if resume and path and path.is_file() else None
            if kept and kept["signature"] == mark and name != "mapping":
                self._restore(name, state, kept["outcome"])
            else:
                resume = False
                stage(state)
                if path:
                    write_json(path, {"signature": mark, "outcome": self._outcome(name, state)})
            if name == until:
                break
        return state

    def _outcome(self, name: str, s: State):
        return {
            "keys": [asdict(k) for k in s.catalog.foreign_keys],
            "patterns": {"patterns": s.patterns, "value_attrs": sorted(s.value_attrs), "key_only": sorted(s.key_only), "inferred": s.inferred},
            "alignment": {t: asdict(a) for t, a in s.alignment.items()},
            "real_values": {t: [asdict(x) for x in a.assertions] for t, a in s.alignment.items()},
            "relations": [asdict(d) for d in s.decisions],
            "mapping": asdict(s.mapping) if s.mapping else None,
        }[name]

    def _restore(self, name: str, s: State, kept) -> None:
        if name == "keys":
            if not s.catalog.primary_keys:
                s.catalog = s.catalog.infer_keys()
            s.catalog = replace(s.catalog, foreign_keys=[ForeignKey(k["table"], tuple(k["columns"]), k["ref_table"], tuple(k["ref_columns"]), k["name"], k["source"]) for k in kept])
        elif name == "patterns":
            s.patterns, s.value_attrs, s.key_only, s.inferred = kept["patterns"], set(kept["value_attrs"]), set(kept["key_only"]), kept["inferred"]
        elif name == "alignment":
            for t, a in kept.items():
                columns = {c: align.ColumnAlignment(**x | {"candidates": [align.Choice(**o) for o in x["candidates"]]}) for c, x in a["columns"].items()}
                s.alignment[t] = align.TableAlignment(**a | {"columns": columns, "assertions": []})
            s.report = align.trim(align.low_confidence(s.alignment), self.config.low_confidence_tables)
        elif name == "real_values":
            for t, xs in kept.items():
                s.alignment[t].assertions = [align.TypeAssertion(**x) for x in xs]
        elif name == "relations":
            lists = ("source_columns", "target_columns", "subject_columns")
            s.decisions = [relations.Decision(relations.Task(**d["task"] | {f: tuple(d["task"][f]) for f in lists}), d["property"], d["reverse"], d["score"]) for d in kept]

    def keys(self, s: State) -> None:
        if not s.catalog.primary_keys:  # plain files declare none; a schema with some means what it says
            s.catalog = s.catalog.infer_keys()
        if self.config.ind == "on" or (self.config.ind == "auto" and len(s.catalog.foreign_keys) <= self.config.ind_most_fks):
            best = ind.best_target(ind.all_pairs_ind(s.catalog), self.config.ind_threshold)
            best = best.where("lower(column) <> 'id'")  # an ID is contained in many; only a declared hierarchy could tell which
            s.catalog = s.catalog.with_fks(ind.discovered_keys(ind.mergeable(best, s.catalog.fk_frame())))

    def patterns(self, s: State) -> None:
        frames = s.catalog.columns_frame(), s.catalog.pk_frame(), s.catalog.fk_frame()
        for r in classify.classify(*frames).collect():  # a row for each table
            s.patterns[r["table"]] = "SE" if r["pattern"] in self.config.disabled else r["pattern"]
            if r["value_attr"]:
                s.value_attrs.add(r["table"])
            if r["key_only"]:
                s.key_only.add(r["table"])
        if self.config.inferred_relations:
            s.inferred = [r.asDict() for r in classify.inferred_relations(frames[1], frames[2]).collect()]

    def alignment(self, s: State) -> None:
        s.alignment = align.align(s.catalog, s.patterns, s.ontology, self.selector, s.value_attrs, s.key_only, self.config.top_k)
        s.report = align.trim(align.low_confidence(s.alignment), self.config.low_confidence_tables)

    def real_values(self, s: State) -> None:
        if self.config.real_values:
            realvalues.assert_all(self.spark, s.catalog, s.alignment, s.ontology, self.reviewer, self.config.accept_tentative)

    def relations(self, s: State) -> None:
        iris = set()
        for t in sorted(s.value_attrs & set(s.alignment)):
            columns = [c.column for c in s.alignment[t].columns.values() if c.role == "data_attr"]
            iris |= {(t, r["column"]) for r in profile.iri_ratio(s.catalog.tables[t], columns).where("is_iri").collect()}
        s.decisions = relations.decide(self.spark, s.ontology, relations.tasks(s.catalog, s.alignment, s.inferred, iris), self.selector)

    def mapping(self, s: State) -> None:
        s.mapping = generate.generate(s.catalog, s.alignment, s.decisions, self.config.base)


def sweep(spark: SparkSession, catalog: Catalog, ontology: O.Ontology, levels: list[dict]) -> dict[str, State]:
    return {json.dumps(x, sort_keys=True, default=sorted): Pipeline(spark, replace(Config(), **x)).run(catalog, ontology) for x in levels}


def signature(catalog: Catalog, config: Config, ontology: O.Ontology | None = None, judges: tuple = ()) -> str:
    """Of what the stages read: schemas, keys, the tables' files, settings, the ontology's content and the kinds of selectors."""
    digest = lambda df: list(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).first())
    what = {"tables": {t: catalog.types(t) for t in catalog.names()}, "files": {t: sorted(catalog.tables[t].inputFiles()) for t in catalog.names()}, "pk": catalog.primary_keys, "fk": [asdict(k) for k in catalog.foreign_keys], "config": asdict(config)}
    what["ontology"] = {f.name: digest(getattr(ontology, f.name)) for f in fields(ontology)} if ontology else None
    what["judges"] = [type(j).__name__ for j in judges]
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=sorted).encode()).hexdigest()


def write_json(path: Path, value) -> None:
    """Whole or not at all: written beside, flushed, then renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_suffix(f".{os.getpid()}.tmp")
    with beside.open("w") as f:
        json.dump(value, f, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x), indent=1)
        f.flush()
        os.fsync(f.fileno())
    beside.replace(path)


def n_foreign_keys(catalog: Catalog) -> int:
    """Counted by member column."""
    return catalog.fk_frame().agg(F.count(F.lit(1))).first()[0]
