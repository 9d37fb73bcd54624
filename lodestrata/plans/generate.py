"""From an alignment and relation decisions to an R2RML mapping."""

from __future__ import annotations

from lodestrata.functions import types as T
from lodestrata.functions.iri import BASE, iri_base, safe_id, subject_template
from lodestrata.plans.align import TableAlignment, identity, key_of
from lodestrata.plans.r2rml import Condition, Mapping, ObjectMap, PredicateObject, TriplesMap
from lodestrata.plans.relations import Decision
from lodestrata.sources.catalog import Catalog


def template_of(catalog: Catalog, alignment: dict[str, TableAlignment], table: str, columns: tuple[str, ...] | None = None, base: str = BASE) -> str | None:
    """IRI template of a table's rows; ``columns`` name the same key in another table (a foreign key's own columns)."""
    root, own = identity(catalog, alignment, table)
    if not own:
        return None
    if columns is not None:
        order = {c: i for i, c in enumerate(catalog.primary_keys.get(table, own))}
        names = [columns[order[c]] if c in order and order[c] < len(columns) else None for c in own]
        if None in names:
            return None
        own = tuple(names)
    return subject_template(iri_base(root), list(own), base)


def generate(catalog: Catalog, alignment: dict[str, TableAlignment], decisions: list[Decision], base: str = BASE, prefixes: dict[str, str] | None = None) -> Mapping:
    maps = []
    by_table: dict[str, list[Decision]] = {}
    for d in decisions:
        by_table.setdefault(d.task.table, []).append(d)
    names = {t: safe_id(t) + "Mapping" for t in alignment}
    for t, a in sorted(alignment.items()):
        own = by_table.get(t, [])
        if a.pattern == "SR" or a.value_attr:
            maps += [m for d in own if (m := _relation(catalog, alignment, d, names[t], base))]
            if a.value_attr and not own:
                maps += _values(catalog, alignment, a, names[t], base)
            continue
        subject = template_of(catalog, alignment, t, base=base)
        if subject is None:
            continue
        properties = [PredicateObject(c.property, ObjectMap(c.column, datatype=c.datatype)) for c in a.columns.values() if c.role == "data_attr" and c.property and T.agrees(c.sql_type, T.XSD + c.datatype.removeprefix("xsd:"))]
        backward = []
        for d in own:
            if d.task.kind == "inferred_sr":
                if m := _relation(catalog, alignment, d, names[t] + "Relation", base):
                    maps.append(m)
            elif d.task.kind == "composite_fk":
                joins = tuple(zip(d.task.source_columns, d.task.target_columns, strict=True))
                if d.task.target in alignment and len(joins) == len(catalog.primary_keys.get(d.task.target, joins)):
                    properties.append(PredicateObject(d.property, ObjectMap(parent=names[d.task.target], joins=joins)))
            elif target := template_of(catalog, alignment, d.task.target, d.task.source_columns, base):
                if d.reverse:
                    backward.append(TriplesMap(f"{names[t]}_{safe_id(d.task.source_columns[0])}_inverse", t, target, (), (PredicateObject(d.property, ObjectMap(template=subject)),), pattern="SR"))
                else:
                    properties.append(PredicateObject(d.property, ObjectMap(template=target)))
        covered = any(x.kind == "enum" and x.value_to_class and not x.unmapped for x in a.assertions)
        classes = () if covered or not a.class_uri else (a.class_uri,)  # a complete enumeration says more; the base class follows from it
        maps.append(TriplesMap(names[t], t, subject, classes, tuple(properties), key=key_of(catalog, t), pattern=a.pattern))
        maps += backward
        maps += _assertions(a, names[t], subject, t)
    return Mapping(maps, base, prefixes or {})


def _relation(catalog: Catalog, alignment: dict[str, TableAlignment], d: Decision, name: str, base: str) -> TriplesMap | None:
    """Two templates and one property; relations have no class."""
    subject = template_of(catalog, alignment, d.task.subject_table, d.task.source_columns, base)
    if not subject:
        return None
    if not d.task.target:
        column = d.task.subject_columns[0]
        if d.task.kind == "value_iri" and d.reverse:  # the stored IRI is the subject
            return TriplesMap(name, d.task.table, "{" + column + "}", (), (PredicateObject(d.property, ObjectMap(template=subject)),), subject_is_iri_column=True, pattern="SR")
        o = ObjectMap(column, iri=True) if d.task.kind == "value_iri" else ObjectMap(column, datatype=T.xsd_of(catalog.types(d.task.table)[column]))
        return TriplesMap(name, d.task.table, subject, (), (PredicateObject(d.property, o),), pattern="SR")
    target = template_of(catalog, alignment, d.task.target, d.task.subject_columns, base)
    if not target:
        return None
    s, o = (target, subject) if d.reverse else (subject, target)
    return TriplesMap(name, d.task.table, s, (), (PredicateObject(d.property, ObjectMap(template=o)),), pattern="SR")


def _values(catalog: Catalog, alignment: dict[str, TableAlignment], a: TableAlignment, name: str, base: str) -> list[TriplesMap]:
    """A many-valued literal: the subject is the referenced entity."""
    k = catalog.fks_of(a.table)[0]
    subject = template_of(catalog, alignment, k.ref_table, k.columns, base)
    mapped = [c for c in a.columns.values() if c.property and c.column not in k.columns]
    return [TriplesMap(name, a.table, subject, (), tuple(PredicateObject(c.property, ObjectMap(c.column, datatype=c.datatype)) for c in mapped), pattern="SR")] if subject and mapped else []


def _assertions(a: TableAlignment, name: str, subject: str, table: str) -> list[TriplesMap]:
    out = []
    for x in a.assertions:
        if x.kind == "boolean" and x.true_class:
            out.append(TriplesMap(f"{name}_{safe_id(x.column)}", table, subject, (x.true_class,), (), Condition(x.column, True), pattern="TYPE"))
        for value, classes in sorted(x.value_to_class.items()):
            out.append(TriplesMap(f"{name}_{safe_id(x.column)}_{safe_id(value)}", table, subject, tuple(classes), (), Condition(x.column, value), pattern="TYPE"))
    return out
