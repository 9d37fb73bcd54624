"""R2RML mappings as plain values, with a writer and a reader of their Turtle form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lodestrata.sources import turtle

RR = "http://www.w3.org/ns/r2rml#"
PREFIXES = {"rr": RR, "rdf": turtle.RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": turtle.XSD}


@dataclass(frozen=True)
class ObjectMap:
    """One of: a column (literal, or IRI if ``iri``), a template, a constant, or a join with another map's subjects."""

    column: str | None = None
    template: str | None = None
    constant: str | None = None
    datatype: str | None = None  # full IRI or xsd: name
    iri: bool = False
    parent: str | None = None  # name of the parent map
    joins: tuple[tuple[str, str], ...] = ()  # (child column, parent column)


@dataclass(frozen=True)
class PredicateObject:
    predicate: str
    object: ObjectMap


@dataclass(frozen=True)
class Condition:
    """Rows of the logical table: column = value; the value is compared in the column's own type."""

    column: str
    value: str | int | bool


@dataclass(frozen=True)
class TriplesMap:
    name: str
    table: str
    subject: str  # template, or {column} alone for a column of IRIs
    classes: tuple[str, ...] = ()
    properties: tuple[PredicateObject, ...] = ()
    condition: Condition | None = None
    subject_is_iri_column: bool = False
    key: tuple[str, ...] = ()  # columns that the map's rows are unique in, if known
    pattern: str = "SE"


@dataclass
class Mapping:
    maps: list[TriplesMap] = field(default_factory=list)
    base: str = "http://example.com/"
    prefixes: dict[str, str] = field(default_factory=dict)

    def named(self, name: str) -> TriplesMap:
        return next(m for m in self.maps if m.name == name)


def sql_literal(value: str | int | float | bool) -> str:
    """Booleans and numbers bare, texts quoted; a text of digits only is a number."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if re.fullmatch(r"-?\d+", value):
        return str(int(value))
    return "'" + value.replace("'", "''") + "'"


def columns_of(m: TriplesMap) -> list[str]:
    """The columns that the map reads, each once, in the order of use."""
    used = re.findall(r"\{([^{}]+)\}", m.subject)
    for po in m.properties:
        o = po.object
        used += [o.column] if o.column else []
        used += re.findall(r"\{([^{}]+)\}", o.template or "")
        used += [c for c, _ in o.joins]
    if m.condition:
        used.append(m.condition.column)
    return list(dict.fromkeys(used))


def logical_table(m: TriplesMap) -> str:
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    where = f" WHERE {quote(m.condition.column)} = {sql_literal(m.condition.value)}" if m.condition else ""
    return f"SELECT {', '.join(map(quote, columns_of(m)))} FROM {quote(m.table)}{where}"


def predicate(uri: str, prefixes: dict[str, str]) -> str:
    """Prefixed if a prefix fits and the local name has no hyphen, dot or blank."""
    cut = max(uri.rfind("#"), uri.rfind("/")) + 1
    local = uri[cut:]
    name = next((p for p, ns in prefixes.items() if ns == uri[:cut]), None)
    return f"{name}:{local}" if name and local and not re.search(r"[-.\s]", local) else f"<{uri}>"


def _datatype(name: str) -> str:
    return name if name.startswith("xsd:") else f"<{name}>"


def _object(o: ObjectMap, prefixes: dict[str, str]) -> str:
    if o.parent:
        joins = " ; ".join(f'rr:joinCondition [ rr:child "{c}" ; rr:parent "{p}" ]' for c, p in o.joins)
        return f"[ rr:parentTriplesMap <#{o.parent}> ; {joins} ]"
    if o.template:
        return f'[ rr:template "{o.template}" ]'
    if o.constant:
        return f"[ rr:constant {predicate(o.constant, prefixes)} ]"
    kind = " ; rr:termType rr:IRI" if o.iri else f" ; rr:datatype {_datatype(o.datatype)}" if o.datatype else ""
    return f'[ rr:column "{o.column}"{kind} ]'


#: Order of the maps in a document.
_ORDER = {"SH": 0, "SR": 1, "SE": 2, "TYPE": 3}


def write(mapping: Mapping) -> str:
    """The document: subtypes, relations, entities, then type assertions."""
    prefixes = PREFIXES | mapping.prefixes
    lines = [f"@prefix {p}: <{ns}> ." for p, ns in prefixes.items()] + [f"@base <{mapping.base}> .", ""]
    for m in sorted(mapping.maps, key=lambda m: _ORDER.get(m.pattern, 2)):
        query = logical_table(m).replace("\\", "\\\\").replace('"', '\\"')
        subject = f'rr:column "{m.subject.strip("{}")}" ; rr:termType rr:IRI' if m.subject_is_iri_column else f'rr:template "{m.subject}"'
        classes = "".join(f" ; rr:class {predicate(c, prefixes)}" for c in m.classes)
        lines.append(f"# {m.table} ({m.pattern})")
        parts = [f"<#{m.name}> a rr:TriplesMap", f'    rr:logicalTable [ rr:sqlQuery "{query}" ]', f"    rr:subjectMap [ {subject}{classes} ]"]
        parts += [f"    rr:predicateObjectMap [ rr:predicate {predicate(po.predicate, prefixes)} ; rr:objectMap {_object(po.object, prefixes)} ]" for po in m.properties]
        lines += [" ;\n".join(parts) + " .", ""]
    return "\n".join(lines)


def _literal(text: str) -> str | int | bool:
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else text.strip("'").replace("''", "'")


def read(text: str) -> Mapping:
    """Documents of the form that ``write`` gives: SELECT ... FROM one table, with at most one equality."""
    triples = turtle.parse(text)
    by: dict[str, dict[str, list[turtle.Term]]] = {}
    for s, p, o in triples:
        by.setdefault(s.value, {}).setdefault(p.value, []).append(o)
    one = lambda node, name: (by.get(node, {}).get(RR + name) or [None])[0]
    maps = []
    for s, fields in by.items():
        if RR + "logicalTable" not in fields:
            continue
        table_node = fields[RR + "logicalTable"][0].value
        query, name = one(table_node, "sqlQuery"), one(table_node, "tableName")
        table, condition = (name.value.strip('"') if name else ""), None
        if query:
            m = re.fullmatch(r'\s*SELECT\s.*?\sFROM\s+"?([^"\s]+)"?(?:\s+WHERE\s+"?([^"=]+?)"?\s*=\s*(.+?))?\s*', query.value, re.S | re.I)
            if not m:
                raise ValueError(f"logical table not understood: {query.value}")
            table, condition = m[1], Condition(m[2], _literal(m[3])) if m[2] else None
        subject = fields[RR + "subjectMap"][0].value
        template, column = one(subject, "template"), one(subject, "column")
        properties = []
        for po in fields.get(RR + "predicateObjectMap", []):
            obj = one(po.value, "objectMap").value
            get = lambda n, obj=obj: (one(obj, n).value if one(obj, n) else None)
            joins = tuple((one(j.value, "child").value, one(j.value, "parent").value) for j in by.get(obj, {}).get(RR + "joinCondition", []))
            kind = get("datatype")
            parent = get("parentTriplesMap")
            properties.append(PredicateObject(one(po.value, "predicate").value, ObjectMap(get("column"), get("template"), get("constant"), kind.replace(turtle.XSD, "xsd:") if kind else None, get("termType") == RR + "IRI", parent.rpartition("#")[2] if parent else None, joins)))
        classes = tuple(t.value for t in by.get(subject, {}).get(RR + "class", []))
        maps.append(TriplesMap(s.rpartition("#")[2], table, template.value if template else "{" + column.value + "}", classes, tuple(properties), condition, template is None))
    base = re.search(r"@base\s+<([^>]*)>", text)
    extra = {p: ns for p, ns in turtle.prefixes(text).items() if PREFIXES.get(p) != ns}
    return Mapping(maps, base[1] if base else "", extra)
