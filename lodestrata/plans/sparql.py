"""A SPARQL subset as DataFrame plans.

SELECT of variables or COUNT; basic graph patterns with ``;`` and ``,`` lists, blank-node property lists and full or
prefixed names; OPTIONAL, FILTER with comparisons, arithmetic, && and ||, and FILTER NOT EXISTS.

Patterns are planned against a mapping where one is given: the patterns that share a subject are answered by one scan
of each map whose rows are unique in its subject (a star needs no join).  A variable that stands for IRIs of one
template is carried as the template's columns: joins, DISTINCT and COUNT work on these, an IRI in the query becomes a
condition on them that reaches the scan, and IRIs are built in the last projection.  Where that isn't sound (another
template, columns that are neither integers nor texts, joined objects, variable predicates), and for plain graphs,
values are the IRIs themselves and patterns read triples, filtered by predicate.

Solutions are compatible as the standard says: a variable that an OPTIONAL left unbound agrees with any value and takes
it.  A filter on an unbound variable isn't true.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.iri import encode, expand, template_columns
from lodestrata.plans import materialize
from lodestrata.plans.r2rml import Mapping, TriplesMap
from lodestrata.sources.catalog import Catalog
from lodestrata.sources.turtle import RDF, XSD

TYPE = RDF + "type"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      |(?P<op>&&|\|\||!=|<=|>=|\^\^|[{}()\[\].;,*=<>!+/-])|(?P<number>\d+(?:\.\d+)?)|(?P<name>(?:[A-Za-z][\w-]*)?:(?:[\w-]|\.(?=[\w-]))*)|(?P<lang>@[\w-]+)|(?P<word>[A-Za-z]+)""",
    re.X,
)


class SparqlError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: str
    literal: bool = False
    datatype: str | None = None


Node = Var | Const


@dataclass(frozen=True)
class Pattern:
    s: Node
    p: Const | Var
    o: Node


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    filters: list[tuple] = field(default_factory=list)
    absent: list[Group] = field(default_factory=list)


@dataclass
class Query:
    variables: list[str]  # empty: all
    where: Group
    count: tuple[str | None, str] | None = None  # (variable or None for *, name of the result)
    distinct: bool = False


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"cannot read {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
        self.at, self.blanks = 0, 0
        self.prefixes = {"rdf": RDF, "xsd": XSD, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#"}  # known without a declaration

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or expected and self.word() != expected:
            raise SparqlError(f"expected {expected or 'more'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def query(self) -> Query:
        while self.word() in ("PREFIX", "BASE"):
            self.take()
            name = self.take()[1].rstrip(":")
            self.prefixes[name] = self.take()[1][1:-1]
        self.take("SELECT")
        distinct = self.word() == "DISTINCT"
        if distinct:
            self.take()
        variables, count = [], None
        while self.word() not in ("WHERE", "{"):
            if self.peek() == "(":
                self.take()
                self.take("COUNT")
                self.take("(")
                inner_distinct = self.word() == "DISTINCT"
                if inner_distinct:
                    self.take()
                what = self.take()[1]
                self.take(")")
                self.take("AS")
                count = (("distinct " if inner_distinct else "") + what.lstrip("?$") if what != "*" else None, self.take()[1].lstrip("?$"))
                self.take(")")
            elif self.peek() == "*":
                self.take()
            else:
                variables.append(self.take()[1].lstrip("?$"))
        if self.word() == "WHERE":
            self.take()
        where = self.group()
        if self.at != len(self.tokens):
            raise SparqlError(f"not supported: {self.peek()!r}")
        return Query(variables, where, count, distinct)

    def group(self) -> Group:
        self.take("{")
        g = Group()
        while self.peek() != "}":
            if self.word() == "OPTIONAL":
                self.take()
                g.optionals.append(self.group())
            elif self.word() == "FILTER":
                self.take()
                if self.word() == "NOT":
                    self.take()
                    self.take("EXISTS")
                    g.absent.append(self.group())
                else:
                    self.take("(")
                    g.filters.append(self.disjunction())
                    self.take(")")
            elif self.peek() == ".":
                self.take()
            else:
                self.subject(g)
        self.take("}")
        return g

    def subject(self, g: Group) -> None:
        s = self.node(g)
        if self.peek() not in (".", "}"):
            self.properties(g, s)

    def properties(self, g: Group, s: Node) -> None:
        while True:
            p = Const(TYPE) if self.peek() == "a" else None
            if p:
                self.take()
            else:
                p = self.node(g)
            while True:
                g.patterns.append(Pattern(s, p, self.node(g)))
                if self.peek() != ",":
                    break
                self.take()
            if self.peek() != ";":
                return
            while self.peek() == ";":
                self.take()
            if self.peek() in (".", "]", "}"):
                return

    def node(self, g: Group) -> Node:
        kind, text = self.take()
        if kind == "var":
            return Var(text[1:])
        if text == "[":
            self.blanks += 1
            blank = Var(f"_blank{self.blanks}")
            if self.peek() != "]":
                self.properties(g, blank)
            self.take("]")
            return blank
        return self.constant(kind, text)

    def constant(self, kind: str, text: str) -> Const:
        if kind == "iri":
            return Const(text[1:-1])
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"no prefix {prefix!r}")
            return Const(self.prefixes[prefix] + local)
        if kind == "number":
            return Const(text, True, XSD + ("decimal" if "." in text else "integer"))
        if kind == "text":
            value = re.sub(r"\\(.)", r"\1", text[1:-1])
            if self.peek() == "^^":
                self.take()
                return Const(value, True, self.constant(*self.take()).value)
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                self.take()
            return Const(value, True)
        if text.lower() in ("true", "false"):
            return Const(text.lower(), True, XSD + "boolean")
        raise SparqlError(f"unexpected {text!r}")

    def disjunction(self) -> tuple:
        return self._chain(("||",), self.conjunction)

    def conjunction(self) -> tuple:
        return self._chain(("&&",), self.comparison)

    def comparison(self) -> tuple:
        left = self.sum()
        if self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            return (self.take()[1], left, self.sum())
        return left

    def sum(self) -> tuple:
        return self._chain(("+", "-"), self.product)

    def product(self) -> tuple:
        return self._chain(("*", "/"), self.unary)

    def _chain(self, operators: tuple[str, ...], below: Callable[[], tuple]) -> tuple:
        left = below()
        while self.peek() in operators:
            left = (self.take()[1], left, below())
        return left

    def unary(self) -> tuple:
        if self.peek() == "!":
            self.take()
            return ("!", self.unary())
        if self.peek() == "(":
            self.take()
            inner = self.disjunction()
            self.take(")")
            return inner
        kind, text = self.take()
        return ("var", text[1:]) if kind == "var" else ("const", self.constant(kind, text))


def parse(text: str) -> Query:
    return _Parser(text).query()


NUMERIC = ("int", "integer", "decimal", "double", "float", "long", "short", "nonNegativeInteger", "unsignedInt", "unsignedLong")


Shape = tuple[tuple[str, ...], tuple[str, ...]]  # a template's fixed parts and the kinds of its columns


@dataclass
class Rows:
    """Solutions: a column for each variable, or, for IRIs of one template, one for each column of it (``name/0`` ...)."""

    df: DataFrame
    terms: dict[str, Shape | None]
    loose: set[str] = field(default_factory=set)  # variables that may be unbound

    def cells(self, name: str) -> list[str]:
        shape = self.terms[name]
        return [name] if shape is None else [f"{name}/{i}" for i in range(len(shape[1]))]

    def value(self, name: str) -> Column:
        """The variable as one column; null if unbound."""
        if name not in self.terms:
            return F.lit(None).cast("string")
        shape = self.terms[name]
        return F.col(_column(name)) if shape is None else build(shape, [F.col(_column(c)) for c in self.cells(name)])

    def plain(self, names: set[str]) -> Rows:
        """With these variables as single columns."""
        if not any(self.terms.get(n) for n in names):
            return self
        keep = [self.value(n).alias(n) if n in names else F.col(_column(c)) for n in self.terms for c in ([n] if n in names else self.cells(n))]
        return Rows(self.df.select(*keep), {n: None if n in names else t for n, t in self.terms.items()}, self.loose)


def build(shape: Shape, columns: list[Column]) -> Column:
    """The IRIs."""
    parts = [F.lit(shape[0][0])]
    for column, fixed in zip(columns, shape[0][1:], strict=True):
        parts += [encode(column), F.lit(fixed)]
    return F.concat(*parts)


def shape_of(df: DataFrame, template: str) -> Shape | None:
    """None unless all columns are integers or texts: of these, equal IRIs mean equal values."""
    kinds = {"byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "string": "text"}
    found = [kinds.get(df.schema[c].dataType.typeName()) for c in template_columns(template)]
    return None if not found or None in found else (tuple(re.split(r"\{[^{}]+\}", template)), tuple(found))


_CODED = re.compile("[/#?:]")  # never in an encoded value


def disjoint(a: Shape, b: Shape) -> bool:
    """Whether no IRI fits both templates."""
    (short, _), (long_, _) = sorted((a, b), key=lambda x: len(x[0][0]))
    if not long_[0].startswith(short[0]):
        return True
    return bool(_CODED.search(long_[0][len(short[0]) :])) and not any(map(_CODED.search, short[1:]))


def values_in(shape: Shape, uri: str) -> list[int | str] | None:
    """The columns' values for which the template gives this IRI, or None; of several texts only where no other split fits."""
    forms = {"integer": r"(0|-?[1-9]\d{0,18})", "text": r"((?:[A-Za-z0-9_.~-]|%[0-9A-F]{2})*)"}
    pattern = re.escape(shape[0][0]) + "".join(forms[k] + re.escape(p) for k, p in zip(shape[1], shape[0][1:], strict=True))
    m = re.fullmatch(pattern, uri)
    return [int(x) if k == "integer" else unquote(x) for k, x in zip(shape[1], m.groups(), strict=True)] if m else None


class Graph:
    """What patterns are answered from."""

    def class_family(self, uri: str) -> list[str]:
        return [uri]

    def predicate_family(self, uri: str) -> list[str]:
        return [uri]

    def star(self, subject: Node, patterns: list[Pattern]) -> Rows | None:
        """All patterns of one subject at once, or None."""
        return None

    def pattern(self, pattern: Pattern) -> Rows:
        raise NotImplementedError


def _column(name: str) -> str:
    return f"`{name}`"


class TripleGraph(Graph):
    """Triples (s, p, o, datatype) and, optionally, class and property hierarchies (child, ancestor)."""

    def __init__(self, triples: DataFrame, subclasses: DataFrame | None = None, subproperties: DataFrame | None = None):
        self.triples = triples
        self.below: dict[str, list[str]] = {}
        for closed in (subclasses, subproperties):
            for r in closed.select("child", "ancestor").distinct().collect() if closed is not None else []:  # of ontology size
                self.below.setdefault(r["ancestor"], []).append(r["child"])

    def class_family(self, uri: str) -> list[str]:
        return sorted({uri, *self.below.get(uri, [])})

    predicate_family = class_family

    def pattern(self, pattern: Pattern) -> Rows:
        t = self.triples
        more = False
        if isinstance(pattern.p, Const):
            names = [TYPE] if pattern.p.value == TYPE else self.predicate_family(pattern.p.value)
            more |= len(names) > 1
            t = t.where(F.col("p").isin(*names))
        if isinstance(pattern.s, Const):
            t = t.where(F.col("s") == pattern.s.value)
        if isinstance(pattern.o, Const):
            names = self.class_family(pattern.o.value) if isinstance(pattern.p, Const) and pattern.p.value == TYPE else [pattern.o.value]
            more |= len(names) > 1
            t = t.where(F.col("o").isin(*names) & (F.col("o_kind") == ("literal" if pattern.o.literal else "iri")))
        cells, seen = [], {}
        for side, node in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
            if isinstance(node, Var):
                if node.name in seen:
                    t = t.where(F.col(side) == F.col(seen[node.name]))
                else:
                    seen[node.name] = side
                    cells.append(F.col(side).alias(node.name))
        out = t.select(*cells) if cells else t.select(F.lit(1).alias("_there")).limit(1)
        return Rows(out.distinct() if more and cells else out, dict.fromkeys(seen))


class MappedGraph(Graph):
    """A mapping over a catalog, queried without building its triples."""

    def __init__(self, catalog: Catalog, mapping: Mapping, subclasses: DataFrame | None = None, subproperties: DataFrame | None = None):
        self.catalog, self.mapping = catalog, mapping
        self.fallback = None
        self.families = TripleGraph(next(iter(catalog.tables.values())), subclasses, subproperties)
        self.class_family, self.predicate_family = self.families.class_family, self.families.predicate_family

    def _maps_with(self, p: Node, o: Node) -> list[TriplesMap]:
        if isinstance(p, Var):
            return self.mapping.maps
        if p.value == TYPE:
            wanted = set(self.class_family(o.value)) if isinstance(o, Const) else None
            return [m for m in self.mapping.maps if m.classes and (wanted is None or wanted & set(m.classes))]
        wanted = set(self.predicate_family(p.value))
        return [m for m in self.mapping.maps if any(po.predicate in wanted for po in m.properties)]

    def star(self, subject: Node, patterns: list[Pattern]) -> Rows | None:
        """One scan of the one map that has all the patterns: its rows are unique in the subject, and no other map speaks of them."""
        if any(isinstance(p.p, Var) for p in patterns):
            return None
        only = {id(m): m for p in patterns for m in self._maps_with(p.p, p.o)}
        if len(only) != 1:
            return None
        m = next(iter(only.values()))
        if not _keyed(m):
            return None
        scan = _Scan(materialize.rows_of(self.catalog, m))
        if not scan.subject(subject, m):
            return None
        for p in patterns:
            if p.p.value == TYPE:
                if isinstance(p.o, Var):
                    return None
                continue
            objects = [po for po in m.properties if po.predicate in self.predicate_family(p.p.value)]
            if len(objects) != 1 or objects[0].object.parent or isinstance(p.o, Var) and p.o.name in scan.terms:
                return None
            scan.object(p.o, objects[0].object)
        return scan.rows()

    def pattern(self, pattern: Pattern) -> Rows:
        """Scans of the maps that have the pattern, put together by the templates of their terms."""
        maps = self._maps_with(pattern.p, pattern.o)
        names = list(dict.fromkeys(n.name for n in (pattern.s, pattern.p, pattern.o) if isinstance(n, Var)))
        if not maps:
            spark = next(iter(self.catalog.tables.values())).sparkSession
            return Rows(spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names) or "_there int"), dict.fromkeys(names))
        typed = isinstance(pattern.p, Const) and pattern.p.value == TYPE
        family = None if isinstance(pattern.p, Var) or typed else self.predicate_family(pattern.p.value)
        objects = [(m, po.object) for m in maps for po in m.properties if family and po.predicate in family]
        plain = isinstance(pattern.p, Const) and names and not (typed and isinstance(pattern.o, Var)) and not (isinstance(pattern.s, Var) and pattern.s == pattern.o) and not any(o.parent for _, o in objects)
        if not plain:
            return self._from_triples(pattern, maps, family)
        number = self._number_type(maps, family) if self._all_numeric(maps, family) else None
        groups: dict[tuple, list[tuple[Rows, bool]]] = {}
        for m, o in [(m, None) for m in maps] if typed else objects:
            scan = _Scan(materialize.rows_of(self.catalog, m), number)
            if not scan.subject(pattern.s, m):
                continue  # the IRI is not of this map's template
            if o is not None:
                scan.object(pattern.o, o)
            rows = scan.rows()
            groups.setdefault(tuple(rows.terms.values()), []).append((rows, _keyed(m)))
        if not groups:
            return self.pattern(Pattern(pattern.s, Const("urn:none"), pattern.o))
        made = []
        for same in groups.values():
            df = reduce(DataFrame.unionByName, [r.df for r, _ in same])
            unique = len(same) == 1 and same[0][1]
            made.append(Rows(df if unique else df.distinct(), same[0][0].terms))
        if len(made) == 1:
            return made[0]
        apart = lambda a, b: any(x and y and disjoint(x, y) for x, y in zip(a.terms.values(), b.terms.values(), strict=True))
        every = all(apart(a, b) for i, a in enumerate(made) for b in made[:i])
        df = reduce(DataFrame.unionByName, [r.plain(set(names)).df for r in made])
        return Rows(df if every else df.distinct(), dict.fromkeys(names))

    def _from_triples(self, pattern: Pattern, maps: list[TriplesMap], keep: list[str] | None) -> Rows:
        parts = []
        for m in maps:
            own = tuple(po for po in m.properties if po.predicate in keep) if keep is not None else () if isinstance(pattern.p, Const) else m.properties
            classes = m.classes if keep is None else ()
            slim = TriplesMap(m.name, m.table, m.subject, classes, own, m.condition, m.subject_is_iri_column, m.key)
            parts.append(materialize.map_triples(self.catalog, self.mapping, slim))
        t = reduce(DataFrame.unionByName, parts)
        graph = TripleGraph(t if len(maps) == 1 and _keyed(maps[0]) else t.distinct())
        graph.below = self.families.below
        out = graph.pattern(pattern)
        if isinstance(pattern.o, Var) and self._all_numeric(maps, keep) and pattern.o.name in out.terms:
            out.df = out.df.withColumn(pattern.o.name, F.col(_column(pattern.o.name)).cast(self._number_type(maps, keep)))
        return out

    def _objects(self, maps: list[TriplesMap], keep: list[str] | None) -> list:
        return [(m, po.object) for m in maps for po in m.properties if keep and po.predicate in keep]

    def _all_numeric(self, maps: list[TriplesMap], keep: list[str] | None) -> bool:
        objects = self._objects(maps, keep)
        return bool(objects) and all(o.column and not o.iri and (o.datatype or "").removeprefix("xsd:").removeprefix(XSD) in NUMERIC for _, o in objects)

    def _number_type(self, maps: list[TriplesMap], keep: list[str] | None) -> str:
        kinds = {self.catalog.tables[m.table].schema[o.column].dataType.simpleString() for m, o in self._objects(maps, keep)}
        return kinds.pop() if len(kinds) == 1 else "double"


def _keyed(m: TriplesMap) -> bool:
    """Whether no two rows of the map have the same subject."""
    return bool(m.key) and set(template_columns(m.subject)) == set(m.key)


class _Scan:
    """Columns and conditions on the rows of one map."""

    def __init__(self, df: DataFrame, number: str | None = None):
        self.df, self.number = df, number
        self.cells: list[Column] = []
        self.terms: dict[str, Shape | None] = {}
        self.conditions: list[Column] = []

    def _template(self, node: Node, template: str) -> bool:
        shape = shape_of(self.df, template)
        columns = [F.col(_column(c)) for c in template_columns(template)]
        if isinstance(node, Var):
            self.terms[node.name] = shape
            if shape is None:
                self.cells.append(expand(template).alias(node.name))
            else:
                self.cells += [(c.cast("long") if k == "integer" else c).alias(f"{node.name}/{i}") for i, (c, k) in enumerate(zip(columns, shape[1], strict=True))]
            return True
        if shape is None or shape[1].count("text") > 1:
            self.conditions.append(expand(template) == node.value)
            return True
        values = values_in(shape, node.value)
        self.conditions += [c == v for c, v in zip(columns, values or [], strict=False)] if values else [F.lit(False)]
        return values is not None

    def subject(self, node: Node, m: TriplesMap) -> bool:
        """False if no row of the map can have this subject."""
        if not m.subject_is_iri_column:
            return self._template(node, m.subject)
        self._column(node, materialize.subject_of(m))
        return True

    def object(self, node: Node, o) -> None:
        if isinstance(node, Const) and node.literal != bool(o.column and not o.iri):
            self.conditions.append(F.lit(False))
        elif o.template:
            self._template(node, o.template)
        else:
            value, kind, datatype = materialize._term(self.df, o)
            if kind == "literal" and isinstance(node, Var) and (self.number or datatype.removeprefix(XSD) in NUMERIC):
                value = F.col(_column(o.column))
            self._column(node, value.cast(self.number) if self.number and isinstance(node, Var) else value)

    def _column(self, node: Node, value: Column) -> None:
        if isinstance(node, Var):
            self.terms[node.name] = None
            self.cells.append(value.alias(node.name))
        else:
            self.conditions.append(value.cast("string") == node.value)

    def rows(self) -> Rows:
        df = reduce(DataFrame.where, self.conditions, self.df)
        if not self.cells:
            return Rows(df.select(F.lit(1).alias("_there")).limit(1), {})
        df = df.select(*self.cells)
        return Rows(df.dropna(subset=[_column(c) if "." in c else c for c in df.columns]), self.terms)


def _join(left: Rows | None, right: Rows, how: str = "inner", filters: tuple | list = ()) -> Rows:
    """Compatible solutions for which the filters hold; unbound variables are compatible with anything."""
    if left is None:
        return right
    shared = [n for n in right.terms if n in left.terms]
    unlike = {n for n in shared if left.terms[n] != right.terms[n]}
    left, right = left.plain(unlike), right.plain(unlike)
    loose = {n for n in shared if n in left.loose or n in right.loose}
    if not shared and not filters and how == "inner" and left.terms and right.terms:
        warnings.warn("patterns without a common variable: their solutions are multiplied", stacklevel=2)
    twin = {c: f"_r/{c}" for n in shared for c in right.cells(n)}
    there = right.df.select(*[F.col(_column(c)).alias(twin.get(c, c)) for c in right.df.columns if c != "_there"] or [F.lit(1).alias("_there_too")])
    conditions = []
    for n in shared:
        same = reduce(lambda a, b: a & b, [F.col(_column(c)) == F.col(_column(twin[c])) for c in right.cells(n)])
        unbound = lambda names: F.col(_column(names[0])).isNull()
        conditions.append(same | unbound(left.cells(n)) | unbound([twin[c] for c in right.cells(n)]) if n in loose else same)

    def value(name: str) -> Column:
        if name in loose:
            mine = Rows(left.df, {name: left.terms[name]}).value(name)
            shape = right.terms[name]
            other = [F.col(_column(twin[c])) for c in right.cells(name)]
            return F.coalesce(mine, other[0] if shape is None else build(shape, other))
        return left.value(name) if name in left.terms else right.value(name)

    conditions += [expression(f, value) for f in filters]
    out = left.df.join(there, reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True), how)
    if how == "left_anti":
        return Rows(out, left.terms, left.loose)
    terms = left.terms | {n: t for n, t in right.terms.items() if n not in left.terms}
    filled = {c: F.coalesce(F.col(_column(c)), F.col(_column(twin[c]))) for n in loose for c in right.cells(n)}
    cells = [c for n in terms for c in Rows(out, terms).cells(n)]
    out = out.select(*[filled.get(c, F.col(_column(c))).alias(c) for c in cells] or [F.lit(1).alias("_there")])
    if how == "left":
        return Rows(out, terms, left.loose | {n for n in right.terms if n not in left.terms})
    return Rows(out, terms, {n for n in left.loose | right.loose if n not in shared or n in left.loose and n in right.loose})


def _group(graph: Graph, g: Group) -> Rows:
    out: Rows | None = None
    by_subject: dict[Node, list[Pattern]] = {}
    for p in g.patterns:
        by_subject.setdefault(p.s, []).append(p)
    units: list[Rows] = []
    for subject, patterns in by_subject.items():
        whole = graph.star(subject, patterns) if len(patterns) > 1 or isinstance(patterns[0].p, Const) else None
        units += [whole] if whole is not None else [graph.pattern(p) for p in patterns]
    while units:  # connected patterns first
        at = next((i for i, u in enumerate(units) if out is None or set(u.terms) & set(out.terms)), 0)
        out = _join(out, units.pop(at))
    for o in g.optionals:  # a condition may name outer variables: it belongs to the join
        out = _join(out, _group(graph, Group(o.patterns, o.optionals, [], o.absent)), "left", o.filters)
    for f in g.filters:
        out = Rows(out.df.where(expression(f, out.value)), out.terms, out.loose)
    for a in g.absent:
        out = _join(out, _group(graph, Group(a.patterns, a.optionals, [], a.absent)), "left_anti", a.filters)
    return out


def expression(e: tuple, value: Callable[[str], Column]) -> Column:
    kind = e[0]
    if kind == "var":
        return value(e[1])
    if kind == "const":
        c: Const = e[1]
        if c.literal and (c.datatype or "").removeprefix(XSD) in ("integer", "int"):
            return F.lit(int(c.value))
        if c.literal and (c.datatype or "").removeprefix(XSD) in NUMERIC:
            return F.lit(float(c.value))
        return F.lit(c.value)
    if kind == "!":
        return ~expression(e[1], value)
    a, b = expression(e[1], value), expression(e[2], value)
    return {
        "&&": lambda: a & b, "||": lambda: a | b, "=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b,
        "<=": lambda: a <= b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b,
    }[kind]()


def run(graph: Graph, text: str) -> DataFrame:
    """Solutions as rows (a bag), or the one row of a COUNT."""
    q = parse(text)
    rows = _group(graph, q.where)
    if q.count:
        what, name = q.count
        if what is None:
            return rows.df.agg(F.count(F.lit(1)).alias(name))
        distinct = what.startswith("distinct ")
        cells = [F.col(_column(c)) for c in rows.cells(what.removeprefix("distinct "))]
        return rows.df.agg((F.count_distinct(*cells) if distinct else F.count(cells[0])).alias(name))
    names = q.variables or [n for n in rows.terms if not n.startswith("_")]
    if q.distinct:
        known = [n for n in dict.fromkeys(names) if n in rows.terms]
        rows = Rows(rows.df.select(*[F.col(_column(c)) for n in known for c in rows.cells(n)]).distinct(), {n: rows.terms[n] for n in known}, rows.loose)
    return rows.df.select(*[rows.value(n).alias(n) for n in names])
