"""A reader for the Turtle that ontologies and mappings use: prefixes, base, lists, blank nodes, typed and tagged literals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TRIPLES_SCHEMA = "s string, p string, o string, o_kind string, datatype string, lang string"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
      | (?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<word>@prefix\b|@base\b|PREFIX\b|BASE\b|prefix\b(?=\s+\S*:\s*<)|base\b(?=\s+<))
      | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      | (?P<mark>\^\^|[.;,\[\]()](?![0-9])|[\[\]();,])
      | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![A-Za-z_]))
      | (?P<blank>_:[\w.-]*\w)
      | (?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\[^\w\s]|\.(?=[\w:%-]))*))
      | (?P<bare>[A-Za-z]\w*)
      | (?P<dot>\.)""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_ESCAPED = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Term:
    value: str
    kind: str = "iri"  # iri, blank or literal
    datatype: str | None = None
    lang: str | None = None


class TurtleError(ValueError):
    pass


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPED.get(m[1], m[1]), text)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"cannot read {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield ("mark" if m.lastgroup == "dot" else m.lastgroup), m[0]


class _Parser:
    def __init__(self, text: str, base: str = ""):
        self.tokens, self.at, self.base = list(_tokens(text)), 0, base
        self.prefixes: dict[str, str] = {}
        self.triples: list[tuple[Term, Term, Term]] = []
        self.blanks = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if value is not None and text != value or kind == "end":
            raise TurtleError(f"expected {value!r}, found {text!r}")
        self.at += 1
        return kind, text

    def fresh(self) -> Term:
        self.blanks += 1
        return Term(f"_:b{self.blanks}", "blank")

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return urljoin(self.base, _unescape(text[1:-1])) if self.base else _unescape(text[1:-1])
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"no prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def document(self) -> None:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "word":
                self.take()
                if "prefix" in text.lower():
                    name = self.take()[1].rstrip(":")
                    self.prefixes[name] = self.iri(*self.take())
                else:
                    self.base = self.iri(*self.take())
                if self.peek()[1] == ".":
                    self.take()
                continue
            subject = self.node()
            if self.peek()[1] != ".":
                self.properties(subject)
            self.take(".")

    def properties(self, subject: Term) -> None:
        while True:
            kind, text = self.take()
            verb = Term(RDF + "type") if text == "a" else Term(self.iri(kind, text))
            while True:
                self.triples.append((subject, verb, self.node()))
                if self.peek()[1] != ",":
                    break
                self.take(",")
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take(";")
            if self.peek()[1] in (".", "]", ""):
                return

    def node(self) -> Term:
        kind, text = self.take()
        if text == "[":
            inner = self.fresh()
            if self.peek()[1] != "]":
                self.properties(inner)
            self.take("]")
            return inner
        if text == "(":
            members = []
            while self.peek()[1] != ")":
                members.append(self.node())
            self.take(")")
            rest = Term(RDF + "nil")
            for m in reversed(members):
                cell = self.fresh()
                self.triples += [(cell, Term(RDF + "first"), m), (cell, Term(RDF + "rest"), rest)]
                rest = cell
            return rest
        if kind == "blank":
            return Term(text, "blank")
        if kind == "number":
            return Term(text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "bare" and text in ("true", "false"):
            return Term(text, "literal", XSD + "boolean")
        if kind == "text":
            value = _unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "lang":
                return Term(value, "literal", RDF + "langString", self.take()[1][1:])
            if self.peek()[1] == "^^":
                self.take()
                return Term(value, "literal", self.iri(*self.take()))
            return Term(value, "literal", XSD + "string")
        return Term(self.iri(kind, text))


def parse(text: str, base: str = "") -> list[tuple[Term, Term, Term]]:
    parser = _Parser(text, base)
    parser.document()
    return parser.triples


def prefixes(text: str) -> dict[str, str]:
    parser = _Parser(text)
    parser.document()
    return parser.prefixes


def triples_frame(spark: SparkSession, triples: list[tuple[Term, Term, Term]]) -> DataFrame:
    return spark.createDataFrame([(s.value, p.value, o.value, o.kind, o.datatype, o.lang) for s, p, o in triples], TRIPLES_SCHEMA)
