"""Families of SQL and XSD types, and which of them go together.

The order of the tests is part of the rule: boolean, temporal, numeric, binary, text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a type's name, by family, in the order in which they are tested.
FAMILIES = (
    ("boolean", ("bool",)),
    ("temporal", ("date", "time")),
    ("numeric", ("int", "numeric", "decimal", "real", "double", "float")),
    ("binary", ("bytea", "binary", "blob")),
    ("text", ("char", "text", "string", "json", "xml", "uuid")),
)
#: XSD types by family, in lower case; they are compared without regard to case.
XSD_FAMILY_NAMES = {
    "boolean": "boolean",
    "temporal": "date datetime time duration",
    "numeric": "byte decimal double float int integer long negativeinteger nonnegativeinteger nonpositiveinteger positiveinteger short unsignedbyte unsignedint unsignedlong unsignedshort",
    "binary": "base64binary hexbinary",
    "text": "anyuri language name ncname normalizedstring qname string token",
}
XSD_FAMILIES = {name: kind for kind, names in XSD_FAMILY_NAMES.items() for name in names.split()}
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Types of columns that are never the source of an inclusion dependency, and such columns' names.
IND_EXCLUDED_TYPES = frozenset({"boolean", "date", "timestamp", "double precision", "double", "float"})
IND_EXCLUDED_COLUMNS = frozenset({"type", "status", "kind", "category", "flag", "code"})


def family(sql_type: str | None) -> str:
    low = (sql_type or "").lower()
    return next((name for name, parts in FAMILIES if any(p in low for p in parts)), "unknown")


def family_column(sql_type: Column) -> Column:
    low = F.lower(F.coalesce(sql_type, F.lit("")))
    tests = [(name, reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])) for name, parts in FAMILIES]
    out = F.when(tests[0][1], F.lit(tests[0][0]))
    for name, test in tests[1:]:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def xsd_family(uri: str | None) -> str:
    return XSD_FAMILIES.get(re.split("[#/:]", uri or "")[-1].lower(), "unknown")


def admits(sql_type: str | None, range_uris: list[str]) -> bool:
    """Only clear clashes are rejected: no declared or known range, a text range, or equal families pass; a number may hold a boolean."""
    sql = family(sql_type)
    ranges = {xsd_family(u) for u in range_uris}
    return not range_uris or sql == "unknown" or "unknown" in ranges or "text" in ranges or sql in ranges or (sql == "numeric" and "boolean" in ranges)


def agrees(sql_type: str | None, xsd_uri: str | None) -> bool:
    """The strict form: numbers, booleans and dates only with their own kind; other targets take anything."""
    sql, target = family(sql_type), xsd_family(xsd_uri)
    return target not in ("numeric", "boolean", "temporal") or sql in (target, "unknown")


def xsd_of(sql_type: str | None, range_uris: list[str] | tuple = ()) -> str:
    """The ontology's XSD range if there is one, else by the type's name; ``int`` is tested first here."""
    for uri in range_uris:
        if uri.startswith(XSD):
            return "xsd:" + uri.removeprefix(XSD)
    low = (sql_type or "").lower()
    if low == "date":
        return "xsd:date"
    for part, target in (("int", "int"), ("timestamp", "dateTime"), ("datetime", "dateTime"), ("float", "decimal"), ("double", "decimal"), ("numeric", "decimal"), ("decimal", "decimal"), ("bool", "boolean")):
        if part in low:
            return "xsd:" + target
    return "xsd:string"
