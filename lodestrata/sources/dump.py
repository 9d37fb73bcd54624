"""Plain SQL dumps: CREATE TABLE, COPY blocks and keys added by ALTER TABLE, as a catalog.

The statements are small and read on the driver; a COPY block of any size is better loaded with ``from_jdbc`` or as
tab-separated files with ``read_copy_files``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.catalog import Catalog, ForeignKey

_ID = r'((?:"[^"]+"|\w+)(?:\.(?:"[^"]+"|\w+))?)'
_CREATE = re.compile(rf"CREATE TABLE\s+(?:ONLY\s+)?{_ID}\s*\((.*?)\n\);", re.S | re.I)
_COPY = re.compile(rf"^COPY\s+{_ID}\s*\(([^)]*)\)\s+FROM stdin;\n(.*?)^\\\.$", re.S | re.M | re.I)
_KEY = re.compile(rf"ALTER TABLE\s+(?:ONLY\s+)?{_ID}\s+ADD CONSTRAINT\s+{_ID}\s+PRIMARY KEY\s*\(([^)]*)\)", re.I)
_REFERENCE = re.compile(rf"ALTER TABLE\s+(?:ONLY\s+)?{_ID}\s+ADD CONSTRAINT\s+{_ID}\s+FOREIGN KEY\s*\(([^)]*)\)\s+REFERENCES\s+{_ID}\s*\(([^)]*)\)", re.I)
_SCHEMA = re.compile(r"CREATE SCHEMA\s+(?:IF NOT EXISTS\s+)?\"?(\w+)\"?", re.I)
_ESCAPES = {"\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\v": "\v", "\\\\": "\\"}
#: Names of SQL types and Spark's for them, tried in this order.
_TYPES = (("bigint", "bigint"), ("smallint", "smallint"), ("int", "int"), ("serial", "int"), ("bool", "boolean"), ("timestamp", "timestamp"), ("date", "date"), ("double", "double"), ("real", "float"), ("numeric", "decimal(38,10)"), ("decimal", "decimal(38,10)"), ("bytea", "binary"))


def _name(text: str) -> str:
    return re.split(r'\.(?=(?:[^"]*"[^"]*")*[^"]*$)', text.strip())[-1].strip('"')


def _names(text: str) -> tuple[str, ...]:
    return tuple(_name(x) for x in text.split(","))


def spark_type(sql_type: str) -> str:
    low = sql_type.lower()
    return next((s for part, s in _TYPES if part in low), "string")


def schema_of(text: str) -> str:
    """The schema that the head of a dump creates, or ``public``."""
    m = _SCHEMA.search(text[:4000])
    return m[1] if m else "public"


def unescape(column):
    """COPY's text form: ``\\N`` is null, backslash sequences are characters."""
    text = F.replace(column, F.lit("\\\\"), F.lit("\x00"))
    for code, char in _ESCAPES.items():
        if code != "\\\\":
            text = F.replace(text, F.lit(code), F.lit(char))
    return F.when(column != "\\N", F.replace(text, F.lit("\x00"), F.lit("\\")))


def _typed(lines: DataFrame, columns: tuple[str, ...], types: dict[str, str]) -> DataFrame:
    parts = F.split("value", "\t")
    return lines.select(*[unescape(parts[i]).cast(types.get(c, "string")).alias(c) for i, c in enumerate(columns)])


def read_copy_files(spark: SparkSession, path: str, columns: list[str], types: dict[str, str]) -> DataFrame:
    """Files of COPY lines, read and split by the executors."""
    return _typed(spark.read.text(path), tuple(columns), types)


def load_dump(spark: SparkSession, text: str) -> Catalog:
    types, tables = {}, {}
    for name, body in _CREATE.findall(text):
        columns = {}
        for line in body.split("\n"):
            m = re.match(r'\s*("[^"]+"|\w+)\s+(.+?),?\s*$', line)
            if m and m[1].upper() not in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK"):
                columns[m[1].strip('"')] = spark_type(re.sub(r"\s+(NOT NULL|DEFAULT).*", "", m[2], flags=re.I))
        types[_name(name)] = columns
    for name, columns, block in _COPY.findall(text):
        table = _name(name)
        lines = spark.createDataFrame([(x,) for x in block.split("\n")[:-1]], "value string")
        tables[table] = _typed(lines, _names(columns), types.get(table, {}))
    for table, columns in types.items():
        if table not in tables:
            tables[table] = spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in columns.items()) or "nothing string")
    keys = {_name(t): _names(c) for t, _, c in _KEY.findall(text)}
    foreign = [ForeignKey(_name(t), _names(c), _name(r), _names(rc), _name(n)) for t, n, c, r, rc in _REFERENCE.findall(text)]
    return Catalog(tables, keys, foreign)
