"""IRI templates, their encoding, and the test for absolute IRIs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "http://example.com/"
_PLACE = re.compile(r"\{([^{}]+)\}")


def encode(value: Column) -> Column:
    """Percent-encoding for IRIs: as for forms, but %20, %2A, and a plain tilde."""
    coded = F.url_encode(value.cast("string"))
    return F.replace(F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def template_columns(template: str) -> list[str]:
    return _PLACE.findall(template)


def expand(template: str, columns: dict[str, Column] | None = None, raw: bool = False) -> Column:
    """The template filled from the row; null if any of its columns is null."""
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        value = (columns or {}).get(m[1], F.col(f"`{m[1]}`"))
        parts.append(value.cast("string") if raw else encode(value))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def subject_template(iri_base: str, keys: list[str], base: str = BASE) -> str:
    """Base, table and key; the parts of a composite key are joined by two underscores."""
    return f"{base}{iri_base}/" + "__".join("{" + k + "}" for k in keys)


def iri_base(table: str) -> str:
    """Lower case, blanks as underscores, runs of underscores as one."""
    return re.sub(r"_+", "_", re.sub(r"\s+", "_", table.strip().lower()))


def safe_id(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", name)


def is_absolute(value: Column) -> Column:
    """A scheme of two letters or more and something after it; http needs a host, urn a namespace and a name."""
    scheme = F.lower(F.split_part(value, F.lit(":"), F.lit(1)))
    shaped = value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$")
    rest = F.when(scheme.isin("http", "https"), value.rlike(r"^[A-Za-z]+://[^\s/?#]+")).when(scheme == "urn", value.rlike(r"^[A-Za-z]+:[A-Za-z0-9][A-Za-z0-9-]*:[^\s]+")).otherwise(F.lit(True))
    return F.coalesce(shaped & (F.length(scheme) > 1) & rest, F.lit(False))
