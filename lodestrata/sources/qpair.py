"""Query pairs (a SPARQL query and the SQL that gives its gold answer) and the folders that hold them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class QueryPair:
    name: str
    sql: str
    sparql: str
    order: int = 0
    categories: tuple[str, ...] = ()
    id_columns: tuple[str, ...] = ()
    id_variables: tuple[str, ...] = ()
    disabled: bool = False
    comment: str = ""


def _list(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def parse_pair(text: str) -> QueryPair:
    """``key = value`` lines; a value goes on after a backslash at the end of a line."""
    joined = re.sub(r"(?:\\n)?\\\r?\n\s*", " ", text)
    fields = {}
    for line in joined.splitlines():
        key, eq, value = line.partition("=")
        if eq and not key.lstrip().startswith("#"):
            fields[key.strip()] = re.sub(r"\\n", " ", value).strip()
    return QueryPair(
        fields.get("name", ""),
        fields.get("sql", ""),
        fields.get("sparql", ""),
        int(fields.get("orderNum") or 0),
        _list(fields.get("categories", "")),
        _list(fields.get("entityIdCols", "")),
        _list(fields.get("entityIdVars", "")),
        fields.get("disabled", "").lower() == "true",
        fields.get("comment", ""),
    )


def load_pairs(folder: str | Path, disabled: bool = False) -> list[QueryPair]:
    pairs = [parse_pair(p.read_text()) for p in sorted(Path(folder).glob("*.qpair"))]
    return sorted((p for p in pairs if disabled or not p.disabled), key=lambda p: (p.order, p.name))


@dataclass(frozen=True)
class Scenario:
    name: str
    folder: Path

    @property
    def missing(self) -> list[str]:
        """Which of its parts aren't there."""
        there = {"dump.sql": (self.folder / "dump.sql").is_file(), "ontology.ttl": (self.folder / "ontology.ttl").is_file(), "queries": any((self.folder / "queries").glob("*.qpair"))}
        return [k for k, ok in there.items() if not ok]


def scenarios(root: str | Path) -> list[Scenario]:
    return [Scenario(p.name, p) for p in sorted(Path(root).iterdir()) if p.is_dir()]


def choose(found: list[Scenario], names: str = "all") -> list[Scenario]:
    """``all``, or names separated by commas; an unknown name is an error."""
    if names.strip().lower() == "all":
        return found
    by_name = {s.name: s for s in found}
    wanted = list(dict.fromkeys(_list(names)))
    if unknown := [n for n in wanted if n not in by_name]:
        raise KeyError(f"no scenario {', '.join(unknown)}; there are {', '.join(by_name)}")
    return [by_name[n] for n in wanted]


def require_complete(found: list[Scenario]) -> None:
    if bad := {s.name: s.missing for s in found if s.missing}:
        raise FileNotFoundError("; ".join(f"{n} lacks {', '.join(m)}" for n, m in bad.items()))
