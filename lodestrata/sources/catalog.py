"""The catalog: tables as DataFrames, declared and inferred keys, and both as metadata DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS_SCHEMA = "table string, ordinal int, column string, sql_type string"
PK_SCHEMA = "table string, ordinal int, column string"
FK_SCHEMA = "constraint string, arity int, ordinal int, table string, column string, ref_table string, ref_column string, source string"


@dataclass(frozen=True)
class ForeignKey:
    table: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    name: str = ""
    source: str = "physical"

    @property
    def constraint(self) -> str:
        return self.name or f"{self.table}_{'_'.join(self.columns)}_{self.ref_table}_fk"


@dataclass
class Catalog:
    """Tables by name.  Keys are what was declared, or added later by inference; nothing is read until asked for."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    primary_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: list[str], **keys) -> Catalog:
        return cls({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}, **keys)

    @classmethod
    def from_database(cls, spark: SparkSession, database: str | None = None) -> Catalog:
        """The session catalog's tables; its declared constraints are not visible there."""
        return cls({t.name: spark.table(f"{database}.{t.name}" if database else t.name) for t in spark.catalog.listTables(database) if not t.isTemporary or not database})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, names: list[str], schema: str = "public", properties: Mapping[str, str] | None = None, **keys) -> Catalog:
        return cls({n: spark.read.jdbc(url, f'"{schema}"."{n}"', properties=dict(properties or {})) for n in names}, **keys)

    def names(self) -> list[str]:
        return sorted(self.tables)

    def types(self, table: str) -> dict[str, str]:
        """Column to type, in physical order."""
        return {f.name: f.dataType.simpleString() for f in self.tables[table].schema.fields}

    def fks_of(self, table: str) -> list[ForeignKey]:
        return [k for k in self.foreign_keys if k.table == table]

    def with_fks(self, added: list[ForeignKey]) -> Catalog:
        return replace(self, foreign_keys=[*self.foreign_keys, *added])

    def _spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession

    def columns_frame(self) -> DataFrame:
        rows = [(t, i, c, k) for t in self.names() for i, (c, k) in enumerate(self.types(t).items(), 1)]
        return self._spark().createDataFrame(rows, COLUMNS_SCHEMA)

    def pk_frame(self) -> DataFrame:
        """Ordered members of each key, unnested from the declared arrays."""
        rows = [(t, list(k)) for t, k in sorted(self.primary_keys.items())]
        keys = self._spark().createDataFrame(rows, "table string, members array<string>")
        return keys.select("table", F.posexplode("members").alias("ordinal", "column")).select("table", (F.col("ordinal") + 1).alias("ordinal"), "column")

    def fk_frame(self) -> DataFrame:
        """A row for each member column, with the referenced column of the same ordinal."""
        rows = [(k.constraint, len(k.columns), k.table, list(k.columns), k.ref_table, list(k.ref_columns), k.source) for k in self.foreign_keys]
        keys = self._spark().createDataFrame(rows, "constraint string, arity int, table string, columns array<string>, ref_table string, ref_columns array<string>, source string")
        members = keys.select("*", F.posexplode(F.arrays_zip("columns", "ref_columns")).alias("ordinal", "m"))
        return members.select("constraint", "arity", (F.col("ordinal") + 1).alias("ordinal"), "table", F.col("m.columns").alias("column"), "ref_table", F.col("m.ref_columns").alias("ref_column"), "source")

    def infer_keys(self) -> Catalog:
        """Single-column keys where none is declared: the first column without nulls whose values are all different.

        One scan for each table counts and estimates; only columns whose estimate is near the row count are counted exactly, one after the other.
        """
        found = dict(self.primary_keys)
        for name in self.names():
            if name in found:
                continue
            kinds = [c for c, k in self.types(name).items() if not k.startswith(("array", "map", "struct", "double", "float", "boolean"))]
            if not kinds:
                continue
            r = self.tables[name].agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(kinds) for x in (F.count(f"`{c}`").alias(f"c{i}"), F.approx_count_distinct(f"`{c}`", 0.02).alias(f"d{i}"))]).first()
            likely = [c for i, c in enumerate(kinds) if r["n"] and r[f"c{i}"] == r["n"] and r[f"d{i}"] >= 0.85 * r["n"]]
            key = next((c for c in likely if self.tables[name].select(F.count_distinct(f"`{c}`")).first()[0] == r["n"]), None)
            if key:
                found[name] = (key,)
        return replace(self, primary_keys=found)
