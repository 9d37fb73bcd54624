"""What the text operators share: the cluster's shared folder, cut lineage, connected components.

Nothing here keeps state on one machine.  Intermediate tables go to the folder named by
``spark.checkpoint.dir`` (set to a temporary folder only when a local session names none, as in tests),
so a lost executor never takes the only copy of a result with it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows (keys and a few numbers) is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: And bytes of such a table's texts.
BROADCAST_BYTES = 32_000_000

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, below which this process keeps its tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lodestrata"
        spark.conf.set("spark.checkpoint.dir", base)
    if base not in _roots:
        _roots[base] = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
        atexit.register(_remove_at_exit, spark, _roots[base])
    return _roots[base]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone; the folder is the cluster's scratch space
        pass


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the time of a job, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs start from the files.

    The shuffle files of the job that writes it go when it ends.  ``drop`` removes the table after its last reader.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and no later step reads."""
    for table in tables:
        remove(table.sparkSession, table._written_to)


def small(df: DataFrame, rows: int, width: int = 0) -> DataFrame:
    """Mark for broadcast if its counted rows, of up to ``width`` bytes beside some numbers, are few enough; else leave the join to the shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * width <= BROADCAST_BYTES else df


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """What Python workers need: this package on their path, and whole texts a few hundred at a time.

    Spark's default of 10,000 rows suits narrow rows and takes several times the memory here.  The path serves workers
    that see the same folders as the driver; where they don't, the package is shipped with the job as usual.
    """
    # workers live long; without these they keep the most that they ever held
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "1048576")):
        spark.sparkContext.environment.setdefault(name, value)
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the split into training and held-out rows (null id: bucket of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b: long); root is the smallest node reachable.

    Each round hooks every root to the smallest root it touches, then shortens the paths by pointer jumping, and
    rewrites the edges between the roots that remain; a round at least halves the roots that still have an edge.
    Only counts come to the driver.  Self loops and repeated edges are allowed.  Every join reads written tables,
    so that Spark can split a hub's rows among tasks.
    """
    live = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    labels = None
    for _ in range(max_rounds):
        hooks = cut(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "hooks")
        while True:  # pointer jumping: up points below node, so there is no cycle
            far = hooks.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            jumped = cut(hooks.join(far, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")), "hooks")
            moved = jumped.where("moved").limit(1).count()
            hooks = jumped.select("node", "up")
            if not moved:
                break
        if labels is None:
            labels = nodes.join(hooks, "node", "left").select("node", F.coalesce("up", "node").alias("root"))
        else:
            up = hooks.select(F.col("node").alias("root"), "up")
            labels = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = cut(labels, "labels")
        left, right = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved_edges = live.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")).where("x <> y")
        live = cut(moved_edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if not live.limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))
