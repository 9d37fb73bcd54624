"""Mappings over streams: a map without joins is a projection, so it runs on a streaming table as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lodestrata.plans import materialize
from lodestrata.plans.r2rml import Mapping, TriplesMap
from lodestrata.sources.catalog import Catalog


def stream_triples(stream: DataFrame, m: TriplesMap) -> DataFrame:
    """The triples of arriving rows.  Joined objects need the other table and aren't streamed."""
    if any(po.object.parent for po in m.properties):
        raise ValueError("a map with joins cannot be streamed")
    return materialize.map_triples(Catalog({m.table: stream}), Mapping([m]), m)


def append_triples(stream: DataFrame, m: TriplesMap, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a graph on disk, by predicate; the checkpoint makes each batch count once."""
    return stream_triples(stream, m).writeStream.format("parquet").partitionBy("p").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
