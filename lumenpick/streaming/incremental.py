"""Continuous variants: scoring of arriving images, a decision log, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, MapType, StructType

from ..operators.review import latest_decisions
from ..sources.generations import Store

#: transformWithState needs a state store that can list a key's states.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Keeps the newest row of a key, by the order columns, and gives it whenever it changes."""

    def __init__(self, schema: StructType, order: tuple[str, ...]):
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        best = None
        for pdf in rows:
            # ties in the order columns go by the other columns, as in latest_decisions
            for row in pdf[names].itertuples(index=False):
                if best is None or self._rank(row) > self._rank(best):
                    best = row
        known = tuple(self.newest.get()) if self.newest.exists() else None
        best = tuple(self._plain(v) for v in best) if best is not None else None
        if best is not None and (known is None or self._rank(best) > self._rank(known)):
            self.newest.update(best)
            yield pd.DataFrame([best], columns=names)

    @staticmethod
    def _plain(value):
        if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
            return None
        return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value

    def _rank(self, row) -> tuple:
        by_name = dict(zip(self.schema.names, row, strict=True))
        names = [*self.order, *[n for n in self.schema.names if n not in self.order]]
        values = [self._plain(by_name[n]) for n in names]
        return tuple((v is not None, v if v is not None else 0) for v in values)

    def close(self) -> None:
        pass


def _combined(stream: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Of every Arrow batch the newest row per key, so that a busy key sends few rows to its task."""
    names = stream.columns
    ranks = [(n, "ascending") for n in (*order, *[n for n in names if n not in order])]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.take(pc.sort_indices(batch, sort_keys=ranks, null_placement="at_start"))
            last = pa.table({"key": rows.column(names.index(key)), "at": np.arange(rows.num_rows)}).group_by("key").aggregate([("at", "max")])
            yield rows.take(last.column("at_max").combine_chunks())

    return stream.mapInArrow(combine, stream.schema)


def newest_rows(stream: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The stream's rows that become the newest of their key; a key's state is its newest row."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    if all(not isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in stream.schema.fields):
        stream = _combined(stream, key, order)
    return stream.groupBy(key).transformWithStateInPandas(Newest(stream.schema, order), stream.schema, "Update", "None")


def keyed_upserts(stream: DataFrame, path: str, schema, key: str, order: tuple[str, ...], checkpoint: str) -> StreamingQuery:
    """Fold a stream into a store, last write wins; `latest_upserts` reads it.

    The newest row of every key is kept as state, and a batch appends the rows that became newest; what
    earlier batches wrote is not touched.  A batch that is run again after a crash appends the same rows again, which
    changes nothing, since reading takes the newest row of a key.
    """
    def fold(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        store = Store(batch.sparkSession, path, schema)
        store.append(batch)
        store.fold(lambda rows: latest_decisions(rows, key, order).select(*batch.columns))

    newest = newest_rows(stream, key, order)
    return newest.writeStream.foreachBatch(fold).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_upserts(store: Store, key: str, order: tuple[str, ...]) -> DataFrame:
    """The newest row of every key of a store that keyed_upserts writes."""
    return latest_decisions(store.read(), key, order)


def scored_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score arriving rows; files that a checkpoint has seen are not read again."""
    return score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_progress(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Decisions per window and kind, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "final_decision").agg(F.count("*").alias("n"))
