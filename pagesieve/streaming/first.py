"""The first page of every signature on a stream, kept as state: the winner is defined, not whichever row a task saw first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from pagesieve.functions.text import content_signature
from pagesieve.functions.urls import normalize_url
from pagesieve.schemas import Options
from pagesieve.sources.pages import CORRUPT

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows that a part of a micro-batch gathers, at least, before they are reduced to the first of every signature.
MERGED_ROWS = 100_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stateful(spark: SparkSession, writer: DataStreamWriter, path: str | None = None) -> StreamingQuery:
    """Start a query whose state lies in RocksDB, on disk beside the executors and in the checkpoint, not on their heaps.

    The provider is read when a query starts and kept with its checkpoint; the session's own setting is put back.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start(path) if path else writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)


def _leaves(name: str, kind: T.DataType, value: Column) -> list[tuple[str, Column, T.DataType]]:
    """The order as plain columns that compare like it: a structure field by field, a time in microseconds."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f"{name}_{f.name}", f.dataType, value[f.name])]
    if isinstance(kind, T.TimestampType):
        return [(name, F.unix_micros(value), T.LongType())]
    return [(name, value.cast("long") if isinstance(kind, T.IntegralType) else value, T.LongType() if isinstance(kind, T.IntegralType) else kind)]


def _restored(names: Iterator[str], kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_restored(names, f.dataType).alias(f.name) for f in kind.fields])
    name = next(names)
    return F.timestamp_micros(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name).cast(kind)


def _firsts(table: pa.Table, order: list[str]) -> pa.Table:
    rows = table.sort_by([(c, "ascending") for c in ["sig", *order]])
    return rows.group_by("sig", use_threads=False).aggregate([(c, "first") for c in order]).rename_columns(["sig", *order])


def _least_of_batch(order: list[str]):
    """Of the rows of each Arrow batch the first of every signature: a signature that a third of all pages share is a row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _firsts(pa.Table.from_batches([batch]), order).select(batch.schema.names).cast(batch.schema).to_batches()

    return run


def _least_of_part(order: list[str]):
    """Of all rows of a part, which has every row of its signatures in the micro-batch, the first of every signature.

    Held are the firsts so far, and as many rows again before they are merged: narrow rows, one for each signature of the part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = None, []
        for batch in batches:
            fresh.append(batch)
            if sum(b.num_rows for b in fresh) >= max(MERGED_ROWS, held.num_rows if held else 0):
                held, fresh = _merged(held, fresh, order), []
        if held or fresh:
            yield from _merged(held, fresh, order).to_batches()

    return run


def _merged(held: pa.Table | None, fresh: list[pa.RecordBatch], order: list[str]) -> pa.Table:
    parts = ([held] if held is not None else []) + ([pa.Table.from_batches(fresh)] if fresh else [])
    table = pa.concat_tables(parts)
    return _firsts(table, order).select(table.schema.names).cast(table.schema)


def first_seen(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """``(sig, order, key)`` of the first page of every signature of a stream: by micro-batch, then by order, then by key.

    Pages with an invalid URL or without key or order and undecodable records claim no signature. Only these narrow rows are
    shuffled, a signature once for each Arrow batch. They meet by signature, and the first of the micro-batch alone meets the state,
    which Spark keeps: the signatures seen. It grows with their number; start the query with ``start_stateful``. Orders are numbers,
    strings, times or structures of them.
    """
    if CORRUPT in pages.columns:
        pages = pages.where(F.col(CORRUPT).isNull())
    kind = pages.schema[options.order_by].dataType
    leaves = _leaves("o", kind, F.col(options.order_by))
    names = [name for name, _, _ in leaves]
    order = [*names, "k"]
    valid = normalize_url("url").isNotNull() & F.col(options.key).isNotNull()
    claims = pages.where(valid).select(
        content_signature("visible_text").alias("sig"), *[value.alias(name) for name, value, _ in leaves], F.col(options.key).alias("k")
    ).dropna()
    state = T.StructType([*[T.StructField(name, kind) for name, _, kind in leaves], T.StructField("k", T.StringType())])
    out = T.StructType([T.StructField("sig", T.StringType()), *state.fields])
    firsts = claims.mapInArrow(_least_of_batch(order), out).repartition("sig").mapInArrow(_least_of_part(order), out).dropDuplicates(["sig"])
    return firsts.select("sig", _restored(iter(names), kind).alias(options.order_by), F.col("k").alias(options.key))
