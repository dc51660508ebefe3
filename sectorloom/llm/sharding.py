"""Sharding by a two-pass external shuffle.

First pass: seeded hashes scatter the records uniformly into buckets that fit a task's memory. Second
pass: each bucket is shuffled by Fisher-Yates from its own seed and handed on, or written. The law is
``key``: doc_id and the shard count alone decide the shard, by the highest of the shards' seeded hashes,
so that one more shard takes records only into itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorloom.llm.common import bounded_batches, lean, shuffle_partitions

SHARDS = 40
SEED = 29
#: Bytes of records in a bucket, about.
BUCKET_BYTES = 24 << 20


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the key is highest; with one more shard, a key moves there or stays."""
    votes = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.greatest(*votes)["shard"] if shards > 1 else F.lit(0)


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n)."""
    out = np.arange(n)
    draws = np.random.default_rng(seed).random(max(n - 1, 0))
    for step, i in enumerate(range(n - 1, 0, -1)):
        j = int(draws[step] * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def _shuffled(columns: list[str], at: list[int], seed: int):
    """Rows in order of (shard, bucket) -> each bucket permuted, with slot its begin plus the place."""
    shard_at, bucket_at, begin_at = at

    def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        shard, bucket, begin = (rows.column(i)[0].as_py() for i in (shard_at, bucket_at, begin_at))
        order = fisher_yates(rows.num_rows, hash((seed, shard, bucket)) & 0xFFFFFFFF)
        slots = pa.array(begin + np.arange(rows.num_rows), pa.int64())
        rows = rows.take(pa.array(order)).append_column("slot", slots).select([*columns, "slot"])
        yield from rows.combine_chunks().to_batches(max_chunksize=1000)

    def run(batches):
        of, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (shard_at, bucket_at)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, a])
                if key != of and parts:
                    yield from out(parts)
                    parts = []
                of = key
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from out(parts)

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs -> every row with all its columns, ``shard``, ``grown_shard`` (with one more shard) and ``slot``, gapless from 0 in each shard.

    A null doc_id is a key like any other. Rows with one doc_id share a shard; a second hash over the
    whole record spreads them over its buckets. Equal rows are interchangeable. A null text has no bytes.
    Columns named shard, grown_shard or slot are replaced; others may have any name. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [c for c in docs.columns if c not in ("shard", "grown_shard", "slot")]
    lead = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))  # no column begins so
    bucket_, record_, begin_ = (f"{lead}{x}" for x in ("bucket", "record", "begin"))
    total = docs.agg(F.sum(record_size(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    record = F.xxhash64(F.lit(seed + 1), "doc_id", "text")
    keyed = docs.select(*names, shard_of(F.col("doc_id"), shards, seed).alias("shard"), shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"), F.pmod(record, F.lit(buckets)).alias(bucket_), record.alias(record_))
    counts = keyed.groupBy("shard", bucket_).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy(bucket_).rowsBetween(Window.unboundedPreceding, 0))
    begins = counts.select("shard", bucket_, (upto - F.col("n")).alias(begin_))
    rows = keyed.join(begins, ["shard", bucket_]).select(*names, "shard", "grown_shard", bucket_, begin_, record_)
    rows = rows.repartition(max(shuffle_partitions(spark), shards * buckets), "shard", bucket_).sortWithinPartitions("shard", bucket_, record_, "doc_id")
    columns = [*names, "shard", "grown_shard"]
    schema = rows.select(*columns).schema.add("slot", "long")
    at = [rows.columns.index(c) for c in ("shard", bucket_, begin_)]
    return rows.mapInArrow(lean(_shuffled(columns, at, seed)), schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes what shard_documents returns, a folder for each shard, in the order of the slots."""
    n = sharded.sparkSession
    rows = sharded.repartition(shuffle_partitions(n), "shard").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
