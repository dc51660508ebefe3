"""Ranges: entry sizes, lookup, coverage, sessions, tracks, contiguity, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entry_sizes(entries: DataFrame, key: str, order: list[str], offset: str, end: str) -> DataFrame:
    """Adds encoded_size: the next entry's offset, or the key's data end, less this one's."""
    w = Window.partitionBy(key).orderBy(*order)
    return entries.withColumn("encoded_size", F.coalesce(F.lead(offset).over(w), F.col(end)) - F.col(offset))


def locate(points: DataFrame, ranges: DataFrame, point: str, first: str, count: str, tag: list[str], grain: int = 1024) -> DataFrame:
    """Points joined to the range [first, first + count) that holds each; ranges don't overlap.

    A range is listed under each block of ``grain`` values that it meets, so that the join is by
    equality and no pair outside a block is made.
    """
    listed = ranges.where(F.col(count) > 0).withColumn("__block", F.explode(F.sequence(F.floor(F.col(first) / grain), F.floor((F.col(first) + F.col(count) - 1) / grain))))
    keyed = points.withColumn("__block", F.floor(F.col(point) / grain))
    hit = (F.col(point) >= F.col(first)) & (F.col(point) < F.col(first) + F.col(count))
    return keyed.join(listed.select("__block", first, count, *tag), "__block").where(hit).drop("__block")


def coverage(ranges: DataFrame, key: list[str], first: str, count: str) -> DataFrame:
    """Adds prior_end and ``state``: gap, overlap, empty or ok, by what ends before."""
    w = Window.partitionBy(*key).orderBy(first, count)
    out = ranges.withColumn("prior_end", F.coalesce(F.lag(F.col(first) + F.col(count)).over(w), F.lit(0)))
    state = F.when(F.col(count) <= 0, "empty").when(F.col(first) > F.col("prior_end"), "gap").when(F.col(first) < F.col("prior_end"), "overlap").otherwise("ok")
    return out.withColumn("state", state)


def sessions(entries: DataFrame, key: str, start: str, audio: str, order: list[str], total: str) -> DataFrame:
    """Sessions of ordered (start, audio) entries: an entry without audio, but the first, closes the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    named = entries.withColumn("__n", F.row_number().over(w))
    kept = named.where((F.col("__n") == 1) | ~F.col(audio)).withColumn("first", F.when(F.col("__n") == 1, F.lit(0)).otherwise(F.col(start)))
    k = Window.partitionBy(key).orderBy("__n")
    end = F.coalesce(F.lead("first").over(k), F.col(total))
    return kept.select(key, F.row_number().over(k).cast("long").alias("ordinal"), F.col("first").cast("long").alias("first_sector"), (end - F.col("first")).cast("long").alias("sector_count"))


def tracks(entries: DataFrame, key: str, start: str, audio: str, order: list[str], total: str) -> DataFrame:
    """Audio tracks: closed by the entry after an audio entry; the start moves on only when a track closes."""
    w = Window.partitionBy(key).orderBy(*order)
    named = entries.withColumn("__n", F.row_number().over(w)).withColumn("__audio_before", F.lag(audio).over(w)).withColumn("__last", F.lead(start).over(w).isNull())
    closed = named.where("__audio_before").select(key, F.col(start).alias("end"), F.col("__n"))
    final = named.where(F.col("__last") & F.col(audio) & (F.col("__n") > 1)).select(key, F.col(total).alias("end"), (F.col("__n") + 1).alias("__n"))
    k = Window.partitionBy(key).orderBy("__n")
    ends = closed.union(final).withColumn("first", F.coalesce(F.lag("end").over(k), F.lit(0)))
    return ends.select(key, F.row_number().over(k).cast("long").alias("ordinal"), F.col("first").cast("long").alias("first_sector"), (F.col("end") - F.col("first")).cast("long").alias("sector_count"))


def positions(extents: DataFrame, key: str | list[str], order: list[str], size: str) -> DataFrame:
    """Adds file_position, where each extent begins in its file."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return extents.withColumn("file_position", F.sum(size).over(w) - F.col(size))


def extent_chunks(extents: DataFrame, offset: str, size: str, chunk: int) -> DataFrame:
    """A row for each chunk that an extent meets: chunk_index, and the bytes' begin and length in it."""
    rows = extents.where(F.col(size) > 0).withColumn("chunk_index", F.explode(F.sequence(F.floor(F.col(offset) / chunk), F.floor((F.col(offset) + F.col(size) - 1) / chunk))))
    begin = F.greatest(F.col(offset), F.col("chunk_index") * chunk)
    end = F.least(F.col(offset) + F.col(size), (F.col("chunk_index") + 1) * chunk)
    return rows.withColumn("begin_in_chunk", begin - F.col("chunk_index") * chunk).withColumn("bytes", end - begin)


def contiguity(ranges: DataFrame, key: list[str], order: list[str], first: str, count: str, total: str) -> DataFrame:
    """Adds ``state`` of ranges that must follow each other from 0 to the total: empty, overlap, gap, beyond, short (the last ends early) or ok."""
    w = Window.partitionBy(*key).orderBy(*order)
    end = F.col(first) + F.col(count)
    before = F.coalesce(F.lag(end).over(w), F.lit(0))
    state = F.when(F.col(count) <= 0, "empty").when(F.col(first) < before, "overlap").when(F.col(first) > before, "gap").when(end > F.col(total), "beyond")
    return ranges.withColumn("state", state.when(F.lead(first).over(w).isNull() & (end < F.col(total)), "short").otherwise("ok"))


def containing(points: DataFrame, intervals: DataFrame, point: str, first: str, last: str, ordinal: str, grain: int = 1024) -> DataFrame:
    """Points with ``ordinal`` of the first interval [first, last], its end included, that holds each; null where none does.

    An interval is listed under each block of ``grain`` values that it meets; points of one value are looked up once.
    """
    block = lambda c: F.floor(F.col(c) / grain)
    listed = intervals.where(F.col(last) >= F.col(first)).select(F.explode(F.sequence(block(first), block(last))).alias("__block"), F.col(first).alias("__first"), F.col(last).alias("__last"), F.col(ordinal).alias("__ordinal"))
    values = points.select(F.col(point).alias("__point")).where("__point is not null").distinct().withColumn("__block", F.floor(F.col("__point") / grain))
    hit = values.join(listed, "__block").where("__point between __first and __last").groupBy("__point").agg(F.min("__ordinal").alias(ordinal))
    return points.join(hit, F.col(point) == F.col("__point"), "left").drop("__point")


def session_entries(sessions: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, start, audio): the entries that sessions and audio tracks are stored as, by start and with audio last."""
    rows = sessions.select(key, F.col("first_sector").alias("start"), F.lit(False).alias("audio")).union(tracks.select(key, F.col("first_sector").alias("start"), F.lit(True).alias("audio")))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("start", "audio")).cast("long")).select(key, "ordinal", "start", "audio")
