"""Logical file catalogs: references, paths and folds over an adjacency list."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectorloom.functions.scalar import segment_matches
from sectorloom.operators.ranges import extent_chunks, positions

#: Levels of a tree from one written table to the next.
LEVELS = 4


def entry_sources(entries: DataFrame, sources: DataFrame, ref: str, index: str) -> DataFrame:
    """Entries joined to the source at their position; a reference below 1 or beyond the list gives nulls."""
    return entries.join(sources, (F.col(ref) == F.col(index)) & (F.col(ref) >= 1), "left")


def entry_subjects(entries: DataFrame, subjects: DataFrame, ref: str, identifier: str, order: str) -> DataFrame:
    """Entries joined to the first subject with their identifier."""
    others = [c for c in subjects.columns if c != identifier]
    first = subjects.groupBy(identifier).agg(F.min_by(F.struct(*others), order).alias("subject"))
    return entries.join(first, F.col(ref) == F.col(identifier), "left")


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names, or a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sectorloom-")
    return f"{found.rstrip('/')}/sectorloom-{uuid.uuid4().hex}"


def paths(entries: DataFrame, key: str, parent: str, name: str, separator: str = "\t") -> DataFrame:
    """(key, path, depth): names from the root joined by the separator; ``parent`` null marks roots.

    Level by level, as deep as the tree is; a cycle reaches no root and is left out, and one that does, by a
    repeated key, is an error. Tables written every few levels cut the lineage.
    """
    spark = entries.sparkSession
    level = entries.where(F.col(parent).isNull()).select(F.col(key).alias("entry"), F.col(name).alias("path"), F.lit(0).alias("depth"))
    rest = entries.select(F.col(key).alias("entry"), F.col(parent).alias("up"), F.col(name).alias("own")).where("up is not null")
    pending, written, folder, most, depth = [level], [], "", 0, 0
    while True:
        depth += 1
        above = level.select(F.col("entry").alias("up"), F.col("path").alias("lead"))
        level = rest.join(above, "up").select("entry", F.concat_ws(separator, "lead", "own").alias("path"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        pending.append(level)
        if depth % LEVELS == 0:
            if not written:
                folder, most = _folder(spark), entries.count()
            if depth > most:
                raise ValueError("a cycle is reached from a root: a key is repeated")
            written.append(f"{folder}/{depth}")
            _union(pending).write.parquet(written[-1])
            level, pending = spark.read.schema(level.schema).parquet(written[-1]).where(F.col("depth") == depth), []
    return _union([*([spark.read.schema(level.schema).parquet(*written)] if written else []), *pending])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_children(entries: DataFrame, key: str, parent: str, name: str, ordinal: str) -> DataFrame:
    """Of entries with one name under one parent, the one with the lowest ordinal."""
    rest = [c for c in entries.columns if c not in (parent, name)]
    found = entries.groupBy(parent, name).agg(F.min_by(F.struct(*rest), F.struct(ordinal, key)).alias("x"))
    return found.select(*[F.col(c) if c in (parent, name) else F.col(f"x.{c}").alias(c) for c in entries.columns])


def entry_by_path(entries: DataFrame, wanted: DataFrame, key: str, parent: str, name: str, ordinal: str, path: str = "path") -> DataFrame:
    """``wanted`` with ``entry``, the key that its path leads to from below the root: names by tabs or null characters, one tab before them allowed.

    Of siblings with one name the first counts. An empty path is the root's; a path that leads nowhere
    or lacks a name gives null.
    """
    found = paths(first_children(entries, key, parent, name, ordinal), key, parent, name, "\t")
    below = found.select(F.col("entry"), F.when(F.col("depth") == 0, "").otherwise(F.call_function("substring_index", F.col("path"), F.lit("\t"), -F.col("depth"))).alias("__below"))
    asked = F.regexp_replace(F.replace(F.col(path), F.lit("\0"), F.lit("\t")), "^\t", "")
    asked = F.regexp_replace(asked, "(?<=[^\t])\t$", "")
    return wanted.withColumn("__below", asked).join(below, "__below", "left").drop("__below")


def entry_acl(entries: DataFrame, groups: DataFrame, aces: DataFrame, ref: str, group: str, drop_missing: bool = False) -> DataFrame:
    """Entries with the access control entries of the permission group at their position; one row with nulls for a group without any, or no group."""
    held = groups.select(F.col(group).alias("__group")).join(aces.withColumnRenamed(group, "__of"), F.col("__group") == F.col("__of"), "left").drop("__of")
    return entries.join(held, (F.col(ref) == F.col("__group")) & (F.col(ref) >= 0), "inner" if drop_missing else "left").drop("__group")


def source_by_identifier(sources: DataFrame, wanted: DataFrame, identifier: str, order: str) -> DataFrame:
    """``wanted`` (identifier) with ``source``, the first of the sources that has it; null where none does."""
    return entry_subjects(wanted.withColumnRenamed(identifier, "__wanted"), sources, "__wanted", identifier, order).withColumnRenamed("subject", "source").drop(identifier).withColumnRenamed("__wanted", identifier)


def logical_size(entries: DataFrame, extents: DataFrame, key: str, size: str) -> DataFrame:
    """Entries with ``logical_size``: their stored size, or else the sum of their extents."""
    sums = extents.groupBy(key).agg(F.sum("data_size").alias("__sum"))
    return entries.join(sums, key, "left").withColumn("logical_size", F.coalesce(F.col(size), F.col("__sum"), F.lit(0)).cast("long")).drop("__sum")


def any_present(rows: DataFrame, key: list[str], flag: Column, name: str) -> DataFrame:
    """Per key whether the condition holds for any row."""
    return rows.groupBy(*key).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(name))


def count_of(left: DataFrame, right: DataFrame, key: str, ref: str, name: str) -> DataFrame:
    """Keys of the left with how many rows of the right refer to each; counted before the join."""
    counts = right.groupBy(F.col(ref).alias("__ref")).agg(F.count("*").alias("__n"))
    return left.join(counts, F.col(key) == F.col("__ref"), "left").select(key, F.coalesce("__n", F.lit(0)).alias(name))


def flags_folded(rows: DataFrame, key: list[str], *flags: str) -> DataFrame:
    """Per key the bits that any of its rows sets; a null sets none."""
    return rows.groupBy(*key).agg(*[F.coalesce(F.bit_or(f), F.lit(0)).alias(f) for f in flags])


def differing(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose non-null value is not that of the key's first row with one: parts that belong to another set."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias("__first"))
    return rows.join(first, key).where(F.col(value) != F.col("__first")).drop("__first")


def filled(rows: DataFrame, others: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows whose null or zero columns take the other's value of the same key."""
    named = others.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(named, key, "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def segment_order(files: DataFrame, family: list[str], extension: str, ties: list[str], prefix: str) -> DataFrame:
    """Files whose extension continues a set of the prefix, with ``ordinal``, their place in the family from 1: by extension in any case, then by the ties."""
    w = Window.partitionBy(*family).orderBy(F.upper(extension), *ties)
    return files.where(segment_matches(F.col(extension), prefix)).withColumn("ordinal", F.row_number().over(w).cast("long"))


def without_emitted(values: DataFrame, emitted: DataFrame, tag: list[str]) -> DataFrame:
    """Values whose tag is not among those already written."""
    return values.join(emitted.select(*tag).distinct(), tag, "left_anti")


def data_size(entries: DataFrame, key: list[str], size: str, offset: str, sparse: str) -> DataFrame:
    """Per key the largest of all sizes and of the ends of extents that are not sparse."""
    end = F.max(F.when(~F.col(sparse), F.col(offset) + F.col(size)))
    return entries.groupBy(*key).agg(F.greatest(F.max(size), end).alias("data_size"))


def first_wins(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The first non-null value of each key."""
    return rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def at_most_one(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one non-null value, and how many: conflicts of a merge that allows one."""
    return rows.groupBy(*key).agg(F.count(value).alias("n_values")).where("n_values > 1")


def complete(sections: DataFrame, key: list[str], kind: str, order: list[str]) -> DataFrame:
    """Whether the last section of each key is not "next"."""
    return sections.groupBy(*key).agg((F.max_by(kind, F.struct(*order)) != "next").alias("complete"))


def file_parts(entries: DataFrame, extents: DataFrame, chunks: DataFrame, chunk: int, key: list[str], stream: list[str], offset: int = 0, length: int | None = None) -> DataFrame:
    """(key, position, data) of each file's bytes from ``offset`` on, ``length`` at most: a row for each chunk that an extent meets.

    ``entries`` have the key, logical_size and duplicate_data_offset; an entry without extents but with such
    an offset of 0 or more reads from there. ``extents`` have the key, extent_ordinal, data_offset, data_size
    and sparse; they follow each other. ``chunks`` have the stream's columns, which are among the key's,
    chunk_index and data. Sparse extents give zeros, ``chunk`` bytes a row at most. Joins are by equality,
    and no file is gathered, so a file may be of any size; ``position`` orders its rows. Bytes beyond the
    chunks are missing, which ``uncovered`` finds.
    """
    whole = extents.select(*key, "extent_ordinal", "data_offset", "data_size", "sparse")
    copies = entries.where("duplicate_data_offset >= 0").join(whole.select(*key).distinct(), key, "left_anti")
    whole = whole.unionByName(copies.select(*key, F.lit(0).cast(extents.schema["extent_ordinal"].dataType).alias("extent_ordinal"), F.col("duplicate_data_offset").alias("data_offset"), F.col("logical_size").alias("data_size"), F.lit(False).alias("sparse")))
    placed = positions(whole, key, ["extent_ordinal"], "data_size").join(entries.select(*key, "logical_size"), key)
    # the wanted part of each extent, relative to its begin
    low = F.greatest(F.lit(offset) - F.col("file_position"), F.lit(0))
    high = F.least(F.col("data_size"), F.col("logical_size") - F.col("file_position"), *([] if length is None else [F.lit(offset + length) - F.col("file_position")]))
    cut = placed.withColumn("low", low).withColumn("high", high).where("high > low")
    cut = cut.select(*key, "sparse", (F.col("file_position") + F.col("low")).alias("begin"), F.when(F.col("sparse"), F.lit(0)).otherwise(F.col("data_offset") + F.col("low")).alias("at"), (F.col("high") - F.col("low")).alias("size"))
    parts = extent_chunks(cut, "at", "size", chunk).withColumn("position", F.col("begin") + F.col("chunk_index") * chunk + F.col("begin_in_chunk") - F.col("at"))
    read = parts.where("not sparse").join(chunks.select(*stream, "chunk_index", "data"), [*stream, "chunk_index"]).select(*key, "position", F.substring(F.col("data"), (F.col("begin_in_chunk") + 1).cast("int"), F.col("bytes").cast("int")).alias("data"))
    zeros = parts.where("sparse").select(*key, "position", F.unhex(F.repeat(F.lit("00"), F.col("bytes").cast("int"))).alias("data"))
    return read.unionByName(zeros).where(F.octet_length("data") > 0)


def uncovered(entries: DataFrame, parts: DataFrame, key: list[str], offset: int = 0, length: int | None = None) -> DataFrame:
    """Entries whose parts hold fewer bytes than the range asked for."""
    want = F.greatest(F.col("logical_size") - offset, F.lit(0))
    want = want if length is None else F.least(want, F.lit(length))
    sums = parts.groupBy(*key).agg(F.sum(F.octet_length("data")).alias("__held"))
    return entries.join(sums, key, "left").where(F.coalesce("__held", F.lit(0)) < want).drop("__held")


def read_files(entries: DataFrame, extents: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """(entry_key, data): each file's bytes as one value, for files that fit one; ``file_parts`` has larger ones.

    Bytes beyond the chunks are missing.
    """
    named = entries.select("entry_key", *[c for c in ("duplicate_data_offset",) if c in entries.columns])
    named = named if "duplicate_data_offset" in named.columns else named.withColumn("duplicate_data_offset", F.lit(None).cast("long"))
    stored = entries.select("entry_key", "size") if "size" in entries.columns else entries.select("entry_key", F.lit(None).cast("long").alias("size"))
    sized = logical_size(stored, extents, "entry_key", "size").select("entry_key", "logical_size").join(named, "entry_key")
    parts = file_parts(sized, extents, chunks, chunk, ["entry_key"], [])
    joined = parts.groupBy("entry_key").agg(F.sort_array(F.collect_list(F.struct("position", F.hex("data").alias("h")))).alias("parts"))
    whole = joined.select("entry_key", F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")).alias("data"))
    return entries.select("entry_key").join(whole, "entry_key", "left").withColumn("data", F.coalesce("data", F.unhex(F.lit(""))))
