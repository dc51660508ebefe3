"""Embedding near-dedup by lattice hashing.

Each table projects a vector at random to eight dimensions, decodes it to the nearest point of the
lattice E8, and also probes the neighbouring points that it lies closest to. Vectors with a cell in common
are compared in blocks by exact cosine. A block reports counts and a spanning forest, never all pairs: a
link is counted only in the first of the cells that both vectors have, so its copies need no shuffle.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorloom.llm.common import Scratch, bounded_batches, lean, mix64, shuffle_partitions
from sectorloom.llm.components import components

#: Tables, neighbouring cells probed in each, and the projections' scale: at a cosine of 0.95 they join over 0.99 of all pairs.
TABLES = 4
PROBES = 2
SCALE = 1.5
#: Vectors in a tile; a larger cell is compared tile by tile.
TILE = 2048
SEED = 43


def _roots() -> np.ndarray:
    """The 240 lattice points nearest to the origin."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    rows, worst = np.arange(len(x)), np.abs(off).argmax(axis=1)
    other = near.copy()
    other[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return np.where((near.sum(axis=1) % 2 != 0)[:, None], other, near)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """A 64-bit name for the home cell and the probed ones of each vector in every table: n x (tables * (1 + probes))."""
    out = []
    for t in range(tables):
        r = np.random.default_rng([seed, t, unit.shape[1]]).normal(size=(unit.shape[1], 8))
        y = unit @ r / scale
        home = nearest_e8(y)
        gain = (y - home) @ ROOTS.T
        nearby = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.empty((len(y), 0), int)
        points = np.concatenate([home[:, None], home[:, None] + ROOTS[nearby]], axis=1)
        h = np.full(points.shape[:2], np.uint64(t * 1024 + unit.shape[1]), np.uint64)
        for k in range(8):
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + np.rint(points[:, :, k] * 2).astype(np.int64).view(np.uint64))
        out.append(h)
    return np.concatenate(out, axis=1).view(np.int64)


def _vectors(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(b, kind).astype(np.float64) for b in column.to_pylist()]


def _unit_groups(vectors: list[np.ndarray]):
    """Indices and unit rows of the vectors of each length."""
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.stack([vectors[i] for i in at])
        yield at, x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _packed(kind: type):
    """(vec_id, embedding) -> (vec_id, vector binary), null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                ok = x.is_valid and len(x.values) > 0 and not x.values.null_count
                # adding zero makes equal vectors equal bytes
                v = x.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0) if ok else None
                out.append(v.tobytes() if ok and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    return run


def _in_cells(options: tuple, kind: type, with_vectors: bool):
    """Classes (cid, copies, vector) -> a row for each cell; the cells' names go along for the counting rule."""

    def run(batches):
        for batch in batches:
            vectors = _vectors(batch.column(2), kind)
            for at, unit in _unit_groups(vectors):
                names = cells(unit, *options)
                k = names.shape[1]
                bucket = pa.array(names.ravel())
                if not with_vectors:
                    yield pa.RecordBatch.from_arrays([bucket], names=["bucket"])
                    continue
                rows = pa.array(np.repeat(at, k))
                own = np.sort(names, axis=1)
                codes = pa.array([own[i].tobytes() for i in range(len(own))], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays([bucket, *(batch.column(i).take(rows) for i in range(3)), codes], names=["bucket", "cid", "copies", "vector", "codes"])

    return run


def _compare(threshold: float, kind: type):
    """Rows (bucket, ta, tb, tile, cid, copies, vector, codes) sorted by the first three -> (a, b, links): links counted for a (b null), or a forest's edge."""

    def block(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        bucket, ta, tb = (rows.column(i)[0].as_py() for i in range(3))
        if rows.num_rows < 2:
            return None
        tile, cid, copies = (rows.column(i).to_numpy() for i in (3, 4, 5))
        vectors = _vectors(rows.column(6), kind)
        size = len(vectors[0])
        if any(len(v) != size for v in vectors):
            raise ValueError("vectors of different lengths in a cell")
        ((_, unit),) = _unit_groups(vectors)
        codes = np.stack([np.frombuffer(b, np.int64) for b in rows.column(7).to_pylist()])
        left, right = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
        if ta != tb and (not len(left) or not len(right)):
            return None
        counts, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for i in range(0, len(left), 256):
            own = left[i : i + 256]
            r, c = np.nonzero(unit[own] @ unit[right].T >= threshold)
            a, b = own[r], right[c]
            if ta == tb:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 2000):
                x, y = a[k : k + 2000], b[k : k + 2000]
                both = (codes[x][:, :, None] == codes[y][:, None, :]).any(axis=2)
                first = np.where(both, codes[x], np.iinfo(np.int64).max).min(axis=1) == bucket
                np.add.at(counts, x[first], copies[y[first]])
                np.add.at(counts, y[first], copies[x[first]])
            _unite(root, a, b)
        linked, joined = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(cid)))
        none = pa.nulls(len(linked), pa.int64())
        return [
            pa.RecordBatch.from_arrays([pa.array(cid[linked]), none, pa.array(counts[linked])], names=["a", "b", "links"]),
            pa.RecordBatch.from_arrays([pa.array(cid[joined]), pa.array(cid[root[joined]]), pa.nulls(len(joined), pa.int64())], names=["a", "b", "links"]),
        ]

    def run(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (k := tuple(keys[:, a])) != key:
                    if parts:
                        yield from block(parts) or []
                    key, parts = k, []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from block(parts) or []

    return run


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the trees that the pairs join; a root is the least index of its tree."""
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, embedding, ...) -> a row for each row: vec_id, n_links, component_id, kept.

    Only pairs found with a cosine of ``threshold`` or more, in double precision, link. Equal vectors form
    a class that is compared once; its copies count as links of each other. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, as do vectors of another length. A row
    without vec_id counts like others, but names no component unless all its members lack ids. Repeated
    rows are vectors of their own. Other columns aren't read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch, options = Scratch(spark, vectors), (tables, probes, scale, seed)
    # float components keep their four bytes until they are compared, in double precision
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    packed = scratch.keep(narrow.mapInArrow(lean(_packed(kind)), "vec_id long, vector binary"))
    some = packed.where("vector is not null")
    classes = some.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    own = classes.select("cid", "copies", "vector")
    sizes = own.mapInArrow(_in_cells(options, kind, False), "bucket long").groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    sizes = scratch.keep(sizes, small=True)
    rows = own.mapInArrow(lean(_in_cells(options, kind, True)), "bucket long, cid long, copies long, vector binary, codes binary")
    rows = rows.join(sizes, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("bucket", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "cid", "copies", "vector", "codes")
    rows = rows.repartition(shuffle_partitions(spark), "bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb")
    found = scratch.keep(rows.mapInArrow(lean(_compare(threshold, kind)), "a long, b long, links long"), small=True)
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    comps = components(found.where("b is not null").select("a", "b"), scratch)
    named = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    named = named.join(counts, "cid", "left").join(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "comp")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = packed.where("vector is not null").join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = packed.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
