"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, then exact sorted-array intersection.

Documents with equal shingle sets collapse into a class. Each class sends its smallest shingle hashes
(the prefix that any partner at the threshold must meet, and a little more) to the shingles' groups.
A small group's pairs and, in a larger group, a star to the first class of each size band are counted.
Two classes at the threshold have as many of the hashes sent in common as either sends extra: they meet
in small groups for a ``SHARE`` of these, and for all that larger groups can't make up, or else in larger
groups for the rest. Pairs that met less often go, and classes with fewer hashes in larger groups don't
enter these. Larger groups with the same first class then merge, as a passage's shingles do, and what is
still apart in them is cut into size-banded tiles, compared in blocks by bitmaps. A bitmap holds the parity of the elements on each bit, so that two differ in no more bits
than their sets in elements, which bounds the overlap from above. What passes is decided on the whole
sorted arrays. A block with many pairs passes on each class's nearest only, so that copies unite without
all their pairs, and comes again for what is left apart; the last round passes on every pair.

A group larger than ``HOT`` holds boilerplate. Two classes whose further prefix hashes make up for
their hot ones meet in another group, so in a hot group only classes short of that are compared with
the rest: no link is lost, and the square of a passage's popularity isn't paid. A shingle that more
than ``SPLIT`` classes send is salted before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorloom.llm.common import Scratch, apart, bounded_batches, lean, mix64, ngram_hashes, shuffle_partitions, string_chunks, text_column, word_hashes
from sectorloom.llm.components import components

#: Up to so many members, a group's pairs are listed.
SMALL = 8
#: Classes in a tile; a group with no more is one tile.
TILE = 2048
#: Above so many classes, a shingle's group is hot.
HOT = 2048
#: Rounds over the tiles in which blocks with more than DENSE pairs a class pass on the nearest of each before the round that passes on all.
ROUNDS = 1
DENSE = 4
#: The share of the extra hashes that a pair must meet for in small groups, unless it meets for the rest in larger ones.
SHARE = 0.1
#: Members compared with one pivot in one task.
STAR = 4096
#: Members of a shingle's group in one task, about; at scale, as many as keep the split shingles' table within BROADCAST_IDS.
SPLIT = 10_000
#: Shingles counted together in search of those.
COUNTED = 1_000_000
#: Sets whose copies a task recognises before it forgets them all.
SEEN = 200_000
#: Identifiers that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of a bitmap at most; beyond, its bound is weaker.
WIDEST = 1 << 17


@dataclass(frozen=True)
class Rule:
    """100 * intersection >= percent * union, over runs of ``words`` words."""

    words: int = 5
    percent: int = 75

    def floor(self, n: int) -> int:
        """The overlap that a set of n needs with any partner."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.floor(n) + 1

    def sent(self, n: int) -> int:
        return min(n, self.prefix(n) + -(-n // 20))

    @property
    def base(self) -> float:
        """Ratio of the size bands; partners lie in the same band or the next."""
        return 100 / self.percent * 1.005

    def near(self, inter, a, b):
        return inter * (100 + self.percent) >= self.percent * (a + b)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole sequence if it is shorter; none of none."""
    if not len(words):
        return np.empty(0, np.int64)
    return np.unique(ngram_hashes(words, min(k, len(words))).view(np.int64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The shingle set of each of the texts that lie one after another in data."""
    if len(offsets) == 2:
        return [shingle_set(word_hashes(data)[2], k)]
    spaced, begins = apart(data, offsets)
    start, _, hashes = word_hashes(spaced)
    cut = np.searchsorted(start, begins)
    grams = ngram_hashes(hashes, k).view(np.int64)
    out = []
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        out.append(np.unique(grams[i : j - k + 1]) if j - i >= k else shingle_set(hashes[i:j], k))
    return out


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap with 2 to 4 bits for each element, WIDEST at most, each the parity of the elements that fall on it."""
    bits = min(WIDEST, 1 << max(6, (2 * len(s) - 1).bit_length()))
    at = (mix64(s.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(a: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, rows of 64-bit words, folded to ``width`` bytes."""
    return np.bitwise_xor.reduce(a.reshape(len(a), -1, width // 8), axis=1) if a.shape[1] * 8 > width else a


def _rows(bits: list[bytes]) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words."""
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _keys(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    first = int(np.add.reduce(mix64(u))) if len(u) else 0
    second = int(np.add.reduce(mix64(u ^ np.uint64(0x5851F42D4C957F2D)))) if len(u) else 0
    return first, second


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


SETS = "rid long, doc_id long, n long, k1 long, k2 long, tokens array<long>, bits binary"


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        seen: set = set()
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in string_chunks(batch.column(1)):
                sets_of = shingle_sets(data, offsets, rule.words)
                rows = {k: [] for k in ("n", "k1", "k2", "tokens", "bits")}
                for i in range(last - first):
                    s = sets_of[i]
                    n, key = len(s), _keys(s)
                    both = key[0] << 64 | key[1]
                    new = n > 0 and both not in seen and ids[first + i].is_valid
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(both)
                    rows["n"].append(n)
                    rows["k1"].append(_signed(key[0]))
                    rows["k2"].append(_signed(key[1]))
                    rows["tokens"].append(s[: rule.sent(n)] if new else None)
                    rows["bits"].append(bitmap(s) if new else None)
                m = last - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + m)), ids.slice(first, m).cast(pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["k1"], pa.int64()), pa.array(rows["k2"], pa.int64()), pa.array(rows["tokens"], pa.list_(pa.int64())), pa.array(rows["bits"], pa.binary())],
                    names=["rid", "doc_id", "n", "k1", "k2", "tokens", "bits"],
                )
                at += m

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of tokens -> (token, n) for those that come more than once among COUNTED, and their number in all (token null)."""
    held, size, total = [], 0, 0

    def counted():
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1]), pa.array(n[n > 1])], names=["token", "n"])

    for batch in batches:
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        held.append(values)
        size, total = size + len(values), total + len(values)
        if size >= COUNTED:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total])], names=["token", "n"])


MEETS = "token long, a long, b long"


def _meets(rule: Rule):
    """Rows (token, salt, rid, n), sorted with n before rid -> a small group's pairs of like sizes (token null, a, b), a larger group's members (token, a, the first of its band).

    A salt that isn't negative marks a part of a larger group.
    """

    def out(token, a, b):
        return pa.RecordBatch.from_arrays([token, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["token", "a", "b"])

    def pairs(rid: np.ndarray, n: np.ndarray, first: np.ndarray, size: np.ndarray):
        for k in range(2, SMALL + 1):
            at = first[size == k]
            if len(at):
                at = at[:, None] + np.arange(k)
                i, j = np.triu_indices(k, 1)
                a, b = at[:, i].ravel(), at[:, j].ravel()
                like = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * rule.percent
                a, b = rid[a[like]], rid[b[like]]
                yield out(pa.nulls(len(a), pa.int64()), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, pivot, of, held = None, 0, None, None

        def members(token: np.ndarray, salt: np.ndarray, rid: np.ndarray, band: np.ndarray):
            """Whole groups or the next part of one; its last ``pivot`` goes on."""
            nonlocal pivot, of
            begins = np.concatenate(([of != (token[0], salt[0], band[0])], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (band[1:] != band[:-1])))
            at = np.maximum.accumulate(np.where(begins, np.arange(len(token)), -1))
            pivots = np.where(at >= 0, rid[np.maximum(at, 0)], pivot)
            pivot, of = pivots[-1], (token[-1], salt[-1], band[-1])
            return out(pa.array(token), rid, pivots)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols.insert(3, np.floor(np.log(cols[3]) / np.log(rule.base)).astype(np.int64))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            token, salt, rid, band, n = cols
            first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))))
            if (token[0], salt[0]) == large:  # more of a group that is known to be large
                end = first[1] if len(first) > 1 else len(token)
                yield members(*(x[:end] for x in cols[:4]))
                token, salt, rid, band, n = cols = [x[end:] for x in cols]
                first = first[1:] - end
                held = None
                if not len(token):
                    continue
            size = np.diff(np.append(first, len(token)))
            if size[-1] > SMALL or salt[-1] >= 0:
                large, held = (token[-1], salt[-1]), None
            else:  # the last group may go on in the next batch
                held = [x[first[-1] :] for x in cols]
                first, size = first[:-1], size[:-1]
            big = (size > SMALL) | (salt[first] >= 0)
            yield from pairs(rid, n, first[~big], size[~big])
            if big.any():
                at = _runs(first[big], size[big])
                yield members(*(x[at] for x in cols[:4]))
        if held is not None:
            yield from pairs(held[2], held[4], np.array([0]), np.array([len(held[0])]))

    return run


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(first - (ends - size), size)


def _by_bits(rule: Rule):
    """(a, b, na, nb, bits_a, bits_b) -> the pairs whose overlap can reach the threshold."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keep = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * rule.percent
            left, right = batch.column(4), batch.column(5)
            widths = np.stack([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (left, right)])
            for x, y in np.unique(widths[:, keep], axis=1).T:
                at = np.flatnonzero(keep & (widths[0] == x) & (widths[1] == y))
                for i in range(0, len(at), 1000):
                    own = at[i : i + 1000]
                    a, b = (folded(_rows(c.take(pa.array(own)).to_pylist()), min(x, y)) for c in (left, right))
                    apart = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
                    keep[own] = rule.near((na[own] + nb[own] - apart) // 2, na[own], nb[own])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


class _Widths:
    """A tile's bitmaps, by width: each compares with those of its own width and, folded, of half and of twice that."""

    def __init__(self, bits: pa.Array):
        width = pc.binary_length(bits).to_numpy(zero_copy_only=False)
        self.of, self.place = width, np.zeros(len(width), np.int64)
        self.full: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            self.place[at] = np.arange(len(at))
            self.full[w] = _rows(bits.take(pa.array(at)).to_pylist())
            self.half[w] = folded(self.full[w], max(8, w // 2))

    def apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """In how many bits i differs from each of j, at most twice or half as wide."""
        w, own = int(self.of[i]), self.place[i]
        out = np.zeros(len(j), np.int64)
        for other in (w // 2, w, 2 * w):
            at = np.flatnonzero(self.of[j] == other)
            if len(at):
                theirs, mine = (self.half if other > w else self.full)[other], (self.half if other < w else self.full)[w][own]
                out[at] = np.bitwise_count(theirs[self.place[j[at]]] ^ mine).sum(axis=1)
        return out


def _in_tiles(rule: Rule, nearest: bool):
    """Rows (token, ta, tb, tile, rep, n, bits, comp) sorted by the first three -> pairs in different components that the bitmaps let pass.

    With ``nearest``, a block that has many passes on the nearest of each row, and its key with null for the pair.
    """

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts)
        ta, tb, tile, rep, n = (rows.column(i).to_numpy() for i in range(1, 6))
        comp = rows.column(7).to_numpy()
        if (comp == comp[0]).all():
            return None
        widths = _Widths(rows.column(6).combine_chunks())
        left, right = np.flatnonzero(tile == ta[0]), np.flatnonzero(tile == tb[0])
        out: tuple[list, list] = ([], [])
        found, dense = 0, False
        for k, i in enumerate(left):
            j = right[k + 1 :] if ta[0] == tb[0] else right
            j = j[(comp[j] != comp[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * rule.percent)]
            if len(j):
                apart = widths.apart(i, j)
                ok = rule.near((n[j] + n[i] - apart) // 2, n[j], n[i])
                j = j[ok]
                found += len(j)
                dense = nearest and found > DENSE * len(rep)
                if dense and len(j):
                    j = j[np.argmin(apart[ok] / (n[j] + n[i]))][None]
                out[0].append(np.full(len(j), rep[i]))
                out[1].append(rep[j])
        if not found:
            return None
        a, b = np.concatenate(out[0]), np.concatenate(out[1])
        pairs = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *[pa.nulls(len(a), pa.int64())] * 3]
        if dense:
            keys = [None, None, rows.column(0)[0].as_py(), int(ta[0]), int(tb[0])]
            pairs = [pa.concat_arrays([x, pa.array([k], pa.int64())]) for x, k in zip(pairs, keys, strict=True)]
        return pa.RecordBatch.from_arrays(pairs, names=["a", "b", "token", "ta", "tb"])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (k := tuple(keys[:, a])) != key:
                    if parts and (out := block(parts)) is not None:
                        yield out
                    key, parts = k, []
                parts.append(batch.slice(a, b - a))
        if parts and (out := block(parts)) is not None:
            yield out

    return run


def _verified(rule: Rule):
    """Rows (a, salt, b, k1, text), sorted by a, salt and with a itself first -> links."""

    def run(batches):
        at, own = None, None
        for batch in batches:
            a, salt, b, k1 = (batch.column(i).to_pylist() for i in range(4))
            found: tuple[list, list] = ([], [])
            for first, last, data, offsets in string_chunks(batch.column(4)):
                for i in range(last - first):
                    r = first + i
                    s = shingle_set(word_hashes(data[offsets[i] : offsets[i + 1]])[2], rule.words)
                    if _signed(_keys(s)[0]) != k1[r]:
                        continue  # another text under a repeated id
                    if a[r] == b[r]:
                        at, own = (a[r], salt[r]), s
                    elif at == (a[r], salt[r]) and rule.near(_overlap(own, s), len(own), len(s)):
                        found[0].append(a[r])
                        found[1].append(b[r])
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct elements."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _by_bitmaps(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of classes that their bitmaps let pass."""
    bits = nodes.select("rep", "n", "bits")
    a = bits.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    b = bits.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(lean(_by_bits(rule)), "a long, b long")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The pairs of classes, a < b, that the exact overlap confirms."""
    likely = scratch.keep(pairs, small=True)
    size = likely.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    stars = likely.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    stars = stars.union(size.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b")))
    wanted = scratch.keep(stars.join(nodes.select(F.col("rep").alias("b"), "doc_id", "k1"), "b"), small=True)
    ids = wanted.select("doc_id").distinct()
    texts = docs.select("doc_id", "text")
    texts = texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else texts
    rows = wanted.join(texts, "doc_id").select("a", "salt", "b", "k1", "text", (F.col("a") != F.col("b")).alias("later"))
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "later", "b").drop("later")
    found = scratch.keep(rows.mapInArrow(lean(_verified(rule)), "a long, b long"), small=True)
    scratch.drop(likely, wanted)
    return found


def _alpha(rule: Rule, n: Column) -> Column:
    return F.ceil(n * rule.percent / F.lit(100)).cast("long")


def _extra(rule: Rule, n: Column) -> Column:
    """How many of the hashes sent two classes at the threshold have in common at least, if n is the smaller's size."""
    return F.least(_alpha(rule, n), 1 + F.ceil(n / 20))


def _stands(meets: DataFrame, nodes: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """Of each class how many of its hashes are extra, in larger groups, in hot ones; and how many in larger ones it needs there."""
    held = meets.where("token is not null").select("token", F.col("a").alias("rep")).join(groups, "token")
    held = held.groupBy("rep").agg(F.count("*").alias("large"), F.count(F.when(F.col("classes") > HOT, 1)).alias("hot"))
    extra, least = _extra(rule, F.col("n")), _extra(rule, _alpha(rule, F.col("n")))
    found = nodes.select("rep", "n").join(held, "rep", "left").select("rep", extra.alias("extra"), F.coalesce("large", F.lit(0)).alias("large"), F.coalesce("hot", F.lit(0)).alias("hot"), ((1 - SHARE) * least).alias("needs"))
    return found


def _met(meets: DataFrame, stands: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes, a < b, that met often enough in small groups, or half as often as a larger group's first."""
    pairs = meets.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.isnull("token").alias("small")).agg(F.count("*").alias("times"))
    for side in ("a", "b"):
        own = stands.select(F.col("rep").alias(side), F.col("extra").alias(f"extra_{side}"), (F.col("extra") - F.col("large")).alias(f"least_{side}"), (F.col("extra") - F.col("hot")).alias(f"cool_{side}"))
        pairs = pairs.join(own, side)
    enough = (F.col("times") >= F.least("least_a", "least_b")) & (F.col("times") >= SHARE * F.least("cool_a", "cool_b"))
    enough = F.when(F.col("small"), enough).otherwise(F.col("times") * 2 >= F.least("extra_a", "extra_b"))
    return pairs.where(enough).select("a", "b").distinct()


def _tiles(meets: DataFrame, nodes: DataFrame, comps: DataFrame, groups: DataFrame, stands: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(token, ta, tb, tile, rep, n, bits): the classes of the large groups, tile by tile that they must face."""
    rows = meets.where("token is not null").select("token", F.col("a").alias("rep"))
    enter = stands.where("large > 0 and large >= needs").select("rep", "hot", "extra")
    rows = rows.join(groups.where("classes > 1"), "token").join(nodes.select("rep", "n").join(enter, "rep"), "rep")
    hot = F.when(F.col("classes") > HOT, F.lit(1)).otherwise(F.lit(0))
    # groups with one first class merge; kind 1: in a hot group, while its other hashes are enough
    kind = F.when((hot == 1) & (F.col("extra") > F.col("hot")), 1).otherwise(0)
    rows = scratch.keep(rows.groupBy("rep", "n", (F.col("first") * 2 + hot).alias("token")).agg(F.max(kind).alias("kind")))
    rows = rows.join(scratch.keep(rows.groupBy("token").agg(F.count("*").alias("members"))), "token")
    band = F.when(F.col("members") > TILE, F.floor(F.log(rule.base, F.col("n").cast("double")))).otherwise(F.lit(0))
    rows = rows.withColumn("band", band.cast("int"))
    rows = rows.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    sizes = rows.groupBy("token", "band", "kind").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    part = F.struct((F.col("band") * 2 + F.col("kind")).alias("k"), F.ceil(F.col("c") / TILE).cast("int").alias("h"))
    parts = sizes.groupBy("token").agg(F.map_from_entries(F.collect_list(part)).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = rows.join(parts.where("lo <> hi").select("token", "parts"), "token")

    def code(k, h):
        return k.cast("long") * F.lit(1 << 24) + h.cast("long")

    def facing(d: int, kind: int):
        """The tiles of the band d further, or none."""
        k = (F.col("band") + d) * 2 + kind
        n = F.try_element_at("parts", k)
        found = F.transform(F.sequence(F.lit(0), n - 1), lambda h: code(k, h))
        return F.when(n.isNotNull() & ((F.col("kind") == 0) | F.lit(kind == 0)), found).otherwise(F.array().cast("array<long>"))

    own = F.col("band") * 2 + F.col("kind")
    rows = rows.withColumn("tile", code(own, F.pmod(F.xxhash64("rep"), F.try_element_at("parts", own))))
    rows = rows.withColumn("other", F.explode(F.concat(*[facing(d, kind) for d in (-1, 0, 1) for kind in (0, 1)])))
    rows = rows.select("token", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "rep", "n")
    return scratch.keep(rows.join(nodes.select("rep", "bits"), "rep").select("token", "ta", "tb", "tile", "rep", "n", "bits"))


def _apart_in_tiles(tiles: DataFrame, comps: DataFrame, rule: Rule, nearest: bool) -> DataFrame:
    rows = tiles.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("token", "ta", "tb", "tile", "rep", "n", "bits", F.coalesce("component", "rep").alias("comp"))
    rows = rows.repartition(shuffle_partitions(tiles.sparkSession), "token", "ta", "tb").sortWithinPartitions("token", "ta", "tb")
    return rows.mapInArrow(lean(_in_tiles(rule, nearest)), "a long, b long, token long, ta long, tb long")


def _groups(firsts: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Classes (rid, n, tokens) -> what meets in the tokens' groups; the tokens that many send are salted."""
    counted = firsts.select("tokens").mapInArrow(lean(_repeated), "token long, n long").groupBy("token").agg(F.sum("n").alias("members"))
    counted = scratch.keep(counted.where(f"token is null or members > {SPLIT}"), small=True)
    total = counted.where("token is null").agg(F.max("members")).first()[0] or 0
    most = max(SPLIT, -(-total // BROADCAST_IDS))
    split = counted.where(f"token is not null and members > {most}").select("token", F.ceil(F.col("members") / most).cast("int").alias("parts"))
    rows = firsts.select("rid", "n", F.explode("tokens").alias("token")).join(F.broadcast(split), "token", "left")
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("parts"))).otherwise(F.lit(-1)).cast("int")
    rows = rows.select("token", salt.alias("salt"), "rid", "n")
    rows = rows.repartition(shuffle_partitions(firsts.sparkSession), "token", "salt").sortWithinPartitions("token", "salt", "n", "rid")
    return rows.mapInArrow(lean(_meets(rule)), MEETS)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text, ...) -> one row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z as a-z. Null and wordless texts have
    an empty set and are linked with nothing. Fewer words than ``words`` count as one shingle. A row
    without doc_id is returned with a null component and links nothing. Repeated ids and rows stay,
    each row by its own text. Columns besides doc_id and text are not read, so names can't clash. An
    empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    rule, scratch = Rule(words, percent), Scratch(spark, docs)
    docs = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sets = scratch.keep(docs.mapInArrow(lean(_sets(rule)), SETS))
    linkable = "n > 0 and doc_id is not null"
    classes = sets.where(linkable).groupBy("k1", "k2", "n").agg(F.min(F.when(F.col("tokens").isNotNull(), F.col("rid"))).alias("rep"), F.min("doc_id").alias("least_id"))
    classes = scratch.keep(classes)
    # tokens of a class stand in the first of its rows in each task; those of one of them count
    firsts = sets.where(f"{linkable} and tokens is not null")
    spare = scratch.keep(firsts.select("rid").join(classes.select(F.col("rep").alias("rid")), "rid", "left_anti"), small=True)
    spare = F.broadcast(spare) if spare.count() <= BROADCAST_IDS else spare
    firsts = firsts.join(spare, "rid", "left_anti")
    nodes = scratch.keep(firsts.select(F.col("rid").alias("rep"), "doc_id", "k1", "n", "bits"))
    meets = scratch.keep(_groups(firsts, rule, scratch))
    groups = scratch.keep(meets.where("token is not null").groupBy("token").agg(F.count("*").alias("classes"), F.min("a").alias("first")), small=True)
    stands = scratch.keep(_stands(meets, nodes, groups, rule), small=True)
    links = _links(_by_bitmaps(_met(meets, stands), nodes, rule), nodes, docs, rule, scratch)
    comps = components(links, scratch)
    tiles = _tiles(meets, nodes, comps, groups, stands, rule, scratch)
    scratch.drop(meets)
    for left in range(ROUNDS, -1, -1):
        found = scratch.keep(_apart_in_tiles(tiles, comps, rule, nearest=left > 0), small=True)
        links = links.union(_links(found.where("a is not null").select("a", "b").distinct(), nodes, docs, rule, scratch))
        comps = components(links, scratch)
        again = scratch.keep(found.where("token is not null").select("token", "ta", "tb").distinct(), small=True)
        if not (blocks := again.count()):
            break
        tiles = tiles.join(F.broadcast(again) if blocks <= BROADCAST_IDS else again, ["token", "ta", "tb"], "left_semi")
    named = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = scratch.keep(named.join(least, "comp").select("k1", "k2", "n", "component_id"))
    alone = sets.where(f"not ({linkable}) or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    joined = sets.where(linkable).select("doc_id", "k1", "k2", "n").join(named, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = scratch.keep(joined.union(alone))
    scratch.drop(*[t for t in list(scratch.tables()) if t is not out])
    return out


def keep_first(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, all columns; rows without an id stay.

    Repeated rows of one id and text stay together.
    """
    found = jaccard_components(docs, words, percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
