"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

Each task splits its texts into pre-tokens, numbers the distinct ones of a block of documents and keeps
each document as the sequence of those numbers, by position, in a table bucketed by block. The blocks'
distinct words, packed by a hash of the word, meet in a global shuffle where each distinct word is encoded
once; the ids join back to their block, whose documents stay where they are, and the documents are
reassembled by position. Decoding looks the ids up in the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorloom.llm.common import bounded_batches, lean, leaves, shared_dir, shuffle_partitions, text_column

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A block ends at so many distinct words or so many characters.
BLOCK_WORDS = 300_000
BLOCK_CHARS = 48 << 20
#: Words of a bucket that a task remembers at once; one that comes after more of them is encoded again.
KNOWN = 500_000
#: Documents in a row of the table of blocks.
ROW_DOCS = 100

# The classes of public_tokenizers.PATTERN up to U+024F, where the standard library's faster engine does.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_near = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_any = regex.compile(public_tokenizers.PATTERN).findall
_far = re.compile("[^\x00-ɏ]").search


def pre_tokens(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN; they cover the whole text."""
    return _any(text) if _far(text) else _near(text)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: where each id's bytes begin (one more entry at the end), and the bytes."""
    found = ranks(path)
    size = max(found.values()) + 1
    by_id = [b""] * size
    for token, i in found.items():
        by_id[i] = token
    starts = np.zeros(size + 1, np.int64)
    np.cumsum([len(x) for x in by_id], out=starts[1:])
    return starts, np.frombuffer(b"".join(by_id), np.uint8)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def decoded(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    starts, data = table
    at = starts[ids]
    return data[_spread(at, starts[ids + 1] - at)].tobytes()


# ---------------------------------------------------------------- packing

def _planes(a: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next ones, and so on: each plane compresses better alone."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(map(_planes, arrays)) + tail)


def _unpack(payload: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    k = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, out = 4 * (k + 1), []
    for n in np.frombuffer(raw, np.uint32, k, 4).tolist():
        width = raw[at]
        whole = np.zeros((n, 4), np.uint8)
        whole[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(whole.view("<u4").ravel())
        at += 1 + n * width
    return out, raw[at:]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


BLOCKS = "block long, bucket int, doc_ids array<long>, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "bucket", "doc_ids", "payload"])


def _blocks(buckets: int):
    """(doc_id, text) -> a block's documents as the numbers of their words (bucket null), and its words by bucket."""

    def whole(block: int, numbers: _Numbers, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = list(numbers)
        counts = np.zeros(len(words), np.int64)
        for _, ids in docs:
            np.add.at(counts, ids, 1)
        rank = np.empty(len(words), np.int64)  # frequent words get small numbers
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        rows = []
        for i in range(0, len(docs), ROW_DOCS):
            own = docs[i : i + ROW_DOCS]
            sizes, flat = np.array([len(x) for _, x in own]), np.concatenate([x for _, x in own])
            rows.append((block, None, [d for d, _ in own], _pack(sizes, rank[flat])))
        yield _batch(rows)
        coded = sorted((zlib.crc32(w := word.encode()) % buckets, w, i) for i, word in enumerate(words))
        at = np.fromiter((b for b, _, _ in coded), np.int64, len(coded))
        rows = []
        for part in np.split(np.arange(len(coded)), np.flatnonzero(np.diff(at)) + 1) if coded else []:
            own = [coded[i] for i in part]
            rows.append((block, own[0][0], None, _pack(rank[[i for _, _, i in own]], np.array([len(w) for _, w, _ in own]), tail=b"".join(w for _, w, _ in own))))
        yield _batch(rows)

    def run(batches):
        block, numbers, docs, chars = TaskContext.get().partitionId() << 33, _Numbers(), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = pre_tokens(text or "")
                docs.append((doc_id, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
                chars += len(text or "")
                if len(numbers) >= BLOCK_WORDS or chars >= BLOCK_CHARS:
                    yield from whole(block, numbers, docs)
                    block, numbers, docs, chars = block + 1, _Numbers(), [], 0
        if docs:
            yield from whole(block, numbers, docs)

    return run


def _encode_words(path: str):
    """The blocks' packed words of each bucket -> the same with ids; a distinct word is encoded once."""

    def run(batches):
        encode, of, known = encoding(path).encode_ordinary, None, {}
        for batch in batches:
            rows = []
            for block, bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket != of or len(known) > KNOWN:
                    of, known = bucket, {}
                (numbers, lengths), data = _unpack(payload)
                ends = np.cumsum(lengths).tolist()
                ids, at = [], 0
                for end in ends:
                    word, at = data[at:end], end
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word.decode())
                    ids.append(got)
                counts = np.array([len(x) for x in ids])
                rows.append((block, bucket, None, _pack(numbers, counts, np.array([i for x in ids for i in x]))))
            yield _batch(rows)

    return run


def _assemble(words: pa.Table, docs: pa.Table) -> pa.Table:
    """The ids of a block's words and its documents' words -> (doc_id, ids)."""
    starts, counts, flat = _block_table([_unpack(x)[0] for x in words.column("payload").to_pylist()])
    out = []
    for doc_ids, payload in zip(docs.column("doc_ids").to_pylist(), docs.column("payload").to_pylist(), strict=True):
        (sizes, numbers), _ = _unpack(payload)
        n = counts[numbers]
        ids = flat[_spread(starts[numbers], n)].astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        at = ends[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))].astype(np.int32)
        out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=["doc_id", "ids"]))
    return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def _block_table(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of a block's numbers, where its ids begin and how many there are; and the ids."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    numbers, counts, flat = (np.concatenate([p[i] for p in parts]) for i in range(3))
    starts_of = np.cumsum(counts.astype(np.int64)) - counts
    starts, sizes = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    starts[numbers], sizes[numbers] = starts_of, counts
    return starts, sizes, flat


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, ids array<int>), a row for each row; without special tokens.

    A null text counts as empty and has no ids. A null doc_id and repeated rows are kept as they are.
    Other columns aren't read. An empty table gives an empty result. ``vocabulary``: a file of ranks
    that each executor can open.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts, name = shuffle_partitions(spark), f"sectorloom_{uuid.uuid4().hex}"
    docs = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    leaves(spark, path, name)
    blocks = docs.mapInArrow(lean(_blocks(parts)), BLOCKS)
    blocks.write.bucketBy(parts, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    words = blocks.where("bucket is not null").repartition(parts, "bucket").sortWithinPartitions("bucket")
    words = words.mapInArrow(lean(_encode_words(vocabulary)), BLOCKS).select("block", "payload")
    own = blocks.where("bucket is null").select("block", "doc_ids", "payload")
    return words.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded`` binary, the bytes of the column ``ids`` array<int>; null or no ids give no bytes.

    An id that the vocabulary lacks raises an error. All columns are kept; one named ``decoded`` is replaced.
    """
    bounded_batches(encoded.sparkSession)
    rest = [f for f in encoded.schema if f.name != "decoded"]
    at = [f.name for f in rest].index("ids")

    def run(batches):
        table = token_table(vocabulary)
        for batch in batches:
            ids = batch.column(at)
            out = [decoded(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int64), table) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = encoded.select(*[f.name for f in rest]).schema.add("decoded", "binary")
    return encoded.select(*[f.name for f in rest]).mapInArrow(lean(run), schema)
