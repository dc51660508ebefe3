"""More queries over the given tables with their SQL: codecs, reads and writes at positions, lookups, header maps and codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectorloom.functions import codes as C
from sectorloom.functions import scalar as S
from sectorloom.kernels.build import Options
from sectorloom.operators import catalog, chunks, ranges
from sectorloom.plans.queries import _LINES, _SQL_CHUNKS, CHUNK, _chunks, _lines, _payloads, _table, query
from sectorloom.sources.ewf import read_ewf
from sectorloom.sources.sink import copy_ewf, folder, resume_ewf, write_ewf, write_ewf_sets

# ---------------------------------------------------------------- chunks: codecs, damage, positions


def _roundtrip(spark, sf_dir, method: str):
    rows = _chunks(spark, sf_dir).withColumn("size", F.octet_length("data"))
    back = chunks.decode(chunks.encode(rows, CHUNK, method), "size")
    return back.select("doc_id", "chunk_index", F.md5("data").alias("md5"), "corrupted")


_SQL_ROUNDTRIP = _SQL_CHUNKS + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(unhex(hx)) AS md5, false AS corrupted FROM c"


@query(_SQL_ROUNDTRIP)
def codec_roundtrip_zlib(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "zlib")


@query(_SQL_ROUNDTRIP)
def codec_roundtrip_bzip2(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "bzip2")


@query(_SQL_CHUNKS + """SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_index % 3 = 1 AS corrupted, CASE WHEN chunk_index % 3 = 1 THEN repeat('00', length(hx) // 2) ELSE lower(hx) END AS data_hex FROM c""")
def zero_on_error(spark, sf_dir):
    """Every third chunk's stored bytes are damaged; it reads as zeros and is marked."""
    stored = chunks.encode(_chunks(spark, sf_dir).withColumn("size", F.octet_length("data")), CHUNK, "none")
    torn = F.when(F.col("chunk_index") % 3 == 1, F.expr("substr(stored, 2)")).otherwise(F.col("stored"))
    read = chunks.decode(stored.withColumn("stored", torn), "size", zero_on_error=True)
    return read.select("doc_id", "chunk_index", "corrupted", S.hex_lower(F.col("data")).alias("data_hex"))


@query("""WITH h AS (SELECT doc_id, lower(hex(encode(text))) AS hx, octet_length(encode(text)) AS n FROM documents WHERE text <> ''),
w AS (SELECT doc_id, rpad(repeat('00', 300) || hx, CAST(greatest(600 + 2 * n, 700) AS INTEGER), '0') AS base, n, substr(hx, 1, 2 * least(n, 100)) AS head FROM h)
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(laid, CAST(i * 1024 + 1 AS INTEGER), 1024) AS data_hex FROM
(SELECT doc_id, laid, unnest(range(0, CAST((length(laid) // 2 + 511) // 512 AS BIGINT))) AS i FROM
(SELECT doc_id, substr(base, 1, 700) || head || substr(base, CAST(701 + 2 * least(n, 100) AS INTEGER)) AS laid FROM w))""")
def positioned_writes(spark, sf_dir):
    """Each text is written at 300, then its first 100 bytes at 350 over it; the gap before is zeros."""
    rows = _payloads(spark, sf_dir).where(F.octet_length("payload") > 0)
    first = rows.select("doc_id", F.lit(300).cast("long").alias("offset"), F.lit(1).alias("seq"), F.col("payload").alias("data"))
    second = rows.select("doc_id", F.lit(350).cast("long").alias("offset"), F.lit(2).alias("seq"), F.substring("payload", 1, 100).alias("data"))
    return chunks.overlay(first.union(second), "doc_id", CHUNK).select("doc_id", "chunk_index", S.hex_lower(F.col("data")).alias("data_hex"))


@query(_SQL_CHUNKS + """, s AS (SELECT doc_id, chunk_index, length(hx) // 2 AS size FROM c)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, 'part' || CAST(chunk_index // 3 AS VARCHAR) AS path FROM s WHERE chunk_index < 30""")
def chunk_segment(spark, sf_dir):
    """The file that stores each chunk, three chunks to a file and ten files; later chunks are in none."""
    held = spark.range(10).select((F.col("id") * 3).alias("first_chunk"), F.lit(3).cast("long").alias("chunk_count"), F.col("id").alias("segment_index"))
    files = spark.range(10).select(F.col("id").alias("segment_index"), F.concat(F.lit("part"), F.col("id").cast("string")).alias("path"))
    return chunks.segment_of(_chunks(spark, sf_dir).select("doc_id", "chunk_index"), held, files).select("doc_id", "chunk_index", "path")


@query("""WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS hx FROM documents)
SELECT doc_id, substr(hx, 1, 600) || repeat('00', 700) || substr(hx, 801, 900) AS data_hex FROM h""")
def sparse_read(spark, sf_dir):
    """Files of three extents: 300 bytes of the text, 700 sparse ones, 450 more from its byte 400; what the text lacks is missing."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    shape = F.array(*[F.struct(F.lit(i).alias("extent_ordinal"), F.lit(a).cast("long").alias("data_offset"), F.lit(n).cast("long").alias("data_size"), F.lit(z).alias("sparse")) for i, (a, n, z) in enumerate(((0, 300, False), (0, 700, True), (400, 450, False)))])
    extents = docs.select("doc_id", F.explode(shape).alias("x")).select("doc_id", "x.*")
    files = catalog.logical_size(docs.withColumn("size", F.lit(None).cast("long")), extents, "doc_id", "size").withColumn("duplicate_data_offset", F.lit(-1).cast("long"))
    parts = catalog.file_parts(files, extents, _chunks(spark, sf_dir), CHUNK, ["doc_id"], ["doc_id"])
    joined = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", S.hex_lower(F.col("data")).alias("h")))).alias("p"))
    return joined.select("doc_id", F.array_join(F.transform("p", lambda x: x["h"]), "").alias("data_hex"))


@query("""WITH h AS (SELECT doc_id, lower(hex(encode(text))) AS hx, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 200 THEN substr(hx, 401, 1600) ELSE '' END AS data_hex FROM h""")
def file_read_at(spark, sf_dir):
    """800 bytes from byte 100 of files that duplicate the text's bytes from 100 on and have no extents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.coalesce(F.octet_length(F.encode("text", "UTF-8")), F.lit(0)).cast("long") - 100, F.lit(0)).alias("logical_size"), F.lit(100).cast("long").alias("duplicate_data_offset"))
    none = spark.createDataFrame([], "doc_id long, extent_ordinal int, data_offset long, data_size long, sparse boolean")
    parts = catalog.file_parts(docs, none, _chunks(spark, sf_dir), CHUNK, ["doc_id"], ["doc_id"], 100, 800)
    joined = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", S.hex_lower(F.col("data")).alias("h")))).alias("p"))
    read = joined.select("doc_id", F.array_join(F.transform("p", lambda x: x["h"]), "").alias("data_hex"))
    return docs.select("doc_id").join(read, "doc_id", "left").withColumn("data_hex", F.coalesce("data_hex", F.lit("")))


# ---------------------------------------------------------------- ranges


@query("""WITH i AS (SELECT s_suppkey, s_suppkey * 90 AS first, s_suppkey * 90 + 40 + s_suppkey % 7 * 20 AS last FROM supplier)
SELECT p.p_partkey, coalesce(min(i.s_suppkey), -1) AS s_suppkey FROM part p LEFT JOIN i ON p.p_partkey * 5 BETWEEN i.first AND i.last GROUP BY p.p_partkey""")
def section_containing_offset(spark, sf_dir):
    held = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 90).alias("first"), (F.col("s_suppkey") * 90 + 40 + F.col("s_suppkey") % 7 * 20).alias("last"))
    points = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 5).alias("at"))
    return ranges.containing(points, held, "at", "first", "last", "s_suppkey").select("p_partkey", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"))


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, s_suppkey % 6 AS q FROM supplier),
x AS (SELECT *, (n - 1) * 2 AS first, CAST(CASE WHEN q = 0 THEN 0 WHEN q = 1 THEN 3 WHEN q = 2 THEN 1 ELSE 2 END AS BIGINT) AS c FROM r),
t AS (SELECT s_nationkey, max(n) * 2 AS total FROM x GROUP BY s_nationkey),
y AS (SELECT x.*, total, coalesce(lag(first + c) OVER (PARTITION BY x.s_nationkey ORDER BY s_suppkey), 0) AS before, lead(first) OVER (PARTITION BY x.s_nationkey ORDER BY s_suppkey) AS next FROM x JOIN t ON x.s_nationkey = t.s_nationkey)
SELECT s_nationkey, s_suppkey, CASE WHEN c <= 0 THEN 'empty' WHEN first < before THEN 'overlap' WHEN first > before THEN 'gap' WHEN first + c > total THEN 'beyond' WHEN next IS NULL AND first + c < total THEN 'short' ELSE 'ok' END AS state FROM y""")
def contiguity_check(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long").alias("n"), (F.col("s_suppkey") % 6).alias("q"))
    count = F.when(F.col("q") == 0, 0).when(F.col("q") == 1, 3).when(F.col("q") == 2, 1).otherwise(2).cast("long")
    rows = rows.withColumn("first", (F.col("n") - 1) * 2).withColumn("c", count).withColumn("total", F.max("n").over(Window.partitionBy("s_nationkey")) * 2)
    return ranges.contiguity(rows, ["s_nationkey"], ["s_suppkey"], "first", "c", "total").select("s_nationkey", "s_suppkey", "state")


@query("""WITH u AS (SELECT l_orderkey AS k, l_partkey AS start, false AS audio FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_partkey, true FROM lineitem WHERE l_returnflag = 'R')
SELECT k, row_number() OVER (PARTITION BY k ORDER BY start, audio) AS ordinal, start, audio FROM u""")
def session_entry_order(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("first_sector"), "l_returnflag")
    return ranges.session_entries(rows.where("l_returnflag <> 'R'").drop("l_returnflag"), rows.where("l_returnflag = 'R'").drop("l_returnflag"), "k")


# ---------------------------------------------------------------- catalog


def _tree(spark, sf_dir):
    """World, regions, nations and customers as one catalog; customers are named by their number's last digit, so that siblings repeat."""
    root = spark.createDataFrame([("w", None, "world", 0)], "k string, up string, name string, child_ordinal long")
    region = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("k"), F.lit("w").alias("up"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("child_ordinal"))
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.concat(F.lit("r"), "n_regionkey").alias("up"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("child_ordinal"))
    customer = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("up"), F.concat(F.lit("c"), F.col("c_custkey") % 10).alias("name"), F.col("c_custkey").cast("long").alias("child_ordinal"))
    return root.union(region).union(nation).union(customer)


@query("""WITH c AS (SELECT c_nationkey, c_custkey % 10 AS d, min(c_custkey) AS first FROM customer GROUP BY ALL)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'c' || CAST(c.first AS VARCHAR) END AS entry FROM supplier s LEFT JOIN c ON s.s_nationkey = c.c_nationkey AND s.s_suppkey % 10 = c.d""")
def entry_by_path(spark, sf_dir):
    """Each supplier asks for the customer of its nation and last digit, some by a leading tab, a null character or a name that isn't there."""
    k = F.col("s_suppkey")
    places = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "n_name")
    asked = _table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    last = F.when(k % 4 == 3, F.lit("nobody")).otherwise(F.concat(F.lit("c"), k % 10))
    path = F.concat(F.when(k % 4 == 1, "\t").otherwise(""), "r_name", F.when(k % 4 == 2, "\0").otherwise("\t"), "n_name", F.lit("\t"), last)
    return catalog.entry_by_path(_tree(spark, sf_dir), asked.select("s_suppkey", path.alias("path")), "k", "up", "name", "child_ordinal").select("s_suppkey", "entry")


@query("""WITH g AS (SELECT r_regionkey AS g FROM region), a AS (SELECT s_suppkey % 7 AS g, s_suppkey AS ace FROM supplier WHERE s_suppkey % 7 <> 2)
SELECT n.n_nationkey, coalesce(a.ace, -1) AS ace FROM nation n LEFT JOIN (SELECT g.g, a.ace FROM g LEFT JOIN a USING (g)) a ON n.n_nationkey % 8 - 1 = a.g AND n.n_nationkey % 8 - 1 >= 0""")
def entry_acl(spark, sf_dir):
    entries = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 8 - 1).alias("ref"))
    groups = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("g"))
    aces = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("g"), F.col("s_suppkey").alias("ace")).where("g <> 2")
    return catalog.entry_acl(entries, groups, aces, "ref", "g").select("n_nationkey", F.coalesce("ace", F.lit(-1)).alias("ace"))


@query("""SELECT n.n_nationkey, s.name AS first_name FROM nation n LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY s_nationkey) s ON n.n_nationkey = s.s_nationkey""")
def source_by_identifier(spark, sf_dir):
    sources = _table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    wanted = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return catalog.source_by_identifier(sources, wanted, "s_nationkey", "s_suppkey").select(F.col("s_nationkey").alias("n_nationkey"), F.col("source.s_name").alias("first_name"))


@query("""SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS logical_size FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey""")
def logical_size(spark, sf_dir):
    entries = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("size"))
    extents = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("data_size"))
    return catalog.logical_size(entries, extents, "o_orderkey", "size").select("o_orderkey", "logical_size")


@query("""SELECT l_orderkey, bit_or(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END) AS flags FROM lineitem GROUP BY l_orderkey""")
def flags_folded(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).alias("flags"))
    return catalog.flags_folded(rows, ["l_orderkey"], "flags")


@query(f"""WITH l AS ({_LINES}), f AS (SELECT l_orderkey, arg_min(l_returnflag, n) AS flag FROM l GROUP BY l_orderkey)
SELECT l.l_orderkey, l.n, l.l_returnflag FROM l JOIN f ON l.l_orderkey = f.l_orderkey WHERE l.l_returnflag <> f.flag""")
def set_consistency(spark, sf_dir):
    """Lines whose flag differs from their order's first: segments of another set."""
    return catalog.differing(_lines(spark, sf_dir).select("l_orderkey", "n", "l_returnflag"), ["l_orderkey"], "l_returnflag", ["n"])


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN n_regionkey ELSE CAST(s_nationkey % 3 AS BIGINT) END AS sectors FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def geometry_filled(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_nationkey") % 3).cast("long").alias("sectors"))
    others = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("sectors"))
    return catalog.filled(rows, others, ["s_nationkey"], ["sectors"]).select("s_suppkey", "sectors")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""")
def tags_not_emitted(spark, sf_dir):
    values = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    done = _table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return catalog.without_emitted(values, done, ["n_nationkey"])


# ---------------------------------------------------------------- names, headers and codes


@query("""SELECT c_custkey, family, row_number() OVER (PARTITION BY family ORDER BY upper(ext), c_custkey) AS ordinal FROM (SELECT c_custkey, 'img' || CAST(c_custkey % 5 AS VARCHAR) || '.' || substr(c_mktsegment, 1, 1) AS family, ext FROM
(SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'E' ELSE 'e' END || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS ext FROM customer))""")
def discover_sort(spark, sf_dir):
    """File names in the order of their segments, families by stem and letter."""
    k = F.col("c_custkey")
    ext = F.concat(F.when(k % 2 == 0, "E").otherwise("e"), F.lpad((k % 100).cast("string"), 2, "0"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("img"), k % 5, F.lit("."), F.substring("c_mktsegment", 1, 1)).alias("family"), ext.alias("ext"))
    return catalog.segment_order(rows, ["family"], "ext", ["c_custkey"], "E").select("c_custkey", "family", "ordinal")


@query("""WITH e AS (SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS u, event_type AS t FROM events),
r AS (SELECT event_id, unnest(['notes', 'case_number', 'zeta', t]) AS identifier, unnest(['n', u, 'z', 'own']) AS value FROM e)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY CASE identifier WHEN 'case_number' THEN 1 WHEN 'notes' THEN 2 ELSE 3 END, identifier) AS ordinal, identifier, value FROM r""")
def header_enumeration(spark, sf_dir):
    """Headers set one by one, a value replaced, then listed: the standard ones first."""
    start = F.create_map(F.lit("zeta"), F.lit("z"), F.lit("case_number"), F.lit("old"))
    built = C.header_set(start, F.lit("notes"), F.lit("n"))
    built = C.header_set(C.header_set(built, F.lit("case_number"), F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.col("event_type"), F.lit("own"))
    return _table(spark, sf_dir, "events").select("event_id", F.explode(C.header_list(built)).alias("x")).select("event_id", "x.*")


@query("""SELECT p_partkey, CASE p_size WHEN 0 THEN 'removable' WHEN 1 THEN 'fixed' WHEN 3 THEN 'optical' WHEN 14 THEN 'single_files' WHEN 16 THEN 'memory' ELSE 'unknown' END AS media,
CASE p_size % 5 - 1 WHEN -1 THEN 'default' WHEN 0 THEN 'none' WHEN 1 THEN 'fast' WHEN 2 THEN 'best' END AS level, CASE p_size % 5 - 1 WHEN -1 THEN -1 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 9 END AS level_code,
(p_size & 1) <> 0 AS empty_block, (p_size & 16) <> 0 AS pattern_fill, p_size & 238 AS unknown_bits, p_size AS bits, (p_size & 2) <> 0 AS physical, (p_size & 14) | 1 AS media_bits FROM part""")
def enum_codes(spark, sf_dir):
    size = F.col("p_size").cast("int")
    rows = _table(spark, sf_dir, "part").select("p_partkey", size.alias("n"), C.compression_flags(size).alias("f"), C.media_flags(size, F.lit(False)).alias("m"))
    level = C.named(F.col("n") % 5 - 1, C.COMPRESSION_LEVELS)
    return rows.select("p_partkey", C.named(F.col("n"), C.MEDIA_TYPES, "unknown").alias("media"), level.alias("level"), F.coalesce(C.coded(level, C.COMPRESSION_LEVELS), F.lit(9)).alias("level_code"), "f.*", C.compression_bits(F.col("f")).alias("bits"), "m.physical", C.media_bits(F.col("m")).alias("media_bits"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS plain, CASE p_partkey % 3 WHEN 1 THEN '-' || CAST(p_size AS VARCHAR) WHEN 0 THEN CAST(p_size AS VARCHAR) END AS signed,
CAST(p_partkey AS VARCHAR) AS hexed, p_size AS pair_second FROM part""")
def number_parsers(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, n).when(k % 3 == 1, F.concat(F.lit("-"), n)).otherwise(F.concat(F.lit(" "), n))
    pair = C.number_pair(F.concat(k.cast("string"), F.lit("\t+0"), n))
    return _table(spark, sf_dir, "part").select("p_partkey", C.number(text, "u64").cast("string").alias("plain"), C.number(text, "i64").cast("string").alias("signed"), C.hex_number(F.lower(F.hex(k))).cast("string").alias("hexed"), pair["second"].cast("int").alias("pair_second"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS text FROM customer""")
def hex_stream_parse(spark, sf_dir):
    h = F.hex(F.encode("c_name", "UTF-8"))
    spaced = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.substring(h, 1, 3), F.lit("\n\t "), F.expr("substr(hex(encode(c_name, 'UTF-8')), 4)"))).otherwise(F.concat(h, F.lit("F")))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.decode(C.hex_stream(spaced), "UTF-8").alias("text"))


@query("""SELECT event_id, '<' || event_type || '&x' || CAST(user_id AS VARCHAR) || '&lt;>"' || event_type || '&' AS text FROM events""")
def xml_entity_decode(spark, sf_dir):
    """One pass: the bare ampersand takes the text up to the next semicolon with it, undecoded."""
    raw = F.concat(F.lit("&lt;"), "event_type", F.lit("&x"), F.col("user_id").cast("string"), F.lit("&lt;&gt;&quot;"), "event_type", F.lit("&"))
    return _table(spark, sf_dir, "events").select("event_id", C.entities_decoded(raw).alias("text"))


@query("""SELECT c_custkey, '/a/' || CAST(c_custkey % 7 AS VARCHAR) || '/' || c_name AS path FROM customer""")
def path_normalise(spark, sf_dir):
    k = (F.col("c_custkey") % 7).cast("string")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/../a/./b/../"), k, F.lit("//"), "c_name", F.lit("/x/.."))).otherwise(F.concat(F.lit("./"), k, F.lit("/"), "c_name"))
    return _table(spark, sf_dir, "customer").select("c_custkey", C.path_normalised(raw, "/a").alias("path"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN CASE WHEN c_custkey % 2 = 0 THEN md5(c_name) ELSE sha1(c_name) END END AS value FROM customer""")
def typed_hashes(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    value = F.upper(F.when(even, F.md5("c_name")).otherwise(F.sha1("c_name")))
    value = F.when(F.col("c_custkey") % 3 == 2, F.concat(value, F.lit("0"))).otherwise(value)
    return _table(spark, sf_dir, "customer").select("c_custkey", C.typed_hash(F.when(even, "md5").otherwise("Sha1"), value).alias("value"))


@query("""SELECT doc_id, text AS utf8 FROM documents""")
def code_pages(spark, sf_dir):
    """Texts through the ASCII page, which is UTF-8 in both directions."""
    return _table(spark, sf_dir, "documents").select("doc_id", C.page_decoded(C.page_encoded(F.col("text"), "ascii"), "ascii").alias("utf8"))


@query("""SELECT event_id, event_type AS name, 'v' || CAST(user_id AS VARCHAR) AS value FROM events""")
def attributes_codec(spark, sf_dir):
    own = F.array(F.struct(F.col("event_type").alias("name"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("value")))
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(C.attributes_parsed(C.attributes_text(own))).alias("x"))
    return rows.select("event_id", "x.name", "x.value")


# ---------------------------------------------------------------- whole containers

_SQL_IMAGE = _SQL_CHUNKS + """SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS chunk_index, md5(unhex(rpad(hx, 1024, '0'))) AS md5 FROM c"""


def _image(spark, sf_dir):
    """All texts' chunks, padded to a sector, as the chunks of one medium; and their number."""
    docs = _payloads(spark, sf_dir).where(F.octet_length("payload") > 0)
    n = S.chunk_count(F.octet_length("payload").cast("long"), CHUNK)
    counts = docs.select("doc_id", n.alias("n"))  # before the window, so that no text passes through it
    begins = counts.select("doc_id", (F.sum("n").over(Window.orderBy("doc_id")) - F.col("n")).alias("begin"))  # one row for each document
    rows = _chunks(spark, sf_dir).join(begins, "doc_id").select((F.col("begin") + F.col("chunk_index")).alias("chunk_index"), F.unhex(F.rpad(F.hex("data"), 2 * CHUNK, "0")).alias("data"))
    return rows, docs.agg(F.sum(n)).first()[0] or 0


def _written(spark, sf_dir, format: str, **how) -> str:
    rows, n = _image(spark, sf_dir)
    stem = f"{folder(spark)}/image"
    return write_ewf(rows, stem, n * CHUNK, Options(format, 1, CHUNK), **how)[0]


def _digests(spark, path: str):
    return read_ewf(spark, path).select("chunk_index", F.md5("data").alias("md5"))


def _register(format: str) -> None:
    def roundtrip(spark, sf_dir):
        return _digests(spark, _written(spark, sf_dir, format))

    roundtrip.__name__ = f"ewf_roundtrip_{format.lower()}"
    query(_SQL_IMAGE)(roundtrip)


for _format in ("E01", "L01", "S01", "Ex01", "Lx01"):
    _register(_format)


@query(_SQL_IMAGE)
def ewf_split_multi(spark, sf_dir):
    """In segments of 60,000 bytes, and so in as many sets as their names need; chunks are numbered through."""
    rows, n = _image(spark, sf_dir)
    sets = write_ewf_sets(rows, f"{folder(spark)}/image", n * CHUNK, Options("E01", 1, CHUNK), 60_000)
    parts = [_digests(spark, paths[0]).withColumn("chunk_index", F.col("chunk_index") + first) for first, paths in sets]
    return reduce(lambda a, b: a.union(b), parts)


@query(_SQL_IMAGE)
def ewf_mirror(spark, sf_dir):
    """Read from the second copy."""
    copy = f"{folder(spark)}/copy"
    _written(spark, sf_dir, "E01", mirror=copy)
    return _digests(spark, f"{copy}.E01")


@query(_SQL_IMAGE)
def ewf_resume(spark, sf_dir):
    """The first half is written without an end, then the set goes on with the rest."""
    rows, n = _image(spark, sf_dir)
    half, options = n // 2, Options("E01", 1, CHUNK)
    if not half:
        return _digests(spark, _written(spark, sf_dir, "E01"))
    path = write_ewf(rows.where(F.col("chunk_index") < half), f"{folder(spark)}/image", half * CHUNK, options, terminal=False)[0]
    more = rows.where(F.col("chunk_index") >= half).select((F.col("chunk_index") * CHUNK).alias("offset"), F.lit(0).alias("seq"), "data")
    return _digests(spark, resume_ewf(spark, path, more, n * CHUNK, options)[0])


@query(_SQL_IMAGE)
def ewf_copy(spark, sf_dir):
    """An image copied into the second generation."""
    return _digests(spark, copy_ewf(spark, _written(spark, sf_dir, "E01"), f"{folder(spark)}/copy", format="Ex01")[0])
