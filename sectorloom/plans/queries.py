"""Queries over the given tables, each with the SQL that gives the same rows.

The tables stand in for container data: texts for image payloads, orders and line items for ranges and
points, region to customer for a catalog tree, events for session entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectorloom.functions import scalar as S
from sectorloom.operators import catalog, chunks, ranges

CHUNK = 512
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split(_payloads(spark, sf_dir), "payload", CHUNK)


#: The same chunks in SQL: hex digits stand for bytes.
_SQL_CHUNKS = """WITH h AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents),
c AS (SELECT doc_id, i AS chunk_index, substr(hx, CAST(i * 1024 + 1 AS INTEGER), 1024) AS hx FROM (SELECT doc_id, hx, unnest(range(0, CAST((n + 511) // 512 AS BIGINT))) AS i FROM h))
"""

# ---------------------------------------------------------------- bytes and chunks


@query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST((octet_length(encode(text)) + 511) // 512 AS BIGINT) AS n_chunks,
CAST(CASE WHEN octet_length(encode(text)) = 0 THEN 0 ELSE octet_length(encode(text)) - ((octet_length(encode(text)) - 1) // 512) * 512 END AS BIGINT) AS last_size FROM documents""")
def chunk_geometry(spark, sf_dir):
    size = F.octet_length(F.encode("text", "UTF-8")).cast("long")
    rows = _table(spark, sf_dir, "documents").select("doc_id", size.alias("size"))
    rows = rows.withColumn("n_chunks", S.chunk_count(F.col("size"), CHUNK))
    return rows.withColumn("last_size", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(S.chunk_logical_size(F.col("size"), CHUNK, F.col("n_chunks") - 1)))


@query(_SQL_CHUNKS + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, lower(hx) AS data_hex FROM c")
def chunk_split(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", S.hex_lower(F.col("data")).alias("data_hex"))


@query("""SELECT doc_id, lower(substr(hex(encode(text)), 1401, 2000)) AS data_hex FROM documents WHERE octet_length(encode(text)) > 512""")
def read_window(spark, sf_dir):
    found = chunks.read_window(_chunks(spark, sf_dir), "doc_id", CHUNK, 700, 1000)
    return found.select("doc_id", S.hex_lower(F.col("data")).alias("data_hex"))


@query(_SQL_CHUNKS + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(unhex(hx)) AS md5 FROM c")
def chunk_md5(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", F.md5("data").alias("md5"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(encode(text)) AS md5, sha1(encode(text)) AS sha1 FROM documents WHERE text <> ''")
def stream_verify(spark, sf_dir):
    return chunks.stream_hashes(_chunks(spark, sf_dir), "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN true ELSE false END AS md5_match FROM documents WHERE text <> ''""")
def stored_hash_match(spark, sf_dir):
    stored = F.when(F.col("doc_id") % 3 == 1, F.md5("payload")).when(F.col("doc_id") % 3 == 2, F.lit("0" * 31 + "1"))
    known = _payloads(spark, sf_dir).select("doc_id", stored.alias("stored"))
    found = chunks.stream_hashes(_chunks(spark, sf_dir), "doc_id")
    return found.join(known, "doc_id").select("doc_id", (F.col("md5") == F.col("stored")).alias("md5_match"))


@query(_SQL_CHUNKS + """, b AS (SELECT doc_id, chunk_index, length(hx) // 2 AS n, unnest(range(0, CAST(length(hx) // 2 AS BIGINT))) AS i, hx FROM c),
v AS (SELECT doc_id, chunk_index, n, i, CAST('0x' || substr(hx, CAST(i * 2 + 1 AS INTEGER), 2) AS BIGINT) AS x FROM b)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST((1 + sum(x)) % 65521 + 65536 * ((max(n) + sum((n - i) * x)) % 65521) AS BIGINT) AS adler32 FROM v GROUP BY doc_id, chunk_index""")
def adler32_chunk(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", S.adler32(F.col("data")).alias("adler32"))


@query(_SQL_CHUNKS + """SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, hx = substr(repeat(rpad(substr(hx, 1, 16), 16, '0'), 64), 1, length(hx)) AS repeats FROM c""")
def pattern_fill_detect(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", S.repeats_pattern(F.col("data")).alias("repeats"))


@query(_SQL_CHUNKS + """SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, hx = repeat('0', 1024) AS zero FROM c""")
def zero_chunk_detect(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", S.all_zero(F.col("data"), CHUNK).alias("zero"))


@query("""SELECT p_partkey, p_size * 512 AS chunk, p_size * 512 + 4 AS raw_cap,
greatest(p_size * 512 + ((p_size * 512) >> 12) + ((p_size * 512) >> 14) + ((p_size * 512) >> 25) + 13, p_size * 512 + p_size * 5 + 6) AS zlib_cap,
p_size * 512 + (p_size * 512) // 100 + 4096 AS bzip2_cap FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""")
def encoded_size_caps(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * 512).alias("chunk"))
    c = F.col("chunk")
    return rows.select("p_partkey", "chunk", S.raw_size_cap(c).alias("raw_cap"), S.zlib_size_cap(c).alias("zlib_cap"), S.bzip2_size_cap(c).alias("bzip2_cap"))


@query("SELECT doc_id, CAST((octet_length(encode(text)) + 511) // 512 * 512 AS BIGINT) AS padded_size FROM documents")
def pad_to_sector(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", S.padded(F.octet_length("payload"), 512).alias("padded_size"))


# ---------------------------------------------------------------- ranges


_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS n FROM lineitem"


def _lines(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return _table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long"))


@query(f"""WITH e AS (SELECT l_orderkey, n, CAST(l_quantity AS BIGINT) AS q FROM ({_LINES})), o AS (SELECT *, sum(q) OVER (PARTITION BY l_orderkey ORDER BY n) - q AS pos, sum(q) OVER (PARTITION BY l_orderkey) AS data_end FROM e)
SELECT l_orderkey, n, CAST(coalesce(lead(pos) OVER (PARTITION BY l_orderkey ORDER BY n), data_end) - pos AS BIGINT) AS encoded_size FROM o""")
def table_entry_sizes(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("n")
    rows = _lines(spark, sf_dir).select("l_orderkey", "n", F.col("l_quantity").cast("long").alias("q"))
    rows = rows.withColumn("at", F.sum("q").over(w) - F.col("q")).withColumn("data_end", F.sum("q").over(Window.partitionBy("l_orderkey")))
    return ranges.entry_sizes(rows, "l_orderkey", ["n"], "at", "data_end").select("l_orderkey", "n", "encoded_size")


@query("""WITH r AS (SELECT s_suppkey, s_suppkey * 7 - 7 AS first_chunk, CASE WHEN s_suppkey % 5 = 0 THEN 3 ELSE 7 END AS chunk_count FROM supplier)
SELECT p.p_partkey, r.s_suppkey, p.p_partkey - r.first_chunk AS local_index FROM part p JOIN r ON p.p_partkey >= r.first_chunk AND p.p_partkey < r.first_chunk + r.chunk_count""")
def range_lookup(spark, sf_dir):
    held = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 - 7).alias("first_chunk"), F.when(F.col("s_suppkey") % 5 == 0, 3).otherwise(7).alias("chunk_count"))
    found = ranges.locate(_table(spark, sf_dir, "part").select("p_partkey"), held, "p_partkey", "first_chunk", "chunk_count", ["s_suppkey"])
    return found.select("p_partkey", "s_suppkey", (F.col("p_partkey") - F.col("first_chunk")).alias("local_index"))


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, s_suppkey * 10 AS first_chunk, CAST(10 + s_suppkey % 7 - 3 AS BIGINT) AS chunk_count FROM supplier),
w AS (SELECT *, coalesce(lag(first_chunk + chunk_count) OVER (PARTITION BY s_nationkey ORDER BY first_chunk, chunk_count), 0) AS prior_end FROM r)
SELECT s_nationkey, s_suppkey, prior_end, CASE WHEN chunk_count <= 0 THEN 'empty' WHEN first_chunk > prior_end THEN 'gap' WHEN first_chunk < prior_end THEN 'overlap' ELSE 'ok' END AS state FROM w""")
def range_coverage(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 10).alias("first_chunk"), (10 + F.col("s_suppkey") % 7 - 3).alias("chunk_count"))
    return ranges.coverage(rows, ["s_nationkey"], "first_chunk", "chunk_count").select("s_nationkey", "s_suppkey", "prior_end", "state")


_ENTRIES = """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, (event_type = 'view') AS audio, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT user_id, max(start) + 1 AS total FROM e GROUP BY user_id)
"""


def _entries(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"), (F.col("event_type") == "view").alias("audio"), "ts")
    return rows.withColumn("total", F.max("start").over(Window.partitionBy("user_id")) + 1)


@query(_ENTRIES + """, k AS (SELECT user_id, n, CASE WHEN n = 1 THEN 0 ELSE start END AS first FROM e WHERE n = 1 OR NOT audio)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n) AS ordinal, first AS first_sector, CAST(coalesce(lead(first) OVER (PARTITION BY user_id ORDER BY n), total) - first AS BIGINT) AS sector_count FROM k JOIN t USING (user_id)""")
def sessions_from_flags(spark, sf_dir):
    return ranges.sessions(_entries(spark, sf_dir), "user_id", "start", "audio", ["ts", "event_id"], "total")


@query(_ENTRIES + """, a AS (SELECT e.*, total, lag(audio) OVER (PARTITION BY user_id ORDER BY n) AS before, count(*) OVER (PARTITION BY user_id) AS m FROM e JOIN t USING (user_id)),
c AS (SELECT user_id, start AS stop, n FROM a WHERE before UNION ALL SELECT user_id, total, n + 1 FROM a WHERE n = m AND audio AND n > 1),
d AS (SELECT user_id, n, stop, coalesce(lag(stop) OVER (PARTITION BY user_id ORDER BY n), 0) AS first FROM c)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n) AS ordinal, first AS first_sector, CAST(stop - first AS BIGINT) AS sector_count FROM d""")
def tracks_from_flags(spark, sf_dir):
    return ranges.tracks(_entries(spark, sf_dir), "user_id", "start", "audio", ["ts", "event_id"], "total")


@query("""SELECT DISTINCT user_id, CAST((CAST(floor(epoch(ts)) AS BIGINT) * 512) // 2048 AS BIGINT) AS first_sector, CAST(greatest((CAST(event_id % 900 AS BIGINT) + 2047) // 2048, 1) AS BIGINT) AS sector_count FROM events WHERE event_type = 'error'""")
def error_ranges(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").where("event_type = 'error'")
    first, count = S.error_range(F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("event_id") % 900, 512, F.lit(2048))
    return rows.select("user_id", first.alias("first_sector"), count.alias("sector_count")).distinct()


@query(f"""SELECT l_orderkey, n, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY n) - CAST(l_quantity AS BIGINT) AS BIGINT) AS file_position FROM ({_LINES})""")
def extent_running_position(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "n", F.col("l_quantity").cast("long").alias("size"))
    return ranges.positions(rows, "l_orderkey", ["n"], "size").select("l_orderkey", "n", "file_position")


@query(f"""WITH x AS (SELECT l_orderkey, n, l_partkey * 13 AS pos, CAST(l_quantity AS BIGINT) * 40 AS size FROM ({_LINES})),
y AS (SELECT *, unnest(range(pos // 512, (pos + size - 1) // 512 + 1)) AS k FROM x WHERE size > 0)
SELECT l_orderkey, n, CAST(k AS BIGINT) AS chunk_index, CAST(greatest(pos, k * 512) - k * 512 AS BIGINT) AS begin_in_chunk, CAST(least(pos + size, (k + 1) * 512) - greatest(pos, k * 512) AS BIGINT) AS bytes FROM y""")
def extent_chunk_overlap(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "n", (F.col("l_partkey") * 13).alias("at"), (F.col("l_quantity").cast("long") * 40).alias("size"))
    return ranges.extent_chunks(rows, "at", "size", CHUNK).select("l_orderkey", "n", "chunk_index", "begin_in_chunk", "bytes")


@query("""WITH RECURSIVE s AS (SELECT source, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
p AS (SELECT source, doc_id, size, n, size AS used, CAST(1 AS BIGINT) AS segment FROM s WHERE n = 1
UNION ALL SELECT s.source, s.doc_id, s.size, s.n, CASE WHEN p.used > 0 AND p.used + s.size > 20000 THEN s.size ELSE p.used + s.size END, CASE WHEN p.used > 0 AND p.used + s.size > 20000 THEN p.segment + 1 ELSE p.segment END FROM p JOIN s ON s.source = p.source AND s.n = p.n + 1)
SELECT source, doc_id, size, segment FROM p""")
def segment_pack(spark, sf_dir):
    rows = _payloads(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return chunks.pack(rows.select("source", "doc_id", F.octet_length("payload").alias("size")), "source", ["doc_id"], "size", 20000)


# ---------------------------------------------------------------- catalog


@query("""SELECT n.n_nationkey, c.c_custkey, 'world' || chr(9) || r.r_name || chr(9) || n.n_name || chr(9) || c.c_name AS path FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def catalog_paths(spark, sf_dir):
    nodes = spark.createDataFrame([("w", None, "world")], "k string, up string, name string")
    region = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("k"), F.lit("w").alias("up"), F.col("r_name").alias("name"))
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.concat(F.lit("r"), "n_regionkey").alias("up"), F.col("n_name").alias("name"))
    customer = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("up"), F.col("c_name").alias("name"))
    found = catalog.paths(nodes.union(region).union(nation).union(customer), "k", "up", "name").where("depth = 3")
    keys = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entry"), F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return found.join(keys, "entry").select("n_nationkey", "c_custkey", "path")


@query("""SELECT o.o_orderkey, s.s_name AS source_name FROM orders o LEFT JOIN supplier s ON o.o_orderkey % 40 - 3 = s.s_suppkey AND o.o_orderkey % 40 - 3 >= 1""")
def entry_source(spark, sf_dir):
    entries = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40 - 3).alias("ref"))
    return catalog.entry_sources(entries, _table(spark, sf_dir, "supplier"), "ref", "s_suppkey").select("o_orderkey", F.col("s_name").alias("source_name"))


@query("""SELECT o.o_orderkey, f.name AS subject_name FROM orders o LEFT JOIN (SELECT c_nationkey, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY c_nationkey) f ON o.o_orderkey % 30 = f.c_nationkey""")
def entry_subject(spark, sf_dir):
    entries = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("ref"))
    subjects = _table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return catalog.entry_subjects(entries, subjects, "ref", "c_nationkey", "c_custkey").select("o_orderkey", F.col("subject.c_name").alias("subject_name"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_aces FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def acl_count(spark, sf_dir):
    return catalog.count_of(_table(spark, sf_dir, "orders").select("o_orderkey"), _table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "n_aces")


@query(f"""SELECT l_orderkey, greatest(max(CAST(l_quantity AS BIGINT)), max(CASE WHEN l_returnflag <> 'R' THEN l_partkey + CAST(l_quantity AS BIGINT) END)) AS data_size FROM lineitem GROUP BY l_orderkey""")
def tree_data_size(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("size"), F.col("l_partkey").alias("at"), (F.col("l_returnflag") == "R").alias("sparse"))
    return catalog.data_size(rows, ["l_orderkey"], "size", "at", "sparse")


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_guid FROM lineitem GROUP BY l_orderkey""")
def tree_any_guid(spark, sf_dir):
    return catalog.any_present(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", "any_guid")


@query("""SELECT source, lang, min(doc_id) AS first_doc FROM documents GROUP BY source, lang""")
def first_wins_merge(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.col("doc_id").alias("first_doc"))
    return catalog.first_wins(rows, ["source", "lang"], "first_doc", ["doc_id"])


@query("""SELECT source, lang, count(doc_id) AS n_values FROM documents GROUP BY source, lang HAVING count(doc_id) > 1""")
def at_most_one_conflicts(spark, sf_dir):
    return catalog.at_most_one(_table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


@query("""SELECT user_id, arg_max(event_type, row(ts, event_id)) <> 'error' AS complete FROM events GROUP BY user_id""")
def acquisition_complete(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "error", "next").otherwise(F.col("event_type")))
    return catalog.complete(rows, ["user_id"], "kind", ["ts", "event_id"])


# ---------------------------------------------------------------- text and codes


@query("""SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 99 THEN 'E' || lpad(CAST(p_partkey AS VARCHAR), 2, '0') WHEN p_partkey >= 100 AND 69 + (p_partkey - 100) // 676 <= 90
THEN chr(CAST(69 + (p_partkey - 100) // 676 AS INTEGER)) || chr(CAST(65 + (p_partkey - 100) % 676 // 26 AS INTEGER)) || chr(CAST(65 + (p_partkey - 100) % 26 AS INTEGER)) END AS extension FROM part""")
def segment_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.segment_extension(F.col("p_partkey"), "E").alias("extension"))


@query("""SELECT p_partkey, regexp_full_match(upper(substr(p_name, 1, 3)), 'E([0-9]{2}|[A-Z]{2})|[F-Z][A-Z]{2}') AS continues FROM part""")
def discover_match(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.segment_matches(F.substring("p_name", 1, 3), "E").alias("continues"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || ' ' || CAST(month(o_orderdate) AS VARCHAR) || ' ' || CAST(day(o_orderdate) AS VARCHAR) || ' ' || CAST(hour(o_orderdate) AS VARCHAR) || ' ' || CAST(minute(o_orderdate) AS VARCHAR) || ' ' || CAST(second(o_orderdate) AS VARCHAR) AS legacy,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%a %b ') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') || strftime(o_orderdate, ' %H:%M:%S %Y') AS ctime,
strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS day_month, strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS month_day FROM orders""")
def date_formats(spark, sf_dir):
    ts = F.col("ts")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return rows.select("o_orderkey", S.date_legacy(ts).alias("legacy"), S.date_iso(ts).alias("iso"), S.date_ctime(ts).alias("ctime"), S.date_day_month(ts).alias("day_month"), S.date_month_day(ts).alias("month_day"))


@query("""SELECT o_orderkey, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS legacy, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS iso, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS unix, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS ctime, true AS other_is_null FROM orders""")
def date_parse(spark, sf_dir):
    ts = F.col("ts")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    texts = rows.select("o_orderkey", S.date_legacy(ts).alias("a"), S.date_iso(ts).alias("b"), F.unix_timestamp(ts).cast("string").alias("c"), S.date_ctime(ts).alias("d"))
    read = lambda c: F.unix_timestamp(S.date_parsed(F.col(c)))
    return texts.select("o_orderkey", read("a").alias("legacy"), read("b").alias("iso"), read("c").alias("unix"), read("d").alias("ctime"), S.date_parsed(F.concat(F.lit("x"), "a")).isNull().alias("other_is_null"))


@query("""SELECT event_id, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped, props AS unescaped FROM events""")
def xml_text(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", S.xml_escaped(F.col("props")).alias("escaped"))
    return rows.withColumn("unescaped", S.xml_unescaped(F.col("escaped")))


@query("""SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS clean FROM documents""")
def sanitize_header(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.sanitized(F.col("text")).alias("clean"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(md5(c_name)) END AS digest, CASE WHEN c_custkey % 3 <> 0 THEN md5(c_name) END AS base16 FROM customer""")
def hex_strict_parse(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("h"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.upper("h")).otherwise(F.concat("h", F.lit("0")))
    return rows.select("c_custkey", S.hex_lower(S.strict_unhex(text, 16)).alias("digest"), S.base16(F.when(F.col("c_custkey") % 3 == 0, F.lit("0" * 32)).otherwise(F.upper("h"))).alias("base16"))


@query("""SELECT p_partkey, (p_size & 1) <> 0 AS compressed, (p_size & 2) <> 0 AS has_checksum, ((p_size & 4) <> 0 AND (p_size & 1) <> 0) AS pattern,
CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'zlib' WHEN 2 THEN 'bzip2' ELSE 'unknown' END AS method FROM part""")
def flag_bits(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.chunk_flags(F.col("p_size")).alias("f"), S.method_name(F.col("p_size") % 4).alias("method")).select("p_partkey", "f.*", "method")


@query("""SELECT p_partkey, p_partkey * 16 AS data_offset, CAST(p_size AS BIGINT) AS data_size, p_size % 2 = 0 AS sparse FROM part""")
def extent_text_codec(spark, sf_dir):
    text = F.concat_ws(" ", F.lit("1"), F.when(F.col("p_size") % 2 == 0, "S"), F.lower(F.hex(F.col("p_partkey") * 16)), F.lower(F.hex("p_size")))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.explode(S.extents_parsed(text)).alias("x"))
    return rows.select("p_partkey", "x.data_offset", "x.data_size", "x.sparse")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS short_name FROM part""")
def short_name_codec(spark, sf_dir):
    size = F.octet_length("p_name") + F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(0)
    return _table(spark, sf_dir, "part").select("p_partkey", S.short_name(F.concat(size.cast("string"), F.lit(" "), F.col("p_name"))).alias("short_name"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'EWF1' WHEN 1 THEN 'L01' WHEN 2 THEN 'EWF2' WHEN 3 THEN 'LEF2' END AS family FROM nation""")
def signature_probe(spark, sf_dir):
    hexes = F.array(*[F.lit(h + "FFFF") for h in S.SIGNATURES], F.lit("00" * 10))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.unhex(F.get(hexes, F.col("n_nationkey") % 5)).alias("content"))
    return rows.select("n_nationkey", S.signature_format(F.col("content")).alias("family"))


@query("""SELECT event_id, event_type IN ('view', 'click', 'error') AS corrupt FROM events""")
def corruption_message_probe(spark, sf_dir):
    words = F.when(F.col("event_type") == "view", "table Checksum differs").when(F.col("event_type") == "click", "section integrity hash mismatch").when(F.col("event_type") == "error", "CORRUPT chunk").otherwise("offsets are not ordered")
    return _table(spark, sf_dir, "events").select("event_id", S.is_corruption(words).alias("corrupt"))


@query("""SELECT event_id, k AS identifier, v AS value, row_number() OVER (PARTITION BY event_id ORDER BY k) AS ordinal FROM (SELECT event_id, unnest(['case_number', 'description', 'model']) AS k, unnest([CAST(user_id AS VARCHAR), event_type, 'm' || CAST(event_id % 3 AS VARCHAR)]) AS v FROM events)""")
def header_tabular_parse(spark, sf_dir):
    lines = F.concat(F.lit("1\nmain\ncase_number\tdescription\tmodel\n"), F.concat_ws("\t", F.col("user_id").cast("string"), "event_type", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))), F.lit("\n\n"))
    return _table(spark, sf_dir, "events").select("event_id", F.explode(S.tabular(lines)).alias("x")).select("event_id", "x.*")
