"""Each query's rows against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sectorloom.plans import container_queries  # noqa: F401, adds its queries
from sectorloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    return columns, sorted(map(str, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


def test_fills_of_whole_documents(spark, tmp_path):
    texts = {1: "abcdefgh" * 80, 2: "\0" * 512 + "x", 3: "é" * 300, 4: "abc", 5: None, 6: "", 7: "abcdefgh" * 64 + "other"}
    spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fills = {(r["doc_id"], r["chunk_index"]): r["repeats"] for r in QUERIES["pattern_fill_detect"](spark, str(tmp_path)).collect()}
    assert fills == {(1, 0): True, (1, 1): True, (2, 0): True, (2, 1): True, (3, 0): True, (3, 1): True, (4, 0): True, (7, 0): True, (7, 1): True}
    zeros = {k for k in ((r["doc_id"], r["chunk_index"]) for r in QUERIES["zero_chunk_detect"](spark, str(tmp_path)).where("zero").collect())}
    assert zeros == {(2, 0)}


def test_folds_of_whole_columns(spark, tmp_path):
    rows = [(4, "a", "en"), (8, "a", "en"), (9, "b", "en"), (None, "c", "en")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r["source"], r["first_doc"]) for r in QUERIES["first_wins_merge"](spark, str(tmp_path)).collect()} == {("a", 4), ("b", 9)}
    assert {(r["source"], r["n_values"]) for r in QUERIES["at_most_one_conflicts"](spark, str(tmp_path)).collect()} == {("a", 2)}
