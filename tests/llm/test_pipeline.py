"""The pipeline's stages on a small corpus: decisions take effect, clean documents stay."""

import hashlib
import random

import corpus_pipeline
from sectorloom.llm import byte_bpe, jaccard_join, mixing


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    clean = lambda n=50: " ".join(rng.choice(["thing", "under", "other", "ration", "likely", "onward"]) + rng.choice(["", "s", "er", "ly", "ing"]) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        words = clean().split()
        if bad:
            words[7] = rng.choice(["stupid", "idiot", "scumbag"])
        rows.append((i, " ".join(words), "en", "ab"[i % 2], 0))
        labels.append((i, 1, int(bad)))
    rows.append((500, rows[1][1], "en", "a", 0))
    rows.append((501, clean() + " mail me@host.org " + clean(), "en", "b", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == before
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert sum(i % 4 == 0 for i in kept if i < 160) <= 2 and sum(i % 4 != 0 for i in kept if i < 160) >= 118
    firsts = {r["doc_id"] for r in seen["near_duplicates"]}
    assert 500 not in firsts and 1 in firsts
    assert firsts == {r["doc_id"] for r in jaccard_join.keep_first(spark.read.parquet(str(tmp_path / "toxicity"))).collect()}
    (mail,) = [r["text"] for r in seen["personal_data"] if r["doc_id"] == 501]
    assert "<EMAIL>" in mail and "@" not in mail
    mixed = mixing.mix_sources(spark.read.parquet(str(tmp_path / "personal_data"))).select("doc_id", "mix.parts").collect()
    assert sorted(r["doc_id"] for r in seen["mixing"]) == sorted(r["doc_id"] for r in mixed for _ in r["parts"])
    plain, texts = byte_bpe.encoding(byte_bpe.VOCABULARY), {r["doc_id"]: r["text"] for r in seen["personal_data"]}
    assert len(seen["tokens"]) == len(seen["mixing"])
    for r in seen["tokens"]:
        assert list(r["ids"]) == plain.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def stages(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs, seen = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        seen[name] = docs.collect()
    return seen


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows: defined results, and no crash."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, text + " here", None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", "a", 5), (3, text, "en", "a", 5), (4, text, None, "b", None), (None, None, None, None, None)]
    seen = stages(spark, tmp_path, rows, [(1, 1, 0), (None, 1, 1), (3, None, None)])
    assert len(seen["toxicity"]) == 7
    # rows without an id stay, repeated rows of the first id stay together
    assert sorted((r["doc_id"] for r in seen["near_duplicates"]), key=str) == sorted([None, 1, 2, 3, 3, None], key=str)
    assert all(r["text"] is None for r in seen["personal_data"] if r["doc_id"] == 1)
    assert all(r["text"] for r in seen["mixing"]) and seen["mixing"]
    assert len(seen["tokens"]) == len(seen["mixing"]) and all(r["n_tokens"] > 0 for r in seen["tokens"])


def test_stages_on_empty_tables(spark, tmp_path):
    assert all(not rows for rows in stages(spark, tmp_path, [], []).values())
