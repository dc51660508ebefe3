"""The text operators against brute force and on hard rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sectorloom.llm import byte_bpe, common, embedding_dedup, html_text, jaccard_join, licenses, mixing, pii, quality_rules, sharding, toxicity
from sectorloom.llm.common import Scratch, word_hashes
from sectorloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n: int) -> str:
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "été", "zu", "the", "of"]) + str(rng.randrange(60)) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", "one two three four five"]
    passage = prose(rng, 60)
    for _ in range(25):
        text = prose(rng, rng.randrange(8, 120))
        texts.append(text)
        words = text.split(" ")
        for _ in range(rng.randrange(3)):  # near copies on both sides of the threshold
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    texts += [prose(rng, 15) + " " + passage + " " + prose(rng, 15) for _ in range(14)]
    texts += [texts[10]] * 12 + [prose(rng, 4000)]
    return [(i if i % 11 else None if i == 33 else i, t, "en", [None, "a", "b", "c"][i % 4], 0) for i, t in enumerate(texts)]


def make(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[find(a)] = find(b)
    least = collections.defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    return {i: least[find(k)] for k, (i, _) in enumerate(sets)}


@pytest.mark.parametrize(("small", "parts"), [(True, 3), (False, 3), (False, 40)])
def test_jaccard_components(spark, monkeypatch, small, parts):
    if small:  # all sizes small, so that tiles, hot groups and stars all take part
        for name, value in (("SMALL", 2), ("TILE", 3), ("HOT", 5), ("STAR", 2), ("SPLIT", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus()
    got = jaccard_join.jaccard_components(make(spark, rows).repartition(parts)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    sizes = collections.Counter((i, len(shingles(t))) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes


def test_jaccard_keeps_first(spark):
    rows = corpus()
    kept = {r["doc_id"] for r in jaccard_join.keep_first(make(spark, rows)).collect()}
    want = brute_components(rows)
    assert {k for k in kept if k is not None} == {i for i, c in want.items() if i == c}
    assert not jaccard_join.jaccard_components(make(spark, [])).collect()


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = np.unique(rng.integers(-(1 << 60), 1 << 60, 900))
        x, y = np.sort(rng.choice(pool, 300, False)), np.sort(rng.choice(pool, rng.integers(250, 400), False))
        a, b = jaccard_join.bitmap(x), jaccard_join.bitmap(y)
        w = min(len(a), len(b))
        apart = int(np.bitwise_count(jaccard_join.folded(jaccard_join._rows([a]), w) ^ jaccard_join.folded(jaccard_join._rows([b]), w)).sum())
        assert (len(x) + len(y) - apart) // 2 >= len(np.intersect1d(x, y)) == jaccard_join._overlap(x, y)
        widths = jaccard_join._Widths(pa.array([a, b, a], pa.binary()))
        assert widths.apart(0, np.array([1, 2])).tolist() == [apart, 0] and widths.apart(1, np.array([0])).tolist() == [apart]
    assert len(jaccard_join.bitmap(np.arange(1 << 18))) == jaccard_join.WIDEST // 8


def test_repeated_tokens_are_counted():
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()))], names=["tokens"]) for x in ([[1, 2], [2, 3]], [[2], [], [4, 1]])]
    got = [(r["token"], r["n"]) for b in jaccard_join._repeated(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, 2), (2, 3), (None, 7)]


def test_what_is_left_goes(spark, monkeypatch):
    left = []
    monkeypatch.setattr(common, "_left", left)
    kept = Scratch(spark).keep(spark.range(5))
    encoded = byte_bpe.bpe_encode(make(spark, [(1, "one two", "en", "a", 0)]))
    assert kept.count() == 5 and encoded.first()["doc_id"] == 1 and len(left) == 2
    tables = {t for _, _, t in left if t}
    common.clean()
    assert not left and not tables & {t.name for t in spark.catalog.listTables()}
    with pytest.raises(Exception):
        kept.count()


def test_word_hashes():
    def morse(n, bit):
        return "".join("ab"[(bin(i).count("1") + bit) % 2] for i in range(n))

    words = [morse(1024, 0), morse(1024, 1), *(w * k for w in ("a", "b", "ab", "\0") for k in (1, 2, 7, 8, 9, 16, 31, 32, 33, 40)), "abcdefgh" "12345678", "12345678" "abcdefgh"]
    data = np.frombuffer("  ".join(words).encode(), np.uint8)
    start, end, h = word_hashes(data)
    assert [bytes(data[i:j]).decode() for i, j in zip(start, end, strict=True)] == words
    assert len(set(h.tolist())) == len(set(words))
    again = word_hashes(np.frombuffer(" ".join(reversed(words)).upper().encode(), np.uint8))[2]
    assert again.tolist() == h.tolist()[::-1]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, limit):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(7, None), (3, 3)] + [(200, i) for i in range(201, 230)]
    root = {k: k for e in edges for k in e if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    linked = {k for e in edges if None not in e and e[0] != e[1] for k in e}
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), in_one_task=limit).collect()
    assert {r["node"]: r["component"] for r in got} == {k: find(k) for k in linked}
    assert not components(spark.createDataFrame([], "a long, b long"), Scratch(spark), in_one_task=limit).collect()


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 40)
    rng = random.Random(5)
    letters = "aZé ß½²'s\n\t\r\x1c\x85\xa0_-!٣漢字😀ǅɐ\0 3"
    rows = corpus() + [(1000 + i, "".join(rng.choices(letters, k=rng.randrange(60))), "x", "y", 0) for i in range(150)]
    rows.append((5000, "x" * 20_000 + " " * 3000, "", "", 0))
    got = byte_bpe.bpe_decode(byte_bpe.bpe_encode(make(spark, rows))).collect()
    plain = byte_bpe.encoding(byte_bpe.VOCABULARY)
    want = collections.Counter((i, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert not byte_bpe.bpe_encode(make(spark, [])).collect()


def test_html():
    assert html_text.render("") == ""
    assert html_text.render("a<b") == "a<b"
    assert html_text.render("<p>one<p>two<br>three<script>no</p></script>") == "one\n\ntwo\nthree"
    assert html_text.render("<ul><li>a<li>b<ol start=4><li>c<li>d</ol></ul>") == "- a\n- b\n  4. c\n  5. d"
    assert html_text.render("<style>.x{display:none}</style><div class='y x'>no</div><p hidden>no</p>yes<!-- no -->") == "yes"
    assert html_text.render("<table><tr><th>n<th>long<tr><td>wider<td>2<tr><td colspan=2>across</table>z") == "n      long\nwider  2\nacross\n\nz"
    assert html_text.render("<pre> a\n  b</pre>") == "a\n  b" or html_text.render("<pre> a\n  b</pre>") == " a\n  b"
    assert html_text.render("<div>" * 5000 + "deep") == "deep"
    assert html_text.render("&lt;b&gt; &eacute;") == "<b> é"


def test_html_style_rules():
    def shown(css, attrs="class=x", lead=""):
        return html_text.render(f"{lead}<style>{css}</style><div {attrs}>in</div>out") == "in\nout"

    seen = ["@media print{.x{display:none}}", "@media screen and (max-width:9em){.x{display:none}}", "@supports (display:grid){.x{display:none}}", "/* .x{display:none} */", ".x{display:none}.x{display:block}"]
    seen += [".x{display:none} div.x{display:block}", ".x{/*}*/color:red} @media print{a{b:c} .x{display:none}}", "@import 'a{b';@media print{.x{display:none}}", ".x{display:none!important}.x{display:flex!important}", ".y .x{display:none}", ".x{--display:none}"]
    for css in seen:
        assert shown(css), css
    unseen = [".x{display:none}", "@media screen{.x{display:none}}", "@media print, all{.x{color:red;display:none}}", "@media screen{@media only screen{.x{display:none}}}", ".x{display:block}.x{display:none}", ".x{display:none}div{display:block}", ".x{display:none!important}.x{display:block}", "@media print{.x{display:block}} .x{display : NONE", ".x{display:none; &:hover{color:red}}", "/*{*/.x{content:'}';display:none}", "@charset 'u';.x{display:none}", "<!-- .x{display:none} -->"]
    for css in unseen:
        assert not shown(css), css
    assert shown(".x{display:none}", "class=x style='display:block'") and not shown(".x{display:none!important}", "class=x style='display:block'")
    assert shown(".x{display:none} #i{display:block}", "class=x id=i") and not shown("", "style='color:red; display:none'")
    assert shown("", "class=x", "<style media=print>.x{display:none}</style>") and shown("", "class=x", "<noscript><style>.x{display:none}</style></noscript>")


def brute_table(rows):
    """Cells (text, columns, rows) on a grid, each column's begin counted up from the widths; for texts of one line."""
    grid, cells = set(), []
    for i, row in enumerate(rows):
        for text, span, height in row:
            j = next(j for j in itertools.count() if (i, j) not in grid and all((i, k) not in grid or k < j for k in range(j + 1)) and (i, j) not in grid and j >= max((c + s for r, c, _, s in cells if r == i), default=0))
            cells.append((i, j, text, span))
            grid |= {(r, c) for r in range(i, i + height) for c in range(j, j + span)}
    widths = {j: max([len(t) for _, c, t, s in cells if c == j and s == 1], default=0) for _, j, _, _ in cells}
    begin = {j: sum(w + 2 for k, w in widths.items() if k < j) for j in widths}
    out = []
    for i in range(len(rows)):
        line = ""
        for r, j, text, _ in cells:
            if r == i and text:
                line = line + " " * max(begin[j] - len(line), 2 if line else 0) + text
        out.append(line)
    return "\n".join(out).strip("\n")


def test_tables_against_a_grid():
    rng = random.Random(31)
    assert html_text.render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert html_text.render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    for _ in range(200):
        rows = [[("x" * rng.randrange(1, 9), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 6))]
        source = "<table>" + "".join("<tr>" + "".join(f"<td colspan={s} rowspan={h}>{t}</td>" for t, s, h in row) + "</tr>" for row in rows) + "</table>"
        assert html_text.render(source) == brute_table(rows), source


def test_wide_tables_stay_near_their_text():
    wide = "w" * 20_000
    source = "<table>" + f"<tr><td>{wide}<td>x" + "<tr><td>a<td>b" * 3000 + "</table>"
    text = html_text.render(source)
    assert len(text) < 2 * len(source) * 5 and text.count("a" + " " * 81 + "b") == 3000 and wide + "  x" in text
    steps = "<table>" + "".join(f"<tr><td colspan={i + 1}>{'y' * 80}<td>z" for i in range(900)) + "</table>"
    assert len(html_text.render(steps)) < 900 * 600


def test_html_on_tables(spark):
    rows = [(1, "<p>a", "old"), (2, None, "old"), (None, "", "old"), (1, "<p>a", "old")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got if r["text"] is not None) == [(0, ""), (1, "a"), (1, "a")]


def test_licenses(spark):
    noise = "the quick words of a text about nothing at all. " * 40
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            (row,) = licenses.scan(licenses.pa.array([noise + "\n" + t + "\n" + noise]))
            assert row["families"] == [family], t
    rows = [(1, None), (2, ""), (3, "\n".join(licenses.NEAR_MISSES)), (4, noise + licenses.TEMPLATES["MIT"][0] + noise), (4, "MIT Licensed under the"), (5, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows[:4] + rows[5:], "doc_id long, text string")).collect()}
    assert [got[i]["families"] for i in (1, 2, 3, 4, 5)] == [[], [], [], ["MIT"], ["CC-BY-NC"]]
    assert got[1]["score"] is None and got[5]["score"] > 0.5


def test_wrapped_licenses():
    noise = "the quick words of a text about nothing at all. " * 40
    wrap = lambda text, width, lead: "\n".join(lead + line for line in textwrap.wrap(text, width))
    cases = [(f, t, width, lead, among) for f, ts in licenses.TEMPLATES.items() for t in ts for width in (30, 60, 78) for lead in ("", " * ", "# ", "REM ") for among in (False, True)]
    texts = [wrap(t, width, lead) if not among else "\n".join([wrap(noise, width, lead), wrap(t, width, lead), wrap(noise, width, lead)]) for _, t, width, lead, among in cases]
    for case, row in zip(cases, licenses.scan(licenses.pa.array(texts)), strict=True):
        assert (row["families"], row["n_paragraphs"]) == ([case[0]], 1), case
    grant, keep = licenses.TEMPLATES["MIT"][2:]
    whole = "MIT License\r\n\r\nCopyright (c) 2020 Jane\r\n\r\n" + wrap(grant, 78, "").replace("\n", "\r\n") + "\r\n\r\n" + wrap(keep, 78, "").replace("\n", "\r\n")
    rows = licenses.scan(licenses.pa.array([whole, "Licensed under CC BY 4.0.\nReleased under the ISC License.", " *\n".join(licenses.NEAR_MISSES), wrap(grant, 40, "").replace("\n", "\r")]))
    assert [(r["families"], r["n_paragraphs"]) for r in rows] == [(["MIT"], 2), (["CC-BY", "ISC"], 2), ([], 0), (["MIT"], 1)]


def test_sharding(spark):
    rows = corpus() + [(3, "again", "en", "a", 0)]
    docs = make(spark, rows).withColumn("slot", F.lit("clash"))
    got = sharding.shard_documents(docs, shards=5, bucket_bytes=2000).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    again = sharding.shard_documents(docs, shards=5, bucket_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert not sharding.shard_documents(make(spark, []), shards=5).collect()


def test_shard_files(spark, tmp_path):
    sharded = sharding.shard_documents(make(spark, corpus()), shards=3)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(corpus())


def test_fisher_yates():
    assert sorted(sharding.fisher_yates(50, 3)) == list(range(50))
    firsts = collections.Counter(int(sharding.fisher_yates(4, s)[0]) for s in range(4000))
    assert all(850 < n < 1150 for n in firsts.values())
    assert list(sharding.fisher_yates(0, 1)) == []


@pytest.fixture(scope="module")
def insults():
    """A model of a small corpus, with texts and labels it hasn't seen."""
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice(["thing", "under", "other", "ration", "likely", "onward"]) + rng.choice(["", "s", "er", "ly"]) for _ in range(60))
    texts, labels = [], []
    for i in range(240):
        t = clean().split()
        if i % 4 == 0:
            t[rng.randrange(60)] = rng.choice(["stupid", "idiot", "scumbag", "worthless"])
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    return toxicity.train(texts[:180], labels[:180], 0.25), texts[180:], labels[180:]


def toxicities(spark, model, texts):
    got = toxicity.score_toxicity(make(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)]), model)
    return [r["toxicity"] for r in got.orderBy("doc_id").collect()]


def test_toxicity(spark, insults):
    model, texts, labels = insults
    clean = texts[1]
    held = [(s >= 0.3) != bool(k) for s, k in zip(toxicities(spark, model, texts), labels, strict=True)]
    assert sum(held) <= 2
    assert all(s >= 0.3 for s in toxicities(spark, model, [f"{clean} {w}" for w in ("i d i o t", "stuppid", "i-d-i-o-t", "st*upid", "Idi0t!", "s_t_u_p_i_d")]))
    assert all(s < 0.3 for s in toxicities(spark, model, [clean, None, "", " \n ", "12 34", "a to of", "\u0447\u0442\u043e", "\u4f60\u597d", clean * 300]))
    only = toxicity.train(["a"], [0], 0.0)
    assert only.table is None and 0 <= only.probability(np.zeros(1))[0] < 0.01


def test_toxicity_of_a_document_is_that_of_its_worst_word(spark, insults):
    model, texts, _ = insults
    texts = [*texts[:12], "", None, "an idiot's st-u-pid, worthlessssss" + "x" * 40 + " " + texts[0]]
    alone = [[float(model.words([w])[0]) for w in toxicity.words_of(t or "")] for t in texts]
    brute = [1 / (1 + math.exp(-(model.slope * max(a, default=model.bias) + model.shift))) for a in alone]
    assert np.allclose(toxicities(spark, model, texts), brute, atol=1e-6)


def test_toxicity_on_an_empty_table_and_clashing_names(spark, insults):
    assert toxicities(spark, insults[0], []) == []
    docs = spark.createDataFrame([(1, "stupid idiot", "mine", 5)], "doc_id long, text string, toxicity string, known int")
    (row,) = toxicity.score_toxicity(docs, insults[0]).collect()
    assert row["toxicity"] > 0.3 and row["known"] == 5


def test_kernel_matches_its_definition():
    def brute(s, t):
        def phi(w):
            out = collections.Counter()
            for i, j, k in itertools.combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        a, b = phi(s), phi(t)
        return sum(v * b[u] for u, v in a.items()) / (toxicity._norms[len(s)] * toxicity._norms[len(t)])

    words = ["idiot", "idxiot", "banana", "abracadabra", "the", "to"]
    k = toxicity.Landmarks(words).kernel(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(k[i, j] - brute(a, b)) < 1e-4


def test_toxicity_on_tables(spark):
    docs = make(spark, corpus())
    empty = toxicity.fit_toxicity(docs, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, empty).collect()
    assert len(got) == docs.count() and all(0 <= r["toxicity"] <= 1 for r in got)
    ids = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in ids.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect())


@pytest.mark.parametrize("sizes", [{"a": 5000, "b": 100, "c": 900, None: 40}, {"a": 10, "b": 10, "c": 10}, {"a": 7}])
def test_mixing(spark, sizes):
    rng, rows = random.Random(9), [(1, None, "a", 0), (1, "", "a", 0)]
    for source, total in sizes.items():
        left = total
        while left > 0:
            n = min(left, rng.randrange(1, 60))
            rows.append((len(rows), " ".join(["w"] * n), source, 0))
            left -= n
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix long")
    mixed = mixing.mix_sources(docs, shards=4)
    got = mixed.select("doc_id", "source", "text", "mix.*").collect()
    assert len(got) == len(rows)
    total, weight = sum(sizes.values()), {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    capped: dict = {}
    while True:
        rest = [s for s in sizes if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        want = capped.get(s) if s in capped else left * weight[s] / w
        assert all(abs(r["target"] - want) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - want) <= 0.5 + 1e-6
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["parts"]) for r in got)
    places = collections.Counter((r["source"], p["block"], p["pass"], p["rank"]) for r in got for p in r["parts"])
    assert not places or max(places.values()) == 1
    again = mixing.mix_sources(docs, shards=4).select("doc_id", "source", "text", "mix.*").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_splitting_tree(spark):
    quotas = {1: 5, 2: 1, 3: 40, 4: 0}
    tops = collections.Counter()
    for seed in range(12):
        got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source_id long, blocks long"), 3, seed, Scratch(spark)).collect()
        by_source, by_shard = collections.Counter(), collections.Counter()
        for r in got:
            by_source[r["source_id"]] += r["blocks"]
            by_shard[r["shard"]] += r["blocks"]
        assert dict(by_source) == {k: v for k, v in quotas.items() if v}
        assert max(by_shard.values()) - min(by_shard.values()) <= 1
        tops[next(r["shard"] for r in got if r["source_id"] == 2)] += 1
    assert len(tops) > 1


def test_mixing_orders_whole_shards(spark):
    docs = make(spark, [(i, "w " * (1 + i % 7), "en", "abc"[i % 3], 0) for i in range(1500)])
    rows = mixing.shard_rows(docs, shards=3).withColumn("partition", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in mixing.mixed_rows(docs, shards=3).collect())
    orders, changes, at_random = [], 0, 0.0
    for shard in range(3):
        own = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["at"])
        assert len({r["partition"] for r in own}) == 1 and [r["place"] for r in own] == sorted(r["place"] for r in own)
        sources = [r["source"] for r in own]
        changes += sum(a != b for a, b in itertools.pairwise(sources))
        at_random += len(own) - sum(n * n for n in collections.Counter(sources).values()) / len(own)
        orders.append([r["place"] for r in own])
    assert len({tuple(o[:5]) for o in orders}) == 3
    # sources change about as often as in a random order, rather than standing in runs
    assert changes >= 0.9 * at_random


def brute_pii(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = {}
    for kind, rule in rules.items():
        out[kind] = []
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out[kind].append(m.span())
    return out


def test_pii_base():
    rng = random.Random(10)
    for _ in range(4000):
        text = "".join(rng.choices("a1@.+- ()42_%é5", k=rng.randrange(45)))
        assert pii.base_spans(text) == brute_pii(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == {k: [] for k in pii.KINDS}
    assert pii.base_spans("4111 1111-1111 1111")["card"] == [(0, 19)]


def test_pii_transducers():
    def found(text):
        base, every = pii.all_spans(text)
        assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)
        return [(k, text[a:b]) for k in pii.KINDS for a, b in every[k]]

    assert found("mail jоhn.doe@exаmple.com now")[-1] == ("email", "jоhn.doe@exаmple.com") or ("email", "jоhn.doe@exаmple.com") in found("mail jоhn.doe@exаmple.com now")
    assert ("email", "jane.doe [at] site [dot] org") in found("to jane.doe [at] site [dot] org.")
    assert ("ip", "192 dot 168 dot 1 dot 20") in found("at 192 dot 168 dot 1 dot 20 it")
    assert ("card", "４１１１ １１１１ １１１１ １１１１") in found("no ４１１１ １１１１ １１１１ １１１１")
    assert ("phone", "plus one five five five two three four five six seven") in found("plus one five five five two three four five six seven")
    for clean in ("she sat at the table, dot by dot", "one two three", "Größe at 5 dots", "meet at noon"):
        assert found(clean) == []


def test_pii_disguises_alone():
    cases = [("email", f"jane@firma {a}{w}{b} de") for w in ("dot", "punkt", "point", "punto") for a, b in ("[]", "()", "{}", "<>")]
    cases += [("email", f"juan {a}{w}{b} correo.es") for w in ("at", "arroba") for a, b in ("[]", "()", "{}", "<>")]
    cases += [("email", t) for t in ("juan (arroba) correo (punto) es", "jane.doe at example.com", "jane at site [dot] org", "jane at site dot org", "jane at site.co dot uk", "jane@site dot org")]
    cases += [("ip", t) for t in ("192 dot 168 dot 1 dot 20", "one nine two dot one six eight dot zero dot one", "one nine two [dot] 168 [dot] one [dot] one", "one zero dot 1 dot 1 dot oh")]
    cases += [("phone", "plus" + " one" * 10), ("phone", "plus one.five five five.one two three.four five six seven")]
    for kind, text in cases:
        assert (0, len(text)) in pii.all_spans(text)[1][kind], text
    for clean in ("meet at 10.30", "look at it. one. two. three. four.", "one two three four dot five dot six dot seven", "one dot two dot three"):
        assert not any(pii.all_spans(clean)[1].values()), clean
    pii.all_spans("one " * 20_000 + "one dot " * 20_000 + "a at b." * 20_000)


SPOKEN = {"en": ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"], "de": ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"], "fr": ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"], "es": ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"]}


def test_sharding_with_reserved_names(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i, i, i) for i in range(50)], "doc_id long, text string, __bucket long, __begin long, __record long")
    got = sharding.shard_documents(docs, shards=3).collect()
    assert sorted((r["doc_id"], r["__bucket"], r["__begin"], r["__record"]) for r in got) == [(i, i, i, i) for i in range(50)]
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, k) for s, n in collections.Counter(r["shard"] for r in got).items() for k in range(n))


def test_disguised_identifiers_are_recalled():
    """Identifiers disguised at random in four languages: all are found where they stand, and nothing in the prose around."""
    rng = random.Random(17)
    words = {"en": ("at", "dot"), "de": ("at", "punkt"), "fr": ("arobase", "point"), "es": ("arroba", "punto")}
    found = total = 0
    for _ in range(400):
        lang = rng.choice(list(SPOKEN))
        at, dot = words[lang]
        name, site, end = (rng.choice(x) for x in (("jane.doe", "max", "j_roe"), ("firma", "site-1", "mail"), ("com", "de", "org")))
        kind, hidden = rng.choice([("email", f"{name} {at} {site} {dot} {end}"), ("email", f"{name} [{at}] {site} ({dot}) {end}"), ("email", f"{name}@{site} {dot} {end}"), ("phone", "plus " + " ".join(rng.choice(SPOKEN[lang]) for _ in range(11))), ("ip", f" {dot} ".join(str(rng.randrange(256)) for _ in range(4))), ("email", f"{name}@{site}.{end}".replace("o", "\u043e").replace("a", "\u0430"))])
        text = f"Lorem ipsum: {hidden}; dolor."
        assert not any(pii.all_spans(text.replace(hidden, "sit amet"))[1].values())
        total += 1
        found += (13, 13 + len(hidden)) in pii.all_spans(text)[1][kind]
    assert found == total


def test_pii_on_tables(spark):
    rows = [(1, None), (2, ""), (3, "x a@b.co y"), (3, "x a@b.co y"), (None, "1.2.3.4")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, pii string, n_chars int")
    got = pii.find_pii(docs).select("doc_id", "pii.*").collect()
    assert collections.Counter((r["doc_id"], r["spans"]) for r in got) == {(1, ""): 1, (2, ""): 1, (3, "email:2:8"): 2, (None, "ip:0:7"): 1}
    clean = {(r["doc_id"], r["text"], r["n_chars"]) for r in pii.redact(docs).collect()}
    assert clean == {(1, None, None), (2, "", 0), (3, "x <EMAIL> y", 11), (None, "<IP>", 4)}


def test_quality(spark):
    rng = random.Random(12)
    rows = corpus() + [(900 + i, " ".join(rng.choices(["a", "b", "c#"], k=rng.randrange(40))).replace("c# a", "c#\na"), "", "", 0) for i in range(60)]
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality(make(spark, rows)).collect()}
    want = set()
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, cover = collections.Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                cover |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    assert got == want
    plan = quality_rules.quality(make(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("tile", [3, 2048])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(13)
    base = rng.normal(size=(25, 32))
    x = [b for b in base] + [b + rng.normal(size=32) * s for b in base[:12] for s in (0.02, 0.2, 0.3)] + [base[0]] * 6 + [base[1] * 7]
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(len(x))]
    odd = [(500, None, ""), (501, [0.0] * 32, ""), (502, [1.0, None], ""), (503, [math.nan] * 32, ""), (504, [], ""), (None, [3.0, 4.0], "")]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, kept string")).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while (new := np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])).tolist() != label.tolist():
        label = new
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.97 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert sum(got[i]["component_id"] == label[i] for i in range(len(x))) >= len(x) - 1
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (500, 501, 502, 503, 504))
    assert not embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect()


def test_lattice():
    assert len(embedding_dedup.ROOTS) == 240
    rng = np.random.default_rng(14)
    x = rng.normal(size=(400, 8)) * 2
    p = embedding_dedup.nearest_e8(x)
    assert (((x - p) ** 2).sum(axis=1) <= 1 + 1e-9).all()
    beaten = ((x[:, None] - p[:, None] - embedding_dedup.ROOTS) ** 2).sum(axis=2) < ((x - p) ** 2).sum(axis=1)[:, None] - 1e-9
    assert not beaten.any()


def test_digest_columns(spark, tmp_path):
    from sectorloom.llm.queries import QUERIES

    make(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op2_byte_bpe"](spark, str(tmp_path)).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    rows = QUERIES["op5_sharding"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus()}


@pytest.mark.parametrize("size", [32, 64, 128, 384])
def test_pairs_at_the_threshold_share_a_cell(size):
    rng = np.random.default_rng(size)
    a, b = rng.normal(size=(2, 3000, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = embedding_dedup.cells(a), embedding_dedup.cells(b)
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() > 0.99


APPLY = {
    "html": lambda d: html_text.extract_text(d.withColumnRenamed("text", "html")),
    "licenses": licenses.scan_licenses,
    "mixing": mixing.mix_sources,
    "pii": pii.find_pii,
    "quality": quality_rules.quality,
    "redact": pii.redact,
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_no_rows_and_repeated_rows(spark, name):
    assert not APPLY[name](make(spark, [])).collect()
    rows = [(None, "a b", "en", "a", 3), (1, "Mail x@y.org", None, None, None), (1, "Mail x@y.org", None, None, None), (None, None, None, None, None)]
    got = [tuple(r) for r in APPLY[name](make(spark, rows)).collect()]
    assert len(got) == 4 and max(collections.Counter(map(str, got)).values()) == 2


def test_licence_probabilities_are_calibrated():
    """On fresh corrupted templates among prose of words that no template knows: a prediction's probability is about how often it is right."""
    model, rng = licenses.train(), np.random.default_rng(99)
    prose = licenses._of_text(" ".join(f"w{i}x" for i in range(400)) + " the of and license software notice under terms this")
    right, said = [], []
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            words = licenses._of_text(t)
            for share in (0.0, 0.05, 0.1):
                kept = words[rng.random(len(words)) >= share]
                found, p = model.classify(np.concatenate([rng.choice(prose, 20), kept, rng.choice(prose, 20)]))
                if found != licenses.UNKNOWN:
                    right.append(found == family)
                    said.append(p)
    unknown = [model.classify(rng.choice(prose, rng.integers(2, 90)))[0] == licenses.UNKNOWN for _ in range(300)]
    assert len(right) > 80 and np.mean(right) > 0.97 and all(unknown)
    assert abs(np.mean(right) - np.mean(said)) < 0.1
