"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two words is the sum over their common subsequences of three characters, each occurrence
weighted by DECAY to the power of the stretch it spans, stretches of SPAN characters at most, over the
norms that words of their lengths with no repeats have. Gapped and inserted-character forms of an insult
thus stay near it. A document is a bag of words and scores as its worst word does: in each round of
training, a toxic document is represented by the words that score highest, a clean one by its own
highest (the hard negatives) and others.

Landmarks are words of the training sample; K_mm^(-1/2) k_m(x) are a word's features. As the decision is
linear in the kernel's explicit features, all landmarks collapse into one table of weights by character
triple, and scoring a word costs one look-up for each of its triples.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorloom.llm.common import bounded_batches, release

DECAY = 0.7
SPAN = 8
#: Longer words are read in overlapping pieces of this length.
LONGEST = 24
LANDMARKS = 160
#: Labelled documents of each class that training reads at most, those with the smallest hashes of their id.
SAMPLE = 1500
#: Weight in training of a word like no landmark; all other words weigh 1 together.
UNLIKE = 0.1
#: Words whose scores a task remembers at once.
REMEMBERED = 100_000
EDGES = ".,;:!?\"'()[]{}<>%*$&#|-_~…«»“”„"

# ---------------------------------------------------------------- characters and words

_codes = np.array([27 + i % 19 for i in range(0x250)], np.uint8)
_codes[0] = 0
_codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
_codes[ord("A") : ord("Z") + 1] = np.arange(1, 27)
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        _codes[_c] = 46 + _c % 8
for _c in range(10):
    _codes[ord("0") + _c] = 54 + _c
for _digit, _letter in zip("013457", "oieast", strict=True):  # digits written for letters
    _codes[ord(_digit)] = _codes[ord(_letter)]


def words_of(text: str) -> set[str]:
    """Distinct words by white space, lower case; three or more single characters in a row also as one word."""
    parts = text.lower().split()
    out = set(parts)
    run: list[str] = []
    if sum(map(len, parts)) < 3 * len(parts) or any(len(w) == 1 for w in out):
        for w in [*parts, ".."]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) >= 3:
                    out.add("".join(run))
                run = []
    return out


def _pieces(word: str) -> list[str]:
    """The word, and without the marks put between its letters if there are any; in overlapping pieces if it is long."""
    word = word.strip(EDGES)
    forms = [word] if word.isalnum() else [word, "".join(filter(str.isalnum, word))]
    return [p for w in forms for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)])]


def _matrix(words: list[str]) -> np.ndarray:
    """Codes by row, zero beyond a word's end."""
    width = max(map(len, words))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
    return np.where(flat < len(_codes), _codes[np.minimum(flat, len(_codes) - 1)], 27 + flat % 19).astype(np.int32)


def _offsets(width: int) -> list[tuple[int, int, float]]:
    return [(a, a + b, DECAY ** (a + b + 1)) for a in range(1, SPAN) for b in range(1, SPAN - a) if a + b < width]


_norms = np.ones(LONGEST + 1)
for _n in range(3, LONGEST + 1):
    _norms[_n] = math.sqrt(sum((_n - b) * w * w for a, b, w in _offsets(_n)))


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Each stretch's triples as numbers, 0 where one reaches beyond the word, with the stretch's weight."""
    width = codes.shape[1]
    for a, b, w in _offsets(width):
        x, y, z = codes[:, : width - b], codes[:, a : width - b + a], codes[:, b:]
        yield np.where(z > 0, (x << 12) | (y << 6) | z, 0), w


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of like lengths, in parts."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    bound = np.searchsorted(np.array([6, 9, 12, 16, LONGEST]), size)
    for k in range(5):
        at = np.flatnonzero(bound == k)
        for i in range(0, len(at), 20_000):
            yield at[i : i + 20_000]


def weighted(words: list[str], table: np.ndarray) -> np.ndarray:
    """The sum of the table's weights over each word's triples, over the norm of its length."""
    out = np.zeros(len(words), np.float32)
    for at in _by_length(words):
        own = [words[i] for i in at]
        codes = _matrix(own)
        total = np.zeros(len(own), np.float32)
        if codes.shape[1] >= 3:
            for numbers, w in _triples(codes):
                total += np.float32(w) * table[numbers].sum(axis=1)
        out[at] = total / _norms[[len(x) for x in own]]
    return out


class Landmarks:
    """Kernel values with chosen words, and the collapse of weights on them into a table by triple."""

    def __init__(self, words: list[str]):
        self.words = words
        self.norms = _norms[[len(w) for w in words]]
        rows, numbers, values = [], [], []
        for i, w in enumerate(words):
            if len(w) >= 3:
                for found, weight in _triples(_matrix([w])):
                    rows += [i] * found.shape[1]
                    numbers += found[0].tolist()
                    values += [weight] * found.shape[1]
        self.known, at = np.unique(numbers, return_inverse=True)
        self.vectors = np.zeros((len(self.known) + 1, len(words)), np.float32)
        np.add.at(self.vectors, (at, rows), values)
        self.vectors[:-1] /= self.norms
        self.index = np.full(64**3, len(self.known), np.int32)
        self.index[self.known] = np.arange(len(self.known))
        self.index[0] = len(self.known)

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for part in _by_length(words):
            for i in range(0, len(part), 2000):
                at = part[i : i + 2000]
                own = [words[k] for k in at]
                codes = _matrix(own)
                total = np.zeros((len(own), len(self.words)), np.float32)
                if codes.shape[1] >= 3:
                    for numbers, w in _triples(codes):
                        hit = self.index[numbers]
                        r, c = np.nonzero(hit < len(self.known))
                        np.add.at(total, r, np.float32(w) * self.vectors[hit[r, c]])
                out[at] = total / _norms[[len(x) for x in own]][:, None]
        return out

    def table(self, beta: np.ndarray) -> np.ndarray:
        out = np.zeros(64**3, np.float32)
        out[self.known] = self.vectors[:-1] @ beta
        out[0] = 0
        return out


# ---------------------------------------------------------------- training

def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by accelerated gradient descent; y is +1 or -1."""
    x1 = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    weight = weight / weight.sum()
    keep = np.append(np.full(x.shape[1], ridge), 0.0)
    rate = 1 / (2 * np.linalg.norm((x1 * weight[:, None]).T @ x1, 2) + ridge)
    w, v, t = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), 1.0
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x1 @ v))
        new = v - rate * (keep * v - 2 * x1.T @ (weight * y * short))
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / nxt * (new - w), new, nxt
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Word weights by triple and a bias; slope and shift turn a document's worst word into a probability."""

    table: np.ndarray | None
    bias: float
    slope: float
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        """The decision value of each word, of its worst piece if it is long."""
        pieces, of = [], []
        for i, w in enumerate(words):
            for p in _pieces(w):
                pieces.append(p)
                of.append(i)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, of, weighted(pieces, self.table) + self.bias)
        return out

    def worst(self, bags: Iterable[Iterable[str]], known: dict[str, float]) -> np.ndarray:
        """The decision value of each document's worst word; of no words, that of a word like no landmark."""
        return np.array([max(map(known.__getitem__, b), default=self.bias) for b in bags])

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def _gapped(word: str) -> list[str]:
    """Forms with characters put between, left out or doubled."""
    return [".".join(word), "-".join(word), "_".join(word), word[0] + "*" + word[2:], word[: len(word) // 2] + "." + word[len(word) // 2 :], word[:2] + word[1] + word[2:], word[:-1] + word[-1] * 3]


def _platt(worst: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets, classes weighted to the given share."""
    pos, neg = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, share / pos, (1 - share) / neg)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
        r, c = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * worst).sum() + 1e-4 * a, r.sum()])
        h = np.array([[(c * worst * worst).sum() + 1e-4, (c * worst).sum()], [(c * worst).sum(), c.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(a, 1e-3), b


def train(texts: list[str], toxic: list[int], share: float, rounds: int = 3, seed: int = 7) -> Model:
    """A model from labelled texts; share: of toxic ones among all labelled, for the calibration.

    Without texts of both classes, each text scores the share.
    """
    rng = np.random.default_rng(seed)
    y = np.where(np.array(toxic, int) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(None, 0.0, 0.0, math.log(share / (1 - share)))
    bags = [sorted({p for w in words_of(t) for p in _pieces(w)}) for t in texts]
    fit = rng.random(len(bags)) < 0.75
    pos = [b for b, f, k in zip(bags, fit, y, strict=True) if f and k > 0]
    neg = [b for b, f, k in zip(bags, fit, y, strict=True) if f and k < 0]
    in_pos, in_neg = Counter(w for b in pos for w in b), Counter(w for b in neg for w in b)
    odds = {w: math.log((c + 0.5) / (len(pos) + 1)) - math.log((in_neg[w] + 0.5) / (len(neg) + 1)) for w, c in in_pos.items()}
    worth = {w: odds[w] * min(c, 20) for w, c in in_pos.items() if len(w) >= 3}
    words = sorted({*in_pos, *in_neg})
    number = {w: i for i, w in enumerate(words)}
    telling = sorted((w for w in worth if odds[w] > 1), key=lambda w: (-worth[w], w))[: LANDMARKS // 2]
    usual = [w for w, _ in sorted(in_neg.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3][: LANDMARKS // 4]
    others = [w for w in rng.permutation(sorted(in_neg)).tolist() if len(w) >= 3][: LANDMARKS - len(telling) - len(usual)]
    marks = Landmarks(list(dict.fromkeys([*telling, *usual, *others])) or ["..."])
    values, vectors = np.linalg.eigh(marks.kernel(marks.words).astype(np.float64))
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    score = np.array([worth.get(w, -1.0) for w in words])
    groups_pos, groups_neg = [np.array([number[w] for w in b]) for b in pos if b], [np.array([number[w] for w in b]) for b in neg if b]
    model = None
    for _ in range(rounds):
        witness = Counter(int(g[np.argmax(score[g])]) for g in groups_pos)
        hard = Counter(int(i) for g in groups_neg for i in g[np.argsort(-score[g])[:3]])
        spread = rng.permutation(sorted({int(i) for g in groups_neg for i in g}))[:6000]
        plus = [words[i] for i in witness]
        forms = [f for w in sorted(plus, key=lambda w: -witness[number[w]])[:80] if len(w) >= 4 for f in _gapped(w)]
        minus = [words[i] for i in hard]
        usual_minus = [words[i] for i in spread]
        own = plus + forms + minus + usual_minus
        label = np.array([1] * (len(plus) + len(forms)) + [-1] * (len(minus) + len(usual_minus)))
        weight = np.concatenate(
            [
                [0.4 * witness[number[w]] / max(1, sum(witness.values())) for w in plus],
                np.full(len(forms), 0.1 / max(1, len(forms))),
                np.full(len(minus), 0.3 / max(1, len(minus))),
                np.full(len(usual_minus), 0.2 / max(1, len(usual_minus))),
            ]
        )
        features = marks.kernel([x[:LONGEST] for x in own]) @ root
        # a word like no landmark has no features and is no insult: it holds the bias down
        w, b = svm(np.vstack([features, np.zeros(features.shape[1])]), np.append(label, -1), np.append(weight, UNLIKE))
        model = Model(marks.table(root @ w), b, 1.0, 0.0)
        score = model.words(words)
    rest = [i for i in range(len(bags)) if not fit[i]] or list(range(len(bags)))
    held = sorted({w for i in rest for w in bags[i]})
    worst = model.worst((bags[i] for i in rest), dict(zip(held, model.words(held).tolist(), strict=True)))
    model.slope, model.shift = _platt(worst, y[rest], min(max(share, 1e-4), 1 - 1e-4))
    return model


# ---------------------------------------------------------------- on tables

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, toxic) on docs, without held-out ids; ``sample`` documents of each class at most.

    Rows with a null id or label are ignored; of repeated labels of an id, the highest counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64(F.lit(11), "doc_id")
    parts = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    rows = sorted(chosen.collect())
    return train([r["text"] or "" for r in rows], [r["toxic"] for r in rows], share)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> all columns and ``toxicity`` double in 0 to 1.

    Only the text is read; whole texts. A null or wordless text scores as one without any insult. A
    column named toxicity is replaced. Repeated rows score alike. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for texts in batches:
            if model.table is None:
                yield pa.array(np.broadcast_to(model.probability(np.zeros(1)), len(texts)))
                continue
            bags = [words_of(t or "") for t in texts.to_pylist()]
            new = list(set().union(*bags) - known.keys())
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set().union(*bags))
            if new:
                known.update(zip(new, model.words(new).tolist(), strict=True))
            yield pa.array(model.probability(model.worst(bags, known)))
        known.clear()
        release()

    return docs.drop("toxicity").withColumn("toxicity", F.arrow_udf(run, "double")(F.coalesce(F.col("text").cast("string"), F.lit(""))))
