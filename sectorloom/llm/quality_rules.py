"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

# fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "on", "it", "as", "was", "at", "by", "this", "are", "from", "or", "an",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "den", "zu", "im", "auf", "für", "dem", "des", "sich", "auch", "als", "wie",
    "le", "la", "les", "de", "des", "et", "est", "que", "qui", "un", "une", "pour", "dans", "par", "sur", "pas", "du", "au", "avec", "ce", "en", "il",
    "el", "los", "las", "y", "que", "una", "no", "se", "del", "al", "con", "por", "su", "para", "como", "más", "pero", "lo", "es",
)


@dataclass(frozen=True)
class Threshold:
    """A measured ratio and the least and most that pass; None: no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The method's own rules; the base rules stand in base_failed.
RULES = (
    Threshold("mean_word_length", 2, 20),
    Threshold("symbol_ratio", None, 0.25),
    Threshold("stop_words", 1, None),
    Threshold("dup_line_ratio", None, 0.5),
    Threshold("ellipsis_line_ratio", None, 0.5),
    Threshold("bullet_line_ratio", None, 0.95),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def measures() -> dict[str, Column]:
    """The ratios that a threshold can name."""
    return {
        "mean_word_length": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_words": F.col("n_stop_words").cast("double"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": _ratio("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": _ratio("n_bullet_lines", "n_lines"),
    }


def verdict(rules: tuple[Threshold, ...] = RULES) -> Column:
    """All rules in one expression: true if every measure lies within its bounds."""
    out, known = F.lit(True), measures()
    for r in rules:
        m = known[r.measure]
        if r.least is not None:
            out = out & (m >= F.lit(float(r.least)))
        if r.most is not None:
            out = out & (m <= F.lit(float(r.most)))
    return out


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the sorted (hash, position) of all windows."""
    n = F.size(windows)
    twice = F.filter(
        F.transform(windows, lambda w, i: F.struct(((F.get(windows, i - 1)["h"] == w["h"]) | (F.get(windows, i + 1)["h"] == w["h"])).alias("twice"), w["i"].alias("i"))),
        lambda w: F.coalesce(w["twice"], F.lit(False)),
    )
    at = F.sort_array(F.transform(twice, lambda w: w["i"]))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    folded = F.aggregate(at, start, lambda a, i: F.struct((a["total"] + i + WINDOW - F.greatest(a["end"], i)).alias("total"), (i + WINDOW).alias("end")))
    return F.when(n > 0, folded["total"]).otherwise(F.lit(0).cast("long"))


def quality(docs: DataFrame, rules: tuple[Threshold, ...] = RULES) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and further counts.

    A null text counts as empty: no words, hence base_failed. A null doc_id and repeated rows are kept,
    a row for each row. Other columns aren't read. An empty table gives an empty result.
    """
    # each select's arrays are used several times above it, so that they stay apart and are made once
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = own.select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•·]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)]))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    counts = [c for c in hashed.columns if c != "hashes"]
    last = F.size("hashes") - WINDOW
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    windows = hashed.select(*counts, grams.alias("grams"))
    several = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.when(several, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("h"), i.cast("long").alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>"))
    windows = windows.select(*counts, pairs.alias("windows"))
    measured = windows.select(*counts, _covered(F.col("windows")).alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in first])
