"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, turns homoglyphs and digit substitutions into the letters they imitate, drops
invisible characters and makes everything else a word boundary. The lexicon is learned: word
beginnings and whole words whose document frequency differs between toxic and other labelled texts
by a likelihood-ratio statistic above 2 ln(candidates), weighted by log odds. Exception phrases are
words, and pairs of words, around a term that mostly stand in texts that are not toxic; a match
inside one does not count. A text's two features are its matched weight and this weight per word;
a logistic curve over them gives the score.

Training reads at most SAMPLE texts per label (those of least id hash); the lexicon has at most
TERMS entries. Scoring reads every whole text.

Defined cases: a null or empty text scores as one without matches; labels other than 0 and 1 are
ignored, a document labelled twice counts by the larger; without usable labels the lexicon is empty
and every score is the base rate, or 0; a null id is not held out and repeated rows score alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm.slots import boxed, opened
from barframe.llm.workers import lean
from barframe.session import written

SAMPLE = 6000  # texts per label that the lexicon is learned from
CANDIDATES, TERMS, PHRASES = 100_000, 4096, 4096
TOGETHER = 10_000  # texts whose terms a task sums
PREFIXES = range(4, 9)
THRESHOLD = 0.3

# Characters that imitate Latin letters.
HOMOGLYPHS = {
    "a": "аαɑａ@", "b": "ьЬｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іιıｉⅼｌ|", "j": "јｊ",
    "k": "кκｋ", "m": "мｍ", "n": "ո ｎ".replace(" ", ""), "o": "оοσｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ$",
    "t": "тτｔ", "u": "υսｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
# 1 and | stand for i or l, so l is read as i in texts and in the lexicon alike.
DIGITS = {"l": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
INVISIBLE = "­​‌‍⁠﻿"


def fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalpha()}
    table |= {i: " " for i in (*range(0xA1, 0xBF), 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3004))}
    for letter, like in HOMOGLYPHS.items():
        table |= {ord(c): letter for c in like}
    table |= {ord(d): letter for d, letter in DIGITS.items()}
    return table | {ord(c): None for c in INVISIBLE}


TABLE = fold_table()


def fold(text: str | None) -> str:
    return " " + (text or "").lower().translate(TABLE) + " "


@dataclass
class Lexicon:
    """terms: word beginning -> weight, or "word " for a whole word; exceptions: folded phrases."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(" " + term.rstrip(" "), (weight, len(term.rstrip(" ")) + 1, term.endswith(" ")))
        if self.terms:
            found.make_automaton()
        return found


def word_at(folded: str, at: int) -> tuple[str, str, str]:
    """The word that starts at `at`, the one before and the one after it."""
    end = folded.find(" ", at)
    before = folded[max(0, at - 80):at].split()
    after = folded[end:end + 80].split()
    return folded[at:end], before[-1] if before else "", after[0] if after else ""


def features(folded: str, automaton, lexicon: Lexicon) -> tuple[float, float]:
    """The matched weight and the number of words."""
    total = 0.0
    if lexicon.terms:
        last = -1
        best: tuple[float, int] | None = None
        for end, (weight, size, whole) in automaton.iter(folded):
            start = end - size + 1
            if whole and folded[end + 1] != " ":
                continue
            if start == last and best is not None and best[1] >= size:
                continue
            if start == last and best is not None:
                total -= best[0]
            word, before, after = word_at(folded, start + 1)
            exempt = lexicon.exceptions and not lexicon.exceptions.isdisjoint((word, f"{before} {word}", f"{word} {after}"))
            last, best = start, (0.0 if exempt else weight, size)
            total += best[0]
    return total, folded.count(" ") - folded.count("  ")


def curve_inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    per = 100.0 * total / np.maximum(words, 20.0)
    return np.stack([np.ones_like(total), np.log1p(np.maximum(total, 0)), np.log1p(np.maximum(per, 0))], axis=1)


def fit_curve(total: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps on the bounded training features."""
    if not len(total):
        return (-50.0, 0.0, 0.0)
    x, beta = curve_inputs(total, words), np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _doc_terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(w + " ")
        for k in PREFIXES:
            if len(w) >= k:
                out.add(w[:k])
    return out


def _phrases(folded: str, automaton, terms: dict[str, float]) -> set[str]:
    out: set[str] = set()
    for end, (_, size, whole) in automaton.iter(folded):
        if whole and folded[end + 1] != " ":
            continue
        word, before, after = word_at(folded, end - size + 2)
        out |= {word} if word + " " not in terms and word not in terms else set()
        out |= {f"{before} {word}"} if before else set()
        out |= {f"{word} {after}"} if after else set()
    return out


def counted(texts: DataFrame, of) -> DataFrame:
    """Documents per term and label; counts are summed over TOGETHER texts before they are shuffled."""

    def rows_of(counts: dict[int, Counter]) -> pd.DataFrame:
        both = counts[1].keys() | counts[0].keys()
        return pd.DataFrame([(t, counts[1][t], counts[0][t]) for t in both], columns=["term", "toxic_docs", "other_docs"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = {0: Counter(), 1: Counter()}, 0
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                counts[toxic].update(of(fold(text)))
            n += len(b)
            if n >= TOGETHER:
                yield rows_of(counts)
                counts, n = {0: Counter(), 1: Counter()}, 0
        if n:
            yield rows_of(counts)

    rows = texts.mapInPandas(lean(summed), "term string, toxic_docs long, other_docs long")
    return rows.groupBy("term").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("other_docs").alias("other_docs"))


def significant(counts: DataFrame, toxic: int, other: int, terms: int) -> DataFrame:
    """(term, toxic_docs, weight, gain) of the terms that pass the tests; only these are collected."""
    p, n = F.col("toxic_docs"), F.col("other_docs")
    share = (p + n) / F.lit(float(toxic + other))
    part = lambda x, e: F.when((x > 0) & (e > 0), 2 * x * F.ln(x / e)).otherwise(0.0)
    gain = sum((part(x, of * share) + part(of - x, of * (1 - share)) for x, of in ((p, toxic), (n, other))), F.lit(0.0))
    weight = F.ln((p + 0.5) / (toxic + 1)) - F.ln((n + 0.5) / (other + 1))
    rows = counts.select("term", "toxic_docs", weight.alias("weight"), gain.alias("gain"))
    return rows.filter((F.col("gain") > 2 * math.log(max(terms, 2))) & (F.col("weight") > 1.5))


def select_terms(rows: list) -> dict[str, float]:
    chosen = {r["term"]: (r["gain"], r["weight"], r["toxic_docs"]) for r in rows}
    kept = {}
    for term, (gain, weight, p) in chosen.items():
        stems = [term.rstrip(" ")[:k] for k in PREFIXES if k < len(term)]
        # A beginning gives way to a longer one with nearly its support, a longer one to a beginning
        # that covers clearly more.
        if any(s in chosen and s != term and p < 0.95 * chosen[s][2] for s in stems):
            continue
        kept[term] = (gain, weight, p)
    for term in sorted(kept, key=len):
        if not term.endswith(" ") and any(
            t != term and t.startswith(term) and kept[t][2] >= 0.95 * kept[term][2] for t in kept
        ):
            del kept[term]
    best = sorted(kept, key=lambda t: (-kept[t][0], t))[:TERMS]
    return {t: kept[t][1] for t in best}


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents per label that are not held out."""
    given = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.filter(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [given.filter(F.col("toxic") == v).orderBy(*order).limit(sample) for v in (0, 1)]
    # At most 2 * sample rows of two numbers: small enough to broadcast at any size of the corpus.
    ids = F.broadcast(written(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), "toxic"), "tox-ids"))
    own = docs.select("doc_id", "text")
    return written(own.join(ids, own["doc_id"] == F.col("_id")).select("text", F.col("toxic").cast("int").alias("toxic")), "tox-sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    texts = training_texts(docs, labels, sample)
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        base = toxic / (toxic + other) if toxic + other else 0.0
        return Lexicon(curve=(50.0 if base else -50.0, 0.0, 0.0))
    seen = counted(texts.filter("toxic = 1"), _doc_terms).filter("toxic_docs >= 3")
    top = seen.orderBy(F.desc("toxic_docs"), "term").limit(CANDIDATES).select("term")
    known = frozenset(top.toArrow().column("term").to_pylist())
    counts = counted(texts, lambda folded: _doc_terms(folded) & known)
    best = significant(counts, toxic, other, len(known)).orderBy(F.desc("gain"), "term").limit(4 * TERMS)
    lexicon = Lexicon(select_terms(best.collect()))

    def phrases(folded: str) -> set[str]:
        return _phrases(folded, lexicon.automaton(), lexicon.terms)

    if lexicon.terms:
        near = counted(texts, phrases).filter("other_docs >= 3 and other_docs > 4 * toxic_docs")
        near = near.orderBy(F.desc("other_docs"), "term").limit(PHRASES).select("term").collect()
        lexicon = Lexicon(lexicon.terms, frozenset(r["term"] for r in near))
    found = matched(texts, lexicon).select("total", "words", "toxic").toPandas()  # at most 2 * sample rows
    return Lexicon(lexicon.terms, lexicon.exceptions, fit_curve(*(found[c].to_numpy(float) for c in ("total", "words", "toxic"))))


def matched(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    @F.pandas_udf("total double, words double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for b in batches:
            yield pd.DataFrame([features(fold(t), automaton, lexicon) for t in b], columns=["total", "words"]).astype(float)

    return texts.withColumn("_f", run("text")).select("*", "_f.total", "_f.words").drop("_f")


def score(text: Column, lexicon: Lexicon) -> Column:
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for b in batches:
            f = np.array([features(fold(t), automaton, lexicon) for t in b], dtype=float).reshape(-1, 2)
            z = curve_inputs(f[:, 0], f[:, 1]) @ np.array(lexicon.curve)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(scores)(batches)

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    lexicon = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, with all their columns."""
    lexicon = train(docs, labels)
    rows = boxed(docs, _text="text").select("_row", score(F.col("_text"), lexicon).alias("_score"))
    return opened(rows.filter(F.col("_score") < threshold))
