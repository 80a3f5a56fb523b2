"""Language identification as inference of a multilingual mixture.

Every language has likelihoods of hashed byte trigrams of lower-cased text (everything but letters
is one blank). Trigrams of nearly the same likelihood ratios form one profile, as many as there are
(ratios are never rounded by more than COARSEST), so a text of any length becomes one row of profile counts, and expectation-maximisation over these rows gives the
proportions of the languages in it. EM runs for the best one, two, ... languages; the set with the
largest penalised likelihood, penalty * ln(trigrams) for each language after the first, is kept.
The prediction is the language of the largest proportion, the score this proportion.

Training reads about SAMPLE texts per language, picked by id hash; at most LANGUAGES languages are
learned (the most frequent). Prediction reads every whole text.

Defined cases: a null text, and one without a letter, is "und" with score 0; null languages are not
learned; without any learned language every text is "und"; repeated rows are predicted alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, LANGUAGES = 4000, 256
GRAMS = 1 << 16
SLICE = 4096
PIECE = 2_000_000  # bytes that are counted at once
PROFILES = 512  # the rounding gets coarser above these, up to COARSEST
COARSEST = 1.0
CELLS = 1 << 22  # counts of texts held at once
MOST_IN_MIX = 4
PENALTY = 4.0
STEPS = 15

# Byte classes: blank for ASCII that is not a letter; all bytes of other characters stay as they are.
CLASS = np.array([b if chr(b).isalpha() else 32 for b in range(128)] + list(range(128, 256)), dtype=np.uint8)


def gram_ids(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that starts at each byte, and -1 where it has two blanks in a row."""
    c = CLASS[data].astype(np.uint32)
    ids = (c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA77 + c[2:] * 0xC2B2AE3D) >> np.uint32(16)
    blank = c == 32
    ids = ids.astype(np.int32)
    ids[(blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:])] = -1
    return ids


def pieces(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    """Lower-cased bytes with a blank on either side, in pieces that overlap by two bytes."""
    for i, text in enumerate(texts):
        raw = b" " + (text or "").lower().encode("utf-8", "replace") + b" "
        for at in range(0, max(1, len(raw) - 2), PIECE):
            yield i, raw[at:at + PIECE + 2]


def histograms(texts: list[str | None], group: np.ndarray, width: int) -> np.ndarray:
    """Counts per text of group[trigram]; texts are read in pieces of bounded size."""
    out = np.zeros((len(texts), width), dtype=np.float32)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        data = np.frombuffer(b"  ".join(p for _, p in held) + b"  ", dtype=np.uint8)
        owners = np.repeat(np.array([i for i, _ in held]), [len(p) + 2 for _, p in held])
        ids = gram_ids(data)
        first, last = held[0][0], held[-1][0]
        # Trigrams that start on the last two bytes of a piece belong to the next one, or are blank.
        stops = np.cumsum([len(p) + 2 for _, p in held])
        for back in (3, 4):
            ids[stops - back] = -1
        ok = ids >= 0
        flat = (owners[:-2][ok] - first) * width + group[ids[ok]]
        out[first:last + 1] += np.bincount(flat, minlength=(last - first + 1) * width).reshape(-1, width)
        held.clear()
        size = 0

    for i, piece in pieces(texts):
        held.append((i, piece))
        size += len(piece)
        if size >= PIECE:
            flush()
    if held:
        flush()
    return out


@dataclass
class Model:
    languages: list[str]
    group: np.ndarray  # trigram -> profile
    ratios: np.ndarray  # profile x language, rows sum to 1


def profiles(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts: language x trigram. Trigrams whose log ratios agree after rounding share a profile;
    the rounding gets coarser until at most PROFILES remain, but not beyond COARSEST."""
    p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    ratio = (p / p.sum(axis=0)).T
    weight = counts.sum(axis=0) + 1e-3
    step = 0.5
    while True:
        level = np.maximum(np.round(np.log(ratio) / step), -round(8 / step)).astype(np.int16)
        kinds, group = np.unique(level, axis=0, return_inverse=True)
        if len(kinds) <= PROFILES or step * 1.3 > COARSEST:
            break
        step *= 1.3
    group = group.reshape(-1)
    mean = np.stack([np.bincount(group, weights=weight * ratio[:, l]) for l in range(ratio.shape[1])], axis=1)
    return group.astype(np.int32), (mean / mean.sum(axis=1, keepdims=True)).astype(np.float32)


def train(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """From text and lang of the rows where `learnable` holds."""
    given = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    known = sorted((r["lang"], r["n"]) for r in sizes.collect())
    if not known:
        return Model([], np.zeros(GRAMS, np.int32), np.ones((1, 0), np.float32))
    langs = [l for l, _ in known]
    # At most LANGUAGES rows.
    share = F.broadcast(docs.sparkSession.createDataFrame(
        [(l, i, min(1.0, sample / n)) for i, (l, n) in enumerate(known)], "_lang string, _i int, _share double"
    ))
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = given.join(share, F.col("lang") == F.col("_lang")).filter(dice < F.col("_share")).select("_i", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        own = np.arange(GRAMS)
        for b in batches:
            for i, texts in b.groupby("_i")["text"]:
                # Texts of a language count as one: a row of counts per language, not per text.
                for part in range(0, len(texts), 256):
                    joined = " ".join(texts.iloc[part:part + 256])
                    total[i] = total.get(i, 0) + histograms([joined], own, GRAMS)[0].astype(np.int64)
        for i, counts in total.items():
            for at in range(0, GRAMS, SLICE):
                yield pd.DataFrame({"_i": [i], "at": [at], "counts": [counts[at:at + SLICE].tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        summed = sum(np.frombuffer(x, dtype=np.int64) for x in rows["counts"])
        return pd.DataFrame({"_i": [key[0]], "at": [key[1]], "counts": [summed.tobytes()]})

    shape = "_i int, at int, counts binary"
    parts = picked.mapInPandas(count, shape).groupBy("_i", "at").applyInPandas(add, shape)
    counts = np.zeros((len(langs), GRAMS))
    for r in parts.collect():  # languages * GRAMS numbers
        counts[r["_i"], r["at"]:r["at"] + SLICE] = np.frombuffer(r["counts"], dtype=np.int64)
    return Model(langs, *profiles(counts))


def mixture(counts: np.ndarray, ratios: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM proportions of each row's allowed languages, and the log likelihood."""
    theta = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(STEPS):
        theta = theta * ((counts / np.maximum(theta @ ratios.T, 1e-20)) @ ratios) / total
        theta = np.where(allowed > 0, theta + 1e-9, 0)
        theta /= theta.sum(axis=1, keepdims=True)
    return theta, (counts * np.log(np.maximum(theta @ ratios.T, 1e-20))).sum(axis=1)


def proportions(counts: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The proportions of the selected languages, row by row; the others are 0."""
    seen = counts.any(axis=0)
    counts, ratios = counts[:, seen], ratios[seen]
    rows, n = len(counts), ratios.shape[1]
    everything, _ = mixture(counts, ratios, np.ones((rows, n), dtype=np.float32))
    order = np.argsort(-everything, axis=1, kind="stable")
    cost = penalty * np.log(np.maximum(counts.sum(axis=1), 2))
    best = np.full(rows, -np.inf)
    out = np.zeros((rows, n), dtype=np.float32)
    for m in range(1, min(n, MOST_IN_MIX) + 1):
        allowed = np.zeros((rows, n), dtype=np.float32)
        np.put_along_axis(allowed, order[:, :m], 1, axis=1)
        theta, fit = mixture(counts, ratios, allowed)
        value = fit - cost * (m - 1)
        better = value > best
        out[better], best[better] = theta[better], value[better]
    return out


def predict(text: Column, model: Model, penalty: float = PENALTY) -> Column:
    """struct(lang_pred, score) of a string column."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            rows = max(1, min(1024, CELLS // max(len(model.ratios), 1)))
            for at in range(0, len(texts) if model.languages else 0, rows):
                part = texts[at:at + rows]
                theta = proportions(histograms(part, model.group, len(model.ratios)), model.ratios, penalty)
                top = theta.argmax(axis=1)
                for i, text in enumerate(part):
                    if text is not None and any(map(str.isalpha, text)):
                        names[at + i] = model.languages[top[i]]
                        scores[at + i] = min(1.0, max(0.0, float(theta[i, top[i]])))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    model = train(docs, ~held_out(F.col("doc_id")))
    made = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("_p"))
    return made.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
