import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from barframe.llm import spelling


def apart(a, b):
    """Exactly one edit, by plain dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1] == 1


def brute(counts, ratio=10):
    near = {w: [o for o in counts if apart(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        first = min(others, key=lambda o: (-counts[o], o), default=None)
        if first is not None and counts[first] >= ratio * counts[w]:
            form[w] = first
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def found(spark, counts, **kw):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.variants(df, **kw).collect()
    return sorted([tuple(r) for r in rows], key=lambda r: r[0])


def edited(rnd, w, letters):
    at, kind = rnd.randrange(len(w) + 1), rnd.randrange(3)
    return w[:at] + ("" if kind == 0 else rnd.choice(letters)) + w[at + (kind != 1):]


@pytest.mark.parametrize("letters, least", [("ab", 4), ("abcdefghijklmnop", 5), ("aé÷ÿz", 6)])
def test_equals_all_pairs(spark, letters, least):
    rnd = random.Random(letters)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(least, least + 4))) for _ in range(60)}
    for _ in range(3):
        words |= {edited(rnd, w, letters) for w in list(words) if rnd.random() < 0.8}
    counts = {w: 10 ** rnd.randrange(5) * rnd.randint(2, 4) for w in sorted(words) if len(w) >= least}
    assert found(spark, counts) == brute(counts)


def test_letters_beyond_latin_one(spark):
    counts = {"абвгдеж": 100, "абвгдез": 5, "абвгде": 3, "日本語日本語日": 4, "日本語日本語月": 40, "😀😀😀😀😀😀😀": 3, "😀😀😀😀😀😀": 50}
    assert found(spark, counts) == brute(counts)


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "caaaaaa": 20, "zzzzzzzz": 5}
    rows = {r[0]: r for r in found(spark, counts)}
    assert rows["aaaaaaa"][1:3] == ("aaaaaab", "aaabbbb")  # of two near words of 20 the smaller
    assert rows["zzzzzzzz"] == ("zzzzzzzz", None, "zzzzzzzz", 5, 0, None)
    assert list(rows.values()) == brute(counts)


def test_one_bigram_everywhere(spark):
    """Words of one letter in every length, and one start shared by all."""
    counts = {"a" * n: n for n in range(7, 40)} | {"zzzzzz" + "".join(p): 3 for p in itertools.product("xy", repeat=6)}
    assert found(spark, counts) == brute(counts)


@pytest.mark.parametrize("m", [3, 4, 6])
def test_pivots_are_the_cheapest_disjoint_pair(m):
    rng = np.random.default_rng(m)
    place = np.sort([rng.choice(10, m, replace=False) for _ in range(500)], axis=1)
    cost = rng.integers(0, 30, place.shape).astype(float)
    for row, own, a, b in zip(cost, place.tolist(), *spelling.pivots(place, cost), strict=True):
        assert b >= a + 2
        least = min(row[i] + row[j] for i in range(m) for j in range(i + 1, m) if own[j] >= own[i] + 2)
        assert row[own.index(a)] + row[own.index(b)] == least


def test_words_of_documents(spark, docs):
    rnd = random.Random(2)
    stems = ["".join(rnd.choice("abcdeéÿ") for _ in range(rnd.randint(6, 9))) for _ in range(25)]
    rows = [(i, " ".join(rnd.choice(["{}", "{},", "X{}", "{}9", "-{}", "{}Δ"]).format(rnd.choice([str.upper, str.title, str])(rnd.choice(stems))) for _ in range(80))) for i in range(40)]
    rows += [(None, "Letters Letters LETTERS"), (7, None), (8, ""), (rows[0]), (9, "q" * 60_000), (9, "q" * 60_000)]
    counts = collections.Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert len(counts) > 30
    got = spelling.document_variants(docs(rows, extra="word string, n int, run string, form string")).collect()
    want = brute({w: n for w, n in counts.items() if len(w) < 1000})
    assert sorted([tuple(r) for r in got if len(r["word"]) < 1000], key=lambda r: r[0]) == want
    assert {r["word"]: r["n"] for r in got} == counts


def test_empty_tables(spark, docs):
    assert spelling.document_variants(docs([])).count() == 0
    assert spelling.document_variants(docs([(1, None), (2, "short words only")])).count() == 0
    assert found(spark, {}) == []


def test_short_words_are_refused(spark):
    with pytest.raises(Exception, match="code points"):
        found(spark, {"abc": 2, "abcd": 3})


def test_split_keys(spark, monkeypatch):
    """Keys beyond a cell meet in a grid; nothing is lost or told twice."""
    monkeypatch.setattr(spelling, "CELL", 60)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    rnd = random.Random(9)
    words = {"zz" + "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 7))) for _ in range(150)}
    counts = {w: rnd.randint(2, 2000) for w in sorted(words)}
    assert found(spark, counts) == brute(counts)
