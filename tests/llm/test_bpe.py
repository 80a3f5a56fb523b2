import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barframe.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
NAME = "byte_bpe_50k.json"
BITS = [
    "a", "b", "the", " ", "  ", "\n", "\t\t", "1", "22", "é", "'s", "'re", "<|endoftext|>", "<|endof", "!", "...", " ",
    "日本", "😀", "\x1c", "\x85", "²", "ing", "tion", "é", "‍",
]


def library(texts):
    tok = tokenizers.Tokenizer.from_file(P.path(NAME))
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)], tok


def random_texts(n, most=40, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def ids_of(packed):
    return memoryview(packed).cast("i").tolist()


def test_merges_equal_the_library_also_in_small_slices():
    voc, texts = bpe.Vocabulary(P.path(NAME)), random_texts(3000)
    want, tok = library(texts)
    for text, ids in zip(texts, want, strict=True):
        for chars in (bpe.CHARS, 1, 7):
            assert ids_of(voc.encode(text, chars)) == ids, text
        assert voc.decode(ids).decode("utf-8", "replace") == tok.decode(ids, skip_special_tokens=False) == text


def test_long_words_and_long_texts():
    voc, rnd = bpe.Vocabulary(P.path(NAME)), random.Random(4)
    texts = ["a" * 200_000, "".join(rnd.choice("etaoin") for _ in range(100_000)), " ".join(random_texts(20_000, 12)), " " * 50_000]
    want, _ = library(texts)
    for text, ids in zip(texts, want, strict=True):
        assert ids_of(voc.encode(text, 10_000)) == ids
        assert voc.decode(ids).decode() == text


def test_stale_entries_and_order():
    """Against merging the pair of smallest rank, the leftmost first, until none is left."""
    voc, rnd = bpe.Vocabulary(P.path(NAME)), random.Random(5)
    for _ in range(500):
        word = bytes(rnd.choice(b"aehinrst ") for _ in range(rnd.randint(0, 24)))
        ids = [voc.byte_ids[b] for b in word]
        while True:
            found = [(voc.ranks[k], i) for i, (x, y) in enumerate(zip(ids, ids[1:])) if (k := x * voc.size + y) in voc.ranks]
            if not found:
                break
            rank, i = min(found)
            ids[i:i + 2] = [voc.made[rank]]
        assert voc.merged(word) == ids


def test_words_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    voc, texts = bpe.Vocabulary(P.path(NAME)), random_texts(200, seed=6)
    assert [ids_of(voc.encode(t)) for t in texts] == library(texts)[0]
    assert len(voc.words) == 3


def test_rows_digests_and_clashing_columns(spark, docs):
    texts = [None, "", "hello  world", "hello  world", "<|endoftext|>x", *random_texts(60, seed=7)]
    table = docs([(i if i != 3 else None, t) for i, t in enumerate(texts)], extra="ids string, decoded int, n_tokens int, _row string")
    got = {r["doc_id"]: r for r in bpe.digest(bpe.encode(table, P.path(NAME), decoded=True)).collect()}
    assert len(got) == len(texts)
    want, _ = library([t or "" for t in texts])
    for i, (text, ids) in enumerate(zip(texts, want, strict=True)):
        r = got[i if i != 3 else None]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table_and_decode_column(spark, docs):
    assert bpe.encode(docs([]), P.path(NAME), decoded=True).count() == 0
    _, tok = library([])
    rows = [(1, [15496, 995]), (2, []), (3, None), (4, [50256, 10, 250]), (5, [162, 9999999])]
    got = dict(spark.createDataFrame(rows, "i int, ids array<int>").select("i", bpe.decode(F.col("ids"), P.path(NAME)).alias("t")).collect())
    assert got[3] is None
    for i, ids in rows:
        if ids is not None:
            assert got[i] == tok.decode([x for x in ids if x < 50257], skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(P.path("word_bpe_49k.json"))
