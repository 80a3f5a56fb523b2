import random
import re
import time

import pytest
from barframe.llm import language_id as L
from barframe.llm import pieces as P
from barframe.llm import pii
from barframe.llm import token_counts as C
from barframe.llm import toxicity as T
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  two  blanks ", "x" * 3000, "▁a ▁ b", "日本語 emoji 😀 é\t\x00", "it's we'll a1b22 " * 300, "é " * 2000,
    "İstanbul <|startoftext|>a <|ENDOFTEXT|> " * 100, "ΑΣ σς " * 300, "ab­cd ﬁ Å " * 200, "\n\n\n", "Å" * 700,
]


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    rows = [(i, t) for i, t in enumerate(ODD)] * 2
    for chunk, overlap in ((200, 8), (1000, 64), (65536, 512)):
        got = C.token_counts(docs(rows), BPE, limit=100, chunk=chunk, overlap=overlap).collect()
        assert len(got) == 2 * len(ODD) and all(r.n_tokens == want[r.doc_id] for r in got)
        assert all(r.n_bytes == len((ODD[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 100) for r in got)
    assert C.token_counts(docs([]), BPE).count() == 0


def test_spliced_ids_widen_until_a_boundary_agrees():
    tok = C.tokenizer(BPE)
    for text in ("a" * 5000, "word " * 2000, ("no-blank" * 300 + " ") * 5, "é" * 2000 + " b" * 2000):
        for chunk, overlap in ((100, 4), (700, 16)):
            assert C.spliced(tok, text, chunk, overlap) == tok.encode(text).ids


def test_pieces_are_lossless_and_reproducible(docs):
    rows = [(i, t) for i, t in enumerate(ODD)]
    one = P.sampled_pieces(docs(rows), PIECES)
    first = {r.doc_id: r for r in one.collect()}
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in first.values()) and first[0].n_pieces == 0
    again = {r.doc_id: r.ids for r in P.sampled_pieces(docs(rows[::-1]).repartition(5), PIECES).collect()}
    assert again == {i: r.ids for i, r in first.items()}
    assert P.sampled_pieces(docs([]), PIECES).count() == 0


def test_the_library_decodes_sampled_pieces_and_keys_differ(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "The encoding of many unpredictable segmentations, 12345 times over."
    got = P.sampled_pieces(docs([(i, text) for i in range(200)]), PIECES).collect()
    assert all(sp.decode(r.ids) == text for r in got)
    own = P.sampled_pieces(docs([(i, t) for i, t in enumerate(ODD)]), PIECES).select("doc_id", P.decode(F.col("ids"), PIECES).alias("t"))
    assert {r.doc_id: r.t for r in own.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert len({tuple(r.ids) for r in got}) > 20


def test_sampling_follows_the_lattice_weights():
    """Every segmentation of a short word is drawn in proportion to the product of its pieces' weights."""
    import math
    from collections import Counter

    import numpy as np

    voc = P.vocabulary(PIECES)
    lattice = P.Lattices(["▁then"], voc)
    paths = {}

    def walk(at, edges, weight):
        if at < 0:
            paths[tuple(edges)] = weight
            return
        for e in range(lattice.first_edge[at], lattice.first_edge[at + 1]):
            walk(lattice.start[e] - 1, [e, *edges], weight * voc.weight[lattice.piece[e]])

    walk(len(lattice.points) - 1, [], 1.0)
    n = 40_000
    who, edge = lattice.sample(np.zeros(n, dtype=np.int64), P.mixed(np.arange(n).astype(np.uint64)))
    seen = Counter(tuple(x) for x in np.split(edge, np.flatnonzero(np.diff(who)) + 1))
    total = sum(paths.values())
    assert len(paths) >= 8 and sum(seen.values()) == n
    for path, weight in paths.items():
        p = weight / total
        assert abs(seen[path] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_languages_of_held_out_texts(docs):
    say = {"en": "the quick brown fox jumps over lazy dogs and runs ", "de": "der schnelle braune fuchs springt über den faulen hund ",
           "fr": "le renard brun rapide saute par dessus le chien paresseux "}
    rows = [(i, say[lang][i % 7:] * (1 + i % 3), lang) for i in range(300) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 ... 45", "fr"), (1003, "Ω", "en"), (1004, say["de"] * 20_000, None)]
    out = {r.doc_id: r for r in L.language_id(docs(rows)).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:300]) and {True, False} == {r.held_out for r in out.values()}
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert out[1003].lang_pred in say and out[1004].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in L.language_id(docs([(1, "abc", None)])).collect()} == {"und"}
    assert L.language_id(docs([])).count() == 0


def test_a_mixed_text_has_two_languages(docs):
    en, de = "the quick brown fox jumps over lazy dogs and runs ", "der schnelle braune fuchs springt über den faulen hund "
    model = L.train(docs([(i, en, "en") for i in range(40)] + [(100 + i, de, "de") for i in range(40)]), F.lit(True))
    assert model.languages == ["de", "en"]
    counts = L.histograms([en * 6, en * 30 + de * 10, de * 4], model.group, len(model.ratios))
    theta = L.proportions(counts, model.ratios)
    assert theta[0, 0] == 0 and theta[2, 1] == 0 and abs(theta[1, 1] - 0.75) < 0.06


def test_histograms_of_pieces_equal_those_of_whole_texts(monkeypatch):
    import numpy as np

    texts = ["some words here, and there", None, "x" * 500, "ÄÖ ü" * 90]
    group = np.arange(L.GRAMS) % 97
    whole = L.histograms(texts, group, 97)
    monkeypatch.setattr(L, "PIECE", 37)
    assert (L.histograms(texts, group, 97) == whole).all()


def toxic_tables(spark, docs):
    calm = ["green fields and quiet rivers run here", "we measured the values twice today", "the grumblebee sings in my garden"]
    rows = [(i, calm[i % 3] + f" n{i}", "en") for i in range(300)]
    rows += [(1000 + i, f"you are a grumblex and a snarfed fool {i} " + calm[i % 2], "en") for i in range(120)]
    rows += [(2000, "what a gruMb1ex", "en"), (2001, "сnаrfed? snаrfed grumblex", "en"), (2002, None, None), (2003, "", None), (2004, "x " * 90_000, "en")]
    labels = spark.createDataFrame(
        [(i, 0, 1 if i >= 1000 else 0) for i, *_ in rows if i < 2000] + [(5, 0, None), (7777, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int"
    )
    return docs(rows), labels


def test_toxic_terms_are_learned_and_seen_through_disguise(spark, docs):
    table, labels = toxic_tables(spark, docs)
    lexicon = T.train(table, labels)
    assert any("grumbiex".startswith(t.strip()) for t in lexicon.terms) and not any("grumbiebee".startswith(t.strip()) for t in lexicon.terms)
    out = {r.doc_id: r for r in T.toxicity(table, labels).collect()}
    assert all(out[1000 + i].predicted == 1 for i in range(120)) and all(out[i].predicted == 0 for i in range(300))
    assert out[2000].predicted == 1 and out[2001].predicted == 1
    assert all(out[i].predicted == 0 for i in (2002, 2003, 2004)) and all(0 <= r.score <= 1 for r in out.values())
    kept = T.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == 303


def test_an_exception_phrase_does_not_count():
    lexicon = T.Lexicon({"trash ": 5.0, "ciown": 4.0}, frozenset({"trash can", "ciownfish"}), (-3.0, 1.0, 1.0))
    auto = lexicon.automaton()
    weigh = lambda t: T.features(T.fold(t), auto, lexicon)[0]
    assert weigh("Trash!") == 5 and weigh("the trash can") == 0 and weigh("trashy") == 0
    assert weigh("clowns, clownfish and c10wn") == 8 and weigh(None) == 0


def test_without_labels_nothing_is_toxic(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in T.toxicity(docs([(1, "a"), (2, None)]), none).collect()} == {0}
    assert T.toxicity(docs([]), none).count() == 0


def brute_spans(text):
    """The four patterns tried at every place, without finditer."""
    out = []
    for kind in pii.KINDS:
        at = 0
        while at < len(text):
            m = pii.PATTERNS[kind].match(text, at)
            if not m:
                at += 1
                continue
            if pii.holds(kind, m[0]):
                out.append((kind, *m.span()))
            at = m.end()
    return out


PLAIN = [
    "", "a@b.c", "a@b.c@d.e x@y", "x.y+z@mail-1.example.com.", "1.2.3.4 256.1.1.1 1.2.3.4.5 0255.01.1.1 " + "9" * 5000 + ".1.1.1",
    "4539578763621486 4539-5787-6362-1486 4539 5787 6362 1487 1234567890123", "+1 (988) 555-2485 +12 +123456789 +1234567890123456",
    "+1 (988) 555-2485 4539578763621486", "é 7.7.7.7 é a@é.com",
]


def test_base_spans_equal_a_plain_scan(docs):
    for t in PLAIN:
        assert [s[:3] for s in pii.spans(t) if s[3]] == brute_spans(t)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_linear_scans_equal_the_patterns_on_random_strings():
    rng = random.Random(8)
    for alphabet in ("a9.@-+ ()", "a@.-", "1. ", "12.3", "+1( -", "a@b.c_"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert [s[:3] for s in pii.spans(t) if s[3]] == brute_spans(t), t


@pytest.mark.parametrize("unit", [
    "p", "9", "1.1.1.", "+1(", "a@", "@a", "1.1.1.1 ", "a@b.c ", "one ", "a dot ", "x at ", "(", "a (", "9 ", "one one one ", "a [at] b [dot] cc ",
    "1.1.1.1 one dot one dot one dot one ",
])
def test_very_long_runs_take_linear_time(unit):
    text = unit * (2_000_000 // len(unit))
    start = time.process_time()
    found = pii.spans(text)
    assert time.process_time() - start < 25
    assert all(0 <= a < b <= len(text) for _, a, b, _ in found)


@pytest.mark.parametrize("text, kind, source", [
    ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("x jo [at] example (dot) co (dot) uk", "email", "jo [at] example (dot) co (dot) uk"),
    ("call plus one five five five one two three four five six seven.", "phone", "plus one five five five one two three four five six seven"),
    ("ip 10 dot 0 dot 0 dot 12 ok", "ip", "10 dot 0 dot 0 dot 12"),
    ("u＠ex．com", "email", "u＠ex．com"), ("é 192.168.１.5", "ip", "192.168.１.5"),
    ("é four five three nine five seven eight seven six three six two one four eight six", "card",
     "four five three nine five seven eight seven six three six two one four eight six"),
])
def test_disguised_data_maps_back_to_the_source(text, kind, source):
    assert [(k, text[a:b], own) for k, a, b, own in pii.spans(text) if k == kind] == [(kind, source, False)]


@pytest.mark.parametrize("text", ["available at example.com", "one two three", "the dot at the end", "look at section 4.2 dot", "at one point"])
def test_plain_prose_has_no_spans(text):
    assert pii.spans(text) == []


def test_digest(docs):
    import hashlib

    text = "é a@b.c, 1.2.3.4 and x [at] y [dot] org"
    out = {r.doc_id: r for r in pii.digest(pii.find_pii(docs([(1, text), (2, None), (2, None), (3, "p" * 200_000)]))).collect()}
    base = [f"{k}:{a}:{b}" for k, a, b in brute_spans(text)]
    assert out[1].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) < set(out[1].spans.split(",")) and (out[1].n_email, out[1].n_ip, out[1].n_card, out[1].n_phone) == (2, 1, 0, 0)
    assert out[2].spans == out[3].spans == "" and out[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert re.fullmatch("[0-9a-f]{64}", out[3].base_sha256) and pii.digest(pii.find_pii(docs([]))).count() == 0


def test_many_languages_keep_their_evidence():
    import numpy as np

    rng = np.random.default_rng(11)
    share = rng.lognormal(0, 2, (24, L.GRAMS))
    share /= share.sum(axis=1, keepdims=True)
    group, ratios = L.profiles(np.round(share * 8e6))
    texts = np.stack([np.bincount(group[rng.choice(L.GRAMS, 300, p=p)], minlength=len(ratios)) for p in share])
    theta = L.proportions(texts.astype(np.float32), ratios)
    assert (theta.argmax(axis=1) == np.arange(24)).all() and theta.max(axis=1).min() > 0.5


@pytest.mark.parametrize("source", [
    "alice at example.com", "j.doe at mail.example.org", "Alice at EXAMPLE.COM", "АВЕКМНРСТХ@example.com", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ@example.com",
    "ɡreta@example.com", "rоbеrt@ехаmрӏе.com", "ԛuіzь@example.com", "гoy@example.com",
])
def test_more_disguises_of_addresses(source):
    text = f"now {source} later"
    assert [(text[a:b], own) for k, a, b, own in pii.spans(text) if k == "email" and not own] == [(source, False)]


@pytest.mark.parametrize("text", ["see it at example.com", "hosted at example.com", "parking at example.com", "version 2 at example.com", "rain at noon.Then sun"])
def test_a_bare_at_in_prose_is_none(text):
    assert pii.spans(text) == []
