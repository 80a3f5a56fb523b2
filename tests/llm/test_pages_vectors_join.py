import collections
import json

import numpy as np
import pytest
from barframe.llm import collision_search as A
from barframe.llm import components as G
from barframe.llm import html_wrapper as H
from barframe.llm import ngram_join as J
from barframe.llm.shingles import shingle_sets

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>'
    '<header class="site-header">My site</header><nav><ul><li><a href="/a">Home {0}</a></li></ul></nav><div class="ad">Buy {0}</div>'
    "<article><h1>Title {0}</h1><p>First  &amp; {0}\n text &#233;&nbsp;x<b>bold</b><br>after<p>second {0}"
    '<aside>see also</aside><form><input>ask</form></p><div class="share-links"><a href="/x">share this</a></div></article>'
    '<div id="comments">reader {0} says</div><footer>&copy; {0}</footer></body></html>'
)


def expected(i):
    return f"Title {i}\nFirst & {i} text é xbold\nafter\nsecond {i}"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, text int, wrapper string")


def test_pages_of_a_host_read_through_its_wrapper(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(i)) for i in range(30)]
    rows += [(100, "http://one.example.com/", PAGE.format(100)), (101, None, PAGE.format(101)), (102, "http://h0.example.com/n", None), (103, "x", ""), (0, rows[0][1], rows[0][2])]
    out = H.extract_pages(pages(spark, rows)).collect()
    assert sorted(r.page_id for r in out) == sorted(r[0] for r in rows)
    for r in out:
        want = "" if r.page_id in (102, 103) else expected(r.page_id)
        assert (r.text, r.n_chars) == (want, len(want))
    assert H.extract_pages(pages(spark, [])).count() == 0


def test_induction_without_article_tags():
    form = '<html><body><div class="top"><a>home</a></div><div class="wrap"><div class="links"><a>one</a> <a>two</a></div><div class="body">{}</div></div></body></html>'
    texts = ["".join(f"<p>{w} {k} of page {i} with some words</p>" for k in range(3 + i)) for i, w in enumerate(("alpha", "beta", "gamma"))]
    made = H.induce([form.format(t) for t in texts])
    assert made["path"][-1] == "div.body"
    assert H.extract(form.format(texts[1]), made).split("\n") == [f"beta {k} of page 1 with some words" for k in range(4)]


def test_constant_link_lists_inside_the_region_are_template():
    form = "<html><body><main>{}<ul><li><a>tag one</a></li><li><a>tag two</a></li></ul></main></body></html>"
    made = H.induce([form.format(f"<p>text number {i} goes here</p>") for i in range(4)])
    assert H.extract(form.format("<p>other</p>"), made) == "other"
    assert json.loads(json.dumps(made)) == made


@pytest.mark.parametrize("text, want", [
    ("<p>a<p>b", "a\nb"), ("<b>a</b>b<i>c", "abc"), ("a < b", "a < b"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<!-- <p>x</p> -->y", "y"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<div hidden>x</div>y", "y"), ("<p title='a>b'>c", "c"), ("<script>x", ""),
    ("&lt;p&gt; &eacute;&#x41;", "<p> éA"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("x" * 300_000, "x" * 300_000),
])
def test_odd_markup(text, want):
    assert "\n".join(H.blocks([H.parse(text)], [])) == want


def test_simple_tree_matching_counts_the_best_pairs():
    a = H.Folded([H.parse("<div><p>x</p><ul></ul><h1>t</h1></div>")])
    b = H.Folded([H.parse("<div><ul></ul><p>x</p><h1>u</h1></div>")])
    assert H.matched(a, b, {}) == 4  # root, div, h1 and one of p and ul


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, 1.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")


def brute_nearest(rows, k=5):
    fine = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ok = {i: np.array(v, dtype=np.float64) for i, v in sorted(fine, reverse=True)}  # the smallest of an id comes last
    size = collections.Counter(map(len, ok.values())).most_common(1)[0][0]
    ok = {i: v for i, v in ok.items() if len(v) == size}
    out = {}
    for q, v in ok.items():
        if q % 50 == 0:
            near = sorted((-(w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())), i) for i, w in ok.items() if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def f32(x):
    return [float(v) for v in np.asarray(x, dtype=np.float32)]


def test_nearest_of_a_small_table_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f32(rng.standard_normal(16))) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(8)]  # equal vectors tie by id
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [float("inf")] + [1.0] * 15),
             (2250, [None] + [1.0] * 15), (2300, [1.0, 2.0]), (None, rows[0][1]), (7, rows[7][1]), (8, [9.0] * 16)]
    got = collections.defaultdict(list)
    for r in A.nearest(vectors(spark, rows), block=150, chunk=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_fewer_candidates_than_asked_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert [(r.rank, r.vec_id) for r in A.nearest(vectors(spark, rows)).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert A.nearest(vectors(spark, [])).count() == 0 and A.nearest(vectors(spark, rows[:1])).count() == 0


def test_recall_in_a_block_without_clusters():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 64))
    units = v / np.linalg.norm(v, axis=1)[:, None]
    index, hit = A.Index(np.arange(4000), v), 0
    found = collections.defaultdict(set)
    for q, i, _ in index.search(np.arange(0, 4000, 50), v[::50]):
        found[q].add(i)
    for q in range(0, 4000, 50):
        order = [i for i in np.argsort(-(units @ units[q])) if i != q][:5]
        hit += len(found[q] & set(order))
    assert hit / 400 >= 0.9


def words(k, n, seed=0):
    rng = np.random.default_rng(seed)
    return [f"w{k}x{x}" for x in rng.integers(0, 10_000, n)]


def edited(text, at):
    out = list(text)
    for a in at:
        out[a] = f"new{a}"
    return out


def test_shingles_equal_a_plain_version():
    import re

    texts = [None, "", "a", "A b\x0bc", " \t ", "x y z w", "x y z w x y z w", "Ünï B C D É é", "a " * 50, "q r s t u v"]
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    got = [set(map(int, s)) for s in shingle_sets(texts, 4)]
    assert [len(g) for g in got] == [len(s) for s in sets]
    assert all(len(a & b) == len(x & y) for a, x in zip(got, sets) for b, y in zip(got, sets))


def brute_components(rows, size, percent):
    sets = [(i, set(map(int, s))) for (i, _), s in zip(rows, shingle_sets([t for _, t in rows], size))]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("size, percent, few", [(4, 85, 24), (5, 80, 1)])
def test_join_equals_all_pairs(docs, monkeypatch, size, percent, few):
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "TILE", 8)
    monkeypatch.setattr(J, "HOT", 40)
    rng = np.random.default_rng(size)
    rows = [(i, " ".join(words(i, int(n), i))) for i, n in enumerate(rng.integers(1, 120, 60))]
    for g in range(3):  # groups of near copies with more and more edits, chains among them
        base = words(f"g{g}", 150, g)
        for k in range(60):
            base_k = edited(base, rng.choice(150, int(rng.integers(0, 9)), replace=False))
            rows.append((100 + 100 * g + k, " ".join(base_k[: 150 - k % 4])))
    shared = words("passage", 60)
    rows += [(500 + k, " ".join(shared + words(f"p{k}", 8 + k % 20, k))) for k in range(40)]
    rows += [(600, None), (601, ""), (602, " \t"), (603, "A b"), (604, "a B"), (605, "one two three four"), (606, "ONE two three four"), (607, "b a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_groups(docs(rows), size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_bit_counts_never_lose_a_link():
    rng = np.random.default_rng(1)
    for n in (3, 30, 300, 3000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.02, 0.08, 0.2):
            y = np.unique(np.concatenate([x[int(share * len(x)):], rng.integers(0, 2**63, int(share * n * 3)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            room = J._room(len(x), J.bitmap(x), len(y), J.bitmap(y), 85)
            m = J._matrix([J.bitmap(x), J.bitmap(y)])
            assert bool(J.bounded(np.array([len(x)]), m[:1], np.array([len(y)]), m[1:], 85)[0, 0]) == room
            quick = J._room(len(x), J.bitmap(x, True), len(y), J.bitmap(y, True), 85)
            assert quick or 100 * both < 85 * (len(x) + len(y) - both)
            assert room or 100 * both < 85 * (len(x) + len(y) - both)


def test_keep_one_and_repeated_rows(docs):
    text = " ".join(words("k", 100))
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (1, "else"), (None, text), (7, None)]
    table = docs(rows)
    kept = J.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), r.text is None) for r in kept.collect()) == [("1", False), ("3", False), ("3", False), ("7", True), ("None", False)]
    assert J.ngram_groups(docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(1049, 3000), (5, 5), (2, 1)]
    got = {r.id: r.component for r in G.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in (1000, 1049, 3000)) and 5 in got
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        G.components(spark.createDataFrame(chain, "a long, b long"), most=2)


SHELL = '<html><body><div class="top"><a href="/">home</a></div>{}</body></html>'


def long_text(i, k=0):
    return " ".join(f"w{i}x{k}x{j}" for j in range(40))


def read_alike(spark, forms):
    """The texts by page id; the wrapper of the table is the one of the list."""
    table = pages(spark, [(i, "http://h.example.com/", f) for i, f in enumerate(forms)])
    out = {r.page_id: r.text for r in H.extract_pages(table).collect()}
    made = H.induce(forms)
    assert [json.loads(r.wrapper) for r in H.wrappers(table).collect()] == [made]
    assert [H.extract(f, made) for f in forms] == [out[i] for i in range(len(forms))]
    return out


def test_text_beside_the_largest_part_stays(spark):
    parts = '<div class="lead">Lead {0}</div><div class="body"><p>{1}</p></div><div class="close">End {0}</div>'
    out = read_alike(spark, [SHELL.format(parts.format(i, long_text(i))) for i in range(4)])
    assert out == {i: f"Lead {i}\n{long_text(i)}\nEnd {i}" for i in range(4)}
    parts = '<main><h1>Title {0}</h1><article class="a"><p>{1}</p></article><article class="b"><p>{2}</p></article></main>'
    out = read_alike(spark, [SHELL.format(parts.format(i, long_text(i), long_text(i, 1))) for i in range(4)])
    assert out == {i: f"Title {i}\n{long_text(i)}\n{long_text(i, 1)}" for i in range(4)}
    assert H.extract(SHELL.format(parts.format(9, long_text(9), long_text(9, 1))), None) == out[0].replace("w0x", "w9x").replace("Title 0", "Title 9")


def test_constant_texts_are_template_and_varying_ones_stay(spark):
    parts = (
        '<div class="body"><p>{1}</p><p>Call us for a free quote</p><p>{2}</p><div class="hint">Prices are without tax</div>'
        '<div class="social-policy"><p>On welfare {0}</p></div><div class="related"><a href="/{0}">see {0}</a></div>'
        '<div class="promo">One of {3} offers</div><div class="notice">We use cookies</div></div>'
    )
    out = read_alike(spark, [SHELL.format(parts.format(i, long_text(i), long_text(i, 1), i % 2)) for i in range(6)])
    assert out == {i: f"{long_text(i)}\n{long_text(i, 1)}\nOn welfare {i}" for i in range(6)}


def test_near_copies_of_an_article_are_no_template(spark):
    same = "".join(f"<p>{long_text(7, k)}</p>" for k in range(9))
    out = read_alike(spark, [SHELL.format(f'<div class="body">{same}<p>edit {i}</p></div>') for i in range(3)])
    assert all(out[i].split("\n") == [*(long_text(7, k) for k in range(9)), f"edit {i}"] for i in range(3))


def test_every_page_and_layout_of_a_host_counts(spark):
    story = SHELL.format('<div class="story"><p>{}</p><p>Story terms apply</p></div>')
    other = SHELL.format('<div class="story"><p>Teaser {0}</p></div><div class="longform"><p>{1}</p><p>Longform terms apply</p></div>')
    forms = [story.format(long_text(i)) for i in range(20)] + [other.format(i, long_text(i)) for i in range(20, 24)]
    out = read_alike(spark, [forms[0]] * 40 + forms)  # copies take no page's place
    want = [long_text(i) for i in range(20)] + [f"Teaser {i}\n{long_text(i)}" for i in range(20, 24)]
    assert [out[k] for k in range(64)] == [want[0]] * 40 + want


def test_keep_single_with_repeated_and_null_ids(docs):
    text, more, clean, lone = (" ".join(words(k, 100)) for k in "kmcl")
    rows = [(5, text), (3, text + " more"), (9, text + " still"), (9, clean), (None, text + " null"), (None, more), (None, more + " near"),
            (None, lone), (3, lone + " x"), (6, "tie of rows"), (6, "tie of rows"), (7, None), (7, None)]
    table = docs(rows)
    kept = J.keep_single(table)
    assert kept.columns == table.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    near = got.pop((None, more), 0) + got.pop((None, more + " near"), 0)
    assert near == 1 and got == {(3, text + " more"): 1, (9, clean): 1, (3, lone + " x"): 1, (6, "tie of rows"): 1, (7, None): 2}
    assert J.keep_single(docs([])).count() == 0
