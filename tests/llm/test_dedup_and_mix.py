import hashlib
import re
from collections import defaultdict

import pytest
from barframe.llm import exact_dedup as D
from barframe.llm import mixing as M
from barframe.llm import slots as S
from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute_marks(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        body = SPACE.sub("", t or "")
        first = min(groups[body], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, first[2], len(groups[body]), (-len(t or ""), i) == (first[0], first[2]), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def got_marks(df, **k):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in D.marks(df, **k).collect()), key=str)


EDGES = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (6, "a b"), (7, "ab "), (8, "x" * 200_000), (9, "x" * 200_000), (10, "é"), (None, "ab"), (11, "only")]


def test_marks_of_edge_cases(docs):
    assert got_marks(docs(EDGES)) == brute_marks(EDGES)


def test_marks_when_every_slot_collides(docs):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    assert got_marks(docs(rows), per_row=0) == brute_marks(rows) == got_marks(docs(rows))


def test_empty_table(docs):
    assert D.marks(docs([])).count() == 0 and D.exact_dedup(docs([])).count() == 0 and M.mix(docs([])).count() == 0


def test_exact_dedup_keeps_one_row_and_all_columns(docs):
    rows = [*EDGES, (12, "again"), (12, "again"), (13, "again"), (12, "other")]
    table = docs(rows)
    kept = D.exact_dedup(table)
    assert kept.columns == table.columns
    # Ids 8 and 9 tie: the smaller stays. Of the repeated row 12 one stays, its other text too.
    assert sorted((r.doc_id, r.text[:5]) for r in kept.collect()) == [
        (1, "a b"), (5, " \t\n\x0b\x0c"), (6, "a b"), (8, "xxxxx"), (10, "é"), (11, "only"), (12, "again"), (12, "other"),
    ]


def test_without_matches_nulls_and_only_listed_keys(spark, docs):
    table = docs([(i, "t") for i in range(50)] + [(None, "n")])
    gone = spark.createDataFrame([(3,), (3,), (None,), (77,)], "doc_id long")
    assert sorted(r.doc_id for r in S.without(table, gone).collect()) == [i for i in range(50) if i != 3]
    assert S.without(table, gone.filter("doc_id > 100")).count() == 51


def test_slots_of_a_filter_are_found_again(spark):
    ids = spark.range(2000)
    bits = S.as_filter(ids.filter("id % 3 = 0").select(F.explode(S.slots(F.col("id"), 1 << 17)).alias("slot")))
    seen = {r.id for r in S.hits(ids, F.col("id"), bits, 1 << 17, "seen").filter("seen").collect()}
    assert {i for i in range(2000) if i % 3 == 0} <= seen and len(seen) < 720


def test_dedup_runs_no_python(docs):
    plan = D.marks(docs(EDGES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, goal = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            return goal | {s: w[s] * level for s in open_}
        goal |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return goal


def test_mix_meets_targets_and_bounds(docs):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", f"s{i % 5}") for i in range(600)]
    rows += [(1000, None, "en", None), (1001, "one two", "en", None), (1002, "", None, "zero"), (1003, "w " * 5, "en", "tiny"), (1003, "w " * 5, "en", "tiny")]
    out = M.mix(docs(rows)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    assert len(out) == len(rows) and all(r.source_size == sizes[r.source] for r in out)
    want = water(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in out if r.source == s) + 1 for s in sizes)
    again = M.mix(docs(rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_apply_mix_repeats_rows(docs):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(40)]
    table = docs(rows)
    mixed = M.apply_mix(table)
    copies = {r.doc_id: r.copies for r in M.mix(table).collect()}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert mixed.columns == table.columns and {i: c for i, c in copies.items() if c} == dict(got)


def test_all_words_missing(docs):
    assert {(r.size, r.target, r.taken) for r in M.mix(docs([(1, None, "en", "a"), (2, " ", "en", "b")])).collect()} == {(0, 0.0, 0)}


def test_copies_of_one_id_or_none_leave_one(docs):
    rows = [(None, "a b"), (None, "ab"), (7, "c d"), (7, "cd"), (7, "other"), (8, "e f"), (8, "e f"), (8, "ef"), (None, "alone")]
    kept = sorted((str(r.doc_id), r.text) for r in D.exact_dedup(docs(rows)).collect())
    assert kept == [("7", "c d"), ("7", "other"), ("8", "e f"), ("None", "a b"), ("None", "alone")]


def test_newton_steps_raise_where_they_do_not_get_there(spark):
    sized = spark.createDataFrame([(1, "a", 10), (2, "b", 1000)], "doc_id long, source string, size long")
    goal = M.targets(sized)
    assert M.dual_newton(sized, goal).count() == 2
    with pytest.raises(RuntimeError, match="after 1 Newton steps"):
        M.dual_newton(sized, goal, most=1)
