"""What the Python workers of the pipeline hold, and what they give back."""

import inspect
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from barframe.llm import ngram_join as J
from barframe.llm import shingles as S
from barframe.llm import toxicity as T
from barframe.llm import workers as W

HELD = """
import sys
sys.path.insert(0, {root!r})
from barframe.llm import workers as W

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

pins = []
def run(batches):
    for n in batches:
        made = [bytearray(2000) for _ in range(n)]
        pins.append(made[-1])  # at the top of the heap, so that it cannot simply shrink
        print(mb())
        yield n

assert list(({call})([50_000])) == [50_000]
print(mb())
"""


@pytest.mark.skipif(W._trim() is None or not os.path.exists("/proc/self/statm"), reason="no malloc_trim")
def test_an_idle_worker_holds_none_of_what_it_freed():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", HELD.format(root=root, call="W.lean(run)")], capture_output=True, text=True, check=True, timeout=120)
    most, left = map(float, out.stdout.split())
    assert most - left > 60


def test_memory_is_given_back_after_the_last_batch_and_after_a_failure(monkeypatch):
    given = []
    monkeypatch.setattr(W, "give_back", lambda: given.append(1))
    assert list(W.lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4] and given == [1]
    with pytest.raises(ZeroDivisionError):
        list(W.lean(lambda batches: (1 // b for b in batches))([0]))
    assert given == [1, 1]


@pytest.mark.parametrize("made", [J.profile, J.class_keys, J.paired, J.verified, J.tiles])
def test_every_task_of_the_join_gives_its_memory_back(made):
    assert "(lean(run)" in inspect.getsource(made)


def test_the_sets_of_a_column_are_those_of_its_texts():
    texts = [None, "", "A b", *[f"w{i} w{i + 1} w{i % 7} Ä" * (i % 5) for i in range(2 * S.ROWS + 3)]]
    column = pa.array(["cut", *texts]).slice(1)
    got, want = list(S.batch_sets(column, 4)), list(S.shingle_sets(texts, 4))
    assert len(got) == len(texts) and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert list(S.batch_sets(pa.array([], pa.string()), 4)) == []


def test_classes_of_one_batch_come_once_though_its_rows_are_cut(spark):
    n = 3 * S.ROWS
    docs = spark.createDataFrame([(f"a b c d e f{i % (2 * S.ROWS)}",) for i in range(n)], "text string").coalesce(1)
    rows = J.class_keys(docs, np.zeros(0, dtype=np.uint64), 4, 85, "text").filter("key IS NULL").collect()
    assert len(rows) == len({r.cls for r in rows}) == 2 * S.ROWS


@pytest.fixture
def batch_of(spark):
    """Sets the rows of a batch, and puts the setting back."""
    before = spark.conf.get(P.BATCH_KEY)
    yield lambda n: spark.conf.set(P.BATCH_KEY, str(n))
    spark.conf.set(P.BATCH_KEY, before)


@pytest.mark.parametrize("given, most", [(10_000, P.BATCH), (0, P.BATCH), (7, 7)])
def test_a_stage_hands_its_workers_few_rows_at_once(spark, batch_of, given, most):
    rows = [(i, f"text {i}", "en", "web") for i in range(3 * P.BATCH)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    for stage in (P.drop_copies, P.mix_sources):
        batch_of(given)
        left = stage(spark, docs, "").select("doc_id").coalesce(1)
        sizes = left.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) == most
    assert all(stage.__wrapped__ for _, stage in P.STAGES)


def test_the_pipeline_puts_the_batch_size_back(spark, batch_of, tmp_path):
    batch_of(4321)
    docs = spark.createDataFrame([(i, f"a text of {i}", "en", "web") for i in range(5)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    P.run(spark, str(tmp_path))
    assert spark.conf.get(P.BATCH_KEY) == "4321"


def test_repeated_shingles_are_counted_over_all_batches_of_a_task(spark, batch_of):
    docs = spark.createDataFrame([(i, f"a b c d {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    for n in (10_000, 7, 1):
        batch_of(n)
        rows = J.profile(docs, 4, "doc_id", "text").collect()
        assert [r.times for r in rows if r.shingle is not None] == [40]
        assert sorted(r.doc_id for r in rows if r.shingle is None) == list(range(40))


def test_repeated_shingles_where_their_hashes_do_not_fit_at_once(monkeypatch):
    texts = [" ".join(f"w{j}" for j in range(n)) for n in (5, 9, 30, 5, 9)]
    batch = pa.record_batch([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"])
    taken = {}

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, shape):
            taken["run"] = run

    monkeypatch.setattr(J, "HELD", 10)
    monkeypatch.setattr(J.F, "col", lambda c: Column())
    J.profile(Rows(), 4, "doc_id", "text")
    out = pa.Table.from_batches(taken["run"](iter([batch, batch])))
    found = [r for r in out.to_pylist() if r["shingle"] is None]
    assert [r["n"] for r in found] == [2, 6, 27, 2, 6] * 2
    times = {}
    for r in out.to_pylist():
        if r["shingle"] is not None:
            times[r["shingle"]] = times.get(r["shingle"], 0) + r["times"]
    assert len(times) == 6 and all(2 <= n <= 10 for n in times.values())


class Column:
    def cast(self, kind):
        return self

    def alias(self, name):
        return self


def test_a_class_comes_once_over_all_batches_of_a_task(spark, batch_of):
    batch_of(3)
    docs = spark.createDataFrame([(f"a b c d e f{i % 5}",) for i in range(40)], "text string").coalesce(1)
    rows = J.class_keys(docs, np.zeros(0, dtype=np.uint64), 4, 85, "text").filter("key IS NULL").collect()
    assert len(rows) == len({r.cls for r in rows}) == 5


def test_terms_are_summed_alike_in_batches_of_any_size(spark, batch_of):
    texts = spark.createDataFrame([(f"word{i % 3} all", i % 2) for i in range(30)], "text string, toxic int").coalesce(1)
    found = []
    for n in (10_000, 4):
        batch_of(n)
        found.append(sorted(T.counted(texts, lambda folded: set(folded.split())).collect()))
    assert found[0] == found[1] and ("aii", 15, 15) in found[0]
