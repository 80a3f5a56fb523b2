import math
import os
import re
import sys
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline as P  # noqa: E402
from barframe.llm import queries as Q  # noqa: E402
from barframe.llm import toxicity as T  # noqa: E402
from test_dedup_and_mix import SPACE, water  # noqa: E402
from test_pages_vectors_join import brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def brute_mix(rows):
    """doc_id -> copies, for (doc_id, source, size)."""
    sizes, groups = defaultdict(int), defaultdict(list)
    for i, s, n in rows:
        sizes[s] += n
        groups[s].append((n, i))
    goal, out = water(sizes), {}
    for s, members in groups.items():
        rate = 1.0 if sizes[s] == 0 else round(goal[s] / sizes[s], 9)
        part = rate - math.floor(rate)
        for k, (_, i) in enumerate(sorted(members), 1):
            out[i] = math.floor(rate) + math.floor(k * part + 0.5) - math.floor((k - 1) * part + 0.5)
    return out


def test_the_pipeline_equals_its_parts_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    toxic = {r.doc_id for r in T.toxicity(table, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    left = {i: r for i, r in docs.items() if i not in toxic}
    groups = defaultdict(list)
    for i, r in left.items():
        groups[SPACE.sub("", r.text or "")].append((-len(r.text or ""), i))
    left = {min(g)[1]: docs[min(g)[1]] for g in groups.values()}
    near = brute_components([(i, r.text) for i, r in left.items()], 5, 80)
    left = {i: r for i, r in left.items() if near[i][1] == i}
    copies = brute_mix([(i, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for i, r in left.items()])
    want = Counter({i: c for i, c in copies.items() if c})
    out = P.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == want and toxic
    assert all(r.lossless for r in out)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "source_mix", "sampled_pieces"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLE) <= set(Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_statement(spark, name):
    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    import oracle_check

    assert oracle_check.compare(Q.QUERIES[name](spark, SF), oracle_check.connect(SF), Q.ORACLE[name]) == []
