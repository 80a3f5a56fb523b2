import random

import pytest

from barframe.operators import log as L
from barframe.operators import log_index as Ix

SCHEMA = (
    "record_id long, timestamp string, slate_id string, asset string, strategy_family string, assets array<string>, "
    "lookback int, top_k int, rebalance int"
)
ASSETS = ["AAA", "BBB", "BTC-USD", "two words", "aaa", "A"]
FAMILIES = ["dual_momentum", "momentum", "fx_carry", None]
TEXTS = ["aaa", "AAA bbb", "s1", " S3 ", "record-7", "momentum", "dual_mom", "btc", "btc-usd momentum", "two words", "aaa momentum x", "nothing", "[", "a", "", "portfolio[aaa", "aaa,bbb"]


def records(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        assets = rng.choice([None, [], [None], rng.sample(ASSETS, 1), rng.sample(ASSETS, 2)])
        slate = rng.choice([None, "S1", "S2", "S3", "s 4"])
        asset = rng.choice([None, f"PORTFOLIO[{','.join(a or '' for a in assets or [])}]", "AAA"])
        rows.append((seed * 1000 + i % 40, f"2020-01-{1 + i % 28:02d}", slate, asset, rng.choice(FAMILIES), assets, rng.choice([None, 5]), 1, 21))
    return rows


@pytest.fixture(scope="module", autouse=True)
def few_folders():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Ix, "SHARDS", 4)
        yield


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("log")
    parts = [spark.createDataFrame(records(n, seed), SCHEMA) for n, seed in ((60, 1), (25, 2))]
    read = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{at}/log")
        read.append(Ix.extend(spark.readStream.schema(SCHEMA).parquet(f"{at}/log"), f"{at}/index", f"{at}/state"))
    read.append(Ix.extend(spark.readStream.schema(SCHEMA).parquet(f"{at}/log"), f"{at}/index", f"{at}/state"))
    return spark.read.schema(SCHEMA).parquet(f"{at}/log"), f"{at}/index", read


def test_only_appended_records_are_read(indexed):
    assert indexed[2] == [60, 25, 0]


@pytest.mark.parametrize("text", TEXTS)
def test_index_and_scan_give_the_same_rows(spark, indexed, text):
    log, path, _ = indexed
    assert Ix.search_index(spark, path, text).collect() == L.search(log, text).collect()


def test_a_batch_written_again_changes_nothing(spark, indexed, tmp_path):
    log, _, _ = indexed
    for _ in range(2):
        Ix.write_batch(log, f"{tmp_path}/i", 0)
    assert Ix.search_index(spark, f"{tmp_path}/i", "aaa").collect() == L.search(log, "aaa").collect()


def test_empty_index_and_pruned_scan(spark, indexed, tmp_path):
    assert Ix.search_index(spark, f"{tmp_path}/none", "aaa").collect() == []
    Ix.write_batch(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e", 0)
    assert Ix.search_index(spark, f"{tmp_path}/e", "aaa").collect() == []
    plan = Ix.search_index(spark, indexed[1], "aaa bbb")._jdf.queryExecution().toString()
    assert plan.count("dynamicpruning") > 1
