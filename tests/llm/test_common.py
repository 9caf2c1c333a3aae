from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from textloom.llm import common as m


@pytest.fixture()
def tables(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.xxhash64("id").alias("h"), F.lit("text").alias("text"))
    keys = spark.range(0, 3000, 7).union(spark.range(5000, 5100)).select(F.col("id").alias("key"), F.xxhash64("id").alias("kh"), (F.col("id") * 2).alias("more"))
    return rows, m.written(keys, "keys")


def test_sieve_drops_no_key_and_holds_back_most_others(tables):
    rows, keys = tables
    maybe, rest = (sorted(r.k for r in x.collect()) for x in m.sieve(rows, "h", keys, "kh", keys.count()))
    assert sorted(maybe + rest) == list(range(3000))
    assert {k for k in range(3000) if k % 7 == 0} <= set(maybe)
    assert len(maybe) < 600


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_looked_up_is_the_join(tables, how):
    rows, keys = tables
    on = (F.col("h") == F.col("kh")) & (F.col("k") == F.col("key"))
    want = rows.join(keys, on, how)
    for few in (0, None):
        got = m.looked_up(rows, "h", keys, "kh", on, how, few)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_sieve_without_keys(tables):
    rows, keys = tables
    assert m.looked_up(rows, "h", keys.limit(0), "kh", F.col("h") == F.col("kh"), "left_anti", -1).count() == 3000


def test_written_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, conf = shuffled(), spark.conf.get(m.CLEANUP, None)
    table = m.written(spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(m.CLEANUP, None) == conf
    assert table.count() == 10
