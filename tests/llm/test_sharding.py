from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulse.llm import sharding
from pulse.llm.queries import op7_kd_shards

from . import data


def shard(docs, shards, **more):
    text = F.coalesce("text", F.lit(""))
    return sharding.kd_shards(docs, F.octet_length(text).cast("long") + 16, {"len": F.log2(F.length(text) + 1.0), "n": F.col("n_chars")},
                              text, [F.col("doc_id")], shards=shards, **more).collect()


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_every_row_has_a_shard_and_a_slot(llm, shards):
    got = shard(data.docs(llm), shards)
    assert len(got) == len(data.rows())
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards and r["size"] == len((r["row"]["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_bytes_are_near_equal_with_a_hot_group(llm):
    docs = llm.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(
        F.repeat(F.lit("w "), (F.xxhash64("id") % 50 + 60).cast("int"))).alias("text"), F.col("id").alias("n_chars"))
    got = shard(docs.withColumn("n_chars", F.lit(None).cast("long")), 8)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(x - mean) for x in sizes.values()) < 0.02 * mean


def test_query(llm):
    got = op7_kd_shards(llm, "/root/testdata/sf0.01").collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert sorted(sizes) == list(range(40)) and max(sizes.values()) < 1.15 * sum(sizes.values()) / 40


def test_empty_table(llm):
    assert shard(data.empty(llm), 4) == []
