import struct
import zlib
from math import log

import xxhash

from tidemark.llm import sharding
from tidemark.llm.queries import QUERIES


def brute(key, weights):
    def draw(i):
        h = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest() if key is not None else 42
        h = xxhash.xxh64(struct.pack("<i", i), seed=h).intdigest()
        return -log(((h >> 11) + 0.5) / 2**53) / weights[i]

    return min(range(len(weights)), key=draw)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, ["same text", f"é{i}", None, ""][i % 4]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_sharding"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    slots = {}
    for i, text in rows:
        raw = (text or "").encode()
        r = got[i]
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == brute(i, [1.0] * 40) and r.grown_shard == brute(i, [1.0] * 41)
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_moves(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    two = sharding.assign(df, [1.0, 3.0], "k")
    share = two.where("shard = 1").count() / 20000
    assert 0.73 < share < 0.77
    three = sharding.assign(two, [1.0, 3.0, 2.0], "k", "grown")
    assert three.where("grown <> shard and grown <> 2").count() == 0


def test_odd_inputs(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (5, "x"), (5, "x"), (5, "x")], "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot")
    got = sharding.contract(df).collect()
    assert len(got) == 5
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.shard == brute(r.doc_id, [1.0] * 40)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert sharding.contract(df.limit(0)).count() == 0
    plan = sharding.contract(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
