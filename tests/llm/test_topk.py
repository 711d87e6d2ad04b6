import math

import numpy as np
import pyarrow as pa

from tidemark.llm import topk
from tidemark.llm.queries import QUERIES


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok if c != q)[:k]
            out += [(q, r, c, -x) for r, (x, c) in enumerate(s, 1)]
    return sorted(out)


def test_query_equals_brute_force(spark, tmp_path):
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in g.normal(0, 0.1, 8).astype(np.float32)]) for i in range(400)]
    rows += [(i, [0.5] + [0.0] * 7) for i in range(400, 600)]  # ties and sparse rows
    rows += [(600, None), (601, [float("nan")] * 8), (602, [None] + [0.1] * 7), (603, [float("inf")] * 8), (650, [0.25] * 3), (700, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op9_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_many_blocks_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rows = [(i, [float(i % 5) / 8, 0.5, -0.25]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as score")
    got = sorted(tuple(r) for r in topk.contract(df, every=7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, every=7)
    assert topk.contract(df.where("vec_id < 3")).count() == 2
    assert topk.contract(df.limit(0)).count() == 0


def test_components_of_any_size(spark):
    """Products beyond 64 bits are neither cut nor wrapped; the best scores of these rows fit."""
    big = 3e38
    rows = [(0, [big, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [-big, 5.0]), (4, [-big, 9.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    known = df.where("vec_id not in (0, 50)").select("vec_id", topk.quantized(df["embedding"]).alias("v"))
    got = sorted(tuple(r) for r in topk.search(known.where("vec_id in (1, 2)"), known, 2, "v", "vec_id").select("query_id", "rank", "vec_id", "score").collect())
    assert got == [r for r in brute([r for r in rows if r[0] not in (0, 50)], k=2, every=1) if r[0] in (1, 2)]
    q, c = (pa.table({"id": pa.array([i for i, _ in part]), "v": pa.array([v for _, v in part], pa.list_(pa.float64()))}) for part in ([(9, [2.0**70, 1.0])], [(1, [-(2.0**70), 3.0]), (2, [0.0, 7.0]), (3, [0.0, 5.0])]))
    assert topk.cell(q, c, 2).to_pylist() == [{"query_id": 9, "vec_id": 2, "score": 7}, {"query_id": 9, "vec_id": 3, "score": 5}]
