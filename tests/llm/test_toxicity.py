import random
import zlib

from tidemark.llm import toxicity
from tidemark.llm.queries import QUERIES


def test_features_by_hand():
    f = toxicity.features("You are an IDIOT!! Far away from here stands a lone tr4sh can", {"far": 2.0})
    assert len(f) == toxicity.N_FEATURES
    assert f[0] == 1 and f[2] == 1 and f[4] == 2.0 and f[7] == 1  # one fixed word, one learned word
    assert f[8] == 2  # "idiot" and "far" are within five words of "you"
    assert f[15] == 1  # "tr4sh"
    assert toxicity.features("", {}) == toxicity.features(" !? ", {}) == [0.0] * toxicity.N_FEATURES
    assert toxicity.features("idiot far far away", {})[8] == 0


def corpus():
    g = random.Random(6)
    words = ["river", "stone", "you", "house", "green", "slow", "walk", "Über", "niño"]
    rows = []
    for i in range(900):
        w = [g.choice(words) for _ in range(g.randint(5, 200))]
        if i % 4 == 0:
            for _ in range(g.randint(1, 4)):
                w[g.randrange(len(w))] = g.choice(["idiot", "snark", "trash", "m0ron"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = [(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (2002, "!?"), (2003, "river " * 300_000 + "idiot"), (8, rows[8][1]), (None, "you idiot")]
    return docs, [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7000, 0, 1), (9, None, None)]


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "1 as score", "text as t", "'f' as f", "doc_id as id").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_query_held_out_accuracy_and_hard_rows(spark, tmp_path):
    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    rows = QUERIES["op4_toxicity"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    label = {i: y for i, _, y in labels if i is not None and i < 900 and y is not None}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 100 and sum(r.predicted == label[r.doc_id] for r in held) >= 0.93 * len(held)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else None)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (2000, 2001, 2002))


def test_reject_keeps_clean_rows_with_their_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.llm.labelled import remainder

    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = toxicity.reject(df, spark.read.parquet(f"{tmp_path}/labels.parquet"), remainder(F.col("id"), 4) != 2)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    left = {r.doc_id: r for r in kept.collect()}
    scored = {r.doc_id: r.predicted for r in QUERIES["op4_toxicity"](spark, str(tmp_path)).collect()}
    assert set(left) == {i for i, p in scored.items() if not p}
    assert all(r.text == r.t and r.id == i for i, r in left.items())


def test_one_label_or_no_rows(spark, tmp_path):
    write(spark, tmp_path / "a", [(1, "x"), (2, None)], [(1, 1, 1)])
    assert {r.score for r in QUERIES["op4_toxicity"](spark, str(tmp_path / "a")).collect()} == {1.0}
    write(spark, tmp_path / "b", [], [])
    assert QUERIES["op4_toxicity"](spark, str(tmp_path / "b")).count() == 0


def test_scores_equal_trees_and_curve_by_hand(spark, tmp_path):
    """The query's score is the calibrated probability of the trees, walked node by node, over features counted slowly."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.llm.labelled import remainder

    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    rows = spark.createDataFrame(docs, "id long, t string")
    model = toxicity.train(rows, spark.read.parquet(f"{tmp_path}/labels.parquet"), remainder(F.col("id"), 4) != 2)

    def walk(node, f):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return walk(node.leftChild() if f[split.featureIndex()] <= split.threshold() else node.rightChild(), f)

    roots = [t._call_java("rootNode") for t in model.trees.trees]
    x, y = (np.array(v) for v in (model.curve.boundaries, model.curve.predictions))
    got = {r.doc_id: r.score for r in QUERIES["op4_toxicity"](spark, str(tmp_path)).where("doc_id is not null").collect()}
    for i, t in docs:
        if i is not None and (i % 7 == 0 or i >= 2000):
            f = toxicity.features(t or "", model.learned)
            margin = sum(w * walk(r, f) for w, r in zip(model.trees.treeWeights, roots, strict=True))
            p = 1 / (1 + np.exp(-2 * margin))
            assert np.isclose(got[i], min(1, max(0, 0.999 * np.interp(p, x, y) + 0.001 * p)), atol=1e-9)


def test_lexicon_has_no_cap(spark):
    """Every one of 3,000 words that only toxic texts have is learned."""
    g = random.Random(1)
    own = ["".join(g.choice("abcdefgh") for _ in range(9)) for _ in range(3000)]
    rows = [(i, " ".join(own), 1) for i in range(4)] + [(i, "plain words here", 0) for i in range(4, 12)]
    learned = toxicity._lexicon(spark.createDataFrame(rows, "id long, t string, y int"))
    assert set(own) <= set(learned)


def test_capitals_of_other_alphabets():
    assert toxicity.capitals("ÄÖü Ñandú ПРИвет ABC \U0001d400") == 2 + 1 + 3 + 3
