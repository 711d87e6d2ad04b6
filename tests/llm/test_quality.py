import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import quality
from tidemark.llm.queries import QUERIES


def test_marginals_equal_enumeration():
    g = np.random.default_rng(0)
    emission, transition = g.normal(size=9), g.normal(size=(2, 2))
    first = np.array([0, 4, 4, 5, 9])
    good, pairs, z = quality.marginals(emission, first, transition)
    want, all_pairs, total = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        paths = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([np.exp(sum(emission[a + i] * y for i, y in enumerate(p)) + sum(transition[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        for p, v in zip(paths, w / w.sum(), strict=True):
            want[a:b] += v * np.array(p)
            for x, y in itertools.pairwise(p):
                all_pairs[x, y] += v
        total += np.log(w.sum())
    assert np.allclose(good, want) and np.allclose(pairs, all_pairs) and np.isclose(z, total)


def test_features_of_a_line_depend_on_its_text_alone():
    texts = ["one line\n\nTWO!!! $$$\n", None, "", "   \n\t", "one line", "x" * 300_000 + "\n" + "a b " * 5000]
    f, size, first = quality.line_features(pa.array(texts))
    assert np.diff(first).tolist() == [2, 0, 0, 0, 1, 2]
    for i, t in enumerate(texts):
        alone, its, _ = quality.line_features(pa.array([t], pa.string()))
        assert np.array_equal(f[first[i] : first[i + 1]], alone) and np.array_equal(size[first[i] : first[i + 1]], its)


def corpus():
    g = random.Random(5)
    good = lambda: ". ".join(" ".join(g.choice(["the", "river", "was", "wide", "and", "slow"]) for _ in range(9)) for _ in range(4)) + ".\n"
    bad = lambda: " ".join(g.choice(["$$$", "BUY", "###", "1234", "||"]) for _ in range(20)) + "\n"
    rows = [(i, "".join((good if i % 3 else bad)() for _ in range(g.randint(1, 6))), i % 3) for i in range(400)]
    docs = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, " \n "), (903, "word " * 200_000), (3, rows[3][1]), (None, "no id")]
    return docs, [(i, int(y > 0), 0) for i, _, y in rows] + [(None, 1, 1), (5000, 1, 0), (4, None, None)]


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "1 as score", "text as t").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_query_held_out_accuracy_and_hard_rows(spark, tmp_path):
    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    rows = QUERIES["op3_quality"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    label = {i: y for i, y, _ in labels if i is not None and i < 400 and y is not None}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 40 and sum(r.predicted == label[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 if r.doc_id is not None else None)
    assert len({r.score for r in rows if r.doc_id in (900, 901, 902)}) == 1


def test_held_out_labels_change_no_score(spark, tmp_path):
    docs, labels = corpus()
    write(spark, tmp_path / "a", docs, labels)
    turned = [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    write(spark, tmp_path / "b", docs, turned)
    a, b = (sorted(tuple(r) for r in QUERIES["op3_quality"](spark, str(tmp_path / d)).where("doc_id is not null").collect()) for d in "ab")
    assert a == b


def test_one_label_or_no_rows(spark, tmp_path):
    write(spark, tmp_path / "a", [(1, "x"), (2, None)], [(1, 1, 0)])
    assert {r.score for r in QUERIES["op3_quality"](spark, str(tmp_path / "a")).collect()} == {1.0}
    write(spark, tmp_path / "b", [], [])
    assert QUERIES["op3_quality"](spark, str(tmp_path / "b")).count() == 0


def test_scores_equal_enumeration(spark, tmp_path):
    """The query's score is the length-weighted mean of marginals over all label paths of a document's lines."""
    from pyspark.sql import functions as F

    from tidemark.llm.labelled import remainder

    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    rows = spark.createDataFrame(docs, "id long, t string")
    model, share = quality.fit(rows, spark.read.parquet(f"{tmp_path}/labels.parquet"), remainder(F.col("id"), 5) != 0)
    got = {r.doc_id: r.score for r in QUERIES["op3_quality"](spark, str(tmp_path)).where("doc_id is not null").collect()}
    for i, t in docs[:60]:
        f, size, _ = quality.line_features(pa.array([t]))
        e = [float(((x - model.mean) / model.scale) @ model.w[:-1] + model.w[-1]) for x in f]
        total = good = 0.0
        for path in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(sum(v * y for v, y in zip(e, path, strict=True)) + sum(model.transition[a, b] for a, b in itertools.pairwise(path)))
            total += w
            good += w * float(size @ np.array(path))
        assert np.isclose(got[i], good / total / size.sum(), atol=1e-6)
    assert got[901] == share


def test_gradient_equals_differences():
    g = np.random.default_rng(3)
    f, first, y = g.normal(size=(12, 3)).astype(np.float32), np.array([0, 5, 5, 6, 12]), np.array([1, 0, 0, 1])
    plain = quality.Crf(np.zeros(3), np.ones(3), np.zeros(0), np.zeros((2, 2)))
    theta = g.normal(size=8)
    got = plain.at(theta).likelihood(y, f, first)
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        rise = plain.at(theta + step).likelihood(y, f, first)[0] - plain.at(theta - step).likelihood(y, f, first)[0]
        assert np.isclose(got[1 + k], rise / 2e-5, atol=1e-4)


def test_junk_far_down_a_long_text_is_learned(spark):
    """Bad documents that begin with thousands of good lines: only what comes after tells them apart."""
    from pyspark.sql import functions as F

    g = random.Random(2)
    line = lambda: " ".join(g.choice(["the", "river", "was", "wide"]) for _ in range(9)) + ".\n"
    docs = [(i, "".join(line() for _ in range(600)) + ("$$$ BUY ### || 1234\n" * 900 if i % 2 else line())) for i in range(24)]
    rows = spark.createDataFrame(docs, "id long, t string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, quality int")
    model, share = quality.fit(rows, labels, F.lit(True))
    f, _, first = quality.line_features(pa.array(["$$$ BUY ### || 1234\n" * 3, line() * 3]))
    good = model.lines(f, first)
    assert good[:3].max() < 0.3 < 0.5 < good[3:].min() and share == 0.5
