import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import brute as classes
from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    g = random.Random(9)
    word = lambda: "".join(g.choice(["er", "ti", "an", "ö", "sh", "lo"]) for _ in range(g.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(g.randint(20, 120))) for i in range(200)]
    passage, leak = text(40), text(15)
    for i in range(200, 260):
        t = text(50)
        docs.append((i, t + " " + (passage if i % 3 == 0 else leak if i % 7 == 0 else "you idiot trash" if i % 5 == 0 else "") + " " + text(30)))
    docs += [(300 + i, docs[i][1]) for i in range(20)] + [(400, docs[30][1] + " more"), (500, None), (501, "")]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in docs] + [(1000 + i, 1, i % 2) for i in range(300)]
    docs += [(1000 + i, text(60) + (" idiot" if i % 2 else "")) for i in range(300)]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "web", len(t or "")) for i, t in docs]
    # Columns that stages could take for their own are kept as they are.
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.selectExpr("*", "'x' AS ids", "1 AS decoded", "2 AS c0", "3 AS score", "4 AS kept", "5 AS n_hit", "6 AS id").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(docs), leak


def test_stages_one_by_one(spark, tables, tmp_path):
    folder, texts, leak = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    toxic = {r.doc_id for r in QUERIES["op4_toxicity"](spark, folder).where("predicted = 1").collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns[: len(names)] == names and (out.columns == names or k == 4)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
    assert len(toxic) > 100 and set(kept[0]) == set(texts) - toxic
    left = {i: r.text for i, r in kept[0].items()}
    of = classes(sorted(left.items()))
    assert set(kept[1]) == {i for i, c in of.items() if i == c}
    least = {}
    for i, r in sorted(kept[1].items()):
        raw = (r.text or "").encode()
        for j in range(len(raw) - 49):
            least.setdefault(raw[j : j + 50], i)
    for i, r in kept[1].items():
        raw = (r.text or "").encode()
        gone = {x for j in range(len(raw) - 49) if least[raw[j : j + 50]] < i for x in range(j, j + 50)}
        starts = [x for x, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
        want = b"".join(raw[x:y] for x, y in zip(starts, starts[1:], strict=False) if gone.isdisjoint(range(x, y))).decode()
        assert (kept[2][i].text or "") == want and kept[2][i].n_chars == len(want)
    assert set(kept[2]) == set(kept[1])
    hold = {i for i, r in kept[2].items() if any(" ".join(w) in (r.text or "") for w in (leak.split()[j : j + 10] for j in range(6)))}
    assert hold and set(kept[3]) == set(kept[2]) - hold
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_truncation()
    for r in kept[4].values():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids_ == ids and r.decoded_ == library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.c0, r.score, r.kept, r.n_hit, r.id) == ("x", 1, 2, 3, 4, 5, 6)
    assert set(kept[4]) == set(kept[3]) and {500, 501} <= set(kept[4])
    run = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r for r in run} == kept[4]


def test_empty_documents(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
