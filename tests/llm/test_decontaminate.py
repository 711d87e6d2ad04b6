import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for win, ids in windows.items():
            n = len(win)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == win:
                    hit.update(range(k, k + n))
                    found |= ids
        ids = sorted(map(str, found))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases():
    g = random.Random(5)
    vocab = ["Alpha", "beta", "Été", "d4", "x", "yz", "ñandú", "ß"]
    text = lambda n: g.choice([" ", ", ", "\n"]).join(g.choice(vocab) for _ in range(n))
    items = [(i, text(g.randint(1, 30))) for i in range(12)] + [(100, "beta beta x yz d4 x x"), (101, None), (102, "..."), (None, "x"), (103, text(14))]
    items.append((104, items[-1][1]))
    docs = [(i, text(g.randint(0, 60))) for i in range(60)]
    docs += [(60 + i, f"{text(5)} {items[i % 12][1].upper()} {text(7)}") for i in range(24)]
    docs += [(90, None), (91, ""), (92, "!!! ???"), (93, (items[3][1] + " ") * 300), (93, (items[3][1] + " ") * 300), (94, items[-1][1].replace(" ", "\x00"))]
    return docs, items


def frames(spark, cases):
    docs = spark.createDataFrame(cases[0], "doc_id long, text string")
    return docs, spark.createDataFrame(cases[1], "item_id long, text string")


def test_query_equals_brute_force(spark, tmp_path, cases):
    docs, items = frames(spark, cases)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r) for r in QUERIES["op5_decontaminate"](spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == brute(*cases)


def test_many_tasks_give_the_same(spark, cases, monkeypatch):
    docs, items = frames(spark, cases)
    key = lambda df: sorted(map(str, df.select("doc_id", "n_words", "n_hit", "items").collect()))
    whole = key(decontaminate.mark(docs, items))
    monkeypatch.setattr(decontaminate, "TASK_BYTES", 500)
    assert key(decontaminate.mark(docs.repartition(5), items.repartition(5))) == whole


def test_the_plan_does_not_grow_with_the_benchmark(spark, cases):
    docs, _ = frames(spark, cases)

    def plan(items):
        df = decontaminate.contract(docs, spark.createDataFrame(items, "item_id long, text string"))
        return df._jdf.queryExecution().executedPlan().toString()

    many = [(i, f"word{i} " * 3 + " ".join(f"w{i * 7 + k}" for k in range(200))) for i in range(3000)]
    small, large = (plan(x) for x in (many[:3], many))
    shape = lambda p: re.sub(r"#\d+L?|plan_id=\d+|\S*tidemark-\S*|\d+", "", p)
    assert shape(small) == shape(large) and not re.search("MapInArrow|InArrow", large)  # all Python work is done and stored


def test_a_very_long_text(spark):
    g = random.Random(1)
    w = [f"w{g.randrange(10**5)}" for _ in range(700_000)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w[650_000:650_030])), (2, " ".join(w[:9]) + " else")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.mark(docs, items).collect()}
    assert got == {1: (700_000, 30, [1]), 2: (1, 0, [])}


def test_clean_keeps_columns_that_clash(spark, cases):
    docs, items = frames(spark, cases)
    wide = docs.selectExpr("doc_id", "text", "1 as n_hit", "2 as items", "3 as n_words")
    kept = decontaminate.clean(wide, items)
    assert kept.columns == wide.columns
    assert kept.count() == sum(not r[-1] for r in brute(*cases))
    assert decontaminate.clean(wide.limit(0), items).count() == 0
    assert decontaminate.clean(wide, items.limit(0)).count() == docs.count()
