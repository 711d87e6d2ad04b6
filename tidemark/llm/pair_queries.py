"""The registered queries of operators 11 to 13, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import collocation, jaccard_join, periodic
from tidemark.llm.queries import ORACLES, query, table


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, whose words from some place on are one stretch over and over in a tenth of the rows.

    Rows without an id are left as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                h = crc32(str(i).encode())
                if i is not None and h % 10 == 0 and text and (words := text.encode().split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    stretch = words[a : a + p]
                    text = b" ".join([*words[:a], *(stretch * -(-(n - a) // p))[: n - a]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(_with_planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    start, length, period = (F.col(f"strongest.{c}") for c in ("start", "length", "period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLES["op13_periodic_runs"] = r"""
WITH o AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), CAST(range(1, 9) AS UBIGINT[])), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS c
  FROM documents
), h AS (
  SELECT doc_id, w, len(w) AS n, xor(c, 4294967295::UBIGINT)::BIGINT AS h FROM o
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h
), p AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a
), d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE w[1 : a] || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) END AS w FROM p
), t AS (
  SELECT doc_id, n, unnest(w) AS v, unnest(range(0, n)) AS i FROM d
), m AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.v = y.v AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), g AS (
  SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM m
), s AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)
), r AS (
  SELECT doc_id, start, length::BIGINT AS length, min(q) AS period FROM s GROUP BY doc_id, start, length
), b AS (
  SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length::DOUBLE / period DESC, start, period) AS best,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM r GROUP BY doc_id
), x AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), c AS (
  SELECT t.doc_id, string_agg(v, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN x ON t.doc_id = x.doc_id AND t.i = x.i GROUP BY t.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100
), s AS (
  SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w, k FROM c
), t AS (
  SELECT s.lang, s.phrase, s.a, s.cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * s.a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM s JOIN n USING (lang) JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(w[1 : cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[cut + 1 : s.k], ' ')
), b AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), o AS (
  SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND len(c.w) > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY rank <= 2000
"""


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.contract(table(spark, sf_dir, "documents"))


ORACLES["op11_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), l AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT DISTINCT x AS doc_id, x AS seen FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.seen = l.x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) c USING (doc_id)
"""
