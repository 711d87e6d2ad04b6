"""Incremental forms: a change feed that commits what it has finished, and a review's state that is kept by key.

A change feed's folder holds ``rows``, ``keys`` (all keys ever seen, in hash buckets) and ``filter`` (a Bloom filter of each
bucket), each by version, and ``commits``. A batch writes a version of all three and then one commit, a small file put in
place by one rename; readers take only committed versions, so rows and keys appear together or not at all, and what a
failed batch has left behind is written over by the next try.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.shared import stored
from tidemark.sources.landing import delete, exists, read_small, write_small

#: Fixed order of the states; a conflict stays.
STATES = ("unverified", "corroborated", "conflict")
#: Hash buckets of seen keys, and 64-bit words of a bucket's filter: some ten bits a key up to 1.6 million keys.
BUCKETS, WORDS = 256, 1024
_HELPERS = ("_hash", "_bucket")


def commits(spark: SparkSession, out: str) -> list[dict[str, Any]]:
    """The commits of a feed in their order."""
    if not exists(spark, f"{out}/commits/*.json"):
        return []
    return sorted((json.loads(r.value) for r in spark.read.text(f"{out}/commits/*.json", wholetext=True).collect()), key=lambda c: c["version"])


def rows(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What a feed has committed."""
    done = commits(spark, out)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_at(out, "rows", c["version"]) for c in done if not c.get("compacted")])


def _at(out: str, what: str, version: int) -> str:
    return f"{out}/{what}/{version:09d}"


def _places(h: Column) -> list[tuple[Column, Column]]:
    """Word and bit of each of the two places of a hash in its bucket's filter."""
    at = [F.pmod(x, F.lit(WORDS * 64)).cast("int") for x in (F.shiftright(h, 8), F.xxhash64(h))]
    return [(F.shiftright(x, 6), F.pmod(x, F.lit(64)).cast("int")) for x in at]


def _bits(keys: DataFrame) -> DataFrame:
    """The filter of keys: ``bucket, word, bits``."""
    place = F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _places(F.col("_hash"))])).alias("p")
    return keys.select(F.col("_bucket").alias("bucket"), place).groupBy("bucket", F.col("p.word").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))


def _suspects(keys: DataFrame, bits: DataFrame) -> DataFrame:
    """Keys that a filter may hold; all others were never seen."""
    for n, (word, bit) in enumerate(_places(F.col("_hash"))):
        own = bits.select(F.col("bucket").alias("_b"), F.col("word").alias("_w"), F.col("bits").alias(f"_bits{n}"))
        keys = keys.withColumn("_word", word).join(own, (F.col("_bucket") == F.col("_b")) & (F.col("_word") == F.col("_w"))).where(F.bit_get(F.col(f"_bits{n}"), bit) == 1).drop("_b", "_w", "_word", f"_bits{n}")
    return keys


def take(batch: DataFrame, key: str, time: str, out: str, run: str, number: int) -> None:
    """Add a batch's rows with new keys to a feed, once each: of a key's rows the first by ``time`` (then by the other
    columns). Rows without a key are all kept: they have nothing to be known by but their batch, so a batch (``run`` and
    ``number``) that is committed is not taken again.

    Of the keys ever seen only those buckets are read whose filter may hold one of the batch's keys.
    """
    spark = batch.sparkSession
    done = commits(spark, out)
    if any(c["run"] == run and c["batch"] == number for c in done):
        return
    version = done[-1]["version"] + 1 if done else 1
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), F.struct(F.col(time).isNull(), F.col(time), *[F.col(f"`{c}`") for c in batch.columns if c not in (key, time)]))
    keyed = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(first.alias("_row")).withColumn("_hash", F.xxhash64("_key")).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(BUCKETS)).cast("int"))
    keyed = stored(keyed)
    new, bits, read = keyed, _bits(keyed), []
    if done:
        known = spark.read.parquet(_at(out, "filter", done[-1]["version"]))
        suspects = stored(_suspects(keyed.select("_key", *_HELPERS), known))
        read = sorted(r[0] for r in suspects.select("_bucket").distinct().collect())  # BUCKETS at most
        if read:
            old = [f"{_at(out, 'keys', c['version'])}/bucket={b}" for c in _with_keys(done) for b in sorted(set(read) & set(c["buckets"]))]
            if old:  # a filter may answer for a bucket that has no keys
                new = stored(keyed.join(spark.read.parquet(*old).select(F.col("key").alias("_key")), "_key", "left_anti"))
        bits = known.unionByName(_bits(new)).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    taken = new.select("_row.*").unionByName(batch.where(F.col(key).isNull()))
    taken.write.mode("overwrite").parquet(_at(out, "rows", version))
    # A bucket is one file: its keys meet in one task, which holds none of them.
    new.select(F.col("_key").alias("key"), F.col("_bucket").alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_at(out, "keys", version))
    bits.write.mode("overwrite").parquet(_at(out, "filter", version))
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    write_small(spark, f"{out}/commits/{version:09d}.json", json.dumps({"version": version, "run": run, "batch": number, "buckets": touched, "read": read}))


def _with_keys(done: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The commits whose keys are read: from the last compaction on, which has those of all before it."""
    return done[max([0, *(i for i, c in enumerate(done) if c.get("compacted"))]) :]


def compact(spark: SparkSession, out: str) -> int:
    """Write the seen keys anew, a file a bucket, so that a batch opens one file for a bucket however many batches have
    written to it; the folders of the old ones are deleted after the commit. How many. Not while a batch is taken."""
    done = commits(spark, out)
    old = _with_keys(done)
    if len(old) < 2:
        return 0
    version = done[-1]["version"] + 1
    paths = [f"{_at(out, 'keys', c['version'])}/bucket={b}" for c in old for b in c["buckets"]]
    keys = spark.read.parquet(*paths)
    keyed = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_at(out, "keys", version))
    spark.read.parquet(_at(out, "filter", done[-1]["version"])).write.mode("overwrite").parquet(_at(out, "filter", version))
    buckets = sorted({b for c in old for b in c["buckets"]})
    write_small(spark, f"{out}/commits/{version:09d}.json", json.dumps({"version": version, "run": None, "batch": None, "compacted": True, "buckets": buckets, "read": buckets}))
    for c in old:
        delete(spark, _at(out, "keys", c["version"]))
    return len(old)


def change_feed(source: DataFrame, key: str, time: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append rows with new keys to the feed ``out`` (``rows`` reads it), however late a row comes. A batch that fails is
    read again, since its offsets are committed after its rows; what it had committed by then is not taken twice."""
    return source.writeStream.foreachBatch(lambda batch, n: take(batch, key, time, out, checkpoint, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verification(evidence: DataFrame, key: str) -> DataFrame:
    """The worst state seen by key; the same over a batch or, in update or complete mode, over a stream. ``evidence``
    has ``state``; states are never taken back."""
    level = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("state")), F.lit(1))
    return evidence.groupBy(key).agg(F.max(level).cast("int").alias("level"), F.count(F.lit(1)).alias("seen")).select(key, F.element_at(F.array(*map(F.lit, STATES)), F.greatest("level", F.lit(1))).alias("state"), "seen")


class _Review(StatefulProcessor):
    """The state of a holding, and its evidence by address in the order in which it came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("review", "state string, urls array<string>, titles array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, urls, titles = self.kept.get() if self.kept.exists() else (STATES[0], [], [])
        urls, titles = list(urls), list(titles)
        known = set(urls)
        for r in pd.concat(list(rows)).sort_values(["ord", "url"], kind="stable").itertuples(index=False):
            # No outcome is no evidence, and a conflict stays until it is resolved where the holdings come from.
            if r.outcome not in STATES[1:] or (r.outcome == STATES[1] and state == STATES[2]):
                continue
            state = r.outcome
            if isinstance(r.url, str) and r.url.startswith(("http://", "https://")) and r.url not in known:
                known.add(r.url)
                urls.append(r.url)
                titles.append(r.title if isinstance(r.title, str) else None)
        self.kept.update((state, urls, titles))
        yield pd.DataFrame({"holding": [key[0]], "verification": [state], "urls": [urls], "titles": [titles]})

    def close(self) -> None:
        pass


#: What a review's state is given out as.
REVIEW = "holding {kind}, verification string, urls array<string>, titles array<string>"


def reviewed(found: DataFrame) -> DataFrame:
    """The state of each holding after each batch of a stream of search outcomes: ``holding``, ``verification`` (unverified,
    corroborated or conflict; a conflict stays), ``urls`` and ``titles`` of its evidence, each address once. ``found``:
    ``holding, ord, outcome, url, title``, taken in the order of ``ord`` within a batch. The state is kept by key in the
    stream's state store and survives a restart from its checkpoint. Needs the RocksDB store (``with_state_store``)."""
    kind = found.schema["holding"].dataType.simpleString()
    rows = found.select("holding", "ord", "outcome", "url", "title")
    return rows.groupBy("holding").transformWithStateInPandas(statefulProcessor=_Review(), outputStructType=REVIEW.format(kind=kind), outputMode="Update", timeMode="None")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def review_stream(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the state of the holdings of each batch to ``out``; a batch that is read again writes over its own rows."""
    with_state_store(found.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reviewed(found).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_review(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each holding."""
    states = spark.read.parquet(out)
    own = [c for c in states.columns if c != "batch"]
    return states.groupBy("holding").agg(F.max_by(F.struct(*[c for c in own if c != "holding"]), "batch").alias("r")).select("holding", "r.*")


def last_commit(spark: SparkSession, out: str) -> dict[str, Any]:
    """The last commit of a feed: its version, the buckets that it has read and those that it has written."""
    done = commits(spark, out)
    return json.loads(read_small(spark, f"{out}/commits/{done[-1]['version']:09d}.json") or "{}") if done else {}
