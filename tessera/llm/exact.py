"""Exact deduplication with disk-backed streaming state.

Rows are digested once; a Structured Streaming query keeps, in RocksDB state
without expiry, for each digest the stable identifier and the content locator
(file and row) of the row that stays, and the number of rows.  The aggregation
sums map-side first, so a text that a third of all rows share costs one state
update a task.  Digests that were hit twice or more are then checked on full
bytes, and texts that only share a digest are told apart.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.llm.common import Work, release, slices_of, texts_of

ROW = "doc_id long, file string, row long"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # state that no query uses any more is unloaded then
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves about 4 MB of disk before it holds a row
}


def with_locators(work: Work, df: DataFrame) -> DataFrame:
    """df with __file and __row, each row's content locator; what no file scan gave is written first."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return with_locators(work, work.cut(df, "input"))


def _digests(bits: int, with_body: bool, bloom: np.ndarray | None = None):
    """Rows with the digest of their text, its first `bits` bits, and with the SHA-256 that a shorter digest
    lacks, or the text itself; a few megabytes of text at a time."""

    def run(batches):
        release()
        for batch in batches:
            at = 0
            for texts in slices_of(batch.column("text")):
                rows, at = batch.slice(at, len(texts)), at + len(texts)
                bodies = [t.lower() for t in texts_of(rows)]
                full = [hashlib.sha256(b).digest() for b in bodies]
                keys = full if bits >= 256 else [(int.from_bytes(k[:8], "big") >> (64 - bits)).to_bytes(8, "big") for k in full]
                cols = {c: rows.column(c) for c in ("doc_id", "file", "row")} | {"digest": pa.array(keys, pa.binary())}
                if with_body:
                    cols["body"] = pa.array(bodies, pa.binary())
                elif bits < 256:
                    cols["sha"] = pa.array(full, pa.binary())
                out = pa.RecordBatch.from_pydict(cols)
                yield out if bloom is None else out.filter(pa.array(_maybe(bloom, keys)))

    return run


def _spots(keys: list[bytes], bits: int) -> np.ndarray:
    """Four bit numbers in a filter of `bits` bits (a power of two) for each digest."""
    h = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys), dtype="<u4").reshape(-1, 4)
    return h & np.uint32(bits - 1)


def _maybe(bloom: np.ndarray, keys: list[bytes]) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    s = _spots(keys, len(bloom) * 64).astype(np.int64)
    return ((bloom[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def _bloom(hits: DataFrame, n: int, most_bits: int = 1 << 26) -> np.ndarray:
    """A filter of the digests that were hit, 8 MB at most whatever the input:
    beyond its size it only lets more rows through to the exact check."""
    bits = 1 << 10
    while bits < min(16 * n, most_bits):
        bits *= 2

    def run(batches):
        for batch in batches:
            s = np.unique(_spots(batch.column("digest").to_pylist(), bits).astype(np.int64).ravel())
            words, first = np.unique(s >> 6, return_index=True)
            masks = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (s & 63).astype(np.uint64)), first) if len(s) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.int64()), "mask": pa.array(masks.view(np.int64), pa.int64())})

    rows = hits.select("digest").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return out


def stream_groups(work: Work, rows_path: str, schema, state: str, out: str) -> DataFrame:
    """Runs the stateful query over what is new under rows_path, then returns
    the newest (digest, keep, n) of each digest.  The same state and out folders
    given again continue where the last call ended."""
    spark = work.spark
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(256 << 30)).parquet(rows_path)
        groups = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        (
            groups.writeStream.outputMode("update")
            .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
            .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(f"digest binary, keep struct<{ROW.replace(' ', ':').replace(',:', ',')}>, n long, batch long").parquet(out)
    return changes.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.keep", "s.n")


def _earlier(work: Work, rows: DataFrame, text_col: str) -> DataFrame:
    """doc_id, file, row, text of rows of earlier calls, from the files that their locators name."""
    files = [r["file"] for r in rows.select("file").distinct().collect()]  # as many as files
    if not files:
        return rows.select("doc_id", "file", "row", F.lit(None).cast("string").alias("text"))
    found = work.spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(f"`{text_col}`").alias("text"))
    return rows.select("doc_id", "file", "row").join(found, ["file", "row"]).select("doc_id", "file", "row", "text")


def _judged(work: Work, located: DataFrame, id_col: str, text_col: str, digest_bits: int, kept: str | None = None) -> DataFrame:
    """doc_id, file, row, keep, n, sha256 of each row. `kept` names the folder of a state that goes on from call to call."""
    source = located.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    root, call = kept or work.root, uuid.uuid4().hex
    whole = digest_bits >= 256
    schema = f"{ROW}, digest binary{'' if whole else ', sha binary'}, call string"
    digested = source.mapInArrow(_digests(digest_bits, False), schema.removesuffix(", call string")).withColumn("call", F.lit(call))
    digested.write.mode("append").partitionBy("call").option("compression", "zstd").parquet(f"{root}/rows")
    every = work.spark.read.schema(schema).parquet(f"{root}/rows")
    sha = F.lower(F.hex("digest" if whole else "sha")).alias("sha256")
    rows = every.where(F.col("call") == call).drop("call")
    if not rows.head(1):
        return rows.select("doc_id", "file", "row", F.struct("doc_id", "file", "row").alias("keep"), F.lit(0).cast("long").alias("n"), sha)
    groups = stream_groups(work, f"{root}/rows", every.schema, f"{root}/state", f"{root}/changes")
    if kept:  # of all groups those that this call's rows are in
        groups = groups.join(rows.select("digest").distinct(), "digest", "left_semi")
    groups = work.cut(groups, "groups")
    if not kept:
        work.drop("state")
    hits = groups.where("n > 1").select("digest")
    n_hits = hits.count()
    final, told = groups, None
    if n_hits:
        texts = source
        if kept:
            before = every.where(F.col("call") != call).join(hits, "digest", "left_semi")
            texts = source.unionByName(_earlier(work, before, text_col))
        bodies = texts.mapInArrow(_digests(digest_bits, True, _bloom(hits, n_hits)), f"{ROW}, digest binary, body binary")
        classes = bodies.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
        count = work.cut(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")).join(hits, "digest", "left_semi"), "checked")
        mixed = count.where("classes > 1").select("digest")
        if mixed.head(1):
            told = bodies.join(mixed, "digest", "left_semi").join(classes, ["digest", "body"]).select("doc_id", "file", "row", "keep", "n", F.sha2("body", 256).alias("sha256"))
            if kept:
                told = told.join(rows.select("file", "row"), ["file", "row"], "left_semi").select("doc_id", "file", "row", "keep", "n", "sha256")
            rows, final = rows.join(mixed, "digest", "left_anti"), groups.join(mixed, "digest", "left_anti")
    out = rows.join(final, "digest").select("doc_id", "file", "row", "keep", "n", sha)
    if told is not None:
        out = out.unionByName(told)
    return out


def dedup(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, state: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    `state` names a shared folder where state goes on: each call takes new rows,
    judges them against all rows of the calls before and reports the new ones
    alone.  df has to be read from Parquet files then, which must stay where they
    are, because texts of earlier rows are found again by their locators.

    Texts are equal if identical after lower-casing A-Z; null equals empty.  Of
    equal texts the row with the largest id stays; a null id comes last; of rows
    repeated with the same id, the one with the last locator stays.  Other
    columns of `df` are not read.  An empty table gives no rows.  digest_bits
    under 256 makes digests collide and serves tests of the full-bytes check.
    """
    work = Work(spark, "exact")
    out = _judged(work, with_locators(work, df), id_col, text_col, digest_bits, state)
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), _stays().alias("kept"), F.col("sha256").alias("text_sha256"))


def _stays():
    return F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep"))


def distinct_rows(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns; told by locator, so null and repeated ids do no harm."""
    work = Work(spark, "exact")
    located = with_locators(work, df)
    gone = _judged(work, located, id_col, text_col, 256).where(~_stays()).select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    return located.join(gone, ["__file", "__row"], "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
