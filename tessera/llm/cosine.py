"""Near-duplicate embeddings by random-hyperplane sign hashing.

Equal vectors become one class first.  Several tables of sign keys give
buckets; within a bucket all pairs of classes are checked by their cosine in
double precision, large buckets as a grid of chunk pairs on many tasks.  A pair
counts in the first table in which its keys agree, so counts need no list of
pairs; of the links in a block only a spanning forest goes on to the connected
components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Work, mix
from tessera.llm.components import connected_components

CHUNK = 4096


def tables_for(n: int, cosine: float, miss: float = 1e-4) -> tuple[int, int]:
    """Bits of a key, and tables, for n classes: an unrelated vector in about one of sixteen buckets,
    because what shares a bucket is fetched with its vector, and a pair at the cosine misses all
    tables with probability `miss`."""
    bits = min(32, max(8, round(math.log2(max(n, 2))) + 4))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _vectors(batches):
    """vec_id, and for usable vectors their scaled double-precision bytes and digest."""
    for batch in batches:
        ids, raw = batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()
        vecs, digests = [], []
        for i, v in zip(ids, raw):
            x = None
            if i is not None and v and None not in v:
                x = np.array(v, dtype=np.float64)
                top = np.abs(x).max()
                x = x / top + 0.0 if np.isfinite(x).all() and top > 0 else None  # + 0.0: no negative zeros
            vecs.append(None if x is None else x.tobytes())
            digests.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.binary()), "digest": pa.array(digests, pa.binary())})


def _keys(bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            out = []
            for b in batch.column("vec").to_pylist():
                x = np.frombuffer(b)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((tables * bits, len(x)))
                signs = (planes[len(x)] @ x > 0).reshape(tables, bits)
                keys = signs @ (1 << np.arange(bits, dtype=np.int64))
                out.append(keys.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("rep", "size", "vec")} | {"keys": pa.array(out, pa.binary())})

    return run


def _buckets(batches):
    """A row for each table of each class; vectors of other lengths get other buckets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.frombuffer(k, "<u4") for k in batch.column("keys").to_pylist()]).astype(np.uint64)
        dims = np.fromiter(map(len, batch.column("vec").to_pylist()), np.uint64, batch.num_rows)
        tables = keys.shape[1]
        b = mix(mix(keys + (np.arange(tables, dtype=np.uint64) << np.uint64(32))) + dims[:, None])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(b.ravel().view(np.int64)), "table": pa.array(np.tile(np.arange(tables, dtype=np.int32), len(b))), "rep": pa.array(np.repeat(batch.column("rep").to_numpy(), tables))})


def _pairs(gid: np.ndarray, side: np.ndarray, two: np.ndarray, most: int = 2_000_000):
    """Index pairs (i < j) of rows of the same block, on different sides if it has two."""
    n, at = len(gid), np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    size = np.diff(np.append(at, n))
    left = np.repeat(at + size, size) - np.arange(n) - 1  # rows of the block after this one
    row = 0
    while row < n:
        upto = max(row + 1, int(np.searchsorted(np.cumsum(left[row:]), most, side="right")) + row)
        c = left[row:upto]
        i = np.repeat(np.arange(row, upto), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        ok = ~two[i] | (side[i] != side[j])
        yield i[ok], j[ok]
        row = upto


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index connected with each index."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == old).all():
            return root


def _links(cosine: float):
    """Rows come grouped by block. For each class: size of its partners that were found here,
    and its root in the block's spanning forest."""

    def block(table: pa.Table):
        if not table.num_rows:
            return
        rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
        x = [np.frombuffer(b) for b in table.column("vec").to_pylist()]
        keys = np.stack([np.frombuffer(b, "<u4") for b in table.column("keys").to_pylist()])
        gid, side, two, at = (table.column(c).to_numpy() for c in ("gid", "side", "two", "table"))
        width = max(map(len, x))
        m = np.zeros((len(x), width))
        for k, v in enumerate(x):
            m[k, : len(v)] = v
        m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        li, lj = [], []
        for i, j in _pairs(gid, side, two.astype(bool), max(10_000, 30_000_000 // (8 * width))):
            ok = np.einsum("ij,ij->i", m[i], m[j]) >= cosine
            i, j = i[ok], j[ok]
            earlier = ((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < at[i][:, None])).any(axis=1) & (rep[i] != rep[j])
            li.append(i[~earlier])
            lj.append(j[~earlier])
        i, j = np.concatenate(li), np.concatenate(lj)
        if len(i):
            n = np.bincount(i, size[j], len(rep)) + np.bincount(j, size[i], len(rep))
            root = rep[_forest(i, j, len(rep))]
            got = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"rep": pa.array(rep[got]), "n": pa.array(n[got].astype(np.int64)), "root": pa.array(root[got])})

    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None and rest.num_rows else now
            gid = now.column("gid").to_numpy()
            cut = int(np.flatnonzero(gid != gid[-1])[-1]) + 1 if len(gid) and (gid != gid[-1]).any() else 0
            yield from block(now.slice(0, cut))
            rest = now.slice(cut)
        if rest is not None:
            yield from block(rest)

    return run


def similar_vectors(spark: SparkSession, df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", miss: float = 1e-4, seed: int = 20240229) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, as do vectors of other lengths with each other and rows
    with a null id (component null, kept).  Rows repeated with the same id
    count as vectors of their own.  Other columns are not read; an empty table
    gives no rows.  Every link reported has the cosine in double precision; a
    pair at the cosine is missed with probability `miss`.
    """
    work = Work(spark, "cosine")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = work.cut(source.mapInArrow(_vectors, "vec_id long, vec binary, digest binary"), "rows")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vec").alias("vec"))
    owners = work.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # a class is told by its vector, as ids may repeat; its number is written with it
    bits, tables = tables_for(owners.count(), cosine, miss)
    keyed = work.cut(owners.select(F.col("node").alias("rep"), "size", "vec").mapInArrow(_keys(bits, tables, seed), "rep long, size long, vec binary, keys binary"), "keyed")
    filled = keyed.select("rep", "vec", "keys").mapInArrow(_buckets, "bucket long, table int, rep long")
    shared = filled.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / CHUNK).alias("chunks"))
    member = filled.join(shared, "bucket").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    # a chunk meets each chunk of its bucket, itself included, in a block of its own
    grid = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    blocks = grid.select("table", "rep", "side", F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("gid"), (F.col("side") != F.col("other")).alias("two"))
    found = blocks.join(keyed, "rep").repartition("gid").sortWithinPartitions("gid", "rep").select("gid", "side", F.col("two").cast("int").alias("two"), "table", "rep", "size", "vec", "keys")
    links = work.cut(found.mapInArrow(_links(cosine), "rep long, n long, root long"), "links")
    roots = connected_components(work, links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "parts")
    counts = links.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n"))
    final = owners.join(counts, "node", "left").join(roots, "node", "left")
    final = final.select("digest", "rep", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = final.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = final.join(least, "root").select("digest", "n_links", "component_id")
    out = rows.select("vec_id", "digest").join(final, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS r FROM v UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = vec_id JOIN (SELECT a, min(r) AS c FROM reach GROUP BY a) c ON c.a = vec_id
"""
