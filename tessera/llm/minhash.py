"""Near-duplicates by one-permutation MinHash with optimal densification.

Each document's shingle hashes fall into bins; a bin's least hash is its value
and an empty bin borrows the value of the bin that a permutation of its own
reaches first.  Bands of bins are bucket keys.  In a bucket every document is
a candidate of the smallest one only (a star); documents of a bucket that the
confirmed stars leave in different components are then tested across these
components where their bins agree often enough, so no link is lost to a star's
choice of centre and copies never expand into all pairs.  Links are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Work, gram_hashes, hashes_of, mix, slices_of, words_of
from tessera.llm.components import connected_components
from tessera.llm.exact import with_locators

SHINGLE = 5
BANDS, ROWS = 64, 6  # at a similarity of 0.75 a pair misses all bands once in 280,000
LEAST, OF = 75, 100
CHUNK = 2048  # documents of a group that one block holds of either side
LONG = 2000  # shingles a document, on average, beyond which a block holds fewer
A_SALT = 256  # documents compared with one copy of a star's centre


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text: runs of five words, or the
    whole sequence where there are fewer; none without words."""
    for part in slices_of(texts):
        lens, ids, words = words_of(part, lower=True)
        h = hashes_of(words)[ids]
        g, at = gram_hashes(h, SHINGLE), 0
        for n in lens.tolist():
            if n >= SHINGLE:
                yield np.unique(g[at : at + n - SHINGLE + 1])
            else:
                yield mix(gram_hashes(h[at : at + n], n) + np.uint64(n)) if n else np.empty(0, np.uint64)
            at += n


@lru_cache(maxsize=2)
def _order(bins: int) -> np.ndarray:
    """A random permutation of the bins for each bin: row i tells how early bin i reaches bin j."""
    rng = np.random.default_rng(20240229)
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.int16)


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """Bin values of a non-empty sorted set, densified."""
    where = (((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    full = where[first]
    out = np.zeros(bins, np.uint64)
    out[full] = s[first]
    if len(full) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        out[empty] = out[full[_order(bins)[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = values.reshape(bands, rows)
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(977))
    for r in range(rows):
        key = mix(key + values[:, r])
    return key


def _sketch(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            n, sig, keys, mini = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                values = signature(s, bands * rows) if len(s) else None
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(values, bands, rows).tobytes() if len(s) else None)
                mini.append((mix(values) & np.uint64(255)).astype(np.uint8).tobytes() if len(s) else None)
            cols = [pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (sig, keys, mini))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "row")), *cols], names=["doc_id", "file", "row", "n", "sig", "keys", "mini"])

    return run


def likely(mini: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the share of equal bins leaves the similarity possible: it may fall short of it by
    4.5 standard deviations, taken for as many bins as the smaller set can fill (missing a pair at
    the similarity about as seldom as the bands do)."""
    share = LEAST / OF
    filled = np.minimum(sizes, mini.shape[-1])
    return (mini == other).mean(axis=-1) >= share - 4.5 * np.sqrt(share * (1 - share) / filled)


BLOCK = ["top", "kind", "i", "j"]


def _starts(table) -> np.ndarray:
    """Where rows of another block begin."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in BLOCK:
        v = table.column(c).to_numpy()
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1


def _by_block(batches):
    """Tables of whole blocks, from rows that come grouped by block."""
    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        parts = [t for t in (rest, pa.Table.from_batches([batch]) if batch is not None else None) if t is not None and t.num_rows]
        if not parts:
            continue
        now = pa.concat_tables(parts)
        cut = now.num_rows
        if batch is not None:
            starts = _starts(now)
            cut = int(starts[-1]) if len(starts) else 0
        rest = now.slice(cut)
        if cut:
            yield now.slice(0, cut).combine_chunks()


def _across(table: pa.Table):
    """For each document that a block holds against others: its row and the rows of other components
    whose sizes and bins leave the similarity possible.

    In a block of kind 0 documents outside the largest component (side 1) meet those of a chunk of it
    (side 0); in one of kind 1 two chunks of the former meet, each pair from side 0 or, within one
    chunk, from the earlier row.
    """
    rep, n, root, kind, side, i, j = (table.column(c).to_numpy() for c in ("rep", "n", "root", "kind", "side", "i", "j"))
    mini = np.frombuffer(b"".join(table.column("mini").to_pylist()), np.uint8).reshape(len(rep), -1)
    bounds = [0, *_starts(table).tolist(), len(rep)]
    for lo, hi in zip(bounds, bounds[1:]):
        inner = kind[lo] == 1 and i[lo] == j[lo]
        here = np.arange(lo, hi)
        asks, others = (here, here) if inner else (here[side[lo:hi] == 1], here[side[lo:hi] == 0])
        for x in asks.tolist():
            y = others[others > x] if inner else others
            y = y[root[y] != root[x]]
            y = y[np.minimum(n[y], n[x]) * OF >= np.maximum(n[y], n[x]) * LEAST]
            y = y[likely(mini[y], mini[x], np.minimum(n[y], n[x]))] if len(y) else y
            if len(y):
                yield x, y


def _active(batches):
    """The rows of a block that have any partner left: the texts of no others are fetched."""
    for table in _by_block(batches):
        keep = np.zeros(table.num_rows, bool)
        for x, y in _across(table):
            keep[x] = True
            keep[y] = True
        if keep.any():
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def _links_across(batches):
    """Confirmed links of each block. Pairs are never listed: a document is held against all its partners at once."""
    for table in _by_block(batches):
        rep, sets = table.column("rep").to_numpy(), None
        a, b = [], []
        for x, y in _across(table):
            sets = sets or list(shingle_sets(table.column("text").combine_chunks()))
            s, sizes = sets[x], np.array([len(sets[k]) for k in y])
            others = np.concatenate([sets[k] for k in y])
            hit = s[np.minimum(np.searchsorted(s, others), len(s) - 1)] == others
            common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            near = y[OF * common >= LEAST * (len(s) + sizes - common)]
            a.append(np.full(len(near), rep[x]))
            b.append(rep[near])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _buckets(batches):
    for batch in batches:
        keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
        bands = [len(k) for k in keys]
        cols = {"bucket": np.concatenate(keys) if keys else np.empty(0, np.int64)} | {c: np.repeat(batch.column(c).to_numpy(), bands) for c in ("rep", "n")}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})


def _compare(batches):
    """Rows come grouped by centre, the centre's own row before those it is compared with."""
    held, centre = None, None
    for batch in batches:
        a, b = [], []
        for grp, salt, role, doc, s in zip(*(batch.column(c).to_pylist() for c in ("grp", "salt", "role", "id")), shingle_sets(batch.column("text"))):
            if role == 0:
                held, centre = s, (grp, salt)
            elif centre == (grp, salt):
                common = len(np.intersect1d(held, s, assume_unique=True))
                if OF * common >= LEAST * (len(held) + len(s) - common):
                    a.append(grp)
                    b.append(doc)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.

    A centre's text meets the others' in groups of A_SALT of them, however many it has.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / A_SALT).alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    members = salted.join(texts, F.col("b") == F.col("rep")).select(F.col("a").alias("grp"), "salt", F.lit(1).alias("role"), F.col("b").alias("id"), "text")
    centres = salts.join(texts, F.col("a") == F.col("rep")).select(F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"), "text")
    return members.union(centres).repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role").mapInArrow(_compare, "a long, b long")


def _alike(x: str, y: str):
    """Sizes that can reach the similarity at all."""
    return F.least(x, y) * OF >= F.greatest(x, y) * LEAST


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (top, rep, n, root, mini) dealt to blocks of bounded size.

    The documents of a group's largest component (root = top) are cut into
    chunks, the others into chunks of their own.  Each of the others meets each
    chunk of the largest component and each chunk of the others once; the largest
    component's documents, linked already, never meet each other.
    """
    major = F.col("root") == F.col("top")
    heavy = lambda own: F.greatest(F.ceil(F.count_if(own) / CHUNK), F.ceil(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) / (CHUNK * LONG)))
    sizes = rows.groupBy("top").agg(heavy(major).alias("majors"), heavy(~major).alias("minors")).where("minors > 0")
    chunk = F.pmod(F.xxhash64("rep"), F.when(major, F.col("majors")).otherwise(F.col("minors")))
    dealt = rows.join(sizes, "top").withColumn("chunk", chunk)
    up_to = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)).otherwise(F.array())
    place = lambda kind, side, i, j: F.struct(F.lit(kind).alias("kind"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"), i.alias("i"), j.alias("j"))
    to_minors = up_to(F.col("minors"), lambda k: place(0, 0, F.col("chunk"), k))
    to_majors = up_to(F.col("majors"), lambda k: place(0, 1, k, F.col("chunk")))
    among = up_to(F.col("minors"), lambda k: place(1, F.col("chunk") > k, F.least(F.col("chunk"), k), F.greatest(F.col("chunk"), k)))
    places = F.when(major, to_minors).otherwise(F.concat(to_majors, among))
    return dealt.select("top", "rep", "n", "root", "mini", F.explode(places).alias("p")).select("top", "rep", "n", "root", "mini", "p.*")


def _judged(work: Work, located: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """doc_id, file, row, n_shingles and, of what can be linked, `first`: the least (doc_id, file, row) reachable."""
    docs = located.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    sketches = work.cut(docs.mapInArrow(_sketch(bands, rows), "doc_id long, file string, row long, n long, sig binary, keys binary, mini binary"), "sketches")
    usable = sketches.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    # a class is a set of shingles; its number is written with it, so that it stays whatever is computed again
    classes = usable.groupBy("sig").agg(F.min(F.struct("doc_id", "file", "row", "n", "keys", "mini")).alias("s"))
    classes = work.cut(classes.select(F.monotonically_increasing_id().alias("rep"), "sig", F.struct("s.doc_id", "s.file", "s.row").alias("first"), "s.n", "s.keys", "s.mini"), "classes")
    filled = classes.select("rep", "n", "keys").mapInArrow(_buckets, "bucket long, rep long, n long")
    stars = filled.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = work.cut(filled.join(stars.select("bucket", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "bucket"), "members")
    first = members.where((F.col("rep") != F.col("hub")) & _alike("n", "hub_n")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tested = work.cut(first, "pairs-1")
    near = tested.select(F.col("a").alias("rep")).union(tested.select(F.col("b").alias("rep"))).distinct()
    at = classes.join(near, "rep", "left_semi").select("rep", F.col("first.file").alias("file"), F.col("first.row").alias("row"))
    texts = work.cut(docs.select("file", "row", "text").join(at, ["file", "row"]).select("rep", "text"), "texts")
    links = work.cut(confirm(tested, texts), "links-1")
    roots = connected_components(work, links, "first")
    # what a bucket, less its centre, which has met all others, still holds in different components is tested
    # across these; buckets that have the same largest component are one group, so a document is read once for it
    labelled = members.where("rep <> hub").select("bucket", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    parts = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    open_ = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "root")).alias("top")).where("parts > 1").select("bucket", F.col("top.root").alias("top"))
    group = work.cut(labelled.join(open_, "bucket").groupBy("top", "rep").agg(F.first("n").alias("n"), F.first("root").alias("root")), "open")
    blocks = _blocks(group.join(classes.select("rep", "mini"), "rep")).repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    active = work.cut(blocks.mapInArrow(_active, blocks.schema), "active")
    work.drop("open")
    if active.head(1):
        # of a bucket's members whose sizes aren't alike some have no text yet
        wanted = classes.join(active.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("first.file").alias("file"), F.col("first.row").alias("row"))
        missing = wanted.join(texts.select("rep"), "rep", "left_anti")
        if missing.head(1):
            texts = texts.union(work.cut(docs.select("file", "row", "text").join(missing, ["file", "row"]).select("rep", "text"), "texts-2"))
        held = active.join(texts, "rep").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
        links = work.cut(links.union(held.mapInArrow(_links_across, "a long, b long").distinct()), "links-2")
        roots = connected_components(work, links, "second")
    for name in ("texts", "texts-2", "members"):
        work.drop(name)
    owners = classes.select("sig", "rep", "first").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = owners.groupBy("root").agg(F.min("first").alias("least"))
    owners = owners.join(least, "root").select("sig", F.col("least").alias("first"))
    linkable = F.when(F.col("doc_id").isNotNull(), F.col("sig"))
    return sketches.select("doc_id", "file", "row", F.col("n").alias("n_shingles"), linkable.alias("sig")).join(owners, "sig", "left").drop("sig")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts without words (null, empty, white space) have no shingles and are
    linked with nothing.  Rows are told by file and row, so rows repeated with the
    same id are each linked by their own text; a null id is linked with nothing,
    its component is null and it is kept.  Very long texts are shingled whole.
    Other columns are not read; an empty table gives no rows.
    """
    work = Work(spark, "minhash")
    out = _judged(work, with_locators(work, df), id_col, text_col, bands, rows)
    component = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_rows(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of df that stay, with all their columns: of each group the one with the smallest id, of rows
    repeated with this id the first by file and row. Rows are told by locator: repeated and null ids do no harm."""
    work = Work(spark, "minhash")
    located = with_locators(work, df)
    judged = _judged(work, located, id_col, text_col, bands, rows)
    gone = judged.where(F.struct("doc_id", "file", "row") != F.col("first")).select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    return located.join(gone, ["__file", "__row"], "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(r) AS c FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
