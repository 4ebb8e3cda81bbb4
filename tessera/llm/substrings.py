"""Substring deduplication with a compressed FM-index per shard.

Documents are cut where the least 8-word gram of the sliding window changes;
equal windows have the same least gram, so all places that can share a window
meet under one anchor and are never compared with the rest of the corpus.
Anchors seen once are done.  Of every other anchor each distinct stretch goes to
the FM-index of the anchor's shard, twice if it occurs more than once: backward
search over its wavelet matrix gives each stretch's matching statistics, and
windows that match twice are reported as intervals, which hold for all places of
the stretch.  An anchor with very many distinct stretches is parted: of its
windows those whose hash occurs twice go to the index one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Work, hashes_of, mix, slices_of, texts_of, words_of
from tessera.llm.exact import with_locators

WINDOW, GRAM = 35, 8
SPAN = WINDOW - GRAM + 1  # grams in a window
SHARD_WORDS = 500_000
DEPTH = 64  # words of a pattern at the most: a stretch has hardly more
HOT = 4000  # distinct stretches of an anchor beyond which it is parted into single windows


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 8-word grams and 35-word windows, by doubling."""
    two = _pair(h[:-1], h[1:])
    four = _pair(two[:-2], two[2:])
    eight = _pair(four[:-4], four[4:])
    sixteen = _pair(eight[:-8], eight[8:])
    whole = _pair(sixteen[:-16], sixteen[16:])
    n = max(len(h) - WINDOW + 1, 0)
    return eight, _pair(whole[:n], _pair(two[32 : 32 + n], h[34 : 34 + n]))


def _least(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each run of SPAN grams, and where it stands first; n runs."""
    v, at, width = g, np.arange(len(g)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        right = v[step:] < v[: len(v) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        v = np.where(right, v[step:], v[: len(v) - step])
        width += step
    return v[:n], at[:n]


def stretches(h: np.ndarray, ends: np.ndarray):
    """For word hashes of texts laid end to end: text number, first window (in words of the
    text), windows, anchor, hash of the words, and whether windows may repeat within."""
    starts = np.concatenate([[0], ends[:-1]])
    empty = np.empty(0, np.int64)
    if len(h) < WINDOW:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    g, w = window_hashes(h)
    n = len(w)
    low, at = _least(g, n)
    text = np.searchsorted(ends, np.arange(n), side="right")
    ok = np.arange(n) + WINDOW <= ends[text]
    s = np.flatnonzero(ok)
    if not len(s):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    low, at, text, w = low[s], at[s], text[s], w[s]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, len(s)))
    inner = (np.arange(len(s)) - np.repeat(first, count)).astype(np.uint64)
    whole = np.add.reduceat(mix(w + inner * np.uint64(0x9E3779B97F4A7C15)), first)
    again = at[first] != at[first + count - 1]
    return text[first], s[first] - starts[text[first]], count, low[first], whole, again.astype(np.int64)


def _hashed(texts: pa.Array):
    """Of slices of the texts: how many come before, word hashes of all end to end, and where each text ends."""
    at = 0
    for part in slices_of(texts):
        lens, ids, words = words_of(part, lower=False)
        yield at, hashes_of(words)[ids], np.cumsum(lens)
        at += len(part)


STRETCH = "file long, row long, start long, n long, anchor long, whole long, again long"


def _find(batches):
    for batch in batches:
        file, row = (batch.column(c).to_numpy() for c in ("file", "row"))
        for i, h, ends in _hashed(batch.column("text")):
            text, start, count, anchor, whole, again = stretches(h, ends)
            cols = (file[i + text], row[i + text], start, count, anchor.view(np.int64), whole.view(np.int64), again)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in STRETCH.split(", ")])


def _per_text(batches, schema: str, rows_of, most: int = 20_000):
    """Rows that rows_of gives for each text's file, row, word hashes and wanted stretches."""
    kinds = [(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])
    for batch in batches:
        rows, where = [], list(zip(batch.column("file").to_pylist(), batch.column("row").to_pylist()))
        for i, h, ends in _hashed(batch.column("text")):
            for k, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                rows += rows_of(*where[i + k], h[a:b], batch.column("wanted")[i + k].as_py())
                if len(rows) > most:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)


WINDOWS = "anchor long, whole long, lead boolean, w long, file long, row long, start long, inner long"


def _windows(batches):
    """All windows of the wanted stretches with their hashes."""

    def rows(file, row, h, wanted):
        w = window_hashes(h)[1].view(np.int64)
        return [(x["anchor"], x["whole"], x["lead"], int(w[x["start"] + i]), file, row, x["start"] + i, i) for x in wanted for i in range(x["n"])]

    yield from _per_text(batches, WINDOWS, rows)


WORDS = "shard long, anchor long, whole long, lead boolean, twice boolean, hot boolean, words binary"


def _cut_out(batches):
    """The words of the wanted stretches."""

    def rows(file, row, h, wanted):
        return [(x["shard"], x["anchor"], x["whole"], x["lead"], x["twice"], x["hot"], h[x["start"] : x["start"] + x["n"] + WINDOW - 1].tobytes()) for x in wanted]

    yield from _per_text(batches, WORDS, rows)


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of a sequence of small integers,
    held as a wavelet matrix: a bit vector for each bit of a symbol, with a count per 64 bits.

    Symbols are 0 to most; the order of suffixes is exact for their first `depth` symbols,
    which is all that patterns of at most that length ask.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank = text.astype(np.int64)
        width = 1
        while width < depth:
            key = rank * (int(rank.max(initial=0)) + 2)
            key[: max(n - width, 0)] += rank[width:] + 1
            rank = np.unique(key, return_inverse=True)[1]
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.n, self.bits = n, max(1, int(text.max(initial=0)).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        seq = text[order - 1]
        self.levels: list[tuple] = []
        for b in reversed(range(self.bits)):
            bit = (seq >> b) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, counts, n - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        symbols = np.arange(1 << self.bits)
        self.base = self.before[symbols] - self.rank(symbols, np.zeros_like(symbols))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, counts, _ = self.levels[level]
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position, plus where its range starts in the last level."""
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.levels[level][2] + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after putting a symbol before each pattern."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.base[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]


def matching(index: FMIndex, text: np.ndarray, ends: np.ndarray, most, least_places: int = 2) -> np.ndarray:
    """Matching statistics: the length, up to `most` (one for all or one each), of the longest pattern that
    ends at each position of `ends` and stands in `least_places` places of the indexed text."""
    length, most = np.zeros(len(ends), np.int64), np.broadcast_to(most, len(ends))
    alive, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), index.n, np.int64)
    for i in range(int(most.max(initial=0))):
        lo, hi = index.step(text[ends[alive] - i], lo, hi)
        ok = hi - lo >= least_places
        length[alive[ok]] += 1
        ok &= most[alive] > i + 1
        alive, lo, hi = alive[ok], lo[ok], hi[ok]
        if not len(alive):
            break
    return length


def repeated_windows(index: FMIndex, text: np.ndarray, at: np.ndarray, windows: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, last): runs of windows that stand in two places, of stretches that begin at `at`
    and have so many windows. `likely` stretches are first tried as far as the index's depth goes.

    Windows are decided from the left, all stretches at once.  Where a window's match ends after L
    words, no window that holds these words and the one before them can match: the next one starts
    behind that word.  After a match several windows are tried as one pattern, more each time.
    """
    who, s, runs = np.arange(len(at)), np.zeros(len(at), np.int64), []
    more = np.where(likely, DEPTH, 0)  # windows to try beyond the next
    while len(who):
        g = np.minimum(np.minimum(more, windows[who] - 1 - s), DEPTH - WINDOW)
        length = matching(index, text, at[who] + s + g + WINDOW - 1, g + WINDOW)
        full = length == g + WINDOW
        runs.append((who[full], s[full], s[full] + g[full]))
        s = np.where(full, s + g + 1, np.where(g == 0, s + WINDOW - length, s))
        more = np.where(full, 2 * g + 2, 0)
        left = s < windows[who]
        who, s, more = who[left], s[left], more[left]
    who, first, last = (np.concatenate(c) for c in zip(*runs)) if runs else (np.empty(0, np.int64),) * 3
    order = np.lexsort((first, who))
    who, first, last = who[order], first[order], last[order]
    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (first[1:] != last[:-1] + 1)])) if len(who) else np.empty(0, np.int64)
    return who[new], first[new], last[np.append(new[1:], len(who)) - 1] if len(who) else last


FOUND = "anchor long, whole long, hot boolean, a long, b long"


def _search(table: pa.Table) -> pa.Table:
    """Indexes one shard's stretches and searches the leading one of each kind: (a, b) are the words of
    a stretch, b excluded, that windows cover which stand in two places.  All windows lie within
    their own stretch, and separators never match."""
    seqs = [np.frombuffer(b, "<u8") for b in table.column("words").to_pylist()]
    lens = np.array([len(s) for s in seqs])
    symbols = np.unique(np.concatenate(seqs), return_inverse=True)[1] + 1
    at = np.cumsum(lens + 1) - lens - 1  # a separator, 0, ends each stretch
    text = np.zeros(int((lens + 1).sum()), np.int64)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(seqs)), lens)] = symbols
    ask = np.flatnonzero(table.column("lead").to_numpy())
    o, first, last = repeated_windows(FMIndex(text, DEPTH), text, at[ask], lens[ask] - WINDOW + 1, table.column("twice").to_numpy()[ask])
    out = table.select(["anchor", "whole", "hot"]).take(pa.array(ask[o]))
    return out.append_column("a", pa.array(first, pa.int64())).append_column("b", pa.array(last + WINDOW, pa.int64()))


def _fetch(docs: DataFrame, wanted: DataFrame, run, schema: str) -> DataFrame:
    """What `run` takes from the texts that hold the wanted stretches; a text's are gathered with it."""
    columns = [c for c in wanted.columns if c not in ("file", "row")]
    lists = wanted.groupBy("file", "row").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return docs.select("file", "row", "text").join(lists, ["file", "row"]).mapInArrow(run, schema)


def repeated_spans(work: Work, docs: DataFrame) -> DataFrame:
    """(file, row, a, b): words a to b (b excluded) of a document are covered by windows that occur elsewhere.
    docs: file, row, text."""
    seen = work.cut(docs.select("file", "row", "text").mapInArrow(_find, STRETCH), "seen")
    often = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), F.max("again").alias("loops")).where("total > 1 OR loops > 0").select("anchor")
    again = work.cut(seen.drop("again").join(often, "anchor", "left_semi"), "again")
    work.drop("seen")
    at = F.struct("file", "row", "start", "n")
    kinds = work.cut(again.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(at).alias("lo"), F.max(at).alias("hi")), "kinds")
    kinds_of = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    # a stretch that occurs more than once goes to the index from two places: it has to be found there, like any other
    lead, twin = (F.struct(F.lit(x).alias("lead"), F.col(c).alias("at")) for x, c in ((True, "lo"), (False, "hi")))
    copies = kinds.join(kinds_of, "anchor").select("anchor", "whole", (F.col("kinds") > HOT).alias("hot"), (F.col("c") > 1).alias("twice"), F.explode(F.when(F.col("c") > 1, F.array(lead, twin)).otherwise(F.array(lead))).alias("x"))
    copies = work.cut(copies.select("x.at.*", "anchor", "whole", "x.lead", "twice", "hot"), "copies")
    wanted, windows = copies.where("NOT hot").withColumn("deal", F.xxhash64("anchor")), None
    if copies.where("hot").head(1):
        windows = work.cut(_fetch(docs, copies.where("hot").drop("hot", "twice"), _windows, WINDOWS), "windows")
        place = F.struct("file", "row", "start")
        twice = windows.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("lo"), F.max(place).alias("hi")).where("c > 1")
        twice = twice.select("anchor", F.col("w").alias("whole"), F.explode(F.array(lead, twin)).alias("x"))
        wanted = wanted.unionByName(twice.select("x.at.*", F.lit(1).cast("long").alias("n"), "anchor", "whole", "x.lead", F.lit(True).alias("twice"), F.lit(True).alias("hot"), F.xxhash64("anchor", "whole").alias("deal")))
    wanted = work.cut(wanted, "wanted")
    words = wanted.agg(F.coalesce(F.sum(F.col("n") + WINDOW), F.lit(0)).alias("w")).first()["w"]
    shards = max(1, -(-words // SHARD_WORDS))
    cut = work.cut(_fetch(docs, wanted.withColumn("shard", F.pmod("deal", F.lit(shards))).drop("deal"), _cut_out, WORDS), "cut")
    found = work.cut(cut.groupBy("shard").applyInArrow(_search, FOUND), "found")
    inside = found.where("NOT hot").select("anchor", "whole", "a", "b")
    if windows is not None:
        told = found.where("hot").select("anchor", F.col("whole").alias("w"))
        hot = windows.where("lead").join(told, ["anchor", "w"]).select("anchor", "whole", F.col("inner").alias("a"), (F.col("inner") + WINDOW).alias("b"))
        inside = inside.union(hot)
    return again.join(inside, ["anchor", "whole"]).select("file", "row", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def _keep(text: bytes, spans) -> tuple[int, int, list[bytes]]:
    words = text.split()
    if not spans:
        return len(words), 0, words
    edge = np.zeros(len(words) + 1, np.int32)
    s = np.array([(x["a"], x["b"]) for x in spans])
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), [w for w, g in zip(words, gone.tolist()) if not g]


def _apply(with_text: bool):
    def run(batches):
        for batch in batches:
            n, removed, out = [], [], []
            null = batch.column("text").is_null().to_pylist()
            for text, none, spans in zip(texts_of(batch), null, batch.column("spans").to_pylist()):
                total, gone, words = _keep(text, spans)
                n.append(total)
                removed.append(gone)
                kept = b" ".join(words)
                out.append((None if none else kept if gone else text) if with_text else hashlib.sha256(kept).hexdigest())
            last = pa.array(out, pa.binary()).cast(pa.string()) if with_text else pa.array(out, pa.string())
            cols = {f.name: batch.column(f.name) for f in batch.schema if f.name not in ("text", "spans")}
            yield pa.RecordBatch.from_pydict(cols | {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": last})

    return run


def dedup_substrings(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept.

    Each word that is covered by a 35-word window whose words also start
    anywhere else, the same text included, is removed.  `kept` is the SHA-256
    of the kept words joined by one space, or with with_text the text itself
    (unchanged if nothing was removed, else those words; null stays null).
    Columns named in `carry` go along.  Null, empty and short texts lose nothing;
    repeated rows repeat each other and lose all windows; a null id stays null.
    Rows are told by file and row, so ids needn't be unique.  Other columns are
    not read; an empty table gives no rows.
    """
    work = Work(spark, "substrings")
    rows = with_locators(work, df)
    docs = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"carry_{c}") for c in carry), F.xxhash64("__file").alias("file"), F.col("__row").alias("row"))
    spans = repeated_spans(work, docs)
    spans = work.cut(spans.groupBy("file", "row").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    for name in ("again", "kinds", "copies", "wanted", "cut", "found"):
        work.drop(name)
    joined = docs.join(spans, ["file", "row"], "left").select("doc_id", *(F.col(f"carry_{c}").alias(c) for c in carry), "text", "spans")
    schema = joined.drop("text", "spans").schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(_apply(with_text), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("kept", "kept_sha256")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i : i + 34], ' ')) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM windows WHERE n > 1),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
