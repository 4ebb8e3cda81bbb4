"""Language-model scores from a log-frequency Bloom filter.

Texts are coded once into chunks: each token as an index into the chunk's own
list of words.  The distinct words and word pairs of a chunk are dealt by shard
with their counts in the chunk's training texts.  A shard sums the counts of its
n-grams over all chunks, and puts an n-gram whose count falls in level q into
its segment of the Bloom filter as (n-gram, 1) ... (n-gram, q); probing level
after level until one is missing gives the quantised count, which goes back to
each chunk.  Every n-gram is in the filter, and the number of segments grows with
the input; so no segment is sent to all workers, each is probed where it is made.
Pair and word probabilities are mixed with weights by context count, fitted on
the training part with each token's own occurrence left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Work, hash_words, mix, slices_of, words_of
from tessera.llm.langid import held_out

START = np.uint64(0x5851F42D4C957F2D)  # stands before the first token of a text
WORD, PAIR = 1, 2
BASE = {WORD: 1.2, PAIR: 2.0}  # ratio of neighbouring levels
PROBES = 4
BUCKETS = 40
CHUNK_BYTES = 12_000_000
SHARD_TOKENS = 2_000_000


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h + np.uint64(0x1234567))


def pair_keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Key of (token before, token) for each token; `starts` marks first tokens."""
    before = np.concatenate([[START], h[:-1]]) if len(h) else h
    before[starts] = START
    return mix(mix(before) + h)


def _squeeze(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unsqueeze(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


CHUNKS = "chunk long, docs array<long>, lens array<long>, teach array<boolean>, ids binary, words binary"


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of each text, its end included, all tokens as indices, and the distinct
    tokens; the last of these, the empty one, is the end."""
    lens, ids, words = words_of(texts, lower=True)
    out = np.full(len(ids) + len(lens), len(words), np.int64)
    ends = np.cumsum(lens + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids
    return lens + 1, out, [*words.cast(pa.binary()).to_pylist(), b""]


def _chunks(most: int):
    """Texts coded in chunks of at most `most` bytes, one text at least. A chunk's number is written with it."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            lens, ids, words = coded(table.column("text").combine_chunks())
            # byte by byte: the upper bytes of the indices are nearly all zero
            body = {"ids": _squeeze(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()), "words": _squeeze(b"\n".join(words))}  # no word holds white space
            cols = {"chunk": [part << 32 | number], "docs": [table.column("doc_id").to_pylist()], "lens": [lens], "teach": [table.column("teach").to_pylist()]}
            kinds = {"chunk": pa.int64(), "docs": pa.list_(pa.int64()), "lens": pa.list_(pa.int64()), "teach": pa.list_(pa.bool_())}
            return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in cols.items()} | {k: pa.array([v], pa.binary()) for k, v in body.items()})

        for batch in batches:
            at = 0
            for texts in slices_of(batch.column("text"), most):
                rows, n = batch.slice(at, len(texts)), int(pc.sum(pc.binary_length(texts)).as_py() or 0)
                if held and size + n > most:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(rows)
                at, size = at + len(texts), size + n
        if held:
            yield out()

    return run


def _rows(batch):
    """One row after the other: all of a batch at once would be many chunks."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Lengths and starts of a chunk's texts, its token indices and its distinct tokens."""
    lens = np.array(row["lens"], np.int64)
    ids = np.frombuffer(_unsqueeze(row["ids"]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return lens, np.cumsum(lens) - lens, ids, _unsqueeze(row["words"]).split(b"\n")


def _ngrams(row: dict):
    """Of a chunk, always in the same order: word keys, their order, pair keys in order and where each token's stands."""
    lens, starts, ids, words = _read(row)
    h = hash_words(words)
    keys = word_keys(h)
    pairs, at = np.unique(pair_keys(h[ids], starts), return_inverse=True)
    return lens, starts, ids, words, keys, np.argsort(keys, kind="stable"), pairs, at


def _by_shard(keys: np.ndarray, shards: int):
    """(shard, from, to) of sorted keys: a shard is a range of key values."""
    shard = (keys // np.uint64((1 << 64) // shards + 1)).astype(np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)] if len(keys) else [0]
    return [(int(shard[a]), a, b) for a, b in zip(bounds, bounds[1:])]


def _blobs(keys: np.ndarray, counts: np.ndarray, order: int, shards: int):
    """Sorted keys and counts, parted by shard."""
    rows = [(s, order, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for s, a, b in _by_shard(keys, shards)]
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "ord", "keys", "counts"])


def _deal(shards: int):
    """Each chunk's distinct words, as they are, and pair keys, with their counts in its training texts, by shard."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                lens, _, ids, words, keys, order, pairs, at = _ngrams(row)
                mine = np.repeat(np.array(row["teach"], bool), lens)
                counts = np.bincount(ids, mine, len(words)).astype(np.int64)[order]
                parts = _by_shard(keys[order], shards)
                word = pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([s for s, _, _ in parts], pa.int32()), "ord": pa.array([WORD] * len(parts), pa.int32()),
                        "keys": pa.array([b"\n".join([words[i] for i in order[a:b]]) for _, a, b in parts], pa.binary()),
                        "counts": pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in parts], pa.binary()),
                    }
                )
                pair = _blobs(pairs, np.bincount(at, mine, len(pairs)).astype(np.int64), PAIR, shards)
                for out in (word, pair):
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * out.num_rows, pa.int64()), *out.columns], names=["chunk", *out.schema.names])

    return run


def level(counts: np.ndarray, floor: int, base: float) -> np.ndarray:
    """1 for floor <= count < floor * base and so on; 0 under the floor."""
    with np.errstate(divide="ignore"):
        return np.where(counts >= floor, 1 + np.floor(np.log(counts / floor) / np.log(base) + 1e-9), 0).astype(np.int64)


def _halves(keys: np.ndarray, lev: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of (key, level), the second odd."""
    h = mix(keys + np.uint64(0x9E3779B97F4A7C15 * lev & (1 << 64) - 1))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def _spot(a: np.ndarray, b: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit number of `bits`, a count under 2 ** 32."""
    return ((((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Filter:
    segments: np.ndarray  # (shards, bytes)
    floor: int

    def levels(self, keys: np.ndarray, order: int, most: int = 400) -> np.ndarray:
        """Quantised level of each key: levels are probed until one is missing."""
        shards, width = self.segments.shape
        flat, bits = self.segments.reshape(-1), width * 8
        if not bits:
            return np.zeros(len(keys), np.int64)
        shard = (keys // np.uint64((1 << 64) // shards + 1)).astype(np.int64) * width if shards > 1 else np.zeros(len(keys), np.int64)
        out, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        keys = keys + np.uint64(order)
        for lev in range(1, most):
            one, two = _halves(keys[alive], lev)
            s = shard[alive]
            for i in range(PROBES):  # what is missing at one spot is not looked up at the next
                spot = _spot(one, two, i, bits)
                ok = (flat[s + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1
                alive, one, two, s = alive[ok], one[ok], two[ok], s[ok]
            if not len(alive):
                break
            out[alive] = lev
        return out


def counts_of(lev: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest count of each level; zeros for what isn't there."""
    return np.where(lev > 0, np.ceil(BASE[order] ** (lev - 1.0)), 0.0), np.where(lev > 0, BASE[order] ** lev.astype(float), 0.0)


def segment(keys: np.ndarray, lev: np.ndarray, order: int, width: int) -> np.ndarray:
    """`width` bytes of the filter: each key is put in for every level up to its own."""
    bits, keys = np.zeros(width * 8, bool), keys + np.uint64(order)
    for q in range(1, int(lev.max(initial=0)) + 1):
        keys, lev = keys[lev >= q], lev[lev >= q]
        one, two = _halves(keys, q)
        for i in range(PROBES):
            bits[_spot(one, two, i, width * 8)] = True
    return np.packbits(bits, bitorder="little")


ANSWERS = "chunk long, shard int, ord int, levels binary, exact binary, n long, v long, t long"


def _probe(table: pa.Table) -> pa.Table:
    """One shard of one order: sums its n-grams' training counts, makes its segment and gives each chunk the
    levels of its n-grams, of words the exact counts too; the first row has the shard's sums."""
    blobs, order = table.column("keys").to_pylist(), table.column("ord")[0].as_py()
    if order == WORD:
        lists = [b.split(b"\n") for b in blobs]
        lens = [len(x) for x in lists]
        which = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        words, back = which.dictionary.to_pylist(), which.indices.to_numpy()
        keys = word_keys(hash_words(words))
    else:
        lens = [len(b) // 8 for b in blobs]
        keys, back = np.unique(np.concatenate([np.frombuffer(b, dtype="<u8") for b in blobs]), return_inverse=True)
    counts = np.concatenate([np.frombuffer(b, dtype="<u4") for b in table.column("counts").to_pylist()])
    counts = np.bincount(back, counts, len(keys)).astype(np.int64)
    taught, lev = counts > 0, level(counts, 1, BASE[order])
    width = max(16, int(1.25 * lev.sum()))
    made = segment(keys[taught], lev[taught], order, width) if taught.any() else np.zeros(0, np.uint8)
    lev = Filter(made[None, :], 1).levels(keys, order, 255).astype(np.uint8)[back]
    ends = np.cumsum(lens)
    sums = np.zeros((3, len(blobs)), np.int64)
    exact = [None] * len(blobs)
    if order == WORD:
        sums[:, 0] = counts.sum(), taught.sum(), sum(c for w, c in zip(words, counts.tolist()) if not w)
        exact = [counts[back[i - n : i]].astype("<u8").tobytes() for i, n in zip(ends, lens)]
    cols = {c: table.column(c) for c in ("chunk", "shard", "ord")}
    cols |= {"levels": pa.array([lev[i - n : i].tobytes() for i, n in zip(ends, lens)], pa.binary()), "exact": pa.array(exact, pa.binary())}
    return pa.table(cols | {k: pa.array(x) for k, x in zip("nvt", sums)})


@dataclass
class Model:
    tokens: int  # N
    distinct: int  # V
    texts: int
    weights: np.ndarray  # of the pair probability, by context bucket

    def parts(self, words: np.ndarray, pairs: np.ndarray, starts: np.ndarray, leave_out=0):
        """From levels: word probability, pair frequency (own occurrence left out where leave_out is 1), context bucket."""
        low, high = counts_of(words, WORD)
        word = (np.sqrt(low * np.maximum(high, low)) + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))
        context = np.concatenate([[0.0], high[:-1]]) if len(high) else high
        context[starts] = self.texts
        pair = np.maximum(counts_of(pairs, PAIR)[0] - leave_out, 0) / np.maximum(context - leave_out, 1)
        bucket = np.minimum(np.log2(context + 1) * 2, BUCKETS - 1).astype(np.int64)
        return word, np.minimum(pair, 1.0), bucket


TOKENS = "docs array<long>, lens array<long>, teach array<boolean>, known array<long>, base array<double>, words binary, pairs binary"


def _join(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's texts with the levels of each token's word and pair, and of each text how many of its tokens
    are known and the sum of log10(count + 0.1)."""
    row = chunk.to_pylist()[0]
    lens, starts, ids, words, _, order, _, at = _ngrams(row)
    got = sorted(answers.to_pylist(), key=lambda r: (r["ord"], r["shard"]))
    body = lambda o, c, kind: np.frombuffer(b"".join(r[c] for r in got if r["ord"] == o), kind)
    word, exact = np.zeros(len(words), np.uint8), np.zeros(len(words), np.int64)
    word[order], exact[order] = body(WORD, "levels", np.uint8), body(WORD, "exact", "<u8")
    known, logs = np.add.reduceat((exact > 0)[ids].astype(np.int64), starts), np.add.reduceat(np.log10(exact + 0.1)[ids], starts)
    out = {c: chunk.column(c) for c in ("docs", "lens", "teach")}
    out |= {"known": pa.array([known], pa.list_(pa.int64())), "base": pa.array([logs], pa.list_(pa.float64()))}
    levels = {"words": word[ids], "pairs": body(PAIR, "levels", np.uint8)[at]}
    return pa.table(out | {c: pa.array([_squeeze(v.tobytes())], pa.binary()) for c, v in levels.items()})


def _tokens(batch):
    """For each chunk: its row, its texts' lengths and starts, which of them teach, and levels of words and pairs."""
    for row in _rows(batch):
        lens = np.array(row["lens"], np.int64)
        yield row, lens, np.cumsum(lens) - lens, np.array(row["teach"], bool), *(np.frombuffer(_unsqueeze(row[c]), np.uint8) for c in ("words", "pairs"))


def _ratios(model):
    """For each context bucket, how often the pair frequency of training texts stands in which
    ratio (in eighths of log2, 0: none) to the word probability."""

    def run(batches):
        seen = np.zeros((BUCKETS, 512), np.int64)
        for batch in batches:
            for _, lens, starts, teach, words, pairs in _tokens(batch):
                word, pair, bucket = model.parts(words, pairs, starts, 1)
                mine = np.repeat(teach, lens)
                word, pair, bucket = word[mine], pair[mine], bucket[mine]
                with np.errstate(divide="ignore"):
                    r = np.where(pair > 0, np.clip(np.log2(pair / word) * 8 + 128, 1, 511), 0).astype(np.int64)
                seen += np.bincount(bucket * 512 + r, minlength=BUCKETS * 512).reshape(BUCKETS, 512)
        b, r = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"b": pa.array(b), "r": pa.array(r), "c": pa.array(seen[b, r])})

    return run


def _scores(model):
    den = np.log10(model.tokens + 0.1 * (model.distinct + 1))

    def run(batches):
        for batch in batches:
            for row, lens, starts, _, words, pairs in _tokens(batch):
                word, pair, bucket = model.parts(words, pairs, starts)
                w = model.weights[bucket]
                score = np.add.reduceat(np.log10(w * pair + (1 - w) * word), starts)
                cols = {"doc_id": pa.array(row["docs"], pa.int64()), "n_tokens": lens, "n_known": pa.array(row["known"], pa.int64()), "base_score": np.array(row["base"]) - lens * den, "score": score}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _weights(rows) -> np.ndarray:
    """Mixing weights by expectation-maximisation over the ratio counts."""
    seen = np.zeros((BUCKETS, 512))
    for r in rows:
        seen[r["b"], r["r"]] = r["c"]
    ratio = np.where(np.arange(512) > 0, 2.0 ** ((np.arange(512) - 128) / 8), 0.0)
    w = np.full(BUCKETS, 0.3)
    for _ in range(60):
        part = w[:, None] * ratio / (w[:, None] * ratio + 1 - w[:, None])
        w = ((seen * part).sum(axis=1) + 0.1) / (seen.sum(axis=1) + 1)
    return np.clip(w, 0.001, 0.98)


def coded_chunks(work: Work, docs: DataFrame) -> DataFrame:
    """The table of chunks of docs (doc_id, text, teach), written."""
    return work.cut(docs.mapInArrow(_chunks(CHUNK_BYTES), CHUNKS), "chunks")


def train(work: Work, chunks: DataFrame) -> tuple[Model, DataFrame]:
    """The model with its weights, and the written table of all texts with the levels of their tokens."""
    tokens = chunks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    dealt = chunks.mapInArrow(_deal(max(8, tokens // SHARD_TOKENS)), "chunk long, shard int, ord int, keys binary, counts binary")
    answers = work.cut(dealt.groupBy("shard", "ord").applyInArrow(_probe, ANSWERS), "answers")
    total = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "t"))).first()
    model = Model(total["n"], total["v"], total["t"], np.zeros(BUCKETS))
    joined = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_join, TOKENS)
    joined = work.cut(joined, "joined")
    work.drop("chunks")
    work.drop("answers")
    seen = joined.mapInArrow(_ratios(model), "b long, r long, c long").groupBy("b", "r").agg(F.sum("c").alias("c")).collect()  # BUCKETS x 512 rows at the most
    model.weights = _weights(seen)
    return model, joined


def score(spark: SparkSession, df: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `training` is a condition on doc_id that says which rows teach.  A null or
    empty text has the end token alone.  Repeated rows teach and are scored
    each; a null id doesn't teach, its held_out is null.  Other columns are not
    read.  An empty table gives no rows; without training rows every count is 0
    and the base score is 0.

    Words are counted by their bytes, so n_known and base_score are exact.
    """
    work = Work(spark, "lm")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("teach"))
    model, joined = train(work, coded_chunks(work, docs))
    out = joined.mapInArrow(_scores(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out(10, 0))
