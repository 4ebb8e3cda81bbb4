"""Sampled SentencePiece segmentations, and lossless decoding.

The piece lattice of a text parts wherever a space follows another character,
because no piece goes on after one.  Each distinct stretch is filtered forward
once: the weight of all its prefixes, and for each position the distribution of
the piece that ends there.  Every occurrence then samples its pieces backward,
with random numbers that hash the row key, the stretch and the position, so a
row's segmentation doesn't depend on partitions, batches or order.  Very long
stretches are filtered and sampled window by window, with the same numbers.

The model is a BPE one, whose scores are merge ranks and no probabilities:
a piece of rank r weighs (r + 1) ** -alpha, as frequencies fall with rank.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held, mix, slices, small_batches

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Vocabulary lookup, forward filtering and backward sampling."""

    def __init__(self, path: str, alpha: float = 1.0, most_positions: int = 2_200_000, long: int = 20_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.ascii = np.array([self.bytes[b] for b in range(128)])
        usable = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        first = min(usable)
        self.out = [name.replace(SPACE, " ").encode() for name in names]  # a text's own mark of space has no piece and becomes bytes
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(self.out), np.uint8)
        self.wide = np.fromiter(map(len, self.out), np.int64, self.size)
        self.from_ = np.cumsum(self.wide) - self.wide
        self.widest = max(len(names[i]) for i in usable)
        assert not any(SPACE in names[i].lstrip(SPACE) for i in usable), "a space stands within a piece"
        self.power = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.widest + 1)], dtype=np.uint64)
        self.logw = np.full(self.size, -np.inf)
        self.logw[usable] = [-alpha * np.log(i - first + 2.0) for i in usable]
        self.weights = np.append(self.logw, -np.inf)  # of no piece, number -1
        self.unknown = -alpha * np.log(self.size + 2.0)
        hashes = np.array([self._whole(names[i].replace(SPACE, " ")) for i in usable], dtype=np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        self.slots = 1 << 18
        self.table = np.full(self.slots, -1, np.int32)
        self.hash = np.zeros(self.size, np.uint64)
        self.hash[usable] = hashes
        self.probes = 1
        for i, h in zip(usable, hashes):
            at, k = int(mix(np.array([h]))[0] & np.uint64(self.slots - 1)), 1
            while self.table[at] >= 0:
                at, k = (at + 1) % self.slots, k + 1
            self.table[at], self.probes = i, max(self.probes, k)
        self.most, self.long = most_positions, long
        self._reset()

    def _whole(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.used = 0
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        if not hasattr(self, "cum"):  # kept over resets; memory is only taken where it is written
            self.cum = np.empty((self.most + 1_200_000, self.widest), np.float32)
            self.ids = np.empty((self.most + 1_200_000, self.widest), np.int32)

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        out, alive = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (mix(h) & np.uint64(self.slots - 1)).astype(np.int64)
        for _ in range(self.probes):
            got = self.table[slot[alive]]
            hit = (got >= 0) & (self.hash[got] == h[alive])
            out[alive[hit]] = got[hit]
            alive = alive[~hit & (got >= 0)]
            if not len(alive):
                break
            slot[alive] = (slot[alive] + 1) % self.slots
        return out

    def _pieces(self, code: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and log weights of the piece of each width that ends at each position. code: character + 1; inner: place within its stretch."""
        ids = np.full((len(code), self.widest), -1, np.int32)
        h = np.zeros(len(code), np.uint64)
        for w in range(1, self.widest + 1):  # hash of the w characters that end at each position
            ok = np.flatnonzero(inner >= w)
            h[ok] = code[ok - w + 1] * self.power[w - 1] + h[ok]
            ids[ok, w - 1] = self._lookup(h[ok])
        logw = self.weights[ids]
        odd = np.flatnonzero((inner > 0) & (ids[:, 0] < 0))  # characters without a piece: their bytes stand for them, put in later if there are several
        c = code[odd].astype(np.int64) - 1
        ids[odd, 0] = np.where(c < 128, self.ascii[np.minimum(c, 127)], -2 - c)
        logw[odd, 0] = self.unknown
        return ids, logw

    def _filter(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, lengths, cumulative probabilities and ids of the piece of each width that ends at
        each position, for stretches laid end to end; position 0 of each is its start."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        off = np.cumsum(n + 1) - n - 1
        total = int((n + 1).sum())
        code = np.zeros(total, np.uint64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        where = np.arange(len(chars)) + np.repeat(np.arange(len(words)), n) + 1
        code[where] = chars.astype(np.uint64) + np.uint64(1)
        inner = np.zeros(total, np.int64)  # place within the stretch
        inner[where] = np.arange(len(chars)) - np.repeat(np.cumsum(n) - n, n) + 1
        ids, logw = self._pieces(code, inner)
        cum = np.ones((total, self.widest), np.float32)
        alpha = np.zeros(total)
        order = np.argsort(inner, kind="stable")
        ends = np.searchsorted(inner[order], np.arange(int(inner.max(initial=0)) + 2))
        steps = np.arange(1, self.widest + 1)
        for e in range(1, len(ends) - 1):
            at = order[ends[e] : ends[e + 1]]
            k = min(e, self.widest)
            v = alpha[at[:, None] - steps[:k]] + logw[at, :k]
            top = v.max(axis=1, keepdims=True)
            c = np.cumsum(np.exp(v - top), axis=1)
            alpha[at] = top[:, 0] + np.log(c[:, -1])
            cum[at, :k] = c / c[:, -1:]
        return off, n, cum, ids

    def _sample_long(self, word: str, salt: np.uint64) -> np.ndarray:
        """Sampled ids of one long stretch, window by window: the weights of its prefixes are kept, 8 bytes a
        character; the tables of a window are made once going forward and again going backward."""
        n, step = len(word), self.long
        code = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)])
        alpha = np.zeros(n + 1)

        def window(a: int, b: int):
            lo = max(a - self.widest, 0)
            ids, logw = self._pieces(code[lo : b + 1], np.arange(lo, b + 1) if not lo else np.arange(b + 1 - lo))
            # behind `lo` a place has fewer characters before it than it really has, but not so from `a` on
            return ids[a - lo :], logw[a - lo :]

        def shares(logw, e: int):
            k = min(e, self.widest)
            v = alpha[e - k : e][::-1] + logw[:k]
            top = v.max()
            c = np.cumsum(np.exp(v - top))
            return c, top

        for a in range(1, n + 1, step):
            b = min(a + step - 1, n)
            _, logw = window(a, b)
            for e in range(a, b + 1):
                c, top = shares(logw[e - a], e)
                alpha[e] = top + np.log(c[-1])
        out, e, a = [], n, n + 1
        while e:
            if e < a:
                a = (e - 1) // step * step + 1
                ids, logw = window(a, min(a + step - 1, n))
            c, _ = shares(logw[e - a], e)
            cum = np.ones(self.widest, np.float32)
            cum[: len(c)] = c / c[-1]
            u = np.float32((mix(np.array([salt]) + np.uint64(e)) >> np.uint64(11)).astype(np.float64)[0] * 2.0**-53)
            w = min(int((cum <= u).sum()), self.widest - 1)
            while ids[e - a, w] == -1:
                w -= 1
            out.append(ids[e - a, w])
            e -= w + 1
        return np.array(out[::-1], np.int32)

    def _add(self, words: list[str]) -> None:
        off, n, cum, ids = self._filter(words)
        while self.used + len(cum) > len(self.cum):
            self.cum = np.concatenate([self.cum, np.empty_like(self.cum)])
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.cum[self.used : self.used + len(cum)] = cum
        self.ids[self.used : self.used + len(cum)] = ids
        self.at |= zip(words, range(len(self.start), len(self.start) + len(words)))
        self.start = np.concatenate([self.start, off + self.used])
        self.length = np.concatenate([self.length, n])
        self.used += len(cum)

    def stretches(self, text: str) -> list[str]:
        """Runs of spaces with what follows them, a space put before the text."""
        parts = text.split(" ")
        if "" not in parts:
            return [" " + p for p in parts]
        out, spaces = [], ""
        for p in parts:
            spaces += " "
            if p:
                out.append(spaces + p)
                spaces = ""
        return [*out, spaces] if spaces else out

    def encode(self, keys: list[int], texts: list[str], seed: int) -> list[np.ndarray]:
        """Sampled ids of each text."""
        if self.used > self.most:
            self._reset()
        rows = mix(np.array([k & (1 << 64) - 1 for k in keys], dtype=np.uint64) + np.uint64(seed & (1 << 64) - 1))
        lists, firsts, owner, long_ones = [], [], [], []  # runs of stretches, each with its text's row and place in it
        for doc, t in enumerate(texts):
            run, first = self.stretches(t) if t else [], 0
            while len(t) >= self.long and max(map(len, run), default=0) > self.long:
                at = next(i for i, w in enumerate(run) if len(w) > self.long)
                lists += [run[:at], []]
                firsts += [first, first + at]
                owner += [doc, doc]
                long_ones.append((len(lists) - 1, run[at]))
                run, first = run[at + 1 :], first + at + 1
            lists.append(run)
            firsts.append(first)
            owner.append(doc)
        row = rows[np.array(owner, np.int64)] if owner else rows
        got = self._sampled(lists, np.array(firsts, np.uint64), row)
        for i, word in long_ones:
            got[i] = self._sample_long(word, mix(row[i : i + 1] + np.array(firsts[i : i + 1], np.uint64) * BASE)[0])
        if long_ones:
            parts: list[list] = [[] for _ in texts]
            for doc, ids in zip(owner, got):
                parts[doc].append(ids)
            got = [np.concatenate(p) for p in parts]
        return [self._expand(x) if (x < 0).any() else x for x in got]

    def _sampled(self, lists: list[list[str]], firsts: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each run of stretches; `firsts` are the places of their first ones in the text, `row` the texts' hashes."""
        new = list(set().union(*lists).difference(self.at))
        new.sort(key=len)
        group, size = [], 0
        for w in new:  # a few hundred thousand positions are filtered at a time
            group.append(w)
            size += len(w) + 1
            if size > 200_000:
                self._add(group)
                group, size = [], 0
        if group:
            self._add(group)
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        seg = np.fromiter(map(self.at.__getitem__, chain.from_iterable(lists)), np.int64, int(lens.sum()))
        inner = (np.arange(len(seg)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.uint64) + np.repeat(firsts, lens)
        salt = mix(np.repeat(row, lens) + inner * BASE)
        base, e, occ = self.start[seg], self.length[seg], np.arange(len(seg))
        got_occ, got_at, got_id = [], [], []
        while len(occ):
            u = (mix(salt[occ] + e.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            pos = base[occ] + e
            w = np.minimum((self.cum[pos] <= u[:, None].astype(np.float32)).sum(axis=1), self.widest - 1)
            w = self._possible(pos, w)
            got_occ.append(occ)
            got_id.append(self.ids[pos, w])
            e = e - w - 1
            got_at.append(e)
            ok = e > 0
            occ, e = occ[ok], e[ok]
        if not got_occ:
            return [np.empty(0, np.int32) for _ in lists]
        o, a, i = np.concatenate(got_occ), np.concatenate(got_at), np.concatenate(got_id)
        order = np.lexsort((a, o))
        o, i = o[order], i[order]
        run = np.repeat(np.arange(len(lists)), lens)[o]
        return np.split(i, np.searchsorted(run, np.arange(1, len(lists))))

    def _possible(self, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Rounding may end past the last piece or at a width without one: the nearest narrower one then."""
        while (bad := self.ids[pos, w] == -1).any():
            w = np.where(bad, w - 1, w)
        return w

    def _expand(self, ids: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                out += [self.bytes[b] for b in chr(-2 - i).encode()]
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8; the space put before each text goes."""
        return self.decode_all([ids])[0]

    def decode_all(self, lists: list[np.ndarray]) -> list[bytes]:
        """Texts of many lists of ids together: the bytes of all pieces are fetched at once."""
        if not lists:
            return []
        ids = np.concatenate(lists).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(self.wide[ids])])
        where = np.repeat(self.from_[ids] - ends[:-1], self.wide[ids]) + np.arange(ends[-1])
        body = self.flat[where].tobytes()
        cuts = ends[np.cumsum([0, *map(len, lists)])].tolist()
        return [body[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


def lattice(path: str, alpha: float) -> Lattice:
    return held(("lattice", path, alpha), lambda: Lattice(path, alpha))


def _encoded(model: Lattice, keys: list, texts: list, seed: int):
    """For slices of the texts: their UTF-8 bytes and their ids."""
    sized = [(t or "").encode() for t in texts]
    for i, j in slices(sized, 1_000_000):
        yield sized[i:j], model.encode([k or 0 for k in keys[i:j]], [t or "" for t in texts[i:j]], seed)


def encode(df: DataFrame, model_path: str, seed: int = 1, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of piece ids).

    A null text gives null ids, an empty one no ids.  The row key, doc_id, and
    `seed` fix the segmentation: rows repeated with the same id and text are
    segmented alike; a null id counts as 0.  Characters outside the vocabulary
    become their bytes.  Other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        model = lattice(model_path, alpha)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            every = chain.from_iterable(ids for _, ids in _encoded(model, keys, texts, seed))
            ids = [None if t is None else x.tolist() for t, x in zip(texts, every)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Null ids give a null text."""

    def run(batches):
        model = lattice(model_path, 1.0)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, model_path: str, seed: int = 1, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode, then decode, without carrying the ids. One row per input row: doc_id, n_pieces,
    ids_crc32 (of unsigned little-endian 32-bit ids), lossless.

    Null and empty texts have no pieces and are lossless.  Row keys, nulls, repeats
    and other columns are as in encode; an empty table gives no rows.
    """

    def run(batches):
        model = lattice(model_path, alpha)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            n, crc, same = [], [], []
            for bodies, lists in _encoded(model, keys, texts, seed):
                n += map(len, lists)
                crc += (zlib.crc32(ids.astype("<u4").tobytes()) for ids in lists)
                same += (a == b for a, b in zip(model.decode_all(lists), bodies))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
