"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once; what is longer than a sequence is cut into full
sequences and a rest.  The histogram of piece lengths (4096 counts at most) is
placed on the driver, longest length first, each time into the open packs that
are shortest so far; packs with the same contents are one pattern, held as a
range of sequence numbers.  Each placing says which ranks of a length go to
which range, so a join of pieces to patterns by rank gives every place.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Work, held, texts_of

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_letters() -> dict[int, str]:
    """The public byte-level BPE alphabet: printable bytes stand for themselves,
    the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a text by a `tokenizers` file, packed, little-endian unsigned 32-bit.

    A file with the normaliser and splitter of PARTED drops white space and so never
    joins what white space parts: each stretch between ASCII white space is
    encoded once and its ids are kept.  With any other file each text goes
    through the whole encoder.

    Stretches of Latin-1 letters and ASCII punctuation after them go to the BPE model at
    once (the file's normaliser and splitter do no more to them than lower-case
    them and part the punctuation); all others go through the whole encoder.
    The cache is emptied when it has `most` entries; that bounds memory only.
    """

    # The normaliser and splitter that the short ways below are right for.
    PARTED = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    )
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")  # an apostrophe may begin a contraction

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.most, self.cache, self.letters = Tokenizer.from_file(path), most, {}, _byte_letters()
        self.model = self.whole.model
        parts = json.loads(self.whole.to_str())
        special = [t["content"] for t in parts["added_tokens"]]
        self.parted = (parts["normalizer"], parts["pre_tokenizer"]) == self.PARTED and parts["model"]["type"] == "BPE" and not any(t.split() != [t] for t in special)

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        key = part.encode()
        if (got := self.cache.get(key)) is None:
            byted = part.lower() if part.isascii() else "".join(map(self.letters.__getitem__, unicodedata.normalize("NFC", part).lower().encode()))
            got = self.cache[key] = self._pack([t.id for t in self.model.tokenize(byted)])
        return got

    def _stretch(self, word: bytes) -> bytes:
        if len(self.cache) >= self.most:
            self.cache.clear()
        text = word.decode()
        if m := self.PLAIN.fullmatch(text):
            if not m[2]:
                return self._part(text)
            got = self._part(m[1]) + self._part(m[2])
        else:
            got = self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        self.cache[word] = got
        return got

    def packed(self, text: bytes) -> bytes:
        if not self.parted:
            return self._pack(self.whole.encode(text.decode(), add_special_tokens=False).ids)
        words = text.split()
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self._stretch(w) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)


def tokenizer(path: str) -> WordTokenizer:
    return held(("tokenizer", path), lambda: WordTokenizer(path))


def pieces_of(path: str, most: int, end_id: int, with_ids: bool = False):
    """mapInArrow function: a row for each piece of each document."""

    def run(batches):
        encode, end = tokenizer(path).packed, int(end_id).to_bytes(4, "little")
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, most):
                    piece = ids[4 * start : 4 * (start + most)]
                    for k, v in zip(cols, (doc, start, len(piece) // 4, zlib.crc32(piece), n, piece)):
                        cols[k].append(v)
            arrays = {k: pa.array(v, pa.int64()) for k, v in cols.items() if k != "ids"}
            if with_ids:
                arrays["ids"] = pa.array(cols["ids"], pa.binary())
            yield pa.RecordBatch.from_pydict(arrays)

    return run


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places (length, rank from, rank to, first sequence, copies, offset): the
    rank r of a length in [from, to) goes to sequence first + (r - from) // copies
    at offset + (r - from) % copies * length.

    Lengths come longest first.  The open pattern with the most room is the
    shortest pack; it takes one piece per pack and becomes a pattern with less
    room, and is parted if more packs than pieces are left.  If none has room,
    new packs open, filled with as many copies as fit.
    """
    places, room, heap, sequences = [], {}, [], 0

    def put(left: int, first: int, count: int) -> None:
        if count and left:
            if not room.get(left):
                heapq.heappush(heap, -left)
            room.setdefault(left, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while rank < n:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            left = -heap[0] if heap else 0
            if left >= length:
                first, count = room[left].pop()
                took = min(count, n - rank)
                places.append((length, rank, rank + took, first, 1, most - left))
                put(left - length, first, took)
                put(left, first + took, count - took)
                rank += took
            else:
                fit = most // length
                for copies in (fit, (n - rank) % fit):
                    packs = (n - rank) // copies if copies else 0
                    if packs:
                        places.append((length, rank, rank + packs * copies, sequences, copies, 0))
                        put(most - copies * length, sequences, packs)
                        sequences, rank = sequences + packs, rank + packs * copies
    return places


def _assign(places):
    """mapInArrow function that looks up each piece's place by length and rank."""
    by: dict[int, list] = {}
    for p in places:
        by.setdefault(p[0], []).append(p)
    by = {k: sorted(v, key=lambda p: p[1]) for k, v in by.items()}
    starts = {k: [p[1] for p in v] for k, v in by.items()}

    def run(batches):
        for batch in batches:
            seq, off = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                _, first, _, base, copies, at = by[length][bisect_right(starts[length], rank) - 1]
                seq.append(base + (rank - first) // copies)
                off.append(at + (rank - first) % copies * length)
            cols = {f.name: batch.column(f.name) for f in batch.schema if f.name != "rank"}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(off, pa.int64())})

    return run


def ranked(pieces: DataFrame, rows: int, rows_a_salt: int = 100_000) -> DataFrame:
    """Adds `salt`, and `rank`: 0, 1, ... within each length.

    A length that very many pieces share (full sequences, copies) is ranked in
    salted parts and the parts' sizes are summed up, so no task holds a length.
    """
    salts = max(16, rows // rows_a_salt)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("from"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    return salted.withColumn("within", within).join(starts, ["length", "salt"]).withColumn("rank", F.col("from") + F.col("within") - 1).drop("within", "from", "salt")


def pack(spark: SparkSession, df: DataFrame, tokenizer_path: str, most: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, packed unsigned 32-bit, on request).

    Null and empty texts give one piece that holds end_id alone.  Rows repeated
    with the same id are packed each; a null id stays null.  Texts of any length
    are cut at multiples of `most`.  Other columns are not read.  An empty table
    gives no rows.
    """
    work = Work(spark, "packing")
    schema = PIECE + (", ids binary" if with_ids else "")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = work.cut(source.mapInArrow(pieces_of(tokenizer_path, most, end_id, with_ids), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `most` rows at the most
    places = shortest_pack_first(histogram, most)
    return ranked(pieces, sum(histogram.values())).select(*[c.split()[0] for c in schema.split(", ")], "rank").mapInArrow(_assign(places), f"{schema}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
