"""Language identification, word first: a known word is scored by its frequency in
each language, an unseen one by ever shorter character n-grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held, mix, slices, small_batches, texts_of

LETTERS = re.compile(r"[^\W\d_]+")
GRAMS = (4, 3, 2, 1)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a mark at either end."""
    w = f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Per-language log frequencies, less the best language's. tables[0]: words; tables[n]: n-grams;
    each a number per entry, and a row of `rows[n]` for each number."""

    langs: list[str]
    tables: dict[int, dict[str, int]]
    rows: dict[int, np.ndarray]


def _partial(batches):
    """Counts of words and n-grams of one task, by language."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            counts.setdefault(lang, Counter()).update(LETTERS.findall(text.decode().lower()))
    for lang, words in counts.items():
        tables = {0: words} | {n: Counter() for n in GRAMS}
        for w, c in words.items():
            for n in GRAMS:
                for g in grams(w, n):
                    tables[n][g] += c
        for n, table in tables.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(table), "n": pa.array([n] * len(table), pa.int32()), "gram": list(table), "c": pa.array(table.values(), pa.int64())},
                schema=pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("c", pa.int64())]),
            )


def train(df: DataFrame, most_rows: int = 4000, least_count: int = 3) -> Model:
    """df: doc_id, text, lang. Learns from about `most_rows` labelled rows, the same number
    of each language at the most and small languages whole, picked by a hash of doc_id; that
    bound on rows bounds the model that is collected and sent to the workers.  The languages
    are those of all labelled rows.  Words and n-grams seen fewer than `least_count` times
    in the picked rows stay unseen.  Rows with null text or lang teach nothing; with no
    labelled row the model has no languages.
    """
    small_batches(df.sparkSession)
    rows = df.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # as many rows as languages
    langs = sorted(sizes)
    if sum(sizes.values()) > most_rows:
        each = most_rows / len(langs)
        large = F.create_map(*(F.lit(x) for k in langs if sizes[k] > each for x in (k, int((1 << 40) * each / sizes[k]))))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.coalesce(F.element_at(large, F.col("lang")), F.lit(1 << 40)))
    counts = rows.select("lang", "text").mapInArrow(_partial, "lang string, n int, gram string, c long")
    cells = [F.sum(F.when(F.col("lang") == k, F.col("c")).otherwise(0)).alias(f"c{i}") for i, k in enumerate(langs)]
    if not langs:
        return Model([], {n: {} for n in (0, *GRAMS)}, {})
    got = counts.groupBy("n", "gram").agg(F.sum("c").alias("c"), *cells).where(F.col("c") >= least_count).toArrow()
    number, gram = got.column("n").to_numpy(), got.column("gram").to_pylist()
    m = np.column_stack([got.column(f"c{i}").to_numpy() for i in range(len(langs))]).astype(float)
    tables, logs = {}, {}
    for n in (0, *GRAMS):
        at = np.flatnonzero(number == n)
        tables[n] = {gram[j]: i for i, j in enumerate(at)}
        part = np.log((m[at] + 0.5) / (m[at].sum(axis=0) + 0.5 * (len(at) + 1)))
        logs[n] = part - part.max(axis=1, keepdims=True) if len(at) else part
    return Model(langs, tables, logs)


class Grams:
    """Hashes of the known n-grams of one n, sorted, and the row of each."""

    def __init__(self, table: dict[str, int], n: int):
        codes = np.array([[ord(c) for c in g] for g in table], dtype=np.uint64).reshape(-1, n)
        h = self.hash(codes.T) if len(codes) else np.empty(0, np.uint64)
        order = np.argsort(h)
        self.n, self.keys, self.row = n, h[order], np.array(list(table.values()), np.int64)[order]

    @staticmethod
    def hash(codes) -> np.ndarray:
        h = np.zeros(len(codes[0]), np.uint64)
        for c in codes:
            h = mix(h + c + np.uint64(1))
        return h

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of the n-gram that starts at each place, -1 if it isn't known."""
        n = self.n
        if len(codes) < n or not len(self.keys):
            return np.full(max(len(codes) - n + 1, 0), -1, np.int64)
        h = self.hash([codes[i : len(codes) - n + 1 + i] for i in range(n)])
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.row[at], -1)


class Scorer:
    """Sums the vectors of texts' words. Stretches between white space are looked up whole and
    kept; new ones are worked out together.  What is kept is emptied at `most` stretches, which
    bounds memory and changes no result."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most, self.width = model, most, len(model.langs)
        self.grams = [Grams(model.tables[n], n) for n in GRAMS]
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.width + 1))

    def unseen(self, words: list[str]) -> np.ndarray:
        """Vectors of words that aren't in the model, by the longest n-grams that are."""
        marked = [f"\x02{w}\x03" for w in words]
        lens = np.fromiter(map(len, marked), np.int64, len(words))
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), lens)
        out, open_ = np.zeros((len(words), self.width)), np.ones(len(words), bool)
        for g in self.grams:
            row = g.rows(codes)
            first = np.arange(len(row))
            at = first[(row >= 0) & (owner[: len(row)] == owner[first + g.n - 1]) & open_[owner[: len(row)]]]
            if len(at):
                vectors, who = self.model.rows[g.n][row[at]], owner[at]
                hits = np.bincount(who, minlength=len(words))
                got = np.flatnonzero(hits)
                for k in range(self.width):
                    out[got, k] = np.bincount(who, vectors[:, k], len(words))[got] / hits[got]
                open_[got] = False
        return out

    def _add(self, stretches: list[bytes]) -> None:
        lists = [LETTERS.findall(s.decode().lower()) for s in stretches]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        words = [w for ws in lists for w in ws]
        index = np.fromiter((self.model.tables[0].get(w, -1) for w in words), np.int64, len(words))
        vectors = np.zeros((len(words), self.width))
        if self.width:
            known = index >= 0
            vectors[known] = self.model.rows[0][index[known]]
            vectors[~known] = self.unseen([w for w, k in zip(words, known.tolist()) if not k])
        owner = np.repeat(np.arange(len(lists)), lens)
        new = np.zeros((len(lists), self.width + 1))
        for k in range(self.width):
            new[:, k] = np.bincount(owner, vectors[:, k], len(lists))
        new[:, -1] = lens
        self.at |= zip(stretches, range(len(self.rows), len(self.rows) + len(lists)))
        self.rows = np.concatenate([self.rows, new])

    def predict(self, texts: list[bytes]):
        """(language, probability) of each text."""
        for i, j in slices(texts, 1_000_000):
            if len(self.at) > self.most:
                self._reset()
            lists = [t.split() for t in texts[i:j]]
            if new := list(set().union(*lists).difference(self.at)):
                self._add(new)
            for ws in lists:
                total = self.rows[np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                if not total[-1] or not self.width:
                    yield "und", 0.0
                    continue
                logs = total[:-1] - total[:-1].max()
                best = int(np.argmax(logs))
                yield self.model.langs[best], float(1 / np.exp(logs).sum())


def predict(spark: SparkSession, df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    A text that is null or has no letter is `und` with score 0, as is any text
    when the model has no languages.  Ties go to the language that sorts first.
    Texts are scored whole; other columns are not read; repeats give repeats.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            got = list(scorer.predict(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(sent, least_score: float):
    """Column function on a text: whether a language is told with `least_score` at least."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        scorer = shared_scorer(sent)
        texts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array([lang != "und" and score >= least_score for lang, score in scorer.predict(texts)], pa.bool_())

    return judge


def shared_scorer(sent) -> Scorer:
    return held(("scorer", id(sent.value)), lambda: Scorer(sent.value))


def held_out(modulus: int, remainder: int):
    """crc32 of doc_id written as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(3, 1)))
    return predict(spark, docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())
