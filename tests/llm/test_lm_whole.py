"""What the language model learns isn't capped: n-grams seen once stay in it, whatever the input's size."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm
from tessera.llm.common import Work
from tessera.llm.langid import held_out


@pytest.mark.parametrize("order", [lm.WORD, lm.PAIR])
def test_every_ngram_is_kept(order):
    """One shard over three chunks: the floor is 1, and keys that no text teaches have level 0 but for false hits."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 60, 30000, dtype=np.uint64))
    mine = [np.sort(rng.choice(keys, 20000, replace=False)) for _ in range(3)]
    counts = [rng.integers(0, 3, 20000) for _ in range(3)]
    blob = (lambda k: b"\n".join(b"%d" % x for x in k.tolist())) if order == lm.WORD else (lambda k: k.tobytes())
    table = pa.table({"chunk": [7, 8, 9], "shard": pa.array([0] * 3, pa.int32()), "ord": pa.array([order] * 3, pa.int32()), "keys": [blob(k) for k in mine], "counts": [c.astype("<u4").tobytes() for c in counts]})
    out = lm._probe(table).to_pylist()
    total = Counter()
    for k, c in zip(mine, counts):
        for x, y in zip(k.tolist(), c.tolist()):
            total[x] += y
    for row, k in zip(out, mine):
        lev, sums = np.frombuffer(row["levels"], np.uint8), np.array([total[x] for x in k.tolist()])
        want = lm.level(sums, 1, lm.BASE[order])
        assert (lev >= want).all() and (lev == want).mean() > 0.9 and (want[sums == 1] == 1).all()
        if order == lm.WORD:
            assert (np.frombuffer(row["exact"], "<u8") == sums).all()
    if order == lm.WORD:
        assert out[0]["n"] == sum(total.values()) and out[0]["v"] == sum(c > 0 for c in total.values())


def corpus():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 1 + i % 90) % 500) for i in range(300)]
    return list(enumerate([*texts, *texts[:5], None, "", "  two\u00a0words \u000b end\t"]))


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("size", [500, 12_000_000])
def test_levels_of_tokens(spark, rows, size, monkeypatch):
    """Over small chunks and many shards each token gets the level of its word's and its pair's count in the
    training texts; counts of words are exact, and scores are those of the mixture computed from exact levels."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    teach = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in corpus()}
    words, pairs = Counter(), Counter()
    for i, t in corpus():
        if teach[i]:
            ts = tokens(t)
            words.update(ts), pairs.update(zip([None, *ts], ts))
    assert min(words.values()) == min(pairs.values()) == 1
    work = Work(spark, "lm")
    chunks = lm.coded_chunks(work, rows.withColumn("teach", ~held_out(10, 0)))
    assert chunks.count() > (30 if size == 500 else 0)
    model, joined = lm.train(work, chunks)
    assert (model.tokens, model.distinct, model.texts) == (sum(words.values()), len(words), sum(teach.values()))
    texts, same, seen = dict(corpus()), [], set()
    for batch in joined.toArrow().to_batches():
        for row, lens, starts, mine, lw, lp in lm._tokens(batch):
            for d, n, s, m, known in zip(row["docs"], lens, starts, mine, row["known"]):
                ts = tokens(texts[d])
                assert (n, m, known) == (len(ts), teach[d], sum(words[t] > 0 for t in ts))
                for got, order, counts in ((lw, lm.WORD, [words[t] for t in ts]), (lp, lm.PAIR, [pairs[p] for p in zip([None, *ts], ts)])):
                    want = lm.level(np.array(counts), 1, lm.BASE[order])
                    assert (got[s : s + n] >= want).all()
                    same.extend(got[s : s + n] == want)
                seen.add(d)
    assert seen == set(texts) and np.mean(same) > 0.8


def test_scores_by_exact_counts(spark, rows):
    """The filter in place of exact counts changes scores by its false hits alone."""
    teach = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in corpus()}
    words, pairs = Counter(), Counter()
    for i, t in corpus():
        if teach[i]:
            ts = tokens(t)
            words.update(ts), pairs.update(zip([None, *ts], ts))
    work = Work(spark, "lm")
    model, joined = lm.train(work, lm.coded_chunks(work, rows.withColumn("teach", ~held_out(10, 0))))
    kept = {(d, o): lev[s : s + n] for batch in joined.toArrow().to_batches() for row, lens, starts, _, *both in lm._tokens(batch) for o, lev in zip((lm.WORD, lm.PAIR), both) for d, n, s in zip(row["docs"], lens, starts)}
    got = {r["doc_id"]: r["score"] for r in lm.score(spark, rows, ~held_out(10, 0)).collect()}
    clean = 0
    for i, t in corpus():
        ts, total, false = tokens(t), 0.0, 0
        for k, (w, p) in enumerate(zip(ts, zip([None, *ts], ts))):
            level = lambda c, o: 1 + int(math.log(c) / math.log(lm.BASE[o]) + 1e-9) if c else 0
            lw, lp = level(words[w], lm.WORD), level(pairs[p], lm.PAIR)
            false += (lw != kept[i, lm.WORD][k]) + (lp != kept[i, lm.PAIR][k])
            low, high = math.ceil(1.2 ** (lw - 1)) if lw else 0, 1.2**lw if lw else 0
            word = (math.sqrt(low * max(high, low)) + 0.1) / (model.tokens + 0.1 * (model.distinct + 1))
            context = sum(teach.values()) if k == 0 else (1.2 ** level(words[ts[k - 1]], lm.WORD) if words[ts[k - 1]] else 0)
            share = min((2 ** (lp - 1) if lp else 0) / max(context, 1), 1.0)
            weight = model.weights[min(int(math.log2(context + 1) * 2), lm.BUCKETS - 1)]
            total += math.log10(weight * share + (1 - weight) * word)
        clean += not false
        assert abs(got[i] - total) < 1e-6 + 1.5 * false
    assert clean > 50


def test_null_ids_and_clashes(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, None)], "doc_id long, text string")
    for name in ("teach", "chunk", "words", "score", "n"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["train_tokens"]) for r in lm.score(spark, df, F.col("doc_id") == 3).collect()), key=repr)
    assert got == [(0, None, 3, 6), (3, False, 3, 6), (3, False, 3, 6), (4, True, 1, 6)]
