"""Operators on documents against brute force, with nulls, empties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact, langid, lm, minhash, packing, pieces, substrings

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]


def phrase(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    base, passage = phrase(120), phrase(60)
    texts = [phrase(RNG.randint(1, 80)) for _ in range(25)] + [None, "", " \t\n ", "a b", "A B", base, base, base.upper(), phrase(4), "x " * 90]
    for _ in range(6):
        w = base.split()
        w[RNG.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [phrase(20) + " " + passage + " " + phrase(30) for _ in range(4)]
    texts += ["été naïve ﬁ 日本語 ▁ \U0001f600  two  spaces\n", "long " + phrase(5000)]
    return list(enumerate(texts))


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("key", "n", "file", "row", "rep", "digest", "spans", "length", "start", "word", "score", "kept", "salt", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def low(t):
    return (t or "").encode().lower()


def groups(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bits", [256, 3])
def test_exact(spark, docs, empty, bits):
    got = {r["doc_id"]: r for r in exact.dedup(spark, docs, digest_bits=bits).collect()}
    same = {}
    for i, t in ROWS:
        same.setdefault(low(t), []).append(i)
    for i, t in ROWS:
        r, g = got[i], same[low(t)]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256(low(t)).hexdigest())
    assert exact.dedup(spark, empty).count() == 0


def test_exact_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "c")], "doc_id long, text string")
    assert sorted(map(repr, exact.distinct_rows(spark, df).collect())) == ["Row(doc_id=1, text='a')", "Row(doc_id=2, text='b')", "Row(doc_id=2, text='c')"]


@pytest.mark.parametrize("bits", [256, 2])
def test_exact_goes_on(spark, tmp_path, bits):
    """Two calls with one state: the second's rows are judged against the first's too, on full bytes."""
    first = [(1, "a b"), (5, "A B"), (2, "c"), (3, None)]
    second = [(4, "a B"), (9, "C"), (6, "d"), (7, "")]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / str(k)))
    run = lambda k: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.dedup(spark, spark.read.parquet(str(tmp_path / str(k))), digest_bits=bits, state=str(tmp_path / "state")).collect())
    assert run(0) == [(1, 5, 2, False), (2, 2, 1, True), (3, 3, 1, True), (5, 5, 2, True)]
    assert run(1) == [(4, 5, 3, False), (6, 6, 1, True), (7, 7, 2, True), (9, 9, 2, True)]


def test_exact_stream_continues(spark, tmp_path):
    from tessera.llm.common import Work

    work, at = Work(spark, "t"), str(tmp_path / "rows")
    rows = lambda k, ids: spark.createDataFrame([(i, "f", i, bytes([i % 3])) for i in ids], "doc_id long, file string, row long, digest binary").write.mode("append").parquet(at)
    rows(0, range(6))
    schema = spark.read.parquet(at).schema
    assert {r["n"] for r in exact.stream_groups(work, at, schema, str(tmp_path / "s"), str(tmp_path / "o")).collect()} == {2}
    rows(1, range(6, 9))
    again = exact.stream_groups(work, at, schema, str(tmp_path / "s"), str(tmp_path / "o")).collect()
    assert {(r["n"], r["keep"]["doc_id"]) for r in again} == {(3, 6), (3, 7), (3, 8)}


@pytest.mark.parametrize("chunk", [2048, 3])
def test_minhash(spark, docs, empty, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, docs).collect()}
    sets = {}
    for i, t in ROWS:
        w = low(t).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    assert len(links) > 20
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)
    assert minhash.near_duplicates(spark, empty).count() == 0


def variants(rng, n, edits, copies):
    """A text of n words and copies of it that grow apart: each is an edit of one before it."""
    out = [[rng.choice(WORDS) for _ in range(n)]]
    for _ in range(copies):
        w = list(rng.choice(out))
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("chunk", [2048, 7])
def test_minhash_across(spark, chunk, monkeypatch):
    """Families whose members aren't all like their centre: links between a bucket's components are found too."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(11)
    texts = [t for n, edits, copies in ((60, 2, 90), (150, 4, 90), (30, 1, 40)) for t in variants(rng, n, edits, copies)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, range(len(sets)))
    seen = []
    real = minhash._blocks
    monkeypatch.setattr(minhash, "_blocks", lambda rows: seen.append(rows.count()) or real(rows))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert seen[0] > 20 and len(set(want.values())) > 3
    assert got == want


def test_minhash_repeats(spark):
    """Rows with the same id are linked by their own texts; the rows that stay are told by place."""
    rng = random.Random(3)
    x, y = ([rng.choice(WORDS) for _ in range(100)] for _ in range(2))
    near = lambda w: " ".join(w[:50] + ["edit"] + w[51:])
    rows = [(5, " ".join(x)), (5, " ".join(y)), (6, near(y)), (7, near(x)), (None, " ".join(x))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("clash"))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in minhash.near_duplicates(spark, df).collect())
    assert got == [(0, None), (5, 5), (5, 5), (6, 5), (7, 5)]
    rows = [(3, near(y)), (5, " ".join(x)), (5, " ".join(y)), (5, " ".join(x)), (None, None)]
    kept = minhash.distinct_rows(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[4]]))


def test_minhash_misses_few(spark):
    """Pairs near the threshold, long and short: all found."""
    rng, rows = random.Random(1), []
    for i in range(150):
        n = rng.choice([12, 30, 200])
        w = [rng.choice(WORDS) for _ in range(n)]
        v = list(w)
        for _ in range(max(1, n // 60)):
            v[rng.randrange(n)] = "edit"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    near = [i for i in range(0, 300, 2) if 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near and all(got[i + 1] == i for i in near)


def substring_brute(rows):
    seen = Counter()
    words = {i: (t or "").encode().split() for i, t in rows}
    for w in words.values():
        seen.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_substrings(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = ROWS + [(1000 + i, " ".join(RNG.choice("ab") for _ in range(120))) for i in range(3)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(ROWS) :], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup_substrings(spark, df).collect()}
    assert got == substring_brute(rows)
    text = {r["doc_id"]: r for r in substrings.dedup_substrings(spark, docs, with_text=True, carry=("length",)).collect()}
    assert all(text[i]["kept"] == t for i, t in ROWS if not text[i]["n_removed"]) and text[0]["length"] == "clash"
    assert substrings.dedup_substrings(spark, empty).count() == 0


@pytest.mark.parametrize("hot", [4000, 1])
def test_substrings_all_by_the_index(spark, docs, hot, monkeypatch):
    """Nothing is removed that the index didn't find, of copies and hot anchors too."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "_search", lambda table: table.select(["anchor", "whole", "hot"]).slice(0, 0).append_column("a", table.column("anchor").slice(0, 0)).append_column("b", table.column("anchor").slice(0, 0)))
    assert all(r["n_removed"] == 0 for r in substrings.dedup_substrings(spark, docs).collect())


def test_substrings_repeats(spark):
    """Rows with the same id keep their own texts."""
    passage = phrase(40)
    rows = [(1, "a b " + passage), (1, passage + " c"), (1, "x y"), (None, "z " + passage), (2, None), (2, "")]
    got = substrings.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("clash")), with_text=True, carry=("file",))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [(1, "clash", 42, 40, "a b"), (1, "clash", 41, 40, "c"), (1, "clash", 2, 0, "x y"), (None, "clash", 41, 40, "z"), (2, "clash", 0, 0, None), (2, "clash", 0, 0, "")]))


def test_fm_index():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = substrings.FMIndex(text, 12)
    ends = np.arange(20, 300)
    got = substrings.matching(index, text, ends, 10)
    for e, g in zip(ends, got):
        best = max((n for n in range(11) if n == 0 or sum((text[i : i + n] == text[e - n + 1 : e + 1]).all() for i in range(300 - n + 1)) > 1), default=0)
        assert g == best


def test_repeated_windows(monkeypatch):
    """Runs of windows that stand in two places, by brute force, for any guess of what is likely."""
    monkeypatch.setattr(substrings, "WINDOW", 4)
    monkeypatch.setattr(substrings, "DEPTH", 8)
    rng = np.random.default_rng(8)
    lens = rng.integers(4, 30, 60)
    parts = [rng.integers(1, 4, n) for n in lens]
    for i in range(0, 60, 3):
        parts[i] = np.where(rng.random(lens[i]) < 0.1, 5, parts[i - 1][np.arange(lens[i]) % lens[i - 1]])
    text = np.concatenate([np.append(p, 0) for p in parts])
    at = np.cumsum(lens + 1) - lens - 1
    seen = Counter(tuple(p[j : j + 4]) for p in parts for j in range(len(p) - 3))
    want = {(i, j) for i, p in enumerate(parts) for j in range(len(p) - 3) if seen[tuple(p[j : j + 4])] > 1}
    for likely in (np.ones(60, bool), np.zeros(60, bool), rng.random(60) < 0.5):
        got = list(zip(*substrings.repeated_windows(substrings.FMIndex(text, 8), text, at, lens - 3, likely)))
        assert {(i, j) for i, a, b in got for j in range(a, b + 1)} == want
        assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(got, got[1:]))


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [2] for i, t in ROWS}
    rows = packing.pack(spark, docs, path, most=512, with_ids=True).collect()
    taken = {i: [] for i in ids}
    for r in rows:
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert piece == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        taken[r["doc_id"]].append((r["start"], r["length"]))
    for i, t in taken.items():
        at = 0
        for s, n in sorted(t):
            assert s == at
            at += n
        assert at == len(ids[i])
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512
    assert packing.pack(spark, empty, path).count() == 0


def test_shortest_pack_first():
    rng = np.random.default_rng(1)
    for most, n in ((64, 3000), (4096, 20000), (16, 5)):
        h = Counter(np.minimum(rng.geometric(4 / most, n), most).tolist())
        used, ranks = Counter(), {k: [] for k in h}
        for length, a, b, first, copies, offset in packing.shortest_pack_first(h, most):
            ranks[length].append((a, b))
            for r in range(a, b):
                used[first + (r - a) // copies] += length
        for k, v in ranks.items():
            assert [a for a, _ in sorted(v)] == [0, *[b for _, b in sorted(v)][:-1]] and max(b for _, b in v) == h[k]
        assert max(used.values()) <= most and set(used) == set(range(len(used)))
        if n > 1000:
            assert sum(used.values()) / (most * len(used)) > 0.98


def test_pieces(spark, docs, empty):
    path = pieces.default_model()
    ids = pieces.encode(docs, path, seed=3).cache()
    got = {r["doc_id"]: r["text"] for r in pieces.decode(ids, path).collect()}
    assert got == dict(ROWS)
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(7), path, seed=3).collect()}
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == again
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, path, seed=4).collect()}
    assert other != again
    assert pieces.encode(empty, path).count() == 0
    assert all(r["lossless"] for r in pieces.digests(docs, path).collect())


def test_pieces_distribution():
    model = pieces.Lattice(pieces.default_model())
    names = {}
    for i, p in enumerate(model.out):
        if np.isfinite(model.logw[i]):
            names.setdefault(p.decode(), i)

    def cuts(s):
        if not s:
            yield ()
        for j in range(1, len(s) + 1):
            if s[:j] in names:
                for rest in cuts(s[j:]):
                    yield (names[s[:j]], *rest)

    weight = {c: math.exp(sum(model.logw[i] for i in c)) for c in cuts(" hello")}
    total, n = sum(weight.values()), 30_000
    seen = Counter(tuple(x.tolist()) for x in model.encode(list(range(n)), ["hello"] * n, 5))
    assert set(seen) <= set(weight) and all(abs(seen[c] / n - w / total) < 0.02 for c, w in weight.items())


def test_pieces_of_long_stretches():
    """A stretch has the same pieces whether it is sampled whole or window by window, and takes bounded time and memory."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeghilnorst") for _ in range(n)) for n in (5, 90, 301, 1000)] + ["aé日\u0301\U0001f600" * 60, "short words only", "one " + "x" * 250 + " two  " + "ab" * 90, "", "   "]
    whole, parted = pieces.Lattice(pieces.default_model()), pieces.Lattice(pieces.default_model(), long=40)
    keys = list(range(len(texts)))
    for seed in (1, 2):
        for a, b, t in zip(whole.encode(keys, texts, seed), parted.encode(keys, texts, seed), texts):
            assert a.tolist() == b.tolist() and whole.decode(b).decode() == t
    long = "".join(rng.choice("abcdeghilnorst") for _ in range(60_000))
    assert whole.decode(whole.encode([1], [long], 1)[0]).decode() == long and whole.used < 50_000


def test_pieces_query(spark, docs, empty):
    """Each row's digest is that of its own segmentation."""
    path = pieces.default_model()
    ids = {r["doc_id"]: r["ids"] or [] for r in pieces.encode(docs, path).collect()}
    for r in pieces.digests(docs.withColumn("lossless", F.lit("clash")), path).collect():
        assert (r["n_pieces"], r["ids_crc32"], r["lossless"]) == (len(ids[r["doc_id"]]), zlib.crc32(np.array(ids[r["doc_id"]], "<u4").tobytes()), True)
    assert pieces.digests(empty, path).count() == 0


def test_packing_with_other_tokenizers(spark, docs, tmp_path):
    """A tokenizer that doesn't part at white space is asked for whole texts."""
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(packing.default_tokenizer())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "t.json"))
    assert packing.WordTokenizer(packing.default_tokenizer()).parted and not packing.WordTokenizer(str(tmp_path / "t.json")).parted
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(spark, docs, str(tmp_path / "t.json")).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in ROWS}


def test_language(spark):
    rng = random.Random(2)
    say = {"xx": ["the", "thing", "with", "of", "and"], "yy": ["der", "und", "nicht", "über", "das"], "zz": ["que", "para", "niño", "los", "con"]}
    rows = [(i, " ".join(rng.choice(say[k]) + rng.choice(["", rng.choice(say[k])]) for _ in range(12)), k) for i in range(300) for k in [rng.choice(list(say))]]
    rows += [(900, None, "xx"), (901, "12 !? 34", "yy"), (902, "", None), (903, "the thing", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    out = langid.held_out(3, 1)
    model = langid.train(df.select("doc_id", "text", "lang").where(~out))
    got = {r["doc_id"]: r for r in langid.predict(spark, df, model).select("*", out.alias("held")).collect()}
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == r["held"] for i, r in got.items())
    held = [(i, k) for i, _, k in rows[:300] if got[i]["held"]]
    assert sum(got[i]["lang_pred"] == k for i, k in held) / len(held) > 0.98
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902)) and got[903]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.train(df.where("false").select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(spark, df, nothing).collect()} == {"und"} and langid.predict(spark, df.where("false"), model).count() == 0


def test_language_backoff():
    """An unseen word takes the mean of its longest known n-grams."""
    tables = {0: {"abc": 0}, 4: {"abcd": 0}, 3: {"bcd": 0, "cde": 1}, 2: {"xy": 0}, 1: {"q": 0}}
    rows = {n: np.arange(2 * max(len(t), 1), dtype=float).reshape(-1, 2) + 10 * n for n, t in tables.items()}
    s = langid.Scorer(langid.Model(["a", "b"], tables, rows))
    got = s.unseen(["zabcdz", "abcde", "bcde", "xyz", "qq", "zz"])
    assert got.tolist() == [[40, 41], [40, 41], [31, 32], [20, 21], [10, 11], [0, 0]]


def test_lm(spark, docs, empty):
    got = {r["doc_id"]: r for r in lm.score(spark, docs, ~langid.held_out(10, 0)).collect()}
    tokens = {i: low(t).split() + [b"\n"] for i, t in ROWS}
    seen = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(seen[w] > 0 for w in ws), n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert lm.score(spark, empty, ~langid.held_out(10, 0)).count() == 0


def test_lm_chunks(spark, docs, monkeypatch):
    """However texts are cut into chunks, the base scores are the same."""
    got = {}
    for most in (12_000_000, 300):
        monkeypatch.setattr(lm, "CHUNK_BYTES", most)
        got[most] = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score(spark, docs, ~langid.held_out(10, 0)).collect()}
    assert got[12_000_000] == got[300]


def test_bloom_levels():
    """No key that was put in is missed or comes back lower; false ones are few."""
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = rng.geometric(0.05, 5000)
    blob = lm._blobs(keys, counts, lm.PAIR, 8).to_pylist()
    assert b"".join(r["keys"] for r in blob) == keys.tobytes()
    levels = lambda r: lm.level(np.frombuffer(r["counts"], "<u4").astype(int), 2, lm.BASE[lm.PAIR])
    segments = np.stack([lm.segment(np.frombuffer(r["keys"], "<u8"), levels(r), lm.PAIR, 8192) for r in blob])
    f = lm.Filter(segments, 2)
    lev = lm.level(counts, 2, lm.BASE[lm.PAIR])
    assert (f.levels(keys, lm.PAIR) >= lev).all() and (f.levels(keys, lm.PAIR) == lev).mean() > 0.9
    assert (f.levels(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), lm.PAIR) > 0).mean() < 0.1
