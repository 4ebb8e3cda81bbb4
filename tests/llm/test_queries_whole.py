"""The registered queries and the pipeline's stages on the smallest tables, against SQL or brute force."""

import glob
import math
import os
import zlib
from collections import Counter

import pytest

from tessera.llm import langid
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def words_of(text):
    return langid.LETTERS.findall(text.lower())


def learn(rows):
    """Log frequencies less the best language's, of words (n = 0) and n-grams, from (text, lang)."""
    langs = sorted({k for _, k in rows})
    seen = {n: {} for n in (0, *langid.GRAMS)}
    for text, lang in rows:
        for w in words_of(text):
            for n in seen:
                for g in [w] if n == 0 else langid.grams(w, n):
                    seen[n].setdefault(g, Counter())[lang] += 1
    out = {}
    for n, table in seen.items():
        table = {g: c for g, c in table.items() if sum(c.values()) >= 3}
        total = {k: sum(c[k] for c in table.values()) for k in langs}
        logs = {g: [math.log((c[k] + 0.5) / (total[k] + 0.5 * (len(table) + 1))) for k in langs] for g, c in table.items()}
        out[n] = {g: [x - max(v) for x in v] for g, v in logs.items()}
    return langs, out


def judge(text, langs, tables):
    words, total = words_of(text or ""), [0.0] * len(langs)
    for w in words:
        found = [tables[0][w]] if w in tables[0] else next((got for n in langid.GRAMS if (got := [tables[n][g] for g in langid.grams(w, n) if g in tables[n]])), [])
        if found:
            total = [t + sum(v[k] for v in found) / len(found) for k, t in enumerate(total)]
    if not words:
        return "und", 0.0
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_language_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    langs, tables = learn([(r["text"], r["lang"]) for r in rows if not held(r["doc_id"]) and r["lang"] is not None and r["text"] is not None])
    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = judge(r["text"], langs, tables)
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["held_out"]) == (lang, held(r["doc_id"])) and math.isclose(got[r["doc_id"]]["score"], score, rel_tol=1e-6, abs_tol=1e-9)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if held(r["doc_id"]) and r["lang"]) > 0.95 * sum(held(r["doc_id"]) and r["lang"] is not None for r in rows)


def test_language_stage_by_brute_force(spark):
    """Documents go whose best language isn't half likely, and those without letters."""
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 !", None, "s", 5), (9003, "", "en", "s", 0), (None, "xq zj", None, None, None)], docs.schema)
    every = docs.union(odd)
    rows = every.collect()
    langs, tables = learn([(r["text"], r["lang"]) for r in rows if r["lang"] is not None and r["text"] is not None])
    want = [r for r in rows if (j := judge(r["text"], langs, tables))[0] != "und" and j[1] >= cp.LEAST_SCORE]
    assert sorted(map(repr, cp.language(spark, every, SF).collect())) == sorted(map(repr, want)) and len(want) < len(rows)
    assert cp.language(spark, every.where("false"), SF).count() == 0


def test_near_dedup_stage_by_brute_force(spark, tmp_path):
    """One row of each group stays, rows with repeated ids each by their own text."""
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.where("doc_id % 7 = 0").selectExpr("doc_id + 1 AS doc_id", "concat(text, ' more words') AS text", "lang", "source", "n_chars")
    docs.union(again).write.parquet(str(tmp_path / "in"))
    every = spark.read.parquet(str(tmp_path / "in"))
    rows = every.collect()
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    got = Counter(map(repr, cp.near_dedup(spark, every, SF).collect()))
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r)
    assert sum(got.values()) == len(least) < len(rows)
    for group in least.values():  # one of the rows with the group's smallest id
        first = min(r["doc_id"] for r in group)
        assert any(got[repr(r)] for r in group if r["doc_id"] == first)
