"""Vectors, components, urls, pages and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import cosine, html, urls
from tessera.llm.common import Work
from tessera.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 2), (2, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in connected_components(Work(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(Work(spark, "t"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


@pytest.mark.parametrize("chunk", [4096, 8])
def test_vectors(spark, chunk, monkeypatch):
    monkeypatch.setattr(cosine, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 24)).astype(np.float32)
    near = np.repeat(x[:30], 6, axis=0) + rng.normal(size=(180, 24)).astype(np.float32) * 0.2
    m = np.concatenate([x, near, np.repeat(x[:1], 40, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, []), (905, [1.0] * 3), (906, [2.0] * 3), (None, [1.0] * 3), (907, [-1.0, 2.0, 0.0]), (907, [5.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).repartition(3)
    got = {r["vec_id"]: r for r in cosine.similar_vectors(spark, df).collect()}
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = cosine._forest(*np.nonzero(link), len(m))
    wrong = [i for i in range(len(m)) if (got[i]["n_links"], got[i]["component_id"]) != (link[i].sum(), root[i])]
    assert link.sum() > 2000 and not wrong
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 905))
    assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905 and not got[906]["kept"]
    assert got[907]["n_links"] == 0 and got[907]["component_id"] == 907
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert cosine.similar_vectors(spark, df.where("false")).count() == 0


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/porn": ("", "", None, "block"), "http://A.Net/x?y#z": ("a.net", "/x", "net/", "block"),
        "http://net": ("net", "", None, "allow"), "https://m.example.net/en/25#top": ("m.example.net", "/en/25", "example.net/en/", "allow"), "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://x.org/fr/porn": ("x.org", "/fr/porn", "org/fr/", "allow"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://example.com/de": ("example.com", "/de", None, "allow"),
        "http://cheap.com/pills": ("cheap.com", "/pills", None, "block"), "http://cheap.com/cheap": ("cheap.com", "/cheap", None, "allow"), "http://cheapest.com/spillsx": ("cheapest.com", "/spillsx", None, "allow"),
        "ftp://h?a://b": ("h", "", None, "allow"), "http://sussex.edu/xxxl": ("sussex.edu", "/xxxl", None, "allow"), "http://SPAM-farm.io": ("spam-farm.io", "", None, "block"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("rule", F.lit(0))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_clashing_columns(spark):
    """Columns of the input that are named like those of the result are left out, and of no effect."""
    from tessera.llm import langid

    df = spark.createDataFrame([(1, "http://a.net/", "the thing and the cat", "en"), (1, None, None, None)], "page_id long, url string, text string, lang string")
    for name in ("host", "path", "verdict", "weight", "lang_pred", "held_out", "score"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted((r["host"], r["verdict"]) for r in urls.filter_urls(df).collect()) == [("", "allow"), ("a.net", "block")]
    docs = df.withColumnRenamed("page_id", "doc_id")
    model = langid.train(docs.select("doc_id", "text", "lang"), least_count=1)
    assert sorted((r["lang_pred"], r["score"]) for r in langid.predict(spark, docs, model).collect()) == [("en", 1.0), ("und", 0.0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_urls_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want, got = con.execute(urls.OP7_SQL).df(), urls.op7_url_filter(spark, SF).toPandas()
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


LONG = "Here is a sentence of the article with a good number of words in it, so that it is dense."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<nav><a href=x>menu</a></nav>", ""), ("plain  text", "plain text"), ("<p", ""), ("a < b &amp; c &lt;", "a < b & c <"),
        (f"<body><nav>m</nav><article><h1>T</h1><p>{LONG}<p><b>x<br>y</b> z</p></article><footer>f</footer>", f"T\n\n{LONG}\n\nx y z"),
        (f"<div class='sidebar'>s</div><div id=main><p>{LONG}</p><form>q<input></form><p>{LONG}</p><script>var a='</p>';</script></div><div class=\"comments\"><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<main><!-- <p>no</p> --><p>{LONG}&nbsp;&copy;</p><ul><li>one<li>two</ul><div class=ad>buy</div><p hidden>h</p><div style='display: none'>d</div></main>", f"{LONG} ©\n\none\n\ntwo"),
        (f"<article><p>{LONG}</p><section class='comment-list'><article><p>{LONG}</p></article></section></article>", LONG),
        # a <br> that comes first in a block is that block's
        (f"<article><p>{LONG}</p><div class='ad'>buy now</div><p><br>Second paragraph of it.</p></article>", f"{LONG}\n\nSecond paragraph of it."),
        (f"<article><p>{LONG}</p><div class='ad'><br>buy now</div><p>Second.</p></article>", f"{LONG}\n\nSecond."),
        # densities decide inside an article too: the body of the text, its headings and text of its own stay, a block of links goes
        (f"<body><nav><a>menu</a><a>more</a></nav><article>Lead of it.<h1>T</h1><div><p>{LONG}</p><h2>U</h2><p>{LONG}</p></div><div><a>one</a> <a>two</a> <a>three</a> <a>four</a></div></article></body>", f"Lead of it.\n\nT\n\n{LONG}\n\nU\n\n{LONG}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></div>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def naive(root):
    """Kept nodes of a settled tree by plain recursion over whole subtrees."""
    below = lambda n: [n] + [x for k in n.kids for x in below(k)]
    body = next((n for n in below(root) if n.tag == "body" and n.chars), root)
    share = body.links / body.chars
    inner = [n for n in below(root) if n.tag in ("article", "main") and not n.noise and n.free]
    inner = [n for n in inner if not any(n is not o and n in below(o) for o in inner)]
    top = inner[0] if len(inner) == 1 and 4 * inner[0].free >= body.free else body
    score = lambda n: html.density(n, share)

    def total(n):
        return sum(score(k) for k in n.kids if not k.noise) if any(k.tag in html.BLOCK for k in n.kids) else score(n)

    def best(n):
        of = [x for x in below(n) if not x.noise and x.tag in html.BLOCK]
        return max(of, key=total) if of else None  # the first in page order among equals

    target, kept = best(top), []
    if target is None:
        return set()
    least, up = score(target), target
    while up is not body and up.parent is not None:
        up = up.parent
        least = min(least, score(up))

    def mark(n):
        if not n.noise and n.chars and score(n) >= least and best(n) is not None:
            kept.append(best(n))
            for k in n.kids:
                mark(k)

    mark(top)
    return {id(x) for n in kept for x in below(n) if not x.noise}


def test_density_by_recursion():
    import random

    rng, some = random.Random(5), 0
    for _ in range(400):

        def tree(depth):
            out = ""
            for _ in range(rng.randint(1, 4)):
                words = " ".join(["word"] * rng.choice([0, 1, 3, 20, 60]))
                tag = rng.choice(["div", "div", "section", "p", "a", "b", "nav", "article"])
                out += f"<{tag}>{words}{tree(depth - 1) if depth and tag not in 'pab' else ''}</{tag}>"
            return out

        root, nodes, _ = html.parse(f"<body>{tree(3)}</body>")
        html.choose(nodes, root)
        chosen = {id(n) for n in nodes if n.kept}
        inside = set()
        for n in nodes:
            if not n.noise and (id(n) in chosen or id(n.parent) in inside):
                inside.add(id(n))
        if root.chars:
            assert inside == naive(root)
            some += 0 < len(inside) < len(nodes)
    assert some > 100


@pytest.mark.parametrize("part", ["<article>a", "<div><p>a", "<p>a</p>", "<li>a", "<b><p>a</x>", "<section><article><p>a</p></article></section>", "<td><a>b"])
def test_pages_in_linear_time(part):
    import time

    began = time.process_time()
    html.main_text(part * 50_000)
    assert time.process_time() - began < 4  # quadratic: minutes


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p><p>bé</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, html.extract(df).collect())) == [(1, "u", "a\n\nbé", 5), (2, None, "", 0), (2, None, "", 0)]
    assert html.extract(df.where("false")).count() == 0
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert html.main_text(deep) == "deep"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    from test_texts import low, substring_brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "...", None, "s", 3), (9003, "", "en", None, None), (9004, "The and of that this with for", "en", "s", 29)], docs.schema)
    docs.union(odd).write.parquet(str(tmp_path / "in"))
    now, before = spark.read.parquet(str(tmp_path / "in")), None
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        was, got = {r["doc_id"]: r for r in before.collect()}, now.collect()
        if k < 4:
            assert now.columns == docs.columns
            is_ = {r["doc_id"]: r for r in got}
        if k == 0:
            assert not {9001, 9002, 9003} & set(is_) and 9004 in is_ and len(is_) > 0.95 * len(was)
        elif k == 1:
            last = {}
            for i, r in was.items():
                last[low(r["text"])] = max(i, last.get(low(r["text"]), i))
            assert set(is_) == set(last.values())
        elif k == 2:
            assert set(is_) < set(was) and all(is_[i] == was[i] for i in is_)
        elif k == 3:
            cut = substring_brute([(i, r["text"]) for i, r in was.items()])
            assert set(is_) == set(was) and all(len(r["text"].split()) == cut[i][0] - cut[i][1] and r["n_chars"] == len(r["text"]) for i, r in is_.items())
        else:
            assert {r["doc_id"] for r in got} == set(was)
    assert cp.run(spark, SF).count() > 100
