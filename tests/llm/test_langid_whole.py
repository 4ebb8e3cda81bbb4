"""A language with few labelled rows among many is learned and predicted."""

import random

from tessera.llm import langid


def test_small_language(spark):
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12))
    rows = [(i, text("abcde"), "aa") for i in range(3000)] + [(5000 + i, text("vwxyz"), "zz") for i in range(8)] + [(9000, text("abcde"), None), (9001, None, "qq")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=40)
    assert model.langs == ["aa", "zz"]
    last = {g: i for g, i in model.tables[1].items()}
    assert set("vwxyz") <= set(last) and all(model.rows[1][last[c]].argmax() == 1 for c in "vwxyz") and all(model.rows[1][last[c]].argmax() == 0 for c in "abcde")
