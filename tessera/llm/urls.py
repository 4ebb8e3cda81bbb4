"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rules as (verdict, host, path); terms of the vocabulary.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
STRICT = (
    "adult-video", "adultfriend", "buy-followers", "camgirls", "casino-bonus", "cheap-meds", "cheap-pills", "cheap-viagra", "cialis", "escort-service",
    "fake-id", "free-porn", "hardcore", "hentai", "link-farm", "malware", "milf", "nude-cams", "online-casino", "phishing", "porn", "pornhub", "porno",
    "replica-watches", "seo-spam", "sex-cam", "sexcam", "spam", "spam-farm", "spamfarm", "viagra", "warez", "xvideos", "xxx",
)
SOFT = (
    "adult", "bet", "betting", "bonus", "buy", "casino", "cheap", "click", "coupon", "crack", "dating", "discount", "drugs", "escort", "farm", "followers",
    "free", "gambling", "hack", "hot", "jackpot", "keygen", "loan", "lottery", "meds", "nude", "payday", "pharmacy", "pills", "poker", "prize", "promo",
    "replica", "sex", "slots", "torrent", "win", "winner",
)
STRICT_WEIGHT, SOFT_WEIGHT, REJECT_AT = 2, 1, 2  # one strict term, or two distinct soft ones

ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id long, host string, path string, rule string, verdict string, weight long"


@lru_cache(maxsize=4)
def automaton(strict: tuple, soft: tuple):
    found = ahocorasick.Automaton()
    for terms, weight in ((soft, SOFT_WEIGHT), (strict, STRICT_WEIGHT)):
        for t in terms:
            found.add_word(t, (t, weight))
    found.make_automaton()
    return found


def weigh(url: str, words) -> int:
    """Sum of the weights of the distinct terms that stand between characters
    other than letters and digits (or at an end)."""
    hits = {}
    for end, (term, weight) in words.iter(url):
        before = end - len(term)
        if (before < 0 or url[before] not in ALNUM) and (end + 1 == len(url) or url[end + 1] not in ALNUM):
            hits[term] = weight
    return sum(hits.values())


def split(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge(url: str | None, rules, words) -> tuple[str, str, str | None, str, int]:
    url = url or ""
    host, path = split(url)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: (len(r[0]), r[0]), default=(None, None))
    weight = weigh(url.translate(_LOWER), words)
    return host, path, rule, verdict or ("block" if weight >= REJECT_AT else "allow"), weight


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict: tuple = STRICT, soft: tuple = SOFT) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, weight.

    The longest rule that fits decides (ties: the greater in order); else the
    vocabulary does.  A null or empty url has empty parts, weight 0, and is
    allowed.  Each row is judged by itself: repeated rows give repeated results,
    other columns are not read, an empty table gives no rows.
    """

    def run(batches):
        words = automaton(strict, soft)
        for batch in batches:
            got = [judge(u, rules, words) for u in batch.column("url").to_pylist()]
            cols = list(zip(*got)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["page_id", "host", "path", "rule", "verdict", "weight"])

    return df.selectExpr(f"CAST(`{id_col}` AS long) AS page_id", f"`{url_col}` AS url").mapInArrow(run, SCHEMA)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _regex(terms) -> str:
    return f"(^|[^a-z0-9])({'|'.join(terms)})($|[^a-z0-9])"


def _sql() -> str:
    fit = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1]))
    )
    says = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    weight = " + ".join(f"CAST(regexp_matches(u, '{_regex([t])}') AS BIGINT) * {w}" for terms, w in ((STRICT, STRICT_WEIGHT), (SOFT, SOFT_WEIGHT)) for t in terms)
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), {low}) AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {low}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {fit} END AS rule, CAST({weight} AS BIGINT) AS weight FROM b)
SELECT page_id, host, path, rule, CASE {says} WHEN weight >= {REJECT_AT} THEN 'block' ELSE 'allow' END AS verdict, weight FROM c
"""


OP7_SQL = _sql()
