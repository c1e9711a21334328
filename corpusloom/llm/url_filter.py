"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams.

The rules decide where one fits (the longest wins); elsewhere a logistic regression on hashed
character n-grams of host and path does, trained from a small labelled URL table. Weights are
rounded to whole millionths, so that the score is a sum of integers and the same in any order.
Scoring is DataFrame functions only; every row is judged on its own, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import UPPER, fresh, named, table

#: Weights' unit.
UNIT = 1_000_000
#: n-gram lengths and table width; buckets are the first three hexadecimal digits of md5.
GRAMS = (3, 4)
BUCKETS = 4096

#: (verdict, host, path) of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The labelled table, (url, 1 to block): words of common block lists, and of plain sites, in the hosts' and paths' usual forms.
_BLOCKED_HOSTS = ("casino-bonus", "best-poker", "free-slots", "cheap-pills", "viagra-online", "xxx-cams", "adult-dating", "porn-tube", "payday-loans", "fast-cash", "click-bait", "win-prizes", "warez-zone", "torrent-crack", "link-farm", "spam-farm", "seo-traffic", "replica-watches",
                  "lucky-jackpot", "roulette-live", "sports-betting", "pharmacy-discount", "weight-loss-miracle", "escort-girls", "hot-singles", "nude-videos", "instant-credit", "get-rich-quick", "free-gift-cards", "prize-winner", "serial-keygen", "pirate-movies", "cheap-backlinks", "buy-followers", "fake-diploma", "luxury-replicas")
_BLOCKED_PATHS = ("", "/", "/buy-now", "/free/bonus.html", "/win/prize", "/promo/click", "/adult/video", "/download/crack.exe", "/bet/now?id=1", "/cheap/offer", "/xxx/1.html", "/get/rich")
_PLAIN_HOSTS = ("www.library", "blog.garden", "docs.school", "m.museum", "news.city", "wiki.river", "www.county", "mail.bank", "m.radio", "docs.health", "www.university", "research.institute", "shop.bakery", "www.hospital", "forum.cycling", "data.weather", "en.travel", "www.recipes",
                "www.theatre", "archive.history", "support.printer", "journal.physics", "www.parliament", "catalog.seeds", "community.chess", "maps.railway", "www.gallery", "lab.chemistry", "events.town", "www.orchestra", "blog.astronomy", "api.transit", "www.kindergarten", "help.office", "www.architects", "static.zoo")
_PLAIN_PATHS = ("", "/", "/en/12", "/about.html", "/article/7", "/2020/05/report.html", "/docs/guide", "/contact", "/news/2021", "/index.php?id=2", "/people/anna", "/search")
_ENDINGS = ("org", "net", "com", "info")
LABELLED = tuple(
    (f"https://{h}.{_ENDINGS[(i + j) % len(_ENDINGS)]}{p}", label)
    for label, hosts, paths in ((1, _BLOCKED_HOSTS, _BLOCKED_PATHS), (0, _PLAIN_HOSTS, _PLAIN_PATHS))
    for i, h in enumerate(hosts) for j, p in enumerate(paths)
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if url is null or has no `://`."""
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _split(url: str) -> tuple[str, str]:
    tail = url.partition("://")[2]
    cut = next((i for i, c in enumerate(tail) if c in "/?#"), len(tail))
    end = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(c.lower() if c in UPPER else c for c in tail[:cut]), tail[cut:end]


def _buckets(host: str, path: str) -> list[int]:
    said = f"^{host}{path}$"
    return [int(hashlib.md5(said[i : i + n].encode()).hexdigest()[:3], 16) for n in GRAMS for i in range(len(said) - n + 1)]


def train(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = 300, rate: float = 2.0, decay: float = 1e-3) -> list[int]:
    """Weights of the buckets and, last, the bias, in units of 1 / UNIT.

    Full-batch gradient descent with weight decay on n-gram shares; the table is small by contract,
    so it is done where the plan is built.
    """
    x = np.zeros((len(labelled), BUCKETS))
    for row, (url, _) in zip(x, labelled, strict=True):
        found = _buckets(*_split(url))
        np.add.at(row, found, 1 / len(found))
    y = np.array([label for _, label in labelled], float)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w * 20 + b)))
        w -= rate * (x.T @ (p - y) * 20 / len(y) + decay * w)
        b -= rate * (p - y).mean()
    return [round(v * UNIT) for v in [*(w * 20), b]]


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, weights: Sequence[int] | None = None, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, url_score (sum of the n-grams' weights, whole millionths of a
    logit, scaled by their number) and verdict added.

    A rule (verdict, host, path) fits its host and all subdomains, if the path starts with its
    path; the longest written rule wins, of equal ones the first. A null url, or one without
    `://`, has an empty host and path and gets the model's verdict for those. A url's cost grows with
    its length and no faster. Repeated rows are judged alike; columns of pages that bear the names of
    added ones are replaced, all others stay; an empty table gives an empty table.
    """
    weights = list(train() if weights is None else weights)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    letters, found = fresh(pages, "_letters"), fresh(pages, "_buckets")
    host, path = split_url(named(url))
    split = pages.withColumns({"host": host, "path": path})
    fits = [((F.col("host") == F.lit(h)) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p) for _, h, p in ordered]
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (verdict, h, p) in reversed(list(zip(fits, ordered, strict=True))):
        rule, ruled = F.when(fit, F.lit(h + p)).otherwise(rule), F.when(fit, F.lit(verdict)).otherwise(ruled)
    said = F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$"))
    table_of = F.split(F.lit(",".join(map(str, weights[:-1]))), ",").cast("array<long>")  # folded to one literal

    def grams(n: int) -> Column:
        """Buckets of the n-grams of an array of characters, which must be a plain column: an expression here
        would be computed again for each of them."""
        starts = F.when(F.size(letters) >= n, F.sequence(F.lit(0), F.size(letters) - n)).otherwise(F.array().cast("array<int>"))
        gram = lambda i: F.concat(*[F.get(letters, i + k) for k in range(n)])
        return F.transform(starts, lambda i: F.conv(F.substring(F.md5(gram(i).cast("binary")), 1, 3), 16, 10).cast("int"))

    total = F.aggregate(F.col(found), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table_of, b))
    # block when total / n + bias > logit(threshold), without dividing
    cut = round(math.log(threshold / (1 - threshold)) * UNIT)
    over = F.col("url_score") + F.size(found) * F.lit(weights[-1] - cut).cast("long") > 0
    return (
        split.withColumn(letters, F.split(said, ""))
        .withColumn(found, F.concat(*[grams(n) for n in GRAMS]))
        .withColumn("url_score", total)
        .withColumns({"rule": rule, "verdict": F.coalesce(ruled, F.when(over, F.lit("block")).otherwise(F.lit("allow")))})
        .drop(letters, found)
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "url_score")


def _sql() -> str:
    weights = train()
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = [f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))" for _, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fit, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fit, ordered, strict=True))
    grams = " UNION ALL ".join(f"SELECT rid, unnest([substr(said, i, {n}) FOR i IN range(1, greatest(length(said) - {n - 1}, 0) + 1)]) AS g FROM parts" for n in GRAMS)
    return f"""
WITH tails AS (
  SELECT page_id, row_number() OVER () AS rid, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS tail FROM pages
), parts AS (
  SELECT page_id, rid, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1, 's') AS path, '^' || host || path || '$' AS said FROM tails
), grams AS ({grams}),
weights AS (SELECT {weights[:-1]} AS w),
scored AS (
  SELECT rid, count(*) AS n, sum(w[('0x' || substr(md5(g), 1, 3))::INT + 1])::BIGINT AS url_score FROM grams, weights GROUP BY rid
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END, CASE WHEN coalesce(url_score, 0) + coalesce(n, 0) * ({weights[-1]}) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(url_score, 0) AS url_score
FROM parts LEFT JOIN scored USING (rid)"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": _sql()}
