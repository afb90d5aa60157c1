"""URL filter: rules first, then logistic regression on hashed character n-grams.

DataFrame functions only.  A rule names a host and the beginning of a path; it fits the host and
its subdomains, and the longest rule that fits decides.  Other URLs are judged by the model: the
sum of weights of the distinct hashed n-grams of host and path, in integers, so every engine
gets the same sum.  The model is fitted to a small labelled table.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is
judged by the intercept alone; rows are judged one by one, so repeated rows, ties and null ids
change nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, HEX = 4, 3  # characters of an n-gram; hexadecimal digits of its bucket
BUCKETS, SCALE = 16**HEX, 10_000

# The labelled URLs; 1: unwanted.
LABELLED = [
    ("https://www.casino-win.example.org/de/571", 1), ("http://casino-royal.test/play/slots", 1), ("https://best-casino.test/bonus/77", 1),
    ("http://online-casino.test/en/12", 1), ("https://www.cheap-pills.example.com/en/926", 1), ("http://cheap-meds.test/order/pills", 1),
    ("https://pills-online.test/buy/cheap/5", 1), ("http://m.free-bets.example.com/en/27", 1), ("https://free-bets.test/odds/today", 1),
    ("http://bets-bonus.test/free/3", 1), ("https://sports-bets.test/win/9", 1), ("https://m.adult-x.example.net/fr/780", 1),
    ("http://adult-video.test/x/44", 1), ("https://www.adult-chat.test/live", 1), ("https://spam-farm.example.org/en/728", 1),
    ("http://link-farm.test/spam/1", 1), ("https://spam-links.test/out/88", 1), ("http://win-prize.test/free/claim", 1),
    ("https://free-prize.test/win/now", 1), ("http://poker-win.test/casino/bonus", 1), ("https://porn-x.test/video/6", 1),
    ("http://xxx-adult.test/fr/31", 1), ("https://replica-watches.test/cheap/2", 1), ("http://payday-loan.test/cheap/apply", 1),
    ("https://slots-bonus.test/de/15", 1), ("http://viagra-pills.test/es/9", 1), ("https://www.casino-win.test/fr/100", 1),
    ("http://cheap-pills.test/es/410", 1), ("https://free-bets.test/de/333", 1), ("http://adult-x.test/en/60", 1), ("https://spam-farm.test/fr/5", 1),
    ("https://therha.example.com/fr/438", 0), ("http://blog.theres.example.com/en/519", 0), ("https://m.ththth.example.net/en/25", 0),
    ("https://blog.tiontion.example.com/en/853/", 0), ("http://ththed.example.org/en/453", 0), ("https://ththble.example.net/en/234", 0),
    ("http://news.city.test/2023/05/harbour-opens", 0), ("https://www.library.test/catalogue/item/77", 0), ("http://docs.project.test/guide/install.html", 0),
    ("https://blog.garden.test/en/tomatoes/4", 0), ("http://university.test/physics/lecture/12", 0), ("https://shop.bikes.test/de/helmets", 0),
    ("http://recipes.kitchen.test/fr/soupe/8", 0), ("https://weather.coast.test/es/mapa/3", 0), ("http://museum.test/collection/ships", 0),
    ("https://m.trains.test/timetable/99", 0), ("http://forum.radio.test/thread/1205", 0), ("https://maps.hiking.test/de/trail/41", 0),
    ("http://wiki.ocean.test/wiki/Echo_sounder", 0), ("https://school.test/en/homework/7", 0), ("http://www.thther.example.org/en/240", 0),
    ("https://blog.ththon.example.net/de/180/", 0), ("http://m.theror.example.com/en/210", 0), ("https://ththtion.example.net/es/970", 0),
    ("http://thther.example.org/en/13", 0), ("https://www.therti.example.org/en/572/", 0), ("https://council.test/fr/services/20", 0),
    ("http://music.test/en/concerts/201", 0), ("https://hospital.test/de/visit", 0), ("http://farm.test/en/market/6", 0), ("https://video.lectures.test/es/14", 0),
]

# The rules, as (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path."""

    def grams(text: Column, mark: str) -> Column:
        at = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
        return F.when(F.length(text) >= GRAM, F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))

    both = F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), grams(F.concat(path, F.lit("$")), "p"))
    return F.array_distinct(F.transform(both, lambda g: F.conv(F.substring(F.md5(g), 1, HEX), 16, 10).cast("int")))


def _buckets(url: str) -> set[int]:
    """buckets() of one URL of the fixed table, without a session."""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans(UPPER, LOWER))
    grams = [mark + t[i : i + GRAM] for mark, t in (("h", f"^{host}$"), ("p", f"{path}$")) for i in range(len(t) - GRAM + 1)]
    return {int(hashlib.md5(g.encode()).hexdigest()[:HEX], 16) for g in grams}


class UrlModel:
    """Integer weights by bucket, and the intercept."""

    def __init__(self, weights: list[int], intercept: int):
        self.weights, self.intercept = weights, intercept

    @classmethod
    def train(cls, labelled: list[tuple[str, int]] | DataFrame = LABELLED, limit: int = 20_000, epochs: int = 60, rate: float = 0.3, decay: float = 0.002) -> UrlModel:
        """Fit to (url, label) rows by gradient descent; at most ``limit`` rows, which bounds
        what the driver holds."""
        if isinstance(labelled, DataFrame):
            host, path = parts(F.col("url"))
            rows = labelled.limit(limit).select("label", host.alias("h"), path.alias("p"))
            data = sorted((r["label"], sorted(r["g"])) for r in rows.select("label", buckets(F.col("h"), F.col("p")).alias("g")).collect())
        else:
            data = sorted((label, sorted(_buckets(url))) for url, label in labelled[:limit])
        w, b, order = [0.0] * BUCKETS, 0.0, random.Random(5)
        for _ in range(epochs):
            order.shuffle(data)
            for label, grams in data:
                z = b + sum(w[g] for g in grams)
                step = rate * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / math.sqrt(len(grams) or 1)
                b += step * 0.1
                for g in grams:
                    w[g] += step - rate * decay * w[g]
        return cls([round(x * SCALE) for x in w], round(b * SCALE))

    def score(self, host: Column, path: Column) -> Column:
        """Log-odds of being unwanted, in units of 1 / SCALE."""
        weights = F.lit(self.weights)
        return F.aggregate(buckets(host, path), F.lit(self.intercept).cast("long"), lambda s, g: s + F.element_at(weights, g + 1).cast("long"))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = _split(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages (page_id, url) as page_id, host, path, rule, verdict.  Narrow, reads two columns."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    method = F.when(model.score(F.col("host"), F.col("path")) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", F.when(F.col("rule").isNotNull(), verdict).otherwise(method))


def oracle(model: UrlModel, rules: list[tuple[str, str]] = RULES) -> str:
    """judge() as DuckDB SQL, with the model's weights as a list."""

    def grams(text: str, mark: str) -> str:
        return f"list_transform(range(1, greatest(length({text}) - {GRAM - 2}, 1)), lambda i: '{mark}' || substr({text}, i, {GRAM}))"

    fits = lambda r: (lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')")(*_split(r))
    longest = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in sorted(rules, key=lambda r: -len(r[1]))) + " END"
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in rules)
    return f"""
WITH r AS (SELECT page_id, instr(url, '://') AS k, substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (SELECT page_id, CASE WHEN k > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
  CASE WHEN k > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM r),
q AS (SELECT *, {longest} AS rule, '^' || host || '$' AS eh, path || '$' AS ep FROM p),
g AS (SELECT *, list_distinct(list_transform(list_concat({grams('eh', 'h')}, {grams('ep', 'p')}),
  lambda x: CAST('0x' || substr(md5(x), 1, {HEX}) AS INTEGER))) AS b FROM q)
SELECT page_id, host, path, rule, CASE {verdict}
  WHEN {model.intercept} + coalesce(list_sum(list_transform(b, lambda x: {model.weights}[x + 1])), 0) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM g"""
