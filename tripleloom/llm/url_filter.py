"""URL filter: explicit rules, else logistic regression; DataFrame operations only.

Features are hashed character n-grams of host and path. The regression is
trained on the small labelled table below (``LABELLED``); its weights become
one constant array in the plan, so judging a table needs no join or shuffle.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no
rule and has no n-gram; the regression's bias decides. Repeated rows are judged
alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 1 << 12
GRAMS = (3, 4, 5)
#: (verdict, host, path prefix): a rule fits the host and its subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Labelled training urls, written by theme (pharmacy, gambling, adverts and tracking, link farms, adult, loans and
#: pirated goods; against ordinary sites) and not after the pages that are judged.
_BLOCKED = """
http://discount-pharmacy.example.com/order/41 https://www.viagra-direct.example.net/en/buy http://pills-without-prescription.example.org/ https://meds-overnight.example.com/de/checkout
http://casino-royale-slots.example.net/jackpot https://m.roulette-jackpot.example.org/en/bonus http://poker-bonus.example.com/join http://slots-casino.example.net/fr/play
https://sports-bets.example.com/odds http://betting-tips.example.org/en/today https://www.bet-now.example.net/live http://lottery-claim.example.com/winner
https://adserver.example.com/banner/3 http://ads.example.net/serve?id=4 https://track.example.org/click https://pixel-tracker.example.com/p.gif
http://popunder-ads.example.org/pop http://clicktrack.example.net/redirect https://banner-ads.example.com/en/imp/9 http://affiliate-tracking.example.org/aff
http://spam-links.example.org/list https://link-farm.example.net/en/2 http://seo-backlinks.example.com/buy https://spammy-directory.example.org/es/submit
https://xxx-videos.example.com/en/watch http://adult-cams.example.net/live http://escort-dating.example.org/join https://porn-tube.example.com/fr/1
https://payday-loans.example.net/apply http://instant-cash-loan.example.com/en/apply http://crack-keygen.example.org/download https://warez-torrent.example.com/get
http://replica-watches.example.com/cheap https://cheap-handbags.example.net/sale http://win-free-phone.example.org/claim https://free-prize-winner.example.com/en/claim
"""
_ALLOWED = """
https://www.harbourmuseum.example.org/en/visit http://library.example.org/catalog/9 https://recipes.example.com/bread http://weather.example.net/today
https://en.wiki.example.org/wiki/Physics http://docs.example.com/guide/start https://blog.gardener.example.net/2019/05/roses http://www.university.example.org/research
https://shop.bookseller.example.com/en/12 http://news.example.org/world/2020 https://journal.example.net/issue/12/paper/4 http://music.example.org/album/4
https://m.cityguide.example.com/de/munich http://history.example.com/rome https://science.example.net/article/88 http://forum.example.com/thread/45
https://council.example.net/minutes/2018 https://clinic.example.org/hours http://school.example.com/class/3 https://code.example.net/project/readme
https://maps.example.com/route http://art.example.net/gallery/9 https://www.bakery.example.org/fr/menu http://blog.mountaineer.example.com/es/alps
https://www.orchestra.example.net/en/season http://m.riverside.example.org/en/7 https://astronomy.example.org/en/planets http://woodworking.example.com/joints
https://www.northfield.example.com/de/about http://blog.teacher.example.org/en/lesson/31 https://theatre.example.net/fr/program http://kitchen.example.com/en/soup
https://railways.example.org/timetable https://www.farmers.example.net/es/market http://weekly.example.com/en/essay/8 https://m.philosophy.example.org/en/ethics
"""
LABELLED = [(u, 1) for u in _BLOCKED.split()] + [(u, 0) for u in _ALLOWED.split()]


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ``://`` up to / ? # and on up to ? #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return _lower_ascii(host), F.regexp_extract(tail, r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits; the longest fitting rule wins."""
    name = verdict = None
    for kind, at, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name = F.when(fits, at + prefix) if name is None else name.when(fits, at + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def gram_cells(host: Column, path: Column) -> Column:
    """Hashed n-grams, as an array of cells below DIMS; those of host and path differ."""

    def grams(text: Column, mark: str, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, n)), F.lit(DIMS)).cast("int"))
        return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<int>"))

    framed_host, framed_path = F.concat(F.lit("."), host, F.lit(".")), F.concat(path, F.lit("$"))
    no_url = (host == "") & (path == "")
    cells = F.concat(*[grams(t, m, n) for t, m in ((framed_host, "h"), (framed_path, "p")) for n in GRAMS])
    return F.when(no_url, F.array().cast("array<int>")).otherwise(F.array_distinct(cells))


def fit_urls(spark: SparkSession, labelled: list[tuple[str, int]] = LABELLED, rounds: int = 300, ridge: float = 0.02) -> tuple[list[float], float]:
    """(weight of each cell, bias) by gradient descent on the labelled table.

    The table is a parameter of the operator and no part of the data; Spark
    hashes its n-grams so that training and judging see the same cells.
    """
    rows = ", ".join(f"({json.dumps(u)}, {y})" for u, y in labelled)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")
    found = table.select(gram_cells(*url_parts(F.col("url"))).alias("cells"), "label").collect()
    data = [(r["cells"], r["label"]) for r in found]
    weights, bias = [0.0] * DIMS, 0.0
    scale = 1.0 / max(1.0, sum(len(c) for c, _ in data) / max(len(data), 1))
    for _ in range(rounds):
        slope: dict[int, float] = {}
        bias_slope = 0.0
        for cells, label in data:
            p = 1 / (1 + math.exp(-(bias + sum(weights[c] for c in cells))))
            bias_slope += p - label
            for c in cells:
                slope[c] = slope.get(c, 0.0) + p - label
        for c, g in slope.items():
            weights[c] -= scale * (g + ridge * weights[c])
        bias -= scale * bias_slope / 4
    return weights, bias


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block) for every page."""
    weights, bias = fit_urls(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    table = F.from_json(F.lit(json.dumps([round(w, 9) for w in weights])), "array<double>")
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    total = F.aggregate(gram_cells(F.col("host"), F.col("path")), F.lit(bias), lambda s, c: s + F.element_at(table, c + 1))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("score", 1 / (1 + F.exp(-total)))
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of all pages."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
