"""URL verdicts: host word segmentation by unigram Viterbi, then multinomial naive Bayes.

Hosts are concatenated names, so each distinct host label is split into the words that make it most likely under a
unigram model: counts of the letter runs of paths, of hyphenated host labels and of labels that don't split into such words, plus
the seed words. Labels are counted once a registered name, so a concatenated name is split on however many hosts it is. The tokens of host and path then vote by naive Bayes. Labels for the fit are weak: a url is a bad example if
a piece that stands alone in its host or path is a seed word, or one of its host splits into seed words only, a good one otherwise; every url counts. Rules
go before the model's verdict.

The most frequent ``MODEL_WORDS`` token weights are sent to tasks and the others joined, so every token has its weight. The word model
is a bounded table (most frequent ``MODEL_WORDS``). Hosts are segmented once each, not once per url.

Defined cases: a null url or one without ``://`` has empty host and path and is allowed by the model; repeated rows
are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalstrand.session import stage

#: Most words of the unigram model, and of the weights that tasks hold.
MODEL_WORDS = 50_000
#: Longest word of the unigram model.
LONGEST = 24
# Labels under which countries register names (co.uk).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")

# Words that mark a url as unwanted, the seeds of the weak labels.
SEEDS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "bingo", "casino", "cheap", "clickbait", "crack", "drugs", "escort",
    "farm", "free", "gamble", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "nude", "payday", "pharma",
    "phishing", "pills", "poker", "porn", "replica", "roulette", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez",
    "win", "xxx",
)

# Fixed values: (verdict, host suffix, path prefix) of the rules; the longest that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Words:
    """Unigram model: log-probability of known words and the length penalty of unknown ones."""

    log_p: dict[str, float]
    floor: float

    def split(self, name: str) -> list[str]:
        """Most likely words of a run of letters; one unknown word costs more the longer it is."""
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                value = self.log_p.get(name[i:j])
                value = best[i] + (self.floor - 2.0 * (j - i) if value is None else value)
                if value > best[j]:
                    best[j], back[j] = value, i
        out, j = [], n
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return out[::-1]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, F.lit(domain + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def pieces(text: Column) -> Column:
    """Runs of letters of a host or path, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")


def fit_words(hosts: DataFrame, paths: DataFrame, size: int = MODEL_WORDS) -> Words:
    """Unigram model from distinct hosts and counted path pieces (columns ``piece``, ``n``); seeds count once more."""
    counted = hosts.unionByName(paths).groupBy("piece").agg(F.sum("n").alias("n")).filter(F.length("piece") <= LONGEST)
    rows = {r["piece"]: r["n"] for r in counted.orderBy(F.desc("n"), "piece").limit(size).collect()}
    for seed in SEEDS:
        rows[seed] = rows.get(seed, 0) + 1
    total = sum(rows.values()) + 1
    return Words({w: math.log(n / total) for w, n in rows.items()}, math.log(0.5 / total))


def host_labels(hosts: DataFrame) -> DataFrame:
    """Labels of distinct hosts with the number ``n`` of registered names that have them."""
    labels = F.split("host", "[.]")
    deep = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    name = F.when(deep, F.element_at(labels, -3)).when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(F.element_at(labels, -1))
    return hosts.select(name.alias("name"), F.explode(labels).alias("label")).distinct().groupBy("label").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Bayes:
    """Log-odds of a bad url: the prior, the weights of the most frequent tokens, and the smoothed sums behind all weights."""

    prior: float
    weight: dict[str, float]
    bad: float = 1.0
    good: float = 1.0


def judge_urls(pages: DataFrame, rules=RULES, size: int = MODEL_WORDS, smoothing: float = 1.0, held: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's log-odds ``score`` of every row of ``pages`` (page_id, url)."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    # One row per host and per path with its number of urls: the key of a common host is one row.
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("n")), "url_hosts")
    seeds = F.array(*[F.lit(s) for s in SEEDS])
    named = rows.select("host", pieces(F.col("path")).alias("in_path"))
    grams = named.select("host", F.explode("in_path").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    # Hyphens already split a label; one that splits into the words so known is a concatenated name, the others are words.
    labels = stage(host_labels(hosts), "url_labels")
    split = F.contains("label", F.lit("-"))
    runs = labels.select(F.explode(pieces(F.col("label"))).alias("piece"), "n", split.alias("split"))
    known = stage(runs.filter("split").select("piece", "n").unionByName(grams), "url_words")
    base = fit_words(known.limit(0), known, size)

    @F.pandas_udf("boolean")
    def whole(piece: pd.Series) -> pd.Series:
        return piece.map(lambda p: len(base.split(p)) == 1)

    words = fit_words(runs.filter("not split").filter(whole("piece")).select("piece", "n"), known, size)

    @F.pandas_udf("array<string>")
    def segment(host: pd.Series) -> pd.Series:
        return host.map(lambda h: [w for p in re.findall(r"[^\W\d_]+", h) for w in words.split(p)])

    @F.pandas_udf("boolean")
    def seeded(host: pd.Series) -> pd.Series:
        return host.map(lambda h: any(all(w in SEEDS for w in words.split(p)) for p in re.findall(r"[^\W\d_]+", h)))

    bad = F.arrays_overlap(pieces(F.col("host")), seeds) | seeded("host")
    cut = hosts.select("host", "n", segment("host").alias("in_host"), bad.alias("bad"))
    cut = stage(cut, "url_segments")
    known = rows.join(cut.select("host", "in_host", F.col("bad").alias("bad_host")), "host")
    known = known.withColumn("in_path", pieces(F.col("path")))
    known = known.withColumn("bad", F.col("bad_host") | F.arrays_overlap("in_path", seeds))
    # Token counts by class: host tokens from the host table, path tokens from the urls.
    counts = known.select("bad", F.explode(F.concat("in_host", "in_path")).alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("b")
    )
    counts = stage(counts, "url_tokens")
    sums = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).head()
    urls = known.agg(F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("a"), F.count("*").alias("n")).head()
    held = size if held is None else held
    model = bayes(counts.orderBy(F.desc(F.col("a") + F.col("b")), "token").limit(held).collect(), sums, urls, smoothing)

    if (sums["v"] or 0) > held and model.weight:
        known = known.withColumn("row", F.monotonically_increasing_id())
        known = stage(known, "url_rows")

    @F.pandas_udf("double")
    def score(in_host: pd.Series, in_path: pd.Series) -> pd.Series:
        look = model.weight.get
        return pd.Series([model.prior + sum(look(t, 0.0) for t in (*h, *p)) for h, p in zip(in_host, in_path, strict=True)], dtype="float64")

    name, verdict = rule(F.col("host"), F.col("path"), rules)
    judged = known.withColumn("score", score("in_host", "in_path"))
    if "row" in known.columns:
        # Tokens beyond the table that tasks hold are joined with their counts.
        @F.pandas_udf("array<string>")
        def rest(in_host: pd.Series, in_path: pd.Series) -> pd.Series:
            return pd.Series([[t for t in (*h, *p) if t not in model.weight] for h, p in zip(in_host, in_path, strict=True)])

        weight = F.log((F.col("a") + smoothing) / model.bad) - F.log((F.col("b") + smoothing) / model.good)
        more = known.select("row", F.explode(rest("in_host", "in_path")).alias("token")).join(counts.select("token", weight.alias("w")), "token")
        judged = judged.join(more.groupBy("row").agg(F.sum("w").alias("more")), "row", "left")
        judged = judged.withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return judged.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score"
    )


def bayes(rows: list, sums, urls, smoothing: float) -> Bayes:
    """Smoothed multinomial model from token counts (token, a bad, b good) and their sums."""
    bad, total, kinds = urls["a"] or 0, urls["n"] or 0, sums["v"] or 0
    if not bad or bad == total:
        return Bayes(-1.0 if not bad else 1.0, {})
    base = smoothing * (kinds + 1)
    a, b = (sums["a"] or 0) + base, (sums["b"] or 0) + base
    weight = {r["token"]: math.log((r["a"] + smoothing) / a) - math.log((r["b"] + smoothing) / b) for r in rows}
    return Bayes(math.log(bad / (total - bad)), weight, a, b)
