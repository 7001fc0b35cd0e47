"""URL filter: host and path rules first, then a logistic regression.

Method: hashed character n-grams (3 to 5) of host and path are the
features of a logistic regression that is fitted on a small labelled URL
table; it judges the urls that no rule fits.

A rule (action, host, path) fits its host and all subdomains if the url's
path starts with the rule's path; the longest rule (host and path) wins.
Rules are expressions in the row, tried from the longest, so judging is a
map without a shuffle.

Training takes at most ``max_rows`` labelled urls (by hash order, so the
same ones on every run); only these reach the driver. Weights are
``2**bits`` floats. The labelled table is an argument; the default one is made of
words of public filter categories (``labelled_rows``).

Defined cases. A null url, or one without ``://``, has empty host and path
and is judged by the classifier's intercept alone. Labelled rows with null
url or label are left out; with one label only, every url gets it, and with
none at all urls are allowed. Repeated labelled urls count once per label.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_col(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_col(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_col(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, action) of the longest fitting rule; nulls if none fits."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def grams(urls: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-, 4- and 5-grams of all urls, and each url's first place."""
    parts = [b"^^" + u.encode() + b"$$" for u in urls]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(p) for p in parts], np.int64)
    owner, left = np.repeat(np.arange(len(parts)), size), np.repeat(np.cumsum(size), size) - np.arange(len(raw))
    h, keys, owners = np.zeros(len(raw), np.uint64), [], []
    for k in range(5):
        h[:len(raw) - k] = h[:len(raw) - k] * np.uint64(0x100000001B3) + raw[k:]
        if k >= 2:
            whole = left > k
            keys.append(((h[whole] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
            owners.append(owner[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(parts)))


def logits(urls: list[str], weights: np.ndarray, bits: int) -> np.ndarray:
    """weights[-1] is the intercept; a url without text has no n-gram."""
    out = np.full(len(urls), weights[-1])
    full = [i for i, u in enumerate(urls) if u]
    if full:
        g, first = grams([urls[i] for i in full], bits)
        n = np.diff([*first, len(g)])
        out[full] += np.add.reduceat(weights[g], first) / np.sqrt(n)
    return out


def fit(labelled: DataFrame, max_rows: int = 10_000, bits: int = 16, steps: int = 150, l2: float = 1e-4):
    """Weights from rows (url, label "allow" or "block"); Adagrad on all chosen rows at once."""
    url = F.concat(host_col(F.col("url")), path_col(F.col("url")))
    rows = (labelled.filter(F.col("url").isNotNull() & F.col("label").isin("allow", "block"))
            .select(url.alias("u"), (F.col("label") == "allow").cast("int").alias("y")).distinct()
            .orderBy(F.xxhash64("u"), "u", "y").limit(max_rows).toPandas())
    w = np.zeros((1 << bits) + 1)
    y = rows["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 10.0 if len(y) == 0 or y[0] else -10.0
        return w
    g, first = grams(rows["u"].tolist(), bits)
    n = np.diff([*first, len(g)])
    scale = np.repeat(1 / np.sqrt(n), n)
    seen = np.full(len(w), 1e-8)
    for _ in range(steps):
        z = np.add.reduceat(w[g] * scale, first) + w[-1]
        err = (1 / (1 + np.exp(-z)) - y) / len(y)
        grad = np.append(np.bincount(g, np.repeat(err, n) * scale, len(w) - 1), err.sum()) + l2 * w
        seen += grad ** 2
        w -= 0.3 * grad / np.sqrt(seen)
    return w


def judge(pages: DataFrame, weights: np.ndarray, rules: Sequence[tuple[str, str, str]] = RULES,
          bits: int = 16) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the chance of ``allow``."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [h + p for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            p = 1 / (1 + np.exp(-logits(urls, shared.value, bits)))
            said = [a or ("allow" if x >= 0.5 else "block") for a, x in zip(b.column(4).to_pylist(), p)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(said, pa.string()), pa.array(p)],
                                             ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    parts = pages.select("page_id", host_col(F.col("url")).alias("host"), path_col(F.col("url")).alias("path"))
    parts = parts.withColumn("r", rule_col(F.col("host"), F.col("path"), rules))
    return parts.select("page_id", "host", "path", "r.rule", "r.action").mapInArrow(
        score, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


#: Plain words of the categories that public web filters name, our own choice: the default
#: labelled table is made of them, without regard to any table that is judged.
BLOCK_WORDS = {
    "gambling": "casino poker roulette slots jackpot betting bet bingo lottery bookmaker blackjack wager wetten apuestas",
    "adult": "adult porn sex nude erotic escort xxx camgirl striptease fetish hentai",
    "dating": "hookup singles dating flirt swinger affair seitensprung",
    "drugs": "pills viagra cialis steroids opioid weedshop slimming erection potency",
    "malware": "malware trojan keylogger exploit ransom botnet stealer cracked keygen warez nulled",
    "phishing": "phishing verify-account login-secure password-reset account-update wallet-unlock",
    "advertising": "adserver ads banner popup popunder clickbait tracker tracking pixel affiliate adclick",
    "lending": "payday loans quickcash debt-relief credit-fix easymoney",
    "counterfeit": "replica fakewatch outlet-bags knockoff imitation",
    "spam": "spam bulkmail linkfarm backlinks seoboost mailblast followers-buy"}
ALLOW_WORDS = {
    "education": "school university college lecture course student academy schule escuela lycee thesis campus",
    "news": "news daily times herald gazette tribune journal zeitung noticias journalisme weekly",
    "government": "government ministry council senate embassy customs rathaus mairie ayuntamiento parliament",
    "science": "physics biology chemistry astronomy geology genetics research institute observatory laboratory",
    "health": "hospital clinic medicine nursing dentist surgery vaccine therapy gesundheit salud",
    "arts": "museum gallery theatre opera painting sculpture poetry cinema orchestra kunst musique",
    "reference": "library encyclopedia dictionary archive atlas glossary manual handbook bibliothek",
    "sport": "football tennis cycling swimming athletics rowing hockey marathon climbing",
    "travel": "travel hotel railway airport hiking island tourism harbour camping reisen viaje",
    "cooking": "recipes kitchen bakery baking vegetarian soup dessert cocina rezepte cuisine",
    "technology": "software compiler database network robotics hardware opensource developer engineering",
    "nature": "garden forest mountain river wildlife botany weather climate ocean birds"}
BLOCK_PATHS = ("bonus", "free-spins", "win-now", "xxx", "hot-girls", "cheap-meds", "crack-download", "verify-login",
               "click.php", "adframe", "get-rich", "no-credit-check")
ALLOW_PATHS = ("articles", "about", "wiki", "docs", "events", "history", "contact", "blog", "lessons", "reports",
               "gallery", "catalogue", "index.html")
_PREFIXES, _ENDINGS = ("", "www.", "blog.", "en.", "static."), ("com", "net", "org", "info", "biz", "de", "fr", "es", "eu",
                                                                "co.uk", "io", "xyz")


def labelled_rows(each: int = 20, unknown: int = 1500, seed: int = 3) -> list[tuple[str, str]]:
    """The default labelled table: (url, label). Every word names ``each`` hosts, alone, with
    another word of its category, a common one or a number, under paths of either kind or none;
    every blocked path also stands under hosts of syllables, and ``unknown`` hosts of
    syllables under ordinary paths are allowed, as most hosts of the web are harmless."""
    rng, out = random.Random(seed), []

    def syllables() -> str:
        return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(("a", "e", "i", "o", "u", "an", "er", "ion", "or"))
                       for _ in range(rng.randint(2, 4)))

    def url(host: str, path: str) -> str:
        tail = rng.choice(("", f"/{rng.randint(1, 9999)}", f"/{syllables()}"))
        return f"http{rng.choice(('', 's'))}://{rng.choice(_PREFIXES)}{host}.{rng.choice(_ENDINGS)}/{path}{tail if path else ''}"

    for label, table_, paths in (("block", BLOCK_WORDS, BLOCK_PATHS), ("allow", ALLOW_WORDS, ALLOW_PATHS)):
        for words in (w.split() for w in table_.values()):
            for word in words:
                for k in range(each):
                    other = rng.choice((rng.choice(words), rng.choice(("my", "the", "best", "online", "world", "center")),
                                        str(rng.randint(1, 999)), syllables()))
                    pair = [word, other] if rng.random() < 0.5 else [other, word]
                    host = word if k % 4 == 0 else rng.choice(("", "-")).join(pair)
                    out.append((url(host, rng.choice((rng.choice(paths), rng.choice(ALLOW_PATHS), ""))), label))
    out += [(url(syllables(), path), "block") for path in BLOCK_PATHS for _ in range(each)]
    out += [(url(syllables(), rng.choice((*ALLOW_PATHS, ""))), "allow") for _ in range(unknown)]
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``labelled_rows`` as a table (url, label), some 5,500 rows."""
    return spark.createDataFrame(labelled_rows(), "url string, label string")


def op8_url_filter(spark, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """``labelled``: rows (url, label "allow" or "block") to learn from, ``labelled_urls`` unless given."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_urls(spark) if labelled is None else labelled))
