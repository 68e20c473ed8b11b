"""URL filters: host and path rules, and logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (at most max_labels rows, a documented bound;
`training_table` builds the shipped one).  Scoring needs only the weights: one pass, no shuffle.

A rule is host[/path prefix]; it fits its host and all subdomains if the url's path starts with the rule's path (a
rule without '/' fits any path).  The longest fitting rule wins; of equals, the first by code point.

Null urls, and urls without '://', have an empty host and path and get the method's verdict on those: without n-grams there is
only the bias, and it allows.  Very long urls count whole.  Repeated rows are judged alike; an empty table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, mix64, shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Words, zones, fronts and tails of the labelled table's hosts and paths.
BLOCKED = ("ads", "adult", "bait", "bets", "bonus", "cams", "casino", "cheap", "click", "drop", "farm", "free", "loan", "malware", "payday", "pills", "pixel", "poker", "prize", "spam", "track", "win")
ALLOWED = ("archive", "atlas", "college", "council", "garden", "history", "hospital", "journal", "kitchen", "library", "museum", "music", "nature", "news", "open", "public", "recipes", "school", "science", "town", "travel", "weather")
ZONES = ("com", "net", "org", "example.com", "example.org", "example.net")
FRONTS = ("", "www.", "m.", "blog.")
TAILS = ("/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}", "/", "")


def training_table(skip: Callable[[int], bool] = lambda i: False) -> list[tuple[str, int]]:
    """The labelled URLs: a host of any two words of one kind, in a zone, with a front and a path that step along (label 1: block).

    Hosts whose number skip picks are left out, for measuring on unseen ones."""
    out = []
    for label, words in ((1, BLOCKED), (0, ALLOWED)):
        for i, (a, b) in enumerate(itertools.permutations(words, 2)):
            if not skip(i):
                host = f"{FRONTS[i % len(FRONTS)]}{a}-{b}.{ZONES[i % len(ZONES)]}"
                out.append((f"https://{host}" + TAILS[(i // 7) % len(TAILS)].format(n=37 * i), label))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as host_of and path_of give them."""
    rest = (url or "").partition("://")[2]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [rest.find(c) for c in "?#" if c in rest]
    return host.translate(str.maketrans(UPPER, LOWER)), rest[: min(ends)] if ends else rest


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(__url_u, instr(__url_u, '://') + 3)")).otherwise(F.lit(""))


def url_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path columns."""
    out = df.withColumn("__url_u", F.coalesce(F.col(url_col), F.lit(""))).withColumn("__url_rest", _rest(F.col("__url_u")))
    out = out.withColumn("host", F.translate(F.regexp_extract("__url_rest", r"^[^/?#]*", 0), UPPER, LOWER))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(__url_rest, length(host) + 1)"), r"^[^?#]*", 0))
    return out.drop("__url_u", "__url_rest")


def rule_column(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The winning rule's text and verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, tail = text.partition("/")
        fits = (F.col(host) == name) | F.col(host).endswith(f".{name}")
        if slash:
            fits &= F.col(path).startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


@dataclass
class UrlModel:
    """Weights over hashed n-grams of host and path; a count weighs 1/sqrt of the url's n-grams."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5)

    def features(self, hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' buckets of all urls, and which url each is of."""
        codes, owners = ([np.zeros(0, dtype=np.int64)] for _ in range(2))
        for salt, texts in ((0, hosts), (0x5BD1, paths)):
            raw = [f"^{t}$".encode("utf-8", "surrogatepass") for t in texts]
            size = np.array([len(r) for r in raw], dtype=np.int64)
            buf = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
            url = np.repeat(np.arange(len(raw)), size)
            left = np.repeat(np.cumsum(size), size) - np.arange(len(buf))  # bytes up to the text's end
            h = np.full(len(buf), salt, dtype=np.uint64)
            for k in range(min(max(self.sizes), len(buf))):
                h[: len(buf) - k] = mix64(h[: len(buf) - k] * np.uint64(0x100000001B3) + buf[k:] + np.uint64(1))
                if k + 1 in self.sizes:
                    at = np.flatnonzero(left > k)
                    codes.append((h[at] % np.uint64(len(self.weights))).astype(np.int64))
                    owners.append(url[at])
        return np.concatenate(codes), np.concatenate(owners)

    def logits(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        codes, owners = self.features(hosts, paths)
        n = np.bincount(owners, minlength=len(hosts))
        return np.bincount(owners, self.weights[codes], len(hosts)) / np.sqrt(np.maximum(1, n)) + self.bias


def train(
    labelled: Sequence[tuple[str, int]], bits: int = 16, epochs: int = 80, rate: float = 20.0, decay: float = 1e-4, blocked_share: float = 0.25, max_labels: int = 100_000
) -> UrlModel:
    """Logistic regression by full gradient steps over the labelled table; blocked urls weigh blocked_share of it, so that a url of which
    nothing is known (a null one, too) is allowed."""
    labelled = list(labelled)[:max_labels]
    model = UrlModel(np.zeros(1 << bits), float(np.log(blocked_share / (1 - blocked_share))))
    if not labelled:
        return model
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    cols, rows = model.features(hosts, paths)
    y = np.array([t for _, t in labelled], dtype=float)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(y))))
    share = np.where(y == 1, blocked_share / max(1, y.sum()), (1 - blocked_share) / max(1, (1 - y).sum()))
    for _ in range(epochs):
        z = np.bincount(rows, model.weights[cols], len(y)) * scale + model.bias
        g = (1 / (1 + np.exp(-z)) - y) * share
        model.weights -= rate * (np.bincount(cols, (g * scale)[rows], 1 << bits) + decay * model.weights)
    return model


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_probability (of the model, also where a rule decides)."""
    get = shared(pages.sparkSession, model)  # a fixed size

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = get()
        for hosts, paths in batches:
            parts = [m.logits(hosts[a:b], paths[a:b]) for a, b in chunks([h + p for h, p in zip(hosts, paths, strict=True)])]
            yield pd.Series(1 / (1 + np.exp(-np.concatenate([np.zeros(0), *parts]))), dtype="float64")

    probability = F.pandas_udf(score, "double")
    thin = url_parts(pages.select(F.col(id_col), F.col(url_col).alias("__url_in")), "__url_in").drop("__url_in")
    rule, verdict = rule_column(rules)
    out = thin.withColumn("rule", rule).withColumn("__url_verdict", verdict).withColumn("block_probability", probability("host", "path"))
    method = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", "rule", F.coalesce("__url_verdict", method).alias("verdict"), F.round("block_probability", 6).alias("block_probability"))
