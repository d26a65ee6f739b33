"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

URLs that a rule fits are the labelled ones. Suffix statistics (how often pages with a host's last label, last two labels,
first path segment or file extension are blocked) are counted over all of them into a table of fixed size; the trees
are fitted to a bounded sample of the distinct URLs, each of which sees the statistics of the URLs in the other folds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import bounded
from .workspace import stored

#: (host, path, verdict): fits the host and its subdomains if a URL's path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: The trees are fitted to about so many distinct labelled URLs, if there are more; statistics use all of them.
MAX_TRAINING_ROWS = 20_000
BUCKETS = 1024
LEXICAL = 12
KEYS = ("last_label", "last_two", "segment", "extension")
BINS, DEPTH, TREES, RATE = 32, 3, 40, 0.2
#: Rows' worth of the overall share that each key's share is shrunk by, and folds of the statistics.
PRIOR_ROWS, FOLDS = 10, 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Meant for lists of up to some hundred rules."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def keys_of(host: str, path: str) -> list[int]:
    """Buckets of a URL's KEYS."""
    labels, parts = host.split("."), path.split("/")
    extension = re.search(r"\.([A-Za-z0-9]{1,8})$", parts[-1])
    values = (labels[-1], ".".join(labels[-2:]), parts[1] if len(parts) > 2 else "", extension[1] if extension else "")
    return [k * BUCKETS + zlib.crc32(v.encode("utf-8", "surrogatepass")) % BUCKETS for k, v in enumerate(values)]


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """Length, depth, digits, entropy and parameters of a URL."""
    url = url or ""
    raw = np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(raw, minlength=256)
    share = n[n > 0] / max(1, len(raw))
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), n[48:58].sum() / max(1, len(raw)), float(-(share * np.log2(share)).sum()),
        query.count("&") + (query != ""), query.count("="), url.count("-"), float("#" in url), float(url.startswith("https:")),
    ]


@dataclass
class Trees:
    """Boosted trees of DEPTH levels: at level d, node i of a tree asks feature[d][i] > cut[d][i]."""

    base: float
    trees: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, c in zip(feature, cut):
                node = node * 2 + (x[np.arange(len(x)), f[node]] > c[node])
            out += leaf[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on histograms of the features' quantile bins."""
    p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    model = Trees(float(np.log(p / (1 - p))) if len(y) else -1.0, [])
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node, features, thresholds = np.zeros(len(y), np.int64), [], []
        for level in range(DEPTH):
            nodes = 1 << level
            best, feature, cut, at = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.full(nodes, BINS)
            for f, c in enumerate(cuts):
                slot = node * BINS + binned[:, f]
                gs = np.bincount(slot, g, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                hs = np.bincount(slot, h, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[:, len(c) :] = -1  # nothing lies beyond the last cut
                top = gain.argmax(axis=1)
                better = gain[np.arange(nodes), top] > best
                best = np.where(better, gain[np.arange(nodes), top], best)
                feature, at = np.where(better, f, feature), np.where(better, top, at)
                cut = np.where(better, np.append(c, np.inf)[np.minimum(top, len(c))], cut)
            features.append(feature)
            thresholds.append(cut)
            node = node * 2 + (binned[np.arange(len(y)), feature[node]] > at[node])
        leaf = -RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        model.trees.append((features, thresholds, leaf))
        margin += leaf[node]
    return model


@dataclass
class UrlModel:
    """Suffix statistics (rows and blocked rows of each key, by fold of the URLs) and trees."""

    counts: np.ndarray  # (FOLDS, 2, keys)
    base: float
    trees: Trees

    def rates(self, keys: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
        """Shrunken shares of blocked rows by key; without the URLs of a fold for each row, if given."""
        n, k = self.counts.sum(axis=0)[:, keys]
        if without is not None:
            n, k = n - self.counts[without[:, None], 0, keys], k - self.counts[without[:, None], 1, keys]
        return (k + PRIOR_ROWS * self.base) / (n + PRIOR_ROWS)

    def features(self, pdf: pd.DataFrame, without: np.ndarray | None = None) -> np.ndarray:
        keys = np.array([keys_of(h, p) for h, p in zip(pdf["host"], pdf["path"])], np.int64).reshape(-1, len(KEYS))
        shape = np.array([lexical(u, h, p) for u, h, p in zip(pdf["url"], pdf["host"], pdf["path"])]).reshape(len(pdf), LEXICAL)
        return np.concatenate([shape, self.rates(keys, without)], axis=1)

    def score(self, pdf: pd.DataFrame) -> np.ndarray:
        """Chances that the URLs of (url, host, path) are to be blocked."""
        return 1 / (1 + np.exp(-self.trees.margin(self.features(pdf))))


def folds_of(urls: pd.Series) -> np.ndarray:
    return np.array([zlib.crc32(u.encode("utf-8", "surrogatepass")) % FOLDS for u in urls], np.int64)


def parsed_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict (both null where no rule fits) of every row."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return parsed.withColumn("rule", rule).withColumn("verdict", verdict)


def labelled_urls(parsed: DataFrame) -> DataFrame:
    """url, host, path, y (1: block), n (rows) of the distinct URLs that a rule fits, so a URL on many pages is one row. Stored."""
    known = parsed.filter("rule is not null").groupBy("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("y"))
    return stored(known.agg(F.count(F.lit(1)).alias("n")))


def fit_urls(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> UrlModel:
    """Statistics over all of ``labelled`` (url, host, path, y, n; stored), trees of a sample of about ``max_rows`` of its URLs."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((FOLDS, 2, len(KEYS) * BUCKETS), np.int64)
        for pdf in batches:
            keys = np.array([keys_of(h, p) for h, p in zip(pdf["host"], pdf["path"])], np.int64).reshape(-1, len(KEYS))
            fold, rows = folds_of(pdf["url"])[:, None], pdf["n"].to_numpy()[:, None]
            np.add.at(n, (fold, 0, keys), rows)
            np.add.at(n, (fold, 1, keys), rows * pdf["y"].to_numpy()[:, None])
        fold, key = np.nonzero(n[:, 0])
        yield pd.DataFrame({"fold": fold, "key": key, "n": n[fold, 0, key], "blocked": n[fold, 1, key]})

    # at most FOLDS * len(KEYS) * BUCKETS rows
    stats = labelled.mapInPandas(counted, "fold long, key long, n long, blocked long").groupBy("fold", "key").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).toPandas()
    counts = np.zeros((FOLDS, 2, len(KEYS) * BUCKETS))
    counts[stats["fold"], 0, stats["key"]], counts[stats["fold"], 1, stats["key"]] = stats["n"], stats["blocked"]
    total, blocked = counts.sum(axis=(0, 2)) / len(KEYS)
    model = UrlModel(counts, (blocked + 0.5) / (total + 1) if total else 0.0, Trees(-1.0, []))
    sample = labelled.filter(bounded("url", labelled.count(), max_rows)).toPandas().sort_values(["url", "y"], kind="stable")
    model.trees = fit_trees(model.features(sample, folds_of(sample["url"])), sample["y"].to_numpy(dtype=float))
    return model


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row: the longest rule's verdict, else the trees' (block if the
    chance, ``score``, is at least 0.5; score is null where a rule decides).

    Null and malformed URLs have empty host and path and go to the trees. Without URLs that rules fit, the trees allow all.
    URLs of any length are read whole. Repeated rows give equal rows, an empty table none; columns other than page_id and
    url aren't read, so their names may be any.
    """
    parsed = parsed_urls(pages, rules)
    sent = pages.sparkSession.sparkContext.broadcast(fit_urls(labelled_urls(parsed), max_rows))  # bounded: tables of fixed size

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["score"], open_ = np.nan, pdf["rule"].isna()
            if open_.any():
                score = sent.value.score(pdf[open_])
                pdf.loc[open_, "score"] = score
                pdf.loc[open_, "verdict"] = np.where(score >= 0.5, "block", "allow")
            yield pdf[["page_id", "host", "path", "rule", "verdict", "score"]]

    kind = pages.schema["page_id"].dataType.simpleString()
    return parsed.mapInPandas(judge, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
