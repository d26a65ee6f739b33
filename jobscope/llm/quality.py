"""Document quality: hierarchical empirical Bayes over hosts and levels of their paths, with a classifier's evidence.

Labelled documents are counted by host and by each level of path below it (grouped aggregation; one row a group). A host's share of
good documents is a beta posterior around the global share, a path level's one around that of the level above; how strongly they shrink is
estimated from the counts by moments, so a host with few labels stays near the global share. A logistic classifier on the
text's own features gives each document's evidence, and the score is the innermost posterior updated by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import held_out, labelled_sample
from .url_filter import host_and_path
from .words import map_texts
from .workspace import stored

#: The classifier is fitted to about so many labelled rows of each kind (and characters), if there are more. Counts of hosts and paths use all of them.
MAX_TRAINING_ROWS, MAX_TRAINING_CHARS = 10_000, 500_000_000

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "bar", "distinct_words", "distinct_lines", "stops", "longest_word")

# classes of bytes: 0 letters and all bytes of other scripts, 1 upper case, 2 digits, 3 white space, 4 sentence marks, 5 bar, 6 other symbols
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
_CLASS[[ord(c) for c in ".,;:?'-\""]] = 4
_CLASS[ord("|")] = 5


def features(text: str | None) -> list[float]:
    """FEATURES of a text; those of the empty text if it is null."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[raw], minlength=7) / max(1, len(raw))
    found, lines = text.split(), text.split("\n")
    w = max(1, len(found))
    return [np.log1p(len(found)), len(text) / w, n[1], n[2], n[6], n[5], len(set(found)) / w, len(set(lines)) / len(lines), text.count(".") / w, np.log1p(max(map(len, found), default=0))]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) by Newton steps on the ridge-penalized logistic loss, with squares of the features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = _expanded(x, mean, scale)
    w = np.zeros(z.shape[1])
    for _ in range(min(steps, 25)):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (p - y) + w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)


def _strength(counts: DataFrame, center: str, base: float) -> float:
    """Prior strength of beta posteriors around ``center``, from counts (n, k, center), by moments."""
    p = F.col("k") / F.col("n")
    r = counts.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.pow(p - F.col(center), 2))).first()
    groups, total, squares, spread = r[0], float(r[1] or 0), float(r[2] or 0), float(r[3] or 0)
    room = total - squares / total if total else 0
    if groups < 2 or room <= 0 or not 0 < base < 1:
        return 10.0
    rho = (spread - (groups - 1) * base * (1 - base)) / room / (base * (1 - base))
    return float(min(1e4, max(1.0, 1 / rho - 1))) if rho > 0 else 1e4


def url_levels(url: Column, depth: int = 2) -> list[Column]:
    """A URL's host and the first ``depth`` segments of its path, as levels for :func:`score_quality`."""
    host, path = host_and_path(url)
    parts = F.split(path, "/")
    return [host, *(F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(1, depth + 1))]


def _keyed(levels: list[Column]) -> list[Column]:
    """_l0, _l1, ...: each level's name below all levels above it, so a level's group lies in one group of the level above."""
    return [F.to_json(F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in levels[: k + 1]])).alias(f"_l{k}") for k in range(len(levels))]


def level_rates(counts: DataFrame, depth: int) -> tuple[float, list[DataFrame]]:
    """The global share, and for each level (_l0, ..., rate) posterior means of its groups, from ``counts`` (_l0, ..., n, k; stored).

    A group's rate is that of a beta prior around its parent's rate, updated by the group's own counts; the prior's strength is
    one number a level, so a group with few labels stays near the group above it.
    """
    total, good = counts.agg(F.sum("n"), F.sum("k")).first()
    base = (good + 0.5) / (total + 1) if total else 0.5
    out: list[DataFrame] = []
    for level in range(depth):
        names = [f"_l{k}" for k in range(level + 1)]
        groups = counts.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if level:
            groups = groups.join(out[-1].select(names[-2], F.col("rate").alias("prior")), names[-2])
        else:
            groups = groups.withColumn("prior", F.lit(base))
        groups = stored(groups)
        a = _strength(groups, "prior", base)
        out.append(stored(groups.select(*names, ((F.col("k") + a * F.col("prior")) / (F.col("n") + a)).alias("rate"))))
    return base, out


def score_quality(docs: DataFrame, labels: DataFrame, levels: list[Column] | None = None, max_rows: int = MAX_TRAINING_ROWS, max_chars: int = MAX_TRAINING_CHARS) -> DataFrame:
    """doc_id, held_out, site_rate, section_rate, evidence, score and keep (1 if score is at least 0.5) of every row.

    ``levels``: expressions over ``docs``, from host to innermost path level (see :func:`url_levels`); ``source`` and ``lang``
    within it unless given. site_rate and section_rate are posterior means of the outermost and innermost level, evidence is the
    classifier's chance. Rows in the held-out fold are neither counted nor fitted to. A null level is a group of its own;
    groups without labels get the rate of the nearest level above that has some. Null and empty texts are scored by their features, texts of any
    length by the whole. A doc_id with several labels counts once, as good if all say so; rows that repeat an id are counted,
    and scored alike. Without labels all rates and scores are one half. Other columns aren't read; an empty table gives no rows.
    """
    levels = levels or [F.col("source"), F.col("lang")]
    names, depth = [f"_l{k}" for k in range(len(levels))], len(levels)
    marks = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = stored(marks)
    slim = docs.select("doc_id", *_keyed(levels))
    counts = slim.join(marks, "doc_id").groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") > 0).cast("long")).alias("k"))
    base, rates = level_rates(stored(counts), depth)

    def measured(texts, quality):
        return range(len(texts)), {"x": [features(t) for t in texts], "quality": quality}

    known = labelled_sample(docs, marks, "quality", max_rows, max_chars)
    table = map_texts(known, measured, "x array<double>, quality int", more=("quality",)).toPandas().sort_values("doc_id", kind="stable")
    y = (table["quality"].to_numpy() > 0).astype(float)
    model = fit_logistic(np.array(table["x"].tolist()), y) if len(y) else None
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0

    def judge(texts, *groups):
        if model is None:
            z = np.zeros(len(texts))
        else:
            mean, scale, w = model
            z = _expanded(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)), mean, scale) @ w
        return range(len(texts)), {"z": np.clip(z, -30, 30), **dict(zip(names, groups))}

    out = map_texts(docs.select("doc_id", "text", *_keyed(levels)), judge, ", ".join(["z double", *(f"{n} string" for n in names)]), more=tuple(names))
    for k, found in enumerate(rates):
        out = out.join(found.select(names[k], F.col("rate").alias(f"_r{k}")), names[k], "left")
    site_rate = F.coalesce("_r0", F.lit(base))
    section_rate = F.coalesce(*[f"_r{k}" for k in reversed(range(depth))], F.lit(base))
    logit = F.col("z") - float(prior) + F.log(section_rate / (1 - section_rate))
    score = 1 / (1 + F.exp(-logit))
    return out.select("doc_id", held_out().alias("held_out"), site_rate.alias("site_rate"), section_rate.alias("section_rate"), (1 / (1 + F.exp(-F.col("z")))).alias("evidence"), score.alias("score"), (score >= 0.5).cast("int").alias("keep"))
