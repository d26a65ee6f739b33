"""Language identification by hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds them, permuted by their place: the first
letter's rotated twice, the second's once, the third's as it is, multiplied. A text's vector bundles (adds up) the
vectors of all its trigrams, runs of anything but letters counting as one space; a language's prototype bundles its
texts'. A text has the language with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import held_out, share_picked
from .words import map_texts, mix

DIM = 1024

#: Trigrams whose vectors are held at a time.
STEP_GRAMS = 4096

#: Prototypes are bundled from about so many texts, if there are more.
MAX_TRAINING_ROWS = 20_000

_LETTER = np.zeros(0x110000, bool)
_SPACE = 32


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once in a process."""
    if not _LETTER[97]:
        _LETTER[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The random vector of each code point, the same in every process: (len(codes), dim) of +1 and -1."""
    seeds = mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    blocks = [mix(seeds + np.uint64((k + 1) * 0xD1342543DE82EF95 % 2**64)) for k in range(dim // 64)]
    bits = np.unpackbits(np.stack(blocks, axis=1).view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).reshape(len(codes), dim)


def text_vectors(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """The bundled vector of each text, (len(texts), dim); zero for texts without a letter."""
    out = np.zeros((len(texts), dim), np.float32)
    codes, owner = [], []
    for i, t in enumerate(texts):
        if t:
            c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            c = np.where(_letters()[c], c, _SPACE)
            c = np.concatenate([[_SPACE], c, [_SPACE]])
            c = c[np.concatenate([[True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)])]
            if len(c) > 2:
                codes.append(c)
                owner.append(np.full(len(c), i))
    if not codes:
        return out
    letters, place = np.unique(np.concatenate(codes), return_inverse=True)
    owner, n = np.concatenate(owner), np.int64(len(letters))
    inner = (owner[2:] == owner[:-2]) & (owner[1:-1] == owner[:-2])
    trigram = ((place[:-2] * n + place[1:-1]) * n + place[2:])[inner]
    grams, g = np.unique(trigram, return_inverse=True)
    pairs, count = np.unique(owner[:-2][inner] * np.int64(len(grams)) + g, return_counts=True)
    vectors = letter_vectors(letters, dim)
    twice, once = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    order = np.argsort(pairs % len(grams), kind="stable")
    text, gram, count = pairs[order] // len(grams), pairs[order] % len(grams), count[order]
    # whatever the alphabet, no more than STEP_GRAMS trigrams have vectors at a time
    for at in range(0, len(grams), STEP_GRAMS):
        part = grams[at : at + STEP_GRAMS]
        bound = twice[part // (n * n)]
        bound *= once[part // n % n]
        bound *= vectors[part % n]
        a, b = np.searchsorted(gram, (at, at + STEP_GRAMS))
        table = np.zeros((len(texts), len(part)), np.float32)
        table[text[a:b], gram[a:b] - at] = count[a:b]
        out += table @ bound.astype(np.float32)
    return out


def fit_prototypes(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """(languages, their prototypes) from texts with a ``lang`` outside the held-out fold, each text counting alike.

    Tasks bundle their texts before anything is shuffled: what leaves a task is one vector for each language it met.
    """
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(~held_out())
    rows = docs.select("doc_id", "lang").filter("lang is not null").filter(~held_out()).count()
    # by text and id, so that an id which many rows have is sampled like any other rows
    known = known.filter(share_picked(F.xxhash64("doc_id", "text"), max_rows / max(1, rows))).select("text", "lang")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                v = text_vectors(part["text"].tolist(), dim)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for lang, where in part.reset_index(drop=True).groupby("lang").indices.items():
                    sums[lang] = sums.get(lang, 0) + v[where].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            # whole numbers, so that the order of tasks can't matter
            yield pd.DataFrame({"lang": lang, "i": np.arange(dim), "x": np.round(v * 1e6).astype(np.int64)})

    table = known.mapInPandas(bundle, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    if table.empty:
        return [], np.zeros((0, dim), np.float32)
    wide = table.pivot(index="lang", columns="i", values="x").sort_index()
    p = wide.to_numpy(dtype=np.float64)
    return wide.index.tolist(), (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict_language(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 at least) of every row; ``und`` and 0 for a text that is null or has no letter.

    Without any learned language everything is ``und``. Ties go to the first language in order of names.
    """
    dim = prototypes.shape[1]

    def run(texts):
        names, scores = [], []
        for at in range(0, len(texts), 256):
            v = text_vectors(texts[at : at + 256], dim)
            norm = np.linalg.norm(v, axis=1)
            cosine = v @ prototypes.T / np.maximum(norm, 1e-9)[:, None]
            for c, n in zip(cosine, norm):
                known = n > 0 and len(languages) > 0
                names.append(languages[int(c.argmax())] if known else "und")
                scores.append(float(np.clip(c.max(), 0, 1)) if known else 0.0)
        return range(len(texts)), {"lang_pred": names, "score": scores}

    return map_texts(docs, run, "lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    Rows with a null lang teach nothing. Null texts and texts without a letter are ``und`` with score 0; without any labelled text
    all are. Texts of any length are read whole. Repeated rows give equal rows, an empty table none. Columns other than
    doc_id, text and lang aren't read, so their names may be any.
    """
    return predict_language(docs, *fit_prototypes(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
