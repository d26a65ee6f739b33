"""Toxicity: a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word's embedding is the sum of rows for its hash, its first four letters and its last four letters. Filters of
widths 1, 2 and 3 slide over the words, each filter's largest response over the whole text counts (so one passage in a
long text is found), and a logistic layer joins them. A language's threshold is chosen on training rows
that weren't fitted to; the language is itself guessed from the words, so no column but the text enters a score. Scores
are shifted on the logit scale such that each language's threshold lies at 0.5.

All labelled rows outside the held-out fold are learned from. They are dealt by a hash into cells of about ``CELL_ROWS``;
in each epoch every cell goes on training from the same model, all cells at a time, and the cells' models are averaged
(iterative parameter mixing). Counts and thresholds are sums over all rows. Neither texts nor ids of words come to
the driver, only sums of the model's size, in whole numbers, so their order changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from .folds import fold, held_out
from .words import WordHashes, map_texts, words
from .workspace import stored

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)

#: Labelled rows, and characters of their texts, of a cell: what is trained on in a row before models are averaged.
CELL_ROWS, CELL_CHARS = 8_192, 64_000_000

#: Bits of the map of ids that have labels, by which most texts without are left out before others are shuffled.
MARK_BITS = 1 << 25

#: Texts, and words, that give one step of training.
STEP_TEXTS, STEP_WORDS = 8, 20_000

#: Steps of the whole numbers that models are summed in, and of the logits that thresholds are chosen between.
UNIT, LOGIT_UNIT = 1 << 24, 1 << 8

#: Columns of what a cell gives back: a bucket's embedding and its sum of squares.
COLUMNS = [f"v{k}" for k in range(DIM + 1)]


class _Pieces(WordHashes):
    """Word to its three buckets, packed in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        a, b, c = (xxhash.xxh3_64_intdigest(x) % BUCKETS for x in ("w" + word, "p" + word[:4], "s" + word[-4:]))
        h = self[word] = a | b << 15 | c << 30
        return h


_PIECES = _Pieces()


def word_ids(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_PIECES.__getitem__, found), dtype=np.int64, count=len(found))


def _split(ids: np.ndarray) -> list[np.ndarray]:
    return [ids & (BUCKETS - 1), ids >> 15 & (BUCKETS - 1), ids >> 30]


@dataclass
class ToxicityModel:
    embedding: np.ndarray  # (BUCKETS, DIM)
    filters: list[np.ndarray]  # for each width, (width * DIM, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray  # of the pooled responses
    bias: float
    languages: np.ndarray  # (BUCKETS, languages): log chances of a word's bucket
    thresholds: np.ndarray  # for each language, on the logit scale

    def pooled(self, ids: np.ndarray):
        """Largest responses of all filters over a text, where each was reached, and the padded word vectors."""
        a, b, c = _split(ids)
        x = self.embedding[a] + self.embedding[b] + self.embedding[c]
        x = np.concatenate([x, np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
        top, at = [], []
        for w, f, bias in zip(WIDTHS, self.filters, self.biases):
            r = sum(x[k : len(ids) + k] @ f[k * DIM : (k + 1) * DIM] for k in range(w)) + bias
            p = r.argmax(axis=0)
            at.append(p)
            top.append(r[p, np.arange(FILTERS)])
        return np.concatenate(top), at, x

    def logit(self, ids: np.ndarray) -> float:
        if not len(ids):
            return float(self.bias)
        top, _, _ = self.pooled(ids)
        return float(np.maximum(top, 0) @ self.weights + self.bias)

    def language(self, ids: np.ndarray) -> int:
        return int(self.languages[_split(ids)[0]].sum(axis=0).argmax()) if len(ids) else 0

    def score(self, ids: np.ndarray) -> float:
        z = self.logit(ids) - self.thresholds[self.language(ids)]
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


@dataclass
class _State:
    """The network as two matrices, with Adagrad's sums: what an epoch starts from and what cells change."""

    embedding: np.ndarray  # (BUCKETS, DIM + 1), the last column of sums
    dense: np.ndarray  # (2, n): filters as (max(WIDTHS) * DIM, filters), biases, weights, bias; and their sums

    def copy(self) -> _State:
        return _State(self.embedding.copy(), self.dense.copy())


_N, _SPAN = FILTERS * len(WIDTHS), max(WIDTHS) * DIM
_WIDTH = np.repeat(WIDTHS, FILTERS)
_INSIDE = np.arange(_SPAN)[:, None] < _WIDTH * DIM  # which inputs a filter has


def _views(dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = _SPAN * _N, _SPAN * _N + _N, _SPAN * _N + 2 * _N
    return dense[:a].reshape(_SPAN, _N), dense[a:b], dense[b:c], dense[c:]


def _start(seen: np.ndarray, n: np.ndarray, seed: int = 7) -> _State:
    """Embeddings start from how much oftener a bucket is in toxic texts, so that a rare word has a place to start from."""
    rng = np.random.default_rng(seed)
    lean = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    lean[seen[0] + seen[1] < 3] = 0
    embedding = np.full((BUCKETS, DIM + 1), 1e-3, np.float32)
    embedding[:, :DIM] = rng.normal(0, 0.05, (BUCKETS, DIM))
    embedding[:, 0] += np.clip(lean / 3, -1, 2)
    dense = np.full((2, _SPAN * _N + 2 * _N + 1), 1e-2, np.float32)
    filters, biases, weights, bias = _views(dense[0])
    filters[:] = np.where(_INSIDE, rng.normal(0, 0.2, (_SPAN, _N)), 0)
    filters[0, np.arange(_N) % FILTERS < FILTERS // 2] += 0.5
    biases[:], weights[:], bias[:] = 0, 0.05, -1
    return _State(embedding, dense)


def _step(m: _State, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One step of Adagrad on the logistic loss of a few texts, none of them empty."""
    filters, biases, weights, bias = _views(m.dense[0])
    pad = max(WIDTHS) - 1
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + pad)])
    ids = np.zeros(starts[-1], np.int64)
    real = np.zeros(starts[-1], bool)
    for s, t in zip(starts, texts):
        ids[s : s + len(t)] = t
        real[s : s + len(t)] = True
    x = np.zeros((len(ids) + pad, DIM), np.float32)
    x[: len(ids)][real] = sum(m.embedding[part, :DIM] for part in _split(ids[real]))
    spans = np.concatenate([x[k : k + len(ids)] for k in range(max(WIDTHS))], axis=1)
    found = spans @ filters + biases
    at = np.stack([s + found[s : s + n].argmax(axis=0) for s, n in zip(starts, lengths)])  # (texts, filters)
    top = found[at, np.arange(_N)]
    act = np.maximum(top, 0)
    g = ((1 / (1 + np.exp(-np.clip(act @ weights + bias, -30, 30))) - y) * weight).astype(np.float32)
    back = g[:, None] * weights * (top > 0)
    on_texts, on_filters = np.nonzero(back)
    places, d = at[on_texts, on_filters], back[on_texts, on_filters]
    change = np.zeros_like(m.dense[0])
    of_filters, of_biases, of_weights, of_bias = _views(change)
    of_filters[:] = np.where(_INSIDE, np.einsum("tfi,tf->if", spans[at], back), 0)
    of_biases[:], of_weights[:], of_bias[:] = 0.1 * back.sum(axis=0), g @ act, g.sum()
    buckets, moves = [], []
    for k in range(max(WIDTHS)):
        kept = (_WIDTH[on_filters] > k) & real[np.minimum(places + k, len(ids) - 1)]
        move = d[kept, None] * filters[k * DIM : (k + 1) * DIM, on_filters[kept]].T
        for part in _split(ids[places[kept] + k]):
            buckets.append(part)
            moves.append(move)
    m.dense[1] += change**2
    m.dense[0] -= rate * change / np.sqrt(m.dense[1])
    buckets, moves = np.concatenate(buckets), np.concatenate(moves)
    if len(buckets):
        order = np.argsort(buckets, kind="stable")
        changed, first = np.unique(buckets[order], return_index=True)
        move = np.add.reduceat(moves[order], first, axis=0)
        m.embedding[changed, DIM] += (move**2).sum(axis=1)
        m.embedding[changed, :DIM] -= rate * move / np.sqrt(m.embedding[changed, DIM])[:, None]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, str | None, int, bool]]:
    """cell, ids of words, language, mark and inner of stored rows, each document once: its rows are neighbours."""
    last = None
    for batch in batches:
        for doc, same, cell, ids, lang, toxic, inner in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "_h", "cell", "ids", "lang", "toxic", "inner"))):
            if (doc, same) != last:
                last = doc, same
                yield cell, _unpacked(ids), lang, int(toxic > 0), inner


def _packed(ids: np.ndarray) -> bytes:
    return ids.nbytes.to_bytes(8, "little") + pa.compress(ids.tobytes(), "zstd", asbytes=True) if len(ids) else b""


def _unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(ids[8:], int.from_bytes(ids[:8], "little"), "zstd", asbytes=True) if ids else b"", np.int64)


def _perhaps_marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a doc_id in ``marks``, and few others, without a shuffle: by a map of ``MARK_BITS`` bits, in words of 64."""
    if docs.schema["doc_id"].dataType != marks.schema["doc_id"].dataType or docs.schema["doc_id"].dataType not in (IntegerType(), LongType(), StringType()):
        return docs  # equal ids might have different hashes
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    bits = marks.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return docs.withColumn("_word", word).join(F.broadcast(bits), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """cell, doc_id, _h, lang, ids, toxic, inner of all labelled documents outside the held-out fold, in the order of their cells.

    What repeats an id and its text is mostly left out where it is read, and elsewhere has the same cell and is its neighbour.
    """
    marks = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ours = _perhaps_marked(docs.select("doc_id", "text", "lang").filter("doc_id is not null").filter(~held_out()), marks).withColumn("_h", F.xxhash64("doc_id", "text"))
    sizes = ours.select("doc_id", "_h", F.length("text").alias("chars")).join(marks, "doc_id", "left_semi").groupBy("doc_id", "_h").agg(F.max("chars").alias("chars"))
    n, chars = sizes.agg(F.count(F.lit(1)), F.sum("chars")).first()
    cells = max(1, -(-n // CELL_ROWS), -(-(chars or 0) // CELL_CHARS))

    def ids(texts, lang, same):
        seen = {x: i for i, x in reversed(list(enumerate(zip(same, lang))))}
        index = sorted(seen.values())
        return index, {"_h": [same[i] for i in index], "lang": [lang[i] for i in index], "ids": [_packed(word_ids(texts[i])) for i in index]}

    found = map_texts(ours, ids, "_h bigint, lang string, ids binary", more=("lang", "_h"))
    known = found.join(marks.hint("shuffle_hash"), "doc_id").withColumns({"inner": fold() == 1, "cell": F.pmod(F.xxhash64("_h"), F.lit(cells)).cast("int")})
    return stored(known.repartition(cells, "cell").sortWithinPartitions("cell", "_h", "doc_id", "lang"))


def _counts(known: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of the documents to fit, clean and toxic: in how many each bucket is, and their numbers; of all, by language: each bucket's words."""

    def rows(counts):
        for (what, lang), n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"what": pa.array([what] * len(at), pa.int32()), "lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})
        counts.clear()

    def run(batches):
        counts = {}
        for _, ids, lang, toxic, inner in _documents(batches):
            parts = _split(ids)
            if not inner:
                n = counts.setdefault((toxic, None), np.zeros(BUCKETS + 1, np.int64))
                n[np.unique(np.concatenate(parts))] += 1
                n[BUCKETS] += 1  # the documents
            if lang is not None:
                n = counts.setdefault((2, lang), np.zeros(BUCKETS + 1, np.int64))
                np.add.at(n, parts[0], 1)
                n[BUCKETS] += 1
            if len(counts) > 64:
                yield from rows(counts)
        yield from rows(counts)

    seen, langs = np.zeros((2, BUCKETS + 1), np.int64), {}
    table = known.mapInArrow(run, "what int, lang string, at int, n bigint").groupBy("what", "lang", "at").agg(F.sum("n").alias("n")).toArrow()
    for (what, lang), part in table.to_pandas().groupby(["what", "lang"], dropna=False):
        n = seen[what] if what < 2 else langs.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
        n[part["at"]] = part["n"]
    return seen[:, :BUCKETS], seen[:, BUCKETS], {k: langs[k][:BUCKETS] for k in sorted(langs)}


def _matrix(m: _State) -> np.ndarray:
    """All of a state in rows of one width: the buckets', then the rest's."""
    rest = m.dense.ravel()
    return np.concatenate([m.embedding, np.pad(rest, (0, -len(rest) % len(COLUMNS))).reshape(-1, len(COLUMNS))])


def _epoch(known: DataFrame, start: _State, weights: np.ndarray, rate: float) -> _State:
    """Trains every cell from ``start`` and averages: a bucket over the cells that changed it, the rest over all."""
    sent = known.sparkSession.sparkContext.broadcast(start)  # bounded: BUCKETS * (DIM + 1) floats

    def run(batches):
        before = _matrix(sent.value)
        total, n = np.zeros(before.shape, np.int64), np.zeros(len(before), np.int64)
        m, at, texts, y = sent.value.copy(), None, [], []

        def step():
            if texts:
                _step(m, texts, np.array(y), weights[y], rate)
                texts.clear(), y.clear()

        def add():
            after = _matrix(m)
            changed = (after != before).any(axis=1)
            changed[BUCKETS:] = True
            total[changed] += np.rint(after[changed].astype(np.float64) * UNIT).astype(np.int64)
            n[changed] += 1

        for cell, ids, _, toxic, inner in _documents(batches):
            if cell != at:
                if at is not None:
                    step()
                    add()
                    m = sent.value.copy()
                at = cell
            if inner or not len(ids):
                continue
            texts.append(ids)
            y.append(toxic)
            if len(texts) == STEP_TEXTS or sum(map(len, texts)) > STEP_WORDS:
                step()
        if at is not None:
            step()
            add()
        kept = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(n[kept]), *[pa.array(total[kept, k]) for k in range(len(COLUMNS))]], ["at", "n", *COLUMNS])

    schema = "at int, n bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS)
    table = known.filter("not inner").mapInArrow(run, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", *COLUMNS)]).toArrow()
    mixed, at = _matrix(start), table["at"].to_numpy()
    mixed[at] = np.stack([table[c].to_numpy() for c in COLUMNS], axis=1) / UNIT / table["n"].to_numpy()[:, None]
    sent.destroy()
    return _State(mixed[:BUCKETS], mixed[BUCKETS:].ravel()[: start.dense.size].reshape(start.dense.shape))


def _model(m: _State, langs: dict[str, np.ndarray]) -> ToxicityModel:
    filters, biases, weights, bias = _views(m.dense[0])
    cut = [slice(k * FILTERS, (k + 1) * FILTERS) for k in range(len(WIDTHS))]
    counts = np.stack(list(langs.values()), axis=1) + 0.1 if langs else np.ones((BUCKETS, 1))
    languages = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return ToxicityModel(m.embedding[:, :DIM].copy(), [filters[: w * DIM, c].copy() for w, c in zip(WIDTHS, cut)], [biases[c] for c in cut], weights, float(bias[0]), languages, np.zeros(counts.shape[1]))


def _threshold(logits: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest cut with the fewest errors between logits, of which so many are of clean and of toxic texts; 0
    if there is nothing to tell apart."""
    if clean.sum() + toxic.sum() < 20 or not clean.any() or not toxic.any():
        return 0.0
    order = np.argsort(logits)
    z, clean, toxic = logits[order], clean[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    cuts = [(z[k] - z[k - 1], (z[k] + z[k - 1]) / 2) for k in best if 0 < k < len(z)]
    return float(max(cuts)[1]) if cuts else 0.0


def _thresholds(known: DataFrame, model: ToxicityModel) -> np.ndarray:
    """For each language, from the logits, in steps of 1 / LOGIT_UNIT, of all documents that weren't fitted to."""
    sent = known.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, counts = sent.value, {}
        for _, ids, _, toxic, _ in _documents(batches):
            key = m.language(ids), round(min(50.0, max(-50.0, m.logit(ids))) * LOGIT_UNIT), toxic
            counts[key] = counts.get(key, 0) + 1
        keys = list(zip(*counts)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()) for k in keys] + [pa.array(counts.values(), pa.int64())], ["language", "logit", "toxic", "n"])

    per = known.filter("inner").mapInArrow(run, "language int, logit int, toxic int, n bigint").groupBy("language", "logit")
    found = per.agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(("clean", "marked"))]).toArrow()
    language, logit, clean, toxic = (found[c].to_numpy() for c in ("language", "logit", "clean", "marked"))
    return np.array([_threshold(logit[language == k] / LOGIT_UNIT, clean[language == k], toxic[language == k]) for k in range(len(model.thresholds))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, epochs: int = 4) -> ToxicityModel:
    """Learns from all labelled rows outside the held-out fold.

    A doc_id with several labels counts as toxic if one of them says so; rows that repeat an id and its text count once.
    Texts are learned from whole. Where few are toxic, the clean ones weigh as three times as many together. Without labels of
    both kinds all scores are near the prior.
    """
    known = _labelled(docs, labels)
    seen, n, langs = _counts(known)
    n = np.maximum(1, n)
    weights = np.array([min(1.0, max(500, 3 * n[1]) / n[0]), np.sqrt(min(3.0, n[0] / n[1]))])
    state = _start(seen, n)
    for epoch in range(epochs):
        state = _epoch(known, state, weights, 0.1 / (1 + epoch))
    model = _model(state, langs)
    model.thresholds = _thresholds(known, model)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score is at least 0.5) of every row; null and empty texts are scored too.

    Texts of any length are scored whole. Repeated rows give equal rows, an empty table none. Columns other than doc_id and
    text aren't read, so their names may be any.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS * (DIM + languages) floats

    def run(texts):
        scores = [sent.value.score(word_ids(t)) for t in texts]
        return range(len(texts)), {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_texts(docs, run, "score double, predicted int")


def remove_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't predict toxic, as :func:`score_toxicity` does; repeated rows share a fate."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(word_ids(t.as_py())) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    return score_toxicity(docs, fit_toxicity(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
