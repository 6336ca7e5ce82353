"""Toxicity from subword-bag embeddings.

Every word gives its character n-grams (with word boundaries) and itself; their hashed embeddings are averaged over a
window of words and pass through a linear softmax layer. Embeddings and layer are trained jointly in numpy. A
document is the soft maximum (log-sum-exp) over its windows, in training as in scoring, so that a few toxic words in
a long text are not averaged away. Unseen misspellings share n-grams with the words that were seen.

Training reads at most ``PER_CLASS`` labelled documents of each class, those of the least id hashes: the bound on
what passes through the driver. Scoring covers every whole text.

Defined cases: null, empty and wordless texts get the score of no evidence (the layer's prior); null labels are not
learned from, others than 0 count as toxic; of rows that share an id one text is learned from, that of the least hash; repeated rows
are each scored; with one class only, or none, in the training rows, all scores are that
class's share (0.0 without rows); columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .textbytes import IS_WORD, LOWER, text_slices

PER_CLASS = 2_000
BUCKETS, DIMENSIONS, ORDERS = 1 << 19, 8, (3, 4, 5)
WINDOW_BYTES = 64
EPOCHS, BATCH, RATE, SEED = 3, 64, 0.05, 7


def compacted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one zero around words; first byte of each window; document of each window; whether a document has words.

    A window is a stretch of ``WINDOW_BYTES`` of one document.
    """
    lower = LOWER[np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)]
    word = IS_WORD[lower]
    keep = np.flatnonzero(word | np.r_[False, word[:-1]])
    b = lower[keep]
    b[~word[keep]] = 0
    ends = np.searchsorted(keep, np.cumsum([len(x) + 1 for x in texts]))
    sizes = np.diff(np.r_[0, ends])
    many = -(-sizes // WINDOW_BYTES)
    doc = np.repeat(np.arange(len(texts)), many)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return np.r_[np.uint8(0), b], 1 + (ends - sizes)[doc] + within * WINDOW_BYTES, doc, many > 0


def ngrams(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: where n-grams start, and their buckets. Word boundaries (zeros) stand only at the ends of one."""
    edge = np.cumsum(b == 0, dtype=np.int32)
    wide = b.astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, min(max(ORDERS), len(b)) + 1):
        shifted = wide[n - 1 :]
        h = (h[: len(shifted)] * np.uint32(0x01000193)) ^ (shifted * np.uint32(0x9E3779B1))
        if n in ORDERS:
            good = np.flatnonzero(edge[n - 2 : len(b) - 1] == edge[: len(b) - n + 1])
            x = h[good] + np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            yield good, (x & np.uint32(BUCKETS - 1)).astype(np.int32)


def grouped(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buckets, the window of each bucket, windows' sizes, windows' documents; only windows that have n-grams."""
    b, starts, doc, _ = compacted(texts)
    found = list(ngrams(b))
    grams = np.concatenate([g for _, g in found]) if found else np.zeros(0, np.int32)
    place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    number = np.maximum(np.searchsorted(starts, place, side="right") - 1, 0)
    some, number = np.unique(number, return_inverse=True)
    return grams, number, np.bincount(number, minlength=len(some)).astype(np.float32), doc[some] if len(some) else doc[:0]


class Model:
    """value: what each bucket adds to the mean, already passed through the layer; bias: the layer's."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), float(bias)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        b, starts, doc, some = compacted(texts)
        if not len(starts):
            return out
        value, count = np.zeros(len(b), np.float32), np.zeros(len(b), np.float32)
        for place, grams in ngrams(b):
            value[place] += self.value[grams]
            count[place] += 1
        starts[0] = 0
        mean = np.add.reduceat(value, starts, dtype=np.float64) / np.maximum(np.add.reduceat(count, starts), 1)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        best = np.maximum.reduceat(mean, first)
        soft = np.add.reduceat(np.exp(mean - np.repeat(best, np.diff(np.r_[first, len(doc)]))), first)
        out[some] += best + np.log(soft)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(texts), -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Model:
    """Adagrad on the logistic loss of the documents' soft maxima; a softmax layer of two classes is its difference."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), 40.0 if share else -40.0)
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, DIMENSIONS).astype(np.float32)
    # The first dimension starts at each bucket's log odds over documents, less two standard errors.
    seen = np.zeros((2, BUCKETS), np.float32)
    for text, label in zip(texts, labels):
        seen[int(label), np.unique(grouped([text])[0])] += 1
    rows = np.array([(labels == 0).sum(), labels.sum()], np.float32)
    odds = np.log((seen[1] + 0.5) / (rows[1] + 1)) - np.log((seen[0] + 0.5) / (rows[0] + 1))
    error = np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    embedding[:, 0] = np.sign(odds) * np.maximum(0, np.abs(odds) - 2 * error)
    layer[0] = 25.0
    bias = np.float32(-8.0)
    seen_e, seen_l, seen_b = np.full(BUCKETS, 1e-4, np.float32), np.full(DIMENSIONS, 1e-4, np.float32), 1e-4
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(texts))
        for i in range(0, len(texts), BATCH):
            chosen = mixed[i : i + BATCH]
            grams, number, sizes, docs = grouped([texts[k] for k in chosen])
            if not len(grams):
                continue
            distinct, index = np.unique(grams, return_inverse=True)
            # Mean of embeddings by window, from counts by (window, bucket).
            pair, count = np.unique(number * len(distinct) + index, return_counts=True)
            w, g = pair // len(distinct), pair % len(distinct)
            weight = (count / sizes[w]).astype(np.float32)
            local = embedding[distinct]
            starts = np.searchsorted(w, np.arange(len(sizes)))
            hidden = np.add.reduceat(local[g] * weight[:, None], starts, axis=0)
            m = hidden @ layer
            best = np.full(len(chosen), -np.inf, np.float32)
            np.maximum.at(best, docs, m)
            e = np.exp(m - best[docs])
            soft = np.bincount(docs, weights=e, minlength=len(chosen))
            some = soft > 0
            margin = np.where(some, np.where(some, best, 0) + np.log(np.maximum(soft, 1e-30)), 0) + bias
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[chosen]).astype(np.float32)
            by_window = (error[docs] * e / soft[docs]).astype(np.float32)
            grad_l, grad_b = by_window @ hidden, float(error.sum())
            by_gram = np.bincount(g, weights=by_window[w] * weight, minlength=len(distinct)).astype(np.float32)
            grad_e = by_gram[:, None] * layer[None, :]
            seen_e[distinct] += (grad_e * grad_e).sum(1)
            embedding[distinct] -= RATE * grad_e / np.sqrt(seen_e[distinct])[:, None]
            seen_l += grad_l * grad_l
            layer -= 0.1 * RATE * grad_l / np.sqrt(seen_l)
            seen_b += grad_b * grad_b
            bias -= np.float32(RATE * grad_b / np.sqrt(seen_b))
    return Model(embedding @ layer, bias)


def fit(documents: DataFrame, labels: DataFrame, training=None, per_class: int = PER_CLASS) -> Model:
    """Trains on the labelled rows for which ``training`` (a function of the id column) holds."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if training is not None:
        ids = ids.where(training(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = lambda kind: ids.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = least(0).unionByName(least(1))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * per_class ids
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).collect()  # at most 2 * per_class documents
    return train([(r.text or "").encode() for r in rows], np.array([r.toxic for r in rows], np.float32))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxicity: of every whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.scores(texts) for _, _, texts in text_slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "toxicity"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, toxicity double")


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [x < threshold for _, _, texts in text_slices(batch.column("text")) for x in sent.value.scores(texts)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """See the contract of the query."""
    model = fit(documents, labels, lambda i: fold(i, 5) != 0)
    return score(documents, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
