"""Language identification by word-first backoff.

A word seen in training scores by its log frequency in each language. An unseen word backs off to its longest character
n-grams that were seen, from ``ORDERS[0]`` characters down to one; those of two and more characters mark the ends of the
word. What no table knows scores alike for all languages. A document's score is the sum over its words, so none is left out.

Training counts the words of about ``SAMPLE`` documents, as many of each language, chosen by a hash: a bounded sample of labelled
rows. Spark counts them; the driver gets the counts of words seen ``SEEN`` times or more in a language, no texts. Words
seen less often are left to their n-grams. Prediction covers every whole text.

Defined cases: null text, or one without a letter, is ``und`` with score 0.0, and letters are what Unicode calls so
(not ½ or ①); if nothing was learned, every text is ``und``; ties go to the first language in alphabetical order; a null lang is
not learned from; repeated rows are each predicted; columns other than doc_id, text and (in training) lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .textbytes import text_slices

SAMPLE, SEEN, ORDERS = 4_000, 2, (5, 4, 3, 2, 1)
CACHE = 300_000
RUNS = re.compile(r"[^\W\d_]+")  # letters, and numbers such as ½ that Python's pattern does not tell from them


def words(text: str) -> list[str]:
    """Maximal runs of letters of the lower-cased text."""
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in (x if x.isalpha() else "".join(c if c.isalpha() else " " for c in x)).split()]


def ngrams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """languages in order; tables: a dict for words, then one for each n-gram order, from key to row of logs."""

    def __init__(self, languages: list[str], tables: list[dict[str, int]], logs: np.ndarray):
        self.languages, self.tables, self.logs = languages, tables, logs

    def vector(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return self.logs[known]
        for n, table in zip(ORDERS, self.tables[1:]):
            rows = [table[g] for g in ngrams(word, n) if g in table]
            if rows:
                return self.logs[rows].mean(0)
        return np.zeros(len(self.languages), np.float32)


def train(rows: Iterable[tuple[str, str]]) -> Model:
    """rows: (language, text)."""
    counts: Counter = Counter()
    for lang, text in rows:
        counts.update((lang, w) for w in words(text))
    return from_counts((lang, w, n) for (lang, w), n in counts.items())


def from_counts(rows: Iterable[tuple[str, str, int]]) -> Model:
    """rows: (language, word, times seen)."""
    kinds: list[dict[str, Counter]] = [defaultdict(Counter) for _ in (0, *ORDERS)]
    for lang, word, c in rows:
        kinds[0][lang][word] += c
        for kind, n in zip(kinds[1:], ORDERS):
            own = kind[lang]
            for g in ngrams(word, n):
                own[g] += c
    languages = sorted(kinds[0])
    if not languages:
        return Model([], [{} for _ in kinds], np.zeros((0, 0), np.float32))
    tables, logs, size = [], [], 0
    for kind in kinds:
        keys = sorted(set().union(*(kind[lang] for lang in languages)))
        tables.append({k: size + i for i, k in enumerate(keys)})
        size += len(keys)
        seen = np.array([[kind[lang].get(k, 0) for k in keys] for lang in languages], np.float64) + 0.5
        logs.append(np.log(seen / seen.sum(1, keepdims=True)).T)
    return Model(languages, tables, np.concatenate(logs).astype(np.float32))


def fit(documents: DataFrame, training=None, sample: int = SAMPLE, seen: int = SEEN) -> Model:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    if training is not None:
        rows = rows.where(training(F.col("doc_id")))
    totals = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(float(sample) / max(totals.count(), 1)) / F.col("n")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    rows = rows.join(totals, "lang").where(part < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, texts in text_slices(batch.column("text")):
                counts = Counter((lang, w) for lang, t in zip(langs[i:j], texts) for w in words(t.decode()))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    counts = rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    return from_counts((r.lang, r.word, r.n) for r in counts.collect())  # words of the sample


class Lookup:
    """Distinct words of a task and their vectors."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.vectors = np.zeros((0, len(self.model.languages)), np.float32)

    def rows(self, texts: list[list[str]]) -> np.ndarray:
        distinct = set(chain.from_iterable(texts))
        new = list(distinct.difference(self.number))
        if len(self.number) + len(new) > CACHE and self.number:
            self.clear()
            new = list(distinct)
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.vectors = np.concatenate([self.vectors, np.stack([self.model.vector(w) for w in new])])
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))


def predict(texts: list[str | None], model: Model, lookup: Lookup | None = None) -> list[tuple[str, float]]:
    out = [("und", 0.0)] * len(texts)
    found = [words(t) if t and model.languages else [] for t in texts]
    some = [i for i, x in enumerate(found) if x]
    if not some:
        return out
    lookup = lookup or Lookup(model)
    rows = lookup.rows([found[i] for i in some])
    starts = np.cumsum([0] + [len(found[i]) for i in some[:-1]])
    total = np.add.reduceat(lookup.vectors[rows], starts, axis=0, dtype=np.float64)
    best = total.argmax(1)
    score = 1.0 / np.exp(np.clip(total - total[np.arange(len(some)), best][:, None], -700, 0)).sum(1)
    for i, b, x in zip(some, best, score):
        out[i] = (model.languages[b], float(x))
    return out


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        for batch in batches:
            made = [x for _, _, texts in text_slices(batch.column("text")) for x in predict([t.decode() for t in texts], lookup.model, lookup)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(documents: DataFrame) -> DataFrame:
    """See the contract of the query."""
    model = fit(documents, lambda i: fold(i, 4) != 2)
    return identify(documents, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
