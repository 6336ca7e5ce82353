"""Language-model scoring of whole documents.

Word counts of all training documents are summed in Spark; from them come the base score and, with the pairs of ids where words
meet, the table of subword ids, which grows with the corpus, and the corpus bigrams the model starts from. A causal
self-attention model (:mod:`attention`) is first trained on a few documents, then copies of it are trained on about ``TRAINER``
documents each, so that together they see every training document, and averaged. Scoring tokenises each distinct word once, and each
position is scored once under overlapping windows.

Counts of the ``HEAD`` most frequent words are sent to all tasks; those of other words are joined by word.

Defined cases: null text is empty; an empty text is one end token; without training documents the model is untrained and
the base has N = V = 0; rows that share an id are scored each for itself; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .attention import Prior, Scorer, Vocabulary, blocks_of
from .common import fold, staged
from .textbytes import text_slices

HEAD, HEAD_BYTES = 100_000, 64
PILOT, TRAINER, CACHE, PAIRS = 800, 2_000, 300_000, 4_000_000
PILOT_EPOCHS, PILOT_RATE, LOCAL_RATE = 4, 0.01, 0.004
TOKENIZER = "piece_bpe_32k.model"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()  # at ASCII white space


def tokenizer(path: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(TOKENIZER))


def encode(processor, some: list[bytes]) -> list[list[int]]:
    return processor.encode([w.decode() for w in some], num_threads=1) if some else []


def word_counts(documents: DataFrame) -> DataFrame:
    """word, c: over all documents; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                for text in texts:
                    seen.update(words(text))
            seen[b""] += batch.num_rows
            if len(seen) > CACHE:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_pairs(counts: DataFrame, path: str | None) -> DataFrame:
    """a, b, n: how often id b follows id a inside words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = tokenizer(path)
        for batch in batches:
            made = encode(processor, [w.encode() for w in batch.column("word").to_pylist()])
            n = np.repeat(batch.column("c").to_numpy(), [max(len(x) - 1, 0) for x in made])
            a = np.array([i for x in made for i in x[:-1]], np.int64)
            b = np.array([i for x in made for i in x[1:]], np.int64)
            keys, where = np.unique((a << 32) | b, return_inverse=True)
            n = np.bincount(where, weights=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["a", "b", "n"])

    return counts.where("word <> ''").mapInArrow(run, "a long, b long, n long")


def joints(documents: DataFrame, path: str | None) -> DataFrame:
    """a, b, n: how often a word ends in id a and the next one begins with id b; -1 is the begin of a text, and its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32) - 1), pa.array((keys & 0xFFFFFFFF) - 1), pa.array(n)], ["a", "b", "n"])

        processor = tokenizer(path)
        number: dict[bytes, int] = {}
        ends = np.zeros((0, 2), np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for i, j, texts in text_slices(batch.column("text")):
                split = [words(t) for t in texts]
                new = list(set().union(*split).difference(number))
                if len(number) + len(new) > CACHE and number:
                    number, ends, new = {}, ends[:0], list(set().union(*split))
                number.update(zip(new, range(len(number), len(number) + len(new))))
                ends = np.concatenate([ends, np.array([(x[0], x[-1]) if x else (-1, -1) for x in encode(processor, new)], np.int64).reshape(-1, 2)])
                counts = np.fromiter(map(len, split), np.int64, j - i)
                own = ends[np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))]
                some = own[:, 0] >= 0  # a word may have no ids
                counts = np.bincount(np.repeat(np.arange(j - i), counts)[some], minlength=j - i)
                gaps = np.cumsum(counts)
                a, b = np.insert(own[some, 1], gaps - counts, -1), np.insert(own[some, 0], gaps, -1)
                held.append(((a + 1) << 32) | (b + 1))
                if sum(map(len, held)) > PAIRS:
                    yield rows()
                    held = []
        if held:
            yield rows()

    return documents.select("text").mapInArrow(run, "a long, b long, n long")


def prior_from(training: DataFrame, counts: DataFrame, texts: int, path: str | None) -> tuple[Vocabulary, Prior]:
    pairs = id_pairs(counts, path).withColumn("across", F.lit(False)).unionByName(joints(training, path).withColumn("across", F.lit(True)))
    pairs = staged(pairs.groupBy("a", "b", "across").agg(F.sum("n").alias("n")), "pairs")
    by_id = np.zeros(tokenizer(path).get_piece_size(), np.int64)
    for r in pairs.where("b >= 0").groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the tokenizer
        by_id[r.b] = r.n
    vocabulary = Vocabulary(by_id, texts, *attention.table_shape(by_id))
    table = ", ".join(map(str, [-1, *np.flatnonzero(vocabulary.compact < vocabulary.size).tolist()]))
    inside = lambda c: F.expr(f"if({c} IN ({table}), {c}, -2)").alias(c)
    small = pairs.select(inside("a"), inside("b"), "across", "n").groupBy("a", "b", "across").agg(F.sum("n").alias("n")).toArrow()  # pairs seen of the table's ids
    a, b, n, across = (small.column(c).to_numpy() for c in ("a", "b", "n", "across"))
    place = np.append(vocabulary.compact.astype(np.int64), [vocabulary.size, -1])  # by id; -2 is any other one
    a, b, n = np.where(a == -1, vocabulary.begin, place[a]), np.where(b == -1, vocabulary.end, place[b]), n.astype(np.float64)
    n[across], spread = attention.joint_counts(a[across], b[across], n[across], vocabulary.size)
    return vocabulary, Prior(vocabulary, (a, b, n), spread)


class Model:
    def __init__(self, vocabulary: Vocabulary, prior: Prior, parameters: dict, path: str | None):
        self.vocabulary, self.prior, self.parameters, self.path = vocabulary, prior, parameters, path
        self.trained = 0  # ids, ends of texts too, that the copies were trained on

    def sequences(self, processor, texts: list[bytes]) -> list[np.ndarray]:
        return [self.vocabulary.compact[np.array([i for x in encode(processor, words(t)) for i in x], np.int64)] for t in texts]


def fit(training: DataFrame, counts: DataFrame, path: str | None = None) -> Model:
    """Pilot on a few documents, then trainers on all training documents and an average weighted by tokens."""
    row = counts.where("word = ''").agg(F.sum("c").alias("texts")).first()
    vocabulary, prior = prior_from(training, counts, int(row.texts or 0), path)
    hashed = F.xxhash64("doc_id", F.lit(17))
    pilot = training.orderBy(hashed, "doc_id").limit(PILOT).select("text").collect()  # PILOT documents
    model = Model(vocabulary, prior, attention.fresh(vocabulary), path)
    sequences = model.sequences(tokenizer(path), [(r.text or "").encode() for r in pilot])
    model.parameters = attention.train(model.parameters, prior, sequences, vocabulary, PILOT_EPOCHS, PILOT_RATE, back=len(sequences) // 8)
    sent = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lookup, p, seen = Lookup(m, {}), m.parameters, 0
        for batch in batches:
            for i, j, texts in text_slices(batch.column("text")):
                split = [words(t) for t in texts]
                flat, lengths = lookup.flat(lookup.numbers(split))
                of = np.repeat(np.arange(j - i), [len(x) for x in split])
                made = np.split(flat, np.cumsum(np.bincount(of, weights=lengths, minlength=j - i).astype(np.int64))[:-1])
                p = attention.train(p, m.prior, made, m.vocabulary, 1, LOCAL_RATE)
                seen += sum(len(x) + 1 for x in made)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([attention.packed(p).tolist()], pa.list_(pa.float32()))], ["weight", "parameters"])

    # A trainer has about TRAINER texts, dealt by a hash of the row, so the model does not depend on how files are split.
    trainers = max(1, -(-int(row.texts or 0) // TRAINER))
    spread = training.select("text", hashed.alias("deal")).repartition(trainers, "deal", F.xxhash64("text")).select("text")
    local = staged(spread.mapInArrow(run, "weight long, parameters array<float>"), "trained")
    # Averages of averages: about the root of the number of trainers each, and as many on the driver.
    few = max(1, round(trainers**0.5))
    mean = local.withColumn("part", F.pmod(F.xxhash64("weight", "parameters"), F.lit(few))).groupBy("part").applyInArrow(_averaged, "weight long, parameters array<float>").collect()
    if mean:
        weight = np.array([r.weight for r in mean], np.float64)
        vector = (weight[:, None] * np.array([r.parameters for r in mean], np.float32)).sum(0) / weight.sum()
        model.parameters, model.trained = attention.unpacked(vector.astype(np.float32), model.parameters), int(weight.sum())
    return model


def _averaged(table: pa.Table) -> pa.Table:
    """One row for some trainers: their parameters' average, weighted by what they were trained on."""
    weight = table.column("weight").to_numpy().astype(np.float64)
    total = sum(w * np.array(p.values, np.float64) for w, p in zip(weight, table.column("parameters")))
    return pa.table({"weight": pa.array([int(weight.sum())], pa.int64()), "parameters": pa.array([(total / weight.sum()).astype(np.float32).tolist()], pa.list_(pa.float32()))})


class Lookup:
    """Distinct words of a task: their compact ids, what ids outside the table add, and their log counts."""

    def __init__(self, model: Model, head: dict[bytes, float]):
        self.model, self.head, self.processor = model, head, tokenizer(model.path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.other, self.logs = np.zeros(0), np.zeros(0)

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """Numbers of all words, text after text."""
        words_ = set().union(*texts)
        new = list(words_.difference(self.number))
        if len(self.number) + len(new) > CACHE and self.number:
            self.clear()
            new = list(words_)
        made, v = encode(self.processor, new), self.model.vocabulary
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int64, int(sizes.sum()))
        compact = v.compact[flat]
        apart = np.where(compact == v.size, v.log_other[flat], 0.0)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.ids = np.concatenate([self.ids, compact])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.other = np.concatenate([self.other, np.bincount(np.repeat(np.arange(len(new)), sizes), weights=apart, minlength=len(new))])
        self.logs = np.concatenate([self.logs, np.array([self.head.get(w, math.nan) for w in new], float)])
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compact ids of the words, one after another, and how many each has."""
        lengths = (self.starts[1:] - self.starts[:-1])[numbers]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[:-1][numbers] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def scored(documents: DataFrame, model: Model, head: dict[bytes, float]) -> DataFrame:
    """Two kinds of rows. For each document (word is null): row, doc_id, n_tokens, known and logs over head words, score.
    For each of its other words: row, word, k (times it occurs)."""
    context = documents.sparkSession.sparkContext
    sent, heads = context.broadcast(model), context.broadcast(head)
    names = ["row", "doc_id", "word", "k", "n_tokens", "known", "logs", "score"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer, lookup, v = Scorer(m.parameters, m.prior), Lookup(m, heads.value), m.vocabulary
        end_log = heads.value.get(b"", math.log10(0.5))
        for batch in batches:
            rows, ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j, texts in text_slices(batch.column("text"), 1 << 19):
                split = [words(t) for t in texts]
                counts = np.array([len(x) for x in split], np.int64)
                numbers = lookup.numbers(split)
                doc = np.repeat(np.arange(j - i), counts)
                logs, other = lookup.logs, lookup.other
                flat, lengths = lookup.flat(numbers)
                per_text = np.bincount(doc, weights=lengths, minlength=j - i).astype(np.int64)
                inputs, targets, valid, first, text, _ = blocks_of(np.split(flat, np.cumsum(per_text)[:-1]), v)
                lp = scorer.log_probabilities(inputs, targets, first)
                score = np.bincount(text, weights=(lp * valid).sum(1, dtype=np.float64), minlength=j - i) / math.log(10)
                score += np.bincount(doc, weights=other[numbers], minlength=j - i)
                word_logs = logs[numbers]
                tail = np.isnan(word_logs)
                known = np.bincount(doc, weights=~tail, minlength=j - i).astype(np.int64) + (b"" in heads.value)
                total = np.bincount(doc, weights=np.where(tail, 0, word_logs), minlength=j - i) + end_log
                at = np.flatnonzero(tail)
                flat_words = [w for x in split for w in x]
                rare = Counter((int(d), flat_words[a]) for d, a in zip(doc[at], at))
                n, m_ = j - i, len(rare)
                cols = [rows[i:j] + [rows[i + d] for d, _ in rare], ids[i:j] + [None] * m_, [None] * n + [w.decode() for _, w in rare], [None] * n + list(rare.values()),
                        (counts + 1).tolist() + [None] * m_, known.tolist() + [None] * m_, total.tolist() + [None] * m_, score.tolist() + [None] * m_]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return documents.mapInArrow(run, "row long, doc_id long, word string, k long, n_tokens long, known long, logs double, score double")


def score_documents(documents: DataFrame, training=None, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document; training: a function of the id column."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = docs if training is None else docs.where(training(F.col("doc_id")))
    counts = staged(word_counts(learn), "words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    head_rows = counts.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("c") > 0)).orderBy(F.desc("c"), "word").limit(HEAD).collect()  # HEAD words
    head = {r.word.encode(): math.log10(r.c + 0.5) for r in head_rows}
    model = fit(learn, counts, path)
    rows = staged(scored(docs.withColumn("row", F.monotonically_increasing_id()), model, head), "scored")
    c = F.coalesce("c", F.lit(0))
    tail = rows.where("word IS NOT NULL").select("row", "word", "k").join(counts.where("c > 0"), "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(c + 0.5)).alias("rest"))
    each = math.log10(sums.n + 0.5 * (sums.v + 1))
    out = rows.where("word IS NULL").join(tail, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(sums.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")


def query(documents: DataFrame, path: str | None = None) -> DataFrame:
    """See the contract of the query."""
    out = score_documents(documents, lambda i: fold(i, 5) != 1, path)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
