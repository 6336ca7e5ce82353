"""Benchmark decontamination with suffix arrays over the training texts.

Each shard (a few MB of whole documents) becomes a sequence of word numbers with a separator of its own after every
document. Its suffix array is built by prefix doubling; every suffix of every benchmark item is then searched in
it, word by word, by binary search over the interval that still matches, until the interval is empty. That gives the
longest verbatim match of every test suffix and where it lies; the intervals at ``window`` words are the hits.

Benchmark items are hashed in Spark tasks and staged; they are then sent in blocks of about ``BLOCK_WORDS`` words. One block
at a time is read, broadcast and searched, and its matches are written before the next one's turn, so neither the driver
nor a task holds more than one block however large the benchmark is. A benchmark of several blocks is one pass over
the documents for each.

Defined cases: null and wordless texts have no words and no hits; an item shorter than the window is one window, a
wordless one none; items that share an id count once; an item without an id hits like others, its id is the empty text; repeated
documents, and those without an id, are each reported; columns other than doc_id, text and item_id are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .textbytes import Words, text_slices

WINDOW = 10
BLOCK_WORDS = 250_000

MATCHES = "doc_id long, n_words long, longest long, starts array<int>, ends array<int>, items array<string>"


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``values`` (ints from 0) in ascending order; only unsettled groups are sorted again."""
    n = len(values)
    order = np.argsort(values, kind="stable").astype(np.int64)
    slots, keys = np.arange(n), values[order].astype(np.int64)
    rank, step = np.empty(n + 1, np.int64), 0
    rank[n] = -1
    while len(slots):
        new = np.r_[True, keys[1:] != keys[:-1]]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        tied = ~(new & np.r_[new[1:], True])
        slots, step = slots[tied], max(1, step * 2)
        if not len(slots):
            break
        at = order[slots]
        keys = rank[at] * (n + 2) + rank[np.minimum(at + step, n)] + 1
        by = np.argsort(keys, kind="stable")
        order[slots], keys = at[by], keys[by]
    return order


class Block:
    """Some benchmark items: their word hashes one after another, and of each suffix the item and the words left."""

    def __init__(self, ids: list[str], hashes: list[np.ndarray], window: int):
        lengths = np.array([len(x) for x in hashes], np.int64)
        self.ids, self.window = ids, window
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(ids)), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        self.left = ends - np.arange(len(self.hashes))
        self.width = np.minimum(window, np.repeat(lengths, lengths))


def _narrow(words: np.ndarray, order: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """First slot in [lo, hi) whose word at ``depth`` is not less than (``after``: greater than) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    last = len(words) - 1
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        word = words[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, last)]
        right = (word <= wanted if after else word < wanted) & open_
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def search(words: np.ndarray, order: np.ndarray, tests: np.ndarray, left: np.ndarray, width: np.ndarray):
    """For each test suffix: the slots [lo, hi) that match it on ``width`` words, and its longest match."""
    n = len(tests)
    found_lo, found_hi, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.flatnonzero(tests >= 0)
    lo, hi, depth = np.zeros(len(alive), np.int64), np.full(len(alive), len(order)), 0
    while len(alive):
        wanted = tests[alive + depth]
        lo = _narrow(words, order, depth, lo, hi, wanted, False)
        hi = _narrow(words, order, depth, lo, hi, wanted, True)
        depth += 1
        some = lo < hi
        alive, lo, hi = alive[some], lo[some], hi[some]
        longest[alive] = depth
        at = width[alive] == depth
        found_lo[alive[at]], found_hi[alive[at]] = lo[at], hi[at]
        more = left[alive] > depth
        alive, lo, hi = alive[more], lo[more], hi[more]
        known = tests[alive + depth] >= 0
        alive, lo, hi = alive[known], lo[known], hi[known]
    return found_lo, found_hi, longest


def shard_matches(texts: list[bytes], block: Block) -> list[tuple]:
    """n_words, longest, starts, ends, items for each text."""
    w = Words(texts)
    n, docs = len(w.hashes), len(texts)
    counts = np.diff(w.first)
    out = [(int(c), 0, [], [], []) for c in counts]
    if not n or not len(block.hashes):
        return out
    vocabulary, numbers = np.unique(w.hashes, return_inverse=True)
    # A separator of its own after each document, above all words.
    places = np.arange(n) + w.doc
    sequence = np.empty(n + docs, np.int64)
    sequence[places] = numbers
    sequence[w.first[1:] + np.arange(docs)] = len(vocabulary) + np.arange(docs)
    order = suffix_array(sequence)
    near = np.minimum(np.searchsorted(vocabulary, block.hashes), len(vocabulary) - 1)
    tests = np.where(vocabulary[near] == block.hashes, near, -1)
    lo, hi, longest = search(sequence, order, tests, block.left, block.width)
    hit = np.flatnonzero((hi > lo) & (block.left >= block.width))
    if not len(hit):
        return out
    sizes = hi[hit] - lo[hit]
    slot = np.repeat(lo[hit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    place, suffix = order[slot], np.repeat(hit, sizes)
    doc = np.searchsorted(w.first[1:] + np.arange(docs), place)
    word = place - doc
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, word, 1)
    np.add.at(marks, word + block.width[suffix], -1)
    covered = np.r_[False, np.cumsum(marks)[:n] > 0, False]
    # Runs end with their document too.
    cut = np.zeros(n + 1, bool)
    cut[w.first[:-1]] = cut[n] = True
    starts = np.flatnonzero(covered[1:-1] & (~covered[:-2] | cut[:n]))
    ends = np.flatnonzero(covered[1:-1] & (~covered[2:] | cut[1:])) + 1
    of_run = w.doc[starts]
    pairs = np.unique(doc * len(block.ids) + block.item[suffix])
    best = np.zeros(docs, np.int64)
    np.maximum.at(best, doc, longest[suffix])
    bounds = np.searchsorted(of_run, np.arange(docs + 1))
    for d in np.unique(doc):
        mine = slice(bounds[d], bounds[d + 1])
        items = pairs[np.searchsorted(pairs, d * len(block.ids)) : np.searchsorted(pairs, (d + 1) * len(block.ids))] % len(block.ids)
        out[d] = (int(counts[d]), int(best[d]), (starts[mine] - w.first[d]).tolist(), (ends[mine] - w.first[d]).tolist(), sorted({block.ids[i] for i in items}))
    return out


def hashed(benchmark: DataFrame) -> DataFrame:
    """item_id, hashes (of the item's words, one after another): the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for i, j, texts in text_slices(batch.column("text")):
                w = Words(texts)
                made = [(k, h.tobytes()) for k, h in zip(ids[i:j], np.split(w.hashes, w.first[1:-1])) if len(h)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.binary())], ["item_id", "hashes"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id string, hashes binary")


def blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Block after block, made as it is asked for; one without items if there are none."""
    ids, hashes, size, some = [], [], 0, False
    for row in staged(hashed(benchmark), "benchmark").toLocalIterator():
        words = np.frombuffer(row.hashes, np.uint64)
        if size and size + len(words) > block_words:
            yield Block(ids, hashes, window)
            ids, hashes, size = [], [], 0
        some = True
        ids.append(row.item_id)
        hashes.append(words)
        size += len(words)
    if ids or not some:
        yield Block(ids, hashes, window)


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document's words, longest match, hit runs of words (starts, ends) and the items that hit it."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def of(block: Block, docs: DataFrame, keys: list[str]) -> tuple:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [x for _, _, texts in text_slices(batch.column("text")) for x in shard_matches(texts, sent.value)]
                made = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keys), *(pa.array(x, t) for x, t in zip(made, kinds))], [*keys, "n_words", "longest", "starts", "ends", "items"])

        return docs.mapInArrow(run, ", ".join(f"{k} long" for k in keys if k != "doc_id") + ", " * (len(keys) > 1) + MATCHES), sent

    source = blocks(benchmark, window, block_words)
    first = next(source)
    second = next(source, None)
    if second is None:
        return of(first, docs, ["doc_id"])[0]
    # Several blocks: one pass over the staged documents for each, and only the hits of it are written; joined by row.
    docs = staged(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    union, counts = None, None
    while first is not None:
        found, sent = of(first, docs, ["row", "doc_id"])
        if counts is None:
            counts = staged(found.select("row", "doc_id", "n_words", "longest", "starts", "ends", "items"), "matches")
            part = counts
        else:
            part = staged(found, "matches")
        sent.unpersist()
        part = part.where(F.size("items") > 0).select("row", "longest", "starts", "ends", "items")
        union = part if union is None else union.unionByName(part)
        first, second = second, next(source, None)
    runs = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    merged = union.groupBy("row").agg(F.max("longest").alias("longest"), F.array_sort(runs).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # A run begins where no run before it reaches: the ends so far are a running maximum over the runs of a document.
    ordered = Window.partitionBy("row").orderBy("starts", "ends")
    each = merged.select("row", F.inline("runs")).withColumn("reach", F.max("ends").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("n", F.sum(F.when(F.col("starts") <= F.col("reach"), 0).otherwise(1)).over(ordered))
    each = each.groupBy("row", "n").agg(F.min("starts").alias("s"), F.max("ends").alias("e")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("m"))
    merged = merged.drop("runs").join(each, "row")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return counts.select("row", "doc_id", "n_words").join(merged, "row", "left").select(
        "doc_id", "n_words", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce(F.col("m.s"), none("int")).alias("starts"),
        F.coalesce(F.col("m.e"), none("int")).alias("ends"), F.coalesce("items", none("string")).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """See the contract of the query; ``longest`` is the longest verbatim match that covers a window, in words."""
    matches = find_matches(documents, benchmark, window)
    hits = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0), lambda a, x: a + x)
    return matches.select(
        "doc_id", "n_words", hits.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), "longest",
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without those that a benchmark window hits."""
    spark = documents.sparkSession
    kept, source = documents, blocks(benchmark, window)
    block = next(source)
    while block is not None:
        sent, after = spark.sparkContext.broadcast(block), next(source, None)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not x[4] for _, _, texts in text_slices(batch.column("text")) for x in shard_matches(texts, sent.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, documents.schema)
        if after is not None:
            kept = staged(kept, "clean")
            sent.unpersist()
        block = after
    return kept
