"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenised whole; only those longer than a sequence are cut, into full pieces and a rest. Pieces that fill a
sequence stand alone. The others are dealt at random into pools of about ``POOL`` pieces; each pool is packed by islands
that each evolve a population of packings: crossover injects whole well-filled bins of one parent into the other, bins
that hold an injected piece are dissolved, and the displaced pieces are put back by best fit. After every epoch the
islands' best packings migrate to the next island. An island is one Spark task's group, of bounded size, so pools
and islands spread over the cluster, and a pool that reaches its lower bound stops early. A population begins with one packing by best
fit and others that put a random part of the pieces first.

Pools are mixed: bins filled but for ``SLACK`` tokens stay as they are, and the pieces of all others are dealt anew into fewer pools,
deal after deal, so that what pools waste at their ends does not add up.

Defined cases: null text is empty; an empty text is one piece of one token (the end id); rows that share an id are packed
each for itself; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .textbytes import text_slices

LENGTH, END_ID = 2048, 0
POOL, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2_000, 2, 2, 12, 6
#: Tokens a bin may lack to stay as it is; the share of pieces left over beyond which another deal is the last.
SLACK, SHRINK = 2, 0.9
CACHE, SLICE_BYTES = 400_000, 4 << 20  # parts a task knows; text worked on at once
TOKENIZER = "word_bpe_49k.json"

_SPACE = ord(" ")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", b"abcdefghijklmnopqrstuvwxyz ")
_PUNCTUATION, _LETTER, _LATIN = (np.isin(np.arange(256), [*some]) for some in (
    rb"!\"#$%&'()*+,-./:;<=>?@[\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyz", {*range(0x80, 0xC0)} - {0x97, 0xB7}))


def parted(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Parts of the texts, each with a space at its end, no token crosses from one to the next; where each text's begin, with the end.

    Punctuation between a letter (ASCII, or Latin-1 as UTF-8) and a space is a token of its own, so it is cut off.
    """
    buffer = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    marks = _PUNCTUATION[buffer]
    edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1
    edges = edges[int(marks[0]) :]
    starts, ends = edges[::2], edges[1::2]
    before = buffer[starts - 1]
    cut = starts[(buffer[ends] == _SPACE) & (_LETTER[before] | ((buffer[starts - 2] == 0xC3) & _LATIN[before]))]
    buffer = np.insert(buffer, cut, _SPACE)
    spaces = np.flatnonzero(buffer == _SPACE)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(spaces, bounds + np.searchsorted(cut, bounds))
    offsets = np.append(0, spaces + 1).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(spaces), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]), first


class Known:
    """Parts with their ids, numbered in the order they were added."""

    def __init__(self, parts: list[bytes] = [], ids: np.ndarray = np.zeros(0, "<u4"), sizes: np.ndarray = np.zeros(0, np.int64)):
        self.number, self.ids, self.starts = dict(zip(parts, range(len(parts)))), ids, np.append(0, np.cumsum(sizes))

    def add(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))
        self.ids, self.starts = np.append(self.ids, ids), np.append(self.starts, self.starts[-1] + np.cumsum(sizes))

    def flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the numbered parts, one after another, and how many each has."""
        sizes = (self.starts[1:] - self.starts[:-1])[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[:-1][numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class Encoder:
    """ids of whole texts as little-endian uint32 bytes.

    The tokenizer folds case and no token crosses white space, so the distinct parts of the texts are encoded once each, many in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known([b" "], sizes=np.zeros(1, np.int64))

    def ids(self, parts: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all parts, which are not empty, and how many each has. kind: 2 for letters a-z alone, 1 for letters alone, 0 for others."""
        if kind == 2:  # a word each, which neither the normalizer nor the pre-tokenizer changes
            made = [[t.id for t in self.tokenizer.model.tokenize(p)] for p in parts]
            return np.fromiter(chain.from_iterable(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made))
        if kind == 1:
            # Every part has a word at least, so with as many ends of words as parts each has one; offsets cost more than ids.
            raw = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[raw]) + 1
            if len(ends) == len(parts):
                return raw, np.diff(ends, prepend=0)
        made = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        first = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        of = np.searchsorted(first, np.array([o[0] for o in made.offsets], np.int64), side="right") - 1
        return np.array(made.ids, "<u4"), np.bincount(of, minlength=len(parts))

    def learn(self, parts: list[bytes]) -> None:
        kinds: tuple[list[str], list[str], list[str]] = ([], [], [])
        for p in b"".join(parts).decode().split(" ")[:-1]:
            kinds[p.isalpha() and 1 + p.isascii()].append(p)
        for kind, some in enumerate(kinds):
            for i in range(0, len(some), 10_000):
                self.known.add([f"{p} ".encode() for p in some[i : i + 10_000]], *self.ids(some[i : i + 10_000], kind))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        # A text that spells a special token, in any case, is encoded as it is: its parts may cut the token or make one.
        whole = {k for k, t in enumerate(texts) if any(x in t.lower() for x in self.special)}
        parts, first = parted([b"" if k in whole else t for k, t in enumerate(texts)] if whole else texts)
        parts = parts.dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        known = self.known
        fresh = [p for p in distinct if p not in known.number]
        if len(known.number) + len(fresh) > CACHE:  # what this slice uses stays
            kept = [b" ", *(p for p in distinct if p != b" " and p in known.number)]
            self.known = known = Known(kept, *known.flat(np.array([known.number[p] for p in kept], np.int64)))
        self.learn(fresh)
        numbers = np.fromiter(map(known.number.__getitem__, distinct), np.int64, len(distinct))
        ids, sizes = known.flat(numbers[parts.indices.to_numpy()])
        ends = 4 * np.append(0, np.cumsum(sizes))[first]
        raw = ids.tobytes()
        for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            yield np.array(self.tokenizer.encode(texts[k].decode(), add_special_tokens=False).ids, "<u4").tobytes() if k in whole else raw[i:j]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(documents: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or tokenizer_path())
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, texts in text_slices(batch.column("text"), SLICE_BYTES):
                rows = []
                for doc, made in zip(ids[i:j], encoder.encode(texts)):
                    made += end
                    for n, at in enumerate(range(0, len(made), 4 * length)):
                        part = made[at : at + 4 * length]
                        rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], bins: Bins, length: int) -> Bins:
    """Puts items, largest first, each into the fullest bin that has room for it, or a new one."""
    room = [length - sum(sizes[i] for i in b) for b in bins]
    free = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i in sorted(items, key=lambda x: (-sizes[x], x)):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(i)
            r -= sizes[i]
        else:
            k, r = len(bins), length - sizes[i]
            bins.append([i])
        if r:
            insort(free, (r, k))
    return bins


def fitness(bins: Bins, sizes: list[int], length: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, which leaves the waste in few bins."""
    return -len(bins), sum((sum(sizes[i] for i in b) / length) ** 2 for b in bins)


def crossover(a: Bins, b: Bins, sizes: list[int], length: int, rng) -> Bins:
    """Some well-filled bins of b go into a whole; a's bins that share a piece with them are dissolved."""
    fill = np.array([sum(sizes[i] for i in x) for x in b], float)
    weight = (fill / length) ** 8
    n = max(1, int(len(b) * rng.uniform(0.1, 0.4)))
    picked = rng.choice(len(b), size=min(n, len(b)), replace=False, p=weight / weight.sum())
    injected = [list(b[k]) for k in picked]
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return best_fit(displaced, sizes, injected + kept, length)


def mutate(a: Bins, sizes: list[int], length: int, rng) -> Bins:
    """Dissolves the emptiest bins and a few at random."""
    fill = [sum(sizes[i] for i in x) for x in a]
    order = np.argsort(fill)
    gone = set(order[: max(1, len(a) // 50)].tolist()) | set(rng.choice(len(a), size=max(1, len(a) // 20), replace=False).tolist())
    loose = [i for k in gone for i in a[k]]
    return best_fit(loose, sizes, [list(x) for k, x in enumerate(a) if k not in gone], length)


def evolve(sizes: list[int], population: list[Bins], length: int, generations: int, most: int, seed: int) -> list[Bins]:
    """The best packings after some generations, best first; stops at the lower bound."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // length)
    everything = list(range(len(sizes)))
    population = list(population) or [best_fit(everything, sizes, [], length)]
    while len(population) < most and min(map(len, population)) > bound:
        shuffled = [everything[i] for i in rng.permutation(len(everything))]
        # A packing that starts from a random part of the pieces, in order of arrival.
        first = best_fit(shuffled[: len(shuffled) // 3], sizes, [], length)
        population.append(best_fit(shuffled[len(shuffled) // 3 :], sizes, first, length))
    population.sort(key=lambda x: fitness(x, sizes, length), reverse=True)
    for _ in range(generations):
        if len(population[0]) <= bound or len(population) < 2:
            break
        children = []
        for _ in range(most // 2):
            i, j = sorted(rng.choice(len(population), size=2, replace=False).tolist())
            children.append(crossover(population[i], population[j], sizes, length, rng))
            children.append(mutate(population[i], sizes, length, rng))
        population = sorted(population + children, key=lambda x: fitness(x, sizes, length), reverse=True)[:most]
    return population


def _island(length: int, generations: int, most: int):
    """applyInArrow function: one row for each piece, with its bin in each packing the island has (column ``bins``)."""

    def run(key, group):
        group = group.sort_by("row")
        sizes = group.column("length").to_pylist()
        given = np.array(group.column("bins").to_pylist(), np.int64).reshape(len(sizes), -1)
        population = []
        for c in range(given.shape[1]):
            order = np.argsort(given[:, c], kind="stable")
            population.append([x.tolist() for x in np.split(order, np.flatnonzero(np.diff(given[order, c])) + 1)])
        pool, island, epoch = (k.as_py() for k in key)
        best = evolve(sizes, population, length, generations, most, (pool * 1009 + island * 31 + epoch) & 0x7FFFFFFF)[:2]
        bins = np.empty((len(sizes), len(best)), np.int64)
        for c, packing in enumerate(best):
            for k, members in enumerate(packing):
                bins[members, c] = k
        fill = np.array([sum(sizes[i] for i in x) for x in best[0]], np.int64)[bins[:, 0]]
        done = len(best[0]) <= -(-sum(sizes) // length)
        return pa.table({"pool": group.column("pool"), "island": group.column("island"), "row": group.column("row"), "length": group.column("length"), "bins": pa.array(bins.tolist(), pa.list_(pa.int64())),
                         "fill": pa.array(fill), "used": pa.array(np.full(len(sizes), len(best[0]))), "done": pa.array(np.full(len(sizes), done))})

    return run


def evolved(loose: DataFrame, pools: int, deal: int, length: int, islands: int, epochs: int, generations: int, most: int) -> DataFrame:
    """row, length, pool, bin, fill (of the bin): the best packing of each pool; ``deal`` numbers the way pieces are dealt into pools."""
    pool = F.pmod(F.xxhash64("row", F.lit(5 + deal)), F.lit(pools)).alias("pool")
    state = loose.select(pool, F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "row", "length", F.array().cast("array<bigint>").alias("bins"))
    schema = "pool long, island int, row long, length long, bins array<bigint>, fill long, used long, done boolean"
    out = None
    for epoch in range(epochs):
        # A task has some eight islands; small rows alone would put thousands into one.
        state = state.repartition(max(1, pools * islands // 8), "pool", "island")
        state = staged(state.groupBy("pool", "island", F.lit(epoch).alias("epoch")).applyInArrow(_island(length, generations, most), schema), f"epoch{epoch}")
        first = state.groupBy("pool").agg(F.min(F.struct("used", "island")).alias("best"), F.max("done").alias("ends"))
        state = state.drop("done").join(first.select("pool", F.col("best.island").alias("winner"), (F.col("ends") | F.lit(epoch + 1 == epochs)).alias("ends")), "pool")
        # A pool at its lower bound is settled; in the others the best packing of each island goes on to the next, beside its own.
        settled = state.where("ends AND island = winner").select("row", "length", "pool", F.element_at("bins", 1).alias("bin"), "fill")
        out = settled if out is None else out.unionByName(settled)
        state = state.where("NOT ends")
        moved = state.select("pool", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "row", F.element_at("bins", 1).alias("guest"))
        state = state.join(moved, ["pool", "island", "row"]).select("pool", "island", "row", "length", F.concat("bins", F.array("guest")).alias("bins"))
    return staged(out, "packed")


def pack(parts: DataFrame, length: int = LENGTH, pool: int = POOL, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, most: int = POPULATION) -> DataFrame:
    """parts (any columns with ``length``) with sequence_id and offset."""
    parts = staged(parts, "pieces").withColumn("row", F.monotonically_increasing_id())
    loose, left = parts.where(F.col("length") < length).select("row", "length"), None
    # Sequence ids: full pieces first, then 2^24 for each pool of a deal.
    ids = parts.where(F.col("length") >= length).select("row", (F.lit(1 << 62) + F.col("row")).alias("sequence_id"))
    for deal in range(32):
        count = loose.count()
        pools, last = max(1, -(-count // pool)), left is not None and count > SHRINK * left
        packed = evolved(loose, pools, deal, length, islands, epochs, generations, most)
        # Well-filled bins stay; what is in the others is dealt anew, into fewer pools, until one is left or little was gained.
        keep = F.lit(True) if pools == 1 or last else F.col("fill") >= length - SLACK
        ids = ids.unionByName(packed.where(keep).select("row", (F.lit(deal << 56) + F.col("pool") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")))
        if pools == 1 or last:
            break
        loose, left = packed.where(~keep).select("row", "length"), count
    out = parts.join(ids.withColumnRenamed("row", "r"), F.col("row") == F.col("r")).drop("r")
    order = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop("row")


def query(documents: DataFrame, path: str | None = None) -> DataFrame:
    """See the contract of the query."""
    return pack(pieces(documents, path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
