"""N-gram Jaccard self-join by chosen paths.

Documents are sets of word shingles. Documents with equal sets form one class, and the join runs over classes. Each class has
a signature of ``SIGNATURE`` minhashes. A chosen-path run splits the classes recursively: at every node, coordinates of the
signature are sampled by a hash that all classes share, about 1/threshold of them, and a class goes on to one
child for each sampled coordinate, named by the coordinate and the value there. Two classes with a similarity at the
threshold so share a child with probability 0.63 or more. Nodes with at most ``LEAF`` classes are compared at once; larger ones split
again, up to ``DEPTH`` times. ``repetitions`` independent runs reach the target recall.

Leaves are compared by signature; what is close enough is linked into candidate groups, whose members' shingle sets are then
compared exactly, block against block, so that no task holds more than two blocks of about ``BLOCK_BYTES`` of sets and no list of all pairs is ever made.
Groups are components of links, found by alternating star contraction in Spark.

Defined cases: null, empty and wordless texts have no shingles, are in classes of their own and have no links; fewer words than
a shingle make one shingle; copies count as links to each other; rows that share an id are separate documents of which
the id is reported for each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .textbytes import PRIME, Words, mixed, text_slices

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
SIGNATURE, LEAF, DEPTH = 64, 64, 3
SIGNED_BLOCK, BLOCK_BYTES = 1024, 2 << 20
SLICE_BYTES = 1 << 20  # of text worked on at once; several times as many are held meanwhile
SLACK = 0.2  # how far below the threshold a signature's estimate may lie (4 standard errors)


def repetitions(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was compared with at least this probability."""
    survive = 1.0
    for _ in range(depth):
        survive = 1 - math.exp(-survive)
    return math.ceil(math.log(1 - recall) / math.log(1 - survive))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each; where each text's begin, with the end."""
    w = Words(texts)
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    counts = np.diff(w.first)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        here = np.arange(n) + i < w.first[1:][w.doc]
        nxt = np.where(here, w.hashes[np.minimum(np.arange(n) + i, n - 1)], np.uint64(0))
        h = h * PRIME + nxt
    h = mixed(h)
    start = np.arange(n) - w.first[:-1][w.doc]
    good = (start == 0) | (start + k <= counts[w.doc])
    doc, h = w.doc[good], h[good]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


_SEEDS = np.random.default_rng(11).integers(1, 2**32, (2, SIGNATURE), dtype=np.uint64).astype(np.uint32)


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minhash signatures (uint32) of the sets that aren't empty."""
    out = np.empty((len(first) - 1, SIGNATURE), np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = first[:-1]
    for i in range(SIGNATURE):
        v = (x ^ _SEEDS[0, i]) * (_SEEDS[1, i] | np.uint32(1))
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def made_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of :func:`classes`, a slice of texts at a time: what is made of one is passed on before the next one's turn."""
    for batch in batches:
        for i, j, texts in text_slices(batch.column("text"), SLICE_BYTES):
            h, first = shingle_sets(texts)
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            key, signed = np.zeros(j - i, np.uint64), np.zeros((0, SIGNATURE), np.uint32)
            if len(some):
                starts = first[some]
                total = np.add.reduceat(mixed(h ^ PRIME), starts) + np.add.reduceat(h, starts) * PRIME
                key[some] = mixed(total + sizes[some].astype(np.uint64))
                signed = signatures(h, np.append(starts, len(h)))
            low = np.sort((np.repeat(np.arange(j - i, dtype=np.uint64), sizes) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).astype(np.uint32)
            empty = sizes == 0
            # Without words there are no bytes, and null stands for them.
            column = lambda data, counts: pa.Array.from_buffers(
                pa.binary(), j - i, [pa.array(~empty).buffers()[1], pa.py_buffer(np.append(0, 4 * np.cumsum(counts)).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), pa.array(key.view(np.int64), mask=empty), column(signed.ravel(), np.where(empty, 0, SIGNATURE)), column(low, sizes)],
                ["doc_id", "text_key", "set_key", "signature", "shingles"])


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key (null without words), signature, shingles (low 32 bits, ascending), once for each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return docs.mapInArrow(made_sets, "doc_id long, text_key long, set_key long, signature binary, shingles binary")


def children(level: int, runs: int):
    """mapInArrow function: from set_key, node (null at the root) and signature to the nodes of the next level."""
    rate = min(1.0, 1.0 / (THRESHOLD * SIGNATURE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(SIGNATURE, dtype=np.uint64)
        for batch in batches:
            keys = batch.column("set_key").to_numpy()
            sigs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            if level:
                parents = [(np.arange(len(keys)), batch.column("node").to_numpy().view(np.uint64))]
            else:
                parents = [(np.arange(len(keys)), np.full(len(keys), mixed(np.array([r + 1], np.uint64) * PRIME)[0])) for r in range(runs)]
            rows, nodes = [], []
            for who, node in parents:
                for i in range(0, len(who), 20_000):
                    part, own = who[i : i + 20_000], node[i : i + 20_000]
                    draw = mixed(own[:, None] ^ (at + np.uint64(1)) * PRIME)
                    taken, coordinate = np.nonzero((draw >> np.uint64(11)).astype(np.float64) < rate * 2.0**53)
                    value = sigs[part[taken], coordinate].astype(np.uint64)
                    rows.append(part[taken])
                    nodes.append(mixed(draw[taken, coordinate] + (value + np.uint64(1)) * PRIME))
            rows_, nodes_ = np.concatenate(rows), np.concatenate(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows_]), pa.array(nodes_.view(np.int64))], ["set_key", "node"])

    return run


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for links between 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures whose agreement reaches the threshold less the slack."""
    least = math.ceil((THRESHOLD - SLACK) * SIGNATURE)
    found_a, found_b = [], []
    for i in range(0, len(sigs), 32):
        part = sigs[i : i + 32]
        same = (part[:, None, :] == sigs[None, i:, :]).sum(2) >= least
        x, y = np.nonzero(same)
        more = y > x
        found_a.append(x[more] + i)
        found_b.append(y[more] + i)
    return np.concatenate(found_a), np.concatenate(found_b)


def leaf_links(groups: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    for keys, sigs in groups:
        if len(keys) < 2:
            continue
        a, b = _close(sigs)
        if len(a):
            label = components(len(keys), a, b)
            for i in np.flatnonzero(label != np.arange(len(keys))):
                yield int(keys[i]), int(keys[label[i]])


def _grouped(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of sorted batches by key; a group holds at most what its key's block allows."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in columns]
        for k, *row in zip(batch.column(key).to_pylist(), *cols):
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(tuple(row))
    if held:
        yield held


def block_pairs(members: DataFrame, group: str, blocks, row: str) -> DataFrame:
    """``task``: each member once for every pair of blocks it is in, ``side`` 0 or 1; a group of one block is one task.

    blocks: how many a group has. A block is dealt by a hash of the row, so blocks stay even however large a group is.
    """
    n = F.greatest(F.ceil(blocks).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64(row, F.lit(3)), n).cast("int")
    df = members.withColumn("_n", n).withColumn("_own", own)
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    df = df.withColumn("task", F.xxhash64(group, low, high)).withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
    return df.withColumn("alone", F.col("_own") == F.col("_other")).drop("_n", "_own", "_other")


def candidate_links(sets: DataFrame, recall: float = RECALL) -> DataFrame:
    """a, b: links between classes whose signatures are close, enough to hold each candidate group together."""
    runs = repetitions(recall)
    found = None
    live = sets.select("set_key", F.lit(None).cast("long").alias("node"), "signature")
    signed = sets.select("set_key", "signature")
    for level in range(DEPTH):
        nodes = staged(live.mapInArrow(children(level, runs), "set_key long, node long"), f"paths{level}")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sizes = staged(sizes, f"sizes{level}")
        last = level == DEPTH - 1
        leaf = nodes.join(sizes if last else sizes.where(F.col("size") <= LEAF), "node").join(signed, "set_key")
        made = linked(block_pairs(leaf, "node", F.col("size") / SIGNED_BLOCK, "set_key"))
        found = made if found is None else found.unionByName(made)
        if not last:
            live = nodes.join(sizes.where(F.col("size") > LEAF), "node").join(signed, "set_key").select("set_key", "node", "signature")
    return staged(found.distinct(), "links")


def linked(leaves: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            for rows in _grouped(batches, "task", ["set_key", "signature"]):
                yield np.array([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), np.uint32).reshape(-1, SIGNATURE)

        links = list(leaf_links(groups()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    df = leaves.select("task", "set_key", "signature")
    return df.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each one's component, by alternating large and small stars.

    What each round joins has been written before, so that Spark can split the rows of a large star's centre.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    state = lambda df: df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # Large star: larger neighbours go to the least; small star: smaller ones and the node itself do.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "stars")
        lower = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        after = state(edges)
        if before == after:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def verified(tasks: DataFrame) -> DataFrame:
    """a, b, n: by exact comparison. Rows with a <> b link groups together; those with a = b carry n, a's links in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "task", ["set_key", "shingles", "side", "alone", "copies"]):
            keys = np.array([r[0] for r in rows], np.int64)
            side = np.array([r[2] for r in rows])
            alone = rows[0][3]
            copies = np.array([r[4] for r in rows], np.int64)
            sets = [np.frombuffer(r[1], np.uint32) for r in rows]
            sizes = np.array([len(s) for s in sets])
            vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            mark = np.zeros(len(vocabulary), np.uint16)
            found_a, found_b = [], []
            degree = np.zeros(len(rows), np.int64)
            right = np.arange(len(rows)) if alone else np.flatnonzero(side == 1)
            left = np.arange(len(rows)) if alone else np.flatnonzero(side == 0)
            if not len(right) or not len(left):
                continue
            picked = np.concatenate([flat[starts[j] : starts[j] + sizes[j]] for j in right])
            offsets = np.cumsum(sizes[right]) - sizes[right]
            for i in left:
                own = flat[starts[i] : starts[i] + sizes[i]]
                mark[own] = 1
                common = np.add.reduceat(mark[picked], offsets, dtype=np.int64)
                mark[own] = 0
                good = common >= THRESHOLD * (sizes[i] + sizes[right] - common) - 1e-9
                near = right[good & (right != i)]
                degree[i] += copies[near].sum()
                if not alone:
                    degree[near] += copies[i]
                if len(near):
                    found_a.append(np.full(len(near), i))
                    found_b.append(near)
            if not found_a:
                continue
            label = components(len(rows), np.concatenate(found_a), np.concatenate(found_b))
            star, some = np.flatnonzero(label != np.arange(len(rows))), np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[keys[star], keys[some]]), pa.array(np.r_[keys[label[star]], keys[some]]), pa.array(np.r_[np.zeros(len(star), np.int64), degree[some]])], ["a", "b", "n"])

    df = tasks.select("task", "set_key", "shingles", "side", "alone", "copies")
    return df.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long, n long")


def matched(documents: DataFrame, recall: float = RECALL, keepers: bool = False) -> DataFrame:
    """doc_id, text_key, set_key, class_id, n_links of every document; class_id is the least doc_id of its group of linked documents.

    With ``keepers`` also keeper: null, doc_id and text_key of the row that stands for the group, an id before none and then the least.
    """
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("keeper")] if keepers else []
    kept = ["keeper"] if keepers else []
    rows = staged(classes(documents), "sets").withColumn("row", F.monotonically_increasing_id())
    own = rows.where("set_key IS NOT NULL")
    # One row stands for each class; equal sets have equal signatures and shingles.
    counts = staged(own.groupBy("set_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("row").alias("row"), F.max(F.octet_length("shingles")).alias("bytes"), *first), "classes")
    sets = own.select("row", "set_key", "signature").join(counts.select("row"), "row", "left_semi").drop("row")
    groups = staged(connected(candidate_links(staged(sets, "signatures"), recall)), "groups")
    members = groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = staged(members.join(counts, F.col("node") == F.col("set_key")).select("root", "row", "set_key", "copies", "bytes"), "members")
    sizes = staged(members.groupBy("root").agg(F.sum("bytes").alias("size")), "sizes")
    members = members.drop("bytes").join(sizes, "root")
    wanted = own.select("row", "shingles").join(members, "row")
    exact = staged(verified(block_pairs(wanted, "root", F.col("size") / BLOCK_BYTES, "set_key")), "exact")
    linked_to = exact.where("a = b").groupBy(F.col("a").alias("set_key")).agg(F.sum("n").alias("n"))
    roots = connected(exact.where("a <> b").select("a", "b"))
    of = counts.join(roots, F.col("set_key") == F.col("node"), "left").select("set_key", "copies", "least", *kept, F.coalesce("root", "set_key").alias("root"))
    of = staged(of.join(linked_to, "set_key", "left"), "linked")
    ids = staged(of.groupBy("root").agg(F.min("least").alias("class_id"), *[F.min(c).alias(c) for c in kept]), "ids")
    of = staged(of.drop(*kept).join(ids, "root").select("set_key", "class_id", *kept, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classed")
    return rows.select("doc_id", "text_key", "set_key").join(of, "set_key", "left").select(
        "doc_id", "text_key", "set_key", *kept, F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(documents: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return matched(documents, recall).select("doc_id", "class_id", "n_links")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, all columns, of which one row of each group stays: that with the least id, then the least hash of its text.

    A row is told by its id and text, so rows that share an id, or have none, stay or go each for itself; of rows equal in
    both one stays. Texts without words all stay but for that.
    """
    same = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_key") == F.col("keeper.text_key"))
    drop = matched(documents, keepers=True).where(F.col("set_key").isNotNull() & ~same).select(F.col("doc_id").alias("_drop"), F.col("text_key").alias("_drop_text")).distinct()
    df = documents.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    df = df.join(drop, F.col("doc_id").cast("long").eqNullSafe(F.col("_drop")) & (F.col("_text") == F.col("_drop_text")), "left_anti")
    once = Window.partitionBy("doc_id", "_text").orderBy("_text")
    return df.withColumn("_copy", F.row_number().over(once)).where("_copy = 1").select(*documents.columns)
