"""Document fingerprints: Merkle trees over the blocks, paragraphs and sections of a text.

A paragraph is a line. Its leaves are the digests of its blocks of ``block`` code points, its own digest covers
them, a section covers ``fanout`` paragraphs, and the root covers all sections. The fingerprint is this tree as text:
``root:sections:leaves``, the root as SHA-256, sections as 64-bit digests joined by dots, leaves shortened to 16 bits each
(four hexadecimal digits), with a slash between paragraphs. Equal roots mean equal trees; where roots differ,
:func:`differing_sections` names the branches that changed, and :func:`likeness` tells from two fingerprints alone how
much of the texts agrees.

Defined cases: null text is the empty text; an empty text has one empty paragraph; two trees without leaves are
alike if their roots are equal, else 0.0; rows that share an id follow each other in no stated order; rows without an id come last;
columns other than those named are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

BLOCK, FANOUT = 8, 8


def add_tree(df: DataFrame, text: str, prefix: str, block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """Adds ``{prefix}fingerprint``."""
    leaves, paragraphs, sections = f"{prefix}leaves", f"{prefix}paragraphs", f"{prefix}sections"
    blocks = F.lit(f"(?s).{{1,{block}}}")
    df = df.withColumn(
        leaves,
        F.transform(F.split(F.col(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, blocks, F.lit(0)), lambda x: F.xxhash64(x))),
    )
    df = df.withColumn(paragraphs, F.transform(leaves, lambda x: F.xxhash64(F.size(x), x)))
    starts = F.sequence(F.lit(1), F.size(paragraphs), F.lit(fanout))
    df = df.withColumn(sections, F.transform(starts, lambda i: F.xxhash64(i, F.slice(F.col(paragraphs), i, F.lit(fanout)))))
    upper = F.concat_ws(".", F.transform(sections, lambda x: F.hex(x)))
    root = F.sha2(F.concat_ws("|", F.size(paragraphs).cast("string"), upper), 256)
    short = F.transform(leaves, lambda p: F.concat_ws("", F.transform(p, lambda x: F.substring(F.hex(x.bitwiseAND(F.lit(0xFFFF)) + F.lit(0x10000)), 2, 4))))
    out = F.concat_ws(":", root, F.lower(upper), F.lower(F.concat_ws("/", short)))
    return df.withColumn(f"{prefix}fingerprint", out).drop(leaves, paragraphs, sections)


def likeness(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Adds the Dice coefficient of two fingerprints: of their sets of leaves, or of leaves equal at the same place if that is more.

    The first finds blocks that moved with their paragraph, the second the unchanged part of a text that repeats itself.
    1.0 for equal roots.
    """
    for side, column in (("_x", a), ("_y", b)):
        df = df.withColumn(side, F.regexp_extract_all(F.replace(F.substring_index(column, ":", -1), F.lit("/"), F.lit("")), F.lit("[0-9a-f]{4}"), F.lit(0)))
    total = F.size("_x") + F.size("_y")
    shared = 2.0 * F.size(F.array_intersect("_x", "_y")) / (F.size(F.array_distinct("_x")) + F.size(F.array_distinct("_y")))
    in_place = 2.0 * F.size(F.filter(F.zip_with("_x", "_y", lambda p, q: p == q), lambda same: same)) / total
    found = F.when(F.col(a) == F.col(b), 1.0).when(total == 0, 0.0).otherwise(F.greatest(shared, in_place))
    return df.withColumn(name, found).drop("_x", "_y")


def differing_sections(a: str, b: str) -> Column:
    """Numbers (from 0) of the sections of fingerprint ``a`` that ``b`` does not have at the same place."""
    of = lambda x: F.split(F.get(F.split(x, ":"), F.lit(1)), r"\.")
    pairs = F.zip_with(of(a), of(b), lambda x, y: F.when(x.isNull(), None).otherwise(~x.eqNullSafe(y)))  # null: a has no such section
    return F.filter(F.transform(pairs, lambda differs, i: F.when(differs, i)), lambda i: i.isNotNull())


def with_next(docs: DataFrame, spread: int = 8) -> DataFrame:
    """Adds ``next_text``: the text of the next document by descending id, the first one's after the last.

    The order is dealt into ranges of ids at approximate quantiles; an id that spans several quantiles has as many
    ranges of its own, and so have missing ids, dealt by a hash of the row. Each text is shuffled once, to its range;
    the first document of a range is also sent to the range before it, so no task sees more than its own range.
    """
    spark = docs.sparkSession
    n = partitions(spark) * spread
    docs = docs.withColumn("tie", F.xxhash64("text", F.monotonically_increasing_id()))
    row = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n)), F.count("*"), F.count("doc_id")).first()
    bounds = sorted(row[0] or [], reverse=True) if n > 1 else []
    hot = {b: bounds.count(b) for b in set(bounds)} if len(set(bounds)) < len(bounds) else {}
    hot = {b: k for b, k in hot.items() if k > 1}
    missing = max(1, round(n * (row[1] - row[2]) / max(row[1], 1)))
    # A range holds the ids below one bound and from the next one on; a hot id has bounds on both sides.
    edges = sorted({*bounds, *(b + 1 for b in hot)}, reverse=True)
    # Two levels of bounds, so that a row is compared with twice the root of their number.
    size = max(1, round(len(edges) ** 0.5))
    groups = [edges[i : i + size] for i in range(0, len(edges), size)]
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), F.lit(kind))
    below = lambda found: F.size(F.filter(found, lambda b: F.col("doc_id") < b))
    docs = docs.withColumn("_group", below(literal([g[0] for g in groups], "array<bigint>")))
    docs = docs.withColumn("_bound", F.when(F.col("_group") > 0, (F.col("_group") - 1) * size + below(F.get(literal(groups, "array<array<bigint>>"), F.col("_group") - 1))).otherwise(0))
    ranges = F.try_element_at(literal({str(b): k for b, k in hot.items()}, "map<string,bigint>"), F.col("doc_id").cast("string"))
    many = F.when(F.col("doc_id").isNull(), F.lit(missing)).otherwise(F.coalesce(ranges, F.lit(1)))
    part = F.least(F.floor((F.shiftrightunsigned("tie", 11) / float(1 << 53)) * many), many - 1)
    place = F.when(F.col("doc_id").isNull(), F.lit(len(edges) + 1)).otherwise(F.col("_bound")).cast("long") * F.lit(1 << 32) + part
    docs = docs.withColumn("place", place).drop("_group", "_bound")
    # Nulls last: the key is ascending, so the first document of a place has the least key.
    key = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("id"), F.shiftrightunsigned("tie", 11).alias("part"), F.col("tie").alias("tie"))
    keyed = docs.withColumn("key", key)
    heads = keyed.groupBy("place").agg(F.min("key").alias("head"))
    order = Window.orderBy("place")  # one row for each range
    heads = heads.select(
        F.col("place").alias("head_place"), "head",
        F.coalesce(F.lag("place").over(order), F.last("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"),
    )
    ghosts = (
        keyed.join(F.broadcast(heads), (F.col("place") == F.col("head_place")) & (F.col("key") == F.col("head")))  # a row for each range
        .withColumn("ghost", F.lit(True)).withColumn("place", F.col("to")).drop("head", "head_place", "to")
    )
    both = keyed.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    in_place = Window.partitionBy("place").orderBy("ghost", "key")
    return both.withColumn("next_text", F.lead("text").over(in_place)).where(~F.col("ghost")).drop("ghost", "place", "key", "tie")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form; see the contract of the query."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - k), F.substring(F.col("next_text"), F.lit(1), k)))
    for text, prefix in (("text", ""), ("edited", "edited_"), ("next_text", "next_")):
        df = add_tree(df, text, prefix)
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited", "next_text")
    df = likeness(likeness(df, "near_edited", "fingerprint", "edited_fingerprint"), "near_next", "fingerprint", "next_fingerprint")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.concat_ws(",", differing_sections("fingerprint", "edited_fingerprint").cast("array<string>")).alias("edited_sections"),
    )
