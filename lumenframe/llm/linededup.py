"""Removal of repeated runs of lines by a suffix array over line numbers.

The lines of all documents are one sequence of numbers, with every document's end as a bound, and the suffixes are ranked by
distributed prefix doubling: ranks by the first line are places in the sorted order of line digests; the rank by 2h lines is the place
of the pair (rank by h lines here, rank by h lines h lines on) in the sorted order of all such pairs. Each round sorts the
distinct pairs by range over the cluster. Suffixes whose first h lines occur once leave the later rounds: nothing
longer there can be repeated.

The longest common prefix with any earlier suffix then comes from the tree of LCP intervals: an interval is the set of suffixes
that share their first lines, and each suffix descends from the root by 2^k, ..., 2, 1 more lines for as long as it is not the
first of its interval. The first of an interval goes down with it only to stand for it, so each round holds at
most twice the rows. What a suffix reaches is the maximal repeated run that begins there; runs of ``min_words`` words or
more are deleted, the first copy in the order of document and line stays.

A line has a word at least, so 2^k lines with 2^k >= ``min_words`` are enough: runs longer than the last round's are
covered by those that begin at each of their lines. The number of rounds depends on ``min_words`` alone.

Lines are told apart by 128-bit digests, all that follows compares whole numbers. Words end at any ASCII white space.

Defined cases: a null text stays null; documents whose lines are all deleted are dropped; rows equal in doc_id and text are
one document, of which one row stays; empty texts stay; null ids come first; blank lines belong to no run and stay; columns other than doc_id and text are kept
as they are (n_chars, if there, is counted anew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

MIN_WORDS = 25
DOC, NODE = ["_id", "_key"], ["in_id", "in_key", "in_pos"]


def keyed(documents: DataFrame) -> DataFrame:
    low = -(2**63)
    return documents.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(low))).withColumn("_key", F.xxhash64(F.col("_id"), "text"))


def full(line: Column) -> Column:
    return line.rlike(r"\S")


def repeated(documents: DataFrame, min_words: int) -> DataFrame:
    """_id, _key, pos (number of the line among those that aren't blank), line (digest), words: the lines that occur more than once."""
    lines = F.filter(F.split("text", "\n", -1), full)
    df = keyed(documents).select(*DOC, F.transform(lines, lambda x: F.struct(F.unhex(F.md5(x)).alias("line"), F.regexp_count(x, F.lit(r"\S+")).alias("words"))).alias("lines"))
    df = df.where(F.aggregate("lines", F.lit(0), lambda a, x: a + x["words"]) >= min_words)
    each = staged(df.select(*DOC, F.posexplode("lines").alias("pos", "x")).select(*DOC, "pos", "x.*"), "lines")
    shared = staged(each.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "shared-lines")
    return staged(each.join(shared, "line").select(*DOC, "pos", "line", "words").dropDuplicates([*DOC, "pos"]), "repeated-lines")


def ordered(keys: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct keys with their rank in sorted order: ranges are sorted, and begin after the sizes of those before them."""
    parts = keys.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id())
    parts = staged(parts, "ranges")
    sizes = parts.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*columns))
    return staged(parts.join(F.broadcast(sizes), "_range").select(*columns, (F.col("before") + place).alias("rank")), "ranks")


def ranks(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """For 1, 2, 4, ... lines: _id, _key, pos and rank of the suffixes that share so many first lines with another one."""
    pairs, columns = lines.select(*DOC, "pos", "line"), ["line"]
    levels: list[DataFrame] = []
    while True:
        keys = pairs.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(*columns)
        level = staged(pairs.join(ordered(keys, columns), columns).select(*DOC, "pos", "rank"), "suffixes")
        if level.isEmpty():
            return levels
        levels.append(level)
        h = 1 << (len(levels) - 1)
        if h >= min_words:
            return levels
        onward = F.max("rank").over(Window.partitionBy(*DOC).orderBy("pos").rangeBetween(h, h))  # h lines on
        columns = ["here", "onward"]
        pairs = staged(level.select(*DOC, "pos", F.col("rank").alias("here"), onward.alias("onward")).where("onward IS NOT NULL"), "pairs")


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _key, pos, lines, words, and in_id, in_key, in_pos: for each repeated line, how many lines from there on occur earlier too
    (0: none), their words, and where the first copy begins."""
    lines = repeated(documents, min_words)
    sums = F.sum("words").over(Window.partitionBy(*DOC).orderBy("pos"))
    lines = staged(lines.withColumn("until", sums), "word-sums")
    levels = ranks(lines, min_words)
    none = [F.lit(0).cast("long").alias(c) for c in NODE]
    state = lines.select(*DOC, "pos", (F.col("until") - F.col("words")).alias("before"), *none, F.lit(0).alias("depth"), F.lit(True).alias("real"))
    state = state.withColumn("in_pos", F.col("in_pos").cast("int"))
    columns = state.columns
    for k in reversed(range(len(levels))):
        at = levels[k].select(*DOC, F.col("pos").alias("at"), "rank")
        tried = staged(state.withColumn("at", F.col("pos") + F.col("depth")).join(at, [*DOC, "at"], "left").drop("at"), "descent")
        inside = tried.where("rank IS NOT NULL")
        own = F.struct(*DOC, "pos")
        found = inside.groupBy(*NODE, "depth", "rank").agg(F.count("*").alias("n"), F.min(own).alias("first")).where("n > 1").drop("n")
        # Written before it is joined, so that Spark can split the rows of a hot interval.
        inside = inside.join(staged(found, "intervals"), [*NODE, "depth", "rank"], "left")
        first = F.col("first") == own
        stays = F.when(F.col("first").isNull() | first, F.struct(*columns))
        node = [F.col(f"first.{a}").alias(b) for a, b in zip([*DOC, "pos"], NODE)]
        goes = F.when(F.col("first").isNotNull(), F.struct(*DOC, "pos", "before", *node, (F.col("depth") + (1 << k)).alias("depth"), (F.col("real") & ~first).alias("real")))
        inside = inside.select(F.inline(F.filter(F.array(stays, goes), lambda x: x.isNotNull())))
        state = staged(tried.where("rank IS NULL").select(*columns).unionByName(inside), "depths")
    ends = lines.select(*DOC, (F.col("pos") + 1).alias("end"), "until")
    state = state.where("real").withColumn("end", F.col("pos") + F.col("depth")).join(ends, [*DOC, "end"], "left")
    words = F.when(F.col("depth") > 0, F.col("until") - F.col("before")).otherwise(0)
    return state.select(*DOC, "pos", F.col("depth").alias("lines"), words.alias("words"), *NODE)


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _key, places: numbers of the lines (blank ones not counted) that lie in a later copy of a repeated run."""
    end = F.when(F.col("words") >= min_words, F.col("pos") + F.col("lines"))
    reach = F.max("end").over(Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = repeated_runs(documents, min_words).select(*DOC, "pos", end.alias("end")).withColumn("reach", reach)
    return lines.where("reach > pos").groupBy(*DOC).agg(F.collect_list("pos").alias("places"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all columns, with later copies of repeated runs deleted from text."""
    columns = documents.columns
    df = keyed(documents).join(repeated_lines(documents, min_words).withColumnRenamed("places", "_places"), ["_id", "_key"], "left")
    # Lines are split below the window: a lambda then looks into a finished array instead of splitting the text again for each line.
    df = df.withColumn("_lines", F.split("text", "\n", -1))
    some = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), full(x).alias("full"))), lambda x: x["full"])
    df = df.withColumn("_full", F.transform(some, lambda x: x["i"]))
    df = df.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_id"))).where("_copy = 1")
    gone = F.transform("_places", lambda p: F.get("_full", p))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    df = df.withColumn("_kept", F.when(F.col("_places").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")))
    df = df.where(F.col("_kept").isNull() | full(F.col("_kept")))
    df = df.withColumn("text", F.coalesce("_kept", "text"))
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.when(F.col("_kept").isNotNull(), F.char_length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*columns)


def query(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of each document that stays: doc_id, the digest of what is left, and the lines left."""
    out = dedup_lines(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), min_words)
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.char_length("text").cast("long").alias("n_chars"))
