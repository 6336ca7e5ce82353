"""Personal data by bootstrapped contextual extraction.

Seeds are the spans of four fixed kinds (email, ip, card, phone). A candidate is a token, cut at white space, that
holds a digit or an at sign. The words around the seeds, and the key inside a token before ``=`` or ``:``, become
lexical patterns; a neighbour that is a candidate itself stands in them as ``<num>``. Patterns and instances (distinct token
values) form a bipartite graph. Confidence flows along it for a
few rounds: a pattern has the mean confidence of its distinct instances, an unknown instance that of its best pattern.
Patterns that end with enough support and confidence mark their unseen instances as identifiers of kind ``id``.

Matches are taken out of a text with the lengths of the gaps between them, become rows, and get their places by a running sum over
the rows of their document, so the work grows with a document's matches (but for sorting them).

Defined cases: null text counts as empty; overlapping spans of different kinds are all kept; a candidate that
overlaps a base span is a seed and adds no span; repeated rows are each reported; columns other than doc_id and text
are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
# Private-use characters that stand for a separator between digits, and for themselves where a text has them.
SEP, OTHER = "\ue000", "\ue001"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CARD = f"(?<![0-9{SEP}])[0-9][0-9{SEP}]{{13,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.6


def pieces(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<gap, value>>: the lengths of the gaps before the matches, and the matches."""
    empty = F.array().cast("array<struct<gap:int,value:string>>")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("value")))
    return F.when(when, both).otherwise(empty)  # the last gap has no match


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(number))
    def worth(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def marked(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, SEP, OTHER), "(?<=[0-9])[ -](?=[0-9])", SEP)


def is_span(kind: Column, value: Column) -> Column:
    """Whether a match of a kind's pattern is a span of it."""
    n = F.length(digits(value))
    return (
        F.when(kind == 0, F.lit(True)).when(kind == 1, value.rlike(OCTETS))
        .when(kind == 2, F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)).when(kind == 3, n.between(10, 15)).otherwise(True)
    )


#: The number of the kind of a candidate, among those of :data:`KINDS`.
CANDIDATES = len(KINDS)


def tagged(documents: DataFrame) -> DataFrame:
    """row, doc_id and, by kind, the pieces of every document, written once."""
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    df = df.withColumn("email", pieces(text, EMAIL, F.contains(text, F.lit("@")))).withColumn("ip", pieces(text, IP, text.rlike(r"[0-9]\.[0-9]")))
    df = df.withColumn("card", pieces(marked(text), CARD, text.rlike("[0-9](?:[ -]?[0-9]){13}"))).withColumn("phone", pieces(text, PHONE, F.contains(text, F.lit("+"))))
    # Gaps of candidates, with their first and last words: empty if there is none. Both lists are looked at twice, so neither is made anew.
    df = df.withColumn("_gaps", F.when(text.rlike("[0-9@]"), F.split(text, CANDIDATE, -1)))
    word = lambda g, pattern: F.lower(F.regexp_extract(g, pattern, 1))
    gap = F.transform("_gaps", lambda g: F.struct(F.char_length(g).alias("gap"), word(g, r"^\s+(\S+)").alias("first"), word(g, r"(?s)^(?:.*\s)?(\S+)\s+$").alias("last")))
    hits = F.when(F.col("_gaps").isNotNull(), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    both = F.zip_with(gap, hits, lambda g, h: F.struct(g["gap"].alias("gap"), h.alias("value"), g["first"].alias("first"), g["last"].alias("last")))
    df = df.withColumn("candidates", F.coalesce(both, F.array().cast("array<struct<gap:int,value:string,first:string,last:string>>")))
    return staged(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, "candidates"), "pii")


def located(rows: DataFrame) -> DataFrame:
    """row, kind (number), start, end, value, before, after, seed: every span, and every candidate; offsets in code points."""
    none = F.lit(None).cast("string")

    def numbered(kind: int, name: str) -> Column:
        words = (lambda x: (x["first"], x["last"])) if kind == CANDIDATES else (lambda x: (none, none))
        return F.transform(name, lambda x, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), x["gap"].alias("gap"), x["value"].alias("value"), words(x)[0].alias("first"), words(x)[1].alias("last")))

    lists = [numbered(i, k) for i, k in enumerate((*KINDS, "candidates"))]
    each = rows.select("row", F.inline(F.concat(*lists))).repartition("row")
    here = Window.partitionBy("row", "kind").orderBy("n")
    length = F.coalesce(F.char_length("value"), F.lit(0))
    each = each.withColumn("end", F.sum(F.col("gap") + length).over(here.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    follows = F.lead(F.struct("first", F.col("value").isNotNull().alias("hit"))).over(here)
    num = F.lit("<num>")
    before = F.when((F.col("last") == "") & (F.col("n") > 0), num).otherwise(F.col("last"))
    after = F.when((F.col("_next.first") == "") & F.col("_next.hit"), num).otherwise(F.coalesce("_next.first", F.lit("")))
    each = each.withColumn("_next", follows).select("row", "kind", (F.col("end") - length).alias("start"), "end", "value", before.alias("before"), after.alias("after"))
    # The last piece of the candidates is the gap after them; a gap of one word is its first and its last.
    each = each.where(F.col("value").isNotNull()).where(is_span(F.col("kind"), F.col("value")))
    # A candidate overlaps a base span if one that begins before its end reaches over its start.
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    span = F.col("kind") < CANDIDATES
    reach = F.max(F.when(span, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    # Read backwards: a frame that ends where the rows end is summed anew for each row.
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    begins = F.min(F.when(span, F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    seed = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))
    return each.withColumn("seed", seed)


def links(candidates: DataFrame) -> DataFrame:
    """pattern, instance, seed: the edges of the graph, each once."""
    key = F.regexp_extract("value", r"^([^\s=:@0-9]{2,}[=:])\S", 1)
    named = lambda kind, word: F.when(word != "", F.concat(F.lit(kind + "|"), word))
    both = F.when((F.col("before") != "") & (F.col("after") != ""), F.concat_ws(" ", "before", "after"))
    alone = lambda c: F.when(F.col(c) != "<num>", F.col(c))  # noqa: E731  of candidates on both sides nothing is learned
    patterns = F.array(named("key", F.lower(key)), named("before", alone("before")), named("after", alone("after")), named("both", F.when((F.col("before") != "<num>") | (F.col("after") != "<num>"), both)))
    return candidates.select("*", F.explode(F.filter(patterns, lambda x: x.isNotNull())).alias("pattern"))


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, trust: the patterns whose instances are mostly known or believed to be identifiers."""
    edges = staged(edges.groupBy("pattern", F.col("value").alias("instance")).agg(F.max("seed").alias("seed")), "pii-edges")
    # An instance that is a seed anywhere is a seed everywhere.
    # What is joined has been written before, so that Spark can split the rows of a hot instance or pattern.
    belief = staged(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("belief")), "pii-belief")
    patterns = None
    for _ in range(rounds):
        patterns = edges.join(belief, "instance").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("belief").alias("mass"))
        patterns = staged(patterns.withColumn("trust", F.col("mass") / (F.col("n") + 1.0)), "pii-patterns")
        belief = edges.join(patterns, "pattern").groupBy("instance").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(F.max(F.when(F.col("n") >= support, F.col("trust")).otherwise(0.0))).alias("belief"))
        belief = staged(belief, "pii-belief")
    return patterns.where((F.col("n") >= support) & (F.col("trust") >= confidence)).select("pattern", "trust")


def find_personal_data(documents: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row for each document; see the contract of the query. ``n_id`` counts the discovered spans."""
    rows = tagged(documents)
    spans = staged(located(rows), "pii-spans")
    edges = links(spans.where(F.col("kind") == CANDIDATES))
    patterns = trusted_patterns(edges, rounds, support, confidence)
    more = edges.where(~F.col("seed")).join(patterns, "pattern").select("row", "start", "end").distinct().withColumn("kind", F.lit(CANDIDATES))
    found = spans.where(F.col("kind") < CANDIDATES).select("row", "start", "kind", "end").unionByName(more)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    df = rows.select("row", "doc_id").join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    joined = lambda some: F.concat_ws(",", F.transform(some, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda i: F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long")
    return df.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.filter("found", lambda x: x["kind"] < CANDIDATES)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count(CANDIDATES).alias("n_id"),
    )
