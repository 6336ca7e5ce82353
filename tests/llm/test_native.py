"""Fingerprints, licences, personal data and line dedup against brute force."""

import hashlib
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import fingerprints, licenses, linededup, pii

SCHEMA = "doc_id long, text string, key string"  # key: a column whose name clashes with those used inside
TEXTS = ["", None, "a", "Hello world.\n\nSecond line é😀", "x " * 3000, "Hello world.\n\nSecond line é😀", "émile", "\n\n\n"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], SCHEMA)


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(got, reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = TEXTS[a] or "", TEXTS[b] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
        assert (got[a].fingerprint == got[a].edited_fingerprint) == (t == edited)
    assert got[3].fingerprint == got[5].fingerprint and got[0].fingerprint == got[1].fingerprint != got[2].fingerprint
    assert got[4].near_edited > 0.5


def test_fingerprints_of_one_and_none(spark, docs):
    assert fingerprints.fingerprints(docs.where("doc_id = 2")).first().near_next == 1.0
    assert fingerprints.fingerprints(docs.where("false")).count() == 0


def test_fingerprints_without_ids_and_with_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c d"), (1, "e f"), (1, "e f")], "doc_id long, text string")
    assert fingerprints.fingerprints(df).count() == 4


def brute_likeness(x, y):
    if x == y:
        return 1.0
    a, b = ([p[i : i + 4] for p in f.split(":")[2].split("/") for i in range(0, len(p), 4)] for f in (x, y))
    if not a and not b:
        return 0.0
    return max(2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))), 2 * sum(p == q for p, q in zip(a, b)) / (len(a) + len(b)))


def test_likeness_is_of_the_fingerprints_returned(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["long line " * 20_000, "x" * 7]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    order = sorted(got, reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        assert got[a].near_edited == pytest.approx(brute_likeness(got[a].fingerprint, got[a].edited_fingerprint))
        assert got[a].near_next == pytest.approx(brute_likeness(got[a].fingerprint, got[b].fingerprint))
        root, sections, leaves = got[a].fingerprint.split(":")
        paragraphs = texts[a].split("\n")
        assert len(root) == 64 and len(sections.split(".")) == -(-len(paragraphs) // 8) and [len(p) for p in leaves.split("/")] == [4 * -(-len(p) // 8) for p in paragraphs]


def test_next_of_hot_and_missing_ids(spark):
    rows = [(None, f"n{i}") for i in range(300)] + [(5, f"t{i}") for i in range(400)] + [(i, f"x{i}") for i in range(100)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    follows = {r.text: r.next_text for r in got}
    assert len(got) == 800 and sorted(follows.values()) == sorted(t for _, t in rows)  # one ring
    ids, at, seen = dict((t, i) for i, t in rows), "x99", []
    for _ in rows:
        seen.append(ids[at])
        at = follows[at]
    assert seen == sorted([i for i, _ in rows if i is not None], reverse=True) + [None] * 300 and at == "x99"


def test_edits_are_located(spark):
    lines = [f"line {i}" for i in range(40)]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(lines[:20] + ["changed"] + lines[21:]))], "a string, b string")
    df = fingerprints.add_tree(fingerprints.add_tree(df, "a", "a_"), "b", "b_")
    assert df.select(fingerprints.differing_sections(F.col("a_fingerprint"), F.col("b_fingerprint"))).first()[0] == [2]


def test_licenses(spark):
    mit = licenses.KNOWN[4][2]
    rows = [(1, mit.upper().replace(",", " ;")), (2, "Copyright (c) 2020 Someone\n" + mit), (3, "words\nReleased under the MIT Licence!\nmore"), (4, None), (5, "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 6)] == ["MIT", "MIT", None, None, None]
    assert got[3].notices == "MIT" and got[3].n_notices == 1 and got[4].digest == got[5].digest
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_usual_licenses_and_notices(spark):
    texts = {p.stem: p.read_text("utf-8") for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(texts)
    mit = licenses.KNOWN[4][2].removeprefix("MIT License ").replace(". ", ".\n\n").replace("The above ", "The above\n")
    rows = [*texts.items(), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + texts["BSD-3-Clause"])]
    rows += [("MIT", f"MIT License\n\n{c}\n\n{mit}") for c in ("Copyright Jane Doe", "Copyright (c) <year> <holder>", "Copyright (c) Jane Doe", "Copyright [year] [fullname]")] + [("MIT", mit)]
    # A line of the text that begins with the word is no copyright line.
    rows += [("MIT", "MIT License\n\n" + mit.replace("The above\ncopyright", "The above \ncopyright")), (None, texts["BSD-2-Clause"] + "more")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(rows))] == [x for x, _ in rows]
    notices = [("GPL-3.0-only", "This software is released under the GNU General Public License v3.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("MPL-2.0", "Licensed under the MPL 2.0"), ("", "Licensed under nothing.")]
    got = licenses.scan_licenses(spark.createDataFrame([(i, f"words\n{t}\nmore") for i, (_, t) in enumerate(notices)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.notices for r in got] == [x for x, _ in notices]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(v) <= 255 for v in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            s = re.sub("[^0-9]", "", m.group())
            if low <= len(s) <= high and (kind == 3 or luhn(s)):
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark):
    rng = random.Random(1)
    parts = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5", "300.1.1.1", "001.2.3.255", "4539 1488 0343 6467", "4539-1488-0343-6467 1", "4539148803436467", "+1 (988) 555-2485", "+12", "é😀", "7  8", "word", "@", "..", "1-", "", "56", "+4 4.5-6(7)8 9 0 1"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "-", "."]) for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["", None, "9" * 3000, "1 " * 3000, "a." * 2000 + "@b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == (want.count(",") + 1 if want else 0)


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"please contact: user{i}@mail.org today") for i in range(8)]
    df = spark.createDataFrame([*seeds, (100, "please contact: KX-4471 today"), (101, "some 42 thing"), (102, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[100].n_id == 1 and got[100].spans == "id:16:23" and got[101].n_id == 0 and got[0].n_id == 0
    assert pii.find_personal_data(df.where("false")).count() == 0


def test_many_candidates_in_one_text(spark):
    text = " ".join(f"word user{i}@mail.org then x{i}" for i in range(10_000))
    start = time.time()
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame([(1, text), (2, "a " * 200_000 + "7" + " " * 100_000 + "b"), (3, None)], "doc_id long, text string")).collect()}
    assert got[1].n_email == 10_000 and got[1].base_sha256 == hashlib.sha256(base(text).encode()).hexdigest() and got[2].spans == got[3].spans == ""
    assert time.time() - start < 120


def test_candidates_are_each_others_context(spark):
    rows = [(i, f"badge KX-{i}1 KX-{i}2 KX-{i}3 end") for i in range(8)] + [(i, f"badge u{i}@mail.org v{i}@mail.org w{i}@mail.org end") for i in range(10, 18)]
    rows = rows[:1] + rows[8:]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")).collect()}
    assert got[0].spans == "id:6:11,id:18:23"  # the middle one has candidates on both sides, of which nothing is learned


def test_long_context_words(spark):
    word = "w" * 500
    rows = [(i, f"{word}   {' ' * 200} u{i}@mail.org end{i}") for i in range(8)] + [(9, f"{word} KX-1 z")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9].n_id == 1


def brute_lines(rows, least):
    docs = sorted({(i, t) for i, t in rows})
    seqs = [[x for x in t.split("\n") if x.strip()] for _, t in docs]
    count = lambda x: len(x.split())
    out = {}
    for d, seq in enumerate(seqs):
        gone = set()
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if sum(map(count, seq[a:b])) >= least and any(seqs[e][s : s + b - a] == seq[a:b] for e in range(d + 1) for s in range(len(seqs[e]) - (b - a) + 1) if (e, s) < (d, a)):
                    gone |= set(range(a, b))
        left, n = [], -1
        for x in docs[d][1].split("\n"):
            n += bool(x.strip())
            if not (x.strip() and n in gone):
                left.append(x)
        if not gone or "\n".join(left).strip():
            out[docs[d][0]] = "\n".join(left)
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = ["a b", "c", "d\te\tf", "g h i j", "", "  k ", "\t"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 2, 5, 9])))) for k in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + [rows[4]] * 3], "doc_id long, text string, places string, n_chars long")
    out = linededup.dedup_lines(df, 5)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows, 5)


def test_maximal_runs(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 8, 20])))) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    number = {r._key: r.doc_id for r in linededup.keyed(df).collect()}
    seqs = [t.split("\n") for _, t in rows]
    match = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    least = 32  # every run of up to 32 lines in full
    got = {(number[r._key], r.pos): (r.lines, r.words) for r in linededup.repeated_runs(df, 1).collect()}
    assert got and all(x == (min(y := max([match(seqs[d][p:], seqs[e][q:]) for e in range(d + 1) for q in range(len(seqs[e])) if (e, q) < (d, p)], default=0), x[0] or y), x[1]) for (d, p), x in got.items())
    df = df.withColumn("text", F.concat(F.lit(f"{'w ' * least}\n"), "text", F.lit(f"\n{'w ' * least}")))
    number = {r._key: r.doc_id for r in linededup.keyed(df).collect()}
    seqs = [[f"{'w ' * least}", *s, f"{'w ' * least}"] for s in seqs]
    got = {(number[r._key], r.pos): r.lines for r in linededup.repeated_runs(df, least).collect()}
    for d, s in enumerate(seqs):
        for p in range(len(s)):
            want = max([match(s[p:], seqs[e][q:]) for e in range(d + 1) for q in range(len(seqs[e])) if (e, q) < (d, p)], default=0)
            assert got.get((d, p), 0) == want


def test_line_dedup_of_one_hot_line_and_a_long_text(spark):
    rows = [(i, "\n".join(["same"] * 3 + [f"own {i}"])) for i in range(300)] + [(1000, "\n".join(f"line {i}" for i in range(20_000))), (1001, "\n".join(f"line {i}" for i in range(20_000)))]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert got[0] == rows[0][1] and got[7] == "own 7" and 1001 not in got and got[1000] == rows[300][1]


def test_line_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in linededup.dedup_lines(df, 2).collect()} == {(None, "a b c"), (2, None), (3, "")}
    assert linededup.dedup_lines(df.where("false")).count() == 0
