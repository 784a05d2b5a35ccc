import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from tidemill.llm import decontaminate, license_scan, line_dedup


def terms(t):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t) if x]


def test_decontaminate_equals_brute_force(spark, docs_of, words):
    items = [(k, " ".join(words(n, k))) for k, n in enumerate([3, 9, 10, 11, 30, 1])] + [(7, None), (8, " . "), (4, " ".join(words(30, 4))), (None, " ".join(words(12, 99)))]
    g = random.Random(1)
    rows = []
    for i in range(60):
        w = words(50, 100 + i)
        if i % 2:
            at, w2 = g.randrange(40), terms(items[g.randrange(6)][1])
            w[at:at] = w2[: max(1, len(w2) - i % 3)]
        rows.append((i, "! ".join(w).title()))
    rows += [(None, None), (61, ""), (2, "Ünïcode " + items[2][1].upper()), (62, items[9][1]), (62, items[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs_of(rows), bench).collect()), key=str)
    want = []
    for i, t in rows:
        w, hit, ids = terms(t), set(), set()
        for k, text in items:
            v = terms(text)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids |= {str(k)} if k is not None else set()
        want.append((i, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    assert got == sorted(want, key=str)
    clean = decontaminate.drop_contaminated(docs_of(rows), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(x[0]) for x in want if not x[-1]) and clean.columns == docs_of(rows).columns
    # beyond the bound the same join shuffles
    assert decontaminate.decontaminate(docs_of(rows), bench, broadcast_rows=0).where("contaminated").count() == sum(x[-1] for x in want)


def test_decontaminate_empty(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of([]), bench).count() == 0
    assert decontaminate.decontaminate(docs_of([(1, "a b")]), bench).first().n_words == 2


@pytest.mark.parametrize(
    ("text", "base", "labels", "first", "last"),
    [
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("The MIT-License, mit license and the MIT  LICENSE", "mit", "mit", 1, 7),
        ("Licensed under the Apache License, Version 2.0.", "apache", "apache", 3, 3),
        ("Licensed undr the Apach License, Version 2.0.", "", "apache", None, None),
        ("permision is hereby granted, free of charge, to any persn obtaining a copy", "", "mit", None, None),
        ("limit license", "", "", None, None),
        ("Licensed under CC BY-NC 4.0. x", "", "cc-by-nc", None, None),
        ("GNU General Public Licenses and a general public license", "gpl", "gpl", 6, 6),
    ],
)
def test_license(spark, docs_of, text, base, labels, first, last):
    r = license_scan.license_scan(docs_of([(1, text)])).first()
    assert (r.base_labels, r.labels, r.first_word, r.last_word) == (base, labels, first, last)
    assert 0 <= r.score <= 1 and (r.score == 1 if base else True) and r.n_words == len(terms(text))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(g, notice, k):
    t = list(notice)
    for _ in range(g.randint(0, k)):
        at = g.randrange(len(t))
        t[at : at + g.randint(0, 1)] = g.choice(["", "q", "z"])
    return " ".join("".join(t).split())


def test_license_finds_all_edits_within_the_bound():
    """Pigeonhole: every notice with up to k random edits is found, with no more errors than were made."""
    g = random.Random(4)
    for label, notices in license_scan.NOTICES.items():
        for notice in notices:
            search, k = license_scan.NoticeSearch({label: [notice]}), len(notice) // 12
            for _ in range(20):
                t = edited(g, notice, k)
                made = edits(notice, t)
                found = search.spans("some words before " + t + " and after")
                assert made > k or min(s[3] for s in found) <= made
    assert license_scan.places("mit license mit license", "mit license") == [0, 2]


def test_license_spans_equal_brute_force():
    """Spans are whole words at the stated number of edits, and no stretch of words within k edits is without one."""
    g, notice = random.Random(8), "all rights reserved now"
    search, k = license_scan.NoticeSearch({"x": [notice]}), len(notice) // 12
    for _ in range(150):
        words = [w for _ in range(4) for w in g.choice([edited(g, notice, 3).split(), ["rights", "reserved"], ["all", "now"], ["a"], ["small"]])]
        spans = search.spans(" ".join(words))
        for _, a, b, e, text in spans:
            assert text == " ".join(words[a : b + 1]) and edits(notice, text) == e <= k
        true = [(a, b) for a in range(len(words)) for b in range(a, min(a + 8, len(words))) if edits(notice, " ".join(words[a : b + 1])) <= k]
        assert all(any(s[1] <= b and a <= s[2] for s in spans) for a, b in true)


def test_license_matches_whole_words_and_both_of_two_neighbours():
    search = license_scan.NoticeSearch(license_scan.NOTICES)
    assert search.spans("small rights reserved") == search.spans("xall rights reservedy") == []
    both = search.spans("all rights resrved all rights reserved")
    assert [s[1:4] for s in both] == [(0, 2, 1), (3, 5, 0)]


def test_license_edges(spark, docs_of, words):
    """Common seeds and very long texts are searched in bounded stretches; null ids, repeated rows and empty tables have results."""
    long = " ".join(words(60000, 2)) + " all rights reserved " + "hereby granted " * 4000 + "all rights resrved " * 500
    rows = [(None, "mit license"), (1, "mit license"), (1, "mit license"), (2, long), (3, "x" * 300000)]
    out = license_scan.license_scan(docs_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.labels, r.n_base) for r in out) == [(0, "mit", 1), (1, "mit", 1), (1, "mit", 1), (2, "all-rights-reserved", 0), (3, "", 0)]
    assert [len(r.spans) for r in out if r.doc_id == 2] == [501]
    assert license_scan.license_scan(docs_of([])).count() == 0


def test_license_base_columns_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for r in docs.collect():
        w, x = terms(r.text), got[r.doc_id]
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts, labels = [i for i, _ in at], {label for _, label in at}
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(x.labels.split(","))


def py_chunks(text):
    lines = text.split("\n")
    h, out, start = [hashlib.md5(x.encode()).hexdigest() for x in lines], [], 0
    mark = end = -1
    for i in range(len(lines)):
        is_mark = i > 0 and int(hashlib.md5((h[i - 1] + h[i]).encode()).hexdigest()[24:], 16) % 2 == 0
        taken = is_mark and (i - mark >= 2 or i - end >= 2) and i < len(lines) - 2
        mark, end = i if is_mark else mark, i if taken else end
        if taken or i == len(lines) - 1:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def test_line_dedup_equals_brute_force(spark, docs_of, words):
    g = random.Random(3)
    block = [" ".join(words(6, k)) for k in range(30)]
    rows = []
    for i in range(40):
        own = [" ".join(words(5, 500 + 20 * i + k)) for k in range(6)]
        a = g.randrange(20)
        rows.append((i, "\n".join(own[:3] + block[a : a + 10] + own[3:])))
    rows += [(None, rows[3][1]), (50, None), (51, ""), (52, "\n\n"), (53, rows[0][1]), (54, "é\n" * 3)]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    seen, want = set(), {}
    for r in sorted(rows, key=key):
        if r[1] is None:
            want[r[0]] = None
            continue
        keep = []
        for _, lines in py_chunks(r[1]):
            body = "\n".join(lines)
            if len(lines) >= 2 and len(body) >= 40:
                if body in seen:
                    continue
                seen.add(body)
            keep.append(body)
        want[r[0]] = "\n".join(keep)
    out = line_dedup.line_dedup(docs_of(rows))
    assert {r.doc_id: r.text for r in out.collect()} == want
    left = line_dedup.without_repeated_lines(docs_of(rows))
    assert left.columns == docs_of(rows).columns and {r.doc_id for r in left.collect()} == {k for k, t in want.items() if t is None or t.strip() or k in (51, 52)}
    assert line_dedup.line_dedup(docs_of([])).count() == 0


def test_repeated_runs_and_copies_go_but_for_their_unaligned_ends(spark, docs_of, words):
    line = lambda k: " ".join(words(9, k))
    block = [line(k) for k in range(60)]
    rows = [(i, "\n".join([line(1000 + 90 * i + k) for k in range(7 + i)] + block + [line(1050 + 90 * i + k) for k in range(5)])) for i in range(8)]
    copies = [(20 + i, "\n".join(line(5000 + 40 * i + k) for k in range(2 + i))) for i in range(12)]
    rows += copies + [(40 + i, t) for i, (_, t) in enumerate(copies)]
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(docs_of(rows)).collect()}
    assert all(out[40 + i] == [""] and "\n".join(out[20 + i]) == t for i, (_, t) in enumerate(copies))
    texts = dict(rows)
    assert "\n".join(out[0]) == texts[0]
    for i in range(1, 8):
        left = [k for k in range(60) if block[k] in out[i]]
        assert left == [k for k in left if k < 15 or k >= 45] and len(left) < 20  # what is left is at the ends
        assert [x for x in out[i] if x not in block] == [x for x in texts[i].split("\n") if x not in block]
    assert line_dedup.without_repeated_lines(docs_of(copies + [(60, copies[5][1])])).where("doc_id = 60").count() == 0
    for rule in (1, 2, 3):
        sizes = [[c.n for c in r.c] for r in docs_of(rows).select(line_dedup.chunks(F.col("text"), least=rule).alias("c")).collect()]
        assert [sum(x) for x in sizes] == [t.count("\n") + 1 for _, t in rows]
        assert all(len(x) == 1 or min(x) >= rule for x in sizes)
