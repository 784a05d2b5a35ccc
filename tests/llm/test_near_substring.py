import itertools
import random

import numpy as np
import pytest

from tidemill.llm import near_dedup, substring_dedup
from tidemill.llm.common import Scratch, components


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus(words):
    g, texts = random.Random(5), []
    for k in range(40):
        w = words(g.randint(5, 160), k)
        for _ in range(g.choice([1, 1, 2, 5])):
            v = list(w)
            for _ in range(g.randint(0, max(1, len(v) // 40))):
                v[g.randrange(len(v))] = "edit" + str(g.randint(0, 9))
            texts.append(" ".join(v))
    return texts + texts[:4] + ["one two", "one two", "ONE two", "lone"]


def test_classes_equal_brute_force(spark, docs_of, words):
    texts = corpus(words)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(len(texts), links)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = near_dedup.keep_one(docs_of(list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and "comp" in kept.columns


def test_near_edges(spark, docs_of, words):
    text = " ".join(words(30))
    rows = [(1, None), (2, ""), (3, " \n"), (None, text), (4, text), (4, text), (5, " ".join(words(25000, 9)))]
    out = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs_of(rows)).collect()), key=str)
    assert out == sorted([(1, 1, 1), (2, 2, 1), (3, 3, 1), (None, 4, 3), (4, 4, 3), (4, 4, 3), (5, 5, 1)], key=str)
    assert sorted(str(r.doc_id) for r in near_dedup.keep_one(docs_of(rows)).collect()) == ["1", "2", "3", "4", "5"]
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_sketch_estimates_probability_jaccard(words):
    g = np.random.default_rng(1)
    items = np.unique(g.integers(1, 2**62, 300).astype(np.uint64))
    a, b = items[:220], items[60:]
    wa, wb = 1 + g.random(len(a)), 1 + g.random(len(b))
    signatures = near_dedup.sketch([(a, wa), (b, wb)], 4096)
    exact = sum(1 / sum(max(dict(zip(a, wa)).get(j, 0) / x, dict(zip(b, wb)).get(j, 0) / y) for j in set(a) | set(b)) for i, x in zip(a, wa) for k, y in zip(b, wb) if i == k)
    assert abs((signatures[0] == signatures[1]).mean() - exact) < 0.03
    assert abs(near_dedup.similarity(a, b) - len(set(a) & set(b)) / len(set(a) | set(b))) < 1e-9


def test_components_of_chains_and_hubs(spark):
    g = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(g.randint(2000, 2300), g.randint(2000, 2300)) for _ in range(150)]
    got = {r.node: r.comp for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(2301, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def similar_windows(a, b, t=46):
    """For two lists of distinct shingles: starts in a of windows of t that have 41 shingles in common with some window of b."""
    if len(a) < t or len(b) < t:
        return set()
    m = np.array([[x == y for y in b] for x in a]).astype(int)
    within = np.lib.stride_tricks.sliding_window_view
    common = within(within(m, t, 1).max(-1), t, 0).sum(-1)
    return {int(i) for i in np.flatnonzero((common >= 41).any(1))}


def passage_corpus(words, g):
    """Texts that share passages of 30 to 90 words, some with edits, and lines of 26 to 44 words that many texts hold."""
    shared = [words(g.randint(30, 90), 900 + k) for k in range(36)]
    lines = [words(n, 950 + n) for n in (26, 34, 40, 44)]
    texts = []
    for k in range(70):
        parts = [words(g.randint(5, 40), 10_000 + k)]
        for p in g.sample(shared, g.choice([0, 1, 1, 1, 2])):
            p, lo = list(p), g.choice([0, 0, 8])
            for _ in range(g.choice([0, 0, 1, 1, 2])):
                at = g.randrange(len(p))
                p[at : at + g.choice([0, 1, 1, 2])] = ["edit" + str(g.randint(0, 99))] * g.choice([0, 1, 1])
            parts += [p[lo:], words(g.randint(0, 30), 20_000 + k)]
        if g.random() < 0.5:
            parts += [g.choice(lines), words(g.randint(0, 20), 30_000 + k)]
        texts.append(" ".join(w for p in parts for w in p))
    return texts + texts[:3] + [" ".join(lines[2] + ["the"] + words(40, 77 + k)) for k in range(3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, docs_of, words, seed):
    texts = passage_corpus(words, random.Random(seed))
    rows = [[" ".join(w[i : i + 5]) for i in range(len(w) - 4)] for w in (t.split() for t in texts)]
    found = {(i, j): similar_windows(rows[i], rows[j]) for i, j in itertools.permutations(range(len(texts)), 2) if texts[i] != texts[j] and len(set(rows[i]) & set(rows[j])) >= 41}
    copies = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] == texts[j] and len(rows[i]) >= 46]
    want = roots(len(texts), [p for p, at in found.items() if at] + copies)
    out = {r.doc_id: r for r in substring_dedup.repeated_passages(docs_of(list(enumerate(texts)))).collect()}
    assert [out[i].class_id for i in range(len(texts))] == want
    sizes = [want.count(c) for c in want]
    assert len({c for c, n in zip(want, sizes) if n > 1}) > 4 and [out[i].class_size for i in range(len(texts))] == sizes
    for i in range(len(texts)):
        copied = any(i in c for c in copies)
        windows = set().union(*(at for (a, _), at in found.items() if a == i)) | (set(range(len(rows[i]) - 45)) if copied else set())
        most = {p + k for w in windows for k in range(50) for p in [w]}
        assert (out[i].n_dup_words > 0) == bool(windows) and out[i].n_dup_words <= len(most)
        mine = {p for x in out[i].passages or [] for p in range(x.s, x.e + 1)}
        assert len(mine) == out[i].n_dup_words and mine <= most
        assert mine >= exact_words(texts, i)
        # of edited windows, what is missing lies at the ends of a passage: broken shingles, or less than a run beyond a representative
        assert len(most - mine) <= 2 * 20 * max(1, out[i].n_passages)


def exact_words(texts, i, size=50):
    """The words of text i in windows that another text holds as they are, or all if it has a copy."""
    windows = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    others = {w for t in set(texts) - {texts[i]} for w in windows(t.split())}
    mine = texts[i].split()
    if len(mine) >= size and texts.count(texts[i]) > 1:
        return set(range(len(mine)))
    return {k + j for k, w in enumerate(windows(mine)) if w in others for j in range(size)}


def test_no_exact_repeat_is_missed(spark, docs_of, words):
    g = random.Random(5)
    phrase, longer = words(7, 600), words(700, 601)
    # texts that repeat a word or a phrase for long, also beyond a segment, and stretches of one class that meet in other pairs
    texts = [" ".join(words(30, k) + ["no"] * n + words(20, 40 + k)) for k, n in enumerate((48, 50, 60, 700, 1300))]
    texts += [" ".join(words(10, 80 + k) + phrase * n + words(15, 90 + k)) for k, n in enumerate((7, 8, 20, 200))]
    for k in range(24):
        a, b = sorted(g.sample(range(700), 2))
        texts.append(" ".join(words(g.randint(0, 60), 100 + k) + longer[a:b] + ["no"] * g.choice([0, 55, 90]) + longer[b : b + g.randint(40, 70)]))
    out = {r.doc_id: r for r in substring_dedup.repeated_passages(docs_of(list(enumerate(texts)))).collect()}
    found = {i: {p for x in out[i].passages or [] for p in range(x.s, x.e + 1)} for i in out}
    for i in out:
        want = exact_words(texts, i)
        assert found[i] >= want, (i, sorted(want - found[i])[:9])
    assert not found[0] - set(range(25, 83)) and len(found[4]) >= 1300 and len(found[8]) >= 1400


def test_anchored_items_hold_each_window_once():
    g = np.random.default_rng(4)
    doc = np.repeat([0, 1, 2, 3], [150, 30, 46, 400])
    for most in (2, 30, 2**62):
        x = g.integers(0, most, len(doc)).astype(np.uint64)
        x[300:500] = x[60:260] if most == 2 else x[0:200]
        d, key, content, c, lo, hi = substring_dedup.anchored(x, doc)
        assert (np.diff(d) >= 0).all() and (doc[c] == d).all() and (np.abs(np.concatenate([lo - c, hi - c])) < 128).all()
        got = sorted(s for a, b in zip(lo, hi) for s in range(a, b + 1))
        assert got == [s for s in range(len(x) - 45) if doc[s] == doc[s + 45]]
        keys, of = {}, {}
        for k, h, a, b in zip(key, content, lo, hi):
            of.setdefault(h, set()).add(x[a : b + 46].tobytes())
            for s in range(a, b + 1):
                keys.setdefault(x[s : s + 46].tobytes(), set()).add(k)
        # equal windows have one key; equal hashes are equal contents
        assert all(len(v) == 1 for v in keys.values()) and all(len(v) == 1 for v in of.values())


def test_labels_are_extended_as_if_made_anew(spark, docs_of):
    from tidemill.llm.common import Scratch, components, extended

    g, s = random.Random(9), Scratch(spark)
    edges = [(g.randrange(60), g.randrange(60)) for _ in range(45)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {tuple(r) for r in components(s, table(edges)).collect()}
    for cut in (0, 20, 45):
        assert {tuple(r) for r in extended(s, components(s, table(edges[:cut])), table(edges[cut:])).collect()} == want


def test_passage_edges(spark, docs_of, words):
    shared, other = words(70, 900), words(120, 901)
    texts = [" ".join(words(80, k) + shared + words(30, 50 + k)) for k in range(6)]
    texts += [" ".join(words(40, 70) + other), " ".join(other + words(200, 71)), " ".join(words(300, 72)), " ".join(words(20, 73)), " ".join(words(20, 73)), None, ""]
    edited = list(shared)
    edited[35] = "changed"
    texts.append(" ".join(words(60, 74) + edited + words(60, 75)))
    long = words(30_000, 80)
    texts += [" ".join(long + other + words(20_000, 81)), " ".join(words(700, 82) + long[20_000:20_060])]
    out = {r.doc_id: r for r in substring_dedup.repeated_passages(docs_of(list(enumerate(texts)))).collect()}
    assert [out[i].class_id for i in range(16)] == [0, 0, 0, 0, 0, 0, 6, 6, 8, 9, 10, 11, 12, 0, 6, 6]
    for i in range(6):
        assert [(p.s, p.e) for p in out[i].passages] == [(80, 149)] and out[i].n_dup_words == 70
    assert out[6].n_dup_words == out[7].n_dup_words == 120 and out[8].n_dup_words == 0 and out[9].n_passages == 0
    assert [(p.s, p.e) for p in out[14].passages] == [(20_000, 20_059), (30_000, 30_119)]
    assert out[13].n_dup_words >= 65
    nulls = docs_of([(None, texts[0]), (None, texts[1]), (3, None), (None, None)])
    assert sorted((str(r.doc_id), str(r.class_id), r.n_dup_words) for r in substring_dedup.repeated_passages(nulls).collect()) == [("3", "3", 0), ("None", "None", 0), ("None", "None", 70), ("None", "None", 70)]
    assert substring_dedup.repeated_passages(docs_of([])).count() == 0


def test_cells_are_the_signatures_of_all_runs():
    g = np.random.default_rng(3)
    for most in (40, 2**62):
        x = g.integers(0, most, 500).astype(np.uint64)
        for t in (1, 2, 7, 21):
            assert (substring_dedup.sliding(x, t) == [x[i : i + t].min() for i in range(len(x) - t + 1)]).all()
            first, anchor = substring_dedup.compact_windows(x, t)
            least = [i + int(np.argmin(x[i : i + t])) for i in range(len(x) - t + 1)]
            assert (anchor[np.searchsorted(first, np.arange(len(least)), "right") - 1] == least).all() and (np.diff(anchor) > 0).all()
    doc = np.repeat([0, 1, 2, 3], [100, 10, 21, 369])
    d, key, a = substring_dedup.cells(x, doc)
    assert set(d) == {0, 2, 3} and (doc[a] == d).all() and (d == 2).sum() == 1
    for k in (0, 2, 3):
        # a document alone has the same cells
        alone = substring_dedup.cells(x[doc == k], np.zeros((doc == k).sum(), int))
        assert (alone[1] == key[d == k]).all() and (alone[2] + np.flatnonzero(doc == k)[0] == a[d == k]).all()


def test_repeated_rows_are_copies(spark, docs_of, words):
    t = " ".join(words(60))
    out = substring_dedup.repeated_passages(docs_of([(1, t), (1, t), (None, t), (2, " ".join(words(60, 8)))])).collect()
    assert sorted((str(r.doc_id), r.class_id, r.class_size, r.n_dup_words) for r in out) == [("1", 1, 3, 60), ("1", 1, 3, 60), ("2", 2, 1, 0), ("None", 1, 3, 60)]


def test_every_edited_passage_has_a_common_signature():
    g = np.random.default_rng(8)
    for size, edit in [(50, 25)] * 1500 + [(50, k) for k in range(5, 45)] * 5 + [(52, 26)] * 300:
        passage = g.integers(1, 2**62, size).astype(np.uint64)
        other = passage.copy()
        other[edit] = 7
        rows = [substring_dedup.shingles(np.concatenate([g.integers(1, 2**62, 60).astype(np.uint64), p, g.integers(1, 2**62, 60).astype(np.uint64)])) for p in (passage, other)]
        keys = [set(substring_dedup.cells(r, np.zeros(len(r), int))[1]) for r in rows]
        assert keys[0] & keys[1], (size, edit)


def test_short_edited_passages_are_linked(spark, docs_of, words):
    texts = []
    for k in range(60):
        passage = words(50, 2000 + k)
        edited = list(passage)
        edited[25] = "changed"
        texts += [" ".join(words(70, 3000 + 2 * k + i) + p + words(40, 4000 + 2 * k + i)) for i, p in enumerate((passage, edited))]
    out = {r.doc_id: r for r in substring_dedup.repeated_passages(docs_of(list(enumerate(texts)))).collect()}
    assert [out[i].class_id for i in range(120)] == [i - i % 2 for i in range(120)]
    assert all(out[i].class_size == 2 and out[i].n_dup_words >= 45 for i in range(120))


def test_hashes_by_columns_are_those_of_single_words():
    from tidemill.llm.shingles import WordHashes, shingles, shingles_of, word_hashes

    g, one = random.Random(3), WordHashes()
    texts = ["".join(g.choice("abQZé中ж \n\t\x0b") for _ in range(g.randint(0, 400))) for _ in range(200)]
    texts += [None, "", "  ", *("x" * n + " Y" for n in range(40))]
    hashes, at = word_hashes(texts, WordHashes())
    want = [one.of(t) for t in texts]
    assert (hashes == np.concatenate(want)).all() and (np.diff(at) == [len(w) for w in want]).all()
    x, at = shingles_of(hashes, at, 20)
    want = [shingles(w) if len(w) >= 20 else w[:0] for w in want]
    assert (x == np.concatenate(want)).all() and (np.diff(at) == [len(w) for w in want]).all()
    assert [len(v) for v in word_hashes([], one)] == [0, 1]


def test_repeated_items_are_those_of_a_join(spark):
    g = random.Random(4)
    rows = []
    for i in range(90):
        # key 7 in all texts; a copied text's own key repeats in one node only
        keys = [[7, 1000 + i // 2, *(g.randrange(-(2**62), 2**62) if g.random() < 0.5 else g.randrange(40) for _ in range(g.randint(0, 9)))] for _ in "be"]
        rows.append((i // 9, i // 2, keys[0], [j + 1 for j in range(len(keys[0]))], keys[1], [k ^ 1 for k in keys[1]], [j + 2 for j in range(len(keys[1]))], *[[k] * len(keys[1]) for k in (-3, 4)]))
        if i % 2:
            rows[-1] = (i // 9, *rows[-2][1:])
    made = spark.createDataFrame(rows, "batch long, node long, bkeys array<long>, anchors array<int>, ekeys array<long>, contents array<long>, places array<int>, los array<tinyint>, his array<tinyint>")
    nodes = {}
    for _, node, b, _, e, *_ in rows:
        for kind, keys in ((False, b), (True, e)):
            for k in keys:
                nodes.setdefault((kind, k), set()).add(node)
    want = {(False, k, r[1], c, 0, 0, 0) for r in rows for k, c in zip(r[2], r[3]) if len(nodes[False, k]) > 1}
    want |= {(True, k, r[1], c, h, -3, 4) for r in rows for k, h, c in zip(r[4], r[5], r[6]) if len(nodes[True, k]) > 1}
    assert {tuple(r) for r in substring_dedup.repeated(made).collect()} == want
    # a key of all texts is one entry a batch, and one number a batch on its way back
    packs = [p for f in substring_dedup.key_packs(3)(iter([made.toPandas()])) for p in f.to_dict("records")]
    assert sum((p["keys"] == 7).sum() for p in packs) == 2 * len({r[0] for r in rows})


def test_shuffle_files_go_with_each_table(spark, docs_of, words):
    import glob

    held = lambda: set(glob.glob("/tmp/blockmgr-*/*/shuffle_*.data"))
    before, name = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(name, None)
    texts = passage_corpus(words, random.Random(3))
    out = substring_dedup.repeated_passages(docs_of(list(enumerate(texts))))
    assert len(held() - before) < 60 and spark.conf.get(name, None) == set_before
    assert out.count() == len(texts)
