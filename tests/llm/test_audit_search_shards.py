import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tidemill.llm import filter_audit, lexical_search, sharding

LABELS = "doc_id long, quality int, toxic int, part string, mask int, _d long"


def audited(rows, labels):
    """Filters applied one after the other to each part, in every order."""
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))

    def fails(name, d, t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        if name == "A":
            return len(w) < 50
        if name == "B":
            return 100 * len(set(w)) < 65 * len(w)
        if name == "C":
            return 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)
        return bool(re.search("[#$%&*|]", t)) if name == "D" else d is not None and d > least[t]

    facts = [(r[3] or "", r[0], {x for x in "ABCDE" if fails(x, r[0], r[1] or "")}) for r in rows]
    out, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = list(mine)
            for k, x in enumerate(order):
                gone = [f for f in alive if x in f[2]]
                alive = [f for f in alive if x not in f[2]]
                failing = [f for f in mine if x in f[2]]
                out[part, order, k + 1] = [len(alive), len(gone), len(failing) - len(gone), sum(f[2] == {x} for f in mine), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)]
                shapley[part, x] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_filtering_step_by_step(spark, docs_of, words):
    long_ = " ".join(words(20000, 5))
    texts = [None, "", "short", " ".join(words(60, 1)), " ".join(words(60, 1)), " ".join(words(60, 1)).upper(), " ".join(words(8, 2) * 9), " ".join(words(70, 3)) + " #", long_, "A" * 40 + " | " + " ".join(words(5, 4) * 20), "é é " * 60]
    rows = [(i, texts[i % len(texts)], "en", [None, "", "a", "b", "b"][i % 5]) for i in range(60)]
    rows += [(3, texts[3], "en", "b"), (3, texts[3], "en", "b"), (None, texts[3], "en", "a"), (None, "short", "en", "a"), (2, texts[5], "en", "a")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 60, 3)] + [(3, 0, None), (9, None, 1), (None, 1, 1), (500, 1, 1)]
    table = spark.createDataFrame([(*x, "p", 1, 9) for x in labels], LABELS)
    got = filter_audit.filter_audit(docs_of(rows), table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audited(rows, labels)


def test_audit_of_nothing_and_without_labels(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs_of([]), none).count() == 0
    got = filter_audit.filter_audit(docs_of([(1, None, "en", None)]), none)
    assert got.count() == 600 and {r.part for r in got.collect()} == {""}


def ranked(rows, items, k):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(d, Counter(cut(t)), len(cut(t))) for d, t, *_ in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(cut(t))
    out = set()
    for i, names in asked.items():
        scores = []
        for d, c, n in docs:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * (50 + 50 * n * n_docs // n_terms))) for w in names if w in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        for r, (s, known, d) in enumerate(sorted(scores)[:k], 1):
            out.add((i, r, d if known else None, -s))
    return out


ITEMS = "item_id long, text string, term string, w long, bucket int"


@pytest.mark.parametrize("most", [None, 0])
def test_search_equals_brute_force(spark, docs_of, words, most):
    pool = words(60, 7) + ["été", "Ünder", "naïve", "x1", "42"]
    rows = [(i, " ".join(pool[(i * k * k + k) % len(pool)] for k in range(3 + i % 40))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " .,;!"), (203, "THE the The ÉTÉ"), (204, " ".join(pool * 3000)), (7, rows[7][1]), (7, rows[7][1]), (None, pool[0] + " " + pool[3]), (205, "a-b_c\x00d\x7fe"), (206, " ".join([pool[5]] * 500))]
    items = [(1, " ".join(pool[:9])), (2, "été ünder NAÏVE the"), (3, None), (4, ""), (5, "nowhere"), (1, pool[20]), (None, pool[5]), (6, "A B C D E " + pool[5])]
    table = spark.createDataFrame([(*x, "t", 1, 2) for x in items], ITEMS)
    got = [tuple(r) for r in lexical_search.lexical_search(docs_of(rows), table, 20, most).collect()]
    assert len(got) == len(set(got)) and set(got) == ranked(rows, items, 20)


def test_a_whole_index_answers_as_one_of_wanted_terms(spark, docs_of, words):
    pool = words(40, 8)
    docs = docs_of([(i, " ".join(pool[(i + k * k) % 40] for k in range(5 + i % 9))) for i in range(80)])
    asked = lexical_search.item_terms(spark.createDataFrame([(1, " ".join(pool[:6])), (2, " ".join(pool[6:9]))], "item_id long, text string"))
    whole = lexical_search.build_index(docs)
    assert whole.n_docs == 80 and whole.postings.where("tf < 1 or term = ''").isEmpty()
    a = lexical_search.search(whole, asked, 10).collect()
    b = lexical_search.search(lexical_search.build_index(docs, asked.select("bucket", "term").distinct(), True), asked, 10).collect()
    assert a and set(map(tuple, a)) == set(map(tuple, b))


def test_search_of_empty_tables(spark, docs_of):
    items, none = spark.createDataFrame([(1, "a", "t", 1, 2)], ITEMS), spark.createDataFrame([], ITEMS)
    assert lexical_search.lexical_search(docs_of([]), items).count() == 0
    assert lexical_search.lexical_search(docs_of([(1, None)]), items).count() == 0
    assert lexical_search.lexical_search(docs_of([(1, "a")]), none).count() == 0


def one_jump(key, shards):
    """The loop of the paper, a key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_moves_keys_into_the_new_shard_only():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 64, 4000, dtype=np.uint64)
    before = sharding.jump(keys, 1)
    assert not before.any() and len(sharding.jump(keys[:0], 5)) == 0
    for n in range(2, 40):
        now = sharding.jump(keys, n)
        assert set(now[now != before]) <= {n - 1} and abs((now == n - 1).mean() - 1 / n) < 0.03
        before = now
    assert [one_jump(int(k), 1000) for k in keys[:300]] == sharding.jump(keys[:300], 1000).tolist()


def test_shards_are_whole_gapless_and_stable(spark, docs_of, words):
    rows = [(i, " ".join(words(1 + i % 30, i))) for i in range(900)] + [(None, None), (None, "é"), (900, ""), (901, None), (5, "other"), (6, "a b")] + [(7, "same")] * 300 + [(902, " ".join(words(30000, 1)))]
    got = sharding.assign(docs_of(rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(len({r.shard for r in got if r.doc_id == d}) == 1 for d in (None, 5, 7))
    again = sharding.assign(docs_of(rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_rows_that_move_and_columns_that_stay(spark, docs_of, words):
    docs = docs_of([(i, "t") for i in range(500)])
    out = sharding.with_shard(docs, 8)
    assert out.columns == [*docs.columns, "shard"] and out.drop("shard").exceptAll(docs).isEmpty()
    gone = {r.doc_id for r in sharding.moving(docs, 8).collect()}
    assert gone == {r.doc_id for r in sharding.assign(docs).collect() if r.grown_shard == 8} and gone
    with pytest.raises(ValueError):
        sharding.with_shard(docs.withColumnRenamed("key", "shard"), 8)
    assert sharding.assign(docs_of([])).count() == 0
