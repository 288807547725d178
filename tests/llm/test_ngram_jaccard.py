import random

import numpy as np
import pytest

from loomgraph.llm import ngram_jaccard as J
from loomgraph.llm import textkit as T


def brute(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = T_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(sets[i]), find(i)) for i in ids}


def T_words(t):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x20\x09-\x0d]+", t)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 4)))
    rows = [None, "", "  \n", "a b", "A B", "x", "É", "é", "the same words all the time the same words all the time"]
    common = [word() for _ in range(30)]
    for size in (5, 8, 9, 10, 14, 20, 33, 60, 150, 700):
        base = [word() for _ in range(size)]
        rows += [" ".join(base)] * 2 + [" ".join(base).upper()]
        for _ in range(12):
            c = list(base)
            for _ in range(r.randint(1, max(1, size // 25))):
                i = r.randrange(len(c))
                c[i : i + r.randint(0, 1)] = [word()] * r.randint(0, 2)
            rows.append("\t".join(c))
        for _ in range(4):
            rows.append(" ".join([word() for _ in range(size // 3)] + common + [word() for _ in range(size // 3)]))
    return list(enumerate(rows))


def run(spark, rows, **args):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", J.F.lit("clash"))
    return {(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, **args).collect()}


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_split_components(spark):
    rows = corpus(7)[:120]
    assert run(spark, rows, block=60) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_repeated_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (9, None)]
    assert run(spark, rows) == {(5, 3, 2), (2, 3, 2), (9, 0, 9)}


def test_null_and_repeated_ids(spark):
    """Every row is a document: null ids link and are kept, rows of one id with different texts are compared each for itself."""
    one, two = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "one two three four five six seven eight"
    rows = [(3, one + " end"), (None, one), (None, one), (7, two), (7, one), (7, one), (1, two), (None, "only null ids have this text here"), (None, "only null ids have this text here"), (4, None), (None, "")]
    got = sorted(map(str, ((i, n, c) for i, n, c in ((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))))
    want = [(3, 24, 3), (None, 23, 3), (None, 23, 3), (7, 5, 1), (7, 23, 3), (7, 23, 3), (1, 5, 1), (None, 4, None), (None, 4, None), (4, 0, 4), (None, 0, None)]
    assert got == sorted(map(str, want))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", J.F.lit(1)).withColumn("key", J.F.lit("k"))
    left = J.keep_one(docs, k=4, percent=85)
    assert left.columns == docs.columns
    # both texts of id 7 go, as each has a partner with a smaller id; null ids stay
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [r for r in rows if r[0] != 7]))


def test_large_sets_do_not_overflow():
    """Folded counts beyond 16 bits."""
    r = np.random.default_rng(4)
    one = np.unique(r.integers(0, 1 << 60, 90_000, dtype=np.uint64))
    other = np.unique(np.concatenate([one[: len(one) - 900], r.integers(0, 1 << 60, 900, dtype=np.uint64)]))
    assert J.link_sets([one, other], 85, groups=256) and J.link_sets([one, one.copy()], 85)
    counts = np.array([[20_000] * 4 + [0] * 252] * 2)
    tree = J.CountRTree(counts, counts.sum(axis=1), 85)
    assert tree.search(1).tolist() == [0]


def test_long_texts(spark):
    r = random.Random(2)
    long = " ".join("w%d" % r.randrange(500_000) for _ in range(300_000))
    rows = [(1, "x" * 3_000_000), (2, long), (3, long + " tail"), (4, long.upper()), (5, "x" * 3_000_000 + " y"), (6, " " * 2_000_000)]
    got = {(i, c) for i, _, c in run(spark, rows)}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 6)}


def test_hot_cell(spark):
    """One passage in all documents: candidates of each other, told apart; near copies found."""
    r = random.Random(3)
    passage = " ".join("p%d" % i for i in range(30))
    rows = []
    for i in range(240):
        own = " ".join("d%dx%d" % (i if i % 8 else 0, j) for j in range(25))
        rows.append((i, f"{passage} {own} {r.randrange(3)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_components(df, block=500).collect()} == brute(rows)


def test_tree_bound_never_excludes_a_link():
    r = np.random.default_rng(3)
    for percent in (60, 85):
        base = [np.unique(r.integers(0, 1 << 40, s, dtype=np.uint64)) for s in (7, 20, 100, 400)]
        sets = []
        for b in base:
            for _ in range(20):
                drop = r.random(len(b)) > r.random() * 0.2
                sets.append(np.unique(np.concatenate([b[drop], r.integers(0, 1 << 40, int(len(b) * r.random() * 0.15), dtype=np.uint64)])))
        want = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]

        def classes(pairs):
            root = list(range(len(sets)))
            for _ in range(len(sets)):
                for i, j in pairs:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert classes(want) == classes(J.link_sets(sets, percent, groups=32))


def test_sparse_groups_fall_back():
    """Two sets that agree in a cell only through the finer groupings still share a key."""
    r = np.random.default_rng(5)
    for n in (6, 7, 8, 12, 20, 50):
        for _ in range(200):
            a = np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
            d = (15 * 2 * n // 185) // 2
            b = np.unique(np.concatenate([a[d:], r.integers(0, 1 << 60, d, dtype=np.uint64)]))
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * inter < 85 * union:
                continue
            doc, key = J._cell_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85)
            assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())


def test_hashes_follow_words():
    text = "Aa bB é\x1c\x85 aa\x00 " * 3
    import pyarrow as pa

    (_, _, data, off), = T.slices(pa.array([text]))
    w = T.Words(data, off)
    words = T_words(text)
    h = w.hashes().tolist()
    assert len(words) == len(h)
    assert len(set(zip(words, h))) == len(set(words)) == len(set(h))


def test_vectors_fold_and_keep_links():
    r = np.random.default_rng(8)
    sets = []
    for s in (40, 230, 270, 1000, 1100, 4000, 4300):
        base = np.unique(r.integers(0, 1 << 60, s, dtype=np.uint64))
        sets += [base[r.random(len(base)) > x] for x in (0, 0.03, 0.12)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    blobs = J._vectors(np.concatenate(sets), bounds)
    assert [int(J._unpack(b).sum()) for b in blobs] == [len(s) for s in sets]
    table = {"comp": np.zeros(len(sets), np.int64), "cid": np.arange(len(sets))}
    import pyarrow as pa

    got = J._refine_task(85)(pa.table({**table, "counts": pa.array(blobs, pa.binary())})).to_pylist()
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for e in got:
            root[e["a"]] = root[e["b"]] = min(root[e["a"]], root[e["b"]])
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                assert root[i] == root[j]
    assert len(set(root)) >= 5


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (4, 85)])
def test_quoted_passages_make_no_candidates(spark, monkeypatch, k, percent):
    """texts that share one of a few passages, and no more, are not compared with each other."""
    r = random.Random(11)
    passages = [[f"p{p}w{i}" for i in range(40)] for p in range(4)]
    rows = []
    for i in range(600):
        own = [f"d{i // 2 if i < 40 else i}x{j}" for j in range(60)]
        at = r.randrange(61)
        rows.append((i, " ".join(own[:at] + passages[i // 2 % 4] + own[at:] if i >= 40 else own + passages[0] + [str(i)])))
    dealt, deal = [], J._deal
    monkeypatch.setattr(J, "_deal", lambda some, *a: dealt.append(some.count()) or deal(some, *a))
    assert run(spark, rows, k=k, percent=percent) == brute(rows, k, percent)
    assert max(dealt) <= 100


def test_cells_that_are_kept_join_all_links(monkeypatch):
    """Over tasks with hot cells, copies and cells of one number; parts are gathered here as the join does."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    passage = r.integers(0, 1 << 60, 60, dtype=np.uint64)
    for percent, most, parts in ((80, 3, 3), (85, 1024, 1), (60, 2, 2)):
        monkeypatch.setattr(J, "CELL_ROWS", most)
        sets = []
        for n in (5, 9, 30, 90):
            for _ in range(12):
                base = np.concatenate((r.integers(0, 1 << 60, n, dtype=np.uint64), passage[: r.integers(0, 2 * n)]))
                for _ in range(4):
                    drop = r.random(len(base)) > r.random() * 0.2
                    sets.append(np.unique(np.concatenate((base[drop], r.integers(0, 1 << 60, int(len(base) * r.random() * 0.12), dtype=np.uint64)))))
        sets += sets[::5]
        packs = []
        for task in range(4):
            own = sets[task::4]
            at = np.concatenate(([0], np.cumsum([len(x) for x in own])))
            doc, key, mark = J._marked_keys(np.concatenate(own), at, percent)
            cid = T.i64(J._class_ids(np.concatenate(own), at)[0])
            if most == 2:
                key = key & np.uint64(0xFF000000000000FF)
            packs.append(pa.Table.from_batches([J._cell_packs(key, cid[doc], mark, parts)]))

        def gathered(tables, f):
            t = pa.concat_tables(tables)
            return [f(t.filter(pa.array(t["part"].to_numpy() == x))) for x in np.unique(t["part"].to_numpy())]

        stars = gathered(gathered(gathered(packs, J._shared(2)), J._first_cells(2)), J._stars)
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for t in stars:
            for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist()):
                root[find(a)] = find(b)
        names = T.i64(J._class_ids(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))[0]).tolist()
        linked = 0
        for i, a in enumerate(sets):
            for j in range(i):
                if len(a) and 100 * len(np.intersect1d(a, sets[j])) >= percent * len(np.union1d(a, sets[j])):
                    linked += names[i] != names[j]
                    assert find(names[i]) == find(names[j])
        assert linked > 50
