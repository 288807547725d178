import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from loomgraph.llm import compression_bands as B
from loomgraph.llm.shared import stage, table
from tests.llm.test_ngram_jaccard import brute
from tests.llm.test_text_operators import windows_in

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(x) for x in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    names, steps = zip(*C.STAGES)
    kept = {x.doc_id for x in B.quality_bands(docs).where("kept").collect()}
    one = stage(steps[0](spark, docs, SF), "t")
    assert {x.doc_id for x in one.collect()} == kept and one.columns == docs.columns
    two = stage(steps[1](spark, one, SF), "t")
    rows = [(x.doc_id, x.text) for x in one.collect()]
    assert {x.doc_id for x in two.collect()} == {i for i, n, c in brute(rows, 5, 80) if i == c} and two.columns == docs.columns
    three = stage(steps[2](spark, two, SF), "t")
    dirty = windows_in([(x.doc_id, x.text) for x in two.collect()], items)
    assert {x.doc_id for x in three.collect()} == {d for d, x in dirty.items() if not x[2]} and three.columns == docs.columns
    four = stage(steps[3](spark, three, SF), "t")
    assert four.columns == docs.columns
    times = collections.Counter(x.doc_id for x in four.collect())
    assert set(times) <= {x.doc_id for x in three.collect()} and max(times.values()) <= 3
    five = steps[4](spark, four, SF).collect()
    assert collections.Counter(x.doc_id for x in five) == times
    spans = sorted((x.start, x.n_tokens) for x in five)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, five))


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, k):
    docs = table(spark, SF, "documents").limit(0)
    assert C.STAGES[k][1](spark, docs, SF).count() == 0


def test_nulls(spark):
    docs = table(spark, SF, "documents")
    holes = docs.selectExpr("IF(doc_id % 5 = 0, NULL, doc_id) AS doc_id", "IF(doc_id % 7 = 0, NULL, text) AS text", "lang", "IF(doc_id % 3 = 0, NULL, source) AS source", "CAST(NULL AS BIGINT) AS n_chars")
    names, steps = zip(*C.STAGES)
    rows = lambda df: collections.Counter(map(str, df.collect()))
    kept = [holes]
    for step in steps[:4]:
        kept.append(stage(step(spark, kept[-1], SF), "t"))
        assert kept[-1].columns == holes.columns and set(rows(kept[-1])) <= set(rows(kept[-2]))
    assert all(x.text is not None for x in kept[1].collect())  # a null text fails the base rules
    # a row without an id is never removed as a copy, and takes part in all other stages
    assert kept[2].where("doc_id IS NULL").count() == kept[1].where("doc_id IS NULL").count() > 0
    assert kept[4].where("source IS NULL").count() > 0
    end = steps[4](spark, kept[4], SF).collect()
    ids = collections.Counter(x.doc_id for x in kept[4].collect())
    assert collections.Counter(x.doc_id for x in end) == ids


def test_clashing_columns_and_long_texts(spark):
    """Columns with names that the stages use pass through; one text is megabytes long, one is a single word of them."""
    r = random.Random(31)
    word = ["".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    long = " ".join(r.choice(word) for _ in range(250_000))
    rows = [(i, " ".join(r.choice(word) for _ in range(300)), "a" if i % 2 else "b") for i in range(40)] + [(100, long, "a"), (101, long + " tail", "a"), (102, "z" * 100_000, "b"), (103, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = ("key", "text_key", "pattern", "bad_id", "copies", "cid", "w", "n_words", "kept", "row_key", "n", "class")
    docs = docs.withColumns({c: F.lit(c) for c in extra})
    kept = docs
    for i, (_, step) in enumerate(C.STAGES[:4]):
        after = stage(step(spark, kept, SF), "t")
        assert after.columns == docs.columns and {tuple(x[c] for c in extra) for x in after.collect()} <= {extra}
        ids = {x.doc_id for x in after.select("doc_id").collect()}
        if i == 0:
            assert not ids & {102, 103} and len(ids & set(range(40))) >= 38
            after = docs.where("doc_id < 102")  # whatever the rules say of the long texts, the other stages get them
        if i == 1:
            assert 100 in ids and 101 not in ids
        kept = after
    end = {x.doc_id: x.n_tokens for x in C.STAGES[4][1](spark, kept.unionByName(docs.where("doc_id = 102")), SF).collect()}
    assert end[102] > 1000 and (100 not in end or end[100] > 250_000)


def test_workers_give_memory_back(spark, monkeypatch):
    """Every Arrow function of the stages that run before others ends by returning what is free, and that lowers what the process holds."""
    import subprocess
    import sys

    from loomgraph.llm import compression_bands, ngram_jaccard, textkit

    docs = spark.createDataFrame([(i, "a b c d e f g h i j " * 9 + str(i)) for i in range(9)], "doc_id long, text string")
    run, found = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, *args: found.append(f) or run(df, f, *args))
    ngram_jaccard.keep_one(compression_bands.keep_good(docs), k=5, percent=80).count()
    given = []
    monkeypatch.setattr(textkit, "give_back", lambda: given.append(1))
    assert len(found) >= 6 and all(not list(f(iter(()))) for f in found)
    assert len(given) == len(found)
    held = """
import re
import numpy as np
from loomgraph.llm import textkit

pins = []

def run(batches):
    np.ones(32 << 20, np.uint8)  # from now on such arrays come from the heap
    rows = [np.ones(1 << 20, np.uint8) for _ in range(200)]
    pins.extend(np.ones(1 << 16, np.uint8) for _ in range(9))
    yield len(rows)

anon = lambda: int(re.search(r"Anonymous: *(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
before = anon()
list(textkit.lean(run)(()))
print(anon() - before)
"""
    assert int(subprocess.run([sys.executable, "-c", held], capture_output=True, check=True, text=True).stdout) < 60
