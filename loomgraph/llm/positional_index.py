"""Benchmark decontamination by a positional inverted index; DataFrame functions only.

Terms of the test set are counted over all documents, and each test window ranks
its terms from the rarest on.  The index stores, for the rarest term of every
window, the postings of the training texts: (document, term, position, the two
terms after it).  A window starts from the list of its rarest term: shifted by
the term's offset, its postings are the places where the window may start, and
the two terms after it must agree.  Documents where a place is left give the
lists of the windows' next rarest terms (``lists`` in all), and the places are
intersected with these offset-adjusted lists, one after another.  Places that all
lists agree on are compared with the text itself, so matches are exact.

Proximity matches (enough of a window's distinct terms within reach of each
other, in any order) start from as many of the rarest terms as it takes that one
must occur: if a share of m terms is asked for, one of the rarest
``m - ceil(share * m) + 1``.

Only (document, position, terms) ever passes a shuffle, never an array of words,
so the cost is linear in a text's length.  Test terms, and ids of documents with
places, are broadcast while they are at most ``BROADCAST_TERMS``; beyond it
tokens are shuffled by term and texts by id, with the same result.

Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and all other
non-ASCII characters.  A window is ``k`` consecutive words of an item, or the
whole item if it has fewer (but some).  Defined cases: null and empty texts have
no words and match nothing; items without words have no window; equal items each
count; an empty table on either side gives no match; all rows with a null id, or
with the same id, count as one document, whose n_words is the sum, and matches do
not reach from one row into another; other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, stage

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Tables of test terms and windows of at most so many rows are broadcast (some 100 MB); larger ones are shuffled.
BROADCAST_TERMS = 500_000


def words(text: Column) -> Column:
    """Array of words; an empty string may stand first or last, where a text starts or ends with a gap."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), GAP)


def word_count(found: Column) -> Column:
    ends = F.when(F.size(found) == 1, F.when(F.element_at(found, 1) == "", 1).otherwise(0)).otherwise(
        F.when(F.element_at(found, 1) == "", 1).otherwise(0) + F.when(F.element_at(found, -1) == "", 1).otherwise(0)
    )
    return (F.size(found) - ends).cast("long")


def _sized(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """df as a table, marked to be broadcast if it is small; and whether it is."""
    df = stage(df, name)
    small = df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return (F.broadcast(df) if small else df), small


def windows(items: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(window_id, terms) of the distinct windows, and (window_id, item_id)."""
    w = F.filter(words(F.col(text_col)), lambda x: x != "")
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, k))).alias("terms")).distinct()
    rows = stage(rows, "windows")
    each = rows.select("terms").distinct().withColumn("window_id", F.xxhash64("terms"))
    clash = each.groupBy("window_id").count().where("count > 1").limit(1).count()
    if clash:
        raise RuntimeError("two test windows have one 64-bit id")
    return each, rows.select(F.xxhash64("terms").alias("window_id"), "item_id")


@dataclass
class Index:
    """postings: (doc_id, term, pos, next, after, n_words), n_words once for each row of docs, beside a null term if need be.

    windows: (window_id, terms, ranked), ranked from the rarest term: structs (n, offset, term); only windows all of
    whose terms occur somewhere, unless the index is for proximity.  owners: (window_id, item_id).
    """

    postings: DataFrame
    windows: DataFrame
    owners: DataFrame
    lists: int


def ranked_windows(docs: DataFrame, each: DataFrame, text_col: str = "text") -> DataFrame:
    """(window_id, terms, ranked) by counts over all documents, with a map-side combine."""
    terms, small = _sized(each.select(F.explode("terms").alias("term")).distinct(), "terms")
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    if small:
        counts = tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")
    counts, _ = _sized(counts, "term-counts")
    at = each.select("window_id", "terms", F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    entry = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")
    return at.groupBy("window_id").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_list(entry)).alias("ranked"))


def anchor(lists: int) -> list[Column]:
    """The term that a window starts from, the two that must follow it, and the (offset, term) pairs to intersect with.

    The start is the rarest term that has two more after it in the window (if it is that long), so that these can be
    compared at once.
    """
    first = F.get(F.filter("ranked", lambda x: x["offset"] < F.greatest(F.size("terms") - 2, F.lit(1))), F.lit(0))
    own = lambda x: (x["offset"] < first["offset"]) | (x["offset"] > first["offset"] + 2)
    rest = F.slice(F.filter("ranked", own), 1, lists - 1)
    follows = [F.get("terms", first["offset"] + i).alias(n) for i, n in ((1, "follows"), (2, "follows_after"))]
    return [first["term"].alias("term"), first["offset"].alias("offset"), rest.alias("rest"), *follows]


def build_index(docs: DataFrame, items: DataFrame, k: int = 8, lists: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of docs for the windows of items; ``share`` below 1 adds the terms that proximity matches start from."""
    each, owners = windows(items, k)
    ranked = ranked_windows(docs, stage(each, "window-terms"), text_col)
    if share >= 1:
        ranked = ranked.where(F.get("ranked", F.lit(0))["n"] > 0)  # a term that no document holds rules its window out
    ranked = stage(ranked, "ranked")
    used = ranked.select(anchor(lists)[0])
    if share < 1:
        used = used.unionByName(ranked.select(F.explode(F.transform(starts(share), lambda x: x["term"])).alias("term")))
    terms, small = _sized(used.distinct(), "index-terms")

    rows = _tokens(docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w")))
    if small:
        found = rows.join(terms, F.col("word") == F.col("term"), "left").where("term IS NOT NULL OR pos = 0").drop("word")
    else:
        found = rows.drop("n_words").join(terms, F.col("word") == F.col("term")).drop("word").withColumn("n_words", F.lit(None).cast("long"))
        heads = rows.where("pos = 0").select("doc_id", F.lit(None).cast("string").alias("term"), "pos", "next", "after", "n_words")
        found = found.unionByName(heads)
    return Index(stage(found.select("doc_id", "term", "pos", "next", "after", "n_words"), "postings"), ranked, owners, lists)


def _tokens(rows: DataFrame) -> DataFrame:
    """(doc_id, word, pos, next, after, n_words) of (doc_id, w); n_words at position 0 only."""
    # counted and paired below the explode, so that no array of words is copied beside each of its words
    rows = rows.select("doc_id", "w", word_count(F.col("w")).alias("n_words"), *(F.slice("w", F.lit(i), F.size("w")).alias(n) for i, n in ((2, "next"), (3, "after"))))
    rows = rows.select("doc_id", "n_words", F.posexplode(F.arrays_zip("w", "next", "after")).alias("pos", "t"))
    return rows.select("doc_id", F.col("t.w").alias("word"), "pos", "t.next", "t.after", F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"))


def _texts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, w) of the documents that places name; the texts themselves are a table."""
    some, _ = _sized(places.select(F.col("doc_id").alias("some_id")).distinct(), "place-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(rows.join(some, F.col("doc_id").eqNullSafe(F.col("some_id")), "left_semi"), "place-texts")
    return rows.select("doc_id", words(F.col("text")).alias("w"))


def phrase_matches(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, window_id) of every exact occurrence."""
    first = index.postings.where("term IS NOT NULL").select("doc_id", "term", "pos", "next", "after")
    found, _ = _sized(index.windows.select("window_id", "terms", *anchor(index.lists)), "anchors")
    agree = [F.col(a).isNull() | (F.col(a) == F.col(b)) for a, b in (("follows", "next"), ("follows_after", "after"))]
    places = first.join(found, "term").where(agree[0] & agree[1])
    places = places.select("doc_id", (F.col("pos") - F.col("offset")).alias("start"), "window_id", "terms", "rest").where("start >= 0")
    places = stage(places, "places")
    texts = _texts(docs, places, id_col, text_col)
    terms, _ = _sized(index.windows.select(F.explode(F.transform(anchor(index.lists)[2], lambda x: x["term"])).alias("term")).distinct(), "list-terms")
    rows = _tokens(texts).select("doc_id", "word", "pos")
    lists = stage(rows.join(terms, F.col("word") == F.col("term")).select("doc_id", "term", "pos"), "lists")
    for i in range(index.lists - 1):
        places = stage(places, "places") if i else places
        there = lists.select(F.col("doc_id").alias("list_id"), F.col("term").alias("list_term"), F.col("pos").alias("list_pos"))
        want = F.get("rest", F.lit(i))
        agree = (there["list_term"] == want["term"]) & (there["list_pos"] == F.col("start") + want["offset"]) & there["list_id"].eqNullSafe(F.col("doc_id"))
        more = places.where(F.size("rest") > i)
        places = more.join(there, agree).select(*places.columns).unionByName(places.where(F.size("rest") <= i))
    places = stage(places.dropDuplicates(["doc_id", "start", "window_id"]).drop("rest"), "places")
    some, _ = _sized(places.select(F.col("doc_id").alias("some_id")).distinct(), "match-ids")
    texts = texts.join(some, F.col("doc_id").eqNullSafe(F.col("some_id")), "left_semi").withColumnRenamed("doc_id", "text_id")
    same = F.slice("w", F.col("start") + 1, F.size("terms")) == F.col("terms")
    rows = texts.join(places, F.col("text_id").eqNullSafe(F.col("doc_id"))).where(same)
    return rows.select("doc_id", "start", F.size("terms").alias("length"), "window_id")


def starts(share: float) -> Column:
    """Of a window's ranked terms: the rarest of which one must occur where that share of the distinct terms does."""
    once = F.filter("ranked", lambda x: x["offset"] + 1 == F.array_position("terms", x["term"]))
    m = F.size(F.array_distinct("terms"))
    return F.slice(once, F.lit(1), m - F.greatest(F.ceil(m * F.lit(share)).cast("int"), F.lit(1)) + 1)


def proximity_matches(docs: DataFrame, index: Index, share: float = 0.75, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, window_id, share) where at least that share of a window's distinct terms stands within reach of pos.

    Reach is the window's length less one, plus ``slop``, to either side; pos is that of one of the window's rarest
    terms (see ``starts``).  The index has to be built with the same share.
    """
    at = index.windows.select("window_id", "terms", F.explode(starts(share)).alias("x")).select("window_id", "terms", F.col("x.term").alias("term"))
    at, _ = _sized(at, "starts")
    places = stage(index.postings.where("term IS NOT NULL").join(at, "term").select("doc_id", "pos", "window_id", "terms").distinct(), "places")
    texts = _texts(docs, places, id_col, text_col).withColumnRenamed("doc_id", "text_id")
    reach = F.size("terms") - 1 + slop
    near = F.slice("w", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.col("pos") + reach + 1 - F.greatest(F.col("pos") - reach, F.lit(0)))
    found = F.size(F.array_intersect(near, F.col("terms"))) / F.size(F.array_distinct("terms"))
    rows = texts.join(places, F.col("text_id").eqNullSafe(F.col("doc_id"))).withColumn("share", found).where(F.col("share") >= share)
    return rows.groupBy("doc_id", "pos", "window_id").agg(F.max("share").alias("share"))


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 8, lists: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) of every document: words inside occurrences, items with
    occurring windows, sorted as strings, and the occurrences (start, length)."""
    index = build_index(docs, items, k, lists, 1.0, id_col, text_col)
    matches = phrase_matches(docs, index, id_col, text_col)
    hits = matches.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("window_id")).alias("ids"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("int").alias("end"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["start"] + x["length"] - F.greatest(x["start"], acc["end"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
    )
    hits = stage(hits.withColumn("n_hit", F.aggregate("spans", none, step, lambda acc: acc["n"])), "hits")
    # windows of many documents are few: items are looked up once for each set of windows
    owners, _ = _sized(index.owners, "owners")
    sets = hits.select(F.col("ids").alias("key"), F.explode("ids").alias("window_id")).distinct()
    sets = sets.join(owners, "window_id").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = hits.join(sets, hits["ids"] == sets["key"], "left").select(F.col("doc_id").alias("hit_id"), "n_hit", "items", "spans")
    size = index.postings.where("n_words IS NOT NULL").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))
    return size.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )


def digest(found: DataFrame, least_items: int = 2) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_items") >= least_items).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, k: int = 8, least_items: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which windows of fewer than ``least_items`` items occur."""
    (bad_id,) = free_names(docs.columns, "bad_id")
    bad = decontaminate(docs, items, k, id_col=id_col, text_col=text_col).where(F.col("n_items") >= least_items).select(F.col("doc_id").alias(bad_id))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad[bad_id]), "left_anti")
