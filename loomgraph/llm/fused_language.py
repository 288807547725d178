"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence are added as log likelihoods over the languages:

* the visible text: hashed words and character trigrams with add-one smoothing,
  counted over all documents of known language, tempered by the square root of
  the number of features, since they are far from independent;
* the declared markup language (``<html lang>``, wherever it stands in the page
  outside comments, scripts and styles): P(declared | language), counted over all
  pages against the text's own verdict;
* the address suffix (the last label of the host): P(suffix | language), likewise;
* the host: a prior smoothed hierarchically, the host towards its registered
  domain, that towards all pages.

Each piece of evidence is used once: the suffix is no level of the host's
hierarchy, and a page's own verdict is taken out of every count that it is judged
by, so a host of one page says nothing about it.

The counts of the last three are grouped aggregations with map-side combine over
all pages.  Joins broadcast the keys that hold at least one row in a thousand,
which are a thousand at most, and shuffle all others, so no host, domain or
suffix gathers in one task.

Defined cases: a null page or one without visible text has no text evidence and
goes by the other three; a null or unreadable address has an empty host; with
no training text all languages are ``und``; ties go to the first language by
name; repeated rows get equal results, each counting for the others; an empty
table gives an empty result; texts may have any length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import join_spread, stage

BITS = 16
#: Languages are gathered on the driver; more than this is an error.
MAX_LANGUAGES = 400

_DROP = re.compile(r"<!--.*?-->|<(script|style|nav|noscript)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_ENTITY = re.compile(r"&#?\w+;")


def visible(html: str) -> str:
    return _ENTITY.sub(" ", _TAG.sub(" ", _DROP.sub(" ", html)))


def _features(data, off):
    """Feature numbers of a slice, flat, with bounds: words, and trigrams of bytes of lower-cased text."""
    w = T.Words(data, off)
    word = (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    low = T._LOWER[data].astype(np.uint64)
    if len(low) < 3:
        return word, w.bounds
    tri = (T.mix(low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)) >> np.uint64(64 - BITS)).astype(np.int64)
    ends = np.maximum(off[1:] - 2, off[:-1])
    count = ends - off[:-1]
    at = np.concatenate(([0], np.cumsum(count + np.diff(w.bounds))))
    out = np.empty(at[-1], np.int64)
    out[T.spread(at[:-1], count)] = tri[T.spread(off[:-1], count)]
    out[T.spread(at[:-1] + count, np.diff(w.bounds))] = word
    return out, at


def _count(languages):
    where = {x: i for i, x in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        for b in batches:
            lang = np.array([where[x] for x in T.column(b, "lang").to_pylist()])
            for lo, hi, data, off in T.slices(T.column(b, "text")):
                f, at = _features(data, off)
                key = np.repeat(lang[lo:hi], np.diff(at)) << BITS | f
                total += np.bincount(key, minlength=total.size).reshape(total.shape)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << BITS))] + [pa.array(x) for x in total], names=["feature", *(f"l{i}" for i in range(len(languages)))])

    return run


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # language x feature, relative to the mean over languages


def train_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return TextModel(["und"], np.zeros((1, 1 << BITS)))
    columns = [f"l{i}" for i in range(len(languages))]
    counts = rows.mapInArrow(_count(languages), ", ".join(["feature long", *(f"{c} long" for c in columns)]))
    # one row for each feature, whatever the corpus
    told = counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    n = np.zeros((len(languages), 1 << BITS))
    n[:, told["feature"].to_numpy()] = np.stack([told[c].to_numpy() for c in columns])
    log_p = np.log((n + 1) / (n.sum(axis=1, keepdims=True) + n.shape[1]))
    return TextModel(languages, log_p - log_p.mean(axis=0))


_HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)
# comments, scripts and styles are skipped, to the end of the page if they are not closed; each character is read once
_HTML = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)\b.*?(?:</\1\b|\Z)|<html\b(?P<tag>[^>]*)", re.S | re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})\b", re.I)


def declared_language(html: str) -> str:
    """The language of the first ``<html>`` tag that has one, in lower case, or an empty string."""
    for m in _HTML.finditer(html):
        if m["tag"] and (found := _LANG.search(m["tag"])):
            return found[1].lower()
    return ""


def _evidence(model, column):
    def run(batches):
        m = model.value
        for b in batches:
            ids = T.column(b, "page_id")
            html = [x or "" for x in T.column(b, "html").to_pylist()]
            hosts = [(_HOST.match(x or "") or ["", ""])[1].lower().strip(".") for x in T.column(b, "url").to_pylist()]
            declared = [declared_language(x) for x in html]
            for lo, hi, data, off in T.slices(pa.array([visible(x) for x in html], pa.large_string())):
                f, at = _features(data, off)
                logs = np.stack([T.seg_sum(x[f], at) for x in m.log_p], axis=1) / np.sqrt(np.maximum(np.diff(at), 1))[:, None]
                logs -= logs.max(axis=1, keepdims=True)
                p = np.exp(logs)
                p /= p.sum(axis=1, keepdims=True)
                labels = [h.split(".") for h in hosts[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(hosts[lo:hi]), pa.array([".".join(x[-2:]) for x in labels]), pa.array([x[-1] for x in labels]), pa.array(declared[lo:hi])]
                    + [pa.array(x) for x in p.T],
                    names=["page_id", "host", "domain", "suffix", "declared", *column],
                )

    return run


def identify(pages: DataFrame, model: TextModel, strength: float = 5.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, declared, text_lang, lang, confidence) of each page.

    ``strength`` is how many pages a level of the host hierarchy borrows from the level above it.
    """
    spark = pages.sparkSession
    n = len(model.languages)
    column = [f"p{i}" for i in range(n)]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = "page_id long, host string, domain string, suffix string, declared string, " + ", ".join(f"{c} double" for c in column)
    rows = stage(rows.mapInArrow(_evidence(spark.sparkContext.broadcast(model), column), kinds), "evidence")

    def sums(df: DataFrame, key: str, name: str, *more) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{key}"), *(F.sum(c).alias(f"{name}{i}") for i, c in enumerate(column)), *more)

    total = [x or 0.0 for x in rows.agg(*(F.sum(c) for c in column)).first()]
    hosts = sums(rows, "host", "h", F.min("domain").alias("domain"), F.min("suffix").alias("suffix"))
    for key, name in (("domain", "d"), ("suffix", "x")):
        # how many hosts a domain or suffix has, to spread the join of hosts with it
        table = sums(rows, key, name).drop(f"n_{key}").join(hosts.groupBy(key).agg(F.count(F.lit(1)).alias("n_hosts")), key)
        hosts = join_spread(hosts, stage(table, f"{key}-counts"), key, "n_hosts")
    hosts = stage(hosts.drop("domain", "suffix"), "host-counts")
    # two or three letters, or none: at most 18,253 rows
    declared = F.broadcast(sums(rows, "declared", "m").drop("n_declared"))
    out = join_spread(rows.drop("domain", "suffix"), hosts, "host", "n_host").join(declared, "declared")

    own = [F.col(c) for c in column]
    others = lambda name: [F.col(f"{name}{i}") - own[i] for i in range(n)]
    size = lambda counts: sum(counts, F.lit(0.0))
    pages_of = [F.greatest(F.lit(total[i]) - own[i], F.lit(0.0)) for i in range(n)]
    prior = [(c + 1) / (size(pages_of) + n) for c in pages_of]
    for name in ("d", "h"):
        counts = [F.greatest(c, F.lit(0.0)) for c in others(name)]
        prior = [(c + strength * above) / (size(counts) + strength) for c, above in zip(counts, prior)]
    # add-one over the values seen and one unseen
    given = lambda name: [(F.greatest(c, F.lit(0.0)) + 1) / (t + 2) for c, t in zip(others(name), pages_of)]
    floor = 1e-12
    logs = [
        F.log(p + floor) + F.log(h + floor) + F.log(x) + F.when(F.col("declared") == "", F.lit(0.0)).otherwise(F.log(m))
        for p, h, x, m in zip(own, prior, given("x"), given("m"))
    ]
    best = lambda arr: F.array_position(arr, F.array_max(arr)).cast("int")
    names = F.array(*(F.lit(x) for x in model.languages))
    out = out.withColumn("logs", F.array(*logs)).withColumn("texts", F.array(*column))
    weight = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))), F.lit(0.0), lambda a, x: a + x)
    return out.select("page_id", "host", "declared", F.element_at(names, best(F.col("texts"))).alias("text_lang"), F.element_at(names, best(F.col("logs"))).alias("lang"), (1 / weight).alias("confidence"))
