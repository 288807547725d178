"""Quality rules: base rules, and bands of zstandard ratios over the whole text and over fixed chunks.

A ratio is compressed bytes over bytes.  Repetitive text compresses too well,
random or encoded text too badly.  What is normal depends on the length, since a
short text gives the compressor little to refer back to, so each length band has
its own limits; chunks of a fixed size have one pair of limits, and the share of
a text's bytes in chunks outside it is limited too, which finds a repetitive or
random stretch that the whole ratio of a long text hides.  What is left after the
last whole chunk is measured as well, by the limits of texts of its length, so
every byte of a text counts (a text shorter than a chunk is all rest).

The limits are learned in a first pass over all documents that pass the base
rules, each distinct text once: the quartiles of the ratio in each eighth of an
octave of length, less ``low_fence`` and plus ``high_fence`` times their distance.
So a corpus without odd texts loses next to nothing, and what the corpus's
languages and alphabet make normal is normal.  An eighth with fewer than
``least_texts`` texts goes by its whole octave, an octave with fewer by the fixed
``bands``, which only hold off text repeated many times and random characters.

Words are runs of characters other than ASCII white space.  Defined cases: a null
text has no words; texts with no words fail the base rules; extra columns and
repeated rows pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import stage

COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, whole_ratio double, low_chunks long, high_chunks long, n_chunks long, rest_bytes long, rest_outside boolean"
)


@dataclass(frozen=True)
class Limits:
    """bands: (bytes up to, least ratio, greatest ratio) by rising size; the last one holds for all longer texts.

    Prose of any of the languages tried lies well inside its band; text repeated some times over lies below,
    base64 and random characters above.
    """

    bands: tuple[tuple[int, float, float], ...] = ((400, 0.35, 1.05), (1000, 0.30, 0.85), (4000, 0.25, 0.72), (16000, 0.20, 0.66), (1 << 62, 0.15, 0.62))
    chunk_bytes: int = 2048
    chunk_low: float = 0.14
    chunk_high: float = 0.72
    chunk_share: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    low_fence: float = 1.5
    high_fence: float = 3.0
    least_texts: int = 32


def _measures(data: np.ndarray, off: np.ndarray):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the texts of a slice."""
    n_docs = len(off) - 1
    w = T.Words(data, off)
    n_words = w.counts()
    space = T._WS[data]
    head = (data & 0xC0) != 0x80
    word_chars = T.seg_sum((head & ~space).astype(np.int64), off)
    symbols = np.zeros(256, bool)
    symbols[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
    n_symbols = T.seg_sum(symbols[data].astype(np.int64), off)

    # lines: cut at each newline and at each end of a document
    cuts = np.flatnonzero(data == 10)
    start = np.union1d(cuts + 1, off[:-1])
    start = start[start < len(data)]
    doc = np.searchsorted(off, start, side="right") - 1
    end = np.minimum(np.append(cuts, len(data))[np.searchsorted(cuts, start)], off[doc + 1])
    solid = np.concatenate(([0], np.cumsum(~space)))
    full = solid[end] > solid[start]
    start, end, doc = start[full], end[full], doc[full]
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T._BYTE[data] * T._powers("p", T._BASE, len(data))[: len(data)], out=run[1:])
    line = (run[end] - run[start]) * T._powers("i", T._BASE_INV, len(data) + 1)[start] + (end - start).astype(np.uint64)
    key = T.mix(T.mix(line) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]] if len(order) else order
    n_dup = np.bincount(doc[again], minlength=n_docs)

    gram, at = T.grams(w.hashes(lower=False), w.bounds, 3)
    gdoc = np.repeat(np.arange(n_docs), np.diff(at))
    key = T.mix(gram + gdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first = np.flatnonzero(twice)
    word = w.bounds[gdoc[first]] + first - at[gdoc[first]]
    hit = np.zeros(len(w.start) + 3, bool)
    for i in range(3):
        hit[word + i] = True
    n_repeat = T.seg_sum(hit[: len(w.start)].astype(np.int64), w.bounds)
    return n_words, word_chars, n_symbols, n_dup, n_repeat


STEPS = 8  # length classes of an octave
GRAIN = 1000  # ratios are counted in steps of 1 / GRAIN
LEAST_SPREAD = 8  # of the quartiles, in such steps: near copies do not make all other texts odd


def _octave_step(size: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(size, 1))).astype(np.int64)


def _learn(limits: Limits):
    """Length class, ratio and chunk ratios (in steps of GRAIN) of each text that passes the base rules, and its hash."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=limits.level).compress
        for b in batches:
            keys = T.column(b, "key")
            for lo, hi, data, off in T.slices(T.column(b, "text")):
                n_words, _, _, _, repeat = _measures(data, off)
                good = np.flatnonzero((n_words >= limits.min_words) & (100 * repeat <= limits.max_repeat_percent * n_words))
                raw = data.tobytes()
                ratio = [GRAIN * len(press(raw[off[i] : off[i + 1]])) // int(off[i + 1] - off[i]) for i in good]
                chunks = [
                    [GRAIN * len(press(raw[c : c + limits.chunk_bytes])) // limits.chunk_bytes for c in range(off[i], off[i + 1] - limits.chunk_bytes + 1, limits.chunk_bytes)]
                    for i in good
                ]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo).take(pa.array(good)), pa.array(_octave_step(np.diff(off)[good])), pa.array(ratio, pa.int64()), pa.array(chunks, pa.list_(pa.int64()))],
                    names=["key", "step", "ratio", "chunks"],
                )

    return run


def _fences(limits: Limits, ratio: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Least and greatest usual ratio of a histogram."""
    order = np.argsort(ratio)
    ratio, share = ratio[order], np.cumsum(n[order]) / n.sum()
    q1, q3 = (int(ratio[np.searchsorted(share, q)]) for q in (0.25, 0.75))
    spread = max(q3 - q1, LEAST_SPREAD)
    return (q1 - limits.low_fence * spread) / GRAIN, (q3 + 1 + limits.high_fence * spread) / GRAIN


def learned(docs: DataFrame, limits: Limits | None = None, text_col: str = "text") -> Limits:
    """limits with the bands and chunk limits that the documents' own ratios give.

    Two histograms go to the driver: at most GRAIN or so ratios for each of the length classes, and for chunks.
    """
    limits = limits or Limits()
    text = docs.select(F.col(text_col).cast("string").alias("text")).select(F.xxhash64("text").alias("key"), "text")
    rows = text.mapInArrow(T.lean(_learn(limits)), "key long, step long, ratio long, chunks array<long>").dropDuplicates(["key"])
    rows = stage(rows, "ratios")
    told = rows.groupBy("step", "ratio").agg(F.count(F.lit(1)).alias("n")).toPandas()
    chunks = rows.select(F.explode("chunks").alias("ratio")).groupBy("ratio").agg(F.count(F.lit(1)).alias("n")).toPandas()

    fences = {}
    for by in (STEPS, 1):
        for k, part in told.groupby(told["step"] * by // STEPS):
            if part["n"].sum() >= limits.least_texts:
                fences[by, int(k)] = _fences(limits, part["ratio"].to_numpy(), part["n"].to_numpy())
    bands, fixed = [], list(limits.bands)
    for step in range(STEPS * 62):
        # the greatest whole size of the class
        top = int(np.ceil(2 ** ((step + 1) / STEPS))) - 1
        pair = fences.get((STEPS, step)) or fences.get((1, step // STEPS))
        while fixed[0][0] < top and pair is None:
            bands.append(fixed[0])
            fixed.pop(0)
        while len(fixed) > 1 and fixed[0][0] <= top:
            fixed.pop(0)
        bands.append((top, *(pair or fixed[0][1:])))
    bands.append((1 << 62, *limits.bands[-1][1:]))
    if chunks["n"].sum() < limits.least_texts:
        return replace(limits, bands=tuple(bands))
    low, high = _fences(limits, chunks["ratio"].to_numpy(), chunks["n"].to_numpy())
    return replace(limits, bands=tuple(bands), chunk_low=low, chunk_high=high)


def _judge(limits: Limits):
    tops, least, most = (np.array([b[i] for b in limits.bands]) for i in range(3))

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=limits.level).compress
        for b in batches:
            ids = T.column(b, "doc_id")
            for lo, hi, data, off in T.slices(T.column(b, "text")):
                n_words, chars, symbols, dup, repeat = _measures(data, off)
                failed = (n_words < limits.min_words) | (100 * repeat > limits.max_repeat_percent * n_words)
                n = hi - lo
                ratio, rest = np.ones(n), np.ones(n)
                low, high, chunks, rest_bytes = (np.zeros(n, np.int64) for _ in range(4))
                raw = data.tobytes()
                for i in range(n):
                    a, z = int(off[i]), int(off[i + 1])
                    if a == z:
                        continue
                    ratio[i] = len(press(raw[a:z])) / (z - a)
                    for c in range(a, z - limits.chunk_bytes + 1, limits.chunk_bytes):
                        r = len(press(raw[c : c + limits.chunk_bytes])) / limits.chunk_bytes
                        chunks[i] += 1
                        low[i] += r < limits.chunk_low
                        high[i] += r > limits.chunk_high
                    rest_bytes[i] = (z - a) % limits.chunk_bytes
                    if rest_bytes[i]:
                        rest[i] = ratio[i] if not chunks[i] else len(press(raw[z - rest_bytes[i] : z])) / rest_bytes[i]
                usual = lambda r, size: (r >= least[at := np.searchsorted(tops, size)]) & (r <= most[at])
                rest_outside = (rest_bytes > 0) & ~usual(rest, rest_bytes)
                outside = (low + high) * limits.chunk_bytes + np.where(rest_outside, rest_bytes, 0)
                kept = ~failed & usual(ratio, np.diff(off)) & (outside <= limits.chunk_share * np.diff(off))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n)] + [pa.array(x) for x in (n_words, chars, symbols, dup, repeat, failed, kept, ratio, low, high, chunks, rest_bytes, rest_outside)],
                    names=[c.split()[0] for c in COLUMNS.split(", ")],
                )

    return run


def quality_bands(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the measures, the ratios and the verdict ``kept``; without limits, by those learned from docs."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(T.lean(_judge(limits or learned(text))), COLUMNS)


def _filter(limits: Limits, text_col: str):
    judge = _judge(limits)

    def run(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col)).cast(pa.string())
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), text], names=["doc_id", "text"])
            kept = [x.column("kept") for x in judge(iter([rows]))]
            if kept:
                yield b.filter(pa.chunked_array(kept).combine_chunks())

    return run


def keep_good(docs: DataFrame, limits: Limits | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns; without limits, by those learned from docs."""
    return docs.mapInArrow(T.lean(_filter(limits or learned(docs, text_col=text_col), text_col)), docs.schema)
