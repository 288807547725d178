"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history), both log-linear.

The class model has hashed features: the word before, the word before that (a
skip feature), their pair (an n-gram feature) and a bias, over buckets of words.
Words are put into classes by the square roots of their counts.

The word model starts from a word's relative frequency in its class and has a
weight for each pair of a history and a word that occurs at least ``min_pair``
times, however large the corpus is: the history is the word before (n-gram), or,
where that is a rare word, the word before that (skip).  Weights that are not
stored are zero, so a normaliser is one plus the sum of what the stored ones
change, and the softmax is exact.  The weights and normalisers are a table that
grows with the corpus.  Those of pairs, and of classes after a history, that occur
at least ``tokens / max_pairs`` times travel with the model; as tokens are the sum
of all pairs, they are at most ``max_pairs`` each.  All others are joined.
``max_pairs`` chooses the way and not the result.  A bitmap of fixed size travels
too and tells of most keys that the table lacks; it, too, changes no result.

The corpus is counted in two passes over all training documents: words; then
class counts of each hashed history, pairs, and classes after each history.
Those counts are all that a gradient of the whole corpus needs.  The class
model's gradients are added up by tasks each round and the driver moves the
weights.  The weights of one history depend on no other's, so tasks move those of
their histories by themselves.  Scoring looks whole batches up with sparse numpy
indexing, and the rest of their keys, once a document, in the table.

Frequent words (at most ``max_head``, a parameter of the model: they are its
classes) travel with the model.  All others form the last class; their counts,
however many, are joined, and a word has (count + 1) / (words + kinds + 1) of the
class, which leaves a share for unknown words.  A word is known by a 64-bit hash.

Tokens are words (runs of anything but ASCII white space, A-Z lower-cased) and
one end for each document.  Defined cases: null and empty texts are one end;
repeated rows and ids are scored each; with no training text every token has
probability 1 under the base model; other columns are ignored; an empty table
gives an empty result; texts may have any length.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import drop_shuffles, scratch, stage

END = np.uint64(0x5851F42D4C957F2D)
CLASSES = 16
BUCKETS = 256
OWN = 200
PAIRS = 4096
MAX_HEAD = 1 << 20
MAX_PAIRS = 1 << 20
MIN_PAIR = 2
FLUSH = 1 << 22
FLUSH_PAIRS = 1 << 20
#: Keys of counts: their kind, then a history (shifted by WIDE) and a word or class.
WIDE = 22
CLASS_OF, PAIR, AFTER = 0, 1, 2
#: Keys of a part that one task merges, and the packs that it gets.
PART = 1 << 21
PACKS = pa.schema([("part", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())])
#: Log2 of the bits of the bitmap of joined keys (16 MB).
MAP_BITS = 27
#: Documents of a slice up to which a document and a key fit 63 bits.
NARROW = 1 << 17
#: Parts of the keys that are joined one after the other, by the last bits of a key; the shuffle of one is on the disks at a time.
HALVES = 2


def _tokens(data, off):
    """Token hashes of a slice with an end after each document, and each document's range."""
    w = T.Words(data, off)
    return np.insert(w.hashes(), w.bounds[1:], END), w.bounds + np.arange(len(w.bounds))


def _count(batches):
    held, size = [], 0

    def flush():
        h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
        return h, n

    def rows(h, n):
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(T.i64(h[i : i + 100_000])), pa.array(n[i : i + 100_000])], names=["word", "n"])

    for b in batches:
        for _, _, data, off in T.slices(T.column(b, "text")):
            h, n = np.unique(_tokens(data, off)[0], return_counts=True)
            held.append((h, n))
            size += len(h)
            if size >= FLUSH:
                h, n = flush()
                held, size = [(h, n)], len(h)
                if size > FLUSH // 2:
                    yield from rows(h, n)
                    held, size = [], 0
    if held:
        yield from rows(*flush())


class Head:
    """Frequent words: sorted hashes, counts, classes and buckets.  Class CLASSES - 1 is for all other words.

    Words that occur ``least`` times have a number of their own (``own``, else -1); ``kind_of`` and ``share_of`` give
    their classes and shares of them by it.
    """

    def __init__(self, word: np.ndarray, n: np.ndarray, least: int = 1 << 62):
        order = np.argsort(-n, kind="stable")
        share = np.cumsum(np.sqrt(n[order]))
        kind = np.minimum((share / share[-1] * (CLASSES - 1)).astype(np.uint8), CLASSES - 2) if len(n) else np.zeros(0, np.uint8)
        bucket = (OWN + word[order] % np.uint64(BUCKETS - 1 - OWN)).astype(np.uint8)
        bucket[:OWN] = np.arange(min(OWN, len(n)))
        mass = np.bincount(kind, weights=n[order], minlength=CLASSES)
        inside = np.log10(n[order] / mass[kind]) if len(n) else np.zeros(0)
        own = np.where(n[order] >= least, np.arange(len(n)), -1).astype(np.int32)
        self.n_own = int((own >= 0).sum())
        self.kind_of, self.share_of = kind[: self.n_own].astype(np.int64), 10 ** inside[: self.n_own]
        by = np.argsort(word[order])
        self.word, self.n, self.kind, self.bucket, self.inside, self.own = word[order][by], n[order][by], kind[by], bucket[by], inside[by], own[by]

    def look(self, h: np.ndarray):
        """(place or -1, class, bucket) of each token."""
        if not len(self.word):
            return np.full(len(h), -1), np.full(len(h), CLASSES - 1, np.uint8), (OWN + h % np.uint64(BUCKETS - 1 - OWN)).astype(np.uint8)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        known = self.word[at] == h
        return (
            np.where(known, at, -1),
            np.where(known, self.kind[at], np.uint8(CLASSES - 1)),
            np.where(known, self.bucket[at], (OWN + h % np.uint64(BUCKETS - 1 - OWN)).astype(np.uint8)),
        )


def _histories(bucket: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket of the word before * BUCKETS + bucket of the word before that; the last bucket stands before a text."""
    one = np.empty(len(bucket), np.int64)
    two = np.empty(len(bucket), np.int64)
    one[1:], two[2:] = bucket[:-1], bucket[:-2]
    first = bounds[:-1]
    one[first] = BUCKETS - 1
    two[first] = BUCKETS - 1
    second = first[np.diff(bounds) > 1] + 1
    two[second] = BUCKETS - 1
    return one * BUCKETS + two


def _features(history: np.ndarray) -> np.ndarray:
    """Feature rows of histories: bias, word before, skip, hashed pair."""
    one, two = history // BUCKETS, history % BUCKETS
    pair = T.mix(history.astype(np.uint64)) % np.uint64(PAIRS)
    return np.stack((np.zeros(len(history), np.int64), 1 + one, 1 + BUCKETS + two, 1 + 2 * BUCKETS + pair.astype(np.int64)), axis=1)


N_FEATURES = 1 + 2 * BUCKETS + PAIRS


def _log_softmax(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    z = weights[_features(history)].sum(axis=1)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _contexts(own: np.ndarray, bounds: np.ndarray, n_own: int) -> np.ndarray:
    """Number of the history that the word model looks at: the word before, else the one before that; -1 if both are rare.

    A number n_own stands before a text.
    """
    one = np.full(len(own), n_own, np.int64)
    two = np.full(len(own), n_own, np.int64)
    one[1:], two[2:] = own[:-1], own[:-2]
    first = bounds[:-1]
    one[first] = n_own
    second = first[np.diff(bounds) > 1] + 1
    two[first], two[second] = n_own, n_own
    return np.where(one >= 0, one, np.where(two >= 0, n_own + 1 + two, -1))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Sorted keys with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(n[order], first)


def _pack(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, by planes of bytes, compressed."""
    planes = np.stack((np.diff(key, prepend=0), n)).astype("<i8").view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, size: int):
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=16 * size), np.uint8).reshape(2, 8, size)
    gap, n = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return np.cumsum(gap), n


def _merge(least: int):
    """(key, n) of all packs of a part; pairs only if they occur ``least`` times."""

    def run(t: pa.Table) -> pa.Table:
        key, n = _merged(*zip(*(_unpack(x.as_py(), k) for x, k in zip(t["blob"], t["size"].to_numpy()))))
        keep = (key >> 60 != PAIR) | (n >= least)
        return pa.table({"key": pa.array(key[keep]), "n": pa.array(n[keep])})

    return run


def _events(head, parts: int):
    """(part, size, blob): packs of class counts of hashed histories, pairs of contexts and words, classes after contexts.

    Parts are by the hash of a whole key, so no history makes one large, and a task sends each key once a flush.
    """

    def run(batches):
        m = head.value
        classes = np.zeros(BUCKETS * BUCKETS * CLASSES, np.int64)
        held, size = [], 0

        def rows(key, n):
            part = (T.mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, n, part = key[order], n[order], part[order]
            first = _firsts(part)
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(key)).tolist()):
                yield pa.RecordBatch.from_pylist([{"part": int(part[lo]), "size": hi - lo, "blob": _pack(key[lo:hi], n[lo:hi])}], schema=PACKS)

        for b in batches:
            for _, _, data, off in T.slices(T.column(b, "text")):
                h, bounds = _tokens(data, off)
                at, kind, bucket = m.look(h)
                classes += np.bincount(_histories(bucket, bounds) * CLASSES + kind, minlength=len(classes))
                if not m.n_own:
                    continue
                own = np.where(at >= 0, m.own[at], -1)
                context = _contexts(own, bounds, m.n_own)
                seen = context >= 0
                after = (AFTER << 60) + (context[seen] << WIDE) + kind[seen]
                seen &= own >= 0
                pair = (PAIR << 60) + (context[seen] << WIDE) + own[seen]
                held.append(np.unique(np.concatenate((after, pair)), return_counts=True))
                size += len(held[-1][0])
                if size >= FLUSH_PAIRS:
                    held = [_merged(*zip(*held))]
                    size = len(held[0][0])
                    if size > FLUSH_PAIRS // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*_merged(*zip(*held)))
        some = np.flatnonzero(classes)
        yield from rows((CLASS_OF << 60) + (some // CLASSES << WIDE) + some % CLASSES, classes[some])

    return run


def _move_words(kind_of: np.ndarray, share_of: np.ndarray, rounds: int, l2: float):
    """Weights of the pairs of some contexts, by gradient steps scaled by the curvature, and logs of the normalisers, each with its count."""

    def run(t: pa.Table) -> pa.Table:
        key, n = t["key"].to_numpy(), t["n"].to_numpy().astype(float)
        pair = key >> 60 == PAIR
        low = (1 << WIDE) - 1
        context, word, n_pair = (key[pair] & ((1 << 60) - 1)) >> WIDE, key[pair] & low, n[pair]
        group, at = np.unique(context << 5 | kind_of[word], return_inverse=True)
        after = key[~pair]
        order = np.argsort(name := (after & ((1 << 60) - 1)) >> WIDE << 5 | after & low)
        total = n[~pair][order][np.searchsorted(name[order], group)] if len(group) else np.zeros(0)
        share, theta = share_of[word], np.zeros(len(word))
        z = np.ones(len(group))
        for _ in range(rounds if len(group) else 0):
            p = share * np.exp(theta) / z[at]
            slope = n_pair - total[at] * p - l2 * theta
            theta = np.clip(theta + np.clip(slope / (total[at] * p + l2), -1, 1), -30, 30)
            z = 1 + np.bincount(at, weights=share * np.expm1(theta), minlength=len(group))
        name = np.concatenate(((PAIR << 60) + (context << WIDE) + word, (AFTER << 60) + (group >> 5 << WIDE) + (group & 31)))
        order = np.argsort(name)  # sorted keys take less room
        return pa.table({
            "key": pa.array(name[order]),
            "value": pa.array((np.concatenate((theta, np.log(np.maximum(z, 1e-300)))) / math.log(10)).astype(np.float32)[order]),
            "n": pa.array(np.concatenate((n_pair, total)).astype(np.int64)[order]),
        })

    return run


def train_words(events: DataFrame, head: Head, rounds: int = 60, l2: float = 1.0) -> DataFrame:
    """(key, value, n): weights of pairs, logs of the normalisers of contexts and classes, and their counts; logs to base 10."""
    context = F.shiftright(F.col("key").bitwiseAND((1 << 60) - 1), WIDE)
    wanted = events.where(F.shiftright("key", 60) != CLASS_OF)
    parts = max(1, math.ceil(wanted.count() / 200_000))
    grouped = wanted.groupBy(F.pmod(F.xxhash64(context), F.lit(parts)))
    return stage(grouped.applyInArrow(T.lean_table(_move_words(head.kind_of, head.share_of, rounds, l2)), "key long, value float, n long"), "weights", keep=True, codec="zstd")


def _gradient(weights):
    def run(batches):
        grad, loss, seen = np.zeros((N_FEATURES, CLASSES)), 0.0, False
        for b in batches:
            history = T.column(b, "history").to_numpy()
            n = np.stack([T.column(b, f"n{c}").to_numpy() for c in range(CLASSES)], axis=1).astype(float)
            logp = _log_softmax(weights.value, history)
            loss -= float((n * logp).sum())
            slope = n.sum(axis=1, keepdims=True) * np.exp(logp) - n
            for f in _features(history).T:
                np.add.at(grad, f, slope)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], names=["loss", "grad"])

    return run


def train_classes(histories: DataFrame, rounds: int, rate: float, l2: float) -> np.ndarray:
    """Weights of the class model by distributed gradients with per-weight step sizes.

    The table of histories has at most BUCKETS ** 2 rows whatever the corpus, and one gradient a task goes to the driver.
    """
    sc = histories.sparkSession.sparkContext
    total = sum(histories.agg(*(F.sum(f"n{c}") for c in range(CLASSES))).first()[c] or 0 for c in range(CLASSES))
    weights, square = np.zeros((N_FEATURES, CLASSES)), np.full((N_FEATURES, CLASSES), 1e-10)
    for _ in range(rounds if total else 0):
        sent = sc.broadcast(weights)
        grad = np.zeros_like(weights)
        for r in histories.mapInArrow(_gradient(sent), "loss double, grad binary").collect():
            grad += np.frombuffer(r["grad"]).reshape(grad.shape)
        sent.destroy()
        grad = grad / total + l2 * weights
        square += grad * grad
        weights = weights - rate * grad / np.sqrt(square)
    return weights


class Tables(NamedTuple):
    """What does not travel with the model: counts (word, n) of all words, and weights (key, value) that are joined."""

    counts: DataFrame
    weights: DataFrame


def _bit(key: np.ndarray) -> np.ndarray:
    return T.mix(key.view(np.uint64)) >> np.uint64(64 - MAP_BITS)


def _bits(batches):
    """(place, bits): words of the bitmap that keys set."""
    for b in batches:
        bit = np.sort(_bit(T.column(b, "key").to_numpy()))
        if len(bit):
            place = bit >> np.uint64(6)
            first = _firsts(place)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(T.i64(place[first])), pa.array(T.i64(bits))], names=["place", "bits"])


def key_map(weights: DataFrame) -> np.ndarray:
    """Bitmap of keys; at most 1 << (MAP_BITS - 6) rows come to the driver."""
    told = weights.select("key").mapInArrow(_bits, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[told["place"].to_numpy()] = told["bits"].to_numpy()
    return out.view(np.uint64)


def _look(keys: np.ndarray, names: np.ndarray):
    """Places of names among sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    spot = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
    return spot, keys[spot] == names


class Model:
    def __init__(self, head: Head, log_class: np.ndarray, words: pa.Table, joined: np.ndarray, n: int, v: int, tail_n: int, tail_v: int):
        self.head, self.log_class, self.joined, self.n, self.v = head, log_class, joined, n, v
        key, value = words["key"].to_numpy(), words["value"].to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        cut = int(np.searchsorted(key, AFTER << 60))
        self.pairs, self.weights, self.after, self.norms = key[:cut], value[:cut], key[cut:], value[cut:]
        self.base = math.log10(n + v + 1)
        self.tail = math.log10(tail_n + tail_v + 1)

    def inside(self, at: np.ndarray, kind: np.ndarray, bounds: np.ndarray):
        """(shares, tokens, keys): log10 share of each word in its class after its context, as far as the model tells.

        Of words of the last class it is only what the context changes.  The keys, each of one token, are those that may
        be in the table of weights.
        """
        known = at >= 0
        out = np.zeros(len(at))
        out[known] = self.head.inside[at[known]]
        if not self.head.n_own:
            return out, np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.where(known, self.head.own[at], -1)
        context = _contexts(own, bounds, self.head.n_own)
        seen = np.flatnonzero(context >= 0)
        name = (AFTER << 60) + (context[seen] << WIDE) + kind[seen]
        spot, here = _look(self.after, name)
        out[seen[here]] -= self.norms[spot[here]]
        token, key = seen[~here], name[~here]
        seen = seen[own[seen] >= 0]
        name = (PAIR << 60) + (context[seen] << WIDE) + own[seen]
        spot, here = _look(self.pairs, name)
        out[seen[here]] += self.weights[spot[here]]
        token, key = np.concatenate((token, seen[~here])), np.concatenate((key, name[~here]))
        bit = _bit(key)
        maybe = np.flatnonzero(self.joined[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
        return out, token[maybe], key[maybe]


def train(
    docs: DataFrame, text_col: str = "text", max_head: int = MAX_HEAD, rounds: int = 25, rate: float = 0.5, l2: float = 1e-7,
    max_pairs: int = MAX_PAIRS, min_pair: int = MIN_PAIR,
):
    """(Model, Tables) from all rows of docs."""
    sc = docs.sparkSession.sparkContext
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = text.mapInArrow(T.lean(_count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "word-counts")
    # least count of a word that travels with the model: from a histogram of at most 8 * 64 levels
    level = F.floor(8 * F.log2("n")).cast("int")
    shape = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    n, v = sum(r["n"] for r in shape), sum(r["words"] for r in shape)
    room, floor = max_head, 1 << 30
    for r in sorted(shape, key=lambda r: -r["level"]):
        if r["words"] > room:
            break
        room, floor = room - r["words"], r["level"]
    top = counts.where(level >= floor).toArrow()
    head = Head(top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), min_pair)
    tail_n, tail_v = n - int(head.n.sum()), v - len(head.n)
    with scratch(docs.sparkSession):
        # a token makes at most two keys, and a history one more
        packs = text.mapInArrow(T.lean(_events(sc.broadcast(head), max(1, math.ceil(2 * n / PART)))), "part long, size long, blob binary")
        events = stage(packs.groupBy("part").applyInArrow(T.lean_table(_merge(min_pair)), "key long, n long"), "events", codec="zstd")
        kind = F.shiftright("key", 60)
        history, one = F.shiftright("key", WIDE).alias("history"), F.col("key").bitwiseAND((1 << WIDE) - 1)
        histories = events.where(kind == CLASS_OF).groupBy(history).agg(*(F.coalesce(F.sum(F.when(one == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in range(CLASSES)))
        weights = train_classes(stage(histories, "histories"), rounds, rate, l2)
        log_class = _log_softmax(weights, np.arange(BUCKETS * BUCKETS)) / math.log(10)
        words = train_words(events, head)
    often = F.col("n") >= math.ceil(n / max(1, max_pairs))
    rest = words.where(~often).select("key", "value")
    model = Model(head, log_class, words.where(often).select("key", "value").toArrow(), key_map(rest), n, v, tail_n, tail_v)
    return model, Tables(counts, rest)


def _score(model, halves):
    def run(batches):
        from pyspark import TaskContext

        m = model.value
        uid = TaskContext.get().partitionId() << 40
        log_n = np.log10(m.head.n + 1.0)
        for b in batches:
            ids = T.column(b, "doc_id")
            held = T.column(b, "held_out")
            for lo, hi, data, off in T.slices(T.column(b, "text")):
                h, bounds = _tokens(data, off)
                at, kind, bucket = m.head.look(h)
                known = at >= 0
                inside, token, key = m.inside(at, kind, bounds)
                base, score = np.zeros(len(h)), m.log_class[_histories(bucket, bounds), kind] + inside
                base[known] = log_n[at[known]]
                far = np.flatnonzero(~known)
                doc = np.searchsorted(bounds, far, side="right") - 1
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), pa.array(T.i64(h[far])))
                doc = np.searchsorted(bounds, token, side="right") - 1
                if hi - lo <= NARROW:
                    order = np.argsort(doc << 46 | (key >> 60 == AFTER).astype(np.int64) << 45 | key & (1 << 45) - 1)
                else:
                    order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
                doc, key, times = doc[first], key[first], np.diff(np.append(first, len(key))).astype(np.int32)
                lists = []
                for half in range(halves):
                    some = key % halves == half
                    cut = pa.array(np.searchsorted(doc[some], np.arange(hi - lo + 1)).astype(np.int32))
                    lists += [pa.ListArray.from_arrays(cut, pa.array(x[some])) for x in (key, times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(hi - lo)), ids.slice(lo, hi - lo), held.slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(T.seg_sum(known.astype(np.int64), bounds)),
                     pa.array(np.add.reduceat(base, bounds[:-1])), pa.array(np.add.reduceat(score, bounds[:-1])), tail, *lists],
                    names=["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "tail", *(f"{x}{half}" for half in range(halves) for x in ("keys", "times"))],
                )
                uid += hi - lo

    return run


def score(docs: DataFrame, model: Model, tables: Tables, id_col: str = "doc_id", text_col: str = "text", held_out: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10 probabilities of whole texts."""
    spark = docs.sparkSession
    flag = F.col(held_out) if held_out else F.lit(False)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), flag.alias("held_out"))
    kinds = "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double, tail array<long>"
    kinds += "".join(f", keys{half} array<long>, times{half} array<int>" for half in range(HALVES))
    drop_shuffles(spark)  # what training has shuffled
    scored = stage(rows.mapInArrow(T.lean(_score(spark.sparkContext.broadcast(model), HALVES)), kinds), "scored")
    tail = scored.select("uid", F.explode("tail").alias("word")).groupBy("uid", "word").agg(F.count(F.lit(1)).alias("k"))
    tail = tail.join(tables.counts, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.groupBy("uid").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known"), F.sum(F.col("k") * F.log10(c + 1)).alias("logs"), F.sum("k").alias("k"))
    tail = stage(tail, "tails")
    value = F.col("value").cast("double")
    sign = F.when(F.shiftright("key", 60) == AFTER, -value).otherwise(value)
    out, sums = scored.select("uid", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score").join(tail, "uid", "left"), []
    for half in range(HALVES):
        drop_shuffles(spark)  # those of rare words, then those of the keys before
        pairs = scored.select("uid", F.explode(F.arrays_zip(f"keys{half}", f"times{half}")).alias("x")).select("uid", F.col(f"x.keys{half}").alias("key"), F.col(f"x.times{half}").alias("times"))
        pairs = pairs.join(tables.weights.where(F.col("key") % HALVES == half), "key").groupBy("uid").agg(F.sum(F.col("times") * sign).alias(f"inside{half}"))
        out = out.join(pairs if half == HALVES - 1 else stage(pairs, "sums"), "uid", "left")
        del pairs
        sums.append(f"inside{half}")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + zero("known")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("logs") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"),
        (F.col("head_score") + sum(map(zero, sums), F.lit(0.0)) + zero("logs") - zero("k") * F.lit(model.tail)).alias("score"),
    )
