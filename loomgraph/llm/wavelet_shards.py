"""Token-id output: a wavelet matrix per shard.

A shard holds whole documents in ascending id order.  Its ids are stored as
bit-planes, the highest bit first; below each plane the ids are stably parted by
that bit.  Each plane has a count of ones for every 512 bits, so access to a
token, counting a token in a range and finding its i-th occurrence touch one
place of every plane and never need the ids themselves.

File of a shard, all little-endian: ``LWM2``, u8 bits, 3 zero bytes, u64 tokens,
u64 documents, u32 length of each frame; then the zstandard frames: one of i64
document ids and i64 ends of documents; for each plane one of u64 zeros and u32
ones before each block of 512 bits, and one for every 65,536 bits of the plane,
lowest first, in whole blocks.  A frame is inflated when it is first asked for,
so access, counting and lookup inflate a chunk or two of each plane.
Shards are rows of a Parquet table in shared storage (part, shard, figures,
file), so writing them is committed and retried like any Spark output, on any
store that Spark can write.

Defined cases: a null text is an empty one and holds only the end id; a null id is stored as the least 64-bit
value and sorts first; rows with the same id stand in the order of their texts, each as a document; an empty
table gives no shards; other columns are ignored; a vocabulary or an end id that needs more than ``bits`` bits is
an error.  A text of any length is one document of one shard.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import stage

MAGIC = b"LWM2"
BLOCK = 512
CHUNK = 1 << 16  # bits of a plane in a frame
NULL_ID = -(1 << 63)
SHARD_TOKENS = 1 << 20


class WaveletMatrix:
    """A sequence of ids below 2 ** bits."""

    def __init__(self, n: int, bits: int, zeros, planes, ranks):
        """zeros, planes and ranks: of each plane, its zeros, its bytes (an array, or a Plane) and the ones before each block."""
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        if n and int(ids.max()) >> bits:
            raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
        size = -(-max(n, 1) // BLOCK) * BLOCK
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)) != 0
            padded = np.zeros(size, bool)
            padded[:n] = one
            plane = np.packbits(padded, bitorder="little")
            each = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ranks.append((np.cumsum(each, dtype=np.uint32) - each).astype(np.uint32))
            z, parted = n - int(np.count_nonzero(one)), np.empty_like(now)
            np.compress(~one, now, out=parted[:z])
            np.compress(one, now, out=parted[z:])
            zeros.append(z)
            now = parted
        return cls(n, bits, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block = min(i // BLOCK, len(self.ranks[level]) - 1)
        part = np.unpackbits(self.planes[level][block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(self.ranks[level][block]) + int(part[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = (int(self.planes[level][i >> 3]) >> (i & 7)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value * 2 + bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, z = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + z) if (token >> (self.bits - 1 - level)) & 1 else (lo - a, hi - z)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before place i."""
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._range(token, 0, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return self.rank(token, self.n if hi is None else hi) - self.rank(token, lo)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = (token >> (self.bits - 1 - level)) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids.  Each plane sends places down; ids are gathered along them."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level][:], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            up = np.empty_like(out)
            out[z:] |= out.dtype.type(1 << (self.bits - 1 - level))
            up[np.flatnonzero(~one)] = out[:z]
            up[np.flatnonzero(one)] = out[z:]
            out = up
        return out


class Frames:
    """The frames of a file, each inflated once, when it is asked for."""

    def __init__(self, file: bytes, start: int, sizes: np.ndarray):
        import zstandard

        self.file, self.cuts = file, [start, *(start + np.cumsum(sizes, dtype=np.int64)).tolist()]
        self.inflate, self.open = zstandard.ZstdDecompressor().decompress, {}

    def __getitem__(self, i: int) -> bytes:
        if i not in self.open:
            self.open[i] = self.inflate(self.file[self.cuts[i] : self.cuts[i + 1]])
        return self.open[i]


class Plane:
    """The bytes of a bit-plane, by the frames that hold them."""

    def __init__(self, frames: Frames, first: int, size: int):
        self.frames, self.first, self.size = frames, first, size

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self.frames[self.first + at // (CHUNK // 8)][at % (CHUNK // 8)]
        lo, hi, _ = at.indices(self.size)
        if hi <= lo:
            return np.zeros(0, np.uint8)
        a, z = lo // (CHUNK // 8), (hi - 1) // (CHUNK // 8)
        raw = b"".join(self.frames[self.first + i] for i in range(a, z + 1))
        return np.frombuffer(raw, np.uint8)[lo - a * (CHUNK // 8) : hi - a * (CHUNK // 8)]


class Lazy:
    """A list whose items are parsed when they are asked for."""

    def __init__(self, of):
        self.of = of

    def __getitem__(self, i: int):
        return self.of(i)


def dump(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    import zstandard

    m = WaveletMatrix.build(ids, bits)
    press = zstandard.ZstdCompressor(level=1).compress
    frames = [press(doc_ids.astype("<i8").tobytes() + ends.astype("<i8").tobytes())]
    frames += [press(struct.pack("<Q", zeros) + rank.astype("<u4").tobytes()) for zeros, rank in zip(m.zeros, m.ranks)]
    for plane in m.planes:
        raw = plane.tobytes()
        frames += [press(raw[i : i + CHUNK // 8]) for i in range(0, len(raw), CHUNK // 8)]
    sizes = np.array([len(f) for f in frames], "<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<B3xQQ", bits, len(ids), len(doc_ids)), sizes, *frames])


def load(file: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(document ids, ends of documents, matrix) of a file; planes are inflated where they are read."""
    if file[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    bits, n, n_docs = struct.unpack_from("<B3xQQ", file, 4)
    size = -(-max(n, 1) // BLOCK) * BLOCK // 8
    each = -(-size // (CHUNK // 8))
    sizes = np.frombuffer(file, "<u4", 1 + bits + bits * each, 24)
    frames = Frames(file, 24 + sizes.nbytes, sizes)
    doc_ids, ends = np.frombuffer(frames[0], "<i8").reshape(2, n_docs)
    zeros = Lazy(lambda i: struct.unpack_from("<Q", frames[1 + i])[0])
    ranks = Lazy(lambda i: np.frombuffer(frames[1 + i], "<u4", offset=8))
    planes = [Plane(frames, 1 + bits + i * each, size) for i in range(bits)]
    return doc_ids, ends, WaveletMatrix(n, bits, zeros, planes, ranks)


#: Words that the quick way below may take: printable ASCII and Latin-1.
_SIMPLE = re.compile(r"[\x21-\x7e\xa1-\xff]+")
#: Fixed value: how the vocabulary's own file splits a word into pieces.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of letters whose first byte is 0xC3
_LATIN[[b for b in range(128, 192) if b not in (0x97, 0xB7)]] = True


def part_marks(w: T.Words) -> None:
    """Makes the last character of a word, an ASCII mark after a letter, a word of its own: pieces part there, whatever else the word holds."""
    last = w.end - 1
    one, two = w.data[np.maximum(last - 1, 0)], w.data[np.maximum(last - 2, 0)]
    cut = np.flatnonzero((last > w.start) & _MARK[w.data[last]] & (_LETTER[one] | _LATIN[one] & (two == 0xC3)))
    w.start, w.end = np.insert(w.start, cut + 1, last[cut]), np.insert(w.end, cut, last[cut])
    w.bounds = w.bounds + np.searchsorted(cut, w.bounds)


def byte_char(b: int) -> str:
    """The character that byte-level vocabularies write for a byte: itself if it is printable, else the next free one from 256 on."""
    printable = lambda c: 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255
    return chr(b) if printable(b) else chr(256 + sum(not printable(c) for c in range(b)))


class WordCache:
    """Token ids of texts whose words are encoded once, by the tokenizers library.

    Right for tokenizers that lower-case, drop ASCII white space and never join over it, as ``word_bpe_49k`` does;
    a text that may hold a special token is encoded as a whole.  A mark at the end of a word is a word of its own, so
    most words are known ones.  New words are encoded hundreds to a text, which
    costs a third of one by one; each piece of a word ends in one token with the end mark, so the pieces of the
    words are counted off.  A batch where the counts disagree is encoded word by word.  Words are found by one
    64-bit hash of their lower-cased bytes and confirmed by a second; a slice in which two words share the first
    but not the second is encoded as it stands.  At ``limit`` words the cache drops those that were used once, so its size is bounded whatever
    the corpus; a worker keeps it from task to task.
    """

    kept: dict[str, WordCache] = {}

    @classmethod
    def of(cls, path: str) -> WordCache:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def __init__(self, path: str, limit: int = 500_000, batch: int = 500):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.limit, self.batch = tokenizer.encode_batch_fast, limit, batch
        # the same model without its normaliser and splitter, for words that are one lower-case piece already
        plain = Tokenizer.from_file(path)
        plain.normalizer, plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.plain = plain.encode_batch_fast
        self.as_bytes = {b: byte_char(b) for b in range(256)}
        vocab = tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.pieces = regex.compile(_PIECES).findall
        self.clear()

    def clear(self):
        # hashes of the known words, sorted, and the place of each in bounds, used and check
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if self.closes.size <= 65536 else np.uint32)
        self.bounds = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)
        self.check = np.zeros(0, np.uint64)

    def _shrink(self):
        keep = np.flatnonzero(self.used > 1)
        size = np.diff(self.bounds)[keep]
        self.flat = self.flat[T.spread(self.bounds[keep], size)]
        self.bounds = np.concatenate(([0], np.cumsum(size)))
        moved = np.full(len(self.used), -1)
        moved[keep] = np.arange(len(keep))
        left = moved[self.place] >= 0
        self.names, self.place = self.names[left], moved[self.place[left]]
        self.used, self.check = self.used[keep] // 2, self.check[keep]
        if len(self.names) > self.limit // 2:
            self.clear()

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.encode(words, add_special_tokens=False)]
        return np.fromiter((i for g in got for i in g), np.int64), np.array([len(g) for g in got], np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of ASCII or Latin-1 letters: each is one piece, and composed already."""
        ready = [w if w.isascii() else w.lower().encode().decode("latin-1").translate(self.as_bytes) for w in words]
        ids = np.array(self.plain([" ".join(ready)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.encode([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        last = np.cumsum([len(self.pieces(w)) for w in words])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != last[-1] or ends[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(ends[last - 1], prepend=0)

    def _learn(self, new: list[str], check: np.ndarray) -> np.ndarray:
        """Takes in words; gives their places."""
        kinds: list[list[int]] = [[], [], []]
        for i, x in enumerate(new):
            if x.isalpha() and (x.isascii() or _SIMPLE.fullmatch(x)):
                kinds[0].append(i)
            else:
                kinds[1 if _SIMPLE.fullmatch(x) else 2].append(i)
        parts = []
        for found, way in zip(kinds, (self._letters, self._together, self._each)):
            parts += [way([new[i] for i in found[k : k + self.batch]]) for k in range(0, len(found), self.batch)]
        order = np.concatenate([np.array(x, np.int64) for x in kinds])
        place = np.empty(len(new), np.int64)
        place[order] = len(self.used) + np.arange(len(new))
        self.check = np.concatenate([self.check, check[order]])
        self.flat = np.concatenate([self.flat, *(ids.astype(self.flat.dtype) for ids, _ in parts)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate([n for _, n in parts]))])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        return place

    def encode_slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, how many each has)."""
        if b"<|" in (raw := data.tobytes()):
            parts = []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                special = b"<|" in raw[a:z]
                parts.append(self._each([raw[a:z].decode()]) if special else self.encode_slice(data[a:z], np.array([0, z - a])))
            return np.concatenate([ids.astype(self.flat.dtype) for ids, _ in parts]), np.concatenate([n for _, n in parts])
        w = T.Words(data, off)
        part_marks(w)
        if len(self.names) > self.limit:
            self._shrink()
        h, first, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
        check, spot = w.checks(), np.searchsorted(self.names, h)
        place = np.full(len(h), -1)
        old = np.flatnonzero(spot < len(self.names))
        old = old[self.names[spot[old]] == h[old]]
        place[old] = self.place[spot[old]]
        if (check != check[first][at]).any() or (self.check[place[old]] != check[first[old]]).any():
            parts = [self._each([raw[a:z].decode()]) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
            return np.concatenate([ids.astype(self.flat.dtype) for ids, _ in parts]), np.concatenate([n for _, n in parts])
        new = np.flatnonzero(place < 0)
        if len(new):
            spans = zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())
            place[new] = self._learn([raw[a:z].lower().decode() for a, z in spans], check[first[new]])
            self.names, self.place = np.insert(self.names, spot[new], h[new]), np.insert(self.place, spot[new], place[new])
        at = place[at]
        self.used += np.bincount(at, minlength=len(self.used))
        size = np.diff(self.bounds)[at]
        return self.flat[T.spread(self.bounds[at], size)], T.seg_sum(size, w.bounds)


def _write(path: str, end_id: int, bits: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        cache = WordCache.of(path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = before = 0

        def flush():
            docs, n, ids = (np.concatenate([h[i] for h in held]) for i in range(3))
            return len(ids), pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, shard, len(docs), len(ids), before)] + [pa.array([dump(docs, np.cumsum(n), ids, bits)], pa.binary())],
                names=["part", "shard", "n_docs", "n_tokens", "before", "file"],
            )

        for b in batches:
            doc_ids = T.column(b, "doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in T.slices(T.column(b, "text"), min(T.SLICE_BYTES, 2 * shard_tokens)):
                ids, n = cache.encode_slice(data, off)
                at = np.cumsum(n)
                held.append((doc_ids[lo:hi], n + 1, np.insert(ids, at, end_id).astype(np.uint16 if bits <= 16 else np.uint32)))
                size += len(ids) + hi - lo
                if size >= shard_tokens:
                    n, shard_row = flush()
                    yield shard_row
                    held, size, shard, before = [], 0, shard + 1, before + n
        if held:
            yield flush()[1]

    return run


def write_shards(
    docs: DataFrame, path: str, end_id: int = 1, bits: int = 16, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encodes whole texts, each closed by ``end_id``, and writes shards in ascending id order: (part, shard, n_docs, n_tokens, file, base).

    ``base`` is the number of ids before the shard.  A task holds one shard at a time; a document that is longer
    than ``shard_tokens`` makes a larger shard.
    """
    from tokenizers import Tokenizer

    top = max([end_id, *Tokenizer.from_file(path).get_vocab().values()])
    if top >> bits:
        raise ValueError(f"id {top} of the vocabulary needs more than {bits} bits")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = stage(rows.mapInArrow(T.lean(_write(path, end_id, bits, shard_tokens)), "part long, shard long, n_docs long, n_tokens long, before long, file binary"), "wavelet")
    # one figure for each task that wrote: bounded by the number of partitions, not by the rows or shards
    total, base = 0, []
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base.append((r["part"], total))
        total += r["n"]
    base = docs.sparkSession.createDataFrame(base, "part long, part_base long")
    return shards.join(F.broadcast(base), "part").withColumn("base", F.col("part_base") + F.col("before")).drop("part_base", "before")


def _read(batches):
    for b in batches:
        for row in b.to_pylist():
            doc_ids, ends, m = load(row["file"])
            ids = m.decode().astype("<u4")
            raw, starts = memoryview(ids.tobytes()), np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids), pa.array(row["base"] + starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digest(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards' files."""
    out = shards.select("base", "file").mapInArrow(T.lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(place, doc_id) of every occurrence of a token, by select on each shard's planes."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                doc_ids, ends, m = load(row["file"])
                at = np.array(m.occurrences(token), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["base"] + at), pa.array(doc_ids[np.searchsorted(ends, at, side="right")])], names=["place", "doc_id"])

    return shards.select("base", "file").mapInArrow(run, "place long, doc_id long")
