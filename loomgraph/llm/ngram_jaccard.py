"""N-gram Jaccard join by count vectors and R-trees.

A document is the set of its distinct k-word shingles (all its words as one
shingle when it has fewer; the empty set without words or text).  Two documents
link when ``100 * |A & B| >= percent * |A | B|``.  The join is exact:

1. Equal sets are one class.  Only classes are compared, so a group of copies
   of any size is one point.
2. Shingles are hashed into m groups.  A link of sizes a <= b differs in at most
   ``d = (100-percent) (a+b) / (100+percent)`` shingles, so of the groups that a
   document fills, any d+1 hold one that is equal in both.  The content of each group is a cell key.  A document with
   too few filled groups for that argument also takes part in finer groupings.  Cells are
   ordered by the number of classes that have them, and of a grouping a class keeps the d+1 first (d as for its own size): the first cell
   that two linked classes share has at most d cells of either before it, so both keep it.  The others are mostly cells
   of passages that many documents quote, which would make candidates of all that quote them.  Classes
   that keep a cell are candidates, and candidates hang together as a star around
   the smallest class of the cell, which is linear in the cell.
3. Connected candidates are compared through an R-tree over their group-count
   vectors.  The overlap of a query with anything below a node is at most the sum
   of the coordinate minima of the query and the node's upper corner.  Larger
   groups of candidates pass trees over their vectors first, which breaks them
   up before any set is shipped; the longer a set, the more groups it has, or
   else chance alone would bring long sets together.  Then sets are gathered,
   indexed anew, and what survives at a leaf is verified.  Pairs that are already
   connected are skipped, because only components are asked for.
4. Tasks are dealt by the number of shingles, not of documents.  Candidates of
   one component beyond ``block`` shingles are split over tasks by pairs of
   blocks, so a task holds about two blocks (or two sets, if they are longer).

Defined cases: null and empty texts have 0 shingles and link with nothing; equal
rows link with each other; an empty table gives an empty result; columns other
than the id and the text are ignored.  Every row is a document: rows with one id
and different texts are compared each for itself and get a row each, and rows
that repeat both id and text stay or go together.  Rows with a null id take part
in links (a component of such rows alone has a null id) and are never removed.
Texts may have any length; a set and its vector are held by one task at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import components, free_names, stage

#: Groups of a stored vector by size of the set: (size below, groups).  Each is a multiple of the one before, so a vector folds.
GROUPS = ((256, 64), (1024, 256), (4096, 1024), (1 << 62, 4096))
REFINE_ABOVE = 32
BLOCK = 2 << 20  # shingles (of 8 bytes) or groups of vectors in a block
KEYS_PER_PART = 1_000_000
FLUSH_KEYS = 1_000_000
#: Of a cell that has more rows than this in a task, one row goes to the part of the cell.
CELL_ROWS = 1024


def _sets(data, off, k):
    """Sorted distinct shingle hashes of all documents of a slice, and each document's range."""
    w = T.Words(data, off)
    h = w.hashes()
    s, at = T.grams(h, w.bounds, k)
    n_words = w.counts()
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    count = np.diff(at)
    count[short] = 1
    bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(bounds[-1], np.uint64)
    out[T.spread(bounds[:-1][count > 0], np.where(n_words >= k, count, 0)[count > 0])] = s
    for i in short:
        own = h[w.bounds[i] : w.bounds[i + 1]]
        out[bounds[i]] = T.mix((own * T._GRAM[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    for i in np.flatnonzero(count > 1):
        out[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][count > 0]] = True
    size = np.add.reduceat(keep, bounds[:-1][count > 0]) if keep.any() else np.zeros(0, int)
    full = np.zeros(len(count), np.int64)
    full[count > 0] = size
    return out[keep], np.concatenate(([0], np.cumsum(full)))


def _group(u, groups):
    return (T.mix(u) % np.uint64(groups)).astype(np.int64)


def _vectors(u, bounds) -> list[bytes]:
    """Group counts of each set, two bytes a group, four if the set is that large."""
    n = np.diff(bounds)
    groups = np.array([g for _, g in GROUPS])[np.searchsorted([b for b, _ in GROUPS], n, side="right")]
    base = np.concatenate(([0], np.cumsum(groups)))
    row = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(base[row] + (T.mix(u) % groups[row].astype(np.uint64)).astype(np.int64), minlength=base[-1])
    return [counts[a:z].astype("<u2" if k < 65536 else "<u4").tobytes() for a, z, k in zip(base[:-1], base[1:], n)]


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if len(blob) > 2 * GROUPS[-1][1] else "<u2")


def _class_ids(u, bounds):
    n = np.diff(bounds).astype(np.uint64)
    one = T.seg_sum(T.mix(u ^ np.uint64(0x51ED270B9F8A1C35)), bounds)
    two = T.seg_sum(T.mix(u + np.uint64(0x2545F4914F6CDD1D)), bounds)
    return T.mix(one + n * np.uint64(0x9E3779B97F4A7C15)), T.mix(two ^ n)


class Bands:
    """Size bands: any two sizes that can link share one, and d bounds what such sets differ in."""

    def __init__(self, percent: int, top: int, factor: float = 1.5):
        self.percent, edges = percent, [1]
        while edges[-1] <= top:
            edges.append(max(edges[-1] + 1, int(edges[-1] * factor)))
        self.lo = np.array(edges[:-1], np.int64)
        self.hi = np.array(edges[1:], np.int64) - 1
        self.reach = self.hi * 100 // percent
        self.d = (100 - percent) * (self.hi + self.reach) // (100 + percent)

    def of_size(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """What a set of size n and one that it links with, by this band, differ in at most."""
        return (100 - self.percent) * (n + np.minimum(n * 100 // self.percent, self.reach[band])) // (100 + self.percent)

    def of(self, n: np.ndarray):
        """(index into n, band) of every band that a size takes part in."""
        own = np.searchsorted(self.lo, n, side="right") - 1
        rows, bands = [np.arange(len(n))], [own]
        for back in range(1, len(self.lo)):
            j = own - back
            ok = np.flatnonzero((j >= 0) & (n <= self.reach[np.maximum(j, 0)]))
            if not len(ok):
                break
            rows.append(ok)
            bands.append(j[ok])
        return np.concatenate(rows), np.concatenate(bands)


def _cell_keys(u, bounds, percent):
    """(document, key) of all cells of the documents of a slice."""
    return _marked_keys(u, bounds, percent)[:2]


def _marked_keys(u, bounds, percent):
    """(document, key, mark) of all cells of the documents of a slice.

    A mark is 256 * the grouping (from 1 on) + the cells beyond d+1 that the document has in it, 255 at most; d is here of its own size.
    """
    n = np.diff(bounds)
    # the closest different sets of size n are n and n + 1, or n - 1 and n: one inside the other
    live = np.flatnonzero((n > 0) & (100 * n >= percent * (n + 1)))
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    bands = Bands(percent, int(n[live].max()))
    row, band = bands.of(n[live])
    doc = live[row]
    docs, keys, marks = [], [], []
    for level in range(3):
        d, own = bands.d[band], bands.of_size(n[doc], band)
        m = (d + 1 + (d + 8) // 8 + 3) if level == 0 else 4 * (d + 1) + 64
        if level == 2:
            m = np.full(len(d), 1 << 40, np.int64)
        at = T.spread(bounds[doc], n[doc])
        e = np.repeat(np.arange(len(doc)), n[doc])
        x = T.mix(u[at] + (band[e] * 4 + level).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        if level == 2:
            docs.append(doc[e])
            keys.append(T.mix(x))
            marks.append(_marks(band * 4 + level, n[doc] - own - 1)[e])
            break
        base = np.concatenate(([0], np.cumsum(m)))
        slot = base[e] + ((x >> np.uint64(20)) % m[e].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, T.mix(x ^ np.uint64(0xA24BAED4963EE407)))
        filled = np.flatnonzero(total)
        owner = np.searchsorted(base, filled, side="right") - 1
        tag = ((filled - base[owner]) * 256 + band[owner] * 4 + level).astype(np.uint64)
        docs.append(doc[owner])
        keys.append(T.mix(total[filled] + tag * np.uint64(0xC2B2AE3D27D4EB4F)))
        full = np.bincount(owner, minlength=len(doc))
        marks.append(_marks(band * 4 + level, full - own - 1)[owner])
        few = np.flatnonzero(full <= d)
        if not len(few):
            break
        doc, band = doc[few], band[few]
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(marks)


def _marks(grouping, spare):
    return ((grouping + 1) * 256 + np.clip(spare, 0, 255)).astype(np.uint16)


def _points(k, percent, id_col, text_col):
    def run(batches):
        for b in batches:
            ids, keys = T.column(b, id_col), T.column(b, "key")
            for lo, hi, data, off in T.slices(T.column(b, text_col)):
                u, at = _sets(data, off, k)
                one, two = _class_ids(u, at)
                vec = pa.array(_vectors(u, at), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), keys.slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(T.i64(one)), pa.array(T.i64(two)), vec],
                    names=["doc_id", "key", "n", "cid", "cid2", "counts"],
                )
    return run


def _cells(k, percent, parts, text_col):
    """Cells of all distinct sets of a task, packed by the part that gathers them."""

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0
        for b in batches:
            for _, _, data, off in T.slices(T.column(b, text_col)):
                u, at = _sets(data, off, k)
                one, _ = _class_ids(u, at)
                new = np.zeros(len(one), bool)
                for i, c in enumerate(one.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[i] = True
                n = np.where(new, np.diff(at), 0)
                u = u[np.repeat(new, np.diff(at))]
                doc, key, mark = _marked_keys(u, np.concatenate(([0], np.cumsum(n))), percent)
                if len(key):
                    held.append((key, T.i64(one)[doc], mark))
                    size += len(key)
                if size >= FLUSH_KEYS:
                    yield _cell_packs(*map(np.concatenate, zip(*held)), parts)
                    held, size = [], 0
        if held:
            yield _cell_packs(*map(np.concatenate, zip(*held)), parts)
    return run


def _cell_packs(key, cid, mark, parts):
    """Packs of (cell, class, mark) by part.  A cell's number is its part and 32 bits of its key.

    The rows of a cell with more than CELL_ROWS rows become a cell of their own, whose smallest class also stands for them
    in the cell that other tasks share, so a hot cell has few rows of each task.  These rows have mark 0, which keeps them,
    as have rows of a class whose cells got one number.  As their place in the order is not known, the class drops one
    other cell of the grouping less for each.
    """
    number = lambda x: T.i64(x % np.uint64(parts) << np.uint64(32) | x >> np.uint64(32))
    cell = number(key)
    order = np.argsort(cell)
    cell, cid, mark = cell[order], cid[order], mark[order]
    keep = np.zeros(len(cell), bool)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    count = np.diff(np.append(first, len(cell)))
    if (hot := count > CELL_ROWS).any():
        low, keep = np.minimum.reduceat(cid, first), np.repeat(hot, count)
        own = number(T.mix(cell.view(np.uint64) ^ T.mix(np.repeat(low, count).view(np.uint64))))
        cell = np.concatenate((np.where(keep, own, cell), cell[first[hot]]))
        cid, mark = np.concatenate((cid, low[hot])), np.concatenate((mark, np.zeros(hot.sum(), np.uint16)))
        keep = np.concatenate((keep, np.ones(hot.sum(), bool)))
        order = np.argsort(cell)
        cell, cid, mark, keep = cell[order], cid[order], mark[order], keep[order]
    same = cell[1:] == cell[:-1]
    many = np.flatnonzero(np.append(same, False) | np.append(False, same))
    many = many[np.lexsort((cid[many], cell[many]))]
    again = np.flatnonzero((np.diff(cell[many]) == 0) & (np.diff(cid[many]) == 0))
    keep[many[again]] = keep[many[again + 1]] = True
    if keep.any():
        group = (mark >> 8).astype(np.int64)
        order = np.lexsort((group, cid))
        run = np.cumsum((np.diff(cid[order], prepend=~cid[order[:1]]) != 0) | (np.diff(group[order], prepend=-1) != 0)) - 1
        less = np.bincount(run, weights=keep[order])[run].astype(np.int64)
        mark[order] = mark[order] - np.minimum(less, mark[order] & 255).astype(np.uint16)
        mark[keep] = 0
    return _packs(cell >> 32, keys=cell.astype(np.uint32), cids=cid, marks=mark)


def _packs(part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part: bytes of what it gets of each column."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order].astype(np.int64), {name: x[order] for name, x in columns.items()}
    cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, int)
    blobs = [pa.array([x[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *blobs], names=["part", *columns])


def _open(t: pa.Table, **kinds) -> list[np.ndarray]:
    """Columns of all packs of a part."""
    return [np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()]) for name, kind in kinds.items()]


def _shared(parts):
    """Cells of a part that several classes have: cell, class, mark and the number of classes, packed by class."""

    def run(t: pa.Table) -> pa.Table:
        key, cid, mark = _open(t, keys=np.uint32, cids=np.int64, marks=np.uint16)
        order = np.argsort(key)
        same = np.diff(key[order].astype(np.int64)) == 0
        order = order[np.append(same, False) | np.append(False, same)]
        key, cid, mark = key[order], cid[order], mark[order]
        order = np.lexsort((mark, cid, key))
        key, cid, mark = key[order].astype(np.int64), cid[order], mark[order]
        # rows that repeat a class come from its copies in several tasks
        one = (np.diff(key, prepend=-1) != 0) | (np.diff(cid, prepend=0) != 0)
        key, cid, mark = key[one], cid[one], mark[one]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(np.append(first, len(key)))
        n = np.repeat(n, n)
        some = n > 1
        cell = (int(t["part"][0].as_py()) << 32) + key[some]
        to = T.mix(cid[some].view(np.uint64)) % np.uint64(parts)
        return pa.Table.from_batches([_packs(to, cells=cell, cids=cid[some], marks=mark[some], counts=n[some].astype(np.uint32))])

    return run


def _first_cells(parts):
    """Cells that the classes of a part keep: of each grouping all but the last spare ones, by number of classes; packed by cell."""

    def run(t: pa.Table) -> pa.Table:
        cell, cid, mark, n = _open(t, cells=np.int64, cids=np.int64, marks=np.uint16, counts=np.uint32)
        group = (mark >> 8).astype(np.int64)
        order = np.lexsort((cell, n, group, cid))
        cell, cid, mark, group = cell[order], cid[order], mark[order], group[order]
        first = np.flatnonzero((np.diff(cid, prepend=~cid[:1]) != 0) | (np.diff(group, prepend=-1) != 0))
        size = np.diff(np.append(first, len(cell)))
        spare = np.minimum.reduceat((mark & 255).astype(np.int64), first) if len(first) else size
        keep = np.arange(len(cell)) < np.repeat(first + size - spare, size)
        cell, cid = cell[keep], cid[keep]
        return pa.Table.from_batches([_packs(T.mix(cell.view(np.uint64)) % np.uint64(parts), cells=cell, cids=cid)])

    return run


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different classes."""
    some = a != b
    a, b = a[some], b[some]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _stars(t: pa.Table) -> pa.Table:
    """Candidate links of one part: each class with the smallest class of its cell."""
    cell, cid = _open(t, cells=np.int64, cids=np.int64)
    order = np.argsort(cell)
    cell, cid = cell[order], cid[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    low = np.repeat(np.minimum.reduceat(cid, first), np.diff(np.append(first, len(cell)))) if len(cell) else cid
    a, b = _distinct(low, cid)
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


class CountRTree:
    """A packed R-tree over group-count vectors: leaves of ``leaf`` points, nodes of ``fan`` leaves.

    Boxes, and the first look at a point, use vectors folded to a quarter of the groups, whose minima sum to no
    less; what passes is bounded by the whole vectors.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int, leaf: int = 32, fan: int = 16):
        # no sum of counts exceeds the size of its set, so 16 bits do exactly where all sizes fit them
        self.sum_type = np.uint16 if sizes.max() < 65536 else np.int64
        counts = counts.astype(self.sum_type)
        self.counts, self.sizes, self.percent = counts, sizes, percent
        self.leaf, self.fan = leaf, fan
        groups = counts.shape[1]
        fold = 4 if groups >= 256 else 1
        self.coarse = counts.reshape(len(sizes), fold, groups // fold).sum(axis=1, dtype=counts.dtype) if fold > 1 else counts
        cut = np.arange(0, len(sizes), leaf)
        self.leaf_hi = np.maximum.reduceat(self.coarse, cut)
        self.leaf_lo_n = np.minimum.reduceat(sizes, cut)
        self.leaf_hi_n = np.maximum.reduceat(sizes, cut)
        cut = np.arange(0, len(self.leaf_lo_n), fan)
        self.node_hi = np.maximum.reduceat(self.leaf_hi, cut)
        self.node_lo_n = np.minimum.reduceat(self.leaf_lo_n, cut)
        self.node_hi_n = np.maximum.reduceat(self.leaf_hi_n, cut)

    def _pass(self, q, n, corner, lo_n, hi_n):
        """Rows that may hold a partner: sizes in reach, and summed coordinate minima at least the overlap a link needs."""
        p = self.percent
        small = np.maximum(lo_n, -(-n * p // 100))
        ok = np.flatnonzero((hi_n >= -(-n * p // 100)) & (lo_n * p <= 100 * n))
        if len(ok):
            bound = np.minimum(corner[ok], q).sum(axis=1, dtype=self.sum_type).astype(np.int64)
            ok = ok[bound * (100 + p) >= p * (n + small[ok])]
        return ok

    def search(self, i: int) -> np.ndarray:
        """Points before i that the bounds can't exclude as partners of point i."""
        q, n, until = self.coarse[i], int(self.sizes[i]), i
        nodes = self._pass(q, n, self.node_hi, self.node_lo_n, self.node_hi_n)
        nodes = nodes[nodes * self.leaf * self.fan < until]
        leaves = T.spread(nodes * self.fan, np.minimum(self.fan, len(self.leaf_lo_n) - nodes * self.fan))
        if len(leaves) == 0:
            return leaves
        ok = self._pass(q, n, self.leaf_hi[leaves], self.leaf_lo_n[leaves], self.leaf_hi_n[leaves])
        leaves = leaves[ok]
        points = T.spread(leaves * self.leaf, np.minimum(self.leaf, len(self.sizes) - leaves * self.leaf))
        points = points[points < until]
        points = points[self._pass(q, n, self.coarse[points], self.sizes[points], self.sizes[points])]
        if self.coarse is not self.counts and len(points):
            points = points[self._pass(self.counts[i], n, self.counts[points], self.sizes[points], self.sizes[points])]
        return points


def _order(sizes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Like sizes together, and inside those what ``near`` puts together: boxes of the packed tree are small."""
    return np.lexsort((near, (np.log(np.maximum(sizes, 1)) / np.log(1.05)).astype(np.int64)))


def _forest(tree: CountRTree, verify) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that pass the tree and ``verify(i, candidates) -> those that link``."""
    n = len(tree.sizes)
    parent = np.arange(n)
    out = []
    for i in range(1, n):
        if not tree.sizes[i]:
            continue
        near = tree.search(i)[::-1]
        while len(near := near[parent[near] != parent[i]]):
            some, near = near[:64], near[64:]
            for j in verify(i, some):
                a, b = parent[j], parent[i]
                if a != b:
                    parent[parent == max(a, b)] = min(a, b)
                    out.append((int(j), i))
    return out


def link_sets(sets: list[np.ndarray], percent: int, groups: int | None = None) -> list[tuple[int, int]]:
    """Links that join all that link, among sorted arrays of distinct hashes: a spanning forest, by R-tree and verification."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return []
    if groups is None:
        groups = int(min(512, max(32, 1 << int(np.median(sizes) // 4).bit_length())))
    order = _order(sizes, np.array([s[0] if len(s) else 0 for s in sets], np.uint64))
    sizes, sets = sizes[order], [sets[i] for i in order]
    owner = np.repeat(np.arange(len(sets)), sizes)
    counts = np.bincount(owner * groups + _group(np.concatenate(sets), groups), minlength=len(sets) * groups).reshape(len(sets), groups)

    def verify(i, some):
        at = np.concatenate([sets[j] for j in some])
        spot = np.minimum(np.searchsorted(sets[i], at), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][spot] == at).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
        return some[both * (100 + percent) >= percent * (sizes[i] + sizes[some])]

    return [(int(order[i]), int(order[j])) for i, j in _forest(CountRTree(counts, sizes, percent), verify)]


def close_vectors(counts: np.ndarray, near: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose vectors the bound lets link."""
    sizes = counts.sum(axis=1).astype(np.int64)
    order = _order(sizes, near)
    tree = CountRTree(counts[order], sizes[order], percent)
    return [(int(order[i]), int(order[j])) for i, j in _forest(tree, lambda i, some: some)]


def _ship_sets(k, text_col):
    def run(batches):
        for b in batches:
            keep = [b.schema.get_field_index(c) for c in ("task", "comp", "cid")]
            for lo, hi, data, off in T.slices(T.column(b, text_col)):
                u, at = _sets(data, off, k)
                blobs = [u[a:z].tobytes() for a, z in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in keep] + [pa.array(blobs, pa.binary())], names=["task", "comp", "cid", "shingles"])
    return run


def _by_component(link, column):
    """Links of each component of a task, as pairs of classes."""

    def run(t: pa.Table) -> pa.Table:
        comp = t["comp"].to_numpy()
        cid = t["cid"].to_numpy()
        data = t[column].to_pylist()
        order = np.lexsort((cid, comp))
        if len(order):  # rows that repeat a representative
            again = (np.diff(comp[order], prepend=comp[order[0]] - 1) == 0) & (np.diff(cid[order], prepend=cid[order[0]] - 1) == 0)
            order = order[~again]
        cut = np.append(np.flatnonzero(np.diff(comp[order], prepend=comp[order[0]] - 1)), len(order)) if len(comp) else []
        a, b = [], []
        for x, z in zip(cut[:-1], cut[1:]):
            rows = order[x:z]
            for i, j in link([data[r] for r in rows], cid[rows]):
                a.append(cid[rows[i]])
                b.append(cid[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _link_task(percent):
    return _by_component(lambda blobs, _: link_sets([np.frombuffer(x, np.uint64) for x in blobs], percent), "shingles")


def _refine_task(percent):
    def link(blobs, cid):
        if len(blobs) < 2:
            return []
        vectors = [_unpack(x) for x in blobs]
        kind = np.array([len(v) for v in vectors])
        size = np.array([int(v.sum(dtype=np.int64)) for v in vectors])
        out = []
        for top, groups in GROUPS:
            # those of this length, and longer ones that are near enough in size, folded to it
            at = np.flatnonzero((kind == groups) | (kind > groups) & (size * percent <= 100 * top))
            if len(at) > 1 and (kind[at] == groups).any():
                counts = np.stack([vectors[i].reshape(-1, groups).sum(axis=0, dtype=np.int64) for i in at])
                out += [(int(at[i]), int(at[j])) for i, j in close_vectors(counts, counts.argmax(axis=1), percent)]
        return out

    return _by_component(link, "counts")


def _deal(some: DataFrame, weight: Column, block: int) -> DataFrame:
    """some (cid, comp, ..) with a task, by weight: components up to a block are packed together, larger ones meet by pairs of blocks."""
    some = some.withColumn("weight", weight)
    sizes = some.groupBy("comp").agg(F.sum("weight").alias("size"))
    packs = max(1, math.ceil((sizes.agg(F.sum("size")).first()[0] or 0) / block))
    some = some.join(sizes, "comp").drop("weight")
    small = some.where(F.col("size") <= block).withColumn("task", F.concat(F.lit("p"), F.pmod(F.xxhash64("comp"), F.lit(packs))))
    blocks = F.ceil(F.col("size") / block).cast("int")
    large = some.where(F.col("size") > block).withColumn("i", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    large = large.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.withColumn("task", F.concat_ws("_", "comp", F.least("i", "j"), F.greatest("i", "j"))).drop("i", "j")
    return small.unionByName(large).drop("size")


def _same_row(a: DataFrame, b: DataFrame):
    """Rows of a document: equal ids, null or not, and equal texts by their hash."""
    return (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def jaccard_components(
    docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """(doc_id, key, n_shingles, class_id, component_id) of every row; see the module's text.  key: xxhash64 of the text."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    kinds = "doc_id long, key long, n long, cid long, cid2 long, counts binary"
    members = stage(text.mapInArrow(T.lean(_points(k, percent, "doc_id", "text")), kinds), "members")
    # a class is represented by one row: that of its smallest id, or of a null id if it has no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r")
    classes = members.where("n > 0").groupBy("cid").agg(first, F.first("n").alias("n"), F.min("cid2").alias("x"), F.max("cid2").alias("y"))
    classes = stage(classes.select("cid", "r.doc_id", "r.key", "n", "x", "y"), "classes")
    told = classes.agg(F.sum("n").alias("n"), F.count_if(F.col("x") != F.col("y")).alias("clash")).first()
    if told["clash"]:
        raise RuntimeError("two different shingle sets have one 64-bit class id")
    parts = max(1, math.ceil(0.4 * (told["n"] or 0) / KEYS_PER_PART))
    cells = text.select("text").mapInArrow(T.lean(_cells(k, percent, parts, "text")), "part long, keys binary, cids binary, marks binary")
    fewer = max(1, parts // 4)
    cells = cells.groupBy("part").applyInArrow(T.lean_table(_shared(fewer)), "part long, cells binary, cids binary, marks binary, counts binary")
    cells = cells.groupBy("part").applyInArrow(T.lean_table(_first_cells(fewer)), "part long, cells binary, cids binary")
    near = components(cells.groupBy("part").applyInArrow(T.lean_table(_stars), "a long, b long")).withColumnsRenamed({"node": "cid", "root": "comp"})
    near = near.join(near.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "comp")
    near = stage(near.join(classes.select("cid", "doc_id", "key", "n"), "cid"), "candidates")
    many = near.where(F.col("size") > REFINE_ABOVE).drop("size")
    groups = F.lit(GROUPS[-1][1])
    for top, g in reversed(GROUPS[:-1]):
        groups = F.when(F.col("n") < top, g).otherwise(groups)
    deals = _deal(many, groups, 2 * block)  # vectors are narrower than sets
    short = members.select("doc_id", "key", "counts")
    deals = deals.join(short, _same_row(deals, short)).select("task", "comp", "cid", "counts")
    finer = deals.groupBy("task").applyInArrow(T.lean_table(_refine_task(percent)), "a long, b long")
    finer = components(finer).withColumnsRenamed({"node": "cid", "root": "comp"}).join(classes.select("cid", "doc_id", "key", "n"), "cid")
    some = stage(near.where(F.col("size") <= REFINE_ABOVE).drop("size").unionByName(finer), "candidates")
    ships = _deal(some, F.col("n"), block)
    ships = ships.join(text, _same_row(ships, text)).select("task", "comp", "cid", "text")
    links = ships.mapInArrow(T.lean(_ship_sets(k, "text")), "task string, comp long, cid long, shingles binary")
    links = links.groupBy("task").applyInArrow(T.lean_table(_link_task(percent)), "a long, b long")
    roots = components(links).withColumnsRenamed({"node": "cid"})
    ids = classes.select("cid", "doc_id").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    low = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(low, "root").select("cid", "component_id")
    return members.join(ids, "cid", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args) -> DataFrame:
    """The documents, one of each group of linked ones: the one with the smallest id."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **args)
    gone = found.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id", "key").distinct()
    (key,) = free_names(docs.columns, "text_key")
    rows = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    same = (rows[id_col].cast("long") == gone["doc_id"]) & (rows[key] == gone["key"])
    return rows.join(gone, same, "left_anti").select(*docs.columns)
