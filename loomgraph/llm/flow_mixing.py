"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a
document belongs to).  A flow network with one node for each pattern and one for
each source routes words of patterns to source quotas; the first use of a
pattern's words is free, each further use dearer than the last one, so
repetition is spread evenly and used only where a quota needs it.  The flow is
solved over patterns and sources, never over documents.  Up to ``MAX_PATTERNS``
patterns it is solved on the driver.  Beyond that the quotas are found by
aggregations over the table of sources, and as the flow falls apart into the
groups of patterns that share sources, a pattern that shares its one source with
no other is planned by an expression and every other group by a task of its own;
both ways give the same plan.  A pattern's flow then fixes how often each of its
documents is taken: the whole number of times for all, and once more for
documents in a seeded hash order, class by class of sizes, up to the rest.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and
share the words of all documents; a target stops at ``max_repeat`` times its
source's words, and the excess is shared anew by weight among the others.

Defined cases: a null text has size 0 and is taken 0 or more times at no words;
a document without any source belongs to the null source; rows of equal id and
text are chosen alike; columns of any name pass through; an empty table gives an
empty result; texts may have any length.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, free_names, join_spread, stage

#: So many patterns are planned on the driver; more are planned by the cluster.
MAX_PATTERNS = 1000
#: Size classes of a pattern and bins of the seeded order: at most 64 * BINS sums for a pattern.
BINS = 1024
#: Patterns whose cuts one task finds at a time.
PACK = 200


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: list[int], max_repeat: int) -> dict:
    """Source -> target words (exact fractions)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > max_repeat * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = Fraction(max_repeat * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """Flow of each edge (from, to, capacity, cost >= 0) in a cheapest greatest flow from s to t: successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    height = [0] * n
    while True:
        dist, via = {s: 0}, {}
        heap = [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in graph[x]:
                if cap[e] and d + cost[e] + height[x] - height[to[e]] < dist.get(to[e], float("inf")):
                    dist[to[e]] = d + cost[e] + height[x] - height[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (dist[to[e]], to[e]))
        if t not in dist:
            return [cap[2 * i + 1] for i in range(len(edges))]
        far = max(dist.values())
        for x in range(n):
            height[x] += dist.get(x, far)
        path, x = [], t
        while x != s:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: dict[tuple, int], quota: dict, max_repeat: int, sources=lambda p: p) -> dict[tuple, dict]:
    """Pattern -> {source: words}: the cheapest flow of words to quotas, with the k-th use of a pattern's words at cost k(k-1)/2.

    sources: the sources of a pattern, if the pattern is not the tuple of them.
    """
    names = list(patterns)
    at = {s: 1 + len(names) + i for i, s in enumerate(quota)}
    end = 1 + len(names) + len(quota)
    edges = [(0, 1 + i, patterns[p], k * (k + 1) // 2) for i, p in enumerate(names) for k in range(max_repeat)]
    start = len(edges)
    arcs = [(p, s) for p in names for s in sources(p)]
    edges += [(1 + i, at[s], max_repeat * patterns[p], 0) for i, p in enumerate(names) for s in sources(p)]
    edges += [(at[s], end, round(quota[s]), 0) for s in quota]
    flow = min_cost_flow(end + 1, edges, 0, end)
    out: dict[tuple, dict] = {p: {} for p in names}
    for (p, s), f in zip(arcs, flow[start:], strict=False):
        out[p][s] = f
    return out


PLAN = "pattern string, source_size double, target double, full long, rest long"


def _plan_on_driver(sums: DataFrame, weights: list[int], max_repeat: int) -> DataFrame:
    """(pattern, source_size, target, full, rest): every document of a pattern is taken ``full`` times, and ``rest`` words once more."""
    told = sums.collect()
    found = {tuple(r["sources"]): r["n"] for r in told}
    name = {tuple(r["sources"]): r["pattern"] for r in told}
    source_size: dict = {}
    for p, n in found.items():
        for s in p:
            source_size[s] = source_size.get(s, 0) + n
    # words that belong to several sources count for the total once
    goal = targets_of(found, source_size, weights, max_repeat)
    flow = route(found, goal, max_repeat)
    plan = [
        (name[p], float(sum(source_size[s] for s in p)), float(sum(goal[s] for s in p)), sum(flow[p].values()) // n if n else 0, sum(flow[p].values()) % n if n else 0)
        for p, n in found.items()
    ]
    return sums.sparkSession.createDataFrame(plan, PLAN)


def _quotas(sums: DataFrame, weights: list[int], max_repeat: int) -> DataFrame:
    """(source, n, target, patterns) of each source, as ``targets_of`` has it; source is a JSON array of its name."""
    one = F.explode("sources").alias("name")
    table = sums.select("n", one).groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("patterns"))
    # ranks: ranges of names are tasks, in order; the number of tasks bounds what the driver sees
    table = table.repartitionByRange(F.col("name").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    table = stage(table, "sources")
    before, seen = [], 0
    for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("k")).orderBy("part").collect():
        before.append((r["part"], seen))
        seen += r["k"]
    before = F.broadcast(sums.sparkSession.createDataFrame(before, "part int, before long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("name").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = stage(table.join(before, "part").select(F.to_json(F.array("name")).alias("source"), "n", "patterns", weight.cast("decimal(38,0)").alias("w")), "weights")
    total, over = (int(x or 0) for x in (sums.agg(F.sum("n")).first()[0], table.agg(F.sum("n")).first()[0]))
    size = F.col("n").cast("decimal(20,0)") * max_repeat
    # a source is full if its share of what is left exceeds its words max_repeat times; a share only grows when others are full
    full, count = F.lit(False), -1
    while True:
        told = table.agg(F.count_if(full).alias("k"), F.sum(F.when(full, size)).alias("taken"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        left, rest = over - int(told["taken"] or 0), int(told["w"] or 0)
        if told["k"] == count or not rest:
            break
        count = told["k"]
        full = F.lit(left).cast("decimal(18,0)") * F.col("w").cast("decimal(10,0)") > F.lit(rest).cast("decimal(12,0)") * size.cast("decimal(22,0)")
    share = F.lit(left / rest if rest else 0.0) * F.col("w").cast("double")
    goal = F.when(full, size.cast("double")).otherwise(share) * F.lit(total / over if over else 0.0)
    return stage(table.select("source", "n", "patterns", goal.alias("target")), "quotas")


def _plan_on_cluster(sums: DataFrame, weights: list[int], max_repeat: int) -> DataFrame:
    """As _plan_on_driver, for any number of patterns and sources."""
    quotas = _quotas(sums, weights, max_repeat)
    names = F.transform("sources", lambda x: F.to_json(F.array(x)))
    member = stage(sums.select("pattern", "n", F.explode(names).alias("source"), F.size("sources").alias("k")).join(quotas.withColumnRenamed("n", "source_size"), "source"), "members")
    alone = (F.col("k") == 1) & (F.col("patterns") == 1)
    flow = F.least(F.bround("target").cast("long"), max_repeat * F.col("n"))
    own = member.where(alone).select(
        "pattern", F.col("source_size").cast("double").alias("source_size"), "target",
        F.when(F.col("n") > 0, F.floor(flow / F.col("n"))).otherwise(0).cast("long").alias("full"), F.when(F.col("n") > 0, F.pmod(flow, F.col("n"))).otherwise(0).cast("long").alias("rest"),
    )
    shared = member.where(~alone)
    ids = F.xxhash64(F.lit("p"), "pattern").alias("a"), F.xxhash64(F.lit("s"), "source").alias("b")
    groups = components(shared.select(*ids)).withColumnsRenamed({"node": "a", "root": "part"})
    shared = shared.withColumn("a", ids[0]).join(groups, "a").select("part", "pattern", "n", "source", "source_size", "target")

    def solve(pdf):
        patterns, quota, sizes = {}, dict(zip(pdf["source"], pdf["target"])), dict(zip(pdf["source"], pdf["source_size"]))
        n = dict(zip(pdf["pattern"], pdf["n"]))
        of = {p: tuple(sorted(x)) for p, x in pdf.groupby("pattern")["source"]}
        patterns = {(p, *of[p]): int(n[p]) for p in sorted(of)}
        flow = route({k: v for k, v in patterns.items()}, quota, max_repeat, sources=lambda p: p[1:])
        rows = []
        for p, words in patterns.items():
            used = sum(flow[p].values())
            rows.append((p[0], float(sum(sizes[s] for s in p[1:])), float(sum(quota[s] for s in p[1:])), used // words if words else 0, used % words if words else 0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    return own.unionByName(shared.groupBy("part").applyInPandas(solve, PLAN))


def _cuts(told):
    """(pattern, class, last) from sums n of (pattern, class, bin, rest): the last bin of a class whose documents are taken once more.

    Each size class gives its share of the rest, in the order of bins.  What a class of long documents misses is
    carried to the next shorter one, so a pattern misses its words by less than one short bin.
    """
    edges = []
    for pattern, part in told.groupby("pattern"):
        rest, total, carry = int(part["rest"].iloc[0]), int(part["n"].sum()), 0.0
        for size_class in sorted(part["class"].unique(), reverse=True):
            own = part[part["class"] == size_class].sort_values("bin")
            sums = np.concatenate(([0], own["n"].cumsum()))
            need = rest * int(sums[-1]) / total + carry
            i = int(np.argmin(np.abs(sums - need)))
            carry = need - int(sums[i])
            edges.append((pattern, int(size_class), int(own["bin"].iloc[i - 1]) if i else -1))
    return pd.DataFrame(edges, columns=["pattern", "class", "last"])


def mix(
    docs: DataFrame, sources: Column, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, row_key, size, sources, source_size, target, copies, taken) for each row of docs.

    ``sources`` is an array column: what a document belongs to.  source_size and target are summed over the
    document's sources.  row_key is ``seeded`` by the id and the text, so that a rerun takes the same documents.
    """
    given = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    given = F.when(F.size(given) == 0, F.array(F.lit(None).cast("string"))).otherwise(given)
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("row_key"), n_words(F.col(text_col)).alias("size"), given.alias("sources"), F.to_json(given).alias("pattern")), "sizes")
    rows = rows.withColumn("class", F.length(F.bin("size"))).withColumn("bin", F.pmod(F.shiftrightunsigned("row_key", 24), F.lit(BINS)))
    told = stage(rows.groupBy("pattern", "class", "bin").agg(F.first("sources").alias("sources"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("n_rows")), "sums")
    sums = stage(told.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows")), "patterns")
    few = sums.limit(MAX_PATTERNS + 1).count() <= MAX_PATTERNS
    plan = (_plan_on_driver if few else _plan_on_cluster)(sums.drop("n_rows"), list(weights), max_repeat)
    plan = stage(plan, "plan")
    more = told.where("n > 0").join(plan.where("rest > 0").select("pattern", "rest"), "pattern").select("pattern", F.col("class").cast("int").alias("class"), "bin", "n", "rest")
    packs = max(1, plan.count() // PACK)
    cuts = more.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(packs))).applyInPandas(_cuts, "pattern string, class int, last long")
    cuts = cuts.groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("class", "last"))).alias("cuts"))  # at most 64 classes
    plan = stage(plan.join(cuts, "pattern", "left").join(sums.select("pattern", "n_rows"), "pattern"), "plan")
    rows = join_spread(rows, plan, "pattern", "n_rows")
    last = F.try_element_at("cuts", F.col("class").cast("int"))
    copies = F.col("full") + F.when((F.col("size") > 0) & F.coalesce(F.col("bin") <= last, F.lit(False)), 1).otherwise(0)
    return rows.select(
        "doc_id", "row_key", "size", "sources", F.col("source_size").cast("long").alias("source_size"), "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def targets_of(patterns: dict[tuple, int], source_size: dict, weights: list[int], max_repeat: int) -> dict:
    """Targets that share the words of all documents, each counted once."""
    total, over = sum(patterns.values()), sum(source_size.values())
    goal = targets(source_size, weights, max_repeat)
    if total == over:
        return goal
    return {s: g * total / over for s, g in goal.items()}


def take(docs: DataFrame, mixed: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as ``mixed`` took it."""
    key, take_id, times, copy = free_names(docs.columns, "row_key", "take_id", "copies", "copy")
    counts = mixed.where("copies > 0").groupBy("doc_id", "row_key").agg(F.max("copies").alias(times))
    kept = docs.withColumns({key: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), take_id: F.col(id_col).cast("long")})
    same = (kept[key] == counts["row_key"]) & kept[take_id].eqNullSafe(counts["doc_id"])
    both = kept.join(counts, same).select(*[kept[c] for c in docs.columns], counts[times])
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
