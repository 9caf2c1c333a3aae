"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards take up to their capacity; a byte that stays in the shard of its name costs
nothing, one that moves costs one. The network has an arc from each old shard to the new one of its name and one to a
hub, from which arcs lead to all new shards, so it grows with the number of shards and not with its square. The
optimal flow is realised document by document: an old shard's documents lie in the order of (block, hash), the bytes
that leave come first, and all that leaves, shard after shard, is one line that the new shards' shares cut. A document
goes to the share that its middle lies in and stays if it would pass the end of what leaves, so every new shard is
within its capacity up to one document, which is checked, and no more moves than the flow. Then the shards that lose or receive
are rewritten as files; shards that keep what they had are read from where they are.

Distribution. One pass sums bytes per (shard, block); the flow is solved on the driver from these sums, shards x blocks
numbers, which grow with the number of shards and not with the data. Only in blocks that a cut falls in, at most one a
shard and one a share, documents are put in order, without their texts; the cuts become ranges of hashes. Each document
finds its new shard by a join with the ranges, and only rewritten shards are shuffled, in parts of about PART bytes.

Defined results. A null shard name counts as NULL_NAME. A null text has no bytes; its document stays with its block.
Null doc_ids, empty and long texts need no rule; rows that repeat doc_id and text are one document and stay together.
Ties between shards go by name. Too little capacity raises ValueError. An empty table gives an
empty result. All columns are carried; shard and moved replace columns of these names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import fresh_path, sized, text_hash

BLOCKS, PART, NULL_NAME = 64, 128 << 20, "(null)"
MOST = (1 << 63) - 1
EVERY = (-MOST - 1, MOST)


class Network:
    """Minimum-cost flow by primal-dual: shortest distances, then a blocking flow along arcs of no reduced cost."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def _distances(self, s: int) -> list[float]:
        far = [float("inf")] * len(self.out)
        far[s] = 0
        queue, waits = deque([s]), [False] * len(self.out)
        while queue:
            a = queue.popleft()
            waits[a] = False
            for e in self.out[a]:
                b = self.to[e]
                if self.left[e] and far[a] + self.cost[e] < far[b]:
                    far[b] = far[a] + self.cost[e]
                    if not waits[b]:
                        waits[b] = True
                        queue.append(b)
        return far

    def solve(self, s: int, t: int) -> tuple[int, int]:
        """(flow, cost) of a maximum flow of minimum cost."""
        flow = cost = 0
        while (far := self._distances(s))[t] < float("inf"):
            while True:
                level, queue = {s: 0}, deque([s])  # breadth first, among arcs on shortest paths
                while queue:
                    a = queue.popleft()
                    for e in self.out[a]:
                        b = self.to[e]
                        if self.left[e] and b not in level and far[a] + self.cost[e] == far[b]:
                            level[b] = level[a] + 1
                            queue.append(b)
                if t not in level:
                    break
                at, path, a = dict.fromkeys(level, 0), [], s
                while True:
                    if a == t:
                        much = min(self.left[e] for e in path)
                        for e in path:
                            self.left[e] -= much
                            self.left[e ^ 1] += much
                        flow += much
                        cost += much * int(far[t])
                        path, a = [], s
                        continue
                    while at[a] < len(self.out[a]):
                        e = self.out[a][at[a]]
                        b = self.to[e]
                        if self.left[e] and level.get(b) == level[a] + 1 and far[a] + self.cost[e] == far[b]:
                            break
                        at[a] += 1
                    if at[a] < len(self.out[a]):
                        path.append(self.out[a][at[a]])
                        a = self.to[path[-1]]
                    elif path:
                        a = self.to[path.pop() ^ 1]
                        at[a] += 1
                    else:
                        break
        return flow, cost


def transfers(sizes: Mapping[str, int], capacities: Mapping[str, int]) -> dict[tuple[str, str], int]:
    """Bytes to move from old to new shards, the fewest that fit the capacities."""
    old, new = sorted(sizes), sorted(capacities)
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError(f"{sum(sizes.values())} bytes don't fit capacities of {sum(capacities.values())}")
    hub, t = 1 + len(old) + len(new), 2 + len(old) + len(new)
    net, number = Network(t + 1), {n: 1 + len(old) + j for j, n in enumerate(new)}
    leave, enter = {}, {}
    for i, n in enumerate(old):
        net.arc(0, 1 + i, sizes[n])
        if n in number:
            net.arc(1 + i, number[n], sizes[n])
        leave[n] = net.arc(1 + i, hub, sizes[n], 1)
    for n in new:
        enter[n] = net.arc(hub, number[n], capacities[n])
        net.arc(number[n], t, capacities[n])
    net.solve(0, t)
    out: dict[tuple[str, str], int] = {}
    rest = deque((n, f) for n in new if (f := net.flow(enter[n])))
    for n in old:
        much = net.flow(leave[n])
        while much:
            to, room = rest.popleft()
            part = min(much, room)
            out[n, to] = part
            much -= part
            if room > part:
                rest.appendleft((to, room - part))
    return out


Share = tuple[int, int, str]


def shares(flows: Mapping[tuple[str, str], int]) -> dict[str, list[Share]]:
    """Old shard -> (from, to, new shard): how the new shards cut the bytes that leave it."""
    enter: dict[str, int] = {}
    leave: dict[str, int] = {}
    for (old, new), much in sorted(flows.items()):
        leave[old] = leave.get(old, 0) + much
        enter[new] = enter.get(new, 0) + much
    out: dict[str, list[Share]] = {}
    rest = deque(enter.items())
    for old, much in leave.items():
        at = 0
        while at < much:
            new, room = rest.popleft()
            part = min(much - at, room)
            out.setdefault(old, []).append((at, at + part, new))
            at += part
            if room > part:
                rest.appendleft((new, room - part))
    return out


def block_moves(held: Mapping[str, Mapping[int, int]], cuts: Mapping[str, list[Share]], gone: set[str], spare: str) -> tuple[dict[tuple[str, int], str], dict[tuple[str, int], int]]:
    """Blocks that move whole, with their new shard, and those that a cut falls in, with the bytes before them.

    Of shards that no longer exist (gone) everything moves; what has no bytes goes with the last share, or to spare.
    """
    whole: dict[tuple[str, int], str] = {}
    split: dict[tuple[str, int], int] = {}
    for old in sorted(gone | set(cuts)):
        of, at = cuts.get(old, []), 0
        for b, much in sorted(held[old].items()):
            to = next((new for a, z, new in of if a <= at < z), None)
            if any(at < z < at + much for _, z, _ in of):
                split[old, b] = at
            elif to is not None:
                whole[old, b] = to
            elif old in gone:
                whole[old, b] = of[-1][2] if of else spare
            at += much
    return whole, split


def _split(units: DataFrame, cuts: Mapping[str, list[Share]], gone: set[str], split: Mapping[tuple[str, int], int]) -> list[Row]:
    """(__old, __block, __new, least, most, much, largest): the range of hashes in each split block that goes to a new shard, or stays (null)."""
    if not split:
        return []
    spark = units.sparkSession
    inside = spark.createDataFrame([(o, b, at) for (o, b), at in sorted(split.items())], "__in string, __nr int, __before long")
    units = units.join(sized(inside, len(split)), (F.col("__old") == F.col("__in")) & (F.col("__block") == F.col("__nr"))).groupBy("__old", "__block", "__before", "__hash").agg(F.sum("__bytes").alias("__bytes"))
    so_far = F.sum("__bytes").over(Window.partitionBy("__old", "__block").orderBy("__hash").rowsBetween(Window.unboundedPreceding, 0))
    units = units.withColumn("__end", F.col("__before") + so_far).withColumn("__middle", F.expr("__end - __bytes + __bytes div 2"))
    # a gone shard has no end: its last share takes the rest
    of = [(o, a, MOST if o in gone and z == cuts[o][-1][1] else z, MOST if o in gone else cuts[o][-1][1], n) for o in sorted({o for o, _ in split}) for a, z, n in cuts[o]]
    table = spark.createDataFrame(of, "__from string, __a long, __z long, __leaves long, __to string")
    units = units.join(sized(table, len(of)), (F.col("__old") == F.col("__from")) & (F.col("__middle") >= F.col("__a")) & (F.col("__middle") < F.col("__z")), "left")
    units = units.withColumn("__new", F.when(F.col("__end") <= F.col("__leaves"), F.col("__to")))
    return units.groupBy("__old", "__block", "__new").agg(F.min("__hash").alias("least"), F.max("__hash").alias("most"), F.sum("__bytes").alias("much"), F.max("__bytes").alias("largest")).collect()


def reshard(docs: DataFrame, capacities: Mapping[str, int] | None = None, *, shard: str = "source", extra: int = 4, slack: float = 1.05, blocks: int = BLOCKS) -> DataFrame:
    """docs with the name of each document's new shard, and whether it moved, after rewriting the affected shards.

    shard: the column that names the old shard. Without capacities: the old shards and ``extra`` new ones, each with
    room for an equal part of all bytes times ``slack``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(shard).cast("string"), F.lit(NULL_NAME)).alias("__old"), F.xxhash64(F.col("doc_id").cast("long"), text_hash("text")).alias("__hash"))
    rows = rows.withColumn("__block", F.pmod("__hash", F.lit(blocks)).cast("int"))
    length = F.coalesce(F.octet_length("__row.text"), F.lit(0)).cast("long")
    sums = rows.groupBy("__old", "__block").agg(F.sum(length).alias("__bytes")).collect()
    held: dict[str, dict[int, int]] = {}
    for r in sums:
        held.setdefault(r["__old"], {})[r["__block"]] = r["__bytes"]
    sizes = {n: sum(b.values()) for n, b in held.items()}
    if capacities is None:
        names = [*sizes, *(f"new-{i:03d}" for i in range(extra))]
        capacities = dict.fromkeys(names, int(sum(sizes.values()) * slack / max(1, len(names))) + 1)
    gone, cuts = set(sizes) - set(capacities), shares(transfers(sizes, capacities))
    whole, split = block_moves(held, cuts, gone, min(capacities, default=NULL_NAME))
    moves = [(o, b, *EVERY, n) for (o, b), n in sorted(whole.items())]
    size = dict(sizes)
    for (o, b), n in whole.items():
        size[o] -= held[o][b]
        size[n] = size.get(n, 0) + held[o][b]
    largest = 0
    for r in _split(rows.select("__old", "__block", "__hash", length.alias("__bytes")), cuts, gone, split):
        largest = max(largest, r["largest"])
        if r["__new"] is not None:
            moves.append((r["__old"], r["__block"], r["least"], r["most"], r["__new"]))
            size[r["__old"]] -= r["much"]
            size[r["__new"]] = size.get(r["__new"], 0) + r["much"]
    if over := {n: (size.get(n, 0), c) for n, c in capacities.items() if size.get(n, 0) > c + largest}:
        raise RuntimeError(f"shards over their capacity by more than a document of {largest} bytes: {over}")
    changed = sorted({m[0] for m in moves} | {m[4] for m in moves})
    table = spark.createDataFrame(moves, "__from string, __at int, __least long, __most long, __to string")
    placed = rows.join(sized(table, len(moves)), (F.col("__old") == F.col("__from")) & (F.col("__block") == F.col("__at")) & F.col("__hash").between(F.col("__least"), F.col("__most")), "left")
    keep = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "moved")]
    placed = placed.select(*keep, F.coalesce("__to", "__old").alias("shard"), F.col("__to").isNotNull().alias("moved"), F.xxhash64("__hash").alias("__part"))
    if not changed:
        return placed.drop("__part")
    parts = spark.createDataFrame([(n, max(1, -(-size.get(n, 0) // PART))) for n in changed], "__name string, __parts long")
    hit = placed.join(sized(parts, len(changed)), F.col("shard") == F.col("__name"))
    hit = hit.withColumn("__part", F.pmod("__part", "__parts")).repartition("shard", "__part").sortWithinPartitions("shard").drop("__name", "__parts", "__part")
    path = fresh_path(spark, "shards")
    # the folder of a shard is named by its number: names may hold anything
    numbers = F.create_map(*[F.lit(x) for i, n in enumerate(changed) for x in (n, i)])
    hit.withColumn("__number", numbers[F.col("shard")]).write.partitionBy("__number").parquet(path)
    files = spark.read.schema(hit.schema).parquet(path).select(*hit.columns)
    still = placed.drop("__part").join(sized(parts.select("__name"), len(changed)), F.col("shard") == F.col("__name"), "left_anti")
    return files.unionByName(still)
