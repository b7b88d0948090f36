"""Sharding (4): minimum-cost-flow resharding.

Given where documents lie now (old shards) and how many each new shard shall hold, move the fewest bytes. Each old
shard's documents fall into classes of sizes (quarters of a power of two). A flow network

    source -> (old shard, class) -> stay, at no cost, or move, at the class's mean bytes a row -> new shard -> sink

has the classes' rows as supplies and the new shards' row capacities as demands. Its minimum-cost flow, found on the
driver by successive shortest paths, says how many rows of each class stay and how many go where. Of a class that is
split between the two, the smallest rows go: the size at which it is split is found exactly, by counts in slices that
narrow, and the class is parted there into smaller, equal and larger rows. With these the flow is solved again, and its
bytes are the fewest that row capacities allow. Blocks, a class's rows in one bucket of a hash of doc_id, go to shards along it;
a few blocks are cut between shards, by the rank of their rows.
The network has about 2 x old shards x classes arcs whatever the number of documents.

``rewrite`` then writes the shards whose content changes: texts are shuffled once, to a shard's chunk, since a block's
shard is known where the text is read; only rows of cut blocks are first joined to their ranks. ``op4`` does so, into the
shared folder, and its rows are read from what was written (of shards that don't change, from the plan).

The query's old layout puts each source's documents into one shard (crc32 of the source's name), as a crawl writes
them; the law is ``rows``: the 24 new shards' counts are at most one apart. Equal texts are not tied together.

Defined cases: null texts and empty texts have size 8; a null source is the source ``''``; rows that repeat a doc_id, or
a whole row, are placed and written each by itself; a null doc_id is hashed like the text ``''``; texts of any length
are read whole; an empty table gives no rows and no files; input columns named ``shard`` or ``slot`` are written as ``shard_``
and ``slot_``; other columns are written as they are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType
from pyspark.sql.window import Window as W

from fathomline.session import cut_lineage, ensure_checkpoint_dir, remove_folder

SHARDS = 24
BUCKETS = 64
#: Slices into which a range of sizes is counted at once.
SLICES = 1024
#: Bytes of text in one chunk of a shard at most, about: a file.
FILE_BYTES = 64 << 20

Flow = dict[tuple, int]


def minimum_cost_flow(arcs: list[tuple], source, sink) -> tuple[list[int], float]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least cost, and that cost.

    Successive shortest paths: each round finds the cheapest way through the residual network (costs on reversed arcs
    are negative, so by label correction) and sends as much as fits.
    """
    to, room, price, out = [], [], [], defaultdict(list)
    for u, v, capacity, cost in arcs:
        for x, y, c, w in ((u, v, capacity, cost), (v, u, 0, -cost)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(w)
    total = 0.0
    while True:
        far, come, queue, waiting = {source: 0.0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in out[u]:
                if room[e] and far[u] + price[e] < far.get(to[e], float("inf")) - 1e-9:
                    far[to[e]], come[to[e]] = far[u] + price[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if sink not in come:
            return [room[e + 1] for e in range(0, len(to), 2)], total
        path, v = [], sink
        while v != source:
            path.append(come[v])
            v = to[come[v] ^ 1]
        take = min(room[e] for e in path)
        for e in path:
            room[e] -= take
            room[e ^ 1] += take
        total += take * far[sink]


def transfers(supply: dict, weight: dict, demand: dict[int, int]) -> Flow:
    """Rows of each (old shard, class) that go to each new shard, moving the fewest bytes."""
    if sum(supply.values()) != sum(demand.values()):
        raise ValueError("supplies and demands differ")
    arcs = []
    for a in sorted(supply):
        arcs.append(("from", a, supply[a], 0.0))
        if a[0] in demand:
            arcs.append((a, ("stay", a[0]), supply[a], 0.0))
        arcs.append((a, "move", supply[a], weight[a] / supply[a]))
    for s in sorted(demand):
        arcs.append((("stay", s), ("new", s), demand[s], 0.0))
        arcs.append(("move", ("new", s), demand[s], 0.0))
        arcs.append((("new", s), "to", demand[s], 0.0))
    sent = minimum_cost_flow(arcs, "from", "to")[0]
    flow: Flow = defaultdict(int)
    leave, take = [], []
    for (u, v, _, _), n in zip(arcs, sent, strict=True):
        if n and v == "move":
            leave.append([u, n])
        elif n and u == "move":
            take.append([v[1], n])
        elif n and isinstance(v, tuple) and v[0] == "stay":
            flow[u, v[1]] += n
    while leave:  # what moves is dealt to the shards that have room, in order
        n = min(leave[0][1], take[0][1])
        flow[leave[0][0], take[0][0]] += n
        for x in (leave, take):
            x[0][1] -= n
            if not x[0][1]:
                x.pop(0)
    return dict(flow)


def even(total: int, shards: int) -> dict[int, int]:
    """Row capacities at most one apart."""
    return {s: total // shards + (s < total % shards) for s in range(shards)}


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def old_shard(source: str = "source", shards: int = SHARDS) -> Column:
    return (F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")) % shards).cast("int")


def size_class(size: str = "size") -> Column:
    return F.floor(4 * F.log2(F.col(size).cast("double"))).cast("int")


def small_table(spark, columns: dict[str, tuple]) -> DataFrame:
    """A broadcast table of a few rows a shard: name -> (type, values)."""
    return F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, kind) for k, (kind, v) in columns.items()})))


def split_sizes(rows: DataFrame, split: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """The m-th smallest size of each (old shard, class) in ``split``, where m is its value.

    Every round counts the rows of the range that is left, in ``SLICES`` slices; what comes to the driver is that many
    numbers for each old shard, as a flow splits one class of a shard.
    """
    spark = rows.sparkSession
    low = {a: 0 for a in split}
    step = {a: 1 for a in split}
    for a in split:  # a class holds the sizes below 2 ** ((class + 1) / 4)
        while step[a] * SLICES < 2 ** ((a[1] + 1) / 4) + 1:
            step[a] *= SLICES
    left = dict(split)
    while todo := [a for a in split if step[a]]:
        table = small_table(spark, {"old_shard": (pa.int32(), [a[0] for a in todo]), "class": (pa.int32(), [a[1] for a in todo]), "low": (pa.int64(), [low[a] for a in todo]), "step": (pa.int64(), [step[a] for a in todo])})
        near = rows.join(table, ["old_shard", "class"]).withColumn("slice", F.floor((F.col("size") - F.col("low")) / F.col("step")))
        counts: dict = defaultdict(list)
        for r in near.filter((F.col("slice") >= 0) & (F.col("slice") < SLICES)).groupBy("old_shard", "class", "slice").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["old_shard"], r["class"]].append((r["slice"], r["n"]))
        for a in todo:
            for at, n in sorted(counts[a]):
                if left[a] <= n:
                    low[a] += at * step[a]
                    break
                left[a] -= n
            step[a] //= SLICES
    return low


@dataclass
class Plan:
    """Where rows go: by block, or by rank in the blocks that are cut."""

    flow: Flow
    shards: int
    #: (old shard, class) -> the size at which it is split.
    cut_at: dict
    #: (old shard, class, bucket, shard) of whole blocks; (old shard, class, bucket, begin, stop, shard) of the others.
    whole: list[tuple]
    parted: list[tuple]
    rows: int
    bytes: int

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        def of(found: list[tuple], *more: str) -> DataFrame:
            names = ["old_shard", "class", "bucket", *more]
            return small_table(spark, {k: (pa.int64() if k in ("begin", "stop") else pa.int32(), [x[i] for x in found]) for i, k in enumerate(names)})

        return of(self.whole, "shard"), of(self.parted, "begin", "stop", "shard")

    def chunks(self, spark) -> int:
        """Chunks of a shard: files of bounded size, and some for every task."""
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, -(-self.bytes // (self.shards * FILE_BYTES)), -(-2 * parts // self.shards))

    def changed(self) -> set[int]:
        return {x for (a, s), n in self.flow.items() if a[0] != s for x in (s, a[0])}


def with_blocks(rows: DataFrame, cut_at: dict | None = None) -> DataFrame:
    """Rows (id, size, old_shard, ...) with their class and bucket; classes are four apart, for the parts of one that is split."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).withColumn("class", 4 * size_class())
    if not cut_at:
        return rows
    cuts = small_table(rows.sparkSession, {"old_shard": (pa.int32(), [a[0] for a in cut_at]), "class": (pa.int32(), [4 * a[1] for a in cut_at]), "at": (pa.int64(), list(cut_at.values()))})
    part = F.when(F.col("size") > F.col("at"), 2).when(F.col("size") == F.col("at"), 1).otherwise(0)
    return rows.join(cuts, ["old_shard", "class"], "left").withColumn("class", F.col("class") + part).drop("at")


def plan(rows: DataFrame, shards: int = SHARDS, capacities: dict[int, int] | None = None) -> Plan:
    """Solve for rows (id, size, old_shard, ...).

    What reaches the driver, and comes back as a broadcast, is a row for each (old shard, class, bucket): a bounded number.
    """
    supply: dict = defaultdict(int)
    weight: dict = defaultdict(int)
    for r in rows.groupBy("old_shard", size_class().alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).toArrow().to_pylist():
        supply[r["old_shard"], r["class"]] = r["n"]
        weight[r["old_shard"], r["class"]] = r["bytes"]
    total, size = sum(supply.values()), sum(weight.values())
    demand = capacities or even(total, shards)
    moving: dict = defaultdict(int)
    for (a, s), n in transfers(supply, weight, demand).items():
        moving[a] += n if s != a[0] else 0
    cut_at = split_sizes(rows.withColumn("class", size_class()), {a: n for a, n in moving.items() if 0 < n < supply[a]})
    sums = with_blocks(rows, cut_at).groupBy("old_shard", "class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).toArrow().to_pylist()
    supply, weight = defaultdict(int), defaultdict(int)
    for r in sums:
        supply[r["old_shard"], r["class"]] += r["n"]
        weight[r["old_shard"], r["class"]] += r["bytes"]
    flow = transfers(supply, weight, demand)
    # the rows of a class, in order of bucket, are cut along its flows: those that stay come first
    cuts: dict = defaultdict(list)
    for (a, s), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][1] != x[0][0][0], x[0][1])):
        cuts[a].append((s, n))
    by_class: dict = defaultdict(list)
    for r in sorted(sums, key=lambda r: (r["old_shard"], r["class"], r["bucket"])):
        by_class[r["old_shard"], r["class"]].append((r["bucket"], r["n"]))
    whole, parted = [], []
    for a in sorted(by_class):
        turn = iter(cuts[a])
        shard, room = next(turn)
        for bucket, n in by_class[a]:
            at = 0
            while at < n:
                if not room:
                    shard, room = next(turn)
                take = min(room, n - at)
                if take == n:
                    whole.append((*a, bucket, shard))
                else:
                    parted.append((*a, bucket, at, at + take, shard))
                at, room = at + take, room - take
    return Plan(flow, shards, cut_at, whole, parted, total, size)


ORDER = ("doc_id", "text_crc32", "size", "old_shard")


def assigned(rows: DataFrame, p: Plan) -> DataFrame:
    """Rows with their new ``shard``: a broadcast for whole blocks, the rank in their block for the others."""
    whole, parted = p.tables(rows.sparkSession)
    rows = with_blocks(rows, p.cut_at)
    block = ["old_shard", "class", "bucket"]
    out = rows.join(whole, block)
    if p.parted:
        ranked = rows.join(parted.select(*block).distinct(), block, "left_semi").withColumn("k", F.row_number().over(W.partitionBy(*block).orderBy(*ORDER)).cast("long") - 1)
        out = out.unionByName(ranked.join(parted, block).filter("k >= begin and k < stop").drop("k", "begin", "stop"))
    return out.drop("class", "bucket")


def with_slots(rows: DataFrame, counts: DataFrame, p: Plan, *tie: str) -> DataFrame:
    """Rows (with id and shard) with their ``slot``: the shard's chunks one after the other, each in ``ORDER``.

    ``counts`` has id and shard of every row, for the numbers of rows in the chunks before.
    """
    n = p.chunks(rows.sparkSession)
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)).cast("int")
    each = counts.withColumn("chunk", chunk).groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = rows.withColumn("chunk", chunk).withColumn("k", F.row_number().over(W.partitionBy("shard", "chunk").orderBy(*ORDER, *tie)).cast("long") - 1)
    return own.join(before, ["shard", "chunk"]).withColumn("slot", F.col("k") + F.col("before")).drop("k", "before", "chunk")


def id_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def described(docs: DataFrame, shards: int = SHARDS, *more: Column) -> DataFrame:
    return docs.select("doc_id", id_of().alias("id"), size_of().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), old_shard(shards=shards).alias("old_shard"), *more)


RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "moved")


def result(placed: DataFrame) -> DataFrame:
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int"), "moved": F.col("old_shard") != F.col("shard")}).select(*RESULT)


def reshard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The plan alone, with no file written."""
    rows = cut_lineage(described(docs, shards))
    p = plan(rows, shards)
    placed = cut_lineage(assigned(rows, p))
    return result(with_slots(placed, placed, p))


def rewrite(docs: DataFrame, placed: DataFrame, p: Plan, path: str) -> set[int]:
    """Write the shards whose content changes, a folder each, and return their numbers; the others' files stay.

    ``placed`` is what ``assigned`` made of the same documents.
    """
    changed = sorted(p.changed())
    if not changed:
        return set()
    spark = docs.sparkSession
    names = [c + "_" * (c.lower() in ("shard", "slot")) for c in docs.columns]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = with_blocks(described(docs, p.shards, F.xxhash64(*plain).alias("tie"), row), p.cut_at)
    whole, parted = p.tables(spark)
    block = ["old_shard", "class", "bucket"]
    out = rows.join(whole, block).drop("class", "bucket")
    if p.parted:
        # rows with one doc_id, text and old shard share a list of shards, each with the number of rows up to it, at most a row a shard
        own = parted.select(*block).distinct()
        key = ["id", "size", "text_crc32", "old_shard"]
        counts = with_blocks(placed, p.cut_at).join(own, block, "left_semi").groupBy(*key, "shard").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy(*key).orderBy("shard"))
        lists = counts.withColumn("upto", upto).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("shards"))
        numbered = rows.join(own, block, "left_semi").withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("tie")))
        out = out.unionByName(numbered.join(lists, key).withColumn("shard", F.filter("shards", lambda x: x["upto"] >= F.col("k"))[0]["shard"]).drop("class", "bucket", "k", "shards"))
    out = out.filter(F.col("shard").isin(changed))
    out = with_slots(out, placed.filter(F.col("shard").isin(changed)), p, "tie").select("row.*", "shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return set(changed)


def op4(spark, sf_dir: str) -> DataFrame:
    """Reshard, write what changes to the shared folder, and return the rows as they are read there; the folder goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = cut_lineage(described(docs))
    p = plan(rows)
    placed = cut_lineage(assigned(rows, p))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/reshard-{uuid.uuid4().hex}"
    changed = rewrite(docs, placed, p, path)
    stay = with_slots(placed.filter(~F.col("shard").isin(sorted(changed))), placed, p)
    if not changed:
        return result(stay)
    files = spark.read.schema(docs.schema.add("slot", LongType()).add("shard", IntegerType())).parquet(path)
    there = described(files, SHARDS, F.col("shard"), F.col("slot"))
    out = cut_lineage(result(there.unionByName(stay)))
    remove_folder(spark, path)  # the query's rows are read; a user of ``rewrite`` keeps the shards
    return out
