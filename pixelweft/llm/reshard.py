"""Resharding by minimum-cost flow.

Old shards (files, or any shard column) have sizes, new shards have capacities. First every old shard gets a home, the new shard that adopts it
as a whole: old shards whose number is one of the new shards' keep it, the others go, the largest first, to the
home with most room. Adopting a file is a line in the assignment and moves nothing. What a home then holds beyond its capacity has to move: a
flow network (source -> homes -> new shards -> sink) prices each byte that leaves its home, and its cheapest flow says how many
bytes go where. A home gives whole old shards away as far as they fit into a transfer, and splits at most one for the rest.
Only split ones are rewritten; a new shard consists of untouched old files and of the files written for it.

Rows of a split file are cut by their place in the file (of another shard: by id and text hash). Sizes of old shards and cuts reach the driver, never rows:
one number for each file, as in Spark's own list of files. Tables of them are broadcast only while their counted rows are few.

Nulls: a null text has size 1 and the crc of no bytes; null ids sort first; a null shard key is a shard of its own, sorted first. With another shard column than
files, rows that repeat both id and text are never cut apart. A column ``shard`` of the input is replaced; names that begin with pw_ are
reserved. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweft.runtime import BROADCAST_ROWS, discard, materialize

#: Rows of a task that numbers rows or sums up their sizes.
TASK_ROWS = 500_000
PLACE_BITS = 33


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """The cheapest way to send all of ``supply`` into ``capacity``: {(i, j): amount}.

    Successive shortest paths with node potentials (Dijkstra on reduced costs). ``cost(i, j)`` is
    the price of one unit, not negative.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards are too small")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def edge(u: int, v: int, cap: int, c: int) -> None:
        for a, b, r, p in ((u, v, cap, c), (v, u, 0, -c)):
            head[a].append(len(to))
            to.append(b)
            room.append(r)
            price.append(p)

    first = {}
    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            first[i, j] = len(to)
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential, left = [0] * (n + m + 2), sum(supply)
    while left:
        dist, via = {source: 0}, {}
        heap = [(0, source)]
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for e in head[u]:
                if room[e] and to[e] not in done:
                    nd = d + price[e] + potential[u] - potential[to[e]]
                    if nd < dist.get(to[e], nd + 1):
                        dist[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        far = max(dist.values())
        potential = [p + dist.get(v, far) for v, p in enumerate(potential)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(left, *(room[e] for e in path))
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
        left -= amount
    return {ij: room[e ^ 1] for ij, e in first.items() if room[e ^ 1]}


def homes_of(supply: list[int], capacity: list[int]) -> list[int]:
    """The new shard that adopts each old one: its own number where that is a new shard's, else the one with most room, the largest first."""
    m = len(capacity)
    home = list(range(min(len(supply), m))) + [0] * max(0, len(supply) - m)
    room = [(supply[j] if j < len(supply) else 0) - capacity[j] for j in range(m)]
    heap = [(r, j) for j, r in enumerate(room)]
    heapq.heapify(heap)
    for i in sorted(range(m, len(supply)), key=lambda i: (-supply[i], i)):
        r, j = heapq.heappop(heap)
        home[i] = j
        heapq.heappush(heap, (r + supply[i], j))
    return home


def cheapest_transfers(supply: list[int], capacity: list[int], home: list[int], cost) -> dict[tuple[int, int], int]:
    """``min_cost_flow`` with all old shards of a home as one node, so the network stays small however many files there are; its
    flow is then dealt to the old shards so that few are split. What a home gives away is taken from whole old shards while they fit, the
    largest first, then from the smallest one that has the rest."""
    members: dict[int, list[int]] = {}
    for i, j in enumerate(home):
        members.setdefault(j, []).append(i)
    names = sorted(members)
    flow = min_cost_flow([sum(supply[i] for i in members[h]) for h in names], capacity, lambda a, j: cost(names[a], j))
    away: dict[int, list[list[int]]] = {}
    for (a, j), v in sorted(flow.items()):
        if names[a] != j:
            away.setdefault(names[a], []).append([j, v])
    out: dict[tuple[int, int], int] = {}
    for h, mine in members.items():
        left = {i: supply[i] for i in mine}
        todo = away.get(h, [])
        for i in sorted(mine, key=lambda i: (-supply[i], i)):
            fit = max((t for t in todo if t[1] >= supply[i] > 0), key=lambda t: t[1], default=None)
            if fit:
                out[i, fit[0]] = supply[i]
                fit[1] -= supply[i]
                left[i] = 0
        for t in todo:
            while t[1]:
                i = min((i for i in mine if left[i]), key=lambda i: (left[i] == supply[i], left[i] < t[1], left[i], i))
                take = min(left[i], t[1])
                out[i, t[0]] = out.get((i, t[0]), 0) + take
                left[i] -= take
                t[1] -= take
        out.update({(i, h): n for i, n in left.items() if n})
    return out


@dataclass
class Resharded:
    """What a resharding did: rows (all columns and ``shard``), the flow by old shard, each one's home, the old shards that were rewritten because
    they were split, the bytes that changed their home, and the bytes rewritten."""

    rows: DataFrame
    flow: dict[tuple[int, int], int]
    home: list[int]
    rewritten: list[int]
    moved_bytes: int
    rewritten_bytes: int


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) plus 1."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + 1


def _join_small(df: DataFrame, small: DataFrame, rows: int, on, how: str = "inner") -> DataFrame:
    """Join a table whose ``rows`` are counted: by broadcast while they are few, else plainly, with partitions that Spark splits."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def _numbered(df: DataFrame, group: list[str], order: list[str], path: str, rows: int) -> DataFrame:
    """Write ``df`` in ranges of (group, order): pw_task and pw_at, a row's task and place in it, ascending in that order.
    No task holds a group, however large; rows that are equal in all of it are told apart by their place in the input."""
    keyed = df.withColumn("pw_place", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "pw_place")]
    done = keyed.repartitionByRange(max(1, -(-rows // TASK_ROWS)), *keys).sortWithinPartitions(*keys).drop("pw_place")
    done = materialize(done.withColumn("pw_at", F.monotonically_increasing_id()), path)
    return done.withColumns({"pw_task": F.shiftright("pw_at", PLACE_BITS), "pw_at": F.col("pw_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})


def _before(numbered: DataFrame, group: list[str], value: Column, path: str) -> tuple[DataFrame, int]:
    """(group, pw_task, pw_first, pw_before): a group's first place in a task and its sum of ``value`` in earlier tasks; and the rows of that table.
    The window runs over one row for each task."""
    totals = numbered.groupBy(*group, "pw_task").agg(F.min("pw_at").alias("pw_first"), F.sum(value).alias("pw_total"))
    ahead = Window.partitionBy(*group).orderBy("pw_task").rowsBetween(Window.unboundedPreceding, -1)
    table = materialize(totals.select(*group, "pw_task", "pw_first", F.coalesce(F.sum("pw_total").over(ahead), F.lit(0)).alias("pw_before")), path)
    return table, table.count()


def reshard(docs: DataFrame, out_dir: str, new_shards: int, *, shard_col: str, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None, cost=None) -> Resharded:
    """Move rows from the shards that ``shard_col`` names into ``new_shards`` of equal bytes.

    An old shard's number is its key's rank. ``cost(h, j)`` is the price of a byte that goes from home h to shard j, 1 for every other shard as a rule; e.g. one for
    other racks. ``place_col`` is a whole number that tells a shard's rows apart; without one they are ordered by id and text hash.
    """
    spark = docs.sparkSession
    key, size = F.col(shard_col), size_of(F.col(text_col))
    pos = F.coalesce(F.col(place_col or id_col).cast("long"), F.lit(-(1 << 63)))
    tie = F.lit(0).cast("long") if place_col else F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    sizes = docs.groupBy(key.alias("pw_key")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).orderBy(F.col("pw_key").asc_nulls_first()).collect()
    supply = [r.bytes for r in sizes]
    total = sum(supply)
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    home = homes_of(supply, capacity)
    flow = cheapest_transfers(supply, capacity, home, cost or (lambda h, j: int(h != j)))
    targets: dict[int, list[int]] = {}
    for i, j in sorted(flow):
        targets.setdefault(i, []).append(j)
    split = [i for i, js in targets.items() if len(js) > 1]

    # Where each part of a split shard ends, in bytes; the part that stays comes first. A row belongs to the part that its middle byte falls in.
    cuts: dict[int, list[tuple[int, int, int]]] = {}
    if split:
        parts = {i: sorted(targets[i], key=lambda j, i=i: (j != home[i], j)) for i in split}
        ends = {i: [(sum(flow[i, k] for k in parts[i][: n + 1]), j) for n, j in enumerate(parts[i])] for i in split}
        names = spark.createDataFrame([(sizes[i].pw_key, i, ends[i]) for i in split], f"pw_name {docs.schema[shard_col].dataType.simpleString()}, pw_old int, pw_ends array<struct<pw_end:long,pw_to:int>>")
        inner = docs.select(key.alias("pw_key"), pos.alias("pw_pos"), tie.alias("pw_tie"), size.alias("pw_size"))
        inner = _join_small(inner, names.drop("pw_ends"), len(split), F.col("pw_key").eqNullSafe(F.col("pw_name"))).select("pw_old", "pw_pos", "pw_tie", "pw_size")
        inner = _numbered(inner, ["pw_old"], ["pw_pos", "pw_tie"], f"{out_dir}/split", sum(sizes[i].n for i in split))
        ahead, n = _before(inner, ["pw_old"], F.col("pw_size"), f"{out_dir}/split-before")
        inside = Window.partitionBy("pw_old", "pw_task").orderBy("pw_at").rowsBetween(Window.unboundedPreceding, -1)
        inner = inner.withColumn("pw_in", F.coalesce(F.sum("pw_size").over(inside), F.lit(0)))
        inner = _join_small(_join_small(inner, ahead, n, ["pw_old", "pw_task"]), names.drop("pw_name"), len(split), "pw_old")
        middle = F.col("pw_before") + F.col("pw_in") + F.col("pw_size") / 2
        to = F.coalesce(F.get(F.filter("pw_ends", lambda e: e.pw_end > middle), F.lit(0)), F.element_at("pw_ends", -1)).pw_to
        lasts = inner.withColumn("pw_to", to).groupBy("pw_old", "pw_to").agg(F.max(F.struct("pw_pos", "pw_tie")).alias("last"))
        for r in lasts.collect():
            cuts.setdefault(r.pw_old, []).append((r["last"].pw_pos, r["last"].pw_tie, r.pw_to))
        for done in ("split", "split-before"):
            discard(spark, f"{out_dir}/{done}")

    # Where each old shard goes: one row for each, with the cuts of the split ones.
    top = (1 << 63) - 1
    plan = [(r.pw_key, i, sorted(cuts.get(i, [])) or [(top, top, targets[i][0] if i in targets else home[i])]) for i, r in enumerate(sizes)]
    table = spark.createDataFrame(plan, f"pw_name {docs.schema[shard_col].dataType.simpleString()}, pw_old int, pw_cuts array<struct<pos:long,tie:long,to:int>>")
    row = _join_small(docs, table, len(plan), key.eqNullSafe(F.col("pw_name"))).drop("pw_name")
    where = F.get(F.filter("pw_cuts", lambda c: (c.pos > pos) | ((c.pos == pos) & (c.tie >= tie))), F.lit(0))
    row = row.withColumn("shard", F.coalesce(where, F.element_at("pw_cuts", -1)).to)
    torn = F.size("pw_cuts") > 1
    kept = row.filter(~torn).drop("pw_old", "pw_cuts")
    rewritten = sorted(i for i, c in cuts.items() if len(c) > 1)
    if rewritten:
        out = f"{out_dir}/shards"
        # Only split shards are read here: their number is a literal, so other files' rows go before their texts are used.
        row.filter(torn).drop("pw_old", "pw_cuts").write.mode("overwrite").partitionBy("shard").parquet(out)
        kept = kept.unionByName(spark.read.schema(kept.schema).parquet(out))
    return Resharded(kept, flow, home, rewritten, sum(v for (i, j), v in flow.items() if j != home[i]), sum(supply[i] for i in rewritten))


def with_slots(rows: DataFrame, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document, with its size, crc32 and place in its shard: gapless from 0, by id and text."""
    text = F.col(text_col)
    narrow = rows.select(F.col(id_col).cast("long").alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"), "shard", F.xxhash64(text).alias("pw_th"))
    numbered = _numbered(narrow, ["shard"], ["doc_id", "pw_th"], f"{out_dir}/slots", rows.count())
    ahead, n = _before(numbered, ["shard"], F.lit(1).cast("long"), f"{out_dir}/slots-before")
    done = _join_small(numbered, ahead, n, ["shard", "pw_task"])
    return done.select("doc_id", "size", "text_crc32", "shard", (F.col("pw_before") + F.col("pw_at") - F.col("pw_first")).alias("slot"))


def reshard_files(docs: DataFrame, out_dir: str, new_shards: int, **options) -> Resharded:
    """As ``reshard``, for a table read from Parquet files: each file is an old shard, cut by its rows' places."""
    own = docs.select("*", F.col("_metadata.file_path").alias("pw_file"), F.col("_metadata.row_index").alias("pw_row"))
    done = reshard(own, out_dir, new_shards, shard_col="pw_file", place_col="pw_row", **options)
    done.rows = done.rows.drop("pw_file", "pw_row")
    return done


def written_shards(docs: DataFrame, out_dir: str, new_shards: int, **options) -> DataFrame:
    """Reshard files and describe every row of the result."""
    return with_slots(reshard_files(docs, out_dir, new_shards, **options).rows, out_dir)
