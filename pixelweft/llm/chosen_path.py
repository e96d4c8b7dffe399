"""N-gram Jaccard self-join by chosen paths.

Texts are sets of hashed runs of ``shingle`` words (lower-cased A-Z, parted at blanks). Texts with the same set form one
class representative. The join finds all pairs of representatives with Jaccard similarity of at least
``threshold``:

* Each set is sketched by ``COORDS`` sampled tokens: the smallest hash in each of as many ranges, empty
  ranges borrowing from others. Two sets share a coordinate with a chance equal to their similarity.
* A run splits the sets recursively. A node picks one or two coordinates, by a hash of its path, and sends each set on by its
  token there; so a pair stays together with a known chance, whatever the data. Nodes with at most
  ``bucket`` sets are compared by brute force, larger ones are split again down to ``depth``. Sets of a node are compared in blocks of ``cell``, each pair of blocks by
  itself, so that tasks are even. Runs are repeated until a pair at the threshold is found with the target recall.
* Comparing sketches links sets that may be similar (four standard errors below the threshold); linked sets
  are one candidate group. All sets of a group are then compared exactly, in blocks of ``block`` sets, on their real tokens: that gives each
  set's links and, from these, the classes.

So nothing is compared across candidate groups, pairs are never rows, and equal texts are one row with a
count. Large nodes and groups go to many tasks as pairs of blocks. Work in a group of different texts that are all
near copies grows with the square of its size, which counting their links asks for; memory doesn't.

Result: one row for each document: doc_id, class_id (the smallest doc_id of all documents linked to it directly or through others)
and n_links, the other documents with similarity at or above the threshold, copies included. A text with fewer words
than ``shingle``, but some, is one token of all its words. Texts without words, null ones included, are their own
class without links. Null ids are ignored for class_id. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.llm.common import LOWER_ASCII, release_memory, worker_memo
from pixelweft.llm.components import components
from pixelweft.runtime import discard, materialize, workspace

COORDS = 128
#: Children of a node: 1, or 2 with this chance. 1 / (1 + MORE) is the least similarity at which paths keep up their number.
MORE = 0.43
NO_ID = -(1 << 63)
MEMO = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words; it starts afresh beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int) -> np.ndarray:
    """The text's set of hashed word runs, sorted."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_memo(("shingles",), _Words).__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


@functools.lru_cache(1)
def _probes() -> np.ndarray:
    """For each coordinate, the order in which it tries others when its range is empty."""
    return np.array([np.random.Generator(np.random.Philox(key=j)).permutation(COORDS) for j in range(COORDS)])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The smallest token in each of COORDS ranges of hashes, as 32 bits; empty ranges take another's. Never called without tokens."""
    edges = np.searchsorted(tokens, np.arange(COORDS, dtype=np.uint64) << np.uint64(64 - 7))
    ends = np.append(edges[1:], len(tokens))
    full = edges < ends
    if not full.all():
        probes = _probes()
        rank = np.where(full[probes], np.arange(COORDS), COORDS).argmin(axis=1)
        edges = edges[np.where(full, np.arange(COORDS), probes[np.arange(COORDS), rank])]
    return (tokens[edges] & np.uint64(0xFFFFFFFF)).astype("<u4")


def survival(similarity: float, depth: int) -> float:
    """The chance that two sets share a node at this depth in one run."""
    q = 1.0
    for _ in range(depth):
        miss = 1 - similarity * q
        q = 1 - ((1 - MORE) * miss + MORE * miss * miss)
    return q


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair of this similarity has met with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def children(nodes: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each node's chosen coordinates; row i has nodes[i] and sketches[i]."""
    with np.errstate(over="ignore"):
        h = _mix(nodes + np.uint64(0x632BE59BD9B4E019))
        two = np.flatnonzero((h >> np.uint64(40)).astype(np.float64) < MORE * (1 << 24))
        row = np.concatenate([np.arange(len(nodes)), two])
        turn = np.concatenate([np.zeros(len(nodes), np.uint64), np.ones(len(two), np.uint64)])
        first = h & np.uint64(COORDS - 1)
        step = np.uint64(1) + ((h >> np.uint64(8)) % np.uint64(COORDS - 1))
        coord = (first[row] + turn * step[row]) & np.uint64(COORDS - 1)
        value = sketches[row, coord.astype(np.int64)].astype(np.uint64)
        return row, _mix(_mix(nodes[row] * np.uint64(0x9E3779B97F4A7C15) + coord) + value)


def _roots(runs: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, th, key, n, sketch) of each document: th is the text's hash, key a 128-bit hash of its set (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sizes, sketches = [], [], []
            for text in batch["body"]:
                s = shingles(text.as_py(), shingle)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                sketches.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "th": batch["th"], "key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int32()), "sketch": pa.array(sketches, pa.binary())})

    text = F.col(text_col).cast("string")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("body"))
    return own.mapInArrow(run, "id long, th long, key binary, n int, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, COORDS)


def _descend(rows: DataFrame, first: np.ndarray | None, levels: int) -> DataFrame:
    """(node, key, sketch) some levels further down; ``first`` are the nodes to start from for rows without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _sketches(batch["sketch"])
            if first is None:
                row, node = np.arange(len(s)), batch["node"].to_numpy().astype(np.int64).view(np.uint64)
            else:
                row, node = np.repeat(np.arange(len(s)), len(first)), np.tile(first, len(s))
            for _ in range(levels):
                at, node = children(node, s[row])
                row = row[at]
            for a in range(0, len(row), 20_000):
                part = pa.array(row[a : a + 20_000])
                yield pa.RecordBatch.from_pydict({"node": pa.array(node[a : a + 20_000].view(np.int64)), "key": batch["key"].take(part)} | ({"sketch": batch["sketch"].take(part)} if first is None else {}))

    return rows.mapInArrow(run, "node long, key binary" + (", sketch binary" if first is None else ""))


def _in_blocks(rows: DataFrame, group: str, sizes: DataFrame, block: int) -> DataFrame:
    """``sizes`` is a written table, so that Spark can split a large group's rows in the join. Rows with (bi, bj): a group larger than ``block`` is parted by key, and each pair of its blocks is a task's work. Others have (0, 0)."""
    parts = sizes.select(group, F.ceil(F.col("pw_n") / block).cast("int").alias("pw_parts"))
    mine = F.pmod(F.xxhash64("key", F.lit(7)), F.col("pw_parts")).cast("int")
    rows = rows.join(parts, group).withColumn("own", mine)
    pairs = F.transform(F.sequence(F.lit(0), F.col("pw_parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("bi"), F.greatest(o, F.col("own")).alias("bj")))
    return rows.withColumn("b", F.explode(pairs)).select("*", "b.bi", "b.bj").drop("b", "pw_parts")


def _by_group(rows: DataFrame, group: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, most: int = 20_000) -> DataFrame:
    """Run ``work`` on whole groups, many small ones at a time. A task sees its rows sorted by group and holds
    about ``most`` rows, or one group."""
    placed = rows.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]) if held is not None else pa.table(batch)
            if held.num_rows < most:
                continue
            last = [held[c][-1].as_py() for c in group]
            begin = held.num_rows - 1
            tail = np.ones(held.num_rows, dtype=bool)
            for c, v in zip(group, last, strict=True):
                col = held[c].to_pylist() if isinstance(v, bytes) else held[c].to_numpy()
                tail &= np.array([x == v for x in col]) if isinstance(v, bytes) else col == v
            begin = int(np.argmax(tail))
            if begin:
                yield from work(held.slice(0, begin).combine_chunks())
                held = held.slice(begin)
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks())
        held = None
        release_memory()

    return placed.mapInArrow(run, schema)


def _spans(table: pa.Table, group: list[str]) -> np.ndarray:
    """Starts of the groups in a sorted table, and its end."""
    change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for c in group:
        col = table[c].to_pylist() if pa.types.is_binary(table[c].type) else table[c].to_numpy()
        change |= np.array([a != b for a, b in zip(col[1:], col, strict=False)], dtype=bool) if isinstance(col, list) else col[1:] != col[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _sketch_links(buckets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that span each bucket's components under sketch similarity."""
    need = np.array([COORDS * max(0.0, threshold - 4 * math.sqrt(threshold * (1 - threshold) / max(1, min(n, COORDS)))) for n in range(COORDS + 1)])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        s = (_sketches(table["sketch"]) & 0xFF).astype(np.uint8)
        size = np.minimum(table["n"].to_numpy(), COORDS)
        spans = _spans(table, ["node", "bi", "bj"])
        end = np.repeat(spans[1:], np.diff(spans))
        # Rows d places apart, for growing d. Rows that are linked already, directly or through others, aren't compared again, so
        # a bucket of near copies costs a few rounds, and links are held for one round at a time.
        rows, label = np.arange(n), np.arange(n)
        for d in range(1, int(np.diff(spans).max(initial=0))):
            rows = rows[rows + d < end[rows]]
            apart = rows[label[rows] != label[rows + d]]
            hits = []
            for c in range(0, len(apart), 50_000):
                i = apart[c : c + 50_000]
                same = np.count_nonzero(s[i] == s[i + d], axis=1)
                hits.append(i[same >= need[np.minimum(size[i], size[i + d])]])
            if hits and len(i := np.concatenate(hits)):
                label = _stars(n, label[i], label[i + d])[label]
        linked = np.flatnonzero(label != np.arange(n))
        if len(linked):
            keys = table["key"].combine_chunks()
            yield pa.RecordBatch.from_pydict({"a": keys.take(pa.array(linked)), "b": keys.take(pa.array(label[linked]))})

    return _by_group(buckets, ["node", "bi", "bj"], work, "a binary, b binary", most=10_000)


def candidate_links(reps: DataFrame, path: str, *, threshold: float, recall: float, depth: int, bucket: int, cell: int) -> DataFrame:
    """Links between sets that share a small node in some run and have similar sketches."""
    runs = runs_for(recall, threshold, depth)
    front = materialize(_descend(reps.select("key", "sketch"), _roots(runs), 2), f"{path}/level-2")
    small, level = [], 2
    while True:
        sizes = materialize(front.groupBy("node").agg(F.count("*").alias("pw_n")).filter("pw_n > 1"), f"{path}/sizes-{level}")
        last = level >= depth
        ready = sizes if last else sizes.filter(F.col("pw_n") <= bucket)
        small.append(_in_blocks(front.select("node", "key"), "node", ready, cell))
        if last:
            break
        large = front.join(sizes.filter(F.col("pw_n") > bucket).select("node"), "node", "left_semi")
        if level == 2:
            large = large.join(reps.select("key", "sketch"), "key")
        front = materialize(_descend(large.select("node", "key", "sketch"), None, 1), f"{path}/level-{level + 1}")
        level += 1
        if front.isEmpty():
            break
    buckets = functools.reduce(DataFrame.unionByName, small).join(reps.select("key", "n", "sketch"), "key")
    return _sketch_links(buckets.select("node", "bi", "bj", "key", "n", "sketch"), threshold)


def _exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """(key, n_links, root): a set's links in this block pair, weighted by copies, and its component's first set there."""

    def intersections(sets: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        change = np.append(True, flat[1:] != flat[:-1])
        token = np.cumsum(change) - 1
        shared = np.bincount(token) > 1
        number = np.cumsum(shared) - 1
        keep = shared[token]
        token, owner = number[token[keep]], owner[keep]
        out = np.zeros((len(sets), len(sets)), dtype=np.float32)
        wide = max(256, 8_000_000 // len(sets))
        for a in range(0, int(token[-1]) + 1 if len(token) else 0, wide):
            lo, hi = np.searchsorted(token, [a, a + wide])
            m = np.zeros((len(sets), min(wide, int(token[-1]) + 1 - a)), dtype=np.float32)
            m[owner[lo:hi], token[lo:hi] - a] = 1
            out += m @ m.T
        return out

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        spans = _spans(table, ["root", "bi", "bj"])
        keys, copies, own = table["key"].to_pylist(), table["copies"].to_numpy(), table["own"].to_numpy()
        bi, bj = table["bi"].to_numpy(), table["bj"].to_numpy()
        for lo, hi in zip(spans, spans[1:], strict=False):
            rows = list({keys[i]: i for i in range(lo, hi)}.values())  # a repeated row counts once: its copies are counted
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(table["tokens"][i].as_py(), dtype="<u8") for i in rows]
            both = intersections(sets)
            size = np.array([len(s) for s in sets], dtype=np.float64)
            similar = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            np.fill_diagonal(similar, False)
            if bi[lo] != bj[lo]:
                similar &= own[rows][:, None] != own[rows][None, :]
            links = similar @ copies[rows].astype(np.float64)
            a, b = np.nonzero(np.triu(similar))
            label = _stars(len(rows), a, b)
            yield pa.RecordBatch.from_pydict({"key": pa.array([keys[i] for i in rows], pa.binary()), "n_links": pa.array(links.astype(np.int64)), "root": pa.array([keys[rows[x]] for x in label], pa.binary())})

    return _by_group(members, ["root", "bi", "bj"], work, "key binary, n_links long, root binary", most=2_000)


def _tokens(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([shingles(t.as_py(), shingle).tobytes() for t in batch["body"]], pa.binary())
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("root", "key", "copies")} | {"tokens": values})

    return rows.mapInArrow(run, "root binary, key binary, copies long, tokens binary")


def classify(docs: DataFrame, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 6, bucket: int = 1024, cell: int = 256, block: int = 512) -> DataFrame:
    """(id, th, key, class_id, n_links, rep_id, rep_th) of each document, rep_id and rep_th naming the document that stands for its
    class; ids that were null are NO_ID."""
    sigs = materialize(signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle), f"{out_dir}/signatures")
    has = sigs.filter("key IS NOT NULL")
    reps = has.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th")).alias("row"), F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("least_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, f"{out_dir}/representatives")
    links = materialize(candidate_links(reps, f"{out_dir}/paths", threshold=threshold, recall=recall, depth=depth, bucket=bucket, cell=cell), f"{out_dir}/candidates")
    discard(docs.sparkSession, f"{out_dir}/paths")
    groups = components(links, f"{out_dir}/groups")
    # The groups' texts: one row for each set, found by its first document and that one's text hash.
    members = groups.join(reps.select("key", "copies", "row"), "key").select("root", "key", "copies", "row.id", "row.th")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("body"))
    tokens = _tokens(texts.join(members, ["id", "th"]).select("root", "key", "copies", "body"), shingle)
    sizes = materialize(groups.groupBy("root").agg(F.count("*").alias("pw_n")), f"{out_dir}/sizes")
    exact = _exact_links(_in_blocks(tokens, "root", sizes, block), threshold)
    exact = materialize(exact, f"{out_dir}/links")
    linked = components(exact.filter("n_links > 0").select(F.col("key").alias("a"), F.col("root").alias("b")), f"{out_dir}/classes")
    counts = exact.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    sets = reps.select("key", "copies", "least_id", "row").join(counts, "key", "left").join(linked, "key", "left")
    sets = materialize(sets.select("key", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"), "least_id", "row"), f"{out_dir}/sets")
    # The document that stands for a class: the smallest id that isn't null, if any.
    known = F.struct((F.col("row.id") == NO_ID).alias("none"), F.col("row.id").alias("id"), F.col("row.th").alias("th"))
    heads = materialize(sets.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min(known).alias("head")), f"{out_dir}/heads")
    for part in ("representatives", "candidates", "groups", "sizes", "links", "classes"):
        discard(docs.sparkSession, f"{out_dir}/{part}")
    done = sets.select("key", "n_links", "root").join(heads, "root").select("key", "n_links", "class_id", F.col("head.id").alias("rep_id"), F.col("head.th").alias("rep_th"))
    known_id = F.when(F.col("id") != NO_ID, F.col("id"))
    rows = sigs.select("id", "th", "key").join(done, "key", "left")
    return rows.select("id", "th", "key", F.when(F.col("key").isNull(), known_id).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "rep_id", "rep_th")


def near_duplicates(docs: DataFrame, out_dir: str | None = None, **options) -> DataFrame:
    """(doc_id, class_id, n_links) of each document."""
    out_dir = out_dir or workspace(docs.sparkSession, "near")
    return classify(docs, out_dir, **options).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "class_id", "n_links")


def keep_one(docs: DataFrame, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each class; rows without words all stay."""
    done = classify(docs, out_dir, id_col=id_col, text_col=text_col, **options)
    stays = materialize(done.filter("key IS NOT NULL").select(F.col("rep_id").alias("pw_id"), F.col("rep_th").alias("pw_th")).distinct(), f"{out_dir}/stays")
    wordless = materialize(done.filter("key IS NULL").select(F.col("id").alias("pw_id"), F.col("th").alias("pw_th")).distinct(), f"{out_dir}/wordless")
    for part in ("signatures", "sets", "heads"):
        discard(docs.sparkSession, f"{out_dir}/{part}")
    text = F.col(text_col).cast("string")
    rows = docs.withColumn("pw_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("pw_th", F.xxhash64(text))
    kept = rows.join(stays, ["pw_id", "pw_th"], "left_semi").dropDuplicates(["pw_id", "pw_th"])
    empty = rows.join(wordless, ["pw_id", "pw_th"], "left_semi")
    return kept.unionByName(empty).drop("pw_id", "pw_th")
