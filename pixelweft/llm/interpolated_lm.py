"""Deleted-interpolation language model: train, learn its weights, score.

The probability of a token w is built up from the uniform one, order by order: with h the k - 1 tokens before w,

    P0 = 1 / (V + 1)
    P1 = l1 * c(w) / N                 +  (1 - l1) * P0
    Pk = lk(b) * c(h, w) / c(h)        +  (1 - lk(b)) * P(k-1)        for k = 2, 3, ... ``order``

where b is the bucket of the context's count c(h) (its number of binary digits); a context that was never seen has weight 0. The weights
are learned by expectation-maximisation on deleted data: one fold of the training documents
is taken out of all counts (each count less the fold's own) and the weights that make it likeliest are
found, one order after the other. What EM needs of a token at one order is its bucket and the ratio of its estimate to P(k-1): tokens are counted
on the executors by bucket and ratio, in steps of a 64th of an octave, so what the driver gets is bounded by buckets and steps and every held-out token counts.

Counting and lookup move sorted key blocks, not rows. Documents are encoded once into blocks of about
``block_tokens`` tokens. A block sends each key range (as many as blocks, 128 at most) one message: its distinct n-grams there (hashes) with their counts. A range
adds up all messages and answers each with the total counts in the same order. So a frequent word or pair costs one entry a block, ranges are even, and no
task holds more than its range's share. Beyond ``fan`` blocks this goes in levels: the messages of ``fan`` blocks to a range are merged into
one block of that range, these blocks exchange messages with the 128 ranges within it in the same way, and the answers return by the same way.
So messages are 128 for each block and level, whatever the number of blocks, and no task gets more than about ``fan`` of them.

Words are told apart by 64 bits, longer n-grams by 24 more than the number of tokens has, so that a chance match of two stays below one in 2^24 at every size.

Words are runs of other characters than blanks after lower-casing A-Z; each text ends with an end token, which also stands
as the one token before a text's first word; a text's first words have no longer contexts. A null text has only its end token. A document whose id is null is in the fold
of the empty string. Repeated rows are each counted and scored. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.llm.common import LOWER_ASCII, release_memory
from pixelweft.runtime import discard, materialize

END = b" end of text"
FOLDS, GRID, BUCKETS = 7, 64, 40
#: A range has 2 ** BITS ranges within it.
BITS = 7
ZERO = -(1 << 20)
LEAST = 1e-6


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: small ones cost little whatever their type. The lengths go ahead."""
    import zstandard

    planes = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack_all(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    at, out = 8 * len(kinds), []
    for n, kind in zip(raw[:at].view("<i8").tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel() if n else np.empty(0, kind))
        at += n * size
    return out


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return _unpack_all(data, kind)[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and each one's place among them, in 32 bits: a block, or a range's messages, are bounded."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1]) if len(x) else np.empty(0, bool)
    place = np.empty(len(x), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place


@dataclass
class Block:
    """Documents as numbers: ids, folds, token counts, the block's distinct words (hashes) and the tokens as places
    among them. Word 0 is the end token."""

    ids: list[int | None]
    folds: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    stream: np.ndarray

    def row(self) -> dict:
        return {"ids": _pack(np.array([i or 0 for i in self.ids], "<i8")), "no_id": _pack(np.array([i is None for i in self.ids], "u1")), "folds": _pack(self.folds), "lengths": _pack(self.lengths), "hashes": _pack(self.hashes), "stream": _pack(self.stream)}

    @classmethod
    def of(cls, row: dict) -> Block:
        none = _unpack(row["no_id"], "u1")
        ids = [None if x else i for i, x in zip(_unpack(row["ids"], "<i8").tolist(), none, strict=True)]
        return cls(ids, _unpack(row["folds"], "u1"), _unpack(row["lengths"], "<i8"), _unpack(row["hashes"], "<u8"), _unpack(row["stream"], "<u4"))

    def places(self) -> np.ndarray:
        """Each token's place in its document."""
        ends = np.cumsum(self.lengths)
        return np.arange(len(self.stream)) - np.repeat(ends - self.lengths, self.lengths)

    def keys(self, order: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, the sorted distinct hashes of its n-grams (of ``width`` bits, at the top of 64; words have all 64) and each token's place among them."""
        mask = np.uint64(((1 << width) - 1) << (64 - width))
        first = np.cumsum(self.lengths) - self.lengths
        with np.errstate(over="ignore"):
            words, place = _distinct(_mix(self.hashes))
            yield words, place[self.stream]
            word = _mix(self.hashes + np.uint64(0x9E3779B97F4A7C15))[self.stream]
            end = _mix(self.hashes[:1] + np.uint64(0x9E3779B97F4A7C15))
            gram, start = word, end
            for k in range(2, order + 1):
                before = np.concatenate([start, gram[:-1]])
                before[first] = start
                gram, start = _mix(before * np.uint64(2 * k - 1) + word), _mix(start * np.uint64(2 * k - 1) + end)
                del before
                yield _distinct(gram & mask)


BLOCK = "ids binary, no_id binary, folds binary, lengths binary, hashes binary, stream binary"


def encode_blocks(docs: DataFrame, path: str, *, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """Write the documents as blocks: block, n_tokens and a Block's fields."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        state: dict = {}

        def fresh() -> None:
            rank = defaultdict(itertools.count().__next__)
            rank[END]
            state.update(rank=rank, ids=[], runs=[], total=0)

        def flush(number: int) -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, state["rank"]), dtype="<u8", count=len(state["rank"]))
            block = Block(state["ids"], np.array([fold_of(i) for i in state["ids"]], "u1"), np.array([len(r) for r in state["runs"]], "<i8"), hashes, np.concatenate(state["runs"]).astype("<u4"))
            row = {"block": (task << 32) | number, "n_tokens": len(block.stream)} | block.row()
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for k, v in row.items()})

        fresh()
        numbers = itertools.count()
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["body"], strict=True):
                words = tokens(text.as_py())
                words.append(END)
                state["ids"].append(i)
                state["runs"].append(np.fromiter(map(state["rank"].__getitem__, words), dtype="<u4", count=len(words)))
                state["total"] += len(words)
                if state["total"] >= block_tokens:
                    yield flush(next(numbers))
                    fresh()
        if state["ids"]:
            yield flush(next(numbers))

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return materialize(own.mapInArrow(encode, f"block long, n_tokens long, {BLOCK}"), path)


def _message(level: int) -> tuple[str, str, str]:
    """A message's numbers for each order: key steps, counts in training documents and in the deleted fold. A block's own counts are small; united ones may not be."""
    return ("<u8", "<u4", "<u4") if level == 0 else ("<u8", "<u8", "<u8")


def _write_message(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> bytes:
    flat: list[np.ndarray] = []
    for k, (keys, train, cut) in enumerate(lists):
        flat += [np.diff(keys, prepend=np.uint64(0)) >> np.uint64(64 - width if k else 0), train, cut]
    return _pack(*flat)


def _read_message(data: bytes, order: int, width: int, level: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    flat = _unpack_all(data, *_message(level) * order)
    return [(np.cumsum(flat[3 * k], dtype=np.uint64) << np.uint64(64 - width if k else 0), flat[3 * k + 1], flat[3 * k + 2]) for k in range(order)]


def _cuts(keys: np.ndarray, scope: int, level: int, bits: int) -> list[int]:
    """Where the ranges of a scope begin among sorted keys, and their end. A scope is a run of leading bits, ``bits`` for each level above."""
    low, step = scope << (64 - bits * level), 1 << (64 - bits * (level + 1))
    inner = np.array([low + part * step for part in range(1, 1 << bits)], dtype=np.uint64)
    return [0, *np.searchsorted(keys, inner).tolist(), len(keys)]


def _send(units: DataFrame, read, level: int, groups: int, width: int, bits: int = BITS) -> DataFrame:
    """(cell, grp, scope, unit, message): what each unit has in each range of its scope. ``read`` gives a row's scope, number and lists; units of a scope
    fall into ``groups`` by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                scope, unit, lists = read(row)
                grp = int(_mix(np.array([unit], "<i8").view("<u8") + np.uint64(level + 1))[0] % np.uint64(groups))
                cuts = [_cuts(keys, scope, level, bits) for keys, _, _ in lists]
                for part in range(1 << bits):
                    spans = [slice(c[part], c[part + 1]) for c in cuts]
                    if any(x.start < x.stop for x in spans):
                        message = _write_message([tuple(a[x] for a in own) for own, x in zip(lists, spans, strict=True)], width)
                        values = ((scope << bits) | part, grp, scope, unit)
                        yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in values), pa.array([message], pa.binary())], names=["cell", "grp", "scope", "unit", "message"])
                del lists
                release_memory()

    return units.mapInArrow(run, "cell long, grp long, scope long, unit long, message binary")


def _merge(messages: list, order: int, width: int, level: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, list[int], np.ndarray]]:
    """For each order: the distinct keys of some messages, their added-up counts, each entry's place among them, where each message's entries begin, and
    which entries have a count in the deleted fold."""
    parts = [_read_message(m, order, width, level) for m in messages]
    for k in range(order):
        keys, place = _distinct(np.concatenate([p[k][0] for p in parts]))
        cut = np.concatenate([p[k][2] for p in parts])
        totals = [np.bincount(place, weights=w, minlength=len(keys)).astype("<u8") for w in (np.concatenate([p[k][1] for p in parts]), cut)]
        yield keys, totals, place, np.cumsum([0, *(len(p[k][0]) for p in parts)]).tolist(), cut > 0


def _answer(rows: list[dict], totals: list[list[np.ndarray]], merged: list) -> list[list[bytes]]:
    """The totals for each message's entries by order; those of the deleted fold only where the message has some."""
    out = []
    for i in range(len(rows)):
        frames = []
        for (train, cut), (_, _, place, ends, marked) in zip(totals, merged, strict=True):
            own = slice(ends[i], ends[i + 1])
            frames.append(_pack(train[place[own]], cut[place[own][marked[own]]]))
        out.append(frames)
    return out


ANSWER = "scope long, unit long, cell long, answer array<binary>, n long, v long, n_deleted long"


def _answers(rows: list[dict], answers: list[list[bytes]], stats: tuple[int, int, int] = (0, 0, 0)) -> pa.Table:
    first = lambda v: pa.array([v] + [0] * (len(rows) - 1), pa.int64())
    keys = {c: pa.array([r[c] for r in rows], pa.int64()) for c in ("scope", "unit", "cell")}
    return pa.table(keys | {"answer": pa.array(answers, pa.list_(pa.binary())), "n": first(stats[0]), "v": first(stats[1]), "n_deleted": first(stats[2])})


def exchange(units: DataFrame, read, count: int, path: str, *, order: int, width: int, fan: int, bits: int = BITS, level: int = 0) -> DataFrame:
    """(scope, unit, cell, answer, n, v, n_deleted): total counts for every unit's entries in each range, in its order. ``count`` is how many units a scope has.
    One row of each last range also has its training tokens, distinct training words and tokens of the deleted fold."""
    groups = 1 if count <= 2 * fan or bits * (level + 2) > width else -(-count // fan)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["scope"], r["unit"]))
        merged = list(_merge([r["message"] for r in rows], order, width, level))
        train, cut = merged[0][1]
        done = _answers(rows, _answer(rows, [m[1] for m in merged], merged), (int(train.sum()), int((train > 0).sum()), int(cut.sum())))
        del rows, merged, train, cut
        release_memory()
        return done

    if groups == 1:
        return _send(units, read, level, 1, width, bits).groupBy("cell").applyInArrow(add, ANSWER)

    def unite(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [(keys, *totals) for keys, totals, *_ in _merge([r["message"] for r in rows], order, width, level)]
        flat = [x for keys, train, cut in lists for x in (keys, train, cut)]
        return pa.table({"scope": pa.array([rows[0]["cell"]], pa.int64()), "unit": pa.array([rows[0]["grp"]], pa.int64()), "lists": pa.array([_pack(*flat)], pa.binary())})

    def read_united(row: dict) -> tuple[int, int, list]:
        flat = _unpack_all(row["lists"], *["<u8", "<u8", "<u8"] * order)
        return row["scope"], row["unit"], [tuple(flat[3 * k : 3 * k + 3]) for k in range(order)]

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        merged = list(_merge([r["message"] for r in rows], order, width, level))
        got = _by_cell(right)
        return _answers(rows, _answer(rows, [_totals(got, k, m[1][1] > 0) for k, m in enumerate(merged)], merged))

    united = materialize(_send(units, read, level, groups, width, bits).groupBy("cell", "grp").applyInArrow(unite, "scope long, unit long, lists binary"), f"{path}/level-{level + 1}")
    above = exchange(united, read_united, groups, path, order=order, width=width, fan=fan, bits=bits, level=level + 1)
    above = materialize(above, f"{path}/answers-{level + 1}")
    discard(units.sparkSession, f"{path}/level-{level + 1}")
    sums = above.agg(F.sum("n"), F.sum("v"), F.sum("n_deleted")).first()
    down = _send(units, read, level, groups, width, bits).groupBy("cell", "grp").cogroup(above.filter("unit >= 0").groupBy("scope", "unit")).applyInArrow(back, ANSWER)
    # The totals of the last ranges ride on one row that stands for no unit.
    total = units.sparkSession.createDataFrame([(-1, -1, -1, None, *(x or 0 for x in sums))], ANSWER)
    return down.unionByName(total)


def _by_cell(answers: pa.Table) -> list[list[bytes]]:
    """A unit's answers, range after range."""
    return [a for _, a in sorted(zip(answers["cell"].to_pylist(), answers["answer"].to_pylist(), strict=True), key=lambda x: x[0])]


def _totals(answers: list[list[bytes]], k: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total counts of a unit's entries of one order. ``marked`` are those that have a count of the unit's own in the deleted fold."""
    got = [_unpack_all(a[k], "<u8", "<u8") for a in answers]
    train, some = (np.concatenate([g[j] for g in got]) if got else np.empty(0, "<u8") for j in (0, 1))
    cut = np.zeros(len(marked), "<u8")
    cut[marked] = some
    return train, cut


def _read_block(held_out: int, deleted: int, order: int, width: int):
    def read(row: dict) -> tuple[int, int, list]:
        b = Block.of(row)
        fold = np.repeat(b.folds, b.lengths)
        masks = fold != held_out, fold == deleted
        return 0, row["block"], [(keys, *(np.bincount(place[m], minlength=len(keys)).astype("<u4") for m in masks)) for keys, place in b.keys(order, width)]

    return read


def _grid(ratio: np.ndarray) -> np.ndarray:
    """log2 of a ratio in 64ths of an octave; ZERO where it is 0."""
    out = np.full(len(ratio), ZERO, dtype=np.int64)
    ok = ratio > 0
    out[ok] = np.rint(GRID * np.log2(ratio[ok])).astype(np.int64)
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1).astype(np.int64)


def _contexts(counts: list[np.ndarray], place: np.ndarray, of_end: int) -> list[np.ndarray]:
    """Counts of each token's contexts for orders 2 and up, from the tokens' own counts by order: those of the n-gram that ends before it. A
    document's first token has the end token as context, and none that is longer; 0 where there is none."""
    out = []
    for k, c in enumerate(counts[:-1]):
        before = np.concatenate([np.zeros(1, c.dtype), c[:-1]])
        before[place < k] = 0
        if k == 0:
            before[place == 0] = of_end
        out.append(before)
    return out


def _resolve(blocks: DataFrame, answers: DataFrame, deleted: int, order: int, width: int) -> DataFrame:
    """Each block with its tokens' counts by order, and for the tokens of the deleted fold the counts without that fold: of n-grams and of their contexts."""
    schema = "ids binary, no_id binary, folds binary, lengths binary, counts array<binary>, of_end long, held binary"

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = Block.of(row)
        mine = np.repeat(b.folds, b.lengths) == deleted
        at, place_in = np.flatnonzero(mine), b.places()[mine]
        got, counts, num, den, of_end = _by_cell(right), [], [], [], 0
        for k, (keys, place) in enumerate(b.keys(order, width)):
            total, cut = _totals(got, k, np.bincount(place[mine], minlength=len(keys)) > 0)
            counts.append(_pack(total[place]))
            left_over = total - cut
            num.append(left_over[place[at]])
            before = left_over[place[at - (place_in > 0)]]  # a document's first token has no place before it
            if k == 0:
                end = int(np.searchsorted(keys, _mix(b.hashes[:1])[0]))
                of_end = int(total[end])
                before[place_in == 0] = left_over[end]
            else:
                before[place_in < k] = 0
            den.append(before)
            del keys, place, total, cut, left_over
        values = {c: pa.array([row[c]], pa.binary()) for c in ("ids", "no_id", "folds", "lengths")}
        done = pa.table(values | {"counts": pa.array([counts], pa.list_(pa.binary())), "of_end": pa.array([of_end], pa.int64()), "held": pa.array([_pack(*num, *den[:-1])], pa.binary())})
        del b, got, num, den, row
        release_memory()
        return done

    own = answers.filter("unit >= 0").select("unit", "cell", "answer")
    return blocks.groupBy("block").cogroup(own.groupBy("unit")).applyInArrow(join, schema)


def _mixed(num: list[np.ndarray], den: list[np.ndarray], weights: list[np.ndarray], n: int, v: int) -> np.ndarray:
    """Probabilities up to the order that there are weights for."""
    p = np.full(len(num[0]), 1 / (v + 1))
    for k, w in enumerate(weights):
        if k == 0:
            p = w[0] * num[0] / max(n, 1) + (1 - w[0]) * p
        else:
            share = np.where(den[k - 1] > 0, w[bucket_of(den[k - 1])], 0.0)
            p = share * np.divide(num[k], den[k - 1], out=np.zeros(len(p)), where=den[k - 1] > 0) + (1 - share) * p
    return p


def _ratios(resolved: DataFrame, order: int, weights: list[np.ndarray], n: int, v: int) -> list[tuple[int, int, int]]:
    """(bucket, ratio, tokens) of the deleted fold for the next order: its estimate divided by what the orders below give, in steps of the grid."""
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["held"].to_pylist():
                flat = [x.astype(np.float64) for x in _unpack_all(data, *["<u8"] * (2 * order - 1))]
                num, den = flat[:order], flat[order:]
                if not len(num[0]):
                    continue
                ctx = den[k - 1] if k else np.full(len(num[0]), float(max(n, 1)))
                seen = ctx > 0
                ratio = num[k][seen] / ctx[seen] / _mixed(num, den, weights, n, v)[seen]
                cells, tokens = np.unique(np.stack([bucket_of(ctx[seen]) if k else np.zeros(int(seen.sum()), np.int64), _grid(ratio)], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"b": pa.array(cells[:, 0]), "q": pa.array(cells[:, 1]), "n": pa.array(tokens.astype(np.int64))})

    return [tuple(r) for r in resolved.select("held").mapInArrow(run, "b long, q long, n long").groupBy("b", "q").agg(F.sum("n").alias("n")).collect()]


def learn_weights(cells: list[tuple[int, int, int]], rounds: int = 500, still: float = 1e-9) -> np.ndarray:
    """An order's weight by bucket, from (bucket, log2 of its estimate over the lower orders', tokens) cells, by EM. A bucket
    without held-out tokens takes the weight of the next lower one."""
    a = np.array(cells, dtype=np.int64).reshape(-1, 3)
    ratio = np.where(a[:, 1] == ZERO, 0.0, np.exp2(a[:, 1] / GRID))
    weights, last = np.zeros(BUCKETS), 0.5
    for b in range(BUCKETS):
        r, n = ratio[a[:, 0] == b], a[a[:, 0] == b, 2]
        if len(r):
            w = 0.5
            for _ in range(rounds):
                new = float(n @ (w * r / (w * r + 1 - w))) / float(n.sum())
                done, w = abs(new - w) < still, min(max(new, LEAST), 1 - LEAST)
                if done:
                    break
            last = w
        weights[b] = last
    return weights


@dataclass
class Model:
    """Training totals and each order's weights by bucket (order 1 has one); ``scores`` has a row for each document."""

    n: int
    v: int
    weights: list[np.ndarray]
    scores: DataFrame


def train_and_score(docs: DataFrame, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, deleted: int = 3, order: int = 3, block_tokens: int = 2_000_000, fan: int = 128, bits: int | None = None) -> Model:
    """Learn from all documents but those of fold ``held_out``; score all of them."""
    spark = docs.sparkSession
    blocks = encode_blocks(docs, f"{out_dir}/blocks", id_col=id_col, text_col=text_col, block_tokens=block_tokens)
    total, count = blocks.agg(F.sum("n_tokens"), F.count("*")).first()
    width = min(64, (total or 0).bit_length() + 24)
    # Few blocks have few ranges, so that a range has about a block's share; many have 2 ** BITS of them on each level.
    bits = bits or min(BITS, max(3, count.bit_length()))
    answers = exchange(blocks, _read_block(held_out, deleted, order, width), count, f"{out_dir}/exchange", order=order, width=width, fan=fan, bits=bits)
    answers = materialize(answers, f"{out_dir}/answers")
    n, v, n_deleted = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v"), F.sum("n_deleted")).first())
    resolved = materialize(_resolve(blocks, answers, deleted, order, width), f"{out_dir}/resolved")
    for done in ("blocks", "exchange", "answers"):
        discard(spark, f"{out_dir}/{done}")
    weights: list[np.ndarray] = []
    for _ in range(order):
        weights.append(learn_weights(_ratios(resolved, order, weights, n - n_deleted, v)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, none = _unpack(row["ids"], "<i8"), _unpack(row["no_id"], "u1").astype(bool)
                folds, lengths = _unpack(row["folds"], "u1"), _unpack(row["lengths"], "<i8")
                counts = [_unpack(c, "<u8").astype(np.float64) for c in row["counts"]]
                at = np.cumsum(lengths) - lengths
                place = np.arange(len(counts[0])) - np.repeat(at, lengths)
                p = _mixed(counts, _contexts(counts, place, row["of_end"]), weights, n, v)
                known = np.add.reduceat((counts[0] > 0).astype(np.int64), at)
                base = np.add.reduceat(np.log10((counts[0] + 1) / (n + (v + 1))), at)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=none), "held_out": pa.array(folds == held_out), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), n, np.int64)), "base_score": pa.array(base), "score": pa.array(np.add.reduceat(np.log10(p), at))})

    scores = resolved.select("ids", "no_id", "folds", "lengths", "counts", "of_end").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return Model(n, v, weights, scores)
