"""Benchmark decontamination over a distributed positional inverted index.

The corpus is cut into segments of about ``segment_words`` words. A segment's index is one row: its dictionary, all its terms in
order, and for each term the ascending positions (postings) at which it stands; positions run through
the segment, with a gap between documents, so that no phrase crosses two. Postings are packed in runs of terms, so that a search unpacks only those
that hold a term it looks for. The index holds every word of the corpus and knows nothing of a benchmark: it is written once, and any
number of test sets can be searched in it (``open_index``).

A phrase t0..tk is found in a segment by intersecting offset-adjusted lists from the rarest term: its
postings, minus its offset, are the candidate starts; the other terms' lists, by growing length, strike out
candidates. All phrases of a block of the benchmark are intersected at once. A proximity match is a
posting of the phrase's rarest term with every other term of it within ``slop`` words.

The corpus is never shuffled or grouped by term, so no frequent term, passage or copied document is a hot
key. The benchmark goes to the segments in blocks of at most ``block_phrases`` phrases, each broadcast with its own terms; a larger
benchmark means more passes over the same index, one block at a time, whose hits are put together by document.

Words are runs of letters and digits ([a-z0-9] after lower-casing A-Z) and of any characters beyond ASCII. Null and empty
texts have no words. Benchmark rows without words match nothing; rows that repeat an item id add to that item's
phrases; a null item id is ignored. Repeated documents are each reported. An empty table gives no rows; an empty
benchmark finds nothing. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.llm.common import LOWER_ASCII
from pixelweft.runtime import discard, materialize

#: A word, over UTF-8 bytes after lower-casing A-Z: the bytes outside these ASCII ranges.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SEGMENTS = "segment long, doc_ids binary, no_id binary, hashes binary, starts binary, n_words binary, terms binary, counts binary, runs binary, postings array<binary>"
#: Postings of a run of terms, about: a longer list is a run of its own.
RUN = 16_384


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII)) if text else []


def phrases(item: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of an item: all runs of ``window`` words, or the whole of a shorter item."""
    if not item:
        return []
    return [tuple(item[i : i + window]) for i in range(max(1, len(item) - window + 1))]


@dataclass
class Block:
    """Phrases of one block of the benchmark, over its own numbered terms."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray  # phrases x longest phrase, term number or -1
    lengths: np.ndarray
    items: list[list[int]]  # items of each phrase


def read_benchmark(items: DataFrame, *, id_col: str, text_col: str, window: int, block_phrases: int) -> tuple[list[Block], dict[int, object]]:
    """The benchmark's phrases in blocks, and its item ids by number. The benchmark is a test
    set, read by the driver row by row."""
    found: dict[tuple[bytes, ...], set[int]] = {}
    names: dict[object, int] = {}
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if r.i is None:
            continue
        for p in phrases(words(r.t), window):
            found.setdefault(p, set()).add(names.setdefault(r.i, len(names)))
    every, blocks = list(found), []
    for a in range(0, len(every), block_phrases):
        part = every[a : a + block_phrases]
        wide = max(map(len, part))
        vocabulary: dict[bytes, int] = {}
        terms = np.full((len(part), wide), -1, dtype=np.int32)
        for k, p in enumerate(part):
            terms[k, : len(p)] = [vocabulary.setdefault(w, len(vocabulary)) for w in p]
        blocks.append(Block(vocabulary, terms, np.array([len(p) for p in part], dtype=np.int64), [sorted(found[p]) for p in part]))
    return blocks, {v: k for k, v in names.items()}


def _pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")


def _unpack(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)


def build_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", gap: int = 64, segment_words: int = 500_000) -> DataFrame:
    """Write the segments' postings and return them as a table, one row for each segment. Phrases and proximity searched in it reach
    less than ``gap`` words."""

    def pack_segment(number: int, ids: list, hashes: list[int], rank: dict[bytes, int], found: list[np.ndarray]) -> dict:
        import zstandard

        counts = np.array([len(f) for f in found], "<i8")
        starts = np.cumsum(np.append(0, counts + gap))[:-1]
        flat = np.concatenate(found)
        where = np.repeat(starts, counts) + np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        dictionary = sorted(rank)
        place = np.empty(len(rank), dtype=np.int32)
        place[[rank[w] for w in dictionary]] = np.arange(len(rank), dtype=np.int32)
        flat = place[flat]
        order = np.argsort(flat, kind="stable")
        where = where[order].astype("<u4")
        each = np.bincount(flat, minlength=len(rank))
        ends = np.cumsum(each)
        # A run ends at the first term beyond every RUN postings.
        last = np.unique(np.append(np.searchsorted(ends, np.arange(RUN, len(flat), RUN)) + 1, len(rank))) if len(rank) else np.empty(0, np.int64)
        edges = np.append(0, ends[last - 1]).tolist()
        lists = [_pack(np.diff(where[a:b], prepend=np.uint32(0))) for a, b in zip(edges, edges[1:], strict=False)]  # steps wrap at a list's first posting, and unwrap by summing
        numbers = {"doc_ids": np.array([i or 0 for i in ids], "<i8"), "no_id": np.array([i is None for i in ids], "u1"), "hashes": np.array(hashes, "<i8"), "starts": starts.astype("<i8"), "n_words": counts, "counts": each.astype("<u4"), "runs": last.astype("<i4")}
        return {k: _pack(v) for k, v in numbers.items()} | {"segment": number, "terms": zstandard.ZstdCompressor(level=1).compress(b"\n".join(dictionary)), "postings": lists}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, numbers = TaskContext.get().partitionId(), itertools.count()
        fresh = lambda: ([], [], defaultdict(itertools.count().__next__), [])
        (ids, hashes, rank, found), total = fresh(), 0
        names = [f.split()[0] for f in SEGMENTS.split(", ")]

        def flush() -> pa.RecordBatch:
            row = pack_segment(task << 32 | next(numbers), ids, hashes, rank, found)
            kinds = {"segment": pa.int64(), "postings": pa.list_(pa.binary())}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], kinds.get(k, pa.binary())) for k in names], names=names)

        for batch in batches:
            for i, th, text in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), batch["body"], strict=True):
                w = words(text.as_py())
                ids.append(i)
                hashes.append(th)
                found.append(np.fromiter(map(rank.__getitem__, w), dtype=np.int32, count=len(w)))
                total += len(w)
                if total >= segment_words:
                    yield flush()
                    (ids, hashes, rank, found), total = fresh(), 0
        if ids:
            yield flush()

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("body"))
    return materialize(own.mapInArrow(build, SEGMENTS), path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that was written before."""
    return spark.read.schema(SEGMENTS).parquet(path)


class Segment:
    """One segment's lists of some terms, by the numbers that ``vocabulary`` gives them, and searches over them."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        import zstandard

        self.doc_ids, self.no_id, self.hashes = _unpack(row["doc_ids"], "<i8"), _unpack(row["no_id"], "u1").astype(bool), _unpack(row["hashes"], "<i8")
        self.starts, self.n_words = _unpack(row["starts"], "<i8"), _unpack(row["n_words"], "<i8")
        self.size = int(self.starts[-1] + self.n_words[-1]) + 1 if len(self.starts) else 1
        dictionary = zstandard.ZstdDecompressor().decompress(row["terms"]).split(b"\n")
        number = np.fromiter((vocabulary.get(w, -1) for w in dictionary), dtype=np.int64, count=len(dictionary))
        here = np.flatnonzero(number >= 0)
        counts, runs = _unpack(row["counts"], "<u4").astype(np.int64), _unpack(row["runs"], "<i4")
        ends = np.cumsum(counts)
        lists = []
        for run in np.unique(np.searchsorted(runs, here, side="right")).tolist():
            first = runs[run - 1] if run else 0
            own = here[(here >= first) & (here < runs[run])]
            base = ends[first] - counts[first]
            places = np.cumsum(_unpack(row["postings"][run], "<u4"), dtype=np.uint32).astype(np.int64)
            lists += [(int(number[t]), places[ends[t] - counts[t] - base : ends[t] - base]) for t in own.tolist()]
        lists.sort(key=lambda x: x[0])
        self.terms = np.array([t for t, _ in lists], dtype=np.int64)
        self.offsets = np.cumsum([0, *(len(p) for _, p in lists)])
        self.postings = np.concatenate([p for _, p in lists]) if lists else np.empty(0, np.int64)
        # Term and position in one key: the postings are in ascending order of it.
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.offsets)) * self.size + self.postings

    def _local(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The phrases' terms as places in this segment's term list, and those lists' lengths: 0 if a term is missing,
        a length beyond all others past a phrase's end."""
        if not len(self.terms):
            return np.zeros_like(block.terms, dtype=np.int64), np.zeros(block.terms.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, block.terms), len(self.terms) - 1)
        count = np.where(self.terms[at] == block.terms, np.diff(self.offsets)[at], 0)
        return at, np.where(block.terms < 0, np.iinfo(np.int64).max, count)

    def _seeds(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases all of whose terms occur here, their terms by growing list, and each posting of the rarest as
        (phrase, position)."""
        order = np.argsort(count, axis=1, kind="stable")
        live = np.flatnonzero(count.min(axis=1) > 0) if len(count) else np.empty(0, np.int64)
        rare = order[live, 0]
        lists = at[live, rare]
        sizes = np.diff(self.offsets)[lists] if len(live) else np.empty(0, np.int64)
        phrase = np.repeat(live, sizes)
        inside = np.arange(len(phrase)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return order, phrase, self.postings[np.repeat(self.offsets[lists], sizes) + inside] if len(live) else phrase

    def exact(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence."""
        at, count = self._local(block)
        order, phrase, where = self._seeds(at, count)
        start = where - order[phrase, 0]
        keep = start >= 0
        phrase, start = phrase[keep], start[keep]
        for k in range(1, block.terms.shape[1]):
            j = order[phrase, k]
            more = block.terms[phrase, j] >= 0
            key = at[phrase, j] * self.size + start + j
            hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key if len(key) else more
            keep = hit | ~more
            phrase, start = phrase[keep], start[keep]
        return phrase, start

    def near(self, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its rarest term) wherever every other term is within ``slop`` words."""
        at, count = self._local(block)
        order, phrase, where = self._seeds(at, count)
        doc = np.searchsorted(self.starts, where, side="right") - 1
        low, high = self.starts[doc], self.starts[doc] + self.n_words[doc] - 1
        for k in range(1, block.terms.shape[1]):
            j = order[phrase, k]
            more = block.terms[phrase, j] >= 0
            base = at[phrase, j] * self.size
            first = np.searchsorted(self.keys, base + np.maximum(where - slop, low))
            found = self.keys[np.minimum(first, len(self.keys) - 1)] if len(phrase) else base
            keep = ((first < len(self.keys)) & (found >= base) & (found <= base + np.minimum(where + slop, high))) | ~more
            phrase, where, low, high = phrase[keep], where[keep], low[keep], high[keep]
        return phrase, where


def _search_block(index: DataFrame, block: Block, text: dict[int, str], slop: int | None, covered: bool) -> DataFrame:
    """Every document's hits with one block: segment, place, and the columns of ``search``; with ``covered`` also the hit words' places."""
    held = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row, block.vocabulary)
                cover = np.zeros(s.size + 1, dtype=np.int32)
                items: list[set[int]] = [set() for _ in s.doc_ids]
                near: list[set[int]] = [set() for _ in s.doc_ids]
                phrase, start = s.exact(block)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + block.lengths[phrase], -1)
                doc = np.searchsorted(s.starts, start, side="right") - 1
                for d, p in {*zip(doc.tolist(), phrase.tolist(), strict=True)}:
                    items[d].update(block.items[p])
                if slop is not None:
                    phrase, where = s.near(block, slop)
                    doc = np.searchsorted(s.starts, where, side="right") - 1
                    for d, p in {*zip(doc.tolist(), phrase.tolist(), strict=True)}:
                        near[d].update(block.items[p])
                inside = np.cumsum(cover) > 0
                hit = np.append(0, np.cumsum(inside))
                n_hit = hit[s.starts + s.n_words] - hit[s.starts]
                listed = lambda sets: pa.array([sorted(text[i] for i in x) for x in sets], pa.list_(pa.string()))
                places = [np.flatnonzero(inside[a : a + n]).tolist() if h else [] for a, n, h in zip(s.starts.tolist(), s.n_words.tolist(), n_hit.tolist(), strict=True)] if covered else [None] * len(items)
                yield pa.RecordBatch.from_pydict({"segment": pa.array([row["segment"]] * len(items), pa.int64()), "place": pa.array(range(len(items)), pa.int32()), "doc_id": pa.array(s.doc_ids, pa.int64(), mask=s.no_id), "text_hash": pa.array(s.hashes), "n_words": pa.array(s.n_words), "n_hit": pa.array(n_hit.astype(np.int64)), "items": listed(items), "near_items": listed(near) if slop is not None else pa.nulls(len(near), pa.list_(pa.string())), "covered": pa.array(places, pa.list_(pa.int32()))})

    return index.mapInArrow(run, "segment long, place int, doc_id long, text_hash long, n_words long, n_hit long, items array<string>, near_items array<string>, covered array<int>")


def search(index: DataFrame, blocks: list[Block], names: dict[int, object], *, slop: int | None = None) -> DataFrame:
    """Per document: doc_id, text_hash (xxhash64 of the text), n_words, n_hit (words inside an exact occurrence), items (sorted as strings), and
    near_items: items with a phrase all of whose terms are within ``slop`` words of its rarest one (null without ``slop``)."""
    text = {k: str(v) for k, v in names.items()}
    blocks = blocks or [Block({}, np.full((0, 1), -1, np.int32), np.empty(0, np.int64), [])]
    columns = ["doc_id", "text_hash", "n_words", "n_hit", "items", "near_items"]
    parts = [_search_block(index, b, text, slop, len(blocks) > 1) for b in blocks]
    if len(parts) == 1:
        return parts[0].select(*columns)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    done = functools.reduce(DataFrame.unionByName, parts).groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.size(every("covered")).cast("long").alias("n_hit"),
        every("items").alias("items"), (every("near_items") if slop is not None else F.first("near_items")).alias("near_items"),
    )
    return done.select(*columns)


def decontaminate(docs: DataFrame, items: DataFrame, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = None, block_phrases: int = 50_000) -> DataFrame:
    """Index the documents and search all phrases of the benchmark."""
    blocks, names = read_benchmark(items, id_col=item_id_col, text_col=item_text_col, window=window, block_phrases=block_phrases)
    index = build_index(docs, f"{out_dir}/index", id_col=id_col, text_col=text_col, gap=max(window, slop or 0) + 1)
    return search(index, blocks, names, slop=slop)


def drop_contaminated(docs: DataFrame, items: DataFrame, out_dir: str, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no phrase of the benchmark. A text is known again by its hash."""
    found = decontaminate(docs, items, out_dir, text_col=text_col, **options)
    bad = materialize(found.filter("n_hit > 0").select(F.col("text_hash").alias("pw_th")).distinct(), f"{out_dir}/contaminated")
    discard(docs.sparkSession, f"{out_dir}/index")
    return docs.withColumn("pw_th", F.xxhash64(F.col(text_col).cast("string"))).join(bad, "pw_th", "left_anti").drop("pw_th")
