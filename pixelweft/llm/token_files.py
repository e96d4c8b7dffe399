"""Token-ID files: a concatenated id array with Elias-Fano document boundaries.

One file holds a run of documents in ascending document id. Its boundaries (and its document ids)
are monotone sequences, kept in Elias-Fano form: about 2 + log2(u/n) bits a value and a 32-bit
sample for every 256th value, from which ``select`` finds any boundary without a 64-bit table.

Layout, little-endian::

    magic 8s | width u4 | n_docs u8 | n_null u8 | n_ids u8 | first_id i8 | len(bounds) u8 | len(doc ids) u8
    boundaries (Elias-Fano, n_docs + 1 values) | document ids - first_id (Elias-Fano) | ids

``width`` is 2 where the vocabulary has fewer than 65,536 ids, else 4.

Null texts count as empty, so they have the end id only. Documents without an id come first and are
counted in ``n_null``. Repeated document ids keep every row, ordered by the text's hash.
Empty tables give no file and no row.
"""

from __future__ import annotations

import itertools
import operator
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweft.llm.common import open_output, text_runs, worker_memo
from pixelweft.runtime import materialize

MAGIC = b"EFIDS\x001\n"
HEAD = struct.Struct("<8sIQQQqQQ")
EF_HEAD = struct.Struct("<QQBQQQ")
SAMPLE = 256
#: Distinct chunks, and parts of them, whose ids a worker keeps at once; half go beyond it.
MEMO = 1_000_000
#: Tasks that write; beyond so many, each writes more files.
MOST_TASKS = 100_000
#: Tasks whose files are summed up together.
GROUP = 1024
#: Characters of the texts that are encoded together, and parts that the tokenizer gets at once.
BATCH_CHARS, PARTS = 100_000, 1000
#: Marks that may follow a chunk's letters.
MARKS = ".,!?"


class EliasFano:
    """A non-decreasing sequence of whole numbers at or above 0."""

    def __init__(self, n: int, top: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.high, self.low, self.samples = n, top, low_bits, high, low, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        low = np.zeros((n, low_bits), dtype=np.uint8)
        for b in range(low_bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        return cls(n, top, low_bits, np.packbits(bits, bitorder="little"), np.packbits(low.ravel(), bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [self.high.tobytes(), self.low.tobytes(), self.samples.tobytes()]
        return EF_HEAD.pack(self.n, self.top, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        n, top, low_bits, *sizes = EF_HEAD.unpack_from(data)
        cuts = np.cumsum([EF_HEAD.size, *sizes])
        high, low, samples = (np.frombuffer(data[a:b], dtype=k) for a, b, k in zip(cuts, cuts[1:], ("u1", "u1", "<u4"), strict=False))
        return cls(n, top, low_bits, high, low, samples)

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.uint64)
        start, stop = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
        return bits.reshape(count, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The value at place i: from the nearest sample, over the few bytes that follow it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, size = at // 8, 64
        skip = at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + size], bitorder="little")[skip:])
            if len(ones) > left:
                break
            size *= 4
        where = at + int(ones[left])
        return ((where - i) << self.low_bits) + int(self._low(i, 1)[0])

    def decode(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) + self._low(0, self.n)


class TokenFile:
    """Random access to one file's documents."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.n_docs, self.n_null, self.n_ids, self.first_id, b, d = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.bounds = EliasFano.from_bytes(view[at : at + b])
        self.doc_ids = EliasFano.from_bytes(view[at + b : at + b + d])
        self.ids = np.frombuffer(view[at + b + d :], dtype=f"<u{width}", count=self.n_ids)

    def span(self, i: int) -> tuple[int, int]:
        return self.bounds.select(i), self.bounds.select(i + 1)

    def tokens(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.ids[a:b]

    def all_doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [int(x) + self.first_id for x in self.doc_ids.decode()]


def pack(doc_ids: list[int | None], runs: list[bytes], width: int) -> bytes:
    """One file from documents in order: ids (None first) and each one's token bytes."""
    known = [x for x in doc_ids if x is not None]
    first = known[0] if known else 0
    ends = np.cumsum([0, *(len(r) // width for r in runs)])
    bounds = EliasFano.encode(ends).to_bytes()
    names = EliasFano.encode(np.array([x - first for x in known], dtype=np.uint64)).to_bytes()
    return HEAD.pack(MAGIC, width, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), first, len(bounds), len(names)) + bounds + names + b"".join(runs)


class Encoder:
    """Text to token bytes. The pre-tokenizer drops white space and no token crosses it, so a text is
    encoded chunk by chunk between blanks and line feeds, and frequent chunks only once. It also parts
    letters from marks behind them and lower-cases, so a chunk of letters and final marks is put
    together from its lower-case letters and its marks. Which characters that holds for is asked of the tokenizer, one by one, when they first
    occur; a chunk with any other character is encoded as it is."""

    def __init__(self, tokenizer_path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = b"" if end_id is None else int(end_id).to_bytes(self.width, "little")
        # Where the last token of each word says so, words are counted by it.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocab.values(), default=-1) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.letters = ""
        self.others: set[str] = set()
        self.memo: dict[str, bytes] = {"": b""}

    def _joins_letters(self, c: str) -> bool:
        """Whether this tokenizer keeps a character in one part with letters before it, apart from any mark behind it, in lower case and
        out of it alike. Its own normaliser and splitter are asked, as a character may become several there: U+0130 gets
        a combining dot, which isn't a letter and goes with the mark."""
        normal, parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if c == "\u03a3" or normal is None or parts is None or not c.isalpha():
            return False
        low = normal.normalize_str(c)
        if normal.normalize_str(c.lower()) != low:
            return False
        for m in (*MARKS, MARKS):
            found = parts.pre_tokenize_str(f"a{low}a{low}{m}")
            if len(found) != 2 or found[1] != (m, (2 + 2 * len(low), 2 + 2 * len(low) + len(m))):
                return False
        return normal.normalize_str(f"a{c}a{c}{MARKS}") == f"a{low}a{low}{MARKS}"

    def _learn(self, parts: list[str], single: bool) -> None:
        """Encode parts in one call, put together with blanks, and cut the ids at the parts' places. If each part is to be a ``single`` word and there
        are as many words as parts, they are cut where words end, which spares the places of all tokens."""
        text = " ".join(parts)
        if single and len(self.ends):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(cuts) == len(parts) + 1:
                self._keep(parts, ids, cuts)
                return
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        got = self.tokenizer.encode(text, add_special_tokens=False)
        self._keep(parts, np.array(got.ids, dtype=np.int64), np.searchsorted(np.array([o[0] for o in got.offsets], dtype=np.int64), starts) * self.width)

    def _keep(self, parts: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        run, at = ids.astype(self.kind).tobytes(), cuts.tolist()
        self.memo.update(zip(parts, map(run.__getitem__, map(slice, at, at[1:])), strict=False))

    def _take_in(self, chunks: dict[str, None]) -> None:
        """Encode chunks that occur for the first time: each one's letters in lower case and its marks apart, or the chunk itself, unless all
        its letters are known to be parted there."""
        unseen = set("".join(chunks)).difference(self.letters, self.others)
        self.letters += "".join(filter(self._joins_letters, sorted(unseen)))
        self.others |= unseen.difference(self.letters)
        letters, memo, single, whole, pairs = self.letters, self.memo, {}, {}, []
        for c in chunks:
            head = c.rstrip(MARKS)
            if head.strip(letters):
                whole[c] = None
            elif not head or c == (low := head.lower()):
                single[c] = None
            else:
                tail = c[len(head) :]
                for part in (low, tail):
                    if part not in memo:
                        single[part] = None
                pairs.append((c, low, tail))
        for found, alone in ((single, True), (whole, False)):
            parts = list(found)
            for at in range(0, len(parts), PARTS):
                self._learn(parts[at : at + PARTS], alone)
        for c, low, tail in pairs:
            memo[c] = memo[low] + memo[tail] if tail else memo[low]

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The token bytes of some texts, whose chunks are looked up once and whose new chunks are encoded together."""
        split = [t.replace("\n", " ").split(" ") if t else () for t in texts]
        chunks = list(itertools.chain.from_iterable(split))
        got = list(map(self.memo.get, chunks))
        if new := list(itertools.compress(range(len(got)), map(operator.is_, got, itertools.repeat(None)))):
            self._take_in(dict.fromkeys(map(chunks.__getitem__, new)))
            for i in new:
                got[i] = self.memo[chunks[i]]
        out, at = [], 0
        for s in split:
            out.append(b"".join(got[at : at + len(s)]) + self.end)
            at += len(s)
        if len(self.memo) > MEMO:  # what came first is what comes often
            self.memo = dict(itertools.islice(self.memo.items(), MEMO // 2))
        return out


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, file_bytes: int = 16 << 20) -> DataFrame:
    """Encode every document and write the files; returns the manifest (part, file, n_docs, n_ids).

    Documents go to tasks by ranges of (id, text hash, place in the input), which Spark samples: so null ids, ids that repeat and
    even rows that repeat as a whole are parted where they are many, and the text is shuffled once. A task writes
    a file for about every ``file_bytes`` of text, which is what it holds at a time. The place tells equal rows apart only, so ``docs`` should be read
    from files, whose rows a repeated task finds in the same order.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    total = own.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.col("th").asc()]
    keyed = own.withColumns({"th": F.xxhash64("body"), "place": F.monotonically_increasing_id()})
    placed = keyed.repartitionByRange(max(1, min(MOST_TASKS, round(total / file_bytes))), *order, "place").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = worker_memo(("ids", tokenizer_path, end_id), lambda: Encoder(tokenizer_path, end_id))
        task, number, names, runs, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{out_dir}/ids/part-{task:08d}-{number:06d}.efids"
            stream, commit = open_output(path)
            stream.write(pack(names, runs, encode.width))
            commit()
            return pa.RecordBatch.from_pydict({"part": pa.array([task << 32 | number], pa.int64()), "file": [path.rsplit("/", 1)[1]], "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([sum(map(len, runs)) // encode.width], pa.int64())})

        for batch in batches:
            ids = batch["id"].to_pylist()
            for a, b in text_runs(batch["body"], BATCH_CHARS):
                texts = batch["body"].slice(a, b - a).to_pylist()
                for i, text, run in zip(ids[a:b], texts, encode.many(texts), strict=True):
                    names.append(i)
                    runs.append(run)
                    held += len(text or "")
                    if held >= 2 * file_bytes:
                        yield flush()
                        number, names, runs, held = number + 1, [], [], 0
        if names:
            yield flush()

    manifest = placed.select("id", "body").mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    return materialize(manifest, f"{out_dir}/manifest")


def bases(manifest: DataFrame) -> DataFrame:
    """(file, base): the ids of all files before each one. Sums run inside groups of GROUP tasks and over the groups' totals, so that
    no task sees the whole manifest."""
    group = F.shiftright(F.col("part"), 32 + GROUP.bit_length() - 1)
    own = manifest.select("file", "part", "n_ids", group.alias("g"))
    ahead = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("g").agg(F.sum("n_ids").alias("t")).select("g", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(totals, "g").select("file", (F.col("before") + F.col("own")).alias("base"))


def read_token_files(spark, out_dir: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: id, start (ids of all documents before it), n_tokens and the
    unsigned crc32 of its ids as little-endian 32-bit numbers. Files are read by Spark's own reader."""
    import zlib

    schema = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                f = TokenFile(content.as_buffer())
                ends = f.bounds.decode().astype(np.int64)
                crc = [zlib.crc32(f.ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"file": [path.rsplit("/", 1)[1]] * f.n_docs, "doc_id": pa.array(f.all_doc_ids(), pa.int64()), "local_start": pa.array(ends[:-1]), "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crc, pa.int64())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.efids").load(f"{out_dir}/ids")
    return files.select("path", "content").mapInArrow(read, schema).join(bases(manifest), "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
