"""Images, annotations and masks as files."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.sources.files import open_output

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
PIXELS = "path string, y int, x int, r int, g int, b int"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, y, x, r, g, b) of image files. Spark's reader gives blue first; grey images have one level for all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w, n = row["height"], row["width"], row["nChannels"]
                a = np.frombuffer(row["data"], dtype=np.uint8).reshape(h * w, n).astype(np.int32)
                b, g, r = (a[:, k] for k in ((0, 1, 2) if n >= 3 else (0, 0, 0)))
                at = np.arange(h * w)
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["origin"]] * len(at)), "y": pa.array((at // w).astype(np.int32)), "x": pa.array((at % w).astype(np.int32)), "r": pa.array(r), "g": pa.array(g), "b": pa.array(b)})

    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, PIXELS)


def read_annotations(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, y, x, ann) of .npy files; other kinds of files that ``glob`` lets through raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if not path.lower().endswith(".npy"):
                    raise ValueError(f"annotations are .npy files: {path}")
                a = np.load(io.BytesIO(content), allow_pickle=False).astype(np.int32)
                y, x = np.indices(a.shape, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * a.size), "y": pa.array(y.ravel()), "x": pa.array(x.ravel()), "ann": pa.array(a.ravel())})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, "path string, y int, x int, ann int")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_indexed_png(labels: np.ndarray, palette: np.ndarray) -> bytes:
    """An 8-bit palette PNG."""
    h, w = labels.shape
    rows = np.zeros((h, w + 1), dtype=np.uint8)
    rows[:, 1:] = labels
    head = struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"PLTE", palette.astype(np.uint8).tobytes()) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def decode_indexed_png(data: bytes) -> np.ndarray:
    """The indices of an 8-bit palette PNG, which image readers would turn into colours."""
    at, body, size = 8, b"", (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if (depth, color, interlace) != (8, 3, 0):
                raise ValueError("not an 8-bit palette PNG")
            size = (h, w)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    h, w = size
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, w + 1)
    out = np.zeros((h, w), dtype=np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(int)
        up = out[y - 1].astype(int) if y else np.zeros(w, int)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(w):
                a, b, c = (int(out[y, x - 1]) if x else 0), int(up[x]), (int(up[x - 1]) if x else 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                out[y, x] = (line[x] + guess) & 255
    return out


def write_masks(labels: DataFrame, out_dir: str, palette: list[tuple[int, int, int]], kind: str = "png", shift: int = 0, value: str = "label", key: str = "img", suffix: str = "_index") -> DataFrame:
    """One file for each image of (img, y, x, label): a palette PNG or an .npy. Returns (img, file). ``key`` may be another column that names images, a string too; a file has that name and ``suffix``. ``shift`` is added to each
    index before it gets its colour."""
    colors = np.zeros((256, 3), dtype=np.uint8)
    if palette:
        colors[: len(palette)] = palette

    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype=np.int32)
        a[y, x] = table["pw_value"].to_numpy()
        if kind == "png":
            data = encode_indexed_png((a + shift).astype(np.uint8), colors)
        else:
            buffer = io.BytesIO()
            np.save(buffer, a)
            data = buffer.getvalue()
        img = table[key][0].as_py()
        name = f"{img}{suffix}.{kind}"
        stream, commit = open_output(f"{out_dir}/{name}")
        stream.write(data)
        commit()
        return pa.table({key: pa.array([img], table[key].type), "file": [name]})

    named = F.col(key) if labels.schema[key].dataType.simpleString() == "string" else F.col(key).cast("long")
    rows = labels.select(named.alias(key), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("int").alias("pw_value"))
    return rows.groupBy(key).applyInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, file string")


def label_palette(class_colors: dict[int, tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The palette of exported masks: label k is drawn in the colour of class k + 1; classes without one are black."""
    top = max(class_colors, default=0)
    return [class_colors.get(k + 1, (0, 0, 0)) for k in range(min(top, 256))]


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(file, y, x, label) of palette PNGs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                a = decode_indexed_png(content).astype(np.int32)
                y, x = np.indices(a.shape, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"file": pa.array([name.rsplit("/", 1)[1]] * a.size), "y": pa.array(y.ravel()), "x": pa.array(x.ravel()), "label": pa.array(a.ravel())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, y int, x int, label int")


def base_name(stem: Column) -> Column:
    """A file's stem without the first of its annotation suffixes that fits; at most one goes."""
    return F.regexp_replace(stem, "(_anns_scribbleids|_scribbleids|_anns)$", "")


def listing(files: DataFrame, suffixes: tuple[str, ...] = ("npy",), start: int = 1, count: int = 0) -> DataFrame:
    """Paths with one of the suffixes, in any case of letters, sorted; from the ``start``-th (counted from 1) on, ``count`` of them (0: all)."""
    out = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).orderBy("path")
    out = out.offset(start - 1) if start > 1 else out
    return out.limit(count) if count > 0 else out


def file_name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of a folder's files; what they hold isn't read."""
    return spark.read.format("binaryFile").load(folder).select("path")


def with_base(files: DataFrame) -> DataFrame:
    name = file_name("path")
    return files.withColumns({"stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def match_images(anns: DataFrame, images: DataFrame) -> DataFrame:
    """Each annotation (path) with its image's path, or null: of the images with its base name, the one whose extension
    comes first."""
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("ext"))
    found = with_base(images).filter(F.col("ext").isin(*EXTENSIONS)).groupBy(F.col("stem").alias("base")).agg(F.min_by("path", F.struct(rank, "path")).alias("image"))
    return with_base(anns).withColumn("base", base_name(F.col("stem"))).join(found, "base", "left").select("path", "base", "image")
