"""Quality rules from tokeniser fertility.

Public vocabularies are built for ordinary prose: it costs them a typical number of characters for each token, few
byte-fallback tokens, and spreads over many tokens. Each text is encoded as a whole, its blanks and line feeds too, and measured by

* characters per token, of words: runs of blanks and line feeds cost tokens and give no characters,
* byte-fallback share: tokens that stand for single bytes,
* token entropy in bits, over the text's tokens, as a share of the most that so many tokens can have.

Rejection bands belong to a group of texts: those of one language (or, where it is null, of one script of most letters) and of one
length, in octaves of tokens, as both measures depend on it. A band is the group's median, plus and minus a floor and ``width``
times the distance to the quartile on that side (as standard deviations), so that the junk in a group hardly
widens its band. Statistics come from histograms of fixed resolution, counted on the executors over every distinct text
(by 64-bit hash), so that copies of one text, however many, weigh as one:
what the driver gets is bounded by groups and bins. Where an octave has fewer than ``min_texts`` distinct texts, its band is that of
the octaves from the one below to the one above, or else that of all lengths of its language or script; these judge the means by token only, as the share of entropy
falls with length and ordinary texts would leave a band of other lengths. Languages and scripts
with fewer in all are too small to tell what is usual, and reject nothing.

Texts with fewer than ``min_tokens`` tokens are too short to judge: no verdict against them. A text also fails by
the base rules: under 10 words, or more than a fifth of its words in repeated 5-word windows. Null
and empty texts have no words and fail. Repeated rows are each judged alike. Extra columns don't matter. An
empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.llm.common import worker_memo
from pixelweft.runtime import discard, materialize

WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: ASCII white space, as in the byte sets of the base rules; a word is anything else.
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
#: Characters of a text that are encoded at a time, and a place where a text may be cut: before a blank with another character in front.
PART = 200_000
MARK = "\u2581"
CUT = re.compile(f"[^ {MARK}] ")
BINS = 10_000
#: Measures whose level changes with a text's length: bands of other lengths don't hold for them.
BY_LENGTH = ("entropy_share",)
#: Groups whose bands a broadcast may hold, of seven numbers each; more are joined plainly.
BROADCAST_GROUPS = 20_000

STATS = "chars_per_token double, byte_share double, entropy_share double"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Bands:
    """How far from its group's middle a text may be: ``floor + width * spread``. Measures are counted in BINS bins up to ``top``."""

    width: float = 4.0
    floor: tuple[tuple[str, float], ...] = (("chars_per_token", 0.02), ("byte_share", 0.05), ("entropy_share", 0.02))
    top: tuple[tuple[str, float], ...] = (("chars_per_token", 20.0), ("byte_share", 1.0), ("entropy_share", 1.0))
    min_tokens: int = 40
    min_texts: int = 30


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first one included.
    ``ids`` number the text's distinct words from 0. Windows get exact keys: word numbers are packed
    into 63 bits, and replaced by ranks where they wouldn't fit."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    key, card = ids[:n].astype(np.int64), base
    for k in range(1, size):
        if card * base >= 1 << 63:
            seen, key = np.unique(key, return_inverse=True)
            card = len(seen)
        key = key * base + ids[k : k + n]
        card *= base
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    cover[:n] += twice
    cover[size : size + n] -= twice
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if NOT_BLANK.search(x)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """Script of most letters, by the first word of their Unicode names; 'NONE' without letters."""
    seen: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            name = unicodedata.name(c, "NONE").split(" ", 1)[0]
            seen[name] = seen.get(name, 0) + text.count(c)
    return max(seen, key=lambda k: (seen[k], k)) if seen else "NONE"


class Measurer:
    """Base counts and fertility of texts."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        # No piece goes on past a blank, nor holds a line feed, in the public models; others are encoded in one go whatever their length.
        inside = [self.model.id_to_piece(i) for i in range(size)]
        self.parts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in inside) and len(self.model.encode("\n")) == 2

    def tokens(self, text: str) -> np.ndarray:
        """The ids of the whole text. Long ones are encoded in parts that begin with a blank, which gives the same ids in bounded memory: a line
        feed put before a part keeps the model from adding a blank, and its two ids go."""
        if len(text) <= PART or not self.parts:
            return np.array(self.model.encode(text), dtype=np.int32)
        out, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + PART)
            end = cut.start() + 1 if cut else len(text)
            ids = self.model.encode(("\n" if at else "") + text[at:end])
            out.append(np.array(ids[2 if at else 0 :], dtype=np.int32))
            at = end
        return np.concatenate(out)

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return (0, 0, len(SYMBOLS.findall(text)), repeated_lines(text), 0, 0, 0.0, 0.0, 0.0)
        tokens = self.tokens(text)
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        counts = np.bincount(tokens)
        n = len(tokens)
        share = counts[counts > 0] / n
        entropy = float(-(share * np.log2(share)).sum())
        rank = defaultdict(itertools.count().__next__)
        ids = np.fromiter(map(rank.__getitem__, words), dtype=np.int32, count=len(words))
        return (len(words), chars, len(SYMBOLS.findall(text)), repeated_lines(text), repeated_words(ids), n, chars / max(n, 1), float(self.is_byte[tokens].mean()) if n else 0.0, entropy / np.log2(n) if n > 1 else 0.0)


def measure(docs: DataFrame, model_path: str, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` and pw_stats (names that begin with pw_ are reserved): the base counts, the fertility measures and the band's group."""
    own = docs.withColumn("pw_text", F.col(text_col).cast("string")).withColumn("pw_lang", F.col(lang_col).cast("string"))
    fields = f"{BASE}, n_tokens long, {STATS}, band_group string"

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>")
    def stats(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        run = worker_memo(("fertility", model_path), lambda: Measurer(model_path))
        names = [f.split()[0] for f in fields.split(", ")]
        kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]] for f in fields.split(", ")]
        for texts, langs in batches:
            out = []
            for t, lang in zip(texts, langs.to_pylist(), strict=True):
                t = t.as_py()
                out.append((*run(t), f"lang:{lang}" if lang is not None else f"script:{script_of(t or '')}"))
            cols = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return own.withColumn("pw_stats", stats("pw_text", "pw_lang")).drop("pw_text", "pw_lang")


def _quantile(bins: list[tuple[int, int]], q: float) -> float:
    """Middle of the bin that holds the q-quantile, as a share of the range; ``bins`` are (bin, texts), ascending."""
    total, at = sum(n for _, n in bins), 0
    for b, n in bins:
        at += n
        if at >= q * total:
            break
    return (b + 0.5) / BINS


def _octave(s: str = "pw_stats") -> Column:
    return F.floor(F.log2(f"{s}.n_tokens")).cast("int")


def _widening(octave: int, octaves: list[int]) -> Iterator[list[int]]:
    """The octave alone, with its neighbours, and all of its group."""
    yield [octave]
    yield [o for o in octaves if abs(o - octave) <= 1]
    yield octaves


def learn_bands(measured: DataFrame, bands: Bands = Bands()) -> dict[tuple[str, int], dict[str, tuple[float, float]]]:
    """{(group, octave): {measure: (lowest, highest)}}, without measures that its texts can't be judged by, from every distinct text (pw_id) with enough tokens."""
    judged = measured.filter(F.col("pw_stats.n_tokens") >= bands.min_tokens)
    bins = [F.least(F.floor(F.col(f"pw_stats.{m}") / top * BINS), F.lit(BINS - 1)).cast("int").alias(m) for m, top in bands.top]
    texts = judged.select(F.col("pw_stats.band_group").alias("g"), _octave().alias("o"), "pw_id", *bins).distinct()
    cells = [F.struct(F.lit(m).alias("m"), F.col(m).alias("bin")) for m, _ in bands.top]
    counts = texts.select("g", "o", F.explode(F.array(*cells)).alias("c")).groupBy("g", "o", "c.m", "c.bin").agg(F.count("*").alias("n"))
    found: dict[tuple[str, int], dict[str, list[tuple[int, int]]]] = {}
    for r in counts.toLocalIterator():
        found.setdefault((r.g, r.o), {}).setdefault(r.m, []).append((r.bin, r.n))
    octaves: dict[str, list[int]] = {}
    for g, o in found:
        octaves.setdefault(g, []).append(o)
    floors, tops, out = dict(bands.floor), dict(bands.top), {}
    for key in found:
        for near in _widening(key[1], octaves[key[0]]):
            pool = [found[key[0], o] for o in near]
            if sum(n for measures in pool for _, n in next(iter(measures.values()))) >= bands.min_texts:
                break
        else:
            continue
        for m in tops if near == [key[1]] else [m for m in tops if m not in BY_LENGTH]:
            bins = [b for measures in pool for b in measures[m]]
            low, mid, high = (tops[m] * _quantile(sorted(bins), q) for q in (0.25, 0.5, 0.75))
            slack = [floors[m] + bands.width * far / 0.6745 for far in (mid - low, high - mid)]
            out.setdefault(key, {})[m] = (mid - slack[0], mid + slack[1])
    return out


def base_failed(s: str = "pw_stats") -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def _in_bands(measured: DataFrame, learned: dict[tuple[str, int], dict[str, tuple[float, float]]], bands: Bands) -> DataFrame:
    """Adds pw_fits: true unless a text is long enough and one of its measures is outside its group's band."""
    names = [m for m, _ in bands.top]
    rows = [(g, o, *[x for m in names for x in ms.get(m, (None, None))]) for (g, o), ms in sorted(learned.items())]
    limits = measured.sparkSession.createDataFrame(rows, "pw_g string, pw_o int, " + ", ".join(f"pw_lo_{m} double, pw_hi_{m} double" for m in names))
    if len(rows) <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = measured.withColumns({"pw_g": F.col("pw_stats.band_group"), "pw_o": F.when(F.col("pw_stats.n_tokens") >= bands.min_tokens, _octave())}).join(limits, ["pw_g", "pw_o"], "left")
    fits = F.lit(True)
    for m in names:
        fits = fits & F.coalesce(F.col(f"pw_stats.{m}").between(F.col(f"pw_lo_{m}"), F.col(f"pw_hi_{m}")), F.lit(True))
    return out.withColumn("pw_fits", fits).drop("pw_g", "pw_o", *[f"pw_{e}_{m}" for m in names for e in ("lo", "hi")])


def judge(docs: DataFrame, model_path: str, out_dir: str, *, bands: Bands = Bands(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` but the text, pw_stats, pw_base_failed and pw_kept. The measures are written once to
    ``out_dir``: learning and judging read the same table."""
    docs = docs.withColumn("pw_id", F.xxhash64(F.col(text_col).cast("string")))
    measured = materialize(measure(docs, model_path, text_col=text_col, lang_col=lang_col).drop(text_col), f"{out_dir}/measured")
    fitted = _in_bands(measured, learn_bands(measured, bands), bands)
    return fitted.withColumn("pw_base_failed", base_failed()).withColumn("pw_kept", ~F.col("pw_base_failed") & F.col("pw_fits")).drop("pw_fits", "pw_id")


def keep_good(docs: DataFrame, model_path: str, out_dir: str, *, bands: Bands = Bands(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep. The verdict depends on text and language only, so rejected pairs of text hash
    and language are taken out by an anti-join, whose hot partitions Spark can split."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    key = {"pw_th": F.xxhash64(text), "pw_la": F.coalesce(F.concat(F.lit("l"), lang), F.lit("n"))}
    own = docs.select(text.alias("pw_body"), lang.alias("pw_lang_in"), *[v.alias(k) for k, v in key.items()])
    bad = judge(own, model_path, out_dir, bands=bands, text_col="pw_body", lang_col="pw_lang_in").filter(~F.col("pw_kept")).select(*key).distinct()
    bad = materialize(bad, f"{out_dir}/rejected")
    discard(docs.sparkSession, f"{out_dir}/measured")
    return docs.withColumns(key).join(bad, list(key), "left_anti").drop(*key)
