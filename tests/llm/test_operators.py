"""Each operator on odd rows and on an empty table, against plain models of the same rules."""

import collections
import hashlib
import math
import os
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import chosen_path, fertility, gumbel_pieces, interpolated_lm, license_scan, line_dedup, phrase_index, reshard, token_files, warc_bundle
from pixelweft.llm.components import components

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def none_first(x):
    return (x is not None, x)


# ---- 1: token files


def test_token_files(spark, odd_docs, odd_rows, out_dir):
    from tokenizers import Tokenizer

    docs, empty = odd_docs
    got = token_files.read_token_files(spark, out_dir, token_files.write_token_files(docs, out_dir, BPE, file_bytes=2_000)).collect()
    t = Tokenizer.from_file(BPE)
    coded = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in odd_rows]
    want = sorted(((i, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in coded), key=lambda r: tuple(map(none_first, r)))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: tuple(map(none_first, r))) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=none_first)
    gone = f"{out_dir}-none"
    assert token_files.read_token_files(spark, gone, token_files.write_token_files(empty, gone, BPE)).count() == 0


def test_chunks_are_encoded_as_whole_texts_are():
    e = token_files.Encoder(BPE, None)
    for text in ["Σας ΣΑΣ, É. é. x́, <|endoftext|> a  b\t c\xa0d .. , !? don't DON'T. ﬁ, İstanbul. ǅ, 4.5 a.b. Ab! (x).", "", " ", "\n\n a", "x\x1cy, \x85z"]:
        assert np.frombuffer(e(text), "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_kind_of_character_is_encoded_as_in_whole_texts():
    rng = np.random.default_rng(4)
    e = token_files.Encoder(BPE, None)
    blocks = [*range(0x80, 0x600), *range(0x900, 0xA00), *range(0x10A0, 0x1200, 3), *range(0x1C80, 0x1D00), *range(0x1E00, 0x2200), *range(0xA640, 0xA7FF, 2), *range(0xFB00, 0xFB1E), *range(0x10400, 0x10450)]
    texts = [f"{c}. a{c}, TA{c}O{c}! {c}{c}.," for c in map(chr, blocks)]
    odd = "İIıiSsΣσςßẞﬁﬂǅÅKΩक़़́̇̈'.,!? \n\tabTR0१²½-_()<|endoftext|>"
    texts += ["ALİ.", "ALİ, geldi", "TATİLİ!", "ΟΔΟΣ. ΟΔΟΣ ΣΑ!", *("".join(rng.choice(list(odd), int(rng.integers(1, 25)))) for _ in range(20_000))]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want, strict=True) if np.frombuffer(e(t), e.kind).tolist() != w.ids] == []
    assert "é" in e.letters and "İ" in e.others


def test_many_equal_ids_and_files_keep_their_starts(spark, out_dir, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 4)
    rows = [(None if k % 3 else k, f"word{k % 5} " * (k % 11)) for k in range(400)] + [(7, "again and again")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{out_dir}/docs")
    manifest = token_files.write_token_files(spark.read.parquet(f"{out_dir}/docs"), f"{out_dir}/ids", BPE, file_bytes=800)
    assert manifest.count() > 10 and manifest.agg(F.max("n_docs")).first()[0] < 300
    got = sorted(token_files.read_token_files(spark, f"{out_dir}/ids", manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert len(got) == len(rows) and [none_first(r.doc_id) for r in got] == sorted(none_first(i) for i, _ in rows)


def test_memo_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 3)
    e, f = token_files.Encoder(BPE, 1), token_files.Encoder(BPE, 1)
    for text in ["a b c d e f g", "g, f. e! b", "new words here a b"]:
        assert e(text) == f(text)
        f.memo.clear()
        assert len(e.memo) <= 3


# ---- 2: line dedup


def test_line_dedup(spark, out_dir):
    rows = [(k, "h" if k < 10 else None, f"menu \nbody {k}\n\n{'dup' if k % 2 else 'x'}\nmenu") for k in range(12)] + [(20, "h", None), (21, "h", ""), (22, "h", "menu"), (23, "one", "menu\nbody")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, a int, ratio int")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, out_dir, max_ratio=0.5, min_pages=3).collect()}
    # host h has 13 pages; menu is on 11 of them, dup and x on 5 each; the null host has 2 pages only
    assert got[3].text == "body 3\n\ndup" and (got[3].pw_lines, got[3].pw_dropped) == (4, 2) and (got[3].a, got[3].ratio) == (1, 2)
    assert got[11].text == rows[11][2] and got[11].pw_dropped == 0
    assert got[20].text is None and (got[20].pw_lines, got[20].pw_dropped) == (0, 0)
    assert got[21].text == "" and got[22].text == "" and got[22].pw_dropped == 1 and got[23].text == "menu\nbody"
    kept = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, f"{out_dir}-k", max_ratio=0.5, min_pages=3, keep_whole=True).collect()}
    assert kept[22].text == "menu" and kept[22].pw_dropped == 0 and kept[3].text == "body 3\n\ndup"
    assert line_dedup.drop_boilerplate(docs.limit(0), f"{out_dir}-e").count() == 0


def test_near_copies_above_the_ratio_stay_whole(spark, out_dir):
    lines = [f"line {j} of a passage that many pages share" for j in range(20)]
    copies = {k: "\n".join(["menu home", *lines[: k % 20], f"edit {k}", *lines[k % 20 + 1 :]]) for k in range(30)}
    others = {100 + k: f"menu home\nbody of page {k}\nand {k} more words" for k in range(60)}
    docs = spark.createDataFrame([(k, "s", t) for k, t in {**copies, **others}.items()], "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.pw_dropped) for r in line_dedup.drop_boilerplate(docs, out_dir, keep_whole=True).collect()}
    assert all(got[k] == (t, 0) for k, t in copies.items())
    assert all(got[k] == (t.removeprefix("menu home\n"), 1) for k, t in others.items())


def test_line_dedup_of_odd_rows(spark, odd_docs, odd_rows, out_dir):
    docs, empty = odd_docs
    long = "\n".join(f"line {k % 3000} of a long text" for k in range(60_000))
    rows = [(*r[:4],) for r in odd_rows] + [(50, long, "en", "s"), (51, long + "\nend", "en", "s"), (50, long, "en", "s")]
    blanks = " \t\r\x0b\x0c"
    bare = lambda t: [x.strip(blanks) for x in t.split("\n")]
    pages = collections.Counter(r[3] for r in rows)
    seen = collections.Counter((r[3], x) for r in rows for x in set(bare(r[1] or "")) if x)
    bad = {k for k, n in seen.items() if n >= 2 and n / pages[k[0]] > 0.12}
    want = []
    for i, t, _, s in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if (s, x.strip(blanks)) not in bad]
        want.append((i, None if t is None else "\n".join(left), sum(bool(x) for x in bare(t or "")) if t is not None else 0, len(lines) - len(left)))
    df = spark.createDataFrame([(*r, "m", "n") for r in rows], "doc_id long, text string, lang string, source string, line string, host string")
    got = [(r.doc_id, r.text, r.pw_lines, r.pw_dropped) for r in line_dedup.drop_boilerplate(df, out_dir, min_pages=2, max_ratio=0.12).collect()]
    key = lambda r: tuple(map(none_first, r))
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[3] > 0 for r in want) >= 5
    assert line_dedup.drop_boilerplate(empty, f"{out_dir}-e").columns == [*empty.columns, "pw_lines", "pw_dropped"]


def test_line_dedup_joins_alike_beyond_the_broadcast_bound(spark, odd_docs, out_dir, monkeypatch):
    docs, _ = odd_docs
    run = lambda d: sorted((str(tuple(r)) for r in line_dedup.drop_boilerplate(docs, d, max_ratio=0.05, min_pages=1).collect()))
    a = run(f"{out_dir}/a")
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert run(f"{out_dir}/b") == a


# ---- 3: resharding


@pytest.mark.parametrize("n_new", [2, 8])
def test_reshard(spark, out_dir, n_new):
    rng = np.random.default_rng(1)
    rows = [(int(i), "x" * int(rng.integers(0, 400)) + str(i), int(i % 3)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int")
    done = reshard.reshard(docs, out_dir, n_new, shard_col="old")
    got = reshard.with_slots(done.rows, out_dir).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    assert all(r.size == len(rows[r.doc_id][1].encode()) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode()) for r in got)
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(n_new))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 401
    old = [sum(len(t.encode()) + 1 for _, t, o in rows if o == k) for k in range(3)]
    total = sum(old)
    capacity = [total // n_new + (k < total % n_new) for k in range(n_new)]
    # with two new shards, the third old one is adopted by the smaller of the others
    assert done.home == ([0, 1, 0 if old[0] < old[1] else 1] if n_new == 2 else [0, 1, 2])
    held = [sum(o for o, h in zip(old, done.home, strict=True) if h == k) for k in range(n_new)]
    least = sum(max(0, o - c) for o, c in zip(held, capacity, strict=True))
    assert done.moved_bytes == least
    moved = sum(r.size for r in got if done.home[rows[r.doc_id][2]] != r.shard)
    assert abs(moved - least) <= 401 * n_new


def test_reshard_of_files_odd_and_empty(spark, odd_docs, odd_rows, out_dir):
    docs, empty = odd_docs
    got = reshard.written_shards(docs, out_dir, 3).collect()
    assert sorted((none_first(r.doc_id), r.size) for r in got) == sorted((none_first(r[0]), len((r[1] or "").encode()) + 1) for r in odd_rows)
    assert reshard.written_shards(empty, f"{out_dir}-e", 3).count() == 0


def test_whole_files_are_assigned_and_few_are_rewritten(spark, out_dir, monkeypatch):
    monkeypatch.setattr(reshard, "TASK_ROWS", 100)
    rng = np.random.default_rng(6)
    rows = [(int(k), "y" * int(rng.integers(0, 300))) for k in range(3200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(32).write.parquet(f"{out_dir}/docs")
    docs = spark.read.option("maxPartitionBytes", "1k").parquet(f"{out_dir}/docs")
    done = reshard.reshard_files(docs, f"{out_dir}/new", 8)
    assert len(done.home) == 32 and sorted(collections.Counter(done.home).values()) == [4] * 8
    # at most one old file of each home that has too much is split
    assert len(done.rewritten) <= 7 and done.rewritten_bytes < 0.3 * sum(len(t) + 1 for _, t in rows)
    got = reshard.with_slots(done.rows, f"{out_dir}/new").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [(i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows]
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append((r.slot, r.doc_id))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 301 and set(sizes) == set(range(8))
    for s in slots.values():
        assert [x for x, _ in sorted(s)] == list(range(len(s))) and [i for _, i in sorted(s)] == sorted(i for _, i in s)


def test_rows_that_repeat_are_parted_in_files(spark, out_dir, monkeypatch):
    monkeypatch.setattr(reshard, "TASK_ROWS", 50)
    monkeypatch.setattr(reshard, "BROADCAST_ROWS", -1)
    spark.createDataFrame([(7, "the same row")] * 500, "doc_id long, text string").coalesce(1).write.parquet(f"{out_dir}/docs")
    got = reshard.written_shards(spark.read.parquet(f"{out_dir}/docs"), f"{out_dir}/new", 8).collect()
    count = collections.Counter(r.shard for r in got)
    assert len(got) == 500 and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in count.items())


def test_transfers_are_cheapest(out_dir):
    rng = np.random.default_rng(8)
    for n in (1, 3, 8, 40):
        supply = [int(x) for x in rng.integers(0, 1000, n)]
        total = sum(supply)
        capacity = [total // 8 + (j < total % 8) for j in range(8)]
        home = reshard.homes_of(supply, capacity)
        flow = reshard.cheapest_transfers(supply, capacity, home, lambda h, j: int(h != j))
        held = [sum(s for s, h in zip(supply, home, strict=True) if h == j) for j in range(8)]
        assert sum(v for (i, j), v in flow.items() if j != home[i]) == sum(max(0, x - c) for x, c in zip(held, capacity, strict=True))
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(8)] == capacity
        assert sum(len([1 for a, _ in flow if a == i]) > 1 for i in range(n)) <= 8


# ---- 4: WARC


def test_warc(spark, out_dir):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, None), (7, "u", ""), (None, "u", "same"), (2, "u2", "same"), (11, "l\nx", "é" * 200_000), (12, "u", "tiny")]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    index = warc_bundle.write_bundles(pages, out_dir, bundle_bytes=1_000, frame_bytes=500)
    assert index.count() == len(rows)
    got = warc_bundle.read_bundles(spark, out_dir).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        p, o = (h or "").encode(), least.get(h or "")
        revisit = o is not None and o != i
        want.append((i, len(p), warc_bundle.digest32(p), "revisit" if revisit else "response", o if revisit else None))
    key = lambda r: tuple(map(none_first, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.payload for r in got if r.page_id == 11} == {"é" * 200_000}
    gone = f"{out_dir}-none"
    warc_bundle.write_bundles(pages.limit(0), gone)
    assert warc_bundle.read_bundles(spark, gone).count() == 0


def test_long_records_fill_frames_and_bundles(spark, out_dir):
    rng = np.random.default_rng(14)
    long = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 900_000)))
    rows = [(k, "u", long[k * 1000 :] if k < 3 else f"page {k}") for k in range(12)] + [(20, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = warc_bundle.write_bundles(pages, out_dir, bundle_bytes=1 << 20, frame_bytes=64 << 10)
    assert index.select("file").distinct().count() >= 3 and index.agg(F.max("length")).first()[0] > 2_000_000
    got = {r.page_id: r for r in warc_bundle.read_bundles(spark, out_dir).collect()}
    assert all(got[i].payload == h for i, _, h in rows if i != 20) and got[20].refers_to == 0 and got[20].payload_bytes == len(long.encode())


def test_small_payloads_are_all_responses(spark, out_dir):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc_bundle.write_bundles(pages, out_dir, min_revisit_bytes=5)
    assert {r.page_id: r.refers_to for r in warc_bundle.read_bundles(spark, out_dir).collect()} == {1: None, 2: None, 3: None, 4: 3}


# ---- 5: phrases


def brute_phrases(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for name, text in items:
            p = cut(text)
            n = min(window, len(p))
            for a in range(max(0, len(p) - n + 1) if p else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == p[a : a + n] and name is not None:
                        hit.update(range(b, b + n))
                        found.add(str(name))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_phrases(spark, out_dir):
    rng = np.random.default_rng(2)
    vocab = ["the", "of", "é", "a1", "zz"]
    draw = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, draw(14)), (10, draw(10)), (2, "The, of"), (3, ""), (4, None), (None, "the of"), (5, "unseen words"), (2, "zz zz zz")]
    docs = [(k, draw(30)) for k in range(20)] + [(50, "x " + items[0][1].upper() + ". y"), (51, None), (52, ""), (None, items[1][1]), (50, "q")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (none_first(r[0]), r[1:])
    for n, segment in ((50_000, 500_000), (3, 40)):
        index = phrase_index.build_index(d, f"{out_dir}/{n}", segment_words=segment)
        blocks, names = phrase_index.read_benchmark(b, id_col="item_id", text_col="text", window=10, block_phrases=n)
        assert len(blocks) == 1 if n > 3 else len(blocks) > 2
        got = phrase_index.search(index, blocks, names).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=key) == sorted(brute_phrases(docs, items), key=key)
    # the index knows nothing of a benchmark: another one, with other words, is searched in the same files
    other = [(7, "Q. y"), (8, "of the"), (9, draw(12))]
    blocks, names = phrase_index.read_benchmark(spark.createDataFrame(other, "item_id long, text string"), id_col="item_id", text_col="text", window=10, block_phrases=100)
    got = phrase_index.search(phrase_index.open_index(spark, f"{out_dir}/3"), blocks, names).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=key) == sorted(brute_phrases(docs, other), key=key)
    left = phrase_index.drop_contaminated(d, b.filter("item_id = 10"), f"{out_dir}/drop")
    assert left.count() == sum(not x[3] for x in brute_phrases(docs, [items[1]])) and left.columns == d.columns
    assert phrase_index.decontaminate(d, b.limit(0), f"{out_dir}/nob").filter("n_hit > 0").count() == 0
    assert phrase_index.decontaminate(d.limit(0), b, f"{out_dir}/nod").count() == 0


def test_every_posting_is_stored_once(spark, out_dir, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{int(x)}" for x in np.minimum(rng.zipf(1.3, 700), 900)) for _ in range(40)] + ["the " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = [r.asDict() for r in phrase_index.build_index(docs, out_dir, segment_words=20_000).collect()]
    assert len(rows) > 1 and max(len(r["postings"]) for r in rows) > 1
    found = {}
    for r in rows:
        every = {f"t{k}".encode(): k for k in range(901)} | {b"the": 901}
        s = phrase_index.Segment(r, every)
        doc = np.searchsorted(s.starts, s.postings, side="right") - 1
        for t, d, p in zip(np.repeat(s.terms, np.diff(s.offsets)).tolist(), doc.tolist(), s.postings.tolist(), strict=True):
            assert found.setdefault((int(s.doc_ids[d]), p - int(s.starts[d])), t) == t
        some = phrase_index.Segment(r, {b"t3": 0, b"the": 1, b"never": 2})
        assert set(some.terms.tolist()) <= {0, 1}
    assert found == {(i, k): int(w[1:]) if w != "the" else 901 for i, t in enumerate(texts) for k, w in enumerate(t.split())}


def test_proximity(spark, out_dir):
    d = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha x x x x x x beta gamma"), (5, "alpha"), (6, "beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r.near_items)) for r in phrase_index.decontaminate(d, b, out_dir, slop=5).collect()}
    assert got == {1: (0, ["7"]), 2: (0, ["7"]), 3: (0, []), 4: (0, []), 5: (0, []), 6: (0, [])}


# ---- 6: language model


def lm_texts(rows):
    return [(r[0], [w.decode() for w in interpolated_lm.tokens(r[1])] + ["<end>"]) for r in rows]


def lm_counts(texts, folds, order):
    """Counts of n-grams by order, of documents in these folds. The one token before a text is an end."""
    out = [collections.Counter() for _ in range(order)]
    for i, t in texts:
        if interpolated_lm.fold_of(i) in folds:
            for j in range(len(t)):
                out[0][(t[j],)] += 1
                for k in range(1, order):
                    if j - k >= -1:
                        out[k][tuple((["<end>"] + t)[j + 1 - k : j + 2])] += 1
    return out


def lm_parts(t, j, counts, order):
    """(count of the n-gram, count of its context) for each order that the place has."""
    out = []
    for k in range(1, order):
        if j - k >= -1:
            gram = tuple((["<end>"] + t)[j + 1 - k : j + 2])
            out.append((counts[k][gram], counts[k - 1][gram[:-1]]))
    return out


def lm_prob(t, j, counts, weights, order):
    n, v = sum(counts[0].values()), sum(c > 0 for c in counts[0].values())
    p = 1 / (v + 1)
    p = weights[0][0] * counts[0][(t[j],)] / max(n, 1) + (1 - weights[0][0]) * p
    for k, (a, c) in enumerate(lm_parts(t, j, counts, order)[: len(weights) - 1]):
        if c:
            w = weights[k + 1][c.bit_length()]
            p = w * a / c + (1 - w) * p
    return p


@pytest.mark.parametrize(("order", "options"), [(3, {}), (4, {"block_tokens": 100, "fan": 2, "bits": 2})])
def test_language_model(spark, odd_docs, odd_rows, out_dir, order, options):
    docs, empty = odd_docs
    model = interpolated_lm.train_and_score(docs, out_dir, order=order, **options)
    texts = lm_texts(odd_rows)
    counts = lm_counts(texts, {0, 1, 3, 4, 5, 6}, order)
    n, v = sum(counts[0].values()), len(counts[0])
    assert (model.n, model.v) == (n, v) and len(model.weights) == order
    want = []
    for i, t in texts:
        score = sum(math.log10(lm_prob(t, j, counts, model.weights, order)) for j in range(len(t)))
        want.append((i, interpolated_lm.fold_of(i) == 2, len(t), sum(counts[0][(w,)] > 0 for w in t), n, round(sum(math.log10((counts[0][(w,)] + 1) / (n + v + 1)) for w in t), 6), round(score, 5)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in model.scores.collect()]
    key = lambda r: tuple(map(none_first, r))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-5 and abs(g[6] - w[6]) < 1e-3 + 1e-9 * abs(w[6])
    assert interpolated_lm.train_and_score(empty, f"{out_dir}-e", order=order).scores.count() == 0


def plain_weights(texts, order):
    """The weights by EM on exact estimates, token by token."""
    counts, held = lm_counts(texts, {0, 1, 4, 5, 6}, order), [t for i, t in texts if interpolated_lm.fold_of(i) == 3]
    weights = []
    for k in range(order):
        seen = collections.defaultdict(list)
        for t in held:
            for j in range(len(t)):
                parts = [(counts[0][(t[j],)], sum(counts[0].values()))] + lm_parts(t, j, counts, order)
                if k < len(parts) and parts[k][1]:
                    lower = lm_prob(t, j, counts, weights, k) if k else 1 / (sum(c > 0 for c in counts[0].values()) + 1)
                    seen[parts[k][1].bit_length() if k else 0].append(parts[k][0] / parts[k][1] / lower)
        own, last = np.zeros(interpolated_lm.BUCKETS), 0.5
        for b in range(interpolated_lm.BUCKETS):
            if seen[b]:
                r, w = np.array(seen[b]), 0.5
                for _ in range(500):
                    w = min(max(float((w * r / (w * r + 1 - w)).mean()), interpolated_lm.LEAST), 1 - interpolated_lm.LEAST)
                last = w
            own[b] = last
        weights.append(own)
    return weights


def test_weights_are_those_of_plain_em(spark, out_dir):
    rng = np.random.default_rng(12)
    vocab, p = [f"w{k}" for k in range(60)], np.array([1 / (k + 2) for k in range(60)])
    after = {w: rng.choice(vocab, 6) for w in vocab}
    rows = []
    for i in range(160):
        t = [str(rng.choice(vocab, p=p / p.sum()))]
        for _ in range(int(rng.integers(5, 60))):
            t.append(str(rng.choice(after[t[-1]])) if rng.random() < 0.6 else str(rng.choice(vocab, p=p / p.sum())))
        rows.append((i, " ".join(t)))
    model = interpolated_lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), out_dir, block_tokens=700)
    want = plain_weights(lm_texts(rows), 3)
    counts = lm_counts(lm_texts(rows), {0, 1, 4, 5, 6}, 3)
    assert abs(model.weights[0][0] - want[0][0]) < 0.01
    for k in (1, 2):
        used = {c.bit_length() for c in counts[k - 1].values()}
        assert max(abs(model.weights[k][b] - want[k][b]) for b in used) < 0.02
    assert 0.05 < want[1][4] < 0.95


def test_messages_grow_with_the_blocks(spark, out_dir):
    """Ten times the blocks send ten times the messages on each level, not a hundred times."""
    rng = np.random.default_rng(13)
    sent = {}
    for size in (40, 400):
        rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 5000, 100))) for i in range(size)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        blocks = interpolated_lm.encode_blocks(docs, f"{out_dir}/{size}/blocks", id_col="doc_id", text_col="text", block_tokens=100)
        assert blocks.count() == size
        read = interpolated_lm._read_block(2, 3, 2, 48)
        one = interpolated_lm._send(blocks, read, 0, -(-size // 16), 48, 4).groupBy("cell", "grp").count().agg(F.sum("count"), F.max("count")).first()
        sent[size] = one[0]
        assert one[0] <= size << 4 and one[1] <= 48
    assert sent[400] <= 11 * sent[40]


def test_weights_make_the_deleted_fold_likelier():
    grid = interpolated_lm.GRID
    cells = [(4, 3 * grid, 60), (4, -2 * grid, 25), (4, interpolated_lm.ZERO, 15), (0, interpolated_lm.ZERO, 3)]
    w = interpolated_lm.learn_weights(cells)
    like = lambda x: 60 * math.log(8 * x + 1 - x) + 25 * math.log(x / 4 + 1 - x) + 15 * math.log(1 - x)
    assert all(like(x) <= like(w[4]) + 1e-6 for x in np.linspace(0.001, 0.999, 999))
    assert w[0] <= 2 * interpolated_lm.LEAST and w[5] == w[4]


# ---- 7: quality rules


def test_base_rules(spark, odd_docs, odd_rows, out_dir):
    docs, empty = odd_docs
    got = fertility.judge(docs, PIECES, out_dir).collect()
    want = collections.Counter()
    for r in odd_rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines, seen = 0, set()
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                lines += x in seen
                seen.add(x)
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    s = [r.pw_stats for r in got]
    assert collections.Counter((r.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, r.pw_base_failed) for r, x in zip(got, s, strict=True)) == want
    assert all(not (r.pw_base_failed and r.pw_kept) for r in got) and {x.band_group for x in s} >= {"lang:en", "lang:de", "script:NONE"}
    assert {r.kept for r in got} == {True}
    kept = fertility.keep_good(docs, PIECES, f"{out_dir}/k")
    assert kept.columns == docs.columns and kept.count() == sum(r.pw_kept for r in got)
    assert fertility.judge(empty, PIECES, f"{out_dir}-e").count() == 0


def plain_measures(text, model):
    """Measures by the rules' words: the library's ids of the whole text."""
    ids = model.encode(text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return 0, 0.0, 0.0, 0.0
    n, counts = len(ids), collections.Counter(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return n, sum(map(len, words)) / n, sum(model.is_byte(i) for i in ids) / n, entropy / math.log2(n) if n > 1 else 0.0


def plain_verdicts(rows):
    """Kept or not, of (text, language) rows: another way to write the bands down, with sorted lists in place of histograms."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bands, names = fertility.Bands(), ("chars_per_token", "byte_share", "entropy_share")
    measured = {t: plain_measures(t, model) for t, _ in rows}
    octave = lambda t: int(math.log2(measured[t][0]))
    cells = collections.defaultdict(list)
    for t, lang in {(t, lang) for t, lang in rows if measured[t][0] >= bands.min_tokens}:
        cells[lang, octave(t)].append(measured[t])
    out = []
    for t, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        fits = not (len(words) < 10 or 100 * len(again) > 20 * len(words))
        if measured[t][0] >= bands.min_tokens:
            o = octave(t)
            pools = [cells[lang, o], [x for (g, p), c in cells.items() if g == lang and abs(p - o) <= 1 for x in c], [x for (g, _), c in cells.items() if g == lang for x in c]]
            k = next((k for k in range(3) if len(pools[k]) >= bands.min_texts), None)
            for m, name in enumerate(names) if k is not None else ():
                own_octave_only = all(p == o for (g, p) in cells if g == lang and (k == 2 or abs(p - o) <= 1))
                if name == "entropy_share" and k and not own_octave_only:
                    continue
                top = dict(bands.top)[name]
                ordered = sorted(min(int(x[m + 1] / top * fertility.BINS), fertility.BINS - 1) for x in pools[k])
                low, mid, high = (top * (ordered[max(0, math.ceil(q * len(ordered)) - 1)] + 0.5) / fertility.BINS for q in (0.25, 0.5, 0.75))
                floor = dict(bands.floor)[name]
                fits &= mid - floor - bands.width * (mid - low) / 0.6745 <= measured[t][m + 1] <= mid + floor + bands.width * (high - mid) / 0.6745
        out.append(fits)
    return out


def test_verdicts_against_brute_force(spark, out_dir):
    rng = np.random.default_rng(9)
    plain = ["house", "garden", "river", "people", "because", "mountain", "through", "winter", "little", "morning", "maßstab", "straße", "überall"]
    rows = []
    for k in range(260):
        text = " ".join(rng.choice(plain, int(rng.integers(5, 400)))).replace(" winter", rng.choice([" winter", "\nwinter", ".\n\nWinter"]))
        rows.append((text, ["en", "de", "en", "xx"][k % 4] if k < 250 else "rare"))
    strange = lambda n: " ".join("".join(chr(int(c)) for c in rng.integers(0x1200, 0x1350, 3)) for _ in range(n))
    junk = [strange(n) for n in (15, 30, 60, 120, 400)]
    junk += ["".join(w + "\n" * int(rng.integers(1, 40)) for w in rng.choice(plain, 40)), "".join(w + " \t" * int(rng.integers(1, 30)) for w in rng.choice(plain, 60))]
    junk += [" ".join(rng.permutation([f"{a}%%%&{b}##" for a in plain for b in plain])[:n]) for n in (12, 40)]
    rows += [(t, lang) for t in junk for lang in ("en", "xx")] + [(rows[3][0], "en")] * 90 + [("too short", "en"), ("", "en")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.judge(df, PIECES, out_dir).collect()}
    want = plain_verdicts(rows)
    assert [got[k].pw_kept for k in range(len(rows))] == want
    assert 5 < sum(not w and not got[k].pw_base_failed for k, w in enumerate(want)) < 60


def test_tokens_are_those_of_whole_texts(monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(10)
    odd = "ab é▁  \n\n\t\r\x0b.,汉☃ \u3000\u200b\x00\ufeff\u0301ﬁ½"
    monkeypatch.setattr(fertility, "PART", 7)
    run = fertility.Measurer(PIECES)
    assert run.parts
    for _ in range(5_000):
        text = "".join(rng.choice(list(odd), int(rng.integers(1, 60))))
        assert run.tokens(text).tolist() == model.encode(text), ascii(text)


def test_many_distinct_words_pack_exactly():
    ids = np.arange(20_000, dtype=np.int32)
    assert fertility.repeated_words(ids) == 0
    assert fertility.repeated_words(np.concatenate([ids, ids[100:105]]).astype(np.int32)) == 10
    assert fertility.repeated_words(np.zeros(6, np.int32)) == 6 and fertility.repeated_words(np.zeros(4, np.int32)) == 0


def test_bands_reject_strange_tokens(spark, out_dir):
    rng = np.random.default_rng(0)
    plain = ["house", "garden", "river", "people", "because", "mountain", "through", "winter", "little", "morning"]
    rows = [(k, " ".join(rng.choice(plain, 100)), "en") for k in range(60)]
    odd = [" ".join("".join(chr(int(c)) for c in rng.integers(0x1200, 0x1350, 3)) for _ in range(10)), " ".join(rng.permutation([f"{a}%%%&{b}##" for a in plain for b in plain])[:12]), " ".join(["house"] * 8 + ["river", "winter"] * 40)]
    rows += [(100 + k, t, "en") for k, t in enumerate(odd)] + [(200, odd[0], "fr"), (201, odd[0], None)]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, out_dir).collect()}
    assert all(got[k].pw_kept for k in range(60)) and not any(got[100 + k].pw_kept for k in range(3))
    assert all(64 <= got[k].pw_stats.n_tokens < 128 for k in (0, 59, 100, 101))
    # one text of a language doesn't tell what is usual there
    assert got[200].pw_kept and got[201].pw_kept and got[201].pw_stats.band_group == "script:ETHIOPIC"


def test_copies_of_one_text_do_not_move_the_bands(spark, out_dir):
    rng = np.random.default_rng(1)
    plain = ["house", "garden", "river", "people", "because", "mountain", "through", "winter", "little", "morning"]
    texts = [" ".join(rng.choice(plain, 100)) for _ in range(120)]
    junk = " ".join(rng.permutation([f"{a}%%%&{b}##" for a in plain for b in plain])[:12])
    run = fertility.Measurer(PIECES)
    clean = sorted(texts, key=lambda t: run(t)[6])[36]

    def verdicts(copies, name):
        df = spark.createDataFrame([(t, "en") for t in [*texts, junk, *copies]], "text string, lang string")
        got = fertility.judge(df.withColumn("own", F.col("text")), PIECES, f"{out_dir}/{name}").collect()
        return {(r.own, r.pw_kept) for r in got}

    alone = verdicts([], "alone")
    assert (junk, False) in alone and sum(k for _, k in alone) == 120
    assert verdicts([clean] * 60, "clean") == alone
    assert verdicts([junk] * 60, "junk") == alone


def test_small_octaves_fall_back_to_wider_groups(spark, out_dir):
    rng = np.random.default_rng(2)
    plain = ["house", "garden", "river", "people", "because", "mountain", "through", "winter", "little", "morning"]
    strange = lambda n: " ".join("".join(chr(int(c)) for c in rng.integers(0x1200, 0x1350, 3)) for _ in range(n))
    rows = [(k, " ".join(rng.choice(plain, 100)), "en") for k in range(60)]
    rows += [(100, strange(20), "en"), (101, " ".join(rng.choice(plain, 180)), "en"), (102, strange(160), "en")]
    rows += [(200 + k, strange(20), "fr") for k in range(5)]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, out_dir).collect()}
    octave = {k: int(math.log2(got[k].pw_stats.n_tokens)) for k in (0, 100, 101, 102)}
    assert octave[0] == 6 and octave[100] == octave[101] == 7 and octave[102] > 8
    assert not any(got[k].pw_base_failed for k in (100, 101, 102))
    assert not got[100].pw_kept and got[101].pw_kept and not got[102].pw_kept
    assert all(got[k].pw_kept for k in range(60)) and all(got[200 + k].pw_kept for k in range(5))


# ---- 8: licences


def test_known_sentences_hold_a_mark():
    assert all(any(m in s for m in license_scan.MARKS) for s in license_scan.KNOWN)
    assert {i for _, _, ids in license_scan.ALL_RULES for i in ids} == set(license_scan.KNOWN.values())
    assert all(s == re.sub("[^a-z0-9]+", " ", s).strip() for s in license_scan.KNOWN)


def test_license_rules(spark, odd_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    texts = {1: mit, 2: "Title\nReleased under the MIT License.\nAll rights reserved.", 3: "all RIGHTS  reserved!", 4: "This program is free software: you may like it.", 5: None, 6: "", 7: mit.replace("copies or", "copies of or")}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert got[1].pw_licenses == ["MIT"] and got[1].pw_rules == ["MIT: grant"] and got[1].pw_wrapped == ",mit-grant,mit-condition,mit-warranty,"
    assert got[2].pw_licenses == ["MIT", "all-rights-reserved"] and got[2].pw_by_line == ",MIT notice,reserved,"
    assert got[3].pw_licenses == ["all-rights-reserved"] and got[4].pw_licenses == [] and got[4].pw_by_line == ",gpl-free,"
    assert got[5].pw_licenses == [] and got[5].pw_by_line == ",," and got[6].pw_rules == [] and got[7].pw_licenses == []
    docs, empty = odd_docs
    assert license_scan.scan(docs).filter(F.array_contains("pw_licenses", "Apache-2.0")).count() == 1
    assert license_scan.scan(empty).count() == 0


def test_bsd_clauses_are_told_apart(spark):
    two = "All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    three = two + "3. Neither the name of %s nor the names of its contributors may be\n   used to endorse or promote products derived from this software without\n   specific prior written permission.\n"
    texts = {2: two, 3: three % "the copyright holder", 4: three % "the University of Somewhere", 5: three % "Example Inc.", 6: two[: two.index("2. ")]}
    got = {r.doc_id: r.pw_licenses for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {2: ["BSD-2-Clause", "all-rights-reserved"], **{k: ["BSD-3-Clause", "all-rights-reserved"] for k in (3, 4, 5)}, 6: ["all-rights-reserved"]}


APACHE_HEADER = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_HEADER = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU %sGeneral Public License as published by
the Free Software Foundation%s either version %s of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_headers_as_published_and_in_comments(spark):
    # expected names are written by hand, not taken from the catalogue
    want = {
        "Apache-2.0": APACHE_HEADER, "GPL-3.0-or-later": GPL_HEADER % (":", "", ",", "3"), "GPL-2.0-or-later": GPL_HEADER % (";", "", ";", "2"), "LGPL-2.1-or-later": GPL_HEADER % (";", "Lesser ", ";", "2.1"),
        "AGPL-3.0-or-later": GPL_HEADER % (":", "Affero ", ",", "3"), "ISC": ISC, "0BSD": ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "MPL-2.0": MPL_HEADER,
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "// SPDX-License-Identifier: MIT", "GPL-2.0-only": "x = 1\n# SPDX-License-Identifier: GPL-2.0-only\ny = 2",
    }
    rows = []
    for name, text in want.items():
        forms = [text, "Title of a page\n\n" + text + "\nMore text.\n"]
        forms += [open_ + "".join(f"{mark}{line}".rstrip() + "\n" for line in text.split("\n")) + close for open_, mark, close in (("", "# ", ""), ("/*\n", " * ", " */\n"), ("", "// ", ""), ("<!--\n", "  ", "-->\n"), ("", "; ", ""))]
        forms.append(text.replace("\n", "\r\n"))
        rows += [(f, name) for f in forms]
    got = license_scan.scan(spark.createDataFrame(rows, "text string, name string").coalesce(1)).collect()
    assert [(r.name, r.text) for r in got if r.pw_licenses != [r.name]] == []
    assert {r.pw_rules[0] for r in got if r.name == "Apache-2.0"} == {"Apache-2.0: header"} and all(len(r.pw_rules) == 1 for r in got if r.name == "Apache-2.0")


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no public licence texts here")
def test_whole_licence_texts(spark):
    want = {"Apache-2.0": ["Apache-2.0"], "GPL-2": ["GPL-2.0"], "GPL-3": ["GPL-3.0"], "LGPL-2.1": ["LGPL-2.1"], "LGPL-3": ["LGPL-3.0"], "MPL-2.0": ["MPL-2.0"], "BSD": ["BSD-3-Clause", "all-rights-reserved"], "CC0-1.0": ["CC0-1.0"], "Artistic": [], "GFDL-1.3": []}
    rows = []
    for name in want:
        text = open(f"/usr/share/common-licenses/{name}", errors="replace").read()
        wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), 72) if "http" not in p else p for p in text.split("\n\n"))
        rows += [(name, f) for f in (text, wrapped, "".join(f" * {line}\n" for line in text.split("\n")))]
    got = license_scan.scan(spark.createDataFrame(rows, "name string, text string").coalesce(1)).collect()
    assert [(r.name, r.pw_licenses, r.pw_rules) for r in got if r.pw_licenses != want[r.name]] == []


def test_more_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    texts = {
        "BSD-4-Clause": bsd + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software.\n4. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "MIT-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
        "": "The licence of this song is free. All rights are kept. Permission to enter is granted, software or not: mit license apache.",
    }
    rows = [(*r, 1, 2, "x") for r in texts.items()]
    got = license_scan.scan(spark.createDataFrame(rows, "name string, text string, known int, licence int, needle string")).collect()
    assert {r.name: ",".join(r.pw_licenses) for r in got} == {n: n for n in texts} and {(r.known, r.licence, r.needle) for r in got} == {(1, 2, "x")}


def test_license_sql_agrees_on_all_forms(spark):
    import duckdb

    texts = [APACHE_HEADER, GPL_HEADER % (":", "", ",", "3"), "// " + ISC.replace("\n", "\n// "), MPL_HEADER.replace("\n", "\r\n"), "SPDX-License-Identifier:   MIT\nAll rights reserved.", None, "", "a: b; c. d", "\u0130stanbul All Rights Reserved.", "http://x.y\nAll rights reserved"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(license_scan.oracle_sql()).fetchall())
    done = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = sorted(tuple(r) for r in done.select("doc_id", "pw_by_line", "pw_wrapped", F.array_join("pw_rules", ","), F.array_join("pw_licenses", ",")).collect())
    assert got == want and sum(bool(r[4]) for r in got) == 6


# ---- 9: near copies


def brute_near(rows, threshold=0.8, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split() if (t or "").isascii() else [x.encode() for x in (t or "").split()]
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], least[find(i)], links[i]) for i in range(len(rows))]


def near_rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(25):
        base = list(rng.choice(vocab, int(rng.integers(6, 120))))
        for _ in range(int(rng.integers(1, 7))):
            t = list(base)
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(len(t)))] = f"x{int(rng.integers(99))}"
            rows.append((len(rows), " ".join(t)))
    return rows


def test_near_copies(spark, out_dir):
    rows = near_rows()
    rows += [(900, rows[0][1].upper()), (901, rows[0][1].replace(" ", "\n")), (902, None), (903, ""), (904, "ab"), (905, "ab"), (None, rows[1][1]), (None, "lone null id"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, key int, node string")
    key = lambda r: tuple(map(none_first, r))
    want = sorted(brute_near(rows), key=key)
    for options in ({}, {"bucket": 2, "cell": 2, "block": 3, "depth": 3}):
        got = chosen_path.near_duplicates(docs, f"{out_dir}/{len(options)}", **options).collect()
        assert sorted((tuple(r) for r in got), key=key) == want
    kept = chosen_path.keep_one(docs, f"{out_dir}/keep").collect()
    wordless = sum(not (t or "").split() for _, t in rows)
    assert len(kept) == len({(c, i if c is None else 0) for i, c, _ in brute_near(rows) if i not in (902, 903)}) + wordless
    assert set(kept[0].asDict()) == {"doc_id", "text", "key", "node"}
    assert chosen_path.near_duplicates(docs.limit(0), f"{out_dir}/none").count() == 0


def test_near_copies_of_odd_rows(spark, odd_docs, odd_rows, out_dir):
    docs, _ = odd_docs
    got = chosen_path.near_duplicates(docs, out_dir).collect()
    assert len(got) == len(odd_rows)
    # three copies of the same text besides, and one text with a word changed
    assert {r.n_links for r in got if r.doc_id == 0} == {4} and {r.class_id for r in got if r.doc_id in (1, 2)} == {0}


def test_recall_bound():
    assert chosen_path.runs_for(0.999, 0.8, 6) == 7 and chosen_path.survival(1.0, 6) == 1.0
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = a.copy()
        b[:33] = rng.integers(0, 1 << 63, 33).astype(np.uint64)  # similarity 267 / 333, about 0.8
        s = np.stack([chosen_path.sketch(np.unique(x)) for x in (a, b)])
        row, node = np.repeat([0, 1], 7), np.tile(chosen_path._roots(7), 2)
        for _ in range(6):
            at, node = chosen_path.children(node, s[row])
            row = row[at]
        met += bool(set(node[row == 0].tolist()) & set(node[row == 1].tolist()))
    assert met >= 196


def test_components(spark, out_dir):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, k) for k in range(201, 260)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.key, "big"): int.from_bytes(r.root, "big") for r in components(df, out_dir).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100} | {k: 200 for k in range(200, 260)}


# ---- 10: segmentations


def every_way(vocab, text):
    pieces = {vocab.text[i].decode(): i for i in vocab.text if i not in set(vocab.bytes.tolist())}
    s, out = " " + text, {}

    def go(at, ids, lp):
        if at == len(s):
            out[tuple(ids)] = lp
            return
        for n in range(1, 17):
            if at + n <= len(s) and s[at : at + n] in pieces:
                i = pieces[s[at : at + n]]
                go(at + n, [*ids, i], lp + vocab.log_p[i])
        if s[at] not in pieces:
            raw = s[at].encode()
            go(at + 1, [*ids, *(int(vocab.bytes[b]) for b in raw)], lp + len(raw) * vocab.log_p[vocab.bytes[0]])

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: v - z for k, v in out.items()}


@pytest.fixture(scope="module")
def pieces():
    return gumbel_pieces.Vocabulary(PIECES)


@pytest.mark.parametrize(("text", "ahead"), [("thea an", 24), ("thea an", 2), ("hat, it.", 3), ("a\n☃x", 24)])
def test_samples_are_top_k_of_perturbed_ways(pieces, text, ahead):
    ways = every_way(pieces, text)
    k, n = 4, 3000
    lat, numbers = gumbel_pieces.Units(pieces)([text] * n)
    got = gumbel_pieces.sample_texts(lat, numbers, list(range(n)), k, ahead)
    first, any_of = collections.Counter(), collections.Counter()
    for rows in got:
        seen = [tuple(r[0].tolist()) for r in rows]
        assert len(set(seen)) == len(rows) == min(k, len(ways))
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        for s, r in zip(seen, rows, strict=True):
            assert abs(ways[s] - r[1]) < 1e-9 and r[3] <= 1e-12
        first[seen[0]] += 1
        any_of.update(seen)
    names, lp = list(ways), np.array(list(ways.values()))
    g = lp + np.random.default_rng(0).gumbel(size=(20_000, len(lp)))
    share = np.bincount(np.argsort(-g, axis=1)[:, : min(k, len(lp))].ravel(), minlength=len(lp)) / 20_000
    for s, p, q in zip(names, np.exp(lp), share, strict=True):
        assert abs(first[s] / n - p) < 0.04 and abs(any_of[s] / n - q) < 0.04


def test_samples_do_not_depend_on_the_batch(pieces):
    texts = ["the house, the garden.", None, "", "x y\n\nz ▁ 汉字", "the"]
    lat, numbers = gumbel_pieces.Units(pieces)(texts)
    whole = gumbel_pieces.sample_texts(lat, numbers, [1, 2, 3, None, -5], 3)
    units = gumbel_pieces.Units(pieces)
    units(["the garden z", "the house"])
    for t, key, want in zip(texts, [1, 2, 3, None, -5], whole, strict=True):
        lat, numbers = units([t])
        (got,) = gumbel_pieces.sample_texts(lat, numbers, [key], 3)
        assert [(r[0].tolist(), round(r[1], 9), round(r[2], 9), round(r[3], 9)) for r in got] == [(r[0].tolist(), round(r[1], 9), round(r[2], 9), round(r[3], 9)) for r in want]
    assert [len(w) for w in whole][1:3] == [1, 1] and whole[1][0][0].tolist() == []


def test_long_units_draw_numbers_of_their_own(pieces):
    # one unit of 200,000 characters: its steps run far beyond 65,536, and the next units must not repeat its numbers
    long = "qx" * 100_000
    texts = [f"{long} qx qx qx qx", "qx qx", long]
    lat, numbers = gumbel_pieces.Units(pieces)(texts)
    got = gumbel_pieces.sample_texts(lat, numbers, [1, 2, 3], 2)
    for t, rows in zip(texts, got, strict=True):
        assert len(rows) == 2 and rows[0][0].tolist() != rows[1][0].tolist()
        assert all(pieces.decode(ids.tolist()) == t for ids, *_ in rows)
    seen = []
    real = gumbel_pieces.uniform

    def spy(key, a, b):
        out = real(key, a, b)
        if np.ndim(b):
            seen.append(out)
        return out

    gumbel_pieces.uniform = spy
    try:
        lat, numbers = gumbel_pieces.Units(pieces)([texts[0]])
        gumbel_pieces.sample_texts(lat, numbers, [1], 1)
    finally:
        gumbel_pieces.uniform = real
    drawn = np.concatenate(seen)
    assert len(drawn) > 1 << 16 and len(np.unique(drawn)) == len(drawn)


def test_round_trip_is_against_the_text_itself(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "plain text"), (2, "a \u2581 b"), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.round_trip) for r in gumbel_pieces.encode_samples(docs, PIECES, k=2).collect()}
    assert got == {(1, True), (2, False), (3, True)}


def test_encode_samples(spark, odd_docs, odd_rows):
    docs, empty = odd_docs
    got = gumbel_pieces.encode_samples(docs, PIECES, k=2).collect()
    assert all(r.round_trip for r in got)
    assert len(got) >= 2 * sum(len((r[1] or "").strip()) > 3 for r in odd_rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_ids == len(r.ids) for r in got)
    packed = gumbel_pieces.encode_samples(docs, PIECES, k=2, packed=True).collect()
    assert sorted(np.frombuffer(r.ids, "<u2").tolist() for r in packed) == sorted(list(r.ids) for r in got)
    assert gumbel_pieces.encode_samples(empty, PIECES).count() == 0


def test_library_decodes_the_ids(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "The house  was\nold, é 汉 ☃!"
    lat, numbers = gumbel_pieces.Units(pieces)([text])
    for rows in gumbel_pieces.sample_texts(lat, numbers, [4], 5):
        for ids, *_ in rows:
            assert sp.decode(ids.tolist()) == text == pieces.decode(ids.tolist())


def test_digest_of_nothing_is_that_of_an_empty_string():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_samples_hold_one_slice_and_small_batches(spark, monkeypatch):
    """Arrow batches are bounded in bytes whatever a session had, and a slice's arrays have gone before its rows are given on."""
    from pixelweft.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, "longer words than these " * 200) for i in range(8)], "doc_id long, text string")
    try:
        for had, then in ((str(64 << 20), common.BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(name, had)
            gumbel_pieces.encode_samples(docs, PIECES, k=2)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) == then
    finally:
        spark.conf.set(name, before)

    import gc
    import weakref

    import pyarrow as pa

    made, frame = [], type("Frame", (), {"sparkSession": spark, "select": lambda self, *c: self, "mapInArrow": lambda self, f, schema: f})()
    call = gumbel_pieces.Units.__call__

    def kept(self, texts):
        lat, numbers = call(self, texts)
        made.append((weakref.ref(lat), lat is self.lattices))
        return lat, numbers

    monkeypatch.setattr(gumbel_pieces.Units, "__call__", kept)
    monkeypatch.setattr(gumbel_pieces, "BATCH_CHARS", 2_000)
    monkeypatch.setattr(common, "_HELD", {})
    rows = pa.RecordBatch.from_pydict({"id": list(range(6)), "body": [f"text {i} " * 300 for i in range(6)]})
    for _ in gumbel_pieces.encode_samples(frame, PIECES, k=2)(iter([rows])):
        gc.collect()
        assert all(own or lat() is None for lat, own in made)
    assert len(made) > 2


def test_lattices_are_built_once_and_those_used_least_go(pieces, monkeypatch):
    """Units of any earlier slice keep their lattices, and samples are the same whichever of them have gone."""
    made, init = [], gumbel_pieces.Lattices.__init__

    def spy(self, vocab, units):
        made.extend(units)
        init(self, vocab, units)

    monkeypatch.setattr(gumbel_pieces.Lattices, "__init__", spy)
    units = gumbel_pieces.Units(pieces)
    for t in ("first words.", "other words, here", "more\nof them"):
        units([t])
    assert len(made) == len(set(made))
    made.clear()
    units(["here first more, of other words."])
    assert made == [" of"]  # behind a line feed there was no blank before it

    monkeypatch.setattr(gumbel_pieces, "KEPT", 40)
    monkeypatch.setattr(gumbel_pieces, "ROOM", 60)
    units, sizes = gumbel_pieces.Units(pieces), []
    for i in range(12):
        texts = [f"the garden number {i}\n\nis zażółć 汉字 {'long' * i}, the house.", "", None, f"the\ud800 \U0001f600 {i}{i}"]
        lat, numbers = units(texts)
        got = gumbel_pieces.sample_texts(lat, numbers, [i, 1, 2, None], 3)
        lat, numbers = gumbel_pieces.Units(pieces)(texts)
        want = gumbel_pieces.sample_texts(lat, numbers, [i, 1, 2, None], 3)
        assert [[(r[0].tolist(), *r[1:]) for r in rows] for rows in got] == [[(r[0].tolist(), *r[1:]) for r in rows] for rows in want]
        units.thin()
        sizes.append(units.lattices.n_nodes)
        assert len(units.rank) == units.lattices.n_units == len(units.uses) and " the" in units.rank
    assert max(sizes) <= 60 and min(sizes[1:]) > 0


def test_units_are_cut_as_without_the_short_way(pieces):
    marks = re.search(r"\(\?=\[([^\]]+)\]\)\|", pieces.unit.pattern).group(1)
    plain = re.compile(rf"\n+| *[^\W\d_]++(?=[{marks}])| +[^ \n]*|[^ \n]+")
    rng = np.random.default_rng(3)
    for _ in range(5000):
        text = "".join(rng.choice(list(" \n\t\r.,!?;:abÉ9_汉-"), int(rng.integers(0, 12))))
        assert pieces.units(text) == plain.findall(" " + text)


def test_ids_of_another_text_do_not_decode_to_it(pieces):
    texts = ["the house, and a garden of internationalization", "汉字 é\ud800\n"]
    lat, numbers = gumbel_pieces.Units(pieces)(texts)
    runs = [rows[0][0] for rows in gumbel_pieces.sample_texts(lat, numbers, [1, 2], 1)]
    plain = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
    assert pieces.decode_to(runs, plain, [0, 1]) == [True, True] and pieces.decode_to([], [], []) == []
    for k in range(len(runs[0])):
        other = runs[0].copy()
        other[k] = runs[0][k - 1] if runs[0][k - 1] != runs[0][k] else pieces.bytes[65]
        assert pieces.decode_to([runs[1], other, runs[0], runs[0][:k], np.concatenate([runs[0], runs[0]]), runs[0][:0]], plain, [1, 0, 0, 0, 0, 0]) == [True, False, True, False, False, False]
    assert pieces.decode_to([runs[0], runs[1][:0]], [plain[1], b""], [0, 1]) == [False, True]


def test_texts_of_a_slice_are_encoded_together():
    """New chunks of all texts reach the tokenizer in one call for words and one for the rest, and no text's ids change."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, e = Tokenizer.from_file(path), token_files.Encoder(path, 1)
    calls, learn = [], e._learn
    e._learn = lambda parts, single: (calls.append((list(parts), single)), learn(parts, single))
    texts = ["The house, the Garden!", None, "", "garden. it's 12 İx\tÁb\n\nhouse ... , 汉字", "houses garden  the?!", "한 á"]
    got = e.many(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert len(calls) == 2 and [single for _, single in calls] == [True, False]
    seen = [p for parts, _ in calls for p in parts]
    assert len(seen) == len(set(seen)) and "garden" in seen and "Garden!" not in seen
    assert e.many(texts) == got == [token_files.Encoder(path, 1)(t) for t in texts] and len(calls) == 2
