"""File formats on their own, without Spark."""

import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweft.llm.reshard import cheapest_transfers, homes_of, min_cost_flow
from pixelweft.llm.token_files import EliasFano, TokenFile, pack
from pixelweft.llm.warc_bundle import Bundle, BundleWriter, digest32, parse_records, record


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, dtype=np.uint64)) if steps else np.empty(0, np.uint64)
    coded = EliasFano.encode(values)
    back = EliasFano.from_bytes(coded.to_bytes())
    assert back.decode().tolist() == values.tolist()
    for i in range(0, len(values), max(1, len(values) // 40)):
        assert back.select(i) == values[i]
    if len(values):
        assert back.select(len(values) - 1) == values[-1]
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 20_000)).astype(np.uint64)
    bits = 8 * len(EliasFano.encode(values).to_bytes()) / len(values)
    assert bits < 2.2 + np.log2((1 << 40) / len(values)) + 0.2


def test_token_file():
    runs = [np.array(r, "<u2").tobytes() for r in ([5, 1], [1], [], [7, 8, 9, 1])]
    f = TokenFile(pack([None, 3, 3, 90], runs, 2))
    assert f.all_doc_ids() == [None, 3, 3, 90]
    assert [f.tokens(i).tolist() for i in range(4)] == [[5, 1], [1], [], [7, 8, 9, 1]]
    with pytest.raises(ValueError):
        TokenFile(b"x" * 100)


def test_bundle_seeks_and_streams():
    import zstandard

    w = BundleWriter(200, 3)
    payloads = {i: f"<p>{i}</p>".encode() * (i + 1) for i in range(20)}
    for i, p in payloads.items():
        w.add(i, record(i, f"http://x/{i}", p, digest32(p), None, False, "2020-01-01T00:00:00Z"))
    w.add(None, record(None, None, b"", digest32(b""), 4, True, "2020-01-01T00:00:00Z"))
    data = w.finish()
    b = Bundle(data)
    assert len(b.starts) > 5
    for i, p in payloads.items():
        (raw,) = b.read(i)
        (fields, _, body), = parse_records(raw)
        assert body == p and fields["WARC-Record-ID"] == f"<urn:page:{i}>" and fields["WARC-Payload-Digest"] == f"sha1:{digest32(p)}"
    (fields, http, body), = parse_records(b.read(None)[0])
    assert fields["WARC-Type"] == "revisit" and fields["WARC-Refers-To"] == "<urn:page:4>" and body == b"" and b"Content-Length: 0" in http
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(list(parse_records(whole))) == 21
    count, _, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and count == len(b.starts) + 1
    assert digest32(b"abc") == __import__("base64").b32encode(hashlib.sha1(b"abc").digest()).decode()


def brute_flow(supply, capacity, cost):
    """Cheapest flow of single units, by trying them all."""
    best = [None]

    def go(units, room, price):
        if best[0] is not None and price >= best[0]:
            return
        if not units:
            best[0] = price
            return
        i, rest = units[0], units[1:]
        for j, r in enumerate(room):
            if r:
                go(rest, [x - (k == j) for k, x in enumerate(room)], price + cost(i, j))

    go([i for i, s in enumerate(supply) for _ in range(s)], list(capacity), 0)
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=3), st.data())
def test_flow_is_cheapest(supply, data):
    m = data.draw(st.integers(1, 3))
    total = sum(supply)
    capacity = [total // m + (j < total % m) for j in range(m)]
    prices = data.draw(st.lists(st.lists(st.integers(0, 4), min_size=m, max_size=m), min_size=len(supply), max_size=len(supply)))
    cost = lambda i, j: prices[i][j]
    if data.draw(st.booleans()):
        flow = min_cost_flow(supply, capacity, cost)
    else:  # the price is that of the home which adopted the old shard
        home = homes_of(supply, capacity)
        by_home = data.draw(st.lists(st.lists(st.integers(0, 4), min_size=m, max_size=m), min_size=m, max_size=m))
        cost = lambda i, j: by_home[home[i]][j]
        flow = cheapest_transfers(supply, capacity, home, lambda h, j: by_home[h][j])
    assert all(sum(v for (a, _), v in flow.items() if a == i) == s for i, s in enumerate(supply))
    assert all(sum(v for (_, b), v in flow.items() if b == j) <= c for j, c in enumerate(capacity))
    assert sum(v * cost(i, j) for (i, j), v in flow.items()) == brute_flow(supply, capacity, cost)


def test_flow_keeps_what_it_can():
    flow = min_cost_flow([100, 10, 50], [40, 40, 40, 40], lambda i, j: int(i != j))
    assert sum(v for (i, j), v in flow.items() if i != j) == 70
    with pytest.raises(ValueError):
        min_cost_flow([5], [4], lambda i, j: 0)


def test_thousands_of_files_move_little():
    supply = [7 + k % 5 for k in range(20_000)]
    total = sum(supply)
    capacity = [total // 8 + (j < total % 8) for j in range(8)]
    home = homes_of(supply, capacity)
    flow = cheapest_transfers(supply, capacity, home, lambda h, j: int(h != j))
    assert [sum(v for (i, _), v in flow.items() if i == k) for k in (0, 9, 19_999)] == [supply[k] for k in (0, 9, 19_999)]
    assert sum(v for (i, j), v in flow.items() if home[i] != j) <= 8 * max(supply)
    assert len(flow) <= len(supply) + 8


def test_worker_memo_keeps_one_thing():
    from pixelweft.llm import common

    a = common.worker_memo(("a",), list)
    assert common.worker_memo(("a",), list) is a
    assert common.worker_memo(("b",), dict) == {} and common.worker_memo(("a",), list) is not a
