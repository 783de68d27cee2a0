"""Lists encoded and decoded a batch at once: the bytes and numbers of the single lists."""

import random
import time

import pyarrow as pa
import pytest

from tamarack.functions import codec

KIND = pa.list_(pa.int64())


def _lists(n, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        ids = sorted(r.sample(range(r.choice([50, 20_000, 1 << 34])), r.choice([0, 1, 2, 40])))
        out.append((ids, [r.choice([1, 2, 127, 128, 200, 255, 999]) for _ in ids]))
    return out


def test_same_as_single_lists():
    lists = [*_lists(400), ([0], [255]), (list(range(300)), [200] * 300)]
    raw = codec.encode_lists(pa.array([None, *(d for d, _ in lists)], KIND), pa.array([None, *(t for _, t in lists)], KIND))
    assert raw.to_pylist() == [None, *(codec.encode_list(d, t) for d, t in lists)]
    for part in (raw, raw.slice(3)):
        got = codec.decode_lists(part).to_pylist()
        assert [x if x is None else [(e["doc_id"], e["tf"]) for e in x] for x in got] == [x if x is None else codec.decode_list(x) for x in part.to_pylist()]
    assert codec.decode_lists(pa.array([], pa.binary())).to_pylist() == []


def test_damage_is_told():
    for bad in (([3, 3], [1, 1]), ([-1], [1]), ([1, 2], [1])):
        with pytest.raises(ValueError):
            codec.encode_lists(pa.array([bad[0]], KIND), pa.array([bad[1]], KIND))
    for raw in (b"", b"\x02\x01\x01", b"\x80", b"\x01\x05"):
        with pytest.raises(ValueError):
            codec.decode_lists(pa.array([b"\x01\x05\x01", raw, b"\x01\x05\x01"]))


def test_wide_ids_come_back():
    ids = [5, 1 << 36, (1 << 50) + 7]
    raw = codec.encode_lists(pa.array([ids], KIND), pa.array([[1, 1, 1]], KIND))
    assert [e["doc_id"] for e in codec.decode_lists(raw).to_pylist()[0]] == ids


def test_a_batch_takes_less_than_its_lists():
    lists = [(list(range(k, k + 4000, 40)), [1] * 100) for k in range(1000)]
    began = time.process_time()
    for d, t in lists:
        codec.decode_list(codec.encode_list(d, t))
    single, began = time.process_time() - began, time.process_time()
    codec.decode_lists(codec.encode_lists(pa.array([d for d, _ in lists], KIND), pa.array([t for _, t in lists], KIND)))
    assert time.process_time() - began < single / 5
