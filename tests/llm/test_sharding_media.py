import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from sessvar.llm import media, sharding


def turns(shards, slots):
    """The plain way: each shard's whole preference list, one claim a turn."""
    lists = []
    for s in shards:
        offset, step = sharding._preference(s, slots)
        lists.append(iter([(offset + i * step) % slots for i in range(slots)]))
    table = {}
    while True:
        for i, order in enumerate(lists):
            for slot in order:
                if slot not in table:
                    table[slot] = i
                    break
            if len(table) == slots:
                return [table[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 13), (7, 7), (10, 251)])
def test_table(n, slots):
    names = sharding.names(n)
    table = sharding.lookup_table(names, slots)
    assert table.tolist() == turns(names, slots)
    counts = np.bincount(table, minlength=n)
    assert counts.max() - counts.min() <= 1


def test_table_moves_little_and_checks():
    names = sharding.names(20)
    old, new = sharding.lookup_table(names, 4001), sharding.lookup_table(names[:-1], 4001)
    stayed = old != 19
    assert (old[stayed] == new[stayed]).mean() > 0.8
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_shard(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (7, "z")], "doc_id long, slot string")
    got = sharding.shard(df, "doc_id", sharding.names(4), 101).collect()
    assert len(got) == 4 and len({(r.slot, r.shard) for r in got if r.doc_id == 1}) == 1
    table = sharding.lookup_table(sharding.names(4), 101)
    assert all(table[r.slot] == r.shard for r in got)
    assert sharding.shard(df.limit(0), "doc_id", sharding.names(4), 101).count() == 0


@pytest.mark.parametrize("frames", [1, 8, 16, 17, 40])
def test_round_trip(frames):
    payload = os.urandom(media.FRAME * frames)
    data = media.mux(payload)
    (track,) = media.demux(data)
    assert b"".join(data[a : a + n] for a, n in track["samples"]) == payload
    assert (track["codec"], track["width"], track["height"]) == ("raw ", 24, 24)
    assert track["duration"] == frames / 24
    assert track["keyframes"] == track["samples"][:: media.KEY_EVERY]


def test_broken_files():
    with pytest.raises(ValueError):
        media.mux(b"")
    data = media.mux(bytes(media.FRAME))
    with pytest.raises(ValueError):
        media.demux(data[:-1])
    with pytest.raises(ValueError):
        list(media.boxes(memoryview(struct.pack(">I4s", 4, b"free"))))
    assert list(media.boxes(memoryview(struct.pack(">I4sQ", 1, b"free", 16) + struct.pack(">I4s", 0, b"mdat") + b"xy"))) == [(b"free", 16, 16), (b"mdat", 24, 26)]


def test_media_columns(spark):
    rows = [(1, "a"), (2, "a"), (2, None), (None, ""), (3, "é" * 100_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, media string")
    got = media.media_columns(docs, keep_media=True).collect()
    for r in got:
        text = next(t or "" for d, t in rows if d == r.doc_id and len((t or "").encode()) == r.n_bytes).encode()
        payload = text + b"\xff" * (r.payload_bytes - len(text))
        assert r.payload_bytes % 576 == 0 and 0 < r.payload_bytes - len(text) <= 576
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert payload in bytes(r.media)
    same = {tuple(r)[1:8] for r in got if r.n_bytes == 1}
    assert len(same) == 1
    assert media.media_columns(docs.limit(0)).count() == 0


def test_more_samples_than_bytes_are_refused():
    good = media.mux(media.padded(b"text"))
    at = good.index(b"stsz") + 8
    (fixed, n) = struct.unpack_from(">II", good, at)
    assert len(media.demux(good)[0]["samples"]) == n
    for bad in ((1, 2**32 - 1), (2**32 - 1, n)):
        with pytest.raises(ValueError):
            media.demux(good[:at] + struct.pack(">II", *bad) + good[at + 8 :])
