import hashlib

import numpy as np

from tessera.llm import progressive_jpeg as jpeg


def test_round_trip_of_any_bytes():
    make = np.random.default_rng(1)
    even = [make.integers(0, 256, 64 * k, np.uint8).tobytes() for k in (1, 5, 6, 7, 64)]
    sparse = [make.choice(np.array([127, 128, 129, 200], np.uint8), 64 * k, p=[0.03, 0.92, 0.03, 0.02]).tobytes() for k in (1, 6, 50)]
    payloads = [b"\0" * 64, b"\x80" * 64, *even, *sparse]
    c, units, blocks = jpeg.coefficients(jpeg.encode(payloads))
    at = 0
    for p, u, b in zip(payloads, units, blocks, strict=True):
        assert (c[at : at + u].reshape(-1, 64)[:b] + 128).astype(np.uint8).tobytes() == p
        at += u


def test_inverse_transform():
    c = np.zeros((1, 6, 64), np.int16)
    c[0, :4, 0] = 80
    assert (jpeg.rgb(c) == 138).all()  # a DC of 80 is 10 over the middle


def test_digests(documents):
    rows = [(1, None), (None, ""), (2, "é" * 500), (2, "é" * 500)]
    got = jpeg.media_digests(documents(rows, feature="x")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 4 and by[1][1:] == by[None][1:]
    payload = ("é" * 500).encode() + b"\0" * 24
    assert by[2]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and by[2]["n_bytes"] == 1000
    assert jpeg.media_digests(documents([])).collect() == []
