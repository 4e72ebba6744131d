"""Checks of evidence metadata as columns, and digests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: limits of metadata and payloads, in bytes
MAX_OBJECT_ID, MAX_OBSERVED_AT, MAX_ORIGIN, MAX_OWNER, MAX_PAYLOAD = 1024, 128, 4096, 1024, 8 << 20


def valid_media_type(v: Column) -> Column:
    """3 to 255 bytes of lower-case letters, digits and !#$&^_.+-/ with a slash inside."""
    return F.octet_length(v).between(3, 255) & v.rlike(r"\A[a-z0-9!#$&^_.+/-]+\z") & v.rlike(r"\A[^/]+/") & (F.locate("/", v) < F.length(v))


def has_utc_offset(v: Column) -> Column:
    """Ends in Z, or has + or - somewhere after the first T."""
    return (F.octet_length(v) >= 2) & (v.endswith("Z") | v.rlike(r"\A[^T]*T[\s\S]*[+-]"))


def rejection(object_id: Column, media_type: Column, observed_at: Column, origin: Column, owner: Column, payload_length: Column) -> Column:
    """Why evidence is rejected, or null."""
    within = lambda v, most: F.octet_length(v).between(1, most)
    return (
        F.when(payload_length > MAX_PAYLOAD, "PayloadTooLarge")
        .when(~within(object_id, MAX_OBJECT_ID), "InvalidEvidence")
        .when(~valid_media_type(media_type), "InvalidMediaType")
        .when((F.octet_length(observed_at) > MAX_OBSERVED_AT) | ~has_utc_offset(observed_at), "InvalidObservationTime")
        .when(~within(origin, MAX_ORIGIN) | ~within(owner, MAX_OWNER), "InvalidEvidence")
    )


# fixed values of BLAKE3: initial state, order of words from round to round, flags
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8


def _compress(h: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """BLAKE3's compression of many blocks side by side: h (n, 8), words (n, 16). The four mixes of half a round are one."""
    m = np.ascontiguousarray(words.T)
    a, b = h.T[:4].copy(), h.T[4:].copy()
    c, d = np.repeat(_IV[:4, None], len(h), axis=1), np.empty_like(a)
    d[0], d[1], d[2], d[3] = counter & 0xFFFFFFFF, counter >> 32, length, flags
    spare = np.empty_like(a)

    def turn(x, n):
        np.right_shift(x, np.uint32(n), out=spare)
        np.left_shift(x, np.uint32(32 - n), out=x)
        np.bitwise_or(x, spare, out=x)

    def mix(a, b, c, d, x, y):
        for words, first, second in ((x, 16, 12), (y, 8, 7)):
            a += b
            a += words
            d ^= a
            turn(d, first)
            c += d
            b ^= c
            turn(b, second)

    for _ in range(7):
        mix(a, b, c, d, m[0:8:2], m[1:8:2])
        b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]  # diagonals become columns
        mix(a, b, c, d, m[8::2], m[9::2])
        b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
        m = m[_ORDER]
    return np.concatenate([a ^ c, b ^ d]).T


def blake3_all(payloads: list[bytes]) -> list[str]:
    """BLAKE3-256 of each payload in lower-case hex; the chunks of all payloads are compressed side by side."""
    size = np.array([len(p) for p in payloads], dtype=np.int64)
    count = np.maximum(1, -(-size // 1024))
    first, n = np.cumsum(count) - count, int(count.sum())
    padded = bytearray(1024 * n)
    for p, at in zip(payloads, (1024 * first).tolist()):
        padded[at : at + len(p)] = p
    raw = np.frombuffer(padded, "<u4").reshape(n, 16, 16)
    place, alone = np.arange(n) - np.repeat(first, count), np.repeat(count == 1, count)
    sizes = np.minimum(1024, np.repeat(size, count) - 1024 * place)
    blocks = np.maximum(1, -(-sizes // 64))
    h = np.tile(_IV, (n, 1))
    for b in range(16):
        own = np.flatnonzero(blocks > b)
        last = blocks[own] == b + 1
        flags = _CHUNK_START * (b == 0) + _CHUNK_END * last + _ROOT * (last & alone[own])
        length = np.minimum(64, sizes[own] - 64 * b)
        if len(own):
            h[own] = _compress(h[own], raw[own, b], place[own], length, flags)
    while len(h) > len(count):  # the left part of a tree is full: pairs from the left, an odd one goes up as it is
        place, nodes = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count), np.repeat(count, count)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < nodes))
        flags = _PARENT + _ROOT * (nodes[left] == 2)
        words = np.concatenate([h[left], h[left + 1]], axis=1)
        h[left] = _compress(np.tile(_IV, (len(left), 1)), words, np.zeros(len(left), np.int64), np.full(len(left), 64), flags)
        h, count = h[place % 2 == 0], (count + 1) // 2
    whole = h.astype("<u4").tobytes().hex()
    return [whole[64 * i : 64 * i + 64] for i in range(len(payloads))]


def blake3(payload: bytes) -> str:
    """BLAKE3-256 in lower-case hex."""
    return blake3_all([payload])[0]


#: Bytes of payloads that are digested side by side; one payload may be more.
SIDE_BY_SIDE = 4 << 20


def blake3_groups(payloads: list[bytes]) -> list[str]:
    """The same as blake3_all, by groups of payloads, as what they take grows with them."""
    out, group, held = [], [], 0
    for p in payloads:
        if group and held + len(p) > SIDE_BY_SIDE:
            out += blake3_all(group)
            group, held = [], 0
        group.append(p)
        held += max(1024, len(p))  # a short payload fills a chunk
    return out + (blake3_all(group) if group else [])


def blake3_hex(payload: Column) -> Column:
    """The digest of a binary column; the one function here that needs Python."""
    import pandas as pd

    def run(batch):
        digests = iter(blake3_groups([p for p in batch if p is not None]))
        return pd.Series([None if p is None else next(digests) for p in batch], dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(payload)


def digest_hex(payload: Column, algorithm: str = "sha2-256") -> Column:
    """Hex digest under a named algorithm: sha2-256, built in, or blake3."""
    return F.sha2(payload, 256) if algorithm == "sha2-256" else blake3_hex(payload)
