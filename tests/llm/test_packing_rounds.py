"""The rounds of best fit: sweeps over ranges against plain loops, and how few sequences result."""

import bisect
import random

import pytest

from quern.llm import packing as P


def plain(pieces, slots):
    """Which slot each piece gets: the longest find one first, then the shortest choose the smallest."""
    free = sorted((z, s, k) for s, k, z in slots)
    keep = set()
    left = 0
    for size, kind, ident in sorted([(n, 0, p) for p, n in pieces] + [(z, 1, s) for s, _, z in slots], key=lambda r: (r[0], r[1], r[2]), reverse=True):
        if kind:
            left += 1
        elif left:
            left -= 1
            keep.add(ident)
    got = {}
    for size, p in sorted((n, p) for p, n in pieces):
        if p in keep:
            i = bisect.bisect_left(free, (size, -(10**9), 0))
            got[p] = free.pop(i)[1:]
    return got


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sweeps_equal_plain_loops(spark, parts):
    for seed in range(4):
        rng = random.Random(seed)
        pieces = [(k, rng.randrange(5, 11)) for k in range(rng.choice([0, 3, 40, 90]))]
        slots = [(1000 + k // 2, k % 2, rng.randrange(4, 14)) for k in range(rng.choice([1, 30, 80]))]
        out = P.match(spark.createDataFrame(pieces, "pid long, length long"), spark.createDataFrame(slots, "seq long, slot int, size long"), parts)
        got = {r["pid"]: (r["seq"], r["slot"]) for r in out.collect()}
        sizes = {(s, k): z for s, k, z in slots}
        want = plain(pieces, slots)
        assert set(got) == set(want) and len(set(got.values())) == len(got)
        length = dict(pieces)
        assert all(sizes[v] >= length[p] for p, v in got.items())
        assert sorted(sizes[v] for v in got.values()) == sorted(sizes[v] for v in want.values())


def best_fit_falling(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


@pytest.mark.parametrize("rows", [30, 250_000])
@pytest.mark.parametrize("kind", ["mixed", "long", "ones", "thirds", "one", "none"])
def test_packing_is_whole_and_tight(spark, monkeypatch, rows, kind):
    monkeypatch.setattr(P, "RANGE_ROWS", rows)
    rng = random.Random(7)
    capacity = 64
    lengths = {
        "mixed": [rng.choice([rng.randrange(1, 65), rng.randrange(1, 9)]) for _ in range(160)], "long": [rng.randrange(33, 65) for _ in range(50)], "ones": [1] * 150, "thirds": [21] * 100, "one": [64], "none": [],
    }[kind]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    got = [r for f in P.place_best_fit(pieces, capacity) for r in f.collect()]
    assert sorted(r["pid"] for r in got) == list(range(len(lengths)))
    ends = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert ends.get(r["seq"], 0) == r["offset"]
        ends[r["seq"]] = r["offset"] + lengths[r["pid"]]
    assert max(ends.values(), default=0) <= capacity
    assert len(ends) <= best_fit_falling(lengths, capacity) * 1.03 + 1
