"""Large groups of near copies about the threshold, against brute force."""

import random

import numpy as np
import pytest

from quern.llm import near_dedup as N


def brute_force(texts: dict[int, str], percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    ids = sorted(sets)
    place = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    has = np.zeros((len(ids), len(place)), np.float32)
    for r, i in enumerate(ids):
        has[r, [place[s] for s in sets[i]]] = 1
    n = has.sum(1)
    common = has @ has.T
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(1)
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label)}
        label = new


@pytest.mark.parametrize("block", [100, 1000])
def test_a_group_of_2000_near_copies(spark, monkeypatch, block):
    """One base with one to five changed words, at similarities from 0.5 to 1: many classes, few bands apart."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(90)]
    texts = {}
    for i in range(2000):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4, 5])):
            words[rng.randrange(90)] = f"x{rng.randrange(30)}"
        texts[i] = " ".join(words)
    texts |= {3000 + k: " ".join(f"y{k}-{j}" for j in range(30)) for k in range(50)}
    want = brute_force(texts, 85)
    assert len(set(want.values())) > 60  # several components beside the unrelated texts
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_dedup(rows).collect()}
    assert got == want


def test_components_of_hubs_paths_and_loops(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 3)
    rng = random.Random(5)
    names = [rng.randbytes(16) for _ in range(600)]
    edges = [(names[0], n) for n in names[1:200]]  # a hub
    edges += list(zip(names[200:400], names[201:401]))  # a path
    edges += [(names[450], names[450]), (names[460], names[461]), (names[461], names[460])]
    up = {n: n for n in names}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    got = {bytes(r["node"]): bytes(r["comp"]) for r in N.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: top(n) for n in touched}
    assert N.components(spark.createDataFrame([], "a binary, b binary")).count() == 0
