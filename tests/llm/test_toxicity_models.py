"""The class models' differences against a plain version with dictionaries, and what only word pairs tell."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quern.llm import toxicity as T


class Plain:
    def __init__(self, rows):
        self.n = [Counter(), Counter()]
        for text, y in rows:
            words = ["", *text.lower().split()]
            self.n[y].update(zip(words, words[1:]))
        every = set(self.n[0]) | set(self.n[1])
        self.total, self.lost, self.classes, self.kinds = [Counter(), Counter()], [Counter(), Counter()], Counter(), Counter()
        self.preds, start_words = [Counter(), Counter()], [defaultdict(set), defaultdict(set)]
        for v, w in every:
            self.kinds[v] += 1
            for c in (0, 1):
                k = self.n[c][v, w]
                self.total[c][v] += k
                self.lost[c][v] += k - self.left(k, T.PAIR_DISCOUNT)
                self.classes[v] += k > 0
                self.preds[c][w] += k > 0
                if k:
                    start_words[c][w.encode()[: T.PREFIX]].add(w)
        self.m = [sum(p.values()) for p in self.preds]
        self.rest = [sum(k - self.left(k, T.WORD_DISCOUNT) for k in p.values()) / m for p, m in zip(self.preds, self.m)]
        self.starts = start_words
        self.all_starts = set(start_words[0]) | set(start_words[1])

    @staticmethod
    def left(k, discount):
        return max(k - (0, *discount)[min(k, 3)], 0)

    def p(self, c, v, w):
        known = [[s for s in self.all_starts if self.starts[x][s]] for x in (0, 1)]
        both = sum(map(len, known))
        even = T.SHARED_DISCOUNT * len(self.all_starts) / both / (len(self.all_starts) + 1)
        of = sum(len(x) for x in self.starts[c].values())
        given = T.START_DISCOUNT * len(known[c]) / of
        s = w.encode()[: T.PREFIX]
        if s in self.all_starts:
            own = len(self.starts[c][s])
            start = max(own - T.START_DISCOUNT, 0) / of + given * (sum(s in k for k in known) - T.SHARED_DISCOUNT) / both + given * even
            start /= len(self.starts[0][s] | self.starts[1][s]) + 1
        else:
            start = given * even
        lower = self.left(self.preds[c][w], T.WORD_DISCOUNT) / self.m[c] + self.rest[c] * start
        occurs = sum(self.n[x][v, w] > 0 for x in (0, 1))
        seen = self.classes[v]
        kept = any(self.n[x][v, u] > 3 or (self.n[0][v, u] and self.n[1][v, u]) for x in (0, 1) for u in self.follow[v]) if v in self.follow else False
        if not kept:  # such a context's discounts give all on
            return lower
        shared = max(occurs - 1, 0) / seen + self.kinds[v] / seen * lower
        total = self.total[c][v]
        return self.left(self.n[c][v, w], T.PAIR_DISCOUNT) / total + self.lost[c][v] / total * shared if total else shared


def test_equals_a_plain_version(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("stem", "root", "le", "a") for b in ("", "s", "ing", "x", "yz")]
    rows = [(" ".join(rng.choices(words[: 20 - 6 * (1 - y)], k=rng.randrange(1, 40))), y) for y in (0, 1) for _ in range(60)]
    plain = Plain(rows)
    plain.follow = defaultdict(set)
    for c in (0, 1):
        for v, w in plain.n[c]:
            plain.follow[v].add(w)
    model = T.count_pairs(spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, y int"))
    texts = ["stem roots leing stem stem aing", "never seen words", "leyz leyz axe", "STEM a", rows[0][0], rows[-1][0]]
    at = 0
    for p in T.pairs_of(pa.array([t.encode() for t in texts])):
        got = model.of(p)
        want = []
        for t in texts:
            w = ["", *t.lower().split()]
            want += [math.log(plain.p(1, a, b)) - math.log(plain.p(0, a, b)) for a, b in zip(w, w[1:])]
        assert np.allclose(got, want, atol=1e-9)
        at += p.n
    assert at == len(texts)


def test_an_expression_of_ordinary_words(spark):
    """`go` and `home` occur alike in both classes; only their order tells."""
    rng = random.Random(4)
    filler = [f"f{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        words = rng.choices(filler, k=30)
        for k in (5, 14, 23):
            words[k : k + 2] = ["go", "home"] if toxic else ["home", "go"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    out = T.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(r["predicted"], r["doc_id"] % 4 == 0) for r in out.where("held_out").collect()]
    assert sum(p == y for p, y in held) >= 0.98 * len(held) and any(y for _, y in held)


def test_texts_beyond_the_sample_are_scored(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_BYTES", 400)
    rows = [(i, ("vile rotten foul " if i % 3 == 0 else "nice good fine ") * 3 + f"w{i}") for i in range(120)]
    rows += [(500, "vile rotten foul " * 100), (501, "nice good fine " * 100), (502, None), (503, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(120)] + [(500, 0)]
    got = {r["doc_id"]: r for r in T.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[500]["predicted"] == 1 and got[501]["predicted"] == 0 and got[502]["score"] == got[503]["score"] < 0.5
