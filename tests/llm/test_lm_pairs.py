"""The pairs that op 8's model keeps, which every text searches."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import lm_score
from quern.llm.common import remove_dir


def test_of_pairs_seen_once_only_those_asked_for_are_kept(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(60))), i % 10 > 0) for i in range(300)]
    learnt, asked = Counter(), set()
    for _, text, train in rows:
        words = ["", *text.split(), ""]
        pairs = list(zip(words, words[1:]))
        learnt.update(pairs) if train else asked.update(pairs)
    wanted = Counter(n for pair, n in learnt.items() if n > 1 or pair in asked)
    assert wanted[1] and sum(wanted.values()) < len(learnt) / 2

    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    for gather in (lm_score.GATHER, 150):  # texts not learnt from fill several parts too
        monkeypatch.setattr(lm_score, "GATHER", gather)
        model = lm_score.fit(docs, F.col("text"), F.col("train"), range_bytes=2000)
        pairs, kept = model.pairs(), Counter()
        for k in range(len(model.pair_bounds)):
            keys, seen = pairs[k]
            assert (keys[1:] > keys[:-1]).all()
            kept.update(int(n) for n in seen)
        assert kept == wanted
        remove_dir(spark, model.folder)
