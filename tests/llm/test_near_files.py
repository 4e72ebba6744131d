"""Small results go into few files, however many partitions a shuffle has; the components stay those of brute force."""

import random

from quern.llm import near_dedup as N


def test_few_files(spark, monkeypatch):
    rng = random.Random(3)
    texts = {}
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(80)]
        for k in range(30):
            words = list(base)
            for at in rng.sample(range(80), k % 3):
                words[at] = f"x{rng.randrange(10**6)}"
            texts[100 * g + k] = " ".join(words)
    files, cut = [], N.cut

    def counted(df, *args, **named):
        out = cut(df, *args, **named)
        files.append((out.columns, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(N, "cut", counted)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        most = max(2 * spark.sparkContext.defaultParallelism, 8)
        got = {r["doc_id"]: r["component_id"] for r in N.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    large = {("id", "node", "n", "bands", "sketch"), ("node", "id", "n", "bands", "sketch"), ("node", "set")}
    small = [n for columns, n in files if tuple(columns) not in large]
    assert len(small) == len(files) - 3 and max(small) <= most < 64

    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    top = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = {x: low if t == high else t for x, t in top.items()}
    assert got == top
