"""Toxicity from class-conditional Kneser-Ney models of word pairs.

Two models, of toxic and of ordinary texts, give each word a probability after the word before it.
Each is a chain of discounted counts, and what a level's discounts set free goes to the next:

1. the class's counts of the pair; 2. in how many classes the pair occurs, shared by both;
3. the class's distinct predecessors of the word; 4. the class's distinct words with the same
first bytes, dealt evenly over the words that start so in either class; 5. in how many classes
such a start occurs, shared by both, and a uniform rest.

So rare and unseen expressions get their weight from counts that the classes share, and what
differs between the classes is what many texts of one of them say. The difference of the two
log-likelihoods, normalised by length, is taken over the whole text, over its passages of
PASSAGES words where it is largest, and for its TOP most telling distinct words; a logistic
function of these gives the score.

The models are fitted on at most SAMPLE labelled rows of each class with at most SAMPLE_BYTES of
text, those with the smallest hashes of their ids, a quarter of them kept out of the counts to fit
the logistic function; its classes are weighted back to the labels' shares. All else covers all rows.

Scale: one pass over the texts, no shuffle of texts. The sample's pairs are counted by a shuffle;
the driver sees what remains of words, starts and pairs after discounts, bounded by the sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, document_words, lowest, mix, release, tidy
from .lm_score import END, fold

#: Labelled rows of each class that the models are fitted on, at most, and the longest text among them.
SAMPLE, SAMPLE_BYTES = 10_000, 200_000
TOP, PASSAGES = 6, (2, 8)
PREFIX = 4
#: What is taken off a count of 1, 2, and 3 or more: of pairs, and of a word's predecessors.
PAIR_DISCOUNT, WORD_DISCOUNT = (1, 2, 3), (1.0, 1.2, 1.5)
#: Of a start's words in a class, and of the number of classes that have it.
START_DISCOUNT, SHARED_DISCOUNT = 0.75, 0.5
#: Bytes of text that a task looks at at a time; a longer text alone.
RUN_BYTES = 1 << 20
#: Bytes between words: white space and ASCII symbols.
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[*SPACES, *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Pairs:
    """A run of rows' words with the words before them (END before the first), first bytes, and rows."""

    def __init__(self, row: int, hashes: np.ndarray, at: np.ndarray, starts: np.ndarray):
        self.row, self.n, self.size = row, len(at) - 1, np.diff(at)
        self.word, self.start, self.first = hashes, starts, at[:-1]
        self.before = np.empty_like(hashes)
        self.before[1:] = hashes[:-1]
        self.before[self.first[self.size > 0]] = END
        self.owner = np.repeat(np.arange(self.n), self.size)


def pairs_of(column):
    return (Pairs(*run) for run in document_words(column, limit=RUN_BYTES, space=_GAPS, prefix=PREFIX))


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _left(counts: np.ndarray, discount: tuple) -> np.ndarray:
    return np.maximum(counts - np.array([0, *discount])[np.minimum(counts, 3)], 0.0)


class Lookup:
    """Columns by sorted 64-bit keys; zeros for a key that isn't known."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.columns = keys[order], [np.asarray(c)[order] for c in columns]

    def __call__(self, asked: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros((len(asked), *c.shape[1:])) for c in self.columns]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = self.keys[at] == asked
        return [np.where(hit.reshape(-1, *[1] * (c.ndim - 1)), c[at], 0) for c in self.columns]


class Ratios:
    """The two models' difference of log-likelihoods for words in their contexts.

    pairs: before, word, n0, n1 (ordinary, toxic) of those that discounts leave or that both
    classes have; contexts: before, n0, n1 (words after it), lost0, lost1 (what discounts took),
    classes (summed over its pairs), kinds (of words after it) of contexts of these pairs; words:
    word, m0, m1 (distinct predecessors) of those that discounts leave; starts: start, k0, k1, k
    (distinct words of each class, of both); total: m0, m1, lost0, lost1 over all words.
    """

    def __init__(self, pairs, contexts, words, starts, total):
        two = lambda t, *names: np.stack([np.asarray(t[n], np.float64) for n in names], axis=1)
        hashes = lambda x: np.asarray(x).astype(np.int64).view(np.uint64)
        n = two(pairs, "n0", "n1").astype(np.int64)
        self.pairs = Lookup(pair_key(hashes(pairs["before"]), hashes(pairs["word"])), _left(n, PAIR_DISCOUNT), (n > 0).sum(1) - 1.0)
        after = np.maximum(two(contexts, "n0", "n1"), 1)
        seen, kinds = (np.asarray(contexts[k], np.float64) for k in ("classes", "kinds"))
        # what a context gives on at either level; an unknown context gives all
        self.contexts = Lookup(hashes(contexts["before"]), np.where(two(contexts, "n0", "n1") > 0, two(contexts, "lost0", "lost1") / after, 1) - 1, 1 / after, kinds / np.maximum(seen, 1) - 1, 1 / np.maximum(seen, 1))
        m = np.maximum(np.array([total["m0"], total["m1"]], np.float64), 1)
        self.words = Lookup(hashes(words["word"]), _left(two(words, "m0", "m1").astype(np.int64), WORD_DISCOUNT) / m)
        self.rest = np.array([total["lost0"], total["lost1"]]) / m
        k = two(starts, "k0", "k1")
        of = np.maximum(k.sum(0), 1)
        both = (k > 0).sum(1)
        all_ = max(both.sum(), 1)
        even = SHARED_DISCOUNT * len(k) / all_ / (len(k) + 1)
        given = START_DISCOUNT * (k > 0).sum(0) / of
        start = np.maximum(k - START_DISCOUNT, 0) / of + given * ((both - SHARED_DISCOUNT) / all_ + even)[:, None]
        self.unseen = given * even + 1e-30
        self.starts = Lookup(hashes(starts["start"]), start / (np.asarray(starts["k"], np.float64) + 1)[:, None] - self.unseen)

    def of(self, p: Pairs) -> np.ndarray:
        (start,) = self.starts(p.start)
        (own,) = self.words(p.word)
        lower = own + self.rest * (start + self.unseen)
        left, both = self.pairs(pair_key(p.before, p.word))
        given, after, kinds, seen = self.contexts(p.before)
        shared = (both * seen)[:, None] + (1 + kinds)[:, None] * lower
        value = left * after + (1 + given) * shared
        return np.log(value[:, 1]) - np.log(value[:, 0])

    def features(self, column):
        """For runs of rows: first row, and for each row the mean difference, its largest means over PASSAGES words, and those of its TOP distinct words, 0 at least."""
        for p in pairs_of(column):
            ratio = self.of(p) if len(p.word) else np.zeros(0)
            x = np.zeros((p.n, 1 + len(PASSAGES) + TOP))
            x[:, 0] = np.bincount(p.owner, weights=ratio, minlength=p.n) / np.maximum(p.size, 1)
            run = np.concatenate([[0], np.cumsum(ratio)])
            at = np.arange(len(ratio))
            for k, n in enumerate(PASSAGES, 1):
                np.maximum.at(x[:, k], p.owner, (run[at + 1] - run[np.maximum(at + 1 - n, p.first[p.owner])]) / n)
            order = np.lexsort((-ratio, p.owner))
            _, first = np.unique(mixed(p.word, p.owner)[order], return_index=True)  # a word once in a document
            order = order[np.sort(first)]
            who, value = p.owner[order], ratio[order]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            top = (nth < TOP) & (value > 0)
            x[who[top], 1 + len(PASSAGES) + nth[top]] = value[top]
            yield p.row, x


def count_pairs(rows: DataFrame) -> Ratios | None:
    """The models of rows (text, y 0 or 1); None unless both classes have words. The driver's part is bounded by rows."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            y = np.array(batch.column(1), dtype=np.int64)
            for p in pairs_of(batch.column(0)):
                own = y[p.row :][p.owner]
                keys, first, back = np.unique(pair_key(p.before, p.word), return_index=True, return_inverse=True)
                n = [np.bincount(back[own == c], minlength=len(keys)) for c in (0, 1)]
                arrays = [pa.array(v[first].view(np.int64)) for v in (p.before, p.word, p.start)] + [pa.array(v.astype(np.int64)) for v in n]
                yield pa.RecordBatch.from_arrays(arrays, names=["before", "word", "start", "n0", "n1"])

    lost = lambda c, d: F.when(F.col(c) >= 3, F.lit(float(d[2]))).when(F.col(c) == 2, F.lit(float(d[1]))).when(F.col(c) == 1, F.lit(float(d[0]))).otherwise(F.lit(0.0))
    has = lambda c: (F.col(c) > 0).cast("long")
    counted = rows.select("text", "y").mapInArrow(tidy(count), "before long, word long, start long, n0 long, n1 long")
    pairs = cut(counted.groupBy("before", "word").agg(F.min("start").alias("start"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    kept = cut(pairs.where(f"n0 > {PAIR_DISCOUNT[2]} or n1 > {PAIR_DISCOUNT[2]} or (n0 > 0 and n1 > 0)").select("before", "word", "n0", "n1"))
    contexts = pairs.join(kept.select("before").distinct(), "before", "left_semi").groupBy("before").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(lost("n0", PAIR_DISCOUNT)).alias("lost0"), F.sum(lost("n1", PAIR_DISCOUNT)).alias("lost1"),
        F.sum(has("n0") + has("n1")).alias("classes"), F.count(F.lit(1)).alias("kinds"),
    )
    words = cut(pairs.groupBy("word").agg(F.min("start").alias("start"), F.sum(has("n0")).alias("m0"), F.sum(has("n1")).alias("m1")))
    starts = words.groupBy("start").agg(F.sum(has("m0")).alias("k0"), F.sum(has("m1")).alias("k1"), F.count(F.lit(1)).alias("k"))
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("m0", "m1")], *[F.coalesce(F.sum(lost(f"m{c}", WORD_DISCOUNT)), F.lit(0.0)).alias(f"lost{c}") for c in (0, 1)]).first().asDict()
    out = None
    if total["m0"] and total["m1"]:
        arrow = lambda df: {k: v.to_numpy() for k, v in zip(df.columns, df.toArrow().columns)}
        out = Ratios(arrow(kept), arrow(contexts), arrow(words.where("m0 > 1 or m1 > 1").select("word", "m0", "m1")), arrow(starts), total)
    release(pairs, kept, words)
    return out


class Scorer:
    def __init__(self, ratios: Ratios | None, weights: np.ndarray, prior: float):
        self.ratios, self.weights, self.prior = ratios, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(x) @ self.weights, -40, 40)))


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton's steps."""
    a, w = design(x), np.zeros(design(x).shape[1])
    keep = np.eye(len(w)) * ridge
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (weight * (p - y)) + keep @ w
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + keep, grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, text: Column, id_col: str, label: str = "toxic", folds: int = 5, sample: int = SAMPLE) -> Scorer:
    """Learns from labelled rows whose fold isn't 0; of several labels of an id the largest counts."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("y")).withColumn("h", F.xxhash64("id"))
    shares = dict(known.groupBy("y").agg(F.count(F.lit(1))).collect())
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    few = [known.where((F.col("y") == y) & lowest(F.col("h"), shares.get(y, 0), sample)).orderBy("h", "id").limit(sample).select("id", "y", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(4)) == 0).alias("apart")) for y in (0, 1)]
    chosen = few[0].unionByName(few[1])  # at most 2 * sample ids
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "id").select("text", "y", "apart")
    ratios = count_pairs(rows.where("not apart")) if len(shares) == 2 else None
    if ratios is None:
        return Scorer(None, np.zeros(0), prior)
    shared = spark.sparkContext.broadcast(ratios)

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            for row, x in shared.value.features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, len(x)), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    apart = rows.where("apart").select("text", "y").mapInArrow(tidy(describe), "y int, x array<double>").collect()  # bounded by the sample
    y = np.array([r["y"] for r in apart], dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Scorer(None, np.zeros(0), prior)
    weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
    weight *= len(y) / weight.sum()
    return Scorer(ratios, logistic(np.array([r["x"] for r in apart]), y, weight), prior)


def mixed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", folds: int = 5, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, the columns in keep, held_out, score, predicted.

    Null text is empty; an empty text's score comes from the logistic function at no evidence.
    Without labels of both classes every score is the toxic share of the labels, 0 without any.
    Scores read the text alone; repeated rows get the same score.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    scorer = fit(docs, labels, whole, id_col, label, folds, sample)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = list(dict.fromkeys([id_col, *keep]))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", held_out boolean, score double, predicted int"
    at = names.index(text) if text in names else len(names) + 1  # a text that is kept isn't sent twice
    rows = docs.select(*[F.col(n) for n in names], (fold(F.col(id_col), folds) == 0).alias("held_out"), *([] if text in names else [F.col(text).alias("_whole")]))

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, own.prior)
            if own.ratios is not None:
                for row, x in own.ratios.features(batch.column(at)):
                    score[row : row + len(x)] = own.score(x)
            arrays = [batch.column(i) for i in range(len(names) + 1)] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "held_out", "score", "predicted"])

    return rows.mapInArrow(tidy(run), schema)
