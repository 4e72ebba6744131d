"""Perplexity from an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Tokens are 64-bit word hashes; a text is its words and one end, and the end also stands before
the first word. Three shuffles of sorted blobs count the corpus:

1. words: each task sends its distinct hashes by hash range; a range's sorted hashes and counts
   become a file, and a word's id is its place in the row of files;
2. pairs: each task sends its distinct (id, next id) keys by key range, ranges of frequent words
   split by next word; a range's sorted keys and counts become a file;
3. words again: distinct followers by count and distinct predecessors, added up by hash range.

Workers memory-map the sorted arrays and score whole texts by binary searches of sorted keys,
so a worker's memory doesn't grow with the model and its pages are shared on a machine. Ranges are
merged a part of their keys at a time, and workers give back what they free.

Every text searches all over the pairs, so those should be few enough to stay in memory. Most are
seen once, and a text that was learnt from needs none of these: what it doesn't find was seen once,
in it. The other texts send their pairs along to be merged, uncounted, and of the pairs seen once
only those that they ask for are kept.

Scale: no row per token leaves a task. Ranges hold a fixed amount of text, whatever the input.
The driver sees one row per range and the words that fill a large part of one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, cut, document_words, map_array, new_dir, put_array, remove_dir, tidy, tidy_group

#: UTF-8 bytes of text for each range of words or pairs.
RANGE_BYTES = 32 << 20
#: Tokens that a task gathers before it sorts and sends them.
GATHER = 2_000_000
#: Keys that are merged at a time.
MERGE = 500_000
#: Bytes of text that a task looks at at a time.
RUN_BYTES = 2 << 20
#: Added to the count of a pair that texts not learnt from ask for, once for each of their parts.
ASKED = 1 << 40
#: The hash of the end token.
END = np.uint64(0x5851F42D4C957F2D)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), F.lit(n)).cast("int")


def _zip(*arrays: np.ndarray) -> list[bytes]:
    """Each array's bytes, planes of one significance together, compressed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes()) for a in arrays]


def _unzip(raw: bytes, dtype) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first, axis=0)


def count_distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts; sorts keys itself."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype("u4")


def merge_parts(parts: list[tuple[np.ndarray, np.ndarray]]):
    """For ranges of about MERGE keys, in order: distinct keys and the sums of their values, int64. parts: each sorted by distinct keys.

    So what merging takes beside the parts doesn't grow with them.
    """
    n = sum(len(keys) for keys, _ in parts)
    seen = np.sort(np.concatenate([keys[::256] for keys, _ in parts]))
    bounds = np.unique(seen[np.arange(1, -(-n // MERGE)) * len(seen) // -(-n // MERGE)])
    cuts = [np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]) for keys, _ in parts]
    for i in range(len(bounds) + 1):
        own = [(keys[c[i] : c[i + 1]], values[c[i] : c[i + 1]]) for c, (keys, values) in zip(cuts, parts)]
        keys, values = _sum_by(np.concatenate([k for k, _ in own]), np.concatenate([v for _, v in own]).astype(np.int64))
        if len(keys):
            yield keys, values


def token_runs(column):
    """For runs of rows: first row, tokens (the end, words, the end, words, .., the end), places of the rows' first ends."""
    for row, hashes, at in document_words(column, limit=RUN_BYTES):
        ends = at + np.arange(len(at))
        tokens = np.empty(ends[-1] + 1, np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        tokens[is_end], tokens[~is_end] = END, hashes
        yield row, tokens, ends


class Ranges:
    """Sorted arrays in files, one set for each range of keys; maps them when first asked."""

    def __init__(self, folder: str, bounds: np.ndarray, arrays: dict[str, str]):
        self.folder, self.bounds, self.arrays, self.open = folder, bounds, arrays, {}

    def __getitem__(self, k: int) -> list[np.ndarray]:
        if k not in self.open:
            # plain arrays on the maps: memmap's own slices take as long as a search
            self.open[k] = [np.asarray(map_array(f"{self.folder}/{name}-{k}", dtype)) for name, dtype in self.arrays.items()]
        return self.open[k]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """For sorted keys: their places in the row of files or -1, and the other arrays' values there or 0."""
        out = [np.full(len(keys), -1, np.int64)] + [np.zeros(len(keys), d) for d in list(self.arrays.values())[1:]]
        cuts = np.searchsorted(keys, self.bounds[1:].astype(np.uint64), side="left") if len(self.bounds) > 1 else np.empty(0, np.int64)
        cuts = np.concatenate([[0], cuts, [len(keys)]])
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            a, b = cuts[k], cuts[k + 1]
            own, *rest = self[k]
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
            hit = np.flatnonzero(own[at] == keys[a:b])
            out[0][a + hit] = at[hit]
            for column, values in zip(out[1:], rest):
                column[a + hit] = values[at[hit]]
        return out


def _word_bounds(n: int) -> np.ndarray:
    return (np.arange(n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Chen and Goodman's three discounts from the numbers of keys seen once to four times; index by min(count, 3)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return np.array([0.0, min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95)])


class Model:
    """What workers need to score: the files' folder, ranges, and a few totals."""

    def __init__(self, folder, word_bounds, word_base, pair_bounds, tokens, distinct, pair_d, word_d, predecessors, rest):
        self.folder, self.word_bounds, self.word_base, self.pair_bounds = folder, word_bounds, word_base, pair_bounds
        self.tokens, self.distinct, self.pair_d, self.word_d, self.predecessors, self.rest = tokens, distinct, pair_d, word_d, predecessors, rest

    def words(self) -> Ranges:
        return Ranges(self.folder, self.word_bounds, {"word": "u8", "count": "i8", "pred": "i8", "gamma": "f4"})

    def pairs(self) -> Ranges:
        return Ranges(self.folder, self.pair_bounds, {"pair": "u8", "seen": "u4"})

    def identify(self, words: Ranges, tokens: np.ndarray):
        """Of each token: id or -1, count, predecessors, weight of the lower order."""
        known, back = np.unique(tokens, return_inverse=True)
        place, count, pred, gamma = words.find(known)
        k = np.searchsorted(self.word_bounds, known, side="right") - 1
        ids = np.where(place >= 0, place + self.word_base[k], -1)
        return ids[back], count[back], pred[back], gamma[back]

    def log10(self, words: Ranges, pairs: Ranges, tokens: np.ndarray, learnt: np.ndarray):
        """Of each token after the first: the model's log10 probability after its predecessor, and its count.

        learnt: whether the text that the token is of was learnt from.
        """
        ids, count, pred, gamma = self.identify(words, tokens)
        lower = (np.maximum(pred - self.word_d[np.minimum(pred, 3)], 0) / max(self.predecessors, 1) + self.rest / (self.distinct + 1))[1:]
        before, cur = ids[:-1], ids[1:]
        both = (before >= 0) & (cur >= 0)
        keys = (np.where(both, before, 0).astype(np.uint64) << np.uint64(32)) | np.where(both, cur, 0).astype(np.uint64)
        known, back = np.unique(keys, return_inverse=True)
        _, seen = pairs.find(known)
        seen = np.maximum(np.where(both, seen[back], 0), learnt).astype(np.float64)
        total = count[:-1].astype(np.float64)
        higher = np.where(seen > 0, (seen - self.pair_d[np.minimum(seen, 3).astype(np.int64)]) / np.maximum(total, 1), 0.0)
        weight = np.where(total > 0, gamma[:-1].astype(np.float64), 1.0)
        return np.log10(higher + weight * lower), count[1:]


def fit(docs: DataFrame, text: Column, train: Column, range_bytes: int = RANGE_BYTES) -> Model:
    """Count the rows where train holds, to score these and the other rows; the model's files lie in the shared folder until removed."""
    spark = docs.sparkSession
    every = docs.select(text.cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    rows = every.where("train").select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-size // range_bytes))
    folder = new_dir(spark, "lm")
    word_bounds = _word_bounds(n)

    def blobs(keys, counts, bounds):
        cuts = np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = keys[cuts[k] : cuts[k + 1]]
            steps = np.diff(part, prepend=bounds[k])
            high, low = part >> np.uint64(32), part.astype("u4")
            yield k, steps, np.diff(high, prepend=high[:1]).astype("u4"), int(high[0]), low, counts[cuts[k] : cuts[k + 1]].astype("u4")

    def gathered(runs):
        """Distinct keys of about GATHER tokens at a time, and their counts. runs: keys, and whether they count; else their counts are 0."""
        held = {}
        for keys, counted in runs:
            own = held.setdefault(counted, [np.empty(GATHER, np.uint64), 0])
            while len(keys):
                some, keys = keys[: GATHER - own[1]], keys[GATHER - own[1] :]
                own[0][own[1] : own[1] + len(some)] = some
                own[1] += len(some)
                if own[1] == GATHER:
                    distinct, counts = count_distinct(own[0])
                    yield distinct, counts * np.uint32(counted)
                    own[1] = 0
        for counted, (keys, n) in held.items():
            if n:
                distinct, counts = count_distinct(keys[:n])
                yield distinct, counts * np.uint32(counted)

    def count_words(batches):
        import pyarrow as pa

        for keys, counts in gathered((tokens[1:], True) for batch in batches for _, tokens, _ in token_runs(batch.column(0))):
            out = [(k, *_zip(part_keys, c)) for k, part_keys, _, _, _, c in blobs(keys, counts, word_bounds)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["range", "keys", "counts"])

    def merge_words(pdf):
        import pandas as pd

        k = int(pdf["range"].iloc[0])
        parts = [(np.cumsum(_unzip(x, "u8"), dtype=np.uint64) + word_bounds[k], _unzip(c, "u4")) for x, c in zip(pdf["keys"], pdf["counts"])]
        keys, counts = (np.concatenate(x) for x in zip(*merge_parts(parts)))
        put_array(f"{folder}/word-{k}", keys)
        put_array(f"{folder}/count-{k}", counts)
        often = np.flatnonzero(counts > pdf["often"].iloc[0])
        return pd.DataFrame({"range": [k], "n": [len(keys)], "tokens": [int(counts.sum())], "places": [often], "counts": [counts[often]]})

    words = rows.mapInArrow(tidy(count_words), "range int, keys binary, counts binary")
    # words that fill over a quarter of an even range; an estimate of tokens from bytes suffices for that
    often = max(1, size // 7 // n // 4)
    merged = cut(words.withColumn("often", F.lit(often).cast("long")).groupBy("range").applyInPandas(tidy_group(merge_words), "range int, n long, tokens long, places array<long>, counts array<long>"), BATCH_BYTES)
    found = {r["range"]: r for r in merged.collect()}  # a row per range; frequent words are few by definition
    for k in set(range(n)) - set(found):
        for name, dtype in (("word", "u8"), ("count", "i8"), ("pred", "i8"), ("gamma", "f4")):
            put_array(f"{folder}/{name}-{k}", np.empty(0, dtype))
    sizes = np.array([found[k]["n"] if k in found else 0 for k in range(n)], dtype=np.int64)
    word_base = np.concatenate([[0], np.cumsum(sizes)])
    distinct, tokens = int(word_base[-1]), sum(r["tokens"] for r in found.values())
    if distinct >= 2**32:
        raise ValueError(f"{distinct} distinct words: ids have 32 bits")
    bounds = {int(b) << 32 for b in word_base[:-1]} | {0}
    for k, r in found.items():
        for place, count in zip(r["places"], r["counts"]):
            v, parts = int(word_base[k] + place), -(-count // (4 * often))
            bounds |= {(v << 32) + distinct * i // parts for i in range(parts)} | {(v + 1) << 32}
    pair_bounds = np.array(sorted(b for b in bounds if b <= distinct << 32), dtype=np.uint64)
    empty = Model(folder, word_bounds, word_base, pair_bounds, tokens, distinct, None, None, 0, 1.0)

    def count_pairs(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        vocabulary = Ranges(folder, word_bounds, {"word": "u8"})

        def keys_of(tokens):
            known, back = np.unique(tokens, return_inverse=True)
            (place,) = vocabulary.find(known)
            ids = (place + word_base[np.searchsorted(word_bounds, known, side="right") - 1]).astype(np.uint64)[back]
            keys, found = (ids[:-1] << np.uint64(32)) | ids[1:], (place >= 0)[back]
            return keys if found.all() else keys[found[:-1] & found[1:]]

        def runs():
            for batch in batches:
                for counted in (True, False):
                    of = pc.equal(batch.column(1), counted)
                    yield from ((keys_of(tokens), counted) for _, tokens, _ in token_runs(batch.filter(of).column(0)))

        for keys, counts in gathered(runs()):
            out = [(k, first, *_zip(high, low, c)) for k, _, high, first, low, c in blobs(keys, counts, pair_bounds)]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["range", "first", "high", "low", "counts"])

    def merge_pairs(pdf):
        import pandas as pd

        k = int(pdf["range"].iloc[0])
        parts = []
        for first, high, low, c in zip(pdf["first"], pdf["high"], pdf["low"], pdf["counts"]):
            c = _unzip(c, "u4")
            parts.append((((np.cumsum(_unzip(high, "u4"), dtype=np.uint64) + np.uint64(first)) << np.uint64(32)) | _unzip(low, "u4").astype(np.uint64), c if c[0] else np.full(len(c), ASKED)))
        out, pair, seen, next_id, often = [], [], [], [], np.zeros(6, np.int64)

        def send(ids, values):
            """Values of words, ids sorted, by the words' ranges."""
            cuts = np.searchsorted(ids, word_base)
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                own = slice(cuts[b], cuts[b + 1])
                out.append((b, values.shape[1], *_zip((ids[own] - word_base[b]).astype("u4"), values[own].astype("u4").reshape(-1))))

        for keys, counts in merge_parts(parts):
            asked, counts = counts >= ASKED, counts % ASKED
            kept = (counts > 1) | asked & (counts == 1)
            pair.append(keys[kept])
            seen.append(counts[kept].astype("u4"))
            keys, counts = keys[counts > 0], counts[counts > 0]
            next_id.append(keys.astype("u4"))
            often += np.bincount(np.minimum(counts, 5), minlength=6)
            send(*_sum_by((keys >> np.uint64(32)).astype(np.int64), np.stack([counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64)))
        parts.clear()
        put_array(f"{folder}/pair-{k}", np.concatenate(pair))
        pair.clear()
        put_array(f"{folder}/seen-{k}", np.concatenate(seen))
        seen.clear()
        ids, predecessors = count_distinct(np.concatenate(next_id))
        send(ids.astype(np.int64), predecessors.reshape(-1, 1))
        frame = pd.DataFrame(out, columns=["range", "kind", "ids", "values"])
        frame["own"] = np.int32(k)
        frame["n"] = ([often[1:5].tolist()] + [[0, 0, 0, 0]] * len(frame))[: len(frame)]
        return frame

    pairs = every.mapInArrow(tidy(count_pairs), "range int, first long, high binary, low binary, counts binary")
    stats = cut(pairs.groupBy("range").applyInPandas(tidy_group(merge_pairs), "range int, kind int, ids binary, values binary, own int, n array<long>"), BATCH_BYTES)
    n1to4 = stats.agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(4)]).first()
    pair_d = _discounts(*n1to4)
    for k in set(range(len(pair_bounds))) - {r[0] for r in stats.select("own").distinct().collect()}:  # a row per range
        put_array(f"{folder}/pair-{k}", np.empty(0, "u8"))
        put_array(f"{folder}/seen-{k}", np.empty(0, "f4"))

    def merge_stats(pdf):
        import pandas as pd

        k = int(pdf["range"].iloc[0])
        followers, pred = np.zeros((sizes[k], 3), "u4"), np.zeros(sizes[k], np.int64)
        for kind, ids, values in zip(pdf["kind"], pdf["ids"], pdf["values"]):
            if kind == 3:
                followers[_unzip(ids, "u4")] += _unzip(values, "u4").reshape(-1, 3)
            else:
                pred[_unzip(ids, "u4")] += _unzip(values, "u4")
        count = map_array(f"{folder}/count-{k}", "i8")
        put_array(f"{folder}/pred-{k}", pred)
        put_array(f"{folder}/gamma-{k}", (sum(followers[:, i] * pair_d[i + 1] for i in range(3)) / np.maximum(count, 1)).astype("f4"))
        return pd.DataFrame({"n": [np.bincount(np.minimum(pred, 5), minlength=6)[1:6].tolist()], "sum": [int(pred.sum())]})

    last = cut(stats.drop("n", "own").groupBy("range").applyInPandas(tidy_group(merge_stats), "n array<long>, sum long"))
    *of, more, total = last.agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(5)], F.coalesce(F.sum("sum"), F.lit(0))).first()
    word_d = _discounts(*of)
    rest = (word_d[1] * of[0] + word_d[2] * of[1] + word_d[3] * (of[2] + of[3] + more)) / total if total else 1.0
    empty.pair_d, empty.word_d, empty.predecessors, empty.rest = pair_d, word_d, total, rest
    return empty


def score(docs: DataFrame, model: Model, text: Column, train: Column, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns in keep, n_tokens, n_known, train_tokens, base_score and score of each row of docs: the rows given to fit."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its arrays have a row per range, not per word
    names = [id_col, *(keep or [])]
    fields = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {fields[n]}" for n in names) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        import pyarrow as pa

        m = shared.value
        words, pairs = m.words(), m.pairs()
        for batch in batches:
            n = batch.num_rows
            n_tokens, n_known, base, own = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            train = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            for row, tokens, ends in token_runs(batch.column(len(names))):
                to, at = slice(row, row + len(ends) - 1), ends[:-1]
                log, count = m.log10(words, pairs, tokens, np.repeat(train[to], np.diff(ends)))
                n_tokens[to] = np.diff(ends)
                n_known[to] = np.add.reduceat(count > 0, at, dtype=np.int64)
                own[to] = np.add.reduceat(log, at)
                base[to] = np.add.reduceat(np.log10((count + 0.1) / (m.tokens + 0.1 * (m.distinct + 1))), at)
            arrays = [pa.array(x) for x in (n_tokens, n_known, np.full(n, m.tokens, np.int64), base, own)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + arrays, names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(*names, text.cast("binary").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train")).mapInArrow(tidy(run), schema)


def score_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", folds: int = 10) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose fold isn't 0. Null text is empty: its one token is the end. Without
    training rows every token is unknown. Repeated rows count as often as they occur.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_t"), (fold(F.col(id_col), folds) == 0).alias("held_out"))
    model = fit(rows, F.col("_t"), ~F.col("held_out"))
    out = cut(score(rows, model, F.col("_t"), ~F.col("held_out"), id_col, ["held_out"]), BATCH_BYTES)
    remove_dir(docs.sparkSession, model.folder)
    return out
