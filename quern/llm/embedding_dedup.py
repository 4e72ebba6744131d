"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are all combinations of one codeword from each of BLOCKS random codebooks, one
codebook for each block of a randomly rotated vector; there are TABLES independent codes. A
vector's filters are all directions whose inner product with it exceeds a threshold; it is set so
that LIST directions of a code exceed it on average, and never lets a vector have fewer than
LEAST. As a direction's product is a sum over blocks, the list is decoded from half sums, without
looking at most directions. Vectors that share a filter are compared in double precision, each
pair in the first filter that it shares. At a cosine of exactly 0.9 a pair shares none in about
one of ten cases for one code, so in about one of 10,000 for all.

Equal vectors form a class first, so copies are never expanded into pairs. The number of
directions follows the number of classes, so a filter holds few vectors that aren't near.

Scale: rows are dealt out by filter; a filter with more than CHUNK classes is split into pairs of
chunks, so that no task holds a large group. What leaves a group are link counts by class and
enough edges to connect what it links, not its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .near_dedup import components

BLOCKS, TABLES = 4, 4
LIST, LEAST = 40, 32
CHUNK = 1500
#: Directions per class, and the bounds of a codebook's size.
SPREAD, SMALLEST, LARGEST = 330, 16, 128


def valid(embedding: str):
    """Not null, without null or non-finite components, and not zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


class Caps:
    """Filter directions of one code for vectors of one dimension."""

    def __init__(self, dim: int, words: int, table: int = 0, seed: int = 20240607):
        rng = np.random.default_rng([seed, dim, words, table])
        self.dim, self.words = dim, words
        self.first = (dim * TABLES + table) * words**BLOCKS  # its filters are numbered from here
        self.wide = -(-dim // BLOCKS) * BLOCKS
        self.turn, _ = np.linalg.qr(rng.standard_normal((self.wide, self.wide)))
        self.books = rng.standard_normal((BLOCKS, words, self.wide // BLOCKS))
        self.books /= np.linalg.norm(self.books, axis=2, keepdims=True)
        self.threshold = self._threshold(rng)
        n = np.arange(1, LEAST + 1)
        self.i, self.j = (np.concatenate(x) for x in zip(*[(np.full(LEAST // a, a - 1), np.arange(LEAST // a)) for a in n]))

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products over the first and the second half of the blocks, for each pair of codewords."""
        x = np.zeros((len(unit), self.wide))
        x[:, : self.dim] = unit
        x = (x @ self.turn).reshape(len(unit), BLOCKS, -1)
        p = np.einsum("nbd,bkd->nbk", x, self.books)
        return ((p[:, b, :, None] + p[:, b + 1, None, :]).reshape(len(unit), -1) for b in (0, 2))

    def _threshold(self, rng) -> float:
        """LIST directions exceed it on average over random unit vectors."""
        x = rng.standard_normal((64, self.dim))
        a, b = self.halves(x / np.linalg.norm(x, axis=1, keepdims=True))
        low, high = 0.0, float(BLOCKS)
        b = np.sort(b, axis=1)
        for _ in range(40):
            mid = (low + high) / 2
            n = sum(len(r) * len(s) - np.searchsorted(s, mid - r).sum() for r, s in zip(a, b)) / len(x)
            low, high = (mid, high) if n > LIST else (low, mid)
        return high

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Each vector's filters, sorted."""
        a, b = self.halves(unit)
        need_a, need_b = self.threshold - b.max(axis=1), self.threshold - a.max(axis=1)
        out = []
        for x, y, low_a, low_b in zip(a, b, need_a, need_b):
            r, s = np.flatnonzero(x >= low_a), np.flatnonzero(y >= low_b)
            s = s[np.argsort(-y[s], kind="stable")]
            n = np.searchsorted(-y[s], x[r] - self.threshold, side="right")
            if n.sum() >= LEAST:
                i = np.repeat(r, n)
                j = s[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
            else:  # the best ones lie among these places of the sorted halves
                r, s = (np.argpartition(-v, min(LEAST, len(v) - 1))[:LEAST] for v in (x, y))
                r, s = r[np.argsort(-x[r], kind="stable")], s[np.argsort(-y[s], kind="stable")]
                i, j = r[self.i % len(r)], s[self.j % len(s)]
                best = np.argsort(-(x[i] + y[j]), kind="stable")[:LEAST]
                i, j = i[best], j[best]
            out.append(np.unique(i.astype(np.int64) * len(y) + j) + np.int64(self.first))
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _filters(classes: DataFrame, words: int) -> DataFrame:
    """node, fid of each class, exploded by the caller: fids array."""

    def run(batches):
        import pyarrow as pa

        caps: dict[int, list[Caps]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                vectors = part.column(1).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                fids: list = [None] * len(vectors)
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    if dim not in caps:
                        caps[dim] = [Caps(dim, words, t) for t in range(TABLES)]
                    unit = _unit(np.array([vectors[i] for i in own], dtype=np.float64))
                    for i, *f in zip(own, *(c.decode(unit) for c in caps[dim])):
                        fids[i] = np.concatenate(f)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fids, pa.list_(pa.int64()))], names=["node", "fids"])

    return classes.select("node", "vec").mapInArrow(run, "node binary, fids array<long>")


def _first_shared(earlier: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of members of a group, given each one's smaller filters: whether the group's is the smallest that both have."""
    known = np.unique(np.concatenate(earlier))
    if not len(known):
        return np.ones(len(i), bool)
    has = np.zeros((len(earlier), len(known)), np.float32)
    for row, f in enumerate(earlier):
        has[row, np.searchsorted(known, f)] = 1
    if len(i) > 4 * len(earlier):
        return (has @ has.T)[i, j] == 0
    return np.einsum("pk,pk->p", has[i], has[j]) == 0


def _links(members: list, split: bool, least: float):
    """Links within a group, or between its two sides: (degrees by member, edges that connect what is linked)."""
    x = np.array([m[1] for m in members])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    if split:
        side = np.array([m[4] for m in members])
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near))
    if not len(i):
        return None
    own = _first_shared([m[3] for m in members], i, j)
    weight = np.array([m[2] for m in members], dtype=np.int64)
    degree = np.zeros(len(members), np.int64)
    np.add.at(degree, i[own], weight[j[own]])
    np.add.at(degree, j[own], weight[i[own]])
    label = np.arange(len(members))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return degree, label
        label = new


def _batch_units(column) -> np.ndarray | list[np.ndarray]:
    """Unit vectors of a list column: one array if all have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = column.offsets.to_numpy()
    at = at - at[0] if len(at) else at
    sizes = np.diff(at)
    if len(sizes) and (sizes == sizes[0]).all():
        return _unit(values.reshape(len(sizes), -1))
    return [_unit(values[a:b][None])[0] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _promising(units, starts: np.ndarray, ends: np.ndarray, least: float, most: int = 8) -> np.ndarray:
    """Which groups need a closer look: those with a near pair, and those of more than `most` members."""
    sizes = ends - starts
    if not isinstance(units, np.ndarray):
        return np.ones(len(starts), bool)
    out = sizes > most
    for n in range(2, most + 1):
        own = np.flatnonzero(sizes == n)
        for i in range(n):
            for j in range(i):
                out[own] |= np.einsum("nd,nd->n", units[starts[own] + i], units[starts[own] + j]) >= least - 1e-9
    return out


def _link_groups(rows: DataFrame, least: float) -> DataFrame:
    """a, b, degree: link counts have b null, edges have degree 0. rows: fid, lo, hi, node, vec, w, fids (the node's shared filters smaller than fid, within its dimension), chunk."""
    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), "fid", "lo", "hi").sortWithinPartitions("fid", "lo", "hi", "node")

    def run(batches):
        import pyarrow as pa

        out: list[list] = [[], [], []]

        def finish(key, members):
            if len(members) > 1 and (found := _links(members, key[1] != key[2], least)) is not None:
                degree, label = found
                for k in np.flatnonzero(degree).tolist():
                    out[0].append(members[k][0])
                    out[1].append(None)
                    out[2].append(int(degree[k]))
                for k in np.flatnonzero(label != np.arange(len(label))).tolist():
                    out[0].append(members[k][0])
                    out[1].append(members[label[k]][0])
                    out[2].append(0)

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "degree"])
            for c in out:
                c.clear()
            return batch

        key, members = None, []
        for batch in batches:
            table = [batch.column(i) for i in range(8)]
            where = np.stack([table[i].to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            units = _batch_units(table[4])
            starts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1)]))
            ends = np.append(starts[1:], len(where))
            promising = _promising(units, starts, ends, least)
            if len(starts):
                promising[0] = promising[-1] = True  # they may go on in other batches
            for a, b in zip(starts[promising].tolist(), ends[promising].tolist()):
                k = tuple(where[a].tolist())
                if k != key:
                    finish(key, members)
                    key, members = k, []
                for r in range(a, b):
                    members.append((table[3][r].as_py(), units[r], table[5][r].as_py(), table[6][r].values.to_numpy(), table[7][r].as_py()))
            if len(out[0]) > 10_000:
                yield emit()
        finish(key, members)
        yield emit()

    return ordered.select("fid", "lo", "hi", "node", "vec", "w", "fids", "chunk").mapInArrow(run, "a binary, b binary, degree long")


def embedding_dedup(vectors: DataFrame, embedding: str = "embedding", id_col: str = "vec_id", least: float = 0.9) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows linked directly), component_id, kept.

    Rows whose cosine, in double precision, is at least `least` are linked; other rows with the
    same vector are linked too. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, and vectors of different lengths don't link with each other.
    component_id is the smallest id reachable by links; rows with a repeated id are rows apart.
    """
    name = F.when(valid(embedding), F.unhex(F.md5(F.to_json(F.struct(F.col(embedding).alias("v"))).cast("binary"))))
    rows = cut(vectors.select(F.col(id_col).alias("id"), name.alias("node"), F.when(name.isNotNull(), F.col(embedding)).alias("vec")))
    classes = cut(rows.where("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("w"), F.min("id").alias("id")))
    n = classes.count()
    words = int(min(max(np.ceil((SPREAD * max(n, 1)) ** (1 / BLOCKS)), SMALLEST), LARGEST))
    listed = cut(_filters(classes, words))
    single = listed.select("node", F.explode("fids").alias("fid"))
    shared = single.groupBy("fid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("fid", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))
    lists = single.join(cut(shared), "fid").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("fid", "chunks"))).alias("own"))  # one vector's filters
    member = cut(lists.join(classes.select("node", "vec", "w"), "node"))
    # a membership carries the smaller filters only, numbered within the dimension: TABLES * LARGEST ** BLOCKS numbers fit 31 bits
    base = F.size("vec").cast("long") * F.lit(TABLES * words**BLOCKS)
    within = F.transform("own.fid", lambda f: (f - base).cast("int"))
    dealt = member.select("node", "vec", "w", within.alias("fids"), F.posexplode("own").alias("pos", "f"))
    dealt = dealt.select("node", "vec", "w", F.slice("fids", F.lit(1), F.col("pos")).alias("fids"), "f.fid", "f.chunks")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("fid", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node", "vec", "w", "fids", "chunk")
    found = cut(_link_groups(dealt, least))
    degrees = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("degree"))
    edges = found.where("b is not null").select("a", "b").distinct()
    comps = components(cut(edges))
    named = classes.select("node", "w", "id").join(comps, "node", "left").join(cut(degrees), "node", "left")
    named = cut(named.select("node", "id", F.coalesce("comp", "node").alias("comp"), (F.col("w") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")))
    lowest = cut(named.groupBy("comp").agg(F.min("id").alias("component_id")))
    named = cut(named.join(lowest, "comp").select("node", "n_links", "component_id"))
    component = F.coalesce("component_id", "id")
    return rows.select("id", "node").join(named, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
