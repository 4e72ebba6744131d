"""Near-duplicates by MinHash bands, odd sketches and exact checks on full shingle sets.

Texts with equal sets form a class, named by a 128-bit digest of the set; from there on work
is by class. BANDS bands of ROWS MinHash values give candidates: at similarity 0.85 a pair
shares none with a probability of 4e-7, at 0.8 with 5e-5. The samples are also folded into an odd sketch: BITS
parity bits whose XOR has as many ones as the sketches' sets differ, which estimates high
similarities closely; candidates far below the threshold go. The rest is decided by the sets.

A band's group isn't expanded into pairs, and of bands with the same classes only one is a group.
First each class is compared with one centre of its group. Where a group then still spans several
components, small groups are compared pair by pair across components; large ones are compared
with further centres, and what that leaves, pairs of blocks of a component's outside with
everything, by their sketches and then by products of membership matrices, of which only the
edges that connect something leave. So groups of copies cost a few pairs or edges a member, and
no link is lost.

Scale: texts are never shuffled. Full sets are made again, in a second pass, only for classes
that share a band (found by a bitmap of fixed size); centres come from aggregates that combine
before the shuffle, and joins on groups can be split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, cut, document_words, few_files, mix, release, shuffle_partitions, tidy

SHINGLE = 5
BANDS, ROWS = 25, 5
BITS = 512
#: Candidates whose sketches estimate less than the threshold by this aren't checked: over six standard deviations from 0.8 on.
ESTIMATE_ROOM = 0.25
#: Groups up to this size are compared pair by pair. Larger ones are compared with so many further centres, and what they leave in blocks of so many sets or shingles.
PAIRED, PEELS, BLOCK, BLOCK_SHINGLES = 16, 1, 500, 400_000
#: So many edges are joined up in one task, some 100 KB.
FEW = 1000
#: Bits of the map of candidates.
MAP_BITS = 1 << 23

_rng = np.random.Generator(np.random.PCG64(85))
_XOR = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n words in a row; of fewer words, one hash of them all."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        h += words[j : j + len(h)] * _STEP[j]
    return np.unique(mix(h + np.uint64(width)))


def signature(s: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    out = np.full(len(_XOR), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        np.minimum(out, ((s[a : a + 2048, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    rows = mix(values).reshape(BANDS, ROWS)
    return mix((rows * _MUL[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bits of the samples, as 64-bit integers."""
    at = mix(values + np.arange(len(values), dtype=np.uint64) * _STEP[0]) % np.uint64(BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def largest_distance(estimate: float, samples: int = BANDS * ROWS, bits: int = BITS) -> int:
    """The sketches' XOR has at most so many ones where it estimates that similarity or more."""
    return int(bits / 2 * (1 - np.exp(-4 * samples * (1 - estimate) / bits)))


def digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _describe(docs: DataFrame, text: Column, id_col: str) -> DataFrame:
    """id, node (the class's name, null without words), n, bands, sketch; the last two once for each class in a task."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        met: set[bytes] = set()
        for batch in batches:
            nodes, sizes, keys, sketches = [], [], [], []
            for _, words, at in document_words(batch.column(1)):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    s = shingles(words[a:b])
                    name = digest(s) if len(s) else None
                    nodes.append(name)
                    sizes.append(len(s))
                    if name is None or name in met:
                        keys.append(None)
                        sketches.append(None)
                        continue
                    if len(met) < 1_000_000:
                        met.add(name)
                    values = signature(s)
                    keys.append(bands(values))
                    sketches.append(odd_sketch(values))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs)], names=["id", "node", "n", "bands", "sketch"]
            )

    return docs.select(F.col(id_col), text.cast("binary")).mapInArrow(tidy(run), f"id {kind}, node binary, n long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, text: Column, id_col: str, asked: DataFrame) -> DataFrame:
    """node and set (64-bit hashes as bytes) of the classes in asked (node, id): only documents whose id is on the map are read."""
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    words = asked.select(F.floor(place / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))  # at most MAP_BITS / 64 rows
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"))
    rows = rows.join(F.broadcast(cut(words, files=few_files(docs.sparkSession))), F.floor(place / 64) == F.col("word"))
    rows = rows.where(F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))) != 0).select("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, sets = [], []
            for _, words, at in document_words(batch.column(0)):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    s = shingles(words[a:b])
                    if len(s):
                        nodes.append(digest(s))
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "set"])

    found = rows.mapInArrow(tidy(run), "node binary, set binary").join(asked.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.first("set").alias("set"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their sets."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                    common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                    keep[i] = 100 * common >= percent * (len(s) + len(t) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(tidy(run), "a binary, b binary")


def _forest(left: DataFrame) -> DataFrame:
    """node and comp of at most FEW edges, in one task."""

    def run(batches):
        import pyarrow as pa

        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = sorted((top(a), top(b)))
                up[high] = low
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([top(x) for x in list(up)], pa.binary())], names=["node", "comp"])

    return cut(left.coalesce(1).mapInArrow(run, "node binary, comp binary"))


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of every node that the edges (a, b), which are read several times, touch.

    Each round points every node at the smallest of itself and its neighbours and contracts the
    edges along these pointers, until at most FEW are left, which one task finishes; then the
    pointers are followed, last round first. A round's nodes are its local minima at most twice
    over, so with names that are digests the rounds are few. A hub's neighbours are combined
    before they are shuffled, and pointers and edges meet in joins that adaptive execution can split.
    """
    files = few_files(edges.sparkSession)
    left, rounds, own = edges.select("a", "b").where("a <> b"), [], []
    while left.count() > FEW:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")), files=files)
        rounds.append(pointer)
        to = lambda k: pointer.select(F.col("node").alias(k), F.col("comp").alias(f"_{k}"))
        moved = left.join(to("a"), "a").join(to("b"), "b").where("_a <> _b")
        left = cut(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), files=files)
        release(*own)
        own = [left]
    rounds.append(_forest(left))
    release(*own)
    while len(rounds) > 1:
        last = rounds.pop()
        to = last.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        here = rounds.pop()
        rounds.append(cut(here.join(to, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), files=files))
        release(here, last)
    return rounds[0]


def _ones(a: str, b: str) -> Column:
    """Ones of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _block_links(sets: list[np.ndarray], sketches: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what links across components, at most one less than there are sets.

    Odd sketches tell which sets have any candidate; only their memberships are multiplied.
    """
    bits = np.unpackbits(sketches.view(np.uint8).reshape(len(sets), -1), axis=1).astype(np.float32)
    ones = bits.sum(1)
    apart = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
    maybe = (apart <= largest_distance(percent / 100 - ESTIMATE_ROOM)) & (comp[:, None] != comp[None, :])
    who = np.flatnonzero(maybe.any(1))
    if len(who) < 2:
        return []
    sets, comp, maybe = [sets[i] for i in who], comp[who], maybe[np.ix_(who, who)]
    n = np.array([len(x) for x in sets], dtype=np.int64)
    every = np.concatenate(sets)
    known, counts = np.unique(every, return_counts=True)
    shared = known[counts > 1]  # others are in no intersection
    owner = np.repeat(np.arange(len(sets)), n)
    at = np.minimum(np.searchsorted(shared, every), max(len(shared) - 1, 0))
    hit = np.flatnonzero(shared[at] == every) if len(shared) else np.empty(0, np.int64)
    owner, at = owner[hit], at[hit]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24 are exact
    for low in range(0, len(shared), 4096):
        a, b = np.searchsorted(at, [low, low + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    i, j = np.nonzero(maybe & (100 * common >= percent * (n[:, None] + n[None, :] - common)))
    label = np.arange(len(sets))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(who[k]), int(who[label[k]])) for k in np.flatnonzero(label != np.arange(len(label))).tolist()]


def _link_blocks(groups: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what links across the components of each group (bk, node, comp).

    A group's largest component needs no comparison within itself, so its members only meet the
    rest. Both sides are split into chunks of BLOCK sets, or BLOCK_SHINGLES shingles, and compared
    by pairs of chunks; what leaves such a pair is at most one edge for each member.
    """
    files = few_files(groups.sparkSession)
    sized = cut(groups.join(nodes.select("node", "n", "sketch"), "node"), files=files)
    of_comp = sized.groupBy("bk", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    parts = of_comp.groupBy("bk").agg(F.max(F.struct("k", "n", "comp")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    chunks = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    parts = cut(parts.select("bk", F.col("main.comp").alias("main"), chunks(F.col("main.k"), F.col("main.n")).alias("mains"), chunks(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")).alias("rests")), files=files)
    dealt = sized.join(parts, "bk").withColumn("in_main", F.col("comp") == F.col("main"))
    # chunks of the rest are numbered from 0, those of the largest component from there on
    place = F.xxhash64("node")
    dealt = dealt.withColumn("chunk", F.when(F.col("in_main"), F.col("rests") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("rests"))).cast("int"))
    last = F.when(F.col("in_main"), F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1
    dealt = dealt.select("bk", "node", "comp", "sketch", "chunk", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("bk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node", "comp", "sketch", "chunk").join(sets, "node")
    ordered = dealt.repartition(shuffle_partitions(groups.sparkSession), "bk", "lo", "hi").sortWithinPartitions("bk", "lo", "hi", "node")

    def run(batches):
        import pyarrow as pa

        def edges(members):
            if len(members) < 2:
                return []
            names, comps, sketches, sets = zip(*members)
            _, comp = np.unique(np.array(comps, dtype=object), return_inverse=True)
            return [(names[i], names[j]) for i, j in _block_links(list(sets), np.array(sketches), comp, percent)]

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

        key, members = None, []
        for batch in batches:
            found = []
            for bk, lo, hi, node, comp, sketch, held in zip(*(batch.column(i) for i in range(7))):
                k = (bk.as_py(), lo.as_py(), hi.as_py())
                if k != key:
                    found += edges(members)
                    key, members = k, []
                members.append((node.as_py(), comp.as_py(), np.array(sketch.as_py()), np.frombuffer(held.as_buffer(), np.uint64).copy()))
            yield out(found)
        yield out(edges(members))

    out = cut(ordered.select("bk", "lo", "hi", "node", "comp", "sketch", "set").mapInArrow(tidy(run), "a binary, b binary"), files=files)
    release(sized, parts)
    return out


def band_groups(nodes: DataFrame) -> DataFrame:
    """bk, m, centre of the bands that several classes share; of bands with the same classes only one.

    A group's classes are known by their number and the XOR of their names, which are digests.
    """
    member = nodes.select(F.explode("bands").alias("bk"), "node")
    half = lambda at: F.conv(F.hex(F.substring("node", at, 8)), 16, -10).cast("long")
    groups = member.groupBy("bk").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("centre"), F.bit_xor(half(1)).alias("x"), F.bit_xor(half(9)).alias("y")).where("m > 1")
    return groups.groupBy("m", "centre", "x", "y").agg(F.min("bk").alias("bk")).select("bk", "m", "centre")


def link_classes(nodes: DataFrame, sets_of, percent: int = 85) -> DataFrame:
    """node, comp of the classes that link with another; nodes: node, n, bands, sketch and id, one row each, cut."""
    files = few_files(nodes.sparkSession)
    groups = cut(band_groups(nodes), files=files)
    member = cut(nodes.select(F.explode("bands").alias("bk"), "node").join(groups, "bk"), files=files)
    sketches = cut(nodes.select("node", "n", "sketch", "id").join(member.select("node").distinct(), "node", "left_semi"), files=files)
    sets = cut(sets_of(sketches.select("node", "id")), BATCH_BYTES)
    close = F.lit(largest_distance(percent / 100 - ESTIMATE_ROOM))

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda k: sketches.select(F.col("node").alias(k), F.col("sketch").alias(f"sketch_{k}"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(_ones("sketch_a", "sketch_b") <= close).select("a", "b")
        return cut(_verify(near, sets, percent), files=files)

    def merged(comps: DataFrame, new: DataFrame) -> DataFrame:
        """Components with further edges, which are released."""
        if new.isEmpty():
            release(new)
            return comps
        out = components(comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(new))
        release(comps, new)
        return out

    def open_groups(member: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
        """bk, m, node, comp, centre and its comp, of the groups that span several components."""
        placed = member.select("bk", "m", "node").join(comps, "node", "left").select("bk", "m", "node", F.coalesce("comp", "node").alias("comp"))
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp"))
        spans = placed.groupBy("bk").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), first.alias("c"))
        spans = cut(spans.where("low <> high").select("bk", F.col("c.node").alias("centre"), F.col("c.comp").alias("own")), files=files)
        out = cut(placed.join(spans, "bk"), files=files)
        release(spans)
        return out

    edges = check(member.where(F.col("centre") != F.col("node")).select(F.col("node").alias("a"), F.col("centre").alias("b")))
    comps = components(edges)
    release(edges)
    rest = member.where("m > 2")
    for turn in range(PEELS + 1):
        spread = open_groups(rest, comps, turn)
        rest = spread.where(F.col("m") > PAIRED)
        if turn == PEELS:
            new = _link_blocks(rest.select("bk", "node", "comp"), sketches, sets, percent)
        else:
            pairs = rest.where(F.col("comp") != F.col("own")).select(F.col("node").alias("a"), F.col("centre").alias("b"))
            if turn == 0:  # small groups, across components
                a, b = (spread.where(F.col("m") <= PAIRED).select("bk", F.col("node").alias(k), F.col("comp").alias(f"comp_{k}")) for k in "ab")
                pairs = pairs.unionByName(a.join(b, "bk").where("comp_a < comp_b").select("a", "b"))
            new = check(pairs)
        release(member)
        member = spread
        comps = merged(comps, new)
        if rest.isEmpty():
            break
    release(groups, member, sketches, sets)
    return comps


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 85) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked;
    component_id is the smallest id reachable by links. A text without words, null or empty, has
    no shingles and is its own component. Of repeated rows with one id all are kept or none.
    Null ids are the largest: a component has a null id only if all its ids are null.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    described = cut(_describe(docs, whole, id_col), BATCH_BYTES)
    of_class = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "bands", "sketch")]
    nodes = cut(described.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), *of_class))
    comps = link_classes(nodes, lambda asked: _sets(docs, whole, id_col, asked), percent)
    files = few_files(docs.sparkSession)
    linked = cut(nodes.select("node", "id").join(comps, "node"), files=files)
    lowest = cut(linked.groupBy("comp").agg(F.min("id").alias("component_id")), files=files)
    named = nodes.select("node", "id").join(linked.select("node", "comp").join(lowest, "comp").select("node", "component_id"), "node", "left")
    named = cut(named.select("node", F.coalesce("component_id", "id").alias("component_id")), files=files)
    release(nodes, comps, linked, lowest)
    out = described.select("id", "node", "n").join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
