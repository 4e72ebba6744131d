"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Pieces are packed by bands of length, from the longest down: (1024, 2048], (682, 1024], (512, 682]
and so on. The longest band opens a sequence for each piece. In every other band, rounds of four
steps follow until its pieces are placed:

1. gaps that can hold a piece of the band are offered as slots as long as the band's longest piece
   (the last one takes what is left over), so that a wide gap takes several pieces in one round;
2. pieces and slots are sorted together by size, dealt out by ranges;
3. a sweep downwards chooses the pieces that find a slot, the longest first; a sweep upwards finds
   each one's successor, the smallest slot that holds it. Of several with one successor the first
   by rank gets it and the others go on to the next slots, so the j-th chosen piece, of successor
   s_j, gets slot j + max(s_i - i for i <= j). Counts and that maximum are carried over ranges;
4. the gaps shrink, and pieces without a slot stay for the next round.

Where the gaps left take fewer than an eighth of a band's remaining pieces, as few sequences are
opened as these could fill.

A band whose pieces and gaps are no more than one range, RANGE_ROWS, goes through the same rounds
in one task.

Scale: texts are read once and not shuffled; a round shuffles sizes and numbers of one band's
pieces and of the gaps that it can use. A slot holds a piece of about half its size or more, so each
round at least halves what a gap still offers to its band: the rounds are a few for each of some
16 bands, whatever the number of documents. The driver sees a row per band or range.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batch_bytes, cut, release, shuffle_partitions, tidy

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Rows of a range that is swept in one task, about.
RANGE_ROWS = 250_000
#: Bytes of text that a task encodes at a time; a longer text alone.
RUN_BYTES = 4 << 20

#: The steps before the model for which splitting at white space and at a word's last comma or full stop is proven neutral (tests/llm/test_token_ids.py).
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


_LETTER, _SPACE, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _plain_words(texts):
    """texts with fewer different words and the same ids, where the steps are the known ones.

    ASCII symbols between an ASCII letter and white space or the text's end are a word of their
    own to the tokenizer, so a space may go before them. A-Z are lower-cased as the tokenizer
    will, but not before a byte beyond ASCII, which may be a mark that composes with only one of
    the cases. A run with a `<|` stays as it is, as special strings are looked for in it.
    """
    import pyarrow as pa

    raw, at = batch_bytes(texts)
    if not len(raw) or ((raw[:-1] == 60) & (raw[1:] == 124)).any():
        return texts.fill_null("")
    first = at[:-1][at[1:] > at[:-1]]  # where texts start
    after = np.append(raw[1:], np.uint8(32))
    after[first[1:] - 1] = 32
    symbol = _SYMBOL[raw]
    starts = symbol.copy()
    starts[1:] &= ~symbol[:-1]
    starts[first] = symbol[first]
    stops = symbol & ~_SYMBOL[after]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops)
    own = ~np.isin(starts, first)
    cuts = starts[own & _LETTER[raw[starts - 1]] & _SPACE[after[stops]]]
    raw = raw + ((raw >= 65) & (raw <= 90) & (after < 128)).astype(np.uint8) * np.uint8(32)
    raw, at = np.insert(raw, cuts, np.uint8(32)), at + np.searchsorted(cuts, at)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])


class TextIds:
    """Ids of texts, as the tokenizer gives them.

    Where its steps are the known ones, it drops white space, nothing spans white space, and a run
    of letters is a word of its own. Then texts are split at ASCII white space, and a batch's
    distinct strings are encoded once: runs of ASCII letters by the model, others by the whole
    tokenizer, many at a time. Strings met before come from a cache of bounded size. Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str, room: int = 200_000, at_once: int = 20_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.at_once = Tokenizer.from_file(path), room, at_once
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = all(steps[k] == v for k, v in KNOWN_STEPS.items())
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}  # what was known before; strings met again come back from it

    def encode(self, strings: list[str]) -> None:
        """Learn strings without ASCII white space."""
        known, tokenize, others = self.known, self.tokenizer.model.tokenize, []
        for s in strings:
            if s.isascii() and s.isalpha():
                known[s] = array("I", [t.id for t in tokenize(s.lower())]).tobytes()
            else:
                others.append(s)
        for i in range(0, len(others), self.at_once):
            part = others[i : i + self.at_once]
            starts = np.zeros(len(part), np.int64)
            np.cumsum([len(s) + 1 for s in part[:-1]], out=starts[1:])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            at = np.array([a for a, _ in found.offsets], dtype=np.int64)
            cuts = np.searchsorted(at, np.append(starts, np.iinfo(np.int64).max))
            known.update((s, ids[a:b].tobytes()) for s, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist()))

    def of_strings(self, strings: list[str]) -> list[bytes]:
        known, old = self.known, self.old
        if len(known) > self.room:
            self.old, self.known = known, {"": b""}
            known, old = self.known, self.old
        new = []
        for s in strings:
            if s not in known:
                if (ids := old.get(s)) is not None:
                    known[s] = ids
                else:
                    new.append(s)
        self.encode(new)
        return [known[s] for s in strings]

    def of_texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts in a row, and len + 1 offsets into them; null is empty."""
        import pyarrow.compute as pc

        if not self.by_words:
            found = [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
            return np.concatenate([*found, np.empty(0, "<u4")]), np.cumsum([0, *map(len, found)])
        lists = pc.ascii_split_whitespace(_plain_words(texts))
        coded = lists.flatten().dictionary_encode()
        own = self.of_strings(coded.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in own], dtype=np.int64)
        every, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        n = sizes[word]
        ends = np.cumsum(n)
        ids = every[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[word] - (ends - n), n)]
        at = lists.offsets.to_numpy()
        return ids, np.concatenate([[0], ends])[at - at[0]]


_texts: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """This worker's; it outlives a task."""
    if path not in _texts:
        _texts[path] = TextIds(path)
    return _texts[path]


def tokenizer_path(path: str | None) -> str:
    """path, or the public vocabulary's place on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokenize_pieces(docs: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, pid (a number of its own), ids if asked.

    A document's ids are the tokenizer's and then end_id; only documents of more than `capacity`
    ids are cut. Null text counts as empty and gives one piece that holds end_id.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, pid long" + ", ids array<int>" * keep_ids

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        next_pid = TaskContext.get().partitionId() << 40
        of = text_ids(tokenizer_path(path))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            ends, row = np.cumsum(sizes), 0
            while row < batch.num_rows:
                to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + RUN_BYTES, side="right")))
                ids, at = of.of_texts(batch.column(1).slice(row, to - row))
                n = np.diff(at)
                ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                raw = memoryview(ids.astype("<u4").tobytes())
                pieces = (n + capacity) // capacity  # n + 1 ids each
                owner = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[owner] + 1 - start, capacity)
                first = at[owner] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist())]
                pid = next_pid + np.arange(len(owner))
                next_pid += len(owner)
                arrays = [batch.column(0).take(pa.array(row + owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(pid, pa.int64())]
                if keep_ids:
                    arrays.append(pa.array([ids[a : a + k].astype("<i4") for a, k in zip(first.tolist(), length.tolist())], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", "pid", "ids"][: len(arrays)])
                row = to

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(tidy(run), schema)


def _parts(rows: int, spark) -> int:
    return max(1, min(shuffle_partitions(spark), -(-rows // RANGE_ROWS)))


def _slots(gaps: DataFrame, longest: int, least: int) -> DataFrame:
    """seq, slot and size of the places that gaps of `least` or more offer to pieces of up to `longest`."""
    n = F.greatest(F.floor(F.col("gap") / longest), F.lit(1)).cast("int")
    each = gaps.where(F.col("gap") >= least).select("seq", "gap", n.alias("n"), F.posexplode(F.array_repeat(F.lit(0), n)).alias("slot", "_"))
    return each.select("seq", "slot", F.when(F.col("slot") < F.col("n") - 1, F.lit(longest)).otherwise(F.col("gap") - longest * (F.col("n") - 1)).cast("long").alias("size"))


_FAR = 1 << 62


def _sweep(kind: np.ndarray, below: tuple[int, int, int], above: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int], tuple[int, int]]:
    """One range's rows in ascending order (kind 0 a piece, 1 a slot), with what is carried in from below and from above it.

    From above come the slots without a piece yet and, of the range's own, those that remain: going
    down, a piece is chosen where a slot is left, so that the longest pieces go first. Going up, a
    chosen piece gets the slot of its successor or the next one that is free. Gives which pieces
    are chosen, the numbers of slots and of chosen pieces' slots, and what is carried on.
    """
    free = above[0]
    step = np.where(kind == 1, 1, -1)[::-1]
    run = free + np.cumsum(step)
    low = np.minimum(np.minimum.accumulate(run), 0)
    # a piece that takes the free slots below any earlier low finds none
    before = np.concatenate([[0], low[:-1]])
    chosen = ((step == -1) & (run >= before))[::-1]
    free = int(run[-1] - low[-1]) if len(run) else free
    slots, pieces, most = below
    s, j = slots + np.cumsum(kind) - kind, pieces + np.cumsum(chosen) - chosen
    top = np.maximum.accumulate(np.concatenate([[most], np.where(chosen, s - j, -_FAR)]))
    at = np.where(kind == 1, s, j + top[1:])
    return chosen, at, (slots + int(kind.sum()), pieces + int(chosen.sum()), int(top[-1])), (free,)


def match(pieces: DataFrame, slots: DataFrame, parts: int) -> DataFrame:
    """pid, length, seq, slot of the pieces (pid, length) that get one of the slots (seq, slot, size), by successor sweeps over ranges of the size."""
    no = F.lit(None).cast("long")
    every = pieces.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("pid").alias("id"), no.alias("slot")).unionByName(
        slots.select("size", F.lit(1).alias("kind"), F.col("seq").alias("id"), F.col("slot").cast("long").alias("slot"))
    )
    order = ["size", "kind", "id", "slot"]
    ranges = cut(every.repartitionByRange(parts, *order).sortWithinPartitions(*order))

    def whole(batches):
        """A range's rows, some RANGE_ROWS."""
        import pyarrow as pa
        from pyspark import TaskContext

        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        return TaskContext.get().partitionId(), table, table.column("kind").to_numpy().astype(np.int64) if held else np.empty(0, np.int64)

    def ask(sums, names: str) -> list:
        return sorted(ranges.mapInArrow(sums, ", ".join(f"{n} long" for n in names.split())).collect())  # a row per range

    def row(*values):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names=[f"c{i}" for i in range(len(values))])

    def free(batches):
        """How many slots a range leaves over for the pieces below it, by how many it is given: max(given + change, lowest)."""
        part, _, kind = whole(batches)
        run = np.cumsum(np.where(kind == 1, 1, -1)[::-1])
        yield row(part, int(run[-1]) if len(run) else 0, int((run[-1] - np.minimum.accumulate(run)[-1])) if len(run) else 0)

    above, given = {}, 0
    for part, change, lowest in reversed(ask(free, "c0 c1 c2")):
        above[part] = (given,)
        given = max(given + change, lowest)

    def sums(batches):
        part, _, kind = whole(batches)
        _, _, (s, j, most), _ = _sweep(kind, (0, 0, -_FAR), above[part])
        yield row(part, s, j, most)

    below, state = {}, (0, 0, -_FAR)
    for part, s, j, most in ask(sums, "c0 c1 c2 c3"):
        below[part] = state
        state = (state[0] + s, state[1] + j, max(state[2], most + state[0] - state[1] if most > -_FAR else -_FAR))

    def places(batches):
        import pyarrow as pa

        part, table, kind = whole(batches)
        chosen, at, _, _ = _sweep(kind, below[part], above[part])
        if table is not None:
            yield from table.append_column("at", pa.array(at, pa.int64())).filter(pa.array((kind == 1) | chosen)).to_batches()

    placed = ranges.mapInArrow(places, "size long, kind int, id long, slot long, at long")
    own = placed.where("kind = 0").select("at", F.col("id").alias("pid"), F.col("size").alias("length"))
    out = cut(own.join(placed.where("kind = 1").select("at", F.col("id").alias("seq"), "slot"), "at").drop("at"))
    release(ranges)
    return out


def bands_of(capacity: int) -> list[int]:
    """The longest lengths of the bands, falling: capacity, its halves, and between them what fits three times."""
    halves = [capacity]
    while halves[-1] > 1:
        halves.append(halves[-1] // 2)
    thirds = [h // 3 for h in halves if h // 3 >= 64]
    return sorted({*halves, *thirds}, reverse=True)


def _band_alone(pid: np.ndarray, length: np.ndarray, seq: np.ndarray, gap: np.ndarray, longest: int, least: int, capacity: int, opened: int):
    """A band's rounds where all its rows are one range: pid, seq, offset of its pieces; seq, gap left; sequences opened."""
    placed, stuck = [], False
    while len(pid):
        usable = np.flatnonzero(gap >= least)
        if stuck or not len(usable):
            new = -(-int(length.sum()) // capacity)
            seq, gap = np.concatenate([seq, -(opened + 1 + np.arange(new))]), np.concatenate([gap, np.full(new, capacity)])
            opened, stuck = opened + new, False
            continue
        n = np.maximum(gap[usable] // longest, 1)
        of = np.repeat(usable, n)
        slot = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        size = np.where(slot < np.repeat(n, n) - 1, longest, gap[of] - longest * (np.repeat(n, n) - 1))
        kind = np.concatenate([np.zeros(len(pid), np.int64), np.ones(len(of), np.int64)])
        number = np.concatenate([pid, seq[of]])
        order = np.lexsort((np.concatenate([np.zeros(len(pid), np.int64), slot]), number, kind, np.concatenate([length, size])))
        chosen, at, _, _ = _sweep(kind[order], (0, 0, -_FAR), (0,))
        own, to = order[chosen], order[kind[order] == 1][at[chosen]] - len(pid)
        line = np.lexsort((slot[to], of[to]))
        own, to = own[line], of[to[line]]
        run = np.cumsum(length[own])
        first = np.searchsorted(to, to)
        before = run - length[own] - (run - length[own])[first]
        placed.append((pid[own], seq[to], capacity - gap[to] + before))
        gap = gap - np.bincount(to, weights=length[own], minlength=len(gap)).astype(np.int64)
        stuck = len(own) < len(pid) / 8
        left = np.ones(len(pid), bool)
        left[own] = False
        pid, length = pid[left], length[left]
    keep = gap > 0
    return [np.concatenate(x) for x in zip(*placed)] if placed else [np.empty(0, np.int64)] * 3, seq[keep], gap[keep], opened


def _one_range(rest: DataFrame, gaps: DataFrame, longest: int, least: int, capacity: int, opened: int) -> DataFrame:
    """kind, a, b, c: pid, seq, offset (kind 0); seq, gap (kind 1); sequences opened (kind 2)."""
    rows = rest.select(F.lit(0).alias("kind"), "pid", "length").unionByName(gaps.select(F.lit(1).alias("kind"), F.col("seq").alias("pid"), F.col("gap").alias("length")))

    def run(batches):
        import pyarrow as pa

        columns = list(zip(*[[c.to_numpy().astype(np.int64) for c in batch.columns] for batch in batches]))
        kind, number, size = (np.concatenate(c) for c in columns) if columns else [np.empty(0, np.int64)] * 3
        own = kind == 0
        (pid, to, offset), seq, gap, new = _band_alone(number[own], size[own], number[~own], size[~own], longest, least, capacity, opened)
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(pid), len(seq), 1])
        a, b = np.concatenate([pid, seq, [new]]), np.concatenate([to, gap, [0]])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kinds, a, b, np.concatenate([offset, np.zeros(len(seq) + 1, np.int64)]))], names=["kind", "a", "b", "c"])

    return cut(rows.coalesce(1).mapInArrow(run, "kind int, a long, b long, c long"))


def place_best_fit(pieces: DataFrame, capacity: int) -> list[DataFrame]:
    """Frames (pid, seq, offset) that together place every piece (pid, length) in a sequence."""
    spark = pieces.sparkSession
    bands = bands_of(capacity)  # a band is known by its longest length
    band = F.lit(bands[-1])
    for longest, shorter in reversed(list(zip(bands, bands[1:]))):
        band = F.when(F.col("length") > shorter, F.lit(longest)).otherwise(band)
    pieces = cut(pieces.select("pid", F.col("length").cast("long").alias("length"), band.alias("band")))
    held = {r["band"]: (r["n"], r["total"]) for r in pieces.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).collect()}
    first = pieces.where(F.col("band") == capacity)
    placed = [first.select("pid", F.col("pid").alias("seq"), F.lit(0).cast("long").alias("offset"))]
    gaps, opened = cut(first.where(F.col("length") < capacity).select(F.col("pid").alias("seq"), (F.lit(capacity) - F.col("length")).alias("gap"))), 0
    open_ = gaps.count()
    for longest, shorter in zip(bands[1:], [*bands[2:], 0]):
        n, total = held.get(longest, (0, 0))
        if not n:
            continue
        rest = pieces.where(F.col("band") == longest).select("pid", "length")
        if n + open_ <= RANGE_ROWS:
            out = _one_range(rest, gaps, longest, shorter + 1, capacity, opened)
            placed.append(out.where("kind = 0").select(F.col("a").alias("pid"), F.col("b").alias("seq"), F.col("c").alias("offset")))
            gaps = out.where("kind = 1").select(F.col("a").alias("seq"), F.col("b").alias("gap"))
            opened, open_ = out.agg(F.max(F.when(F.col("kind") == 2, F.col("a"))), F.count_if(F.col("kind") == 1)).first()
            continue
        stuck = False
        while n:
            slots = _slots(gaps, longest, shorter + 1)
            k = slots.count()
            if stuck or not k:  # as few as could hold what is left
                new = -(-total // capacity)
                fresh = spark.range(opened + 1, opened + new + 1).select((-F.col("id")).alias("seq"), F.lit(capacity).cast("long").alias("gap"))
                gaps, opened = cut(gaps.unionByName(fresh)), opened + new
                stuck = False
                continue
            found = match(rest, slots, _parts(n + k, spark))
            taken = found.groupBy("seq").agg(F.sum("length").alias("taken"))
            before = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one sequence's pieces
            offset = F.lit(capacity) - F.col("gap") + F.coalesce(F.sum("length").over(before), F.lit(0))
            placed.append(cut(found.join(gaps, "seq").select("pid", "seq", offset.alias("offset"))))
            left = gaps.join(taken, "seq", "left").select("seq", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"))
            gaps = cut(left.where("gap > 0"))
            done = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            stuck = done[0] < n / 8  # what gaps are left hold few of these pieces
            n, total = n - done[0], total - done[1]
            if n:
                rest = cut(rest.join(found.select("pid"), "pid", "left_anti"))
            release(found)
        open_ = gaps.count()
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, as tokenize_pieces gives them, with sequence_id and offset; materialises them first."""
    pieces = cut(pieces, BATCH_BYTES)
    placed = place_best_fit(pieces.select("pid", "length"), capacity)
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    kept = [c for c in pieces.columns if c != "pid"]
    return pieces.join(every, "pid").select(*kept, F.col("seq").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each row of docs: id_col, piece, start, length, ids_crc32, sequence_id, offset, ids if asked.

    Sequences are filled from offset 0 without gaps. Null text counts as empty, repeated rows are
    packed as often as they occur, and an empty table gives no rows.
    """
    return pack(tokenize_pieces(docs, text, id_col, capacity, path, keep_ids=keep_ids), capacity).withColumnRenamed("id", id_col)
