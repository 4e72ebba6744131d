"""What the operators share: tables, lineage cuts, shared files, and fast token hashes."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine (a local master) it may be unset; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's setting under which a query's shuffle files go as soon as it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's bound on what it sends to a Python worker at a time, beside its 10,000 rows.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A value for texts.
BATCH_BYTES = 4 << 20


def cut(df: DataFrame, batch_bytes: int | None = None, files: int | None = None) -> DataFrame:
    """The same rows without lineage, kept in the shared folder until `release` or the end of the session.

    batch_bytes: about as much goes to a Python worker at a time, and at least a row. files: at
    most so many files, each made by one task; for small results, see `few_files`.

    The shuffles that made them are of no more use then, and their files go at once. The
    optimizer's estimate of the size goes too: a loop of joins would multiply it into numbers of
    millions of digits. Adaptive execution sees the real sizes.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    wanted = {_SHUFFLE_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        kept = (df.coalesce(files) if files else df).select("*").checkpoint(eager=True)._jdf
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    plain = DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
    plain._quern_file = kept.queryExecution().logical().rdd().getCheckpointFile()
    return plain


def few_files(spark: SparkSession) -> int:
    """For results that are small beside the text: still two tasks a core, and an eighth of the shuffle's.

    Without Hadoop's native library an executor starts a process to set the permissions of each
    file and of its checksums. Until that process runs its own program it shares the executor's
    memory, and what adds up processes' memory counts all of it twice.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-shuffle_partitions(spark) // 8))


def release(*frames: DataFrame) -> None:
    """Remove the files of frames that `cut` made and that nothing uses any more, lazily evaluated results included."""
    for frame in frames:
        at = frame._quern_file
        if at.isDefined():
            remove_dir(frame.sparkSession, at.get())


def free_name(docs: DataFrame, base: str) -> str:
    """A column name that docs doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while base in taken:
        base = "_" + base
    return base


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells its rows apart and is the same in every scan.

    Rows of Parquet files are known by their file, as 128 bits of hash, and their place in it, so
    it doesn't matter how a scan is split, or split anew after an executor is lost. Other frames
    are written once with their rows' numbers.
    """
    if "_metadata" not in docs.columns:
        path = F.col("_metadata.file_path")
        try:
            return docs.withColumn(name, F.struct(F.xxhash64(path).alias("a"), F.xxhash64(path, F.lit(1)).alias("b"), F.col("_metadata.row_index").alias("n")))
        except AnalysisException:  # not read from Parquet files
            pass
    return cut(docs.withColumn(name, F.monotonically_increasing_id()))


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lowest(h: Column, rows: int, wanted: int) -> Column:
    """Whether a 64-bit hash is among the lowest, so that some four times `wanted` of `rows` are: a top-n of these sends little to the driver."""
    if rows <= 4 * wanted:
        return F.lit(True)
    return h <= F.lit(-(1 << 63) + (4 * wanted << 64) // rows)


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- what workers hold

#: Larger blocks are the system's own and go back to it when freed; so much may stay free at the heap's end.
OWN_BLOCK, FREE_END = 4 << 20, 16 << 20
_lean = False


def _libc():
    """The C library's calls about freed memory, or None where it has others."""
    try:
        libc = ctypes.CDLL(None)
        return libc if libc.mallopt and libc.malloc_trim else None
    except (OSError, AttributeError):
        return None


def lean() -> None:
    """From now on this process's large arrays go back to the system when freed."""
    global _lean
    if not _lean and (libc := _libc()):
        libc.mallopt(-3, OWN_BLOCK)  # M_MMAP_THRESHOLD, which else follows the blocks freed up to 32 MB
        libc.mallopt(-1, FREE_END)  # M_TRIM_THRESHOLD
    _lean = True


def give_back() -> None:
    """Freed memory that the allocators keep goes back to the system."""
    if libc := _libc():
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        libc.malloc_trim(0)


def tidy(run):
    """run, a generator over batches, in a worker that keeps no freed memory.

    Workers wait for other tasks after theirs, and what they hold adds to the executor's memory
    in stages that have nothing to do with them.
    """

    def tidied(batches):
        lean()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(merge):
    """The same for a function of a group's rows."""

    def tidied(pdf):
        lean()
        try:
            return merge(pdf)
        finally:
            give_back()

    return tidied


# --- files of numpy arrays in the shared folder, written and read by workers


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _plain(uri: str) -> str:
    """file:/x and file:///x are the same place, but only the latter is a URI for pyarrow."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        return "file://" + uri[5:]
    return uri


def put_array(uri: str, array: np.ndarray) -> None:
    """Write an array's bytes; a retried or speculative task writes the same file again, whole."""
    system, path = _filesystem(_plain(uri))
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data if array.size else b"")
    system.move(part, path)


def map_array(uri: str, dtype) -> np.ndarray:
    """Memory-map an array from the shared folder; where that isn't mounted, a copy that goes when it is let go."""
    uri = _plain(uri)
    if uri.startswith("file://"):
        path = uri[len("file://") :]
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    system, path = _filesystem(uri)
    with system.open_input_stream(path) as f, tempfile.NamedTemporaryFile() as own:
        shutil.copyfileobj(f, own, 1 << 20)
        own.flush()
        return np.memmap(own.name, dtype=dtype, mode="r") if own.tell() else np.empty(0, dtype)


# --- token hashes over whole Arrow batches

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_WINDOW = 1 << 16  # what it takes stays in a core's cache
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, _WINDOW + 1), np.uint64(base), dtype=np.uint64)
        out[0] = 1
        known = _powers[base] = np.multiply.accumulate(out)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (SplitMix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_window(raw: np.ndarray, space: np.ndarray, prefix: int) -> tuple[np.ndarray, ...]:
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = space[raw]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw))[: len(raw)], out=total[1:])
    back = _power(_INVERSE, len(raw))[start]
    out = (mix((total[end] - total[start]) * back + (end - start).astype(np.uint64)), start)
    if prefix:
        stop = np.minimum(end, start + prefix)
        out += (mix((total[stop] - total[start]) * back + (stop - start).astype(np.uint64)),)
    return out


def hash_words(raw: np.ndarray, space: np.ndarray = _SPACE, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of UTF-8 bytes with A-Z lower-cased, and where they start.

    space: which bytes stand between words. With prefix, also the hashes of the words' first
    bytes. Works through windows cut at spaces, so that memory is bounded for any length.
    """
    found, at = [], 0
    while at < len(raw):
        to = min(at + _WINDOW, len(raw))
        while to < len(raw) and not space[raw[to]]:  # to the end of the word
            more = np.flatnonzero(space[raw[to : to + _WINDOW]])
            to = to + int(more[0]) if len(more) else min(to + _WINDOW, len(raw))
        own = _hash_window(raw[at:to], space, prefix)
        found.append((own[0], own[1] + at, *own[2:]))
        at = to
    if not found:
        return tuple(np.empty(0, d) for d in ("u8", "i8", "u8")[: 2 + bool(prefix)])
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string Arrow column and len + 1 offsets into them; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def document_words(column, limit: int = 1 << 22, space: np.ndarray = _SPACE, prefix: int = 0):
    """For runs of rows of about `limit` bytes: first row, word hashes, len + 1 offsets of the rows' words, prefix hashes if asked."""
    raw, at = batch_bytes(column)
    row = 0
    while row < len(at) - 1:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        piece = raw[at[row] : at[to]]
        bounds = at[row : to + 1] - at[row]
        joints = bounds[1:-1]
        joints = joints[(joints > 0) & (joints < len(piece))]
        joints = joints[~space[piece[joints]] & ~space[piece[joints - 1]]]
        if len(joints):  # no space stands between two rows: set one there
            joints = np.unique(joints)
            piece = np.insert(piece, joints, 32)
            bounds = bounds + np.searchsorted(joints, bounds, side="left")
        hashes, starts, *more = hash_words(piece, space, prefix)
        yield row, hashes, np.searchsorted(starts, bounds, side="left"), *more
        row = to
