"""Row versions: intervals [created, deleted) of commit sequences, reads at a moment, reclaiming."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import EngineError

MAX_SNAPSHOTS = 4096


def visible(s: int | Column, created: str = "_created_seq", deleted: str = "_deleted_seq") -> Column:
    """Whether a version is seen at commit sequence s; the read predicate of every table."""
    s = F.lit(s) if isinstance(s, int) else s
    return (F.col(created) <= s) & (F.col(deleted).isNull() | (s < F.col(deleted)))


def close_intervals(changes: DataFrame, key: str | list[str], seq: str, is_delete: Column) -> DataFrame:
    """Versions from changes (key, seq, a delete or a whole row): each lasts until the key's next change."""
    keys = [key] if isinstance(key, str) else key
    following = F.lead(seq).over(Window.partitionBy(*keys).orderBy(seq))
    closed = changes.withColumn("_created_seq", F.col(seq)).withColumn("_deleted_seq", following)
    return closed.where(~is_delete)


def read_at(versions: DataFrame, s: int) -> DataFrame:
    return versions.where(visible(s))


def point_read(versions: DataFrame, key: str, value, s: int) -> DataFrame:
    """The one version of a key seen at s, or no row; the key test reaches the scan."""
    return versions.where((F.col(key) == F.lit(value)) & visible(s))


def newest_retained(versions: DataFrame, key: str, s: int) -> DataFrame:
    """Of each key's replaced versions that s sees, the newest; combined before the shuffle."""
    kept = versions.where(F.col("_deleted_seq").isNotNull() & visible(s))
    return kept.groupBy(key).agg(F.max_by(F.struct(*kept.columns), "_created_seq").alias("r")).select("r.*")


def reclaim(versions: DataFrame, oldest: int) -> DataFrame:
    """What remains when versions that ended before the oldest snapshot are freed."""
    return versions.where(F.col("_deleted_seq").isNull() | (F.col("_deleted_seq") >= oldest))


def retention_stats(versions: DataFrame, oldest: int) -> DataFrame:
    """One row: live, retained (replaced, kept), unreclaimable (still needed) and reclaimed versions."""
    done = F.col("_deleted_seq").isNotNull()
    return versions.agg(
        F.count_if(~done).alias("live"),
        F.count_if(done).alias("retained"),
        F.count_if(done & (F.col("_deleted_seq") >= oldest)).alias("unreclaimable"),
        F.count_if(done & (F.col("_deleted_seq") < oldest)).alias("reclaimed"),
    )


class SnapshotRegistry:
    """The moments that readers still use."""

    def __init__(self, capacity: int = MAX_SNAPSHOTS):
        self.capacity, self.active = capacity, Counter()

    def register(self, s: int) -> int:
        if self.active.total() >= self.capacity:
            raise EngineError("SnapshotLimitExceeded")
        self.active[s] += 1
        return s

    def unregister(self, s: int) -> None:
        if not self.active[s]:
            raise EngineError("UnknownSnapshot", str(s))
        self.active[s] -= 1
        if not self.active[s]:
            del self.active[s]

    def oldest(self, published: int) -> int:
        """The horizon for reclaiming: the oldest active moment, or the next one to come."""
        return min(self.active, default=published + 1)
