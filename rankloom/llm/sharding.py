"""Minimax contiguous partition of ordered atomic groups, in native expressions only.

Rows are ordered by a 60-bit hash of their text, so equal texts are neighbours and one atomic group that is never
split. The smallest feasible shard capacity is found by binary search; each candidate is checked greedily: fill a
shard while the next group fits, then begin the next one. The groups themselves are never gathered. The search runs
on sums over ranges of hashes; a range in which some cut could fall is split 64-fold by one aggregation, until every
cut that the search looks at lies between two single groups. So the result is exact and the driver holds a few
thousand sums, whatever the number of groups.

Under the smallest capacity the cuts are then set one by one as near as possible to an equal share of what is left,
as long as the rest stays feasible (else the shard is filled up), so one oversized group doesn't empty the others.

The law that holds is `bytes`: no contiguous partition of the ordered groups has a smaller largest shard.

Defined cases: a null text has no bytes and is grouped with empty texts (checksum 0); repeated rows are rows of
their own; a null doc_id is kept; with fewer groups than shards the last shards are empty; an empty table gives no
rows. Columns named shard are replaced; others are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import BROADCAST_ROWS, literal_table, materialize

SHARDS = 16
KEY_BITS = 60
FIRST_BITS = 12
SPLIT_BITS = 6
SLOT_ROWS = 32_768


def group_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - KEY_BITS)


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0)) + 1


@dataclass
class Range:
    """Groups whose key >> shift is prefix."""

    prefix: int
    shift: int
    total: int
    groups: int
    largest: int

    @property
    def first_key(self) -> int:
        return self.prefix << self.shift


class Profile:
    """Sums over contiguous ranges of the ordered groups (k, size), split where a search needs it."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups
        self.ranges = self._sums(groups, KEY_BITS - FIRST_BITS)
        self.looked_at: set[int] = set()
        self._index()

    def _sums(self, groups: DataFrame, shift: int) -> list[Range]:
        rows = groups.groupBy(F.shiftright("k", shift).alias("prefix")).agg(F.sum("size"), F.count("*"), F.max("size"))
        return [Range(p, shift, total, n, largest) for p, total, n, largest in rows.collect()]

    def _index(self) -> None:
        self.ranges.sort(key=lambda r: r.first_key)
        self.sums = [0]
        for r in self.ranges:
            self.sums.append(self.sums[-1] + r.total)

    @property
    def total(self) -> int:
        return self.sums[-1]

    @property
    def largest(self) -> int:
        return max((r.largest for r in self.ranges), default=0)

    def reach(self, start: int, limit: int) -> int:
        """The farthest boundary at which the sum since boundary start is at most limit."""
        end = bisect_right(self.sums, self.sums[start] + limit) - 1
        if end < len(self.ranges) and self.ranges[end].groups > 1:
            self.looked_at.add(end)
        return max(end, start)

    def refine(self) -> bool:
        """Split every range that was looked at; False if there was none, so that all answers were exact."""
        if not self.looked_at:
            return False
        split = [self.ranges[i] for i in sorted(self.looked_at)]
        keep = [r for i, r in enumerate(self.ranges) if i not in self.looked_at]
        for shift in sorted({r.shift for r in split}, reverse=True):
            prefixes = [(r.prefix,) for r in split if r.shift == shift]
            for i in range(0, len(prefixes), BROADCAST_ROWS):
                wanted = literal_table(self.groups.sparkSession, prefixes[i : i + BROADCAST_ROWS], {"wanted": "bigint"})
                part = self.groups.join(F.broadcast(wanted), F.shiftright("k", shift) == F.col("wanted"), "left_semi")
                keep += self._sums(part, max(0, shift - SPLIT_BITS))
        self.ranges, self.looked_at = keep, set()
        self._index()
        return True


def _greedy(profile: Profile, start: int, shards: int, capacity: int) -> bool:
    for _ in range(shards):
        start = profile.reach(start, capacity)
    return start == len(profile.ranges)


def _search(profile: Profile, shards: int) -> tuple[int, list[int]]:
    low = max(-(-profile.total // shards), profile.largest)
    high = low + profile.largest
    while low < high:
        middle = (low + high) // 2
        if _greedy(profile, 0, shards, middle):
            high = middle
        else:
            low = middle + 1
    cuts, start, end = [], 0, len(profile.ranges)
    for left in range(shards, 1, -1):
        share = -(-(profile.total - profile.sums[start]) // left)
        under = profile.reach(start, share)
        over = min(under + 1, end)
        near = sorted({under, over} - {start}, key=lambda b: (abs(profile.sums[b] - profile.sums[start] - share), b))
        full = profile.reach(start, low)
        start = next((b for b in near if profile.sums[b] - profile.sums[start] <= low and _greedy(profile, b, left - 1, low)), full)
        cuts.append(start)
    return low, [profile.ranges[c].first_key if c < end else 1 << KEY_BITS for c in cuts]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """For groups(k, size), one row per group: the smallest capacity, and the first key of each later shard."""
    profile = Profile(groups)
    while True:
        capacity, cuts = _search(profile, shards)
        if not profile.refine():
            return capacity, cuts


def shard_of(key: Column, cuts: list[int]) -> Column:
    return sum(((key >= F.lit(c)).cast("int") for c in cuts), F.lit(0))


def text_groups(docs: DataFrame) -> DataFrame:
    return docs.groupBy(group_key(F.col("text")).alias("k")).agg(F.sum(row_size(F.col("text"))).alias("size"))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard: a function of each row alone, once the cuts are known."""
    _, cuts = minimax_cuts(materialize(text_groups(docs), "groups"), shards)
    return docs.withColumn("shard", shard_of(group_key(F.col("text")), cuts))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where each row lies.

    Slots number each shard's rows by cells of (shard, hash of place), so that no task numbers a whole shard, nor a
    third of all rows if they are alike."""
    text = F.coalesce("text", F.lit(""))
    narrow = assign_shards(docs.select("doc_id", "text"), shards).select("doc_id", row_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", F.monotonically_increasing_id().alias("place"))
    narrow = materialize(narrow, "shards")
    cells = max(4, -(-narrow.count() // SLOT_ROWS))
    narrow = narrow.withColumn("cell", F.pmod(F.xxhash64("place"), F.lit(cells)).cast("int"))
    before = W.Window.partitionBy("shard").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = narrow.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.Window.partitionBy("shard", "cell").orderBy("place")) - 1
    return narrow.withColumn("inside", inside).join(offsets, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
