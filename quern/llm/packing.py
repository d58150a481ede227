"""Filling fixed-capacity windows by exact-complement hashing.

Items are spread by hash over shards of about ``SHARD_ITEMS`` items, packed
independently.  Within a shard the available sizes are counted.  A window takes
the largest item that fits; then the gap is looked up among the single sizes, the
sums of two and the sums of three available sizes, kept as bit sets, and a
combination that fills it exactly is consumed.  While there is none, the next
largest item goes in.  What is left when nothing fits exactly is packed by best
fit, largest first.

Only an item larger than the capacity is split: into full windows and a rest,
which is packed like any other item.  Items of size 0 have no place.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import materialise

CAPACITY, SHARD_ITEMS = 2048, 20_000


class Sizes:
    """Counts of available sizes with bit sets for complement look-ups."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = dict(counts), capacity
        self.bits = self.mirror = 0
        for size in counts:
            self._set(size)

    def _set(self, size: int) -> None:
        self.bits |= 1 << size
        self.mirror |= 1 << (self.capacity - size)

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            del self.counts[size]
            self.bits &= ~(1 << size)
            self.mirror &= ~(1 << (self.capacity - size))

    def largest(self, at_most: int) -> int:
        """The largest available size up to ``at_most``, or 0."""
        return (self.bits & ((1 << (at_most + 1)) - 1)).bit_length() - 1 if self.bits & ((1 << (at_most + 1)) - 1) else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available sizes with this sum, as unequal as possible."""
        # Bit a is set where both a and total - a are available.
        both = self.bits & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1) & ~1
        while both:
            a = both.bit_length() - 1
            if 2 * a != total or self.counts[a] >= 2:
                return a, total - a
            both &= ~(1 << a)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available sizes that fill the gap exactly."""
        if self.bits >> gap & 1:
            return (gap,)
        if found := self.pair(gap):
            return found
        first = self.largest(gap - 2)
        while first * 3 >= gap:
            self.counts[first] -= 1
            rest = self.pair(gap - first)
            # The pair must not need more of a size than is left.
            ok = rest and all(self.counts.get(x, 0) >= rest.count(x) for x in rest)
            self.counts[first] += 1
            if ok:
                return (first, *rest)
            first = self.largest(first - 1)
        return None


def pack_sizes(counts: dict[int, int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of sizes; every counted size is used exactly as often as counted."""
    sizes, windows, loose = Sizes(counts, capacity), [], []
    while first := sizes.largest(capacity):
        window, gap = [first], capacity - first
        sizes.take(first)
        while gap:
            found = sizes.complement(gap)
            if found:
                for x in found:
                    sizes.take(x)
                window += found
                gap = 0
            else:
                extra = sizes.largest(gap)
                if not extra:
                    break
                sizes.take(extra)
                window.append(extra)
                gap -= extra
        (loose if gap else windows).append(window)
    # Best fit, largest first, over what could not be closed exactly.
    spare = defaultdict(list)
    for size in sorted((x for w in loose for x in w), reverse=True):
        at = next((g for g in range(size, capacity + 1) if spare.get(g)), None)
        window = spare[at].pop() if at else []
        gap = (at or capacity) - size
        window.append(size)
        (spare[gap] if gap else windows).append(window)
    return windows + [w for group in spare.values() for w in group]


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``window_id, id, piece_no, first_token, n_tokens``: the place of every item or piece.

    ``items`` has one row per id.  Windows are numbered ``shard * 2^32 + n``.
    """
    sized = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).filter("size > 0")
    # Sizes are costly where they are counted from texts, and used twice.
    sized = materialise(sized, "packing-sizes")
    n = sized.count()
    shards = max(1, round(n / shard_items))
    whole = F.floor((F.col("size") - 1) / capacity)
    pieces = sized.select("id", "size", F.posexplode(F.sequence(F.lit(0), whole)).alias("piece_no", "_")).select(
        "id", "piece_no", (F.col("piece_no") * capacity).cast("long").alias("first_token"),
        F.least(F.lit(capacity), F.col("size") - F.col("piece_no") * capacity).cast("long").alias("n_tokens"))
    kind = dict(items.dtypes)[id_col]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece_no"]).reset_index(drop=True)
        waiting = defaultdict(list)
        for row, size in enumerate(pdf["n_tokens"]):
            waiting[int(size)].append(row)
        place = [0] * len(pdf)
        for number, window in enumerate(pack_sizes({k: len(v) for k, v in waiting.items()}, capacity)):
            for size in window:
                place[waiting[size].pop()] = (int(key[0]) << 32) + number
        pdf["window_id"] = place
        return pdf[["window_id", "id", "piece_no", "first_token", "n_tokens"]]

    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece_no"), F.lit(shards)))
    return spread.groupBy("shard").applyInPandas(run, f"window_id long, id {kind}, piece_no int, first_token long, n_tokens long")
