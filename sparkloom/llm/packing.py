"""Filling fixed-capacity containers: hierarchical multi-length packing planned on the histogram of lengths."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable, positions, ship
from .bpe import TOKENIZERS, VOCABULARY, token_counts

#: Context-size tiers: capacity, a half, a quarter, an eighth and all below. Containers of a step group.
TIERS, GROUP = 4, 8


def tier_of(size: int, capacity: int) -> int:
    """0 for items of more than half the capacity, 1 for more than a quarter, and so on to TIERS - 1."""
    tier = 0
    while tier < TIERS - 1 and size << (tier + 1) <= capacity:
        tier += 1
    return tier


Pattern = list[tuple[int, int]]  # sizes and how many copies of each, longest first


class _Stock:
    """Items left of each size: how many, and the sorted sizes that are left."""

    def __init__(self, counts: dict[int, int], low: int, high: int) -> None:
        self.left = np.zeros(high + 1, np.int64)
        for s, n in counts.items():
            if low < s <= high and n > 0:
                self.left[s] = n
        self.sizes = np.flatnonzero(self.left).tolist()

    def fill(self, gap: int) -> tuple[Pattern, int]:
        """What is taken for one window with room ``gap``: ever the longest that fits; where nothing would fit behind it, two that end flush."""
        used: dict[int, int] = {}
        k = len(self.sizes)
        while gap and (k := bisect_right(self.sizes, gap, hi=k)):
            s = self.sizes[k - 1]
            n = min(int(self.left[s]) - used.get(s, 0), gap // s)
            if n <= 0:
                k -= 1
                continue
            rest = gap - n * s
            if 0 < rest < self.sizes[0] and (pair := self._closing_pair(gap - (n - 1) * s, s, used)):
                used[s] = used.get(s, 0) + n - 1
                for p in pair:
                    used[p] = used.get(p, 0) + 1
                gap = 0
                break
            used[s] = used.get(s, 0) + n
            gap = rest
        return sorted(((s, n) for s, n in used.items() if n), reverse=True), gap

    def _closing_pair(self, gap: int, below: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two sizes left that add up to ``gap``, the longer as long as possible but not above ``below``."""
        top, half = min(below, gap - 1, len(self.left) - 1), -(-gap // 2)
        if top < half:
            return None
        both = (self.left[half : top + 1] > 0) & (self.left[gap - top : gap - half + 1][::-1] > 0)
        for a in (np.flatnonzero(both)[::-1] + half).tolist():
            b = gap - a
            if self.left[a] - used.get(a, 0) > (a == b) and self.left[b] - used.get(b, 0) > (a == b):
                return a, b
        return None

    def lasts(self, pattern: Pattern) -> int:
        """How many windows the stock can give the pattern to."""
        return min(int(self.left[s]) // n for s, n in pattern)

    def take(self, pattern: Pattern, times: int) -> None:
        for s, n in pattern:
            self.left[s] -= n * times
            if not self.left[s]:
                del self.sizes[bisect_right(self.sizes, s) - 1]


def pack_tier(stock: _Stock, capacity: int) -> list[tuple[Pattern, int, int]]:
    """Windows of one tier's own items: (pattern, how many windows, room left in each), longest items first."""
    windows = []
    while stock.sizes:
        pattern, gap = stock.fill(capacity)
        times = stock.lasts(pattern)
        stock.take(pattern, times)
        windows.append((pattern, times, gap))
    return windows


def fill_gaps(windows: list[tuple[Pattern, int, int]], shorter: _Stock) -> list[tuple[Pattern, int]]:
    """The windows with their gaps filled from the shorter tiers; a group of windows is split where a size runs out."""
    out: list[tuple[Pattern, int]] = []
    for pattern, times, gap in windows:
        while times:
            extra, _ = shorter.fill(gap) if gap else ([], 0)
            n = min(times, shorter.lasts(extra)) if extra else times
            if extra:
                shorter.take(extra, n)
            out.append((pattern + extra, n))
            times -= n
    return out


def plan_containers(counts: dict[int, int], capacity: int, tiers: int = TIERS) -> list[tuple[Pattern, int]]:
    """Container patterns [(size, copies), ...] with how many containers follow each, for ``counts`` items of each size.

    Sizes are routed to ``tiers``: above a half of the capacity, above a quarter, and so on, the last one taking all the rest.
    From the longest tier down, a tier packs what is left of its own items into windows, whose gaps are then filled from
    the shorter tiers, the longest that fit first. Patterns are repeated while their sizes last, so that their number
    goes with that of the sizes, however many items there are.
    """
    borders = [capacity, *(capacity >> t for t in range(1, tiers)), 0]
    plan: list[tuple[Pattern, int]] = []
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    for high, low in zip(borders, borders[1:], strict=False):
        windows = pack_tier(_Stock(left, low, high), capacity)
        shorter = _Stock(left, 0, low)
        plan += fill_gaps(windows, shorter)
        left = {s: int(shorter.left[s]) for s in shorter.sizes}
    return plan


class Layout:
    """Where the r-th item of each length goes: lookup arrays of each budget, sent to the workers (a few rows per pattern)."""

    def __init__(self, counts: dict[int, dict[int, int]], capacities: list[int]) -> None:
        self.containers, self.tables = np.zeros(len(capacities), np.int64), []
        for b, capacity in enumerate(capacities):
            of_size = np.zeros(capacity + 2, np.int64)
            for s, n in counts.get(b, {}).items():
                of_size[s + 1] = n if s else 0
            before = np.cumsum(of_size)  # items of lesser sizes: the r-th of size s is item before[s] + r of all
            plan = plan_containers(counts.get(b, {}), capacity)
            plan.sort(key=lambda p: -sum(n * s * s for s, n in p[0]))  # dearest attention first, for balanced step groups
            taken: dict[int, int] = {}
            rows = []
            for items, times in plan:
                offset = 0
                for s, n in items:
                    at = int(before[s]) + taken.get(s, 0)
                    rows.append((at, int(self.containers[b]), n, offset))
                    taken[s] = taken.get(s, 0) + n * times
                    offset += n * s
                self.containers[b] += times
            rows.sort()
            first, base, copies, offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], [])))
            self.tables.append((before, first, base, copies, offset))

    def place(self, budget: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(container, offset, step group) of items; those of size 0 are dealt out over all containers, at offset 0."""
        total = np.maximum(self.containers[budget], 1)
        container, offset = rank % total, np.zeros(len(rank), np.int64)
        for b, (before, first, base, copies, inside) in enumerate(self.tables):
            own = np.flatnonzero((budget == b) & (size > 0))
            nth = before[size[own]] + rank[own]
            row = np.searchsorted(first, nth, side="right") - 1
            nth -= first[row]
            container[own] = base[row] + nth // copies[row]
            offset[own] = inside[row] + nth % copies[row] * size[own]
        steps = -(-total // GROUP)
        lap, seat = container // steps, container % steps
        return container, offset, np.where(lap % 2 == 0, seat, steps - 1 - seat)


def packed(lengths: DataFrame, key: str, budgets: list[tuple[str, int]]) -> DataFrame:
    """(budget_name, container, step_group, key, piece, token_start, n_tokens, container_offset, tier) of every item and budget.

    ``lengths`` has the unique key and n_tokens of each item. An item longer than the capacity is cut into full pieces and
    a rest; no other is cut. The r-th item of each length finds its container by arithmetic from the plan. What the driver
    sees is the histogram of lengths, at most one row per length up to the capacity, whatever the number of items.
    Items of no tokens (or null n_tokens) take no room and are dealt out evenly; budgets without capacity are left out.
    """
    spark = lengths.sparkSession
    schema = f"budget_name string, container bigint, step_group bigint, `{key}` {lengths.schema[key].dataType.simpleString()}, piece int, token_start bigint, n_tokens int, container_offset bigint, tier int"
    budgets = sorted({(n, c) for n, c in budgets if n is not None and c is not None and c > 0})
    if not budgets:
        return spark.createDataFrame([], schema)
    ship(spark)
    known = durable(lengths.select(key, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.lit(c).cast("bigint").alias("cap")) for i, (_, c) in enumerate(budgets)]))
    per = known.select(key, "n", each.alias("x")).select(key, "n", "x.b", "x.cap")
    pieces = F.greatest(F.ceil(F.col("n") / F.col("cap")) - 1, F.lit(0)).cast("int")
    cut = per.select(key, "n", "b", "cap", F.explode(F.sequence(F.lit(0), pieces)).alias("piece"))
    items = cut.select(key, "b", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.least(F.col("cap"), F.col("n") - F.col("piece") * F.col("cap")).cast("int").alias("size"))
    ranked = positions(items, ["b", "size"], [F.col(key), F.col("piece")], "rank")
    counts: dict[int, dict[int, int]] = {}
    histogram = items.groupBy("b", "size").count().collect()
    if len(histogram) > sum(c + 1 for _, c in budgets):
        raise AssertionError("more lengths than the capacities allow")
    for b, s, n in histogram:
        counts.setdefault(b, {})[s] = n
    layout = Layout(counts, [c for _, c in budgets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([n for n, _ in budgets], object)
        lowest = [np.array([tier_of(s, c) for s in range(c + 1)]) for _, c in budgets]
        for x in batches:
            k, b, piece, start, size, rank = (x.column(i) for i in range(6))
            bi, si = b.to_numpy().astype(np.int64), size.to_numpy().astype(np.int64)
            container, offset, step = layout.place(bi, si, rank.to_numpy().astype(np.int64))
            tier = np.array([lowest[i][s] for i, s in zip(bi, si, strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[bi], pa.string()), pa.array(container), pa.array(step), k, piece, start, size, pa.array(offset), pa.array(tier)],
                names=["budget_name", "container", "step_group", key, "piece", "token_start", "n_tokens", "container_offset", "tier"],
            )

    return ranked.select(key, "b", "piece", "start", "size", "rank").mapInArrow(run, schema)


def packed_documents(documents: DataFrame, token_budgets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Every text of ``documents`` assigned to containers of each capacity, measured in the budget's tokenizer."""
    known = token_budgets.select("budget_name", "capacity", F.coalesce("tokenizer", F.lit(VOCABULARY)).alias("tokenizer")).distinct().collect()  # one row per budget
    out = None
    for vocabulary in sorted({r.tokenizer for r in known} or {VOCABULARY}):
        lengths = token_counts(documents, "doc_id", "text", folder, vocabulary)
        part = packed(lengths, "doc_id", [(r.budget_name, r.capacity) for r in known if r.tokenizer == vocabulary])
        out = part if out is None else out.unionByName(part)
    return out
