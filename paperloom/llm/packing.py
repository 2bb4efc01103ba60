"""Filling containers of fixed capacity: best fit first, then a search that empties bins by moves and exchanges.

Items are dealt at random to groups of bounded size and each group is packed by one task. A group's search takes the
emptiest bin and moves its items away or exchanges them (one for one, two for one, one for two) with fuller bins that
have room, always so that the sum of squared fills grows, until the bin is empty or nothing helps; it ends at once
when the room left in the group is less than one container, for then no bin can be saved. The emptiest bin of every
group is then taken apart and packed in the next round with those of the other groups, until one group is left.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.tokens import count_tokens
from paperloom.staging import stage

#: Items, and containers' worth of items, that one task packs: enough to mix well, few enough to search all pairs of bins.
GROUP, GROUP_BINS = 20_000, 1_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes``: the largest item first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    mask = 0  # bit g is set if a bin has exactly g left
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = mask >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = room[gap].pop()
            if not room[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = gap - size
        if left:
            room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def _best_exchange(a: list[int], b: list[int], sizes: list[int], fill_a: int, fill_b: int, room: int):
    """The move from a to b that fits b's room and most increases the squared fills: (gain, out of a, out of b)."""
    best = (0, (), ())
    options = sorted(
        [(sizes[i], (i,)) for i in a] + [(sizes[i] + sizes[j], (i, j)) for i, j in combinations(a, 2)]
    )
    amounts = [x for x, _ in options]
    back = [(0, ())] + [(sizes[i], (i,)) for i in b] + [(sizes[i] + sizes[j], (i, j)) for i, j in combinations(b, 2)]
    for given, outs in back:
        at = bisect_right(amounts, given + room) - 1
        while at >= 0 and amounts[at] > given:
            if len(outs) < 2 or len(options[at][1]) < 2:
                shift = amounts[at] - given
                gain = 2 * shift * (fill_b - fill_a + shift)
                if gain > best[0]:
                    best = (gain, options[at][1], outs)
                break
            at -= 1
    return best


def empty_bins(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins after the search; never more of them, and none over its capacity."""
    fills = [sum(sizes[i] for i in b) for b in bins]
    total = sum(fills)  # moves and exchanges keep it
    alive = set(range(len(bins)))
    again = True
    while again:  # an exchange may make room for what was passed by; the squares grow with each, so this ends
        again = False
        for a in sorted(alive, key=lambda b: fills[b]):
            if capacity * len(alive) - total < capacity:
                break
            improved = True
            while bins[a] and improved:
                improved = False
                # the fullest bins first: what they take gains the most
                for b in sorted((x for x in alive if x != a and fills[x] < capacity and fills[x] >= fills[a]), key=lambda x: -fills[x]):
                    gain, outs, backs = _best_exchange(bins[a], bins[b], sizes, fills[a], fills[b], capacity - fills[b])
                    if gain:
                        bins[a] = [i for i in bins[a] if i not in outs] + list(backs)
                        bins[b] = [i for i in bins[b] if i not in backs] + list(outs)
                        shift = sum(sizes[i] for i in outs) - sum(sizes[i] for i in backs)
                        fills[a] -= shift
                        fills[b] += shift
                        improved = again = True
                        if not bins[a]:
                            break
            if not bins[a]:
                alive.discard(a)
    return [bins[b] for b in range(len(bins)) if bins[b]]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes``, each of at most ``capacity``; every size lies between 1 and the capacity."""
    return empty_bins(best_fit(sizes, capacity), sizes, capacity)


def _packer(level: int, last: bool, capacity: int, id_col: str) -> Callable:
    """What packs one group; unless it is the last, its emptiest bin's items are marked to be packed again."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row_id", "piece_no"], ignore_index=True)
        bins = pack(pdf["size"].tolist(), capacity)
        sizes = pdf["size"].to_numpy()
        emptiest = None if last else min(range(len(bins)), key=lambda b: sizes[bins[b]].sum())
        where, again = [""] * len(pdf), [False] * len(pdf)
        for b, own in enumerate(bins):
            for i in own:
                where[i] = f"{level}-{key[0]}-{b}"
                again[i] = b == emptiest
        return pdf.assign(container_id=where, again=again)[["container_id", id_col, "row_id", "piece_no", "start_at", "size", "again"]]

    return run


def fill_containers(items: DataFrame, id_col: str, size_col: str, capacity: int, group: int = GROUP) -> DataFrame:
    """(container_id string, id, piece_no int, start_at bigint, size bigint): a place for every item.

    An item over the capacity is cut into whole containers and a rest, its pieces numbered from 0; no other item is
    cut. Items of null, zero or negative size are left out. Repeated rows are items of their own; other columns are
    not read. ``start_at`` is the piece's place in its item.
    """
    kind = dict(items.dtypes)[id_col]
    rows = stage(items.select(F.col(id_col), F.col(size_col).cast("bigint").alias("size")).filter("size > 0"))
    pieces = (
        rows.withColumn("row_id", F.monotonically_increasing_id())
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {capacity} as int)"))))
        .withColumn("start_at", F.col("piece_no").cast("bigint") * capacity)
        .withColumn("size", F.least(F.col("size") - F.col("start_at"), F.lit(capacity).cast("bigint")))
    )
    columns = [id_col, "piece_no", "start_at", "size"]
    whole = pieces.filter(F.col("size") == capacity).select(
        F.concat_ws("-", F.lit("whole"), "row_id", "piece_no").alias("container_id"), *columns
    )
    todo = pieces.filter(F.col("size") < capacity)
    done = [whole]
    measure = [F.count("*"), F.coalesce(F.sum("size"), F.lit(0))]
    n, total = todo.agg(*measure).first()
    for level in range(64):
        if not n:
            break
        groups = max(-(-n // group), -(-total // (capacity * GROUP_BINS)))
        schema = f"container_id string, `{id_col}` {kind}, row_id bigint, piece_no int, start_at bigint, size bigint, again boolean"

        packed = stage(
            todo.withColumn("g", F.pmod(F.xxhash64("row_id", "piece_no", F.lit(level)), F.lit(groups)))
            .groupBy("g")
            .applyInPandas(_packer(level, groups == 1, capacity, id_col), schema)
        )
        done.append(packed.filter(~F.col("again")).select("container_id", *columns))
        todo = packed.filter("again").drop("container_id", "again")
        if groups == 1:
            break
        n, total = todo.agg(*measure).first()
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, group: int = GROUP) -> DataFrame:
    """Containers of ``capacity`` tokens for documents, as ``fill_containers``; documents without tokens are left out."""
    return fill_containers(count_tokens(docs, id_col, text_col, path), id_col, "n_tokens", capacity, group)
