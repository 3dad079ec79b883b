"""Filling containers of fixed capacity with items of varying length.

Lengths above the capacity are cut; what is left has at most ``capacity`` different lengths, so
the histogram of the whole corpus fits the driver at any scale. Dynamic programming over it
chooses the bucket boundaries that minimise padding to the bucket's upper end; batches within the
token budget are formed from the buckets and written down as (batch shape, number of containers);
items then find their container by their number inside their bucket, in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.tokens import encode
from auditlake.operators.ranking import number_in_group
from auditlake.session import checkpointed

CAPACITY = 2048
#: With this many buckets the padding of the test corpora is about a five-thousandth of their tokens.
MAX_BUCKETS = 1024


def length_buckets(histogram: dict[int, int], capacity: int, most: int) -> list[int]:
    """Upper bounds of at most ``most`` buckets with the least padding over the histogram.

    Padding of a bucket is what its items lack to its upper bound. Optimal: the recurrence
    best[b][j] = min over i of best[b-1][i] + padding(i, j) is solved over all distinct lengths.
    """
    sizes = np.array(sorted(histogram), np.int64)
    if len(sizes) <= most:
        return sizes.tolist()
    n = np.array([histogram[int(s)] for s in sizes], np.float64)
    count, mass = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], (n * sizes).cumsum()])
    k = len(sizes)
    best = np.concatenate([[0.0], sizes * count[1:] - mass[1:]])
    cuts = []
    for _ in range(most - 1):
        best, cut = _layer(best, sizes, count, mass)
        cuts.append(cut)
    bounds, j = [], k
    for cut in reversed(cuts):
        bounds.append(int(sizes[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j > 0:
        bounds.append(int(sizes[j - 1]))
    return sorted(set(bounds))


def _layer(best: np.ndarray, sizes: np.ndarray, count: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, cut) with one bucket more: the lengths cut[j] .. j-1 share the last bucket.

    The best cut never falls as j rises, so each level of a bisection searches only between the
    cuts of its neighbours: about k log k steps instead of k squared.
    """
    k = len(sizes)
    new, cut = np.zeros(k + 1), np.zeros(k + 1, np.int64)
    known = np.array([0, k + 1])
    low, high = np.array([0]), np.array([k])
    while True:
        middle = (known[:-1] + known[1:]) // 2
        todo = middle > known[:-1]
        if not todo.any():
            return new, cut
        j, lo, hi = middle[todo], low[todo], np.minimum(high[todo], middle[todo] - 1)
        hi = np.maximum(hi, lo)
        width = hi - lo + 1
        start = np.concatenate([[0], width.cumsum()[:-1]])
        group = np.repeat(np.arange(len(j)), width)
        i = np.arange(int(width.sum())) - start[group] + lo[group]
        jj = j[group]
        cost = best[i] + sizes[jj - 1] * (count[jj] - count[i]) - (mass[jj] - mass[i])
        least = np.minimum.reduceat(cost, start)
        at = np.flatnonzero(cost == least[group])
        first = at[np.unique(group[at], return_index=True)[1]]
        new[j], cut[j] = least, i[first]
        known = np.sort(np.concatenate([known, j]))
        inner = cut[known[1:-1]]
        low, high = np.concatenate([[0], inner]), np.concatenate([inner, [k]])


def _first_fit(left: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """The longest item, then again and again the longest that still fits."""
    room, shape = capacity, {}
    for b in range(len(sizes) - 1, -1, -1):
        if left[b] and sizes[b] <= room:
            n = int(min(left[b], room // sizes[b]))
            shape[b] = n
            room -= n * int(sizes[b])
    return shape


def _least_room(left: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """The longest item with the set of others that fills its container best (bounded subset sum on bit sets)."""
    top = int(np.flatnonzero(left)[-1])
    room = capacity - int(sizes[top])
    shape = {top: 1}
    reach, trail = 1, []
    full = (1 << (room + 1)) - 1
    for b in range(top, -1, -1):
        n = int(min(left[b] - (b == top), room // sizes[b]))
        if n <= 0:
            continue
        before, step = reach, int(sizes[b])
        taken = 1
        while n > 0:
            use = min(taken, n)
            reach |= (reach << (step * use)) & full
            n -= use
            taken *= 2
        trail.append((b, before))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for b, before in reversed(trail):
        n = 0
        while not before >> at & 1:
            at -= int(sizes[b])
            n += 1
        if n:
            shape[b] = shape.get(b, 0) + n
    return shape


def form_batches(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(number of containers, {bucket bound: items of it in each})] that place all items.

    Two rules are tried on the histogram, first fit by falling length and the least room per
    container; the one with fewer containers is kept. A shape is repeated while its items last,
    so the work depends on the number of buckets, not on the number of items.
    """
    plans = []
    for rule in (_first_fit, _least_room):
        sizes = np.array(sorted(counts), np.int64)
        left = np.array([counts[int(s)] for s in sizes], np.int64)
        plan = []
        while left.any():
            shape = rule(left, sizes, capacity)
            times = min(int(left[b]) // n for b, n in shape.items())
            for b, n in shape.items():
                left[b] -= n * times
            plan.append((times, {int(sizes[b]): n for b, n in shape.items()}))
        plans.append(plan)
    return min(plans, key=lambda p: sum(t for t, _ in p))


def _slots(batches: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each bucket the runs of its numbers: first number, first container, items a container, first position."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    container = 0
    for times, shape in batches:
        position = 0
        for bound in sorted(shape, reverse=True):
            n = shape[bound]
            runs.setdefault(bound, []).append((taken.get(bound, 0), container, n, position))
            taken[bound] = taken.get(bound, 0) + n * times
            position += n
        container += times
    return {b: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for b, r in runs.items()}


def _place(slots: dict[int, tuple[np.ndarray, ...]]):
    @F.arrow_udf(T.StructType([T.StructField("container", T.LongType()), T.StructField("position", T.IntegerType())]))
    def place(bucket: pa.Array, rank: pa.Array) -> pa.Array:
        b, r = bucket.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        container, position = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
        for bound in np.unique(b):
            at = np.flatnonzero(b == bound)
            first, base, per, offset = slots[int(bound)]
            run = np.searchsorted(first, r[at], side="right") - 1
            inside = r[at] - first[run]
            container[at] = base[run] + inside // per[run]
            position[at] = offset[run] + inside % per[run]
        return pa.StructArray.from_arrays([pa.array(container), pa.array(position)], ["container", "position"])

    return place


def items_of(lengths: DataFrame, id_col: str, length_col: str, capacity: int) -> DataFrame:
    """(id, piece, token_start, token_end, size): whole items, and the full pieces and the rest of longer ones."""
    n = F.col(length_col)
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("long")),
        lambda k: F.struct(k.alias("piece"), (k * capacity).alias("token_start"), F.least((k + 1) * capacity, n).alias("token_end")),
    )
    cut = lengths.select(F.col(id_col), F.explode(pieces).alias("_p"))
    return cut.select(id_col, "_p.piece", "_p.token_start", "_p.token_end", (F.col("_p.token_end") - F.col("_p.token_start")).cast("int").alias("size"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_buckets: int = MAX_BUCKETS, **tokenizer) -> DataFrame:
    """(id, container_id, position, token_start, token_end): a row per item, more for items above the capacity.

    An item is whole unless it alone exceeds the capacity; then its full pieces have containers of
    their own and the rest is packed like any item. Items without tokens (null, empty text) need no
    room: one row with the range 0, 0 and null for container and position. Ids should be unique;
    rows that repeat an id are still placed each on its own. Empty input gives no rows.
    """
    lengths = encode(docs, id_col, text_col, out="_n", count_only=True, **tokenizer)
    items = checkpointed(items_of(lengths, id_col, "_n", capacity).withColumn("_row", F.monotonically_increasing_id()))
    # At most ``capacity`` rows reach the driver, whatever the size of the corpus.
    histogram = {r["size"]: r["count"] for r in items.where("size > 0").groupBy("size").count().collect()}
    bounds = length_buckets(histogram, capacity, max_buckets)
    if not bounds:
        return items.select(id_col, F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("position"), "token_start", "token_end")
    filled = np.zeros(len(bounds), np.int64)
    for size, n in histogram.items():
        filled[np.searchsorted(bounds, size)] += n
    slots = _slots(form_batches({b: int(n) for b, n in zip(bounds, filled, strict=True) if n}, capacity))
    bound_of = F.array(*[F.lit(bounds[int(np.searchsorted(bounds, s))]) for s in range(1, bounds[-1] + 1)])
    sized = items.where("size > 0").withColumn("_bucket", F.element_at(bound_of, F.col("size")))
    ranked = number_in_group(sized, "_bucket", ["_row"], "_rank")
    placed = ranked.withColumn("_at", _place(slots)("_bucket", "_rank")).select(id_col, F.col("_at.container").alias("container_id"), F.col("_at.position").alias("position"), "token_start", "token_end")
    empty = items.where("size = 0").select(id_col, F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("position"), "token_start", "token_end")
    return placed.unionByName(empty)
