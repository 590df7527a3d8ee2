"""Filling fixed-capacity containers with items of varying length.

Bin completion: the largest item left opens a container, the undominated sets of further items that can
complete it are enumerated by their sums, and the search goes on with what is left. A branch is given up when the
waste so far is more than a solution with the wanted number of containers can have. The first incumbent is best fit
decreasing; numbers between the lower bound and the incumbent are tried by halving, each with completions of least
waste first and with those of fewest items first. A search ends with a solution, when all branches are done, or when
its nodes are used up.

A shard of a few hundred containers is one problem. Its containers that are left with room are opened again
and their items packed together with those of other shards, in rounds of ever fewer shards, so that the last
container of the last shard is the only one with much room, whatever the number of items.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .tokens import VOCABULARY, token_counts

#: Containers and items of a shard.
SHARD_CONTAINERS, SHARD_ITEMS = 300, 12_000
#: Nodes of a search beyond two a container, completions looked at in a node, items whose sums are enumerated at first.
NODES, WIDTH, MOST_ITEMS = 300, 6, 256
#: Kinds of container at most; every document is packed once for each.
KINDS = 64
#: A container with more room than this share of its capacity is opened again.
OPEN_SHARE = 0.002


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item indices: the largest first, each into the fullest container it fits in."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - sizes[i], len(bins) - 1))
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
            insort(rooms, (room - sizes[i], b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that are needed at least: by the total, and, for every threshold k, by the items larger than
    ``capacity - k``, which go with none of size k or more, and those of half the capacity or more.
    """
    best = -(-sum(sizes) // capacity)
    order = sorted(sizes, reverse=True)
    sums = [0]
    for s in order:
        sums.append(sums[-1] + s)
    down = [-s for s in order]
    half = bisect_left(down, -(capacity // 2))  # the items before it are larger than half
    for k in {0, *(s for s in order if 2 * s <= capacity)}:
        alone = bisect_left(down, -(capacity - k))  # larger than capacity - k
        upto = bisect_right(down, -k) if k else len(order)
        middle = half - alone
        rest = sums[upto] - sums[half] - (middle * capacity - (sums[half] - sums[alone]))
        best = max(best, half + max(0, -(-rest // capacity)))
    return best


class Multiset:
    """Sizes with counts, the distinct ones in order."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.order = sorted(self.count)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            self.order.pop(bisect_left(self.order, s))

    def give(self, s: int) -> None:
        if s in self.count:
            self.count[s] += 1
        else:
            self.count[s] = 1
            insort(self.order, s)

    def largest_within(self, room: int) -> int | None:
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else None


def _fillings(items: list[int], target: int, sums: list[int], most: int) -> Iterator[tuple[int, ...]]:
    """Up to ``most`` different sets of items with the sum ``target``, those with the larger items first.

    ``items`` ascend; bit ``t`` of ``sums[i]`` tells whether the first ``i`` of them have a subset of sum ``t``.
    """
    stack: list[tuple[int, int, tuple[int, ...]]] = [(len(items), target, ())]
    found = 0
    while stack and found < most:
        i, rest, chosen = stack.pop()
        if not rest:
            found += 1
            yield chosen
            continue
        while i and (items[i - 1] > rest or not sums[i - 1] >> (rest - items[i - 1]) & 1):
            i -= 1  # with this item the rest cannot be reached
        if not i:
            continue
        s, j = items[i - 1], i - 1
        while j and items[j - 1] == s:
            j -= 1  # the same size again gives the same set
        if sums[j] >> rest & 1:
            stack.append((j, rest, chosen))
        stack.append((i - 1, rest - s, (*chosen, s)))


def completions(left: Multiset, room: int, waste: int, width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """``waste, sizes`` of undominated sets of items that fill ``room`` but for at most ``waste``, least waste first.

    A set is dominated, and left out, if another item still fits beside it, or if one of its items can be
    exchanged for a larger one that is left; that the larger items go first only helps what is left.

    All sums of the items are enumerated, as bits of an integer, and sets are read off for the ``width`` greatest that
    are within the room. Of more than ``MOST_ITEMS`` items that many of all
    sizes are looked at first, and all of them only if these do not fill the room.
    """
    items = [s for s in left.order[: bisect_right(left.order, room)] for _ in range(min(left.count[s], room // s))]
    few = items if len(items) <= MOST_ITEMS else sorted(items[i * len(items) // MOST_ITEMS] for i in range(MOST_ITEMS))
    out: list[tuple[int, tuple[int, ...]]] = []
    for part in (few, items):
        mask, sums = (1 << room + 1) - 1, [1]
        for s in part:
            sums.append((sums[-1] | sums[-1] << s) & mask)
        reach, target, tries = sums[-1], room, 0
        while target >= room - waste and len(out) < width and tries < width:
            tries += 1
            target = (reach & (1 << target + 1) - 1).bit_length() - 1
            if target < max(0, room - waste):
                break
            for chosen in _fillings(part, target, sums, width - len(out)):
                if target == room or not _dominated(left, chosen, room - target):
                    out.append((room - target, chosen))
            if target == 0:
                break
            target -= 1
        if out and out[0][0] == 0 or part is items:
            break
        out = []
    for chosen in _fewest(left, room):  # they may waste more, but keep the smaller items for the smaller rooms
        rest = room - sum(chosen)
        if rest <= waste and (rest, chosen) not in out and not _dominated(left, chosen, rest):
            out.append((rest, chosen))
    return sorted(out, key=lambda x: x[0])


def _fewest(left: Multiset, room: int) -> Iterator[tuple[int, ...]]:
    """The largest item that fits, and the two that fill most."""
    at = bisect_right(left.order, room)
    if at:
        yield (left.order[at - 1],)
    best, low, high = None, 0, at - 1
    while low <= high:
        a, b = left.order[high], left.order[low]
        if a + b > room or a == b and left.count[a] < 2:
            high -= 1
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
            low += 1
    if best:
        yield best


def _dominated(left: Multiset, chosen: tuple[int, ...], rest: int) -> bool:
    used = {s: chosen.count(s) for s in chosen}
    free = lambda s: left.count.get(s, 0) > used.get(s, 0)
    if any(free(s) for s in left.order[: bisect_right(left.order, rest)]):
        return True
    return any(any(free(t) for t in left.order[bisect_right(left.order, s) : bisect_right(left.order, s + rest)]) for s in used)


def _least_waste(choices: list, budget: float) -> list:
    return choices


def _fewest_items(choices: list, budget: float) -> list:
    """The fewest items first of those that waste no more than a container may on the mean; then the others."""
    return sorted(choices, key=lambda x: (x[0] > budget, len(x[1]) if x[0] <= budget else 0, x[0]))


def _search(kept: list[int], capacity: int, most: int, nodes: int, order) -> list[tuple[int, ...]] | None:
    """At most ``most`` containers, as tuples of sizes, if the search finds them."""
    total, left = sum(kept), Multiset(kept)
    stack: list[tuple[Iterator, int, int]] = []  # choices, the size that opened the container, waste before it
    chosen: list[tuple[int, ...]] = []
    spent, waste, allowed = 0, 0, most * capacity - total

    def open_node() -> bool:
        top = left.order[-1]
        left.take(top)
        choices = completions(left, capacity - top, allowed - waste)
        if not choices:
            left.give(top)
            return False
        stack.append((iter(order(choices, (allowed - waste) / max(1, most - len(stack)))), top, waste))
        return True

    open_node()
    while stack:
        choices, top, before = stack[-1]
        if len(chosen) == len(stack):
            for s in chosen.pop():
                left.give(s)
        step = next(choices, None) if spent < nodes else None
        if step is None:
            stack.pop()
            left.give(top)
            if spent >= nodes:
                break
            continue
        spent += 1
        for s in step[1]:
            left.take(s)
        chosen.append(step[1])
        waste = before + step[0]
        if not left.order:
            return [(t, *c) for (_, t, _), c in zip(stack, chosen)]
        open_node()
    return None


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """Containers as lists of item indices, and whether their number is proved least by ``lower_bound``.

    Items of size 0 lie in the first container; no size may exceed the capacity.
    """
    order = [i for i, s in enumerate(sizes) if s > 0]
    empty = [i for i, s in enumerate(sizes) if s <= 0]
    if not order:
        return ([empty] if empty else []), True
    kept = [sizes[i] for i in order]
    least = lower_bound(kept, capacity)
    best = best_fit_decreasing(kept, capacity)
    bins, number = [[order[i] for i in b] for b in best], len(best)
    low = least
    while low < number:  # the waste that is allowed bounds the search: numbers in between are tried by halving
        most = (low + number - 1) // 2
        found = (_search(kept, capacity, most, nodes + 2 * number, way) for way in (_least_waste, _fewest_items))
        solution = next((x for x in found if x is not None), None)
        if solution is None:
            low = most + 1
            continue
        by_size: dict[int, list[int]] = {}
        for i in order:
            by_size.setdefault(sizes[i], []).append(i)
        bins, number = [[by_size[s].pop() for s in group] for group in solution], len(solution)
    bins[0].extend(empty)
    return bins, number == least


def items_of(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """``container, capacity, doc_id, piece_no, token_from, tokens``: each text once per container.

    A text larger than the container is cut into full pieces and a rest; every other is one piece.
    """
    cap = F.col("capacity")
    pieces = F.greatest(F.ceil(F.col("size") / cap), F.lit(1)).cast("int")
    kinds = limits.where("capacity_tokens > 0 AND container IS NOT NULL").groupBy("container").agg(F.min("capacity_tokens").cast("bigint").alias("capacity"))
    known = sorted(tuple(r) for r in kinds.limit(KINDS + 1).collect())
    if len(known) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of container")
    if not known:
        return sizes.sparkSession.createDataFrame([], "container string, capacity bigint, doc_id bigint, piece_no int, token_from bigint, tokens bigint")
    each = F.array(*(F.struct(F.lit(name).alias("container"), F.lit(size).cast("bigint").alias("capacity")) for name, size in known))
    every = sizes.select("doc_id", F.col("tokens").alias("size"), F.explode(each).alias("kind")).select("kind.*", "doc_id", "size")
    cut = every.select("container", "capacity", "doc_id", "size", F.explode(F.sequence(F.lit(1), pieces)).alias("piece_no"))
    start = (F.col("piece_no") - 1) * cap
    return cut.select("container", "capacity", "doc_id", "piece_no", start.alias("token_from"), F.least(F.col("size") - start, cap).alias("tokens"))


def _packed(items: DataFrame, turn: int) -> DataFrame:
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
        capacity = int(rows["capacity"].iloc[0])
        bins, proved = pack(rows["tokens"].tolist(), capacity)
        number = [0] * len(rows)
        room = [0] * len(rows)
        for b, group in enumerate(bins):
            free = capacity - int(sum(rows["tokens"].iloc[i] for i in group))
            for i in group:
                number[i], room[i] = b, free
        bin_id = f"{rows['container'].iloc[0]}-{turn}-{int(rows['shard'].iloc[0])}-"
        return rows.assign(bin=[bin_id + str(b) for b in number], room=room, proved=proved)[["container", "capacity", "doc_id", "piece_no", "token_from", "tokens", "bin", "room", "proved"]]

    schema = "container string, capacity bigint, doc_id bigint, piece_no int, token_from bigint, tokens bigint, bin string, room bigint, proved boolean"
    return items.groupBy("container", "shard").applyInPandas(solve, schema)


def _sharded(items: DataFrame) -> tuple[DataFrame, int]:
    """The items with a shard, evenly by hash, and the number of shards of the container that has most."""
    totals = items.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("capacity").alias("c")).collect()  # a row per container
    parts = {r["container"]: max(1, -(-int(r["t"]) // (int(r["c"]) * SHARD_CONTAINERS)), -(-r["n"] // SHARD_ITEMS)) for r in totals}
    if not parts:
        return items.withColumn("shard", F.lit(0)), 0
    number = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))[F.col("container")]
    return items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), number).cast("int")), max(parts.values())


def pack_documents(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``container, capacity, doc_id, piece_no, token_from, tokens, bin, room, proved``: where each text or piece lies.

    Every document with an id and a text appears once per container kind, or, if it has more tokens than
    the container holds, once per piece: full pieces, which fill a container each, and a rest. ``room`` is
    what the container ``bin`` has left, ``proved`` whether the shard it was packed with last needs no fewer containers. Texts without tokens take no room and lie in the first container of
    their shard. NULL ids and texts give no row, repeated ids count once (with their largest size), empty
    tables give an empty result; other columns are not read.
    """
    named = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sizes = token_counts(named, ["doc_id"], vocabulary=vocabulary).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    items = durable(items_of(durable(sizes), limits))
    full = items.where("tokens = capacity").withColumn("bin", F.concat_ws("-", "container", F.lit("full"), "doc_id", "piece_no")).withColumns({"room": F.lit(0).cast("bigint"), "proved": F.lit(True)})
    done, todo, turn = [full], items.where("tokens < capacity"), 0
    while True:
        sharded, shards = _sharded(todo)
        packed = durable(_packed(sharded, turn))
        if shards <= 1:
            done.append(packed)
            break
        done.append(packed.where(F.col("room") <= F.col("capacity") * OPEN_SHARE))
        reopened = packed.where(F.col("room") > F.col("capacity") * OPEN_SHARE).drop("bin", "room", "proved")
        before, todo, turn = shards, durable(reopened), turn + 1
        if _sharded(todo)[1] >= before:  # nothing gained: these items do not go together any better
            done.append(packed.where(F.col("room") > F.col("capacity") * OPEN_SHARE))
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def container_summary(packed: DataFrame) -> DataFrame:
    """``container, bins, tokens, room, least_bins, room_share`` of a packing."""
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("tokens"))
    total = bins.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"))
    room = F.col("bins") * F.col("capacity") - F.col("tokens")
    return total.select(
        "container", "bins", "tokens", room.alias("room"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(room / (F.col("bins") * F.col("capacity")), 6).alias("room_share")
    )


def packing_faults(packed: DataFrame) -> DataFrame:
    """``container, capacity, documents, lost_or_repeated, torn, overfull``: 0 but for the first three in any right packing."""
    packed = durable(packed)
    pieces = packed.groupBy("container", "capacity", "doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("piece_no").alias("d"), F.max("piece_no").alias("m"), F.sum("tokens").alias("t"), F.max(F.col("token_from") + F.col("tokens")).alias("e")
    )
    lost = (F.col("n") != F.col("d")) | (F.col("n") != F.col("m")) | (F.col("t") != F.col("e"))
    torn = (F.col("n") > 1) & (F.col("t") <= F.col("capacity"))
    count = lambda c: F.sum(c.cast("bigint"))
    documents = pieces.groupBy("container", "capacity").agg(F.count("*").alias("documents"), count(lost).alias("lost_or_repeated"), count(torn).alias("torn"))
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t"))
    return documents.join(bins.groupBy("container").agg(count(F.col("t") > F.col("capacity")).alias("overfull")), "container")
