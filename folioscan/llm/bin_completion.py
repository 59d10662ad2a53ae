"""Best-fit packing by bin completion with branch and bound.

Only lengths matter for packing, and there are at most ``capacity`` different
ones: Spark tokenizes, cuts and counts; the counts by length (a table whose size
does not depend on the corpus) are solved at one place; Spark then gives every
piece its slot by its rank among the pieces of its length.

The search fills the bin of the largest remaining length: it enumerates
undominated fillings of what that length leaves free (a filling dominates
another whose lengths could be put inside its own), least waste first, takes
one for as many bins as the counts allow, and goes on with what remains.  A
branch ends when its waste is more than a packing with one bin less than the
best known could have.  The best known packing at the start is best-fit
decreasing; the search stops at the lower bound or after ``nodes`` steps.  It is
a bounded search: of a bin's undominated fillings the ``width`` with the least
waste are followed, those of more than three lengths are looked for in 400 steps,
and a filling is taken as often as the counts allow.  So the packing is only
proven to be the best one where it meets the lower bound; no piece is left out
in any case.

Defined results: a null or empty text is one piece of the end token alone; a
document of more than ``capacity`` tokens is cut into pieces of ``capacity``,
the last may be shorter; repeated rows and equal doc_ids are packed each for
itself; a null doc_id stays null; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from folioscan.llm import tokens
from folioscan.llm.common import stored

CAPACITY, END = 4096, 1
Pattern = tuple[tuple[int, ...], int]  # lengths in a bin, number of such bins


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts; equal bins are kept together."""
    open_bins: dict[int, list[Pattern]] = defaultdict(list)  # by free space

    def put(length: int, left: int, space: int, pattern: tuple[int, ...], bins: int) -> int:
        """Fills bins one after the other, as many items in each as fit."""
        each = space // length
        full = min(bins, left // each)
        rest = left - full * each if full < bins else 0
        if full:
            open_bins[space - each * length].append((pattern + (length,) * each, full))
        if rest:
            open_bins[space - rest * length].append((pattern + (length,) * rest, 1))
        if bins - full - (rest > 0):
            open_bins[space].append((pattern, bins - full - (rest > 0)))
        return full * each + rest

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(s for s in open_bins if s >= length):
            for pattern, bins in open_bins.pop(space) if left else ():
                if left:
                    left -= put(length, left, space, pattern, bins)
                else:
                    open_bins[space].append((pattern, bins))
        if left:
            each = capacity // length
            put(length, left, capacity, (), -(-left // each))
    return [p for bins in open_bins.values() for p in bins]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the lengths of ``b`` can be put inside those of ``a``."""
    def place(i: int, room: tuple[int, ...]) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                if place(i + 1, room[:k] + (r - b[i],) + room[k + 1:]):
                    return True
        return False

    return sum(b) <= sum(a) and place(0, a)


def fillings(counts: np.ndarray, lengths: list[int], space: int, most_waste: int, width: int) -> list[tuple[int, ...]]:
    """Up to ``width`` undominated fillings of ``space`` with no more than
    ``most_waste``, best first.  ``lengths``: those with counts, ascending."""
    if bisect_right(lengths, space) == 0:
        return [()] if space <= most_waste else []
    if counts[space]:
        return [(space,)]  # dominates all others
    have = np.array(lengths[:bisect_right(lengths, space)])

    def pairs(room: int, most: int, used: int | None) -> np.ndarray:
        """First lengths of pairs that fill ``room``, descending."""
        first = have[(have <= min(most, room - 1)) & (2 * have >= room)]
        other = room - first
        enough = counts[other] >= 1 + (other == first) + (other == used)
        enough &= counts[first] >= 1 + (first == used) + ((other == first) & (first == used))
        return first[enough][::-1]

    exact = [(int(a), int(space - a)) for a in pairs(space, space, None)[:width]]
    if len(exact) < width:
        for top in have[::-1][:64].tolist():
            exact += [(top, int(a), int(space - top - a)) for a in pairs(space - top, top, top)[:1]]
            if len(exact) >= width:
                break
    if exact:
        return exact[:width]
    found: dict[tuple[int, ...], int] = {}
    steps = 0

    def extend(room: int, index: int, chosen: tuple[int, ...], left: int) -> None:
        nonlocal steps
        steps += 1
        if steps > 400 or any(not w for w in found.values()):
            return
        index = min(index, bisect_right(lengths, room) - 1)
        if index < 0 or (index == 0 and left < 1):
            if room <= most_waste:
                found[chosen] = room
            return
        tried = False
        for k in range(index, -1, -1):
            length = lengths[k]
            spare = left if k == index and chosen and chosen[-1] == length else int(counts[length])
            if spare < 1:
                continue
            if tried and length * (room // length) + most_waste < room and k == 0:
                break
            tried = True
            extend(room - length, k, chosen + (length,), spare - 1)
            if steps > 400:
                break
        if not tried and room <= most_waste:
            found[chosen] = room

    extend(space, len(lengths) - 1, (), int(counts[lengths[-1]]))
    best = sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))[:4 * width]
    kept: list[tuple[int, ...]] = []
    for f in best:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept[:width]


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 20_000, width: int = 4) -> list[Pattern]:
    """The best packing found, as patterns."""
    best = best_fit_decreasing(counts, capacity)
    bins = sum(n for _, n in best)
    total = sum(length * n for length, n in counts.items())
    lower = max(-(-total // capacity), sum(n for length, n in counts.items() if 2 * length > capacity))
    if bins <= lower:
        return best
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = sorted(counts)
    taken: list[Pattern] = []
    waste = 0
    branches: list[list[tuple[int, ...]]] = []

    def options() -> list[tuple[int, ...]]:
        top = lengths[-1]
        left[top] -= 1
        inside = lengths if left[top] else lengths[:-1]
        found = fillings(left, inside, capacity - top, (bins - 1) * capacity - total - waste, width)
        left[top] += 1
        return [(top, *f) for f in reversed(found)]

    def take(pattern: tuple[int, ...]) -> None:
        nonlocal waste
        need = Counter(pattern)
        free = capacity - sum(pattern)
        times = min(int(left[x]) // n for x, n in need.items())
        if free:  # no more waste than a better packing may have
            times = max(1, min(times, ((bins - 1) * capacity - total - waste) // free))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                lengths.remove(x)
        taken.append((pattern, times))
        waste += free * times

    def back() -> None:
        nonlocal waste
        pattern, times = taken.pop()
        for x, n in Counter(pattern).items():
            if not left[x]:
                lengths.insert(bisect_right(lengths, x), x)
            left[x] += n * times
        waste -= (capacity - sum(pattern)) * times

    for _ in range(nodes):
        if not lengths and sum(n for _, n in taken) < bins:
            best, bins = list(taken), sum(n for _, n in taken)
            if bins <= lower:
                break
        if len(branches) == len(taken):
            within = waste <= (bins - 1) * capacity - total
            branches.append(options() if lengths and within else [])
        while branches and not branches[-1]:
            branches.pop()
            if taken:
                back()
        if not branches:
            break
        take(branches[-1].pop())
    return best


def _cutter(tokenizer: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches):
        encode = tokens.word_bpe(tokenizer)
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        end = tokens.packed([END])
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((doc, piece, at // 4, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; ``nth``: its place
    among the pieces of its length that its task made."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _cutter(tokenizer, capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of equal slots in order of length and first rank: the bin of the
    first rank (the next rank has the next bin) and the place in that bin."""
    runs, used, first = [], Counter(), 0
    for lengths, bins in patterns:
        offset = 0
        for length in lengths:
            runs.append((length, used[length], first, offset))
            used[length] += bins
            offset += length
        first += bins
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "bin", "offset"), table.T.copy()))


def _placer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        runs = shared.value
        keys = (runs["length"] << 40) + runs["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 40) + rank, "right") - 1
            sequence = runs["bin"][at] + rank - runs["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(runs["offset"][at])],
                [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with its sequence and its place in it."""
    cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = stored(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(slots(complete(counts, capacity)))
    # A row for each length in each task: they grow with the corpus, so pieces meet them by a shuffle at every size.
    ranked = cut.join(by_task.drop("n").hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placer(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
