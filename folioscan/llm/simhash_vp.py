"""SimHash near-duplicates with vantage-point trees.

Fingerprints: each shingle of four words is hashed to 64 bits; a bit of the
fingerprint is set if it is set in over half of the hashes.  Fingerprints link
at four or fewer differing bits; a component is what links reach.

Pairs are found on distinct fingerprints only, so exact copies cost one row.
The 64 bits are seen as four bands of 16.  Two fingerprints within four bits
are within one bit in some band (four bits over four bands), so each band has a
tree that is searched with radius one:

* a tree partitions its band by Hamming distance to a vantage point, each ring
  again by the distance to the next vantage point, and so on; the path of rings
  names a shard.  Vantage points come from a bounded sample of fingerprints;
  the depth follows the number of fingerprints;
* by the triangle inequality, whatever is one bit away lies in a ring whose
  number differs by one at every level, and what is zero bits away in the same.
  All other branches are pruned.  A fingerprint lives in its own shard and
  visits the shards of the neighbouring rings; of two neighbours only the one
  in the inner ring of the first level visits;
* a shard compares what lives there with what lives there or visits, all 64
  bits.  It gives back a spanning forest of its links, never all pairs.  A
  shard with many members is searched breadth first, taking out what is
  reached, so that a dense group of near copies shrinks at once; if it holds
  more than ``tile`` members, it is cut in tiles and pairs of tiles go to
  different tasks.

Components are closed over the forests' edges by rounds of joins.

Defined results: null or empty texts, or texts of white space, have
fingerprint zero and link like any other; fewer than four words are one
shingle; rows with a null doc_id get a fingerprint but take no part in linking
(component_id null); repeated rows are in one component; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from folioscan.llm.common import as_bytes, numbered, row_name, stored

SHINGLE, DISTANCE, SEED = 4, 4, 42
BANDS, BAND_BITS = 4, 16
SPACE = re.compile(rb"[\x20\x09-\x0D]")
EACH_BYTE = np.uint64(0x0101010101010101)
SAMPLE = 512  # fingerprints that vantage points are chosen from
BLOCK = 256  # members compared with a shard at a time
SMALL = 32  # members up to which shards are compared side by side
MATRIX = 1 << 22  # comparisons up to which a shard is compared at once


def _pieces(text: bytes, limit: int) -> Iterator[list[bytes]]:
    """The words of a text, long texts in pieces that share three words."""
    carried: list[bytes] = []
    begin, some = 0, False
    while begin < len(text):
        space = SPACE.search(text, begin + limit)
        end = space.start() if space else len(text)
        words = carried + text[begin:end].lower().split()  # of bytes: A-Z and ASCII white space only
        if len(words) >= SHINGLE:
            yield words
            some = True
        carried = words[1 - SHINGLE:]
        begin = end
    if carried and not some:
        yield carried


def _shingle_hashes(words: list[bytes]) -> list[int]:
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    begins = [0, *ends]
    last = min(SHINGLE, len(words)) - 1
    return [xxhash.xxh64_intdigest(joined[begins[i]:ends[i + last] - 1], SEED) for i in range(len(words) - last)]


def fingerprints_of(texts: list[bytes], limit: int = 1 << 22) -> np.ndarray:
    """The fingerprints, as unsigned numbers."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    owners: list[int] = []
    counts: list[int] = []
    hashes: list[int] = []

    def add():
        """Counts each bit: of all eight bytes of a hash at once, in groups of
        255 hashes, as many as a byte can count."""
        if hashes:
            values, n = np.array(hashes, np.uint64), np.array(counts)
            groups = -(-n // 255)
            of = np.repeat(np.arange(len(n)), groups)
            within = np.arange(len(of)) - (np.cumsum(groups) - groups)[of]
            at = (np.cumsum(n) - n)[of] + 255 * within
            sums = np.empty((len(of), 8, 8), np.int64)
            for bit in range(8):
                lanes = np.add.reduceat((values >> np.uint64(bit)) & EACH_BYTE, at)
                sums[:, :, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
            np.add.at(ones, np.array(owners)[of], sums.reshape(-1, 64))
            np.add.at(total, owners, n)
        for held in (owners, counts, hashes):
            held.clear()

    for i, text in enumerate(texts):
        for words in _pieces(text, limit):
            found = _shingle_hashes(words)
            owners.append(i)
            counts.append(len(found))
            hashes += found
            if len(hashes) > 1 << 19:
                add()
    add()
    bits = (2 * ones > total[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        prints = fingerprints_of(as_bytes(batch.column("text")))
        keys = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(prints.view(np.int64))], [*keys, "print"])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, ``keys`` (longs) and print (the fingerprint's 64 bits as a long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, "text")
    return rows.mapInArrow(_fingerprint_batches, ", ".join(f"{c} long" for c in ("doc_id", *keys, "print")))


def _band(prints: np.ndarray, band: int) -> np.ndarray:
    return (prints >> np.uint64(band * BAND_BITS)) & np.uint64(0xFFFF)


def vantage_points(sample: np.ndarray, depth: int) -> list[list[int]]:
    """For each band ``depth`` values out of the sample: the first whose
    distances spread most, then each time the one that leaves the smallest
    largest shard."""
    trees = []
    for band in range(BANDS):
        values = np.unique(_band(sample, band))
        path = np.zeros(len(sample), np.int64)
        members = _band(sample, band)
        chosen: list[int] = []
        for _ in range(depth):
            best = None
            for v in values[:: max(1, len(values) // 64)]:
                rings = path * 17 + np.bitwise_count(members ^ v)
                cost = int((np.unique(rings, return_counts=True)[1] ** 2).sum())
                if best is None or cost < best[0]:
                    best = cost, int(v), rings
            chosen.append(best[1])
            path = np.unique(best[2], return_inverse=True)[1]
        trees.append(chosen)
    return trees


def tree_depth(prints: int) -> int:
    """Levels, so that a shard of evenly spread fingerprints stays small: each
    level divides by about seven; sixteen bits carry five at most."""
    return min(5, max(1, math.ceil(math.log(max(2, prints) / 256, 7)) if prints > 256 else 1))


def _rings(trees: list[list[int]]) -> Column:
    """The four rows (band, rings) of a fingerprint."""
    rows = []
    for band, points in enumerate(trees):
        part = F.shiftrightunsigned("print", band * BAND_BITS).bitwiseAND(F.lit(0xFFFF))
        rows.append(F.struct(F.lit(band).alias("band"),
                             F.array(*[F.bit_count(part.bitwiseXOR(F.lit(v))).cast("int") for v in points]).alias("rings")))
    return F.inline(F.array(*rows))


def _shard(shift: tuple[int, ...]) -> Column:
    """A shard's number, from band and rings, with each ring shifted."""
    number = F.col("band").cast("long")
    for level, by in enumerate(shift):
        number = number * 19 + F.col("rings")[level] + (1 + by)
    return number


def members(prints: DataFrame, trees: list[list[int]]) -> DataFrame:
    """(shard, print, visits): where each fingerprint lives, and what it visits."""
    depth = len(trees[0])
    home = (0,) * depth
    # From the inner ring of the first level outwards, one step at every level.
    steps = [(1, *(1 if i >> k & 1 else -1 for k in range(depth - 1))) for i in range(1 << (depth - 1))]
    places = F.array(F.struct(_shard(home).alias("shard"), F.lit(False).alias("visits")),
                     *[F.struct(_shard(s).alias("shard"), F.lit(True).alias("visits")) for s in steps])
    return prints.select("print", _rings(trees)).select("print", F.inline(places))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= DISTANCE


def forest(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect all that links connect within ``left``, or between
    ``left`` and ``right``.  Breadth first; what is reached is taken out."""
    edges: list[tuple[int, int]] = []
    if right is None:
        waiting = left
        while len(waiting) > 1:
            front, waiting = waiting[:1], waiting[1:]
            while len(front) and len(waiting):
                step, front = front[:BLOCK], front[BLOCK:]
                near = _near(step, waiting)
                hit = near.any(0)
                edges += zip(step[near[:, hit].argmax(0)].tolist(), waiting[hit].tolist())
                front = np.concatenate([front, waiting[hit]])
                waiting = waiting[~hit]
        return edges
    sides = [left, right]
    while len(sides[0]) and len(sides[1]):
        fronts = [sides[0][:1], sides[0][:0]]
        sides[0] = sides[0][1:]
        while len(fronts[0]) or len(fronts[1]):
            side = 0 if len(fronts[0]) else 1
            step, fronts[side] = fronts[side][:BLOCK], fronts[side][BLOCK:]
            other = sides[1 - side]
            if not len(other):
                continue
            near = _near(step, other)
            hit = near.any(0)
            edges += zip(step[near[:, hit].argmax(0)].tolist(), other[hit].tolist())
            fronts[1 - side] = np.concatenate([fronts[1 - side], other[hit]])
            sides[1 - side] = other[~hit]
    return edges


def _thinned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _small_shards(shard: np.ndarray, prints: np.ndarray, visits: np.ndarray) -> list[tuple[int, int]]:
    """Links within many small shards at once: members lie side by side, those
    that live in a shard first; each is compared with the one k places on."""
    pairs: list[tuple[int, int]] = []
    here = np.arange(len(shard))
    k = 0
    while len(here):
        k += 1
        here = here[here + k < len(shard)]
        here = here[(shard[here] == shard[here + k]) & ~visits[here]]
        near = here[np.bitwise_count(prints[here] ^ prints[here + k]) <= DISTANCE]
        pairs += zip(prints[near].tolist(), prints[near + k].tolist())
        if len(pairs) > 1 << 18:
            pairs = _thinned(pairs)
    return _thinned(pairs)


def _shard_links(prints: np.ndarray, visits: np.ndarray) -> list[tuple[int, int]]:
    lives, guests = prints[~visits], prints[visits]
    if len(lives) * len(prints) <= MATRIX:
        everyone = np.concatenate([lives, guests])
        near = np.triu(_near(lives, everyone), 1)
        if near.sum() <= 8 * len(prints):
            i, k = near.nonzero()
            return list(zip(lives[i].tolist(), everyone[k].tolist()))
    return forest(lives) + (forest(lives, guests) if len(guests) else [])


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the shards that come in order, whole shards at a time."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

    def emit(shard, prints, visits):
        pairs = []
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        sizes = np.diff(np.r_[starts, len(shard)])
        many = np.repeat(sizes > SMALL, sizes)
        pairs += _small_shards(shard[~many], prints[~many], visits[~many])
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            pairs += _shard_links(prints[s:s + n], visits[s:s + n])
        if pairs:
            found = np.array(_thinned(pairs), np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    for batch in batches:
        got = (batch.column("shard").to_numpy(zero_copy_only=False), batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64),
               batch.column("visits").to_numpy(zero_copy_only=False))
        held = [np.concatenate(x) for x in zip(held, got)]
        if len(held[0]) >= 1 << 16 and held[0][0] != held[0][-1]:
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last shard may go on
            yield from emit(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from emit(*held)


def _tile_linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between two tiles of a shard, whole pairs of tiles at a time."""
    def emit(rows: list):
        first, second = (np.array([p for p, s, _ in rows if s == side], np.int64).view(np.uint64) for side in (0, 1))
        lives = np.array([not v for _, s, v in rows if s == 0], bool)
        other = np.array([not v for _, s, v in rows if s == 1], bool)
        pairs = forest(first[lives]) if not len(second) else forest(first[lives], second)
        if not len(second):
            pairs += forest(first[lives], first[~lives])
        elif other.any():
            pairs += forest(second[other], first[~lives])
        if pairs:
            found = np.array(_thinned(pairs), np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    held, key = [], None
    for batch in batches:
        for shard, low, high, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "low", "high", "print", "side", "visits"))):
            if (shard, low, high) != key:
                if held:
                    yield from emit(held)
                held, key = [], (shard, low, high)
            held.append(row)
    if held:
        yield from emit(held)


def links(prints: DataFrame, tile: int = 20_000) -> DataFrame:
    """Edges (a, b) of ``prints`` (distinct): a forest for each shard, which
    together connect what links of ``DISTANCE`` bits connect.  ``prints`` is
    read more than once: pass a stored table."""
    spark = prints.sparkSession
    count = prints.count()
    if count < 2:
        return spark.createDataFrame([], "a long, b long")
    sample = prints.orderBy(F.xxhash64("print")).limit(SAMPLE).collect()  # bounded
    depth = tree_depth(count)
    trees = vantage_points(np.array([r["print"] for r in sample], np.int64).view(np.uint64), depth)
    placed = members(prints, trees)
    large = stored(placed.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > tile)
                   .select("shard", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "large-shards")
    any_large = large.limit(1).count() > 0
    whole = placed.join(large, "shard", "left_anti") if any_large else placed
    found = whole.repartition("shard").sortWithinPartitions("shard", "visits").mapInArrow(_linker, "a long, b long")
    if any_large:
        cut = placed.join(large, "shard").withColumn(
            "tile", F.pmod(F.xxhash64("print"), "tiles").cast("int"))
        # Each pair of tiles meets once: tile t is the lower side for t and above, the higher side for those below.
        paired = (cut.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
                  .select("shard", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high"), "print",
                          F.when(F.col("tile") > F.col("partner"), 1).otherwise(0).alias("side"), "visits")
                  .repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high"))
        found = found.unionByName(paired.mapInArrow(_tile_linker, "a long, b long"))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches.

    Alternating stars: every node's larger neighbours are tied to its smallest
    neighbour, then every node and its smaller neighbours, until all edges
    point at a root.  Each round is stored; groups are only summed up, never
    gathered."""
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(lower, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(lower.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
        edges = stored(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = now


def _rooted(prints: DataFrame, least: Column) -> DataFrame:
    """print, least (of the rows that have it and a doc_id), root of each distinct fingerprint."""
    known = stored(prints.where("doc_id IS NOT NULL").groupBy("print").agg(least.alias("least")), "distinct-prints")
    roots = components(stored(links(known.select("print")), "links"))
    return stored(known.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")), "roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = stored(fingerprints(docs), "prints")
    rooted = _rooted(prints, F.min("doc_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.join(least, "root").select("print", "component_id")
    return prints.join(labelled, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, of those with its smallest doc_id; all columns
    kept.  Rows without doc_id stay.  Rows that share a doc_id and have texts in
    different components are told apart."""
    rows, row = numbered(docs, "rows"), row_name(docs)
    prints = stored(fingerprints(rows, row), "prints")
    first = _rooted(prints, F.min(F.struct("doc_id", row))).groupBy("root").agg(F.min("least").alias("first"))
    kept = stored(first.select(F.col("first")[row].alias(row)), "kept")
    # Nearly all documents are kept, so the keys grow with the corpus: texts meet them by a shuffle at every size.
    once = rows.where("doc_id IS NOT NULL").join(kept.hint("merge"), row, "left_semi")
    nameless = rows.where("doc_id IS NULL")
    return once.select(docs.columns).unionByName(nameless.select(docs.columns))
