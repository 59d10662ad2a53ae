"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds the hashes of its distinct shingles of five words.  Two
documents link if their sets' Jaccard similarity is 0.8 or more; a component is
what links reach.

* Order.  Shingles are taken in one order by all documents: by how often they
  occur, roughly, then by hash.  How often is read off a table of counters,
  ``2 ** CELL_BITS``, over the whole corpus, of which the cells far above the mean are
  kept; so what many documents share comes last.
* Prefix.  Of n shingles, the first ``n - ceil(0.8 n) + extra + 1`` are a
  document's prefix, with ``extra`` of ``n // 10``.  So the prefixes of two linked
  documents share more than a tenth of their shingles (:func:`_enough`).
* Groups.  Documents with the same size and prefix are one group, and only
  groups are listed under the shingles of their prefixes.  A group that has too
  few shingles in lists with others, even for the smallest partner, is out.
  Pairs of groups must agree in size and meet in a list that both keep.
* Members.  Documents with equal sets are one class.  Groups that are left are
  expanded to their classes, whose whole sets are compared, exactly.

Dense clusters of near copies would give a pair for each two of them.  As links
only have to connect, groups first are compared with a few neighbours, those
before them when groups are sorted by the least hashes of their listed shingles,
and members with the first of their group.  What that connects is a component.
Then all pairs that are still in different components are compared, list by
list, the largest component of a list with the others but never with itself.
Pairs whose sets cannot be similar, by 512 parity bits of each, are not looked
at further.

Hashes of shingles have 64 bits, classes 128.  Texts are read once for each of
the four steps and not shuffled, only prefixes and the sets that are compared.

Defined results: words are parted by ASCII white space, A-Z in lower case;
fewer than five words are one shingle; null, empty or blank texts have no
shingles and link with nothing; repeated rows link with each other; a row
without doc_id takes part like any other, and component_id is the smallest
doc_id there is in its component (null if there is none); rows that share a
doc_id are judged by their own texts; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscan.llm.common import as_bytes, blocks, stored
from folioscan.llm.simhash_vp import components

SHINGLE = 5
CELL_BITS = 20
BLOCK = 1 << 20  # bytes of texts that are hashed at a time
REMEMBERED = 1 << 20  # groups or classes that a task remembers
PARITY = 512  # bits that tell unlikely pairs before sets are compared
FILTER_BITS = 1 << 27  # most bits of the filter that tells which sets to take
TURNS, BEFORE = 6, 3  # sortings, and neighbours in each, that are compared first
TILE = 1000  # comparisons with one set in a task
SAME_PREFIX = 1 << 30  # weight of the list of a group's own members
SPACE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
OF_BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
OF_BYTE[0x41:0x5B] = OF_BYTE[0x61:0x7B]  # A-Z as a-z
MULTIPLIER = np.uint64(0xD1342543DE82EF95)
Batches = Iterator[pa.RecordBatch]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their hashes: sums of a random number
    for each byte times one for its place in the word, mixed."""
    raw = np.frombuffer(text, np.uint8)
    break_ = IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(break_.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    begins, ends = edge[::2], edge[1::2]
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    sizes = ends - begins
    powers = np.full(int(sizes.max()), MULTIPLIER, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    letters = raw[~break_]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    return begins, _mixed(np.add.reduceat(OF_BYTE[letters] * powers[place], first))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` words, or of all words if they are fewer."""
    width = min(SHINGLE, len(words))
    hashes = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(hashes)])
    return hashes


def _long_words(text: bytes) -> np.ndarray:
    """The words' hashes of a long text, piece by piece."""
    parts, begin = [], 0
    while begin < len(text):
        end = min((e for e in (text.find(s, begin + BLOCK) for s in SPACE) if e >= 0), default=len(text)) if len(text) > begin + BLOCK else len(text)
        parts.append(word_hashes(text[begin:end])[1])
        begin = end
    return np.concatenate(parts)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    for low, high in blocks([len(t) for t in texts], BLOCK):
        if len(texts[low]) > BLOCK:
            words = _long_words(texts[low])
            yield np.unique(_shingles(words)) if len(words) else words
            continue
        begins, words = word_hashes(b" ".join(texts[low:high]))
        after = np.cumsum([len(t) + 1 for t in texts[low:high]])
        ends = np.searchsorted(begins, after).tolist()
        hashes = _shingles(words) if len(words) >= SHINGLE else words
        begin = 0
        for end in ends:
            if end - begin >= SHINGLE:
                own = np.sort(hashes[begin:end - SHINGLE + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            else:
                yield _shingles(words[begin:end]) if end > begin else words[:0]
            begin = end


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + n // 10 + 1


def _enough(n: Column) -> Column:
    """How many shingles of its prefix a document of ``n`` shares at least with
    that of any linked one.  All they share up to the end of the prefix that ends
    first is in both prefixes, and beyond it no more than the other shingles of
    that document: of m and n shingles 4 / 9 (m + n) are shared, and seven tenths
    of the larger number, at most, lie beyond."""
    return F.floor(n / 10) + 1


def _alike(m: Column, n: Column) -> Column:
    """Can sets of these sizes be linked?"""
    return (5 * m >= 4 * n) & (5 * n >= 4 * m)


def prefix(tokens: np.ndarray, heat: np.ndarray) -> np.ndarray:
    warm = heat[tokens >> np.uint64(64 - CELL_BITS)]
    if warm.any():
        tokens = tokens[np.lexsort((tokens, warm))]
    return tokens[:prefix_length(len(tokens))]


def _cells(batches: Batches) -> Batches:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for tokens in shingle_sets(as_bytes(batch.column("text"))):
            np.add.at(counts, tokens >> np.uint64(64 - CELL_BITS), 1)
    some = counts.nonzero()[0]
    for at in range(0, len(some), 1 << 16):
        part = some[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], ["cell", "n"])


def heat_of(docs: DataFrame) -> np.ndarray:
    """How far above the mean each cell of shingles is: a bounded table."""
    cells = stored(docs.select("text").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    usual = 2 * total / (1 << CELL_BITS) + 16
    above = cells.where(F.col("n") >= 2 * usual).toArrow()  # fewer than a quarter of the cells
    heat = np.zeros(1 << CELL_BITS, np.uint8)
    heat[above["cell"].to_numpy()] = np.log2(above["n"].to_numpy() / usual)
    return heat


def _described(heat: np.ndarray) -> Callable[[Batches], Batches]:
    def describe(batches):
        for batch in batches:
            sizes, classes, groups = [], [], []
            for tokens in shingle_sets(as_bytes(batch.column("text"))):
                sizes.append(len(tokens))
                classes.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                groups.append(_group(prefix(tokens, heat), len(tokens)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(groups, pa.int64())],
                ["doc_id", "n", "class", "group"])

    return describe


def _group(first: np.ndarray, n: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(first.tobytes(), n)).view(np.int64))


def _posted(heat: np.ndarray) -> Callable[[Batches], Batches]:
    """(token, group, n) for each shingle of a prefix, once for a group as far as the task remembers."""
    def post(batches):
        seen: set[bytes] = set()
        for batch in batches:
            tokens, groups, sizes = [np.zeros(0, np.uint64)], [], []
            for own in shingle_sets(as_bytes(batch.column("text"))):
                first = prefix(own, heat)
                key = xxhash.xxh3_128_digest(first.tobytes(), len(own))
                if not len(own) or key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                tokens.append(first)
                groups.append(_group(first, len(own)))
                sizes.append(len(own))
            times = [len(t) for t in tokens[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(groups, np.int64), times)),
                 pa.array(np.repeat(np.array(sizes, np.int64), times))], ["token", "group", "n"])

    return post


def _shared(batches: Batches) -> Batches:
    """Of rows sorted by token and group: each (token, group) once, of tokens with two groups at least."""
    held = [np.zeros(0, np.int64)] * 3
    alone = True  # is the last row so far the only one of its token?

    def emit(rows: list[np.ndarray], more: bool):
        nonlocal alone, held
        token, group, _ = rows
        fresh = np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])] if len(token) else np.zeros(0, bool)
        rows = [x[fresh] for x in rows]
        token = rows[0]
        if not len(token):
            return
        before = np.r_[not alone, token[1:] == token[:-1]]
        after = np.r_[token[1:] == token[:-1], False]
        keep = before | after
        if more:  # the last row waits for what follows
            held, alone, keep = [x[-1:] for x in rows], not before[-1], keep[:-1]
            rows = [x[:-1] for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], ["token", "group", "n"])

    for batch in batches:
        yield from emit([np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("token", "group", "n"))], True)
    if len(held[0]):
        yield from emit(held, False)


def _bits(classes: list[bytes], mask: int) -> list[tuple[int, int]]:
    return [(int.from_bytes(c[:8], "little") & mask, int.from_bytes(c[8:], "little") & mask) for c in classes]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _filter_words(bits: int) -> Callable[[Batches], Batches]:
    def words(batches):
        for batch in batches:
            at = np.unique(np.array(_bits(batch.column("class").to_pylist(), bits - 1), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    return words


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of the tokens fall on each of ``PARITY`` bits.  Of two
    sets, at least as many tokens are in one only as their bits differ."""
    odd = np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _taken(heard: np.ndarray) -> Callable[[Batches], Batches]:
    """(class, parity, tokens) of the texts whose class the filter knows."""
    mask = len(heard) * 64 - 1

    def take(batches):
        seen: set[bytes] = set()
        for batch in batches:
            classes, sets, parities = [], [], []
            for tokens in shingle_sets(as_bytes(batch.column("text"))):
                name = xxhash.xxh3_128_digest(tokens.tobytes())
                if name not in seen and all(int(heard[at >> 6]) >> (at & 63) & 1 for at in _bits([name], mask)[0]):
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    classes.append(name)
                    sets.append(tokens.view(np.int64))
                    parities.append(_parity(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), _lists(parities), _lists(sets)], ["class", "parity", "tokens"])

    return take


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, parity, tokens), stored, of ``classes`` and a few others.  Tasks know which
    sets to take by a filter of at most ``FILTER_BITS`` bits; where more classes
    are asked for than it can tell apart, more sets are taken."""
    count = classes.count()
    bits = min(FILTER_BITS, 1 << max(10, math.ceil(math.log2(16 * max(1, count)))))
    words = classes.mapInArrow(_filter_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    heard = np.zeros(bits >> 6, np.uint64)
    heard[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    taken = docs.select("text").mapInArrow(_taken(heard), "class binary, parity array<long>, tokens array<long>")
    return stored(taken.groupBy("class").agg(F.first("parity").alias("parity"), F.first("tokens").alias("tokens")), "sets")


def _likely(parities: tuple[str, str], sizes: tuple[str, str]) -> Column:
    """Do the bits of two sets differ in no more places than those of linked sets do?"""
    differ = sum((F.bit_count(F.col(parities[0])[i].bitwiseXOR(F.col(parities[1])[i])) for i in range(PARITY // 64)), F.lit(0))
    return 9 * differ <= F.col(sizes[0]) + F.col(sizes[1])


def _probable(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose bits may be those of linked sets."""
    def side(name: str, parity: str, size: str) -> DataFrame:
        return sets.select(F.col("class").alias(name), F.col("parity").alias(parity), F.size("tokens").alias(size))

    both = pairs.join(side("a", "own", "m"), "a").join(side("b", "parity", "n"), "b")
    return stored(both.where(_likely(("own", "parity"), ("m", "n"))).select("a", "b"), "probable")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` of classes whose whole sets are similar.  A class that
    is ``b`` of many pairs is copied for every ``TILE`` of them."""
    many = pairs.groupBy("b").count().where(F.col("count") > TILE).select("b", F.ceil(F.col("count") / TILE).alias("tiles"))
    # Stored, so that Spark knows its size: few pairs are broadcast, and sets that no pair names stay where they are.
    dealt = stored(pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("tiles", F.lit(1))).alias("tile")), "dealt")
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("right")).join(dealt.select("b", "tile").distinct(), "b")
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("left")).join(dealt, "a")
    common = F.size(F.array_intersect("left", "right"))
    return left.join(right, ["b", "tile"]).where(5 * common >= 4 * (F.size("left") + F.size("right") - common)).select("a", "b")


def _neighbours(lists: DataFrame) -> DataFrame:
    """(a, b): members of ``lists(token, member, n)`` that likely share much.  Each
    turn sorts them by the least hashes of their tokens and takes the ``BEFORE``
    in front of a member that have the first two of them in common."""
    least = F.array(*[F.struct(F.lit(t).alias("turn"), *[F.min(F.xxhash64("token", F.lit(3 * t + i))).alias(f"least_{i}") for i in range(3)])
                      for t in range(TURNS)])
    members = lists.groupBy("member").agg(F.first("n").alias("n"), least.alias("turns")).select("member", "n", F.inline("turns"))
    order = Window.partitionBy("turn", "least_0", "least_1").orderBy("least_2", "member")
    own = F.struct(F.col("member").alias("b"), F.col("n").alias("m"))
    near = members.withColumn("near", F.array(*[F.lag(own, i + 1).over(order) for i in range(BEFORE)]))
    pairs = near.withColumn("before", F.explode("near")).where(_alike(F.col("n"), F.col("before.m")))
    return pairs.select(F.least("member", "before.b").alias("a"), F.greatest("member", "before.b").alias("b")).distinct()


def _open(lists: DataFrame) -> DataFrame:
    """The lists that hold more than one part."""
    parts = lists.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return lists.join(parts.select("token"), "token", "left_semi")


def _across(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of different parts that may be linked.  A list's largest
    part meets the others, and those meet each other.  Linked documents share
    :func:`_enough` lists, so a document may leave out its longest lists, one
    fewer than that: the shortest list that two linked documents share is in
    what both keep."""
    parts = lists.groupBy("token", "part").count()
    most = parts.groupBy("token").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.sum("count").alias("length"))
    rows = lists.join(most.withColumn("tiles", F.ceil(F.col("length") / (20 * TILE))), "token")
    of_member = Window.partitionBy("member")
    shared = F.col("weight") == 1
    rows = rows.withColumn("place", F.row_number().over(of_member.orderBy(shared, "length", "token"))).withColumn(
        "last", F.count("*").over(of_member) - _enough(F.col("n")) + 1)
    kept = rows.where((F.col("place") <= F.col("last")) | ~shared).select("token", "member", "n", "part", "main", "tiles")
    rows = stored(kept.join(sets.select(F.col("class").alias("member"), "parity"), "member"), "kept")
    few = rows.where("part <> main").select(
        "token", F.col("member").alias("a"), F.col("n").alias("m"), F.col("part").alias("of"), F.col("parity").alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    rest = rows.withColumn("tile", F.pmod(F.xxhash64("member"), F.col("tiles")))
    pairs = few.join(rest, ["token", "tile"]).where(
        (F.col("of") != F.col("part")) & ((F.col("part") == F.col("main")) | (F.col("a") < F.col("member"))) & _alike(F.col("m"), F.col("n"))
        & _likely(("own", "parity"), ("m", "n")))
    return pairs.select(F.least("a", "member").alias("a"), F.greatest("a", "member").alias("b")).distinct()


def links(docs: DataFrame, heat: np.ndarray, classes: DataFrame) -> DataFrame:
    """Links (a, b) of ``classes(class, n, group)``, stored, that connect all that links connect."""
    posted = docs.select("text").mapInArrow(_posted(heat), "token long, group long, n long")
    lists = stored(posted.repartition("token").sortWithinPartitions("token", "group").mapInArrow(_shared, "token long, group long, n long"), "lists")
    enough = lists.groupBy("group", "n").count().where(F.col("count") >= _enough(F.col("n"))).select("group")
    one = F.lit(1).cast("long").alias("weight")
    lists = stored(_open(lists.join(enough, "group", "left_semi").select("token", F.col("group").alias("member"), "n", F.col("group").alias("part"), one)), "groups")
    heads = classes.groupBy("group").agg(F.min("class").alias("head"), F.count("*").alias("classes"))
    listed = lists.select(F.col("member").alias("group")).distinct().withColumn("listed", F.lit(True))
    heads = heads.join(listed, "group", "left").where("listed OR classes > 1")
    wanted = stored(classes.join(heads, "group").select("class", "n", "group", "head"), "wanted")
    sets = whole_sets(docs, wanted)
    ends = [wanted.where("class = head").select(F.col("group").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab"]
    near = _neighbours(lists).join(ends[0], "a").join(ends[1], "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    pairs = near.unionByName(wanted.where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b")))
    found = stored(linked(_probable(pairs, sets), sets), "links")
    expanded = lists.select("token", F.col("member").alias("group"), "weight").join(wanted, "group").select("token", "class", "n", "weight")
    inside = wanted.join(wanted.where("class <> head").select("group").distinct(), "group", "left_semi")
    members = stored(expanded.unionByName(inside.select(F.col("group").alias("token"), "class", "n", F.lit(SAME_PREFIX).cast("long").alias("weight")))
                     .withColumnRenamed("class", "member"), "members")
    roots = components(found).select(F.col("node").alias("member"), "root")
    apart = stored(_open(members.join(roots, "member", "left").withColumn("part", F.coalesce("root", "member")).drop("root")), "apart")
    return stored(found.unionByName(linked(stored(_across(apart, sets), "pairs"), sets)), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heat = heat_of(rows)
    known = stored(rows.mapInArrow(_described(heat), "doc_id long, n long, class binary, group long"), "described")
    classes = stored(known.where("n > 0").groupBy("class").agg(
        F.first("n").alias("n"), F.first("group").alias("group"), F.min("doc_id").alias("least"), F.count("*").alias("rows")), "classes")
    roots = components(links(rows, heat, classes)).withColumnRenamed("node", "class")
    rooted = classes.join(roots, "class", "left").select("class", "least", "rows", F.coalesce("root", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("all")).where("all > 1").drop("all")
    labels = stored(rooted.join(least, "root").select("class", "component_id", "rows"), "labels")
    # At most a thousand classes hold over a thousandth of the rows each: these are broadcast, the others are joined.
    count = known.count()
    hot = labels.where(F.col("rows") * 1000 > count).select("class", F.struct("component_id").alias("hot"))
    marked = known.join(F.broadcast(hot), "class", "left")
    cold = marked.where("hot IS NULL").join(labels.select("class", "component_id"), "class", "left")
    result = marked.where("hot IS NOT NULL").select("doc_id", "n", F.col("hot.component_id").alias("component_id")).unionByName(
        cold.select("doc_id", "n", "component_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
