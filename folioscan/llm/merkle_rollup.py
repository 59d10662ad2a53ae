"""Merkle manifest of a dataset by nested-struct rollup.

A leaf is the hash of a row's fields.  The leaves of a language, in the order
of doc_id, are hashed together two by two, level by level, to its subroot; the
subroots, in the order of the languages, likewise to the root.

* Leaves get their rank in their language by a range partition: a sorted
  partition counts its rows, and what earlier partitions hold of a language is
  added.  No language has to fit in one task.
* A rank is ``block`` and ``BITS`` digits.  One exchange brings a block's rows
  together; then the digits are grouped away one after the other, the last
  first, and what a group holds becomes the ``kids`` of a struct with their
  hash.  A block's struct nests ``2 ** BITS`` leaves at most.
* The blocks' hashes are ranked rows again, until each language has one.
* Proofs come down the same way: ``transform`` walks through the nested kids
  and gives each leaf the hashes beside its way up, and an explode emits the
  leaves.  What a block's own hash has beside its way meets the block in a
  grouping by block; there are no joins.

Everything is DataFrame functions.

Defined results: null fields count as ``-``; rows with a null doc_id come first
in their language, equal doc_ids are in the order of their leaves, repeated
rows are leaves of their own (alike but for their place); a null language is a
language of its own; empty texts are hashed as they are; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscan.llm.common import stored

BITS = 10  # digits that are grouped away within a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a row, with some fields changed."""
    return digest(*[_field(changed.get(name, F.col(name))) for name in FIELDS])


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """lang, doc_id, hash, and seen: the hash of the row as it would be after
    1 is added to n_chars, where ``tampered`` holds."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1  # beyond a long, too
    return docs.select(
        "lang", F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("hash"),
        F.when(tampered, leaf(n_chars=more)).otherwise(F.lit(None)).alias("seen"))


def ranked(rows: DataFrame, key: list[str], order: list[str], purpose: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 among those with the same ``key``."""
    by = [F.col(c).asc_nulls_first() for c in (*key, *order)]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), purpose)
    # The place counts from 2 ** 33 times the number of its partition.
    placed = placed.withColumn("part", F.shiftright("place", 33))
    # A line for each partition and key in it: as many as partitions and keys.
    held = placed.groupBy("part", *key).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col("part").alias("of_part"), *[F.col(c).alias(f"of_{c}") for c in key], (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    same = F.col("part") == F.col("of_part")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return placed.join(held, same).select(*rows.columns, (F.col("place") + F.col("shift")).alias("rank"))


def _hashed(level: int) -> Column:
    """Is there more than one node to hash together on this level?  A first block that is not full is all its key has."""
    return (F.col("block") > 0) | (F.col("size") > (1 << level))


def trees(nodes: DataFrame, key: list[str]) -> DataFrame:
    """``key``, block, size, node of each block of ``nodes(key, rank, node)``; a node is (hash, kids or what the caller put there)."""
    digits = [f"digit_{level}" for level in range(BITS)]
    rows = nodes.select(*key, F.shiftright("rank", BITS).alias("block"), "node",
                        *[F.shiftright("rank", level).bitwiseAND(F.lit(1)).alias(d) for level, d in enumerate(digits)])
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(*key, "block")))
    for level, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("digit"), "node")))
        rows = rows.groupBy(*key, "block", "size", *digits[level + 1:]).agg(kids.alias("kids"))
        hashes = F.col("kids")["node"]["hash"]
        own = F.when(_hashed(level), F.sha2(F.concat_ws("", hashes), 256)).otherwise(F.get(hashes, F.lit(0)))
        rows = rows.select(*key, "block", "size", *digits[level + 1:], F.struct(own.alias("hash"), "kids").alias("node"))
    return rows


def tiers(nodes: DataFrame, key: list[str]) -> list[DataFrame]:
    """``nodes(key, rank, node)``, the blocks over them, and so on up to one node for each key."""
    levels = [nodes]
    while True:
        blocks = stored(trees(levels[-1], key).select(*key, F.col("block").alias("rank"), F.struct(F.col("node.hash").alias("hash")).alias("node")), "blocks")
        levels.append(blocks)
        if not blocks.where("rank > 0").limit(1).count():
            return levels


def _walk(level: int) -> Callable[[Column], Column]:
    """From a node to its kids, each with its way and its rank in the block so far."""
    def walk(row: Column) -> Column:
        kids = row["node"]["kids"]

        def step(kid: Column, i: Column) -> Column:
            beside = F.struct(F.get(kids, 1 - i)["node"]["hash"].alias("hash"), (i == 1).alias("left"))
            way = F.when(_hashed(level), F.concat(F.array(beside), row["way"])).otherwise(row["way"])
            return F.struct(kid["node"].alias("node"), way.alias("way"), (row["rank"] * 2 + kid["digit"]).alias("rank"))

        return F.transform(kids, step)

    return walk


def _ways(nodes: DataFrame, above: DataFrame, key: list[str]) -> DataFrame:
    """``key``, rank, node, way, top of ``nodes``: way holds, from the leaf up,
    the hash beside (null if there is none) and whether it is on the left.
    ``above(key, rank, way, top)`` says so of the blocks."""
    blocks = trees(nodes, key).select(*key, "block", "size", "node")
    both = blocks.unionByName(above.select(*key, F.col("rank").alias("block"), F.struct("way", "top").alias("up")), allowMissingColumns=True)
    met = both.groupBy(*key, "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "node", "up")])
    rows = F.array(F.struct("node", F.col("up.way").alias("way"), F.lit(0).cast("long").alias("rank")))
    for level in reversed(range(BITS)):
        rows = F.flatten(F.transform(rows, _walk(level)))
    met = met.select(*key, "block", "up", F.explode(rows).alias("row"))
    return met.select(*key, (F.shiftleft("block", BITS) + F.col("row.rank")).alias("rank"), "row.node", "row.way", F.col("up.top").alias("top"))


def proofs(levels: list[DataFrame], key: list[str], tops: DataFrame) -> DataFrame:
    """``key``, rank, node, way, top of the lowest of ``levels``; ``tops(key, way, top)`` says how each key goes on."""
    above = tops.withColumn("rank", F.lit(0).cast("long"))
    for nodes in reversed(levels[:-1]):
        above = _ways(nodes, above, key)
    return above


def fold(start: Column, way: Column) -> Column:
    """The root that a leaf's hash leads to."""
    return F.aggregate(way, start, lambda own, step: F.sha2(F.when(step["left"], F.concat(step["hash"], own)).otherwise(
        F.concat(own, F.coalesce(step["hash"], F.lit("")))), 256))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the row as it
    is where ``tampered`` holds), verified."""
    rows = ranked(leaves(docs, tampered), ["lang"], ["doc_id", "hash"], "leaves")
    levels = tiers(rows.select("lang", "rank", F.struct("hash", "doc_id", "seen").alias("node")), ["lang"])
    # The subroots are the leaves of one more tree.
    subroots = levels[-1].select(F.lit(0).alias("all"), "lang", F.col("node.hash").alias("hash"))
    over = tiers(ranked(subroots, ["all"], ["lang"], "subroots").select("all", "rank", F.struct("hash", "lang").alias("node")), ["all"])
    no_way = F.array().cast("array<struct<hash:string,left:boolean>>")
    tops = proofs(over, ["all"], over[-1].select("all", no_way.alias("way"), F.col("node.hash").alias("top")))
    tops = tops.select(F.col("node.lang").alias("lang"), "way", F.struct(F.col("node.hash").alias("subroot"), F.col("top").alias("root")).alias("top"))
    proved = proofs(levels, ["lang"], tops)
    return proved.select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.hash").alias("leaf"), "top.subroot", "top.root",
        F.sha2(F.concat_ws("", F.col("way")["hash"]), 256).alias("proof_sha256"),
        fold(F.coalesce("node.seen", "node.hash"), F.col("way")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
