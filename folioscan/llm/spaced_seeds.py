"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words that looks at some of them and
ignores the others, so that a changed word at an ignored place changes nothing.
The hash of what each mask sees at each place of a document is joined with the
same hashes of the benchmark.  Around a hit the words of document and item are
compared one by one, without shifts: over ``OVERLAP`` words of the item (all,
if it has fewer) with the hit in the middle, at least ``SIMILAR`` of them must
be equal.

Items of more than ``OVERLAP`` words have three masks that see six of nine words.
Shorter ones have the five masks that see four of five: an item of n words may
differ in n / 5 of them and holds as many runs of five side by side, so one run
has at most one changed word.  No overlap of such an item is missed.

Everything is DataFrame and SQL functions.  Texts are never shuffled: the
benchmark's hashes are broadcast in slices of ``slice_rows`` rows at most, each
with the words compared around it and no others, so that what is broadcast is
bounded for a benchmark of any size and items of any length.  Each slice reads
the texts once, as do short and long items.  Hits are compared in the loop that
finds them, so a word that repeats all over a text costs time, not rows; only
verified overlaps are shuffled.

Defined results: words are runs of letters and digits (all characters beyond
ASCII count as letters) in lower case; items of fewer than five words, null or
empty texts match nothing; equal items are reported each; rows that repeat a doc_id are reported
as one document, rows without doc_id under null; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.llm.common import numbered, row_name, stored

SPAN = 9
MASKS = ("111010011", "110101101", "101101011")
SHORT_SPAN = 5
SHORT_MASKS = ("11110", "11101", "11011", "10111", "01111")
LEAST_WORDS, OVERLAP, SIMILAR = 5, 20, 0.8
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), BREAKS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """A line (..., at, seed) for each place of ``rows(..., hashes)`` and each of
    ``masks``, which are equally long.  No branches and no lambdas, so that all
    up to the join with the benchmark is one generated loop over a row."""
    last = F.size("hashes") - len(masks[0])
    places = rows.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    seen = [F.xxhash64(F.lit(mask), *[F.get("hashes", F.col("at") + k) for k, c in enumerate(mask) if c == "1"]) for mask in masks]
    return places.select("*", F.explode(F.array(*seen)).alias("seed"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id and word hashes of items with enough words, stored."""
    items = benchmark.select("item_id", _word_hashes(F.coalesce("text", F.lit(""))).alias("hashes"))
    return stored(items.where(F.size("hashes") >= LEAST_WORDS).distinct(), "items")


def _hits(rows: DataFrame, items: DataFrame, masks: tuple[str, ...], slice_rows: int) -> DataFrame:
    # With a seed go only the words that are compared around it.
    size = F.size("hashes")
    n = F.least(size, F.lit(OVERLAP))
    low = F.greatest(F.lit(0), F.least(F.col("at") + (len(masks[0]) // 2 - OVERLAP // 2), size - n))
    seeds = stored(_seeds(items, masks).select("seed", "item_id", F.col("at").alias("item_at"), low.alias("low"), F.slice("hashes", low + 1, n).alias("item")), "seeds")
    slices = max(1, math.ceil(seeds.count() / slice_rows))
    places = _seeds(rows, masks)
    # About `slice_rows` seeds, each with OVERLAP words at most.
    found = [places.join(F.broadcast(
        seeds if slices == 1 else seeds.where(F.pmod(F.xxhash64("seed", "item_id", "item_at"), F.lit(slices)) == i)), "seed")
        for i in range(slices)]
    # Word by word without a lambda, so that it stays in the generated loop and no hit carries its text's hashes along.
    start = F.col("at") - F.col("item_at") + F.col("low")
    same = sum((F.when(F.get("hashes", start + k) == F.get("item", F.lit(k)), 1).otherwise(0) for k in range(OVERLAP)), F.lit(0))
    return reduce(DataFrame.unionByName, found).select(
        "doc_id", "item_id", start.alias("start"), F.size("item").alias("n_words"), same.alias("n_same"))


def overlaps(docs: DataFrame, benchmark: DataFrame, slice_rows: int = 50_000) -> DataFrame:
    """doc_id, item_id, start (the document's word that the compared words begin
    at), n_words, n_same, similarity: the best verified overlap of each pair."""
    items = benchmark_items(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _word_hashes(F.coalesce("text", F.lit(""))).alias("hashes"))
    short = F.size("hashes") <= OVERLAP
    kinds = [(some, masks) for some, masks in ((short, SHORT_MASKS), (~short, MASKS)) if items.where(some).limit(1).count()]
    hits = reduce(DataFrame.unionByName, [_hits(rows, items.where(some), masks, slice_rows) for some, masks in kinds or [(~short, MASKS)]])
    # Filtered after the sums: a filter before would move into the join and out of the generated loop.
    best = F.max(F.struct((F.col("n_same") / F.col("n_words")).alias("similarity"), (-F.col("start")).alias("back"), "n_words", "n_same"))
    return (hits.groupBy("doc_id", "item_id").agg(best.alias("best")).where(F.col("best.similarity") >= SIMILAR)
            .select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.n_words", "best.n_same", "best.similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without an overlap, all columns kept.  Each row is judged by its
    own text, whatever rows share its doc_id or have none."""
    rows, row = numbered(docs, "rows"), row_name(docs)
    found = stored(overlaps(rows.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return rows.join(found, row, "left_anti").select(docs.columns)
