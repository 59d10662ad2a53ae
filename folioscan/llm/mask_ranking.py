"""Ranked lexical search by presence masks.

The terms of a document are its runs of letters and digits (all characters
beyond ASCII count as letters), A-Z in lower case.  Each query item is ranked
against all documents by the integer score of :func:`impacts`, summed over the
item's terms, repeats included.

A first pass over the texts counts, for the terms of the items only, the
documents that hold them, and the documents and terms at all.  The second pass
works on bounded blocks of documents within the tasks:

* a bitmap for each term says which documents of the block hold it;
* the bitmaps of an item's terms, put side by side and packed, are the mask of
  each document; documents with the same mask are one group;
* a mask cannot score more than the sum of the greatest impacts its terms reach
  in the block.  Masks are evaluated by descending bound, until the bound falls
  below the item's tenth score so far.  Equal bounds are evaluated, since equal
  scores are told apart by doc_id.

A task gives back at most ``k`` documents for each item; texts are not
shuffled.  Items go in slices of about ``slice_terms`` terms, each two passes,
so that what a task holds of them is bounded for any number of items (one
item's terms are held together).

Defined results: a null or empty text has no terms, is not counted and never
found; items without terms give no rows; equal items are ranked each; equal
scores ascend by doc_id, rows without doc_id last; rows that repeat a doc_id
are documents of their own; extra columns are ignored; empty tables give no
rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscan.llm.common import as_bytes, blocks, stored

FOLD = bytes(32 if x < 0x30 or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x + 32 if 0x41 <= x <= 0x5A else x
             for x in range(256))
PIECE = 1 << 22  # bytes of a text that are split into words at a time
CELLS = 1 << 25  # bits of a block's bitmaps
DOCS, BLOCK_BYTES = 4096, 1 << 24  # documents and bytes of a block, at most
FIRST = 32  # documents evaluated first
DOCUMENTS, ALL_TERMS = -1, -2  # counters beside those of the terms
FOUND = "row long, doc_id long, score long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, long texts in pieces."""
    folded, begin = text.translate(FOLD), 0
    while begin < len(folded):
        end = folded.find(b" ", begin + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[begin:end].split()
        begin = end


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term adds to a document's score, once for each time the item has it."""
    m = 25 + (75 * length * documents) // all_terms
    return weights * ((10**9 * tf) // (1000 * tf + 8 * m))


def _counter(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches):
        holding, documents, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                n, seen = 0, set()
                for words in terms_of(text):
                    n += len(words)
                    seen.update(words)
                documents, total = documents + (n > 0), total + n
                for word in seen & vocabulary.keys():
                    holding[vocabulary[word]] += 1
        some = holding.nonzero()[0]
        keys, counts = [DOCUMENTS, ALL_TERMS, *some.tolist()], [documents, total, *holding[some].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["term", "n"])

    return count


class _Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((3, 0), np.int64)  # score, no doc_id, doc_id

    def least(self) -> int:
        """A score below which nothing enters."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else 1

    def add(self, scores: np.ndarray, nameless: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least()
        rows = np.concatenate([self.rows, np.stack([scores[some], nameless[some], ids[some]])], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks (as rows of bits) of a matrix (term, document), and which of them each document has."""
    packed = np.packbits(present, axis=0, bitorder="little")
    wide = np.zeros((present.shape[1], -(-len(packed) // 8) * 8), np.uint8)
    wide[:, : len(packed)] = packed.T
    keys = wide.view(np.uint64)[:, 0] if wide.shape[1] == 8 else wide.view(f"V{wide.shape[1]}")[:, 0]
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return present[:, first].T, which


class _Block:
    """Postings of a block of documents: sorted by term, then document."""

    def __init__(self, held: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = n_docs
        self.keys, self.tf = np.unique(held, return_counts=True)  # term * n_docs + document
        self.term, self.doc = np.divmod(self.keys, n_docs)
        self.present = np.zeros((n_terms, n_docs), bool)
        self.present[self.term, self.doc] = True

    def weigh(self, weights: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> None:
        self.impact = impacts(weights[self.term], self.tf, length[self.doc], documents, all_terms)
        self.most = np.zeros(len(self.present), np.int64)
        np.maximum.at(self.most, self.term, self.impact)

    def scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        keys = terms[:, None] * self.n_docs + docs
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (times[:, None] * np.where(self.keys[at] == keys, self.impact[at], 0)).sum(0)

    def rank(self, terms: np.ndarray, times: np.ndarray, nameless: np.ndarray, ids: np.ndarray, best: _Best) -> int:
        """Takes the block's documents into ``best``; gives the number of documents evaluated."""
        here = self.most[terms] > 0  # other terms add nothing to any document
        terms, times = terms[here], times[here]
        if not len(terms):
            return 0
        masks, which = _masks(self.present[terms])
        bounds = masks @ (times * self.most[terms])
        order = np.argsort(-bounds, kind="stable")
        docs = np.argsort(which, kind="stable")
        sizes = np.bincount(which, minlength=len(masks))
        ends = np.cumsum(sizes)
        step, at, done = FIRST, 0, 0
        while at < len(order) and bounds[order[at]] >= best.least():
            to = at + 1 + int(np.searchsorted(np.cumsum(sizes[order[at:]]), step))
            some = [m for m in order[at:to] if bounds[m] >= best.least()]
            group = np.concatenate([docs[ends[m] - sizes[m]:ends[m]] for m in some])
            best.add(self.scores(group, terms, times), nameless[group], ids[group])
            at, step, done = to, step * 4, done + len(group)
        return done


def _ranker(vocabulary: dict[bytes, int], items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int,
            all_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_docs = max(64, min(DOCS, CELLS // max(1, len(vocabulary))))

    def rank(batches):
        best = [_Best(k) for _ in items]

        def take(texts: list[bytes], ids: np.ndarray, nameless: np.ndarray) -> None:
            held, length = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                for words in terms_of(text):
                    length[i] += len(words)
                    held.append(np.array([vocabulary[w] for w in words if w in vocabulary], np.int64) * len(texts) + i)
            postings = np.concatenate(held)
            if len(postings):
                block = _Block(postings, len(texts), len(vocabulary))
                block.weigh(weights, length, documents, all_terms)
                for (_, terms, times), so_far in zip(items, best):
                    block.rank(terms, times, nameless, ids, so_far)

        for batch in batches:
            texts, ids = as_bytes(batch.column("text")), batch.column("doc_id")
            nameless = np.asarray(ids.is_null()).astype(np.int64)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for begin, end in blocks([len(t) for t in texts], BLOCK_BYTES):
                for low in range(begin, end, n_docs):
                    high = min(end, low + n_docs)
                    take(texts[low:high], known[low:high], nameless[low:high])
        for (row, _, _), found in zip(items, best):
            score, unnamed, doc = found.rows
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(score), pa.int64()), pa.array(doc, mask=unnamed.astype(bool)), pa.array(score)], ["row", "doc_id", "score"])

    return rank


def _slice_ranks(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame | None:
    vocabulary: dict[bytes, int] = {}
    asked = []
    for row, text in items:
        times = Counter(word for words in terms_of(text) for word in words)
        if times:
            asked.append((row, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in times]), np.array(list(times.values()))))
    counts = docs.select("text").mapInArrow(_counter(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = {r["term"]: r["n"] for r in counts.collect()}  # a row for each term of the slice
    documents, all_terms = known.get(DOCUMENTS, 0), known.get(ALL_TERMS, 0)
    if not asked or not documents:
        return None
    weights = np.array([weight(documents, known.get(i, 0)) for i in range(len(vocabulary))])
    return docs.mapInArrow(_ranker(vocabulary, asked, weights, documents, all_terms, k), FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, slice_terms: int = 1 << 17) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item with a score above zero."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = stored(items.select(F.monotonically_increasing_id().alias("row"), "item_id", F.coalesce("text", F.lit("")).alias("text")), "items")
    # A term has a character and a break at least.
    size = asked.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    slices = max(1, math.ceil(size / slice_terms))
    found = []
    for i in range(slices):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == i)
        ranked = _slice_ranks(rows, [(r["row"], r["text"].encode()) for r in some.select("row", "text").collect()], k)
        if ranked is not None:
            found.append(ranked)
    best = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
