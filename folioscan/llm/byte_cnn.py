"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into chunks of 256 bytes that overlap by half and cover it
from end to end.  Each byte has a learned vector, learned filters look at six
bytes at a time, each filter's largest response in a chunk is kept, a small
dense layer turns a chunk's responses into evidence, and the mean and the
maximum of the evidence over all chunks give one probability.

The network is fitted on a bounded sample of labelled rows (``per_class`` rows
of each label, chosen by a hash of doc_id, and ``fit_chunks`` chunks of each,
spread over its whole length); scoring reads every byte of every document.

Defined results: a null or empty text is scored as one zero byte; rows without
doc_id are scored but never learned from; repeated rows are scored one by one;
a doc_id with several labels counts with their mean, rounded half up; labels
other than 0 and 1 are ignored.  Without labels of both classes every score is
(n1 + 1) / (n + 2), n labels of which n1 are 1.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folioscan.llm.common import as_bytes, blocks, crc_class, stored

WIDTH, VECTOR, FILTERS, EVIDENCE = 6, 8, 16, 8
HALF = 128  # bytes; a chunk is two halves
SLAB = 1 << 17  # bytes whose responses are in memory at once
ACCEPT = 0.7
SHORT = 0.2  # share of the steps' texts that are cropped


@dataclass
class ByteCNN:
    """Parameters by name; none if it could not be fitted, then ``prior`` is every score."""

    prior: float
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def fitted(self) -> bool:
        return bool(self.parameters)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    shapes = {"bytes": (256, VECTOR), "filters": (WIDTH * VECTOR, FILTERS), "filter_bias": (FILTERS,),
              "dense": (FILTERS, EVIDENCE), "dense_bias": (EVIDENCE,), "out": (2 * EVIDENCE,), "out_bias": (1,)}
    scale = {"bytes": 1.0, "filters": (WIDTH * VECTOR) ** -0.5, "dense": FILTERS ** -0.5, "out": 0.3}
    return {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes.items()}


def _responses(vectors: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Filter responses at each position that has ``WIDTH`` bytes.  Windows of
    one phase lie side by side, so each phase is one matrix product."""
    n = len(vectors) - WIDTH + 1
    out = np.empty((n, FILTERS), np.float32)
    for phase in range(min(WIDTH, n)):
        count = (n - phase + WIDTH - 1) // WIDTH
        windows = vectors[phase:phase + count * WIDTH].reshape(count, WIDTH * VECTOR)
        out[phase::WIDTH] = windows @ filters
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _pooled(model: ByteCNN, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The largest responses in each half chunk, and each text's number of halves."""
    p = model.parameters
    lengths = np.array([max(1, len(t)) for t in texts])
    pad = b"\0" * (WIDTH - 1)
    joined = np.frombuffer(b"".join((t or b"\0") + pad for t in texts) + b"\0", np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths + len(pad))[:-1]])
    halves = -(-lengths // HALF)
    first = np.concatenate([[0], np.cumsum(halves)[:-1]])
    place = np.arange(halves.sum()) - np.repeat(first, halves)
    start = np.repeat(begins, halves) + place * HALF
    end = np.minimum(start + HALF, np.repeat(begins + lengths, halves))
    out = np.empty((len(start), FILTERS), np.float32)
    for a, b in blocks((end - start).tolist(), SLAB):
        low, high = start[a], end[b - 1]
        # one position more, as reduceat wants each bound inside the array
        responses = _responses(p["bytes"][joined[low:high + WIDTH]], p["filters"])
        bounds = np.stack([start[a:b], end[a:b]], 1).ravel() - low
        out[a:b] = np.maximum.reduceat(responses, bounds, axis=0)[::2]
    return out, halves


def probabilities(model: ByteCNN, texts: list[bytes]) -> np.ndarray:
    """One probability for each text."""
    if not model.fitted or not texts:
        return np.full(len(texts), model.prior)
    p = model.parameters
    result = []
    for a, b in blocks([len(t) for t in texts], 1 << 22):
        pooled, halves = _pooled(model, texts[a:b])
        last = np.cumsum(halves) - 1
        keep = np.ones(len(pooled), bool)
        keep[last[halves > 1]] = False  # chunk i is half i and half i + 1
        joined = pooled.copy()
        joined[:-1][keep[:-1]] = np.maximum(pooled[:-1], pooled[1:])[keep[:-1]]
        lone = last[halves == 1]
        joined[lone] = pooled[lone]
        chunks = joined[keep]
        counts = np.maximum(1, halves - 1)
        evidence = np.maximum(0, np.maximum(0, chunks + p["filter_bias"]) @ p["dense"] + p["dense_bias"])
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(evidence, at, axis=0) / counts[:, None]
        most = np.maximum.reduceat(evidence, at, axis=0)
        result.append(_sigmoid((np.concatenate([mean, most], 1) @ p["out"] + p["out_bias"]).astype(np.float64)))
    return np.concatenate(result)


def _chunks(text: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` chunks spread evenly over a text, and their valid positions."""
    text = text or b"\0"
    count = max(1, -(-len(text) // HALF) - 1)
    chosen = np.unique(np.linspace(0, count - 1, min(count, most)).round().astype(int))
    rows = np.zeros((len(chosen), 2 * HALF + WIDTH - 1), np.uint8)
    for row, c in zip(rows, chosen):
        piece = np.frombuffer(text, np.uint8)[c * HALF:c * HALF + rows.shape[1]]
        row[:len(piece)] = piece
    return rows, np.minimum(2 * HALF, len(text) - chosen * HALF)


def _crop(length: int, rng: np.random.Generator) -> slice:
    """8 to 300 bytes out of a text of ``length`` bytes, more often few than many."""
    size = int(8 * (300 / 8) ** rng.random())
    begin = int(rng.integers(0, max(1, length - size + 1)))
    return slice(begin, begin + size)


Cuts = list[tuple[np.ndarray, np.ndarray]]


def fit(lengths: list[int], cuts: Callable[[list[slice]], tuple[Cuts, Cuts]], labels: np.ndarray, weights: np.ndarray,
        steps: int = 480, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the weighted cross entropy, as many steps for any number of texts,
    of which only ``lengths`` and what ``cuts`` gives are seen: the chunks of
    each, and those of its crop, which is passed."""
    rng = np.random.default_rng(seed)
    p = _start(rng)
    cut, short = cuts([_crop(n, rng) for n in lengths])  # short texts are few, and as good as long ones
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    queue = np.zeros(0, int)
    for step in range(1, steps + 1):
        while len(queue) < batch:
            queue = np.concatenate([queue, rng.permutation(len(lengths))])
        rows, queue = queue[:batch], queue[batch:]
        lowered = rate * (1 if 3 * step < 2 * steps else 0.25)
        for k, g in _gradients(p, [(short if rng.random() < SHORT else cut)[r] for r in rows], labels[rows], weights[rows]).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[k] -= lowered * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p


def _gradients(p: dict, cut: list, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    x = np.concatenate([c[0] for c in cut])
    valid = np.concatenate([c[1] for c in cut])
    counts = np.array([len(c[0]) for c in cut])
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(cut)), counts)
    n, length = x.shape
    flat = np.concatenate([x.ravel(), np.zeros(WIDTH - 1, np.uint8)])
    vectors = p["bytes"][flat]
    responses = _responses(vectors, p["filters"]).reshape(n, length, FILTERS)[:, :2 * HALF]
    responses[np.arange(2 * HALF)[None] >= valid[:, None]] = -1e9
    best = responses.argmax(1)
    pooled = np.take_along_axis(responses, best[:, None], 1)[:, 0]
    seen = np.maximum(0, pooled + p["filter_bias"])
    evidence = np.maximum(0, seen @ p["dense"] + p["dense_bias"])
    mean = np.add.reduceat(evidence, at, axis=0) / counts[:, None]
    most = np.maximum.reduceat(evidence, at, axis=0)
    both = np.concatenate([mean, most], 1)
    wrong = ((_sigmoid(both @ p["out"] + p["out_bias"]) - labels) * weights / weights.sum()).astype(np.float32)

    to_both = wrong[:, None] * p["out"]
    is_most = evidence == most[owner]
    ties = np.add.reduceat(is_most.astype(np.float32), at, axis=0)
    to_evidence = to_both[owner, :EVIDENCE] / counts[owner, None] + is_most / ties[owner] * to_both[owner, EVIDENCE:]
    to_evidence = to_evidence * (evidence > 0)
    to_pooled = (to_evidence @ p["dense"].T) * (seen > 0)
    position = (np.arange(n)[:, None] * length + best).ravel()
    windows = position[:, None] + np.arange(WIDTH)
    codes = flat[windows]
    given = p["bytes"][codes].reshape(n, FILTERS, WIDTH * VECTOR)
    grads = {
        "filters": np.einsum("nfk,nf->kf", given, to_pooled, optimize=True), "filter_bias": to_pooled.sum(0),
        "dense": seen.T @ to_evidence, "dense_bias": to_evidence.sum(0),
        "out": both.T @ wrong, "out_bias": wrong.sum(keepdims=True),
    }
    to_vectors = (to_pooled.ravel()[:, None] * np.tile(p["filters"].T, (n, 1))).reshape(-1, VECTOR)
    grads["bytes"] = np.zeros_like(p["bytes"])
    for v in range(VECTOR):
        grads["bytes"][:, v] = np.bincount(codes.ravel(), to_vectors[:, v], 256)
    return grads


def _cutter(crops: dict, fit_chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text its chunks and those of its crop, and their valid positions, as bytes."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            cut = [[a.tobytes() for part in (t, t[crops[i]]) for a in _chunks(part, fit_chunks)]
                   for i, t in zip(ids.to_pylist(), as_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array([c[k] for c in cut], pa.binary()) for k in range(4))], ["doc_id", "rows", "valid", "short_rows", "short_valid"])

    return run


def _uncut(rows: bytes, valid: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(rows, np.uint8).reshape(-1, 2 * HALF + WIDTH - 1), np.frombuffer(valid, np.int64)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, fit_chunks: int = 16,
          left_out: tuple[int, int] = (4, 2), seed: int = 7) -> ByteCNN:
    """Fits the network to ``labels(doc_id, quality)`` of rows whose crc32 class
    is not held out.  ``per_class`` bounds the rows that are collected, ``fit_chunks``
    their size: texts are cut in the tasks.  Of rows that repeat a doc_id the
    one with the greatest text counts."""
    classes, held = left_out
    known = (
        labels.where(F.col("quality").isin(0, 1) & (crc_class("doc_id", classes) != held))
        .groupBy("doc_id").agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("quality"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return ByteCNN(prior)
    # The first by hash of each label: tasks give no more than these back.
    chosen = reduce(DataFrame.unionByName, [
        known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class) for label in (0, 1)])
    # 2 * per_class rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text")), "sample")
    sized = sorted(sample.select("doc_id", "quality", F.octet_length("text").alias("size")).collect(), key=lambda r: r["doc_id"])
    schema = T.StructType([sample.schema["doc_id"], *(T.StructField(c, T.BinaryType()) for c in ("rows", "valid", "short_rows", "short_valid"))])

    def cuts(crops: list[slice]) -> tuple[Cuts, Cuts]:
        by_doc = {r["doc_id"]: crop for r, crop in zip(sized, crops)}
        got = sorted(sample.select("doc_id", "text").mapInArrow(_cutter(by_doc, fit_chunks), schema).collect(), key=lambda r: r["doc_id"])
        return [_uncut(r["rows"], r["valid"]) for r in got], [_uncut(r["short_rows"], r["short_valid"]) for r in got]

    marks = np.array([r["quality"] for r in sized], np.float32)
    share = {q: counts[q] / max(1, int((marks == q).sum())) for q in (0, 1)}
    weights = np.array([share[int(m)] for m in marks], np.float32)
    return ByteCNN(prior, fit([r["size"] for r in sized], cuts, marks, weights / weights.mean(), seed=seed))


def _scorer(model: ByteCNN) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            score = probabilities(model, as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()),
                 pa.array((score >= ACCEPT).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])
    return run


def quality_scores(docs: DataFrame, model: ByteCNN, left_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    classes, held = left_out
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc_class("doc_id", classes) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def _accepted(model: ByteCNN, columns: list[str]) -> Callable:
    def run(batches):
        for batch in batches:
            score = probabilities(model, as_bytes(batch.column("text")))
            yield batch.filter(pa.array(score >= ACCEPT))
    return run


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the network accepts, all columns kept.  If there
    are no labels of both classes nothing can be told apart, and all rows stay."""
    model = learn(docs, labels, **options)
    return docs.mapInArrow(_accepted(model, docs.columns), docs.schema) if model.fitted else docs
