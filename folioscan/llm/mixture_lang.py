"""Language identification as inference of a mixture.

Each language has a distribution over trigrams of letters, counted over all
documents it may be learned from.  A document's trigrams are taken as a mixture
of languages; expectation-maximisation finds the proportions.  Which languages
a document has is chosen by penalised likelihood: in the order of their
proportions, a language is taken in as long as the likelihood of the larger set
is higher by more than a penalty that grows with the logarithm of the length.

Trigrams are of UTF-8 bytes in lower case, everything else in ASCII being a
space, hashed to ``BUCKETS`` places.  Counts are summed within each task before
they are shuffled, so that their shuffle is bounded by tasks, languages and
buckets; the model has ``BUCKETS`` numbers for each language.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is everything if nothing can be learned; rows without a language, text or
doc_id are not learned from; repeated rows are predicted one by one; of equally
likely languages the first by name is predicted; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscan.llm.common import blocks, crc_class

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 6.0
ROUNDS = 12
SLICE = 1 << 21  # bytes of a text that are counted at once
LETTER = re.compile(r"[^\W\d_]")  # and numerals such as ½, which are no letters

_KEPT = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of a text in lower case whose middle is not a space."""
    seen = _KEPT[np.frombuffer(b" " + text + b" ", np.uint8)]
    seen = seen[np.r_[True, (seen[1:] != 0x20) | (seen[:-1] != 0x20)]].astype(np.uint32)
    code = (seen[:-2] << np.uint32(16) | seen[1:-1] << np.uint32(8) | seen[2:])[seen[1:-1] != 0x20]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint32)


def _slices(text: bytes) -> list[bytes]:
    return [text[a:a + SLICE + 2] for a in range(0, max(1, len(text)), SLICE)]


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of all texts, in order."""
    out = []
    for a, b in blocks([len(t) for t in texts], SLICE):
        if b == a + 1 and len(texts[a]) > SLICE:
            sums = sum(np.bincount(trigrams(s), minlength=BUCKETS) for s in _slices(texts[a]))
            bucket = np.flatnonzero(sums)
            out.append((np.full(len(bucket), a), bucket, sums[bucket]))
            continue
        for low in range(a, b, BUCKETS):  # so that a text's number fits beside a bucket
            each = [trigrams(t) for t in texts[low:min(b, low + BUCKETS)]]
            owner = np.repeat(np.arange(len(each), dtype=np.uint32), [len(x) for x in each])
            keys = np.sort(owner << np.uint32(16) | np.concatenate(each))
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            unique = keys[first]
            out.append(((unique >> np.uint32(16)).astype(np.int64) + low, (unique & np.uint32(BUCKETS - 1)).astype(np.int64),
                        np.diff(np.r_[first, len(keys)])))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Languages:
    names: list[str]
    chance: np.ndarray  # (bucket, language)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for piece in _slices(text.lower().encode()):
                found = trigrams(piece)
                if len(found) > BUCKETS // 8:
                    sums[lang] += np.bincount(found, minlength=BUCKETS)
                else:
                    np.add.at(sums[lang], found, 1)
    for lang, values in sorted(sums.items()):
        bucket = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(values[bucket])], ["lang", "bucket", "n"])


def learn(docs: DataFrame, left_out: tuple[int, int] = (5, 0)) -> Languages:
    """Trigram chances by language, from all rows that are not held out."""
    classes, held = left_out
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_class("doc_id", classes) != held)).select("lang", "text")
    counts = (rows.mapInArrow(_count_batches, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())  # BUCKETS rows a language at most
    lang = np.array(counts.column("lang").to_pylist(), object)
    names = sorted(set(lang))
    table = np.zeros((BUCKETS, len(names)))
    at = {name: i for i, name in enumerate(names)}
    table[counts.column("bucket").to_numpy(), [at[x] for x in lang]] = counts.column("n").to_numpy()
    used = max(1, int((table.sum(1) > 0).sum()))
    chance = (table + SMOOTHING) / (table.sum(0) + SMOOTHING * used) if names else table
    return Languages(names, chance.astype(np.float32))


def mixture(chance: np.ndarray, count: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once.  ``chance``: of each of their trigrams in
    each language; ``starts``: where a document's trigrams begin; ``share``: the
    proportions to begin with.  Proportions and log likelihoods."""
    sizes = np.diff(np.r_[starts, len(count)])
    total = np.add.reduceat(count, starts)[:, None]
    for _ in range(rounds):
        part = np.repeat(share, sizes, axis=0) * chance
        part *= (count / part.sum(1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total
    mixed = (np.repeat(share, sizes, axis=0) * chance).sum(1)
    return share, np.add.reduceat(count * np.log(np.maximum(mixed, 1e-30)), starts)


def infer(model: Languages, texts: list[str | None]) -> list[tuple[str, float, str]]:
    """(language, score, proportions) of each text."""
    unknown = ("und", 0.0, "")
    results = [unknown] * len(texts)
    if not model.names:
        return results
    known = [i for i, t in enumerate(texts) if t and any(c.group().isalpha() for c in LETTER.finditer(t))]
    for a, b in blocks([len(texts[i]) for i in known], 1 << 20):
        mine = known[a:b]
        owner, bucket, count = counted([texts[i].lower().encode() for i in mine])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        present = owner[starts]  # every text with a letter has a trigram
        chance, count = model.chance[bucket].astype(np.float64), count.astype(np.float64)
        single = np.stack([np.add.reduceat(count * np.log(chance[:, k]), starts) for k in range(len(model.names))], 1)
        uniform = np.full(single.shape, 1 / single.shape[1])
        share, _ = mixture(chance, count, starts, uniform)
        rank = np.argsort(-share, axis=1, kind="stable")
        best = single.argmax(1)
        # The first of a set of one is the likeliest single language.
        at = np.arange(len(best))
        for row in at[rank[:, 0] != best]:
            rank[row] = [best[row], *(k for k in rank[row] if k != best[row])]
        final = np.zeros_like(share)
        final[at, best] = 1
        score = single[at, best]
        sizes = np.diff(np.r_[starts, len(count)])
        penalty = PENALTY * np.log(1 + np.add.reduceat(count, starts))
        open_rows = at
        for k in range(2, len(model.names) + 1):
            if not len(open_rows):
                break
            member = np.zeros((len(open_rows), share.shape[1]), bool)
            np.put_along_axis(member, rank[open_rows, :k], True, 1)
            begin = np.maximum(share[open_rows], 1e-3) * member
            lines = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[open_rows], sizes[open_rows])])
            new_starts = np.r_[0, np.cumsum(sizes[open_rows])[:-1]]
            mixed, likelihood = mixture(chance[lines], count[lines], new_starts, begin / begin.sum(1, keepdims=True))
            better = likelihood - score[open_rows] > penalty[open_rows]
            taken = open_rows[better]
            final[taken], score[taken] = mixed[better], likelihood[better]
            open_rows = taken
        odds = np.exp(np.maximum(single - single.max(1, keepdims=True), -700))
        odds /= odds.sum(1, keepdims=True)
        for row, text in enumerate(present):
            top = int(final[row].argmax())
            shares = ",".join(f"{model.names[k]}:{final[row, k]:.3f}" for k in np.argsort(-final[row], kind="stable") if final[row, k] > 0)
            sure = float(odds[row, top]) if (final[row] > 0).sum() == 1 else 1.0
            results[mine[text]] = (model.names[top], min(1.0, float(final[row, top]) * sure), shares)
    return results


def _predictor(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            found = infer(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.string())],
                ["doc_id", "held_out", "lang_pred", "score", "proportions"])

    return run


def languages(docs: DataFrame, model: Languages, left_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions of every row."""
    classes, held = left_out
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(crc_class("doc_id", classes) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double, proportions string")
