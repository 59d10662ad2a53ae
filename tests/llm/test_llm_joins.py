"""Grouped prefix join, Merkle rollup and mask ranking against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from folioscan.llm import group_join as gj, mask_ranking as mk, merkle_rollup as mr
from folioscan.llm.common import crc_class

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("rank", T.StringType()),
                     T.StructField("class", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("token", T.DoubleType())])


def table(spark, texts, ids=None, langs=None, sources=None, chars=None):
    """Documents with columns whose names the operators use themselves."""
    n = len(texts)
    rows = zip(ids or range(n), texts, langs or ["en"] * n, sources or ["s"] * n, chars or [len(t or "") for t in texts], "x" * n, "y" * n, [7] * n, [0.5] * n)
    return spark.createDataFrame(list(rows), DOCS).repartition(3)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# op11

def shingles(text):
    words = re.split(r"[\x20\x09-\x0D]+", lowered(text or ""))
    words = [w for w in words if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def joined(texts, ids):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, k in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[k])
        if sets[i] and sets[k] and 100 * common >= 80 * len(sets[i] | sets[k]):
            root[find(i)] = find(k)
    least = [min((ids[k] for k in range(len(texts)) if find(k) == find(i) and ids[k] is not None), default=None) if sets[i] else ids[i] for i in range(len(texts))]
    return sorted(((ids[i], len(sets[i]), least[i]) for i in range(len(texts))), key=str)


def mixed_texts(r, n):
    """Copies that differ more and less, chains of them, passages in common."""
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "Ünï"]
    passage = " ".join(f"p{i}" for i in range(55))
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.6 and texts:
            words = (r.choice(texts) or "").split(" ")
            for _ in range(r.randint(0, 5)):
                at = r.randrange(len(words) + 1)
                words[at:at + r.randint(0, 1)] = [r.choice(vocabulary)]
            texts.append(" ".join(words))
        else:
            own = " ".join(r.choice(vocabulary) for _ in range(r.choice((1, 3, 5, 6, 20, 60, 200))))
            texts.append(f"{passage} {own} {passage}" if kind > 0.9 else own)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_group_join(spark, seed):
    r = random.Random(seed)
    texts = mixed_texts(r, 180)
    texts += [None, "", " \n\t", "a b c", "A  b\tC", "a b c d", "one two three four five", "x\x85y z", "x y z", texts[3], texts[3]]
    texts += ["long " + " ".join(f"v{i % 977}x{i}" for i in range(60_000)), "long " + " ".join(f"v{i % 977}x{i}" for i in range(57_000))]
    ids = [5 * i % 1009 for i in range(len(texts))]
    ids[10] = ids[11] = None
    ids[20] = ids[21]
    got = gj.near_duplicates(table(spark, texts, ids))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == joined(texts, ids)


def test_group_join_of_nothing(spark):
    assert gj.near_duplicates(table(spark, [])).collect() == []
    assert [tuple(r) for r in gj.near_duplicates(table(spark, [None], [4])).collect()] == [(4, 0, 4)]


def test_group_join_of_a_dense_cluster(spark, monkeypatch):
    """Copies around one text, about as far from each other as links go; few neighbours, so that most is left to the lists."""
    monkeypatch.setattr(gj, "TURNS", 1)
    monkeypatch.setattr(gj, "TILE", 3)
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in r.sample(range(120), r.randint(1, 4)):
            words[at] = f"c{r.randrange(4)}"
        texts.append(" ".join(words))
    ids = list(range(len(texts)))
    assert sorted((tuple(x) for x in gj.near_duplicates(table(spark, texts)).collect()), key=str) == joined(texts, ids)


def test_prefixes_share_enough():
    """Of linked sets, in any order of shingles."""
    r = random.Random(4)
    for _ in range(3000):
        n = r.randint(1, 60)
        a = set(range(n))
        b = set(r.sample(range(n), r.randint(max(1, 4 * n // 5), n))) | {n + i for i in range(r.randint(0, n // 5))}
        if 5 * len(a & b) < 4 * len(a | b):
            continue
        order = {x: r.random() for x in a | b}
        first = [set(sorted(s, key=order.get)[: gj.prefix_length(len(s))]) for s in (a, b)]
        for s in (a, b):
            assert len(first[0] & first[1]) >= len(s) // 10 + 1


def test_parity_bits_differ_no_more_than_sets():
    r = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 64, r.integers(1, 900), np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.9], r.integers(0, 1 << 64, r.integers(0, 60), np.uint64)])
        bits = int(np.bitwise_count((gj._parity(a) ^ gj._parity(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_word_hashes():
    begins, hashes = gj.word_hashes("Ab aB  ab\nabc é ".encode())
    assert begins.tolist() == [0, 3, 7, 10, 14] and len(set(hashes.tolist())) == 3 and len(set(hashes[:3].tolist())) == 1
    text = ("wörd " * 400_000).encode()
    assert len(gj._long_words(text)) == 400_000 and len(next(gj.shingle_sets([text]))) == 1
    words = {f"{a}{b}" for a in "abcdefgh" for b in range(2000)}
    assert len(set(gj.word_hashes(" ".join(words).encode())[1].tolist())) == len(words)


# op12

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(level):
    """(root, for each leaf its way as (hash beside or None, is it on the left))."""
    ways = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            beside = k ^ 1
            ways[i].append((level[beside] if beside < len(level) else None, beside < k))
            at[i] = k // 2
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], ways


def manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    root, tops = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for row, way in zip(groups[lang], trees[lang][1]):
            way = way + top
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            own = leaf((*row[:3], row[3] + 1, row[4])) if tampered else leaf(row)
            for beside, left in way:
                own = h(beside, own) if left else h(own, beside or "")
            out.append((row[0], leaf(row), trees[lang][0], root, h(*[b for b, _ in way if b]), own, own == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,n", [(2, 75), (10, 75), (1, 9), (3, 8)])
def test_manifest(spark, monkeypatch, bits, n):
    monkeypatch.setattr(mr, "BITS", bits)
    r = random.Random(n)
    texts = [r.choice(("", "é ß", "plain", None, "a" * 5000)) for _ in range(n)]
    langs = [r.choice((None, "en", "de", "", "é", "z", "en")) for _ in range(n)]
    ids = [r.choice((3 * i, i)) for i in range(n)]
    chars = [r.choice((None, 0, 12, (1 << 63) - 1)) for _ in range(n)]
    sources = [r.choice((None, "src:1", "")) for _ in range(n)]
    if n > 20:
        ids[4] = ids[5] = None
        ids[7], texts[7], langs[7], chars[7], sources[7] = ids[8], texts[8], langs[8], chars[8], sources[8]  # the same row twice
    docs = table(spark, texts, ids, langs, sources, chars)
    got = mr.manifest(docs, crc_class("doc_id", 7) == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == manifest(list(zip(ids, sources, langs, chars, texts)))


def test_manifest_of_one_and_of_nothing(spark):
    row = mr.manifest(table(spark, ["x"], [7]), F.lit(False)).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h() and row["verified"]
    assert mr.manifest(table(spark, []), F.lit(False)).collect() == []


def test_ranks_go_on_over_partitions(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'b' ELSE 'c' END AS k", "id DIV 7 AS v", "id AS w")
    got = mr.ranked(rows, ["k"], ["v", "w"], "ranks").collect()
    for k in (None, "b", "c"):
        own = sorted((r["v"], r["w"], r["rank"]) for r in got if r["k"] == k)
        assert [r for _, _, r in own] == list(range(len(own)))


# op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(docs, items, k=10):
    terms = [TERM.findall(lowered(t or "")) for _, t in docs]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), own in zip(docs, terms):
            tf, score = Counter(own), 0
            for w in TERM.findall(lowered(text or "")):
                if tf[w]:
                    m = 25 + (75 * len(own) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, doc_id, -score) for i, (score, _, _, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x")).withColumn("score", F.lit(1))


@pytest.mark.parametrize("seed,slice_terms,docs_a_block", [(1, 1 << 17, 4096), (2, 40, 64)])
def test_ranking(spark, monkeypatch, seed, slice_terms, docs_a_block):
    monkeypatch.setattr(mk, "DOCS", docs_a_block)
    r = random.Random(seed)
    words = [f"t{i}" for i in range(80)] + ["Éa", "ß9", "the"]
    texts = [r.choice((" ", "-", ", ")).join(r.choice(words) if r.random() < 0.7 else "the" for _ in range(r.choice((1, 4, 30, 90)))) for _ in range(400)]
    texts += [None, "", "?!", texts[0], texts[0], "THE the The", "t1 " * 5000]
    ids = list(range(len(texts)))
    ids[3] = ids[4] = None
    ids[9] = ids[10]
    r.shuffle(ids)
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((1, 2, 8, 70))))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "nothing matches"), (28, "the the the THE"), (28, "the the the THE"), (None, "t1 t2"), (29, " ".join(words))]
    got = mk.search(table(spark, texts, ids), items_of(spark, items), slice_terms=slice_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == ranking(list(zip(ids, texts)), items)


def test_ranking_of_nothing(spark):
    some, none = items_of(spark, [(1, "a b")]), items_of(spark, [(1, "a")]).limit(0)
    assert mk.search(table(spark, []), some).collect() == [] and mk.search(table(spark, ["a"]), none).collect() == []
    assert mk.search(table(spark, [None, ""]), some).collect() == []


def test_masks_end_the_search():
    """Documents whose mask cannot reach the tenth score are not evaluated."""
    n = 2000
    held = np.concatenate([np.arange(n), n + np.arange(30), 2 * n + np.arange(15, 45)])  # term * n + document
    block = mk._Block(held.astype(np.int64), n, 3)
    block.weigh(np.array([3, 900, 800]), np.full(n, 50), n, 50 * n)
    best = mk._Best(10)
    done = block.rank(np.array([0, 1, 2]), np.array([1, 1, 1]), np.zeros(n, np.int64), np.arange(n), best)
    assert done < 100 and best.rows[2].tolist() == list(range(15, 25))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(mk, "PIECE", 50)
    text = "Ab-cd é" * 100
    assert [w.decode() for words in mk.terms_of(text.encode()) for w in words] == TERM.findall(lowered(text))
