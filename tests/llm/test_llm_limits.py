"""Odd names, long lines, numerals."""

import hashlib
import itertools
import random
import time

from pyspark.sql import functions as F

from folioscan.llm import byte_cnn as cnn, credentials as cr, mixture_lang as ml, simhash_vp as vp, spaced_seeds as ss, surrogates as sg


def test_a_column_named_as_the_helper(spark):
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k l", "other words stand here and nothing else at all now", None]
    docs = spark.createDataFrame([(i, t, f"own {i}", 7) for i, t in enumerate(texts)], "doc_id long, text string, _stored_row string, __stored_row int")
    kept = vp.keep_one(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["_stored_row"], r["__stored_row"]) for r in kept.collect()} >= {(0, "own 0", 7), (2, "own 2", 7)}
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    left = ss.drop_contaminated(docs, items)
    assert left.columns == docs.columns and {(r["doc_id"], r["_stored_row"]) for r in left.collect()} == {(2, "own 2"), (3, "own 3")}


def test_persons_of_a_long_line():
    line = "Meeting Notes Of The Northern Office And More Words " * 40_000  # 2 MB without a person or a break
    begin = time.perf_counter()
    assert list(sg._persons(line)) == []
    assert time.perf_counter() - begin < 20
    r = random.Random(1)
    parts = ["Anna", "Weber", "Frau", "Dr.", "Schmidt", "\n", "the", "Herr", "(Peter", "x"]
    for _ in range(300):
        text = "".join(r.choice(parts) + r.choice((" ", " ", "\n")) for _ in range(r.randint(1, 12)))
        for e in sg._persons(text):
            assert text[e.start:e.end] == e.text and not e.text.startswith((" ", "\n"))


def test_numerals_are_no_letters(spark):
    rows = [(i, f"wort und satz {i} mit wörtern" if i % 2 else f"word and sentence {i} with words", "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame([*rows, (900, "½ ²³", None), (901, "² x", None), (902, "12 ½ .", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in ml.languages(docs, ml.learn(docs)).collect()}
    assert got[900] == "und" and got[902] == "und" and got[901] != "und"


def test_the_sample_of_a_label_is_no_task_of_its_own(spark, monkeypatch):
    """Each label's rows are the first by hash, taken without sorting all of them in one place."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    seen = {}
    stored = cnn.stored
    monkeypatch.setattr(cnn, "stored", lambda df, purpose: seen.setdefault(purpose, stored(df, purpose)))
    cnn.learn(docs, labels, per_class=20, fit_chunks=2)
    known = labels.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2)
    want = {r["doc_id"] for q in (0, 1) for r in known.filter(f"quality = {q}").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(20).collect()}
    assert {r["doc_id"] for r in seen["sample"].collect()} == want


def test_no_overlap_of_a_short_item_is_missed(spark):
    """Every way to change a fifth of its words."""
    docs, items = [], []
    for n in (*range(5, 13), 15, 16, 19, 20):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for places in itertools.islice(itertools.combinations(range(n), n // 5), 0, None, 1 if n < 15 else 7):
            changed = ["other" if i in places else w for i, w in enumerate(words)]
            docs.append((len(docs), f"before it {' '.join(changed)} behind it", n))
        if n > 5:  # one more is too many
            docs.append((-n, " ".join(f"x{i}" if i <= n // 5 else w for i, w in enumerate(words)), n))
    got = ss.overlaps(spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, n) for i, _, n in docs if i >= 0}
    assert all(r["start"] == 2 and r["n_words"] == r["item_id"] and r["n_same"] == r["item_id"] - r["item_id"] // 5 for r in got)


def test_a_word_that_repeats(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "word " * 30), (3, "word other " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word " * 50), (2, "word " * 12)], "item_id long, text string")
    begin = time.perf_counter()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in ss.overlaps(docs, items).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 1.0} and time.perf_counter() - begin < 60


def test_many_candidates_in_a_text(spark):
    n = 200_000
    text = "".join(f"token = abcdef{i:06}\n" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, text[:21 * 1000]), (3, None)], "doc_id long, text string")
    begin = time.perf_counter()
    got = {r["doc_id"]: r for r in cr.secret_scan(docs).collect()}
    assert time.perf_counter() - begin < 100
    spans = ",".join(f"assign:{21 * i}:{21 * i + 20}" for i in range(n))
    assert got[1]["n_assign"] == n and got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and got[1]["spans"] == spans
    assert got[2]["n_assign"] == 1000 and got[3]["n_assign"] == 0
