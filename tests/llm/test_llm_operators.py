"""The ten operators against brute force, on small tables with every odd row:
nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F, types as T

from folioscan.llm import (
    bin_completion as bc, byte_cnn as cnn, credentials as cr, learned_partitions as lp, license_rules as lr, mixture_lang as ml,
    packed_output as po, queries as q, simhash_vp as vp, spaced_seeds as ss, surrogates as sg, tokens,
)

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()),
                     T.StructField("start", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("hashes", T.StringType())])
BASE = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 0.5, "x", 3, None) for i, t in zip(ids, texts)], DOCS).repartition(3)


def rows(df):
    return [r.asDict() for r in df.collect()]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# op1

def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in BASE.finditer(text) if len(m.group(1)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_credentials(spark):
    key, value = "AK" + "IA" + "AB12" * 4, "zY+/" * 10
    alone = f"x {value} y"
    both = f"é id {key} then {value} at https://example.com/x"
    far = f"{key}{' ' * 400}{value}"
    weak = 'user_name: "bob77" pwd = "hunter2!x" host = db.example.com'
    texts = [None, "", "no secrets", alone, both, far, weak, "login = bob77 only", "secret=token:abcdefgh password: abc",
             f"TOKEN = \"{'9f' * 20}\"!! api_key='abc.def-1' éé {'0a' * 12}", f"AKIAAKIA{'A' * 12} AKIA1", "token = " + "a" * 50_000, both]
    got = {r["doc_id"]: r for r in rows(cr.secret_scan(table(spark, texts)))}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        kinds = collections.Counter(s.split(":")[0] for s in base)
        assert tuple(got[i][f"n_{k}"] for k in ("assign", "access", "hex")) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}
    kinds = {i: [s.split(":")[0] for s in r["spans"].split(",")] for i, r in got.items()}
    assert got[3]["n_linked"] == 0 and kinds[4] == ["access", "base64", "endpoint"] and got[5]["n_linked"] == 0
    assert kinds[6] == ["login", "value", "host"] and got[7]["n_linked"] == 0 and got[12]["spans"] == got[4]["spans"]


def test_credentials_nearest_equals_all_pairs(spark):
    rng = random.Random(4)
    parts = ["user_id=abcd", "pwd=abcdefgh1", "https://h.example/x", "token=abcdef123", "word", " " * 150, "AKIA" + "Z" * 16, "q1W2" * 10]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = table(spark, texts)
    found = collections.defaultdict(list)
    for r in rows(cr.candidates(docs).where("rank IS NOT NULL")):
        found[r["doc_id"]].append((r["start"], r["end"], r["rank"]))
    for r in rows(cr.secret_scan(docs)):
        want = []
        for a, b, k in found[r["doc_id"]]:
            kind = cr.KINDS[k]
            others = [(x, y, cr.KINDS[j]) for x, y, j in found[r["doc_id"]] if (x, y, j) != (a, b, k)]
            near = any(o.role == cr.COMPLEMENT[kind.role] and x - b <= cr.REACH and a - y <= cr.REACH for x, y, o in others)
            covered = any(o.strong and x < b and a < y for x, y, o in others)
            if kind.strong or near and not covered:
                want.append((a, k, b, kind.name))
        assert r["spans"] == ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(want))


# op2

KEY = b"test key"


def test_surrogates_keep_type_and_look():
    for kind, text in [("email", "jean.90@mail2.example.com"), ("ipv4", "152.143.123.131"), ("card", "4111 1111 1111 1111"),
                       ("phone", "+1 (017) 555-7713"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"),
                       ("person", "Frau Anna Müller"), ("person", "Господин Иван Петров"), ("ipv6", "2001:db8:0:0:0:ff00:42:8329")]:
        found = sg.detect(f"ab {text}, cd")
        assert [(e.kind, e.text) for e in found] == [(kind, text)], found
        new = sg.surrogate(kind, text, KEY, 0, sg.person_gender(text))
        assert new != text and [e.kind for e in sg.detect(f"ab {new}, cd")] == [kind], new
        if kind in ("card", "phone", "email"):
            look = lambda s: re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", s))
            assert look(new) == look(text)
    card = sg.surrogate("card", "4111 1111 1111 1111", KEY).replace(" ", "")
    assert sg.luhn(card[:-1]) == int(card[-1])
    iban = sg.normal("iban", sg.surrogate("iban", "DE89 3704 0044 0532 0130 00", KEY))
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert sg.person_gender(sg.surrogate("person", "Maria Rossi", KEY, 0, "f")) == "f"
    assert sg.surrogate("person", "Господин Иван Петров", KEY, 0, "m").startswith("Господин ")


def test_surrogates_of_documents(spark):
    mail = "anna.12@mail1.example.com"
    texts = [None, "", "Nothing here. At all.", f"{mail} and {mail.upper()} Mr. John Smith met John Smith. Smith", f"x {mail}\nDr. Kim Lee",
             f"x {mail}\nDr. Kim Lee", "card 4485275742308327 tel +1 (136) 555-7479%%% 8.8.8.8", "long " * 30_000 + "10.0.0.1"]
    docs = table(spark, texts, [0, 1, 2, 3, 4, 4, None, 6])
    got = rows(sg.with_surrogates(docs, KEY, count=True))
    assert len(got) == 8 and set(got[0]) == {*docs.columns, "n_entities"}
    by = {r["doc_id"]: r for r in got}
    assert by[0]["text"] is None and by[1]["text"] == "" and by[2]["text"] == texts[2] and by[2]["n_entities"] == 0
    new = by[3]["text"].split(" ")[0]
    assert new != mail and by[4]["text"].split()[1] == new and by[3]["text"].split(" ")[2] == new.upper()
    first = re.search(r"Mr\. (\w+ \w+) met (\w+ \w+)\.", by[3]["text"])
    assert first and first[1] == first[2] != "John Smith"
    assert len({r["text"] for r in got if r["doc_id"] == 4}) == 1
    assert not re.search("4485275742308327|555-7479|8\\.8\\.8\\.8", by[None]["text"]) and by[None]["n_entities"] == 3
    assert sg.mask_documents(docs.limit(0), KEY).collect() == []


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With few surrogates to draw from, clashes are found and drawn again."""
    monkeypatch.setitem(sg.SYLLABLES, "latin", "ba be")
    names = [f"{given} {family}" for given in ("Anna", "Maria", "Laura", "Peter") for family in ("Abel", "Bode", "Cramer", "Dorn", "Ebert")]
    found = [(k, "person", *sg.identified(sg.detect(n))[0][1:], n) for k, n in enumerate(names)]
    again = {r["entity"]: r["attempt"] for r in rows(sg.collisions(
        spark.createDataFrame(found, "doc long, kind string, entity string, gender string, spelling string").coalesce(1), KEY))}
    new = [sg.normal("person", sg.surrogate("person", n, KEY, again.get(e, 0), g)) for _, _, e, g, n in found]
    assert len(set(new)) == len(names) and not set(new) & {n.lower() for n in names}


def test_persons_behind_several_titles(spark):
    for text, person, name in [("Herr Dr. Schmidt", "Herr Dr. Schmidt", "schmidt"), ("Dr. Prof. Lee", "Dr. Prof. Lee", "lee"),
                               ("Frau Prof. Dr. Anna Weber", "Frau Prof. Dr. Anna Weber", "anna weber")]:
        found = sg.detect(f"so {text}, who")
        assert [(e.kind, e.text) for e in found] == [("person", person)] and sg.normal("person", person) == name
    assert [e.text for e in sg.detect("met Mr. Smith Dr. Weber")] == ["Mr. Smith", "Dr. Weber"]
    titles = ["Herr Dr.", "Herr Professor", "Dr. Prof. Dr", "Herr Dr.-Ing", "Mr. Don, Sir Dr. and"]
    assert all(sg.detect(t) == [] for t in titles)
    texts = ["so Herr Dr. Schmidt", "by Dr. Prof. Lee", *titles]
    got = {r["doc_id"]: r for r in rows(sg.with_surrogates(table(spark, texts), KEY, count=True))}
    assert got[0]["text"].startswith("so Herr Dr. ") and "Schmidt" not in got[0]["text"]
    assert got[1]["text"].startswith("by Dr. Prof. ") and "Lee" not in got[1]["text"]
    assert [got[i]["n_entities"] for i in range(len(texts))] == [1, 1, 0, 0, 0, 0, 0]
    assert [got[i]["text"] for i in range(2, len(texts))] == titles


def test_surrogates_where_the_look_allows_too_few(spark):
    """All one-letter local parts of a kept domain, and one that has no letter to change."""
    mails = [f"{c}@example.com" for c in "_abcdefghijklmnopqrstuvwxyz"]
    texts = [f"write {m} now" for m in mails]
    new = [re.search(r"\S+@example.com", r["text"])[0] for r in rows(sg.with_surrogates(table(spark, texts), KEY))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    for kind, text in [("email", "_@example.com"), ("ipv4", "1.2.3.4"), ("ipv6", "1:2:3:4:5:6:7:8"), ("card", "4111 1111 1111 1111"),
                       ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("phone", "55 555 5555"), ("person", "Mr. Smith"),
                       ("person", "Anna Smith")]:
        drawn = [sg.normal(kind, sg.surrogate(kind, text, KEY, a)) for a in range(4, 24)]
        assert len(set(drawn)) == 20 and (len(drawn[-1]) > len(drawn[0]) + 10 or kind == "ipv6"), kind


@pytest.mark.parametrize("kind, text", [
    *(("phone", t) for t in ("(555)555-1234", "+1(555)555-1234", "+49 30 1234567", "+49 (0)30 123456", "+49 (0)30/123456-78", "030/1234567",
                             "030 / 1234567", "(030) 1234567", "0171 1234567", "030/123 45 67", "06 12 34 56 78", "06.12.34.56.78",
                             "+33 6 12 34 56 78", "+33 (0)6 12 34 56 78", "+41 44 123 45 67", "+44 20 7946 0958")),
    *(("ipv6", t) for t in ("2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0DB8:0:1::AB", "2001:db8:85a3:8d3::", "2001:db8:0:0:0:ff00:42:8329")),
    ("card", "3782 822463 10005"), ("card", "3056-930902-5904")])
def test_spellings(kind, text):
    found = sg.detect(f"ab {text}, cd {text}. ef")
    assert [(e.kind, e.text) for e in found] == [(kind, text)] * 2, found
    new = sg.surrogate(kind, text, KEY)
    assert new != text and len(new) == len(text) and [e.kind for e in sg.detect(f"ab {new}, cd")] == [kind], new


def test_look_alikes_stay():
    for text in ("2024-01-15", "15.01.2024", "01/15/2024", "01.02.2024 08:15", "2024/01/15", "12:30:45", "2024-01-15T12:30:45", "08:15:30:01", "1.2.3",
                 "v2.10.04", "10.0.19045", "01.02.03.04", "std::abc", "add::bad1", "x[10::20]", "a::b", "12:30::", "::", "::1", "fe80::",
                 "00 01 02 03 04 05 06 07", "2024-08-15-12-30-45", "003/120", "0.12 34", "1990-2000", "00:1A:2B:3C:4D:5E", "+5 to +10"):
        assert sg.detect(f"ab {text} cd") == [], (text, sg.detect(f"ab {text} cd"))


def test_spellings_of_one_entity():
    for kind, one, other in [("phone", "+49 (0)30 123456", "+49 30 123456"), ("phone", "030/1234567", "(030) 1234567"),
                             ("ipv6", "2001:db8::1", "2001:0DB8:0:0:0:0:0:1"), ("card", "3782 822463 10005", "378282246310005")]:
        assert sg.normal(kind, one) == sg.normal(kind, other)
        assert sg.normal(kind, sg.surrogate(kind, one, KEY)) == sg.normal(kind, sg.surrogate(kind, other, KEY))
    assert "(0)" in sg.surrogate("phone", "+49 (0)30 123456", KEY)


# op3

def test_languages(spark):
    rng = random.Random(1)
    made = {"aa": "bala lomo nika tera", "bb": "schtr krund welft achz", "cc": "ço éla dué naï"}
    texts, langs = [], []
    for i in range(90):
        lang = ("aa", "bb", "cc")[i % 3]
        texts.append(" ".join("".join(rng.sample(made[lang].split(), 2)) for _ in range(rng.randint(5, 80))))
        langs.append(lang)
    half = " ".join(texts[0].split()[:40] * 3) + " " + " ".join(texts[1].split()[:40] * 3)
    texts += [None, "", "123 !!", half, texts[2] * 400]
    langs += ["aa", None, "bb", None, "cc"]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    model = ml.learn(docs)
    want = {g: collections.Counter() for g in made}
    for i, (t, g) in enumerate(zip(texts, langs)):
        if g and t is not None and zlib.crc32(str(i).encode()) % 5:
            seen = re.sub("[^a-z\x80-\U0010ffff]+", " ", f" {t.lower()} ").encode()
            want[g].update(seen[k:k + 3] for k in range(len(seen) - 2) if seen[k + 1:k + 2] != b" ")
    for k, g in enumerate(model.names):
        counted = np.zeros(ml.BUCKETS)
        for gram, n in want[g].items():
            counted[((int.from_bytes(gram, "big") * 2654435761) & 0xFFFFFFFF) >> 16] += n
        order = np.argsort(model.chance[:, k], kind="stable")
        assert np.all(np.diff(counted[order]) >= 0) and counted.sum() > 0
    got = {r["doc_id"]: r for r in rows(ml.languages(docs, model))}
    assert len(got) == len(texts) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i]["lang_pred"] == langs[i] for i in [*range(90), 94])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 92))
    assert got[93]["proportions"].count(":") == 2 and 0.3 < got[93]["score"] < 0.7
    assert all(r["lang_pred"] == "und" for r in rows(ml.languages(docs, ml.learn(docs.where("lang = 'zz'")))))
    assert ml.languages(docs.limit(0), model).collect() == []


def test_mixture_is_the_most_likely_one():
    rng = np.random.default_rng(3)
    chance = rng.dirichlet(np.ones(30), 2).T
    count = rng.integers(1, 20, 30).astype(float)
    share, likelihood = ml.mixture(chance, count, np.array([0]), np.full((1, 2), 0.5), rounds=500)
    grid = max((count * np.log(chance @ [p, 1 - p])).sum() for p in np.linspace(1e-6, 1 - 1e-6, 2001))
    assert abs(share.sum() - 1) < 1e-9 and likelihood[0] >= grid - 1e-6


# op4

def test_spaced_seeds(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (15, 20, 40, 60, 9, 6, 5, 3)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    changed = list(items[2])
    for k in (3, 11, 19, 27, 35):
        changed[k] = "other"
    wrong = [w if k % 2 else "other" for k, w in enumerate(items[3])]
    docs = [noise(50) + items[0] + noise(20), items[1], noise(9) + changed + noise(9), noise(5) + wrong, noise(3) + items[4], noise(30) + items[5],
            items[6] + noise(8), items[7], noise(200), items[3][10:45], [], noise(40_000) + items[2]]
    texts = [None, *(" ".join(d).upper().replace(" ", "!! ") for d in docs), " ".join(docs[0])]
    ids = [None, *range(len(docs)), 0]
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (8, None), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in rows(ss.overlaps(table(spark, texts, ids), bench))}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6), (9, 3), (11, 2)}
    assert got[2, 2]["similarity"] >= 0.8 and got[0, 0]["start"] == 50 and got[11, 2]["n_same"] == 20
    sliced = {(r["doc_id"], r["item_id"]): r for r in rows(ss.overlaps(table(spark, texts, ids), bench, slice_rows=50))}
    assert sliced == got
    kept = rows(ss.drop_contaminated(table(spark, texts, ids), bench))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 7), (False, 8), (False, 10), (True, 0)]
    assert ss.overlaps(table(spark, texts, ids), bench.limit(0)).collect() == []


def test_seeds_of_long_items_carry_few_words(spark, monkeypatch):
    rng = random.Random(3)
    item = ["w%d" % rng.randrange(10 ** 6) for _ in range(3000)]
    kept = {}
    monkeypatch.setattr(ss, "stored", lambda df, purpose: kept.setdefault(purpose, df))
    texts = [" ".join(item[1000:1030]), " ".join(item[-20:]), "nothing of it"]
    got = {r["doc_id"]: r for r in rows(ss.overlaps(table(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")))}
    assert set(got) == {0, 1} and got[0]["n_same"] == got[1]["n_same"] == 20
    arrays = [f.name for f in kept["seeds"].schema if isinstance(f.dataType, T.ArrayType)]
    longest = kept["seeds"].agg(*[F.max(F.size(c)).alias(c) for c in arrays], F.count("*").alias("n")).first().asDict()
    assert longest.pop("n") == 3 * 2992 and max(longest.values()) <= ss.OVERLAP


def test_rows_are_dropped_by_their_own_text(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("w%d" % rng.randrange(10 ** 6) for _ in range(n))
    item = noise(30)
    texts = [f"{noise(9)} {item}", noise(40), None, f"{item} {noise(9)}", noise(40), noise(40)]
    docs = table(spark, texts, [None, None, None, 5, 5, 6])
    kept = rows(ss.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str(x) for x in zip([None, None, 5, 6], [*texts[1:3], *texts[4:]]))
    assert set(kept[0]) == set(docs.columns)


def test_one_row_of_each_component_where_doc_ids_repeat(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join("w%d" % rng.randrange(10 ** 6) for _ in range(60)) for _ in range(4))
    docs = table(spark, [a, a, b, c, d, d, b, a], [3, 5, 5, 7, 7, 7, 8, None])
    kept = rows(vp.keep_one(docs))
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str(x) for x in [(3, a), (5, b), (7, c), (7, d), (None, a)])


# op5

def brute(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors):
        if i % 20 == 0:
            near = sorted((-float(np.float64(w) @ np.float64(v)), j) for j, w in zip(ids, vectors) if j != i)
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 12))
    vectors = (centres[rng.integers(0, 30, 5000)] + 0.6 * rng.standard_normal((5000, 12))).astype(np.float32)
    vectors[1000:1400] = vectors[1000]  # a large group of copies
    data = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 12, 1), (9004, [float("nan")] + [1.0] * 11, 1), (9005, [None] + [1.0] * 11, 1),
           (9006, [1.0] * 3, 1), (9007, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (7, vectors[7].tolist(), 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in rows(lp.nearest(df, F.col("vec_id") % 20 == 0)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute(range(5000), vectors, 20)
    assert set(got) == set(want) and all(sorted(r for r, *_ in g) == list(range(1, 21)) for g in got.values())
    for i, g in got.items():
        assert all(abs(s - float(np.float64(vectors[i]) @ np.float64(vectors[j]))) < 1e-9 for _, j, s in g)
        assert [j for _, j, _ in sorted(g)] == [j for _, j, _ in sorted(g, key=lambda x: (-x[2], x[1]))]
    recall = sum(len({j for _, j, _ in got[i]} & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9
    assert [j for _, j, _ in sorted(got[1000])] == want[1000]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(lp.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank"))]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert lp.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_parts_are_equal():
    vectors = np.random.default_rng(2).standard_normal((512, 8))
    label = lp.balanced_parts(lp.neighbour_graph(vectors, 8), 8)
    assert np.bincount(label).tolist() == [64] * 8


# op6

def test_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(150)]
    bad = [" ".join(word() + rng.choice(["###", "$$$", "%%%"]) for _ in range(rng.randint(5, 120))) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, "", "x", good[0] * 2000]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(0, 1, 0), (None, 1, 0), (301, None, 0), (5000, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = cnn.learn(docs, labels)
    got = {r["doc_id"]: r for r in rows(cnn.quality_scores(docs, model))}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in range(300))
    assert sum(got[i]["predicted"] == 1 - i % 2 for i in held) / len(held) > 0.95
    assert got[300]["score"] == got[301]["score"] and got[303]["predicted"] == 1
    kept = rows(cnn.keep_good(docs, labels))
    assert {r["doc_id"] for r in kept} == {i for i, r in got.items() if r["predicted"]} and set(kept[0]) == set(docs.columns)
    assert rows(cnn.quality_scores(docs, cnn.learn(docs, labels.limit(0))))[0]["score"] == 0.5
    assert cnn.keep_good(docs, labels.where("quality = 1")).count() == len(texts)
    assert cnn.quality_scores(docs.limit(0), model).collect() == []


def test_sample_of_the_network_is_bounded(spark, monkeypatch):
    """A hot doc_id with long texts: the driver sees one row of it, and chunks only."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("abc " if i % 2 else "xyz ", k=rng.choice([0, 60, 9000]))) for i in range(60)] + ["hot " * 5000 + str(i) for i in range(200)]
    docs = table(spark, texts, [*range(60), *[1] * 200])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: seen.append(collect(df)) or seen[-1])
    model = cnn.learn(docs, labels, per_class=20)
    assert model.fitted and max(map(len, seen)) <= 40
    assert max(len(v) for found in seen for r in found for v in r if isinstance(v, (str, bytes, bytearray))) <= 16 * 261


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    model = cnn.ByteCNN(0.5, cnn._start(rng))
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 5, 127, 128, 129, 256, 257, 384, 5000, 300_000)]
    together = cnn.probabilities(model, texts)
    assert np.allclose(together, [cnn.probabilities(model, [t])[0] for t in texts], atol=1e-6)
    p = model.parameters
    for text, score in zip(texts[:9], together):
        padded = np.frombuffer((text or b"\0") + b"\0" * (cnn.WIDTH - 1), np.uint8)
        windows = np.stack([p["bytes"][padded[i:i + cnn.WIDTH]].ravel() @ p["filters"] for i in range(max(1, len(text)))])
        chunks = [windows[a:a + 2 * cnn.HALF].max(0) for a in range(0, max(1, len(windows) - cnn.HALF), cnn.HALF)]
        evidence = np.maximum(0, np.maximum(0, np.array(chunks) + p["filter_bias"]) @ p["dense"] + p["dense_bias"])
        out = np.concatenate([evidence.mean(0), evidence.max(0)]) @ p["out"] + p["out_bias"]
        assert abs(1 / (1 + np.exp(-out[0])) - score) < 1e-5


def test_gradients():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in cnn._start(rng).items()}
    cut = [cnn._chunks(rng.integers(0, 256, n, dtype=np.uint8).tobytes(), 4) for n in (40, 400, 2000)]
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        total = 0
        for (x, valid), label, weight in zip(cut, y, w):
            flat = [np.stack([p["bytes"][row[i:i + cnn.WIDTH]].ravel() @ p["filters"] for i in range(n)]).max(0) for row, n in zip(x, valid)]
            e = np.maximum(0, np.maximum(0, np.array(flat) + p["filter_bias"]) @ p["dense"] + p["dense_bias"])
            s = 1 / (1 + np.exp(-(np.concatenate([e.mean(0), e.max(0)]) @ p["out"] + p["out_bias"])[0]))
            total -= weight * np.log(s if label else 1 - s)
        return total / w.sum()

    grads = cnn._gradients(p, cut, y, w)
    for name in ("filters", "dense", "out", "filter_bias", "bytes"):
        at = tuple(np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape))
        p[name][at] += 1e-4
        high = loss()
        p[name][at] -= 2e-4
        low = loss()
        p[name][at] += 1e-4
        assert abs((high - low) / 2e-4 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])), name


# op7

def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text or "").encode())
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(1, 300))] for _ in range(40)]
    texts = [None, "", " \t\n", "Ä b", "One  two\nthree", "one TWO three"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            other = list(words)
            other[rng.randrange(len(other))] = "changed"
            texts.append("\n".join(other))
    texts += [texts[-1]] * 30
    prints = [plain_fingerprint(t) for t in texts]
    roots = classes(prints)
    docs = table(spark, [*texts, texts[7]], [*range(len(texts)), None])
    got = {r["doc_id"]: r for r in rows(vp.near_duplicates(docs))}
    assert len(got) == len(texts) + 1 and got[None]["component_id"] is None
    for i in range(len(texts)):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[i]:016x}", roots[i])
    kept = rows(vp.keep_one(docs.unionByName(docs.where("doc_id = 0"))))
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == [-1, *sorted(set(roots))]
    assert vp.near_duplicates(docs.limit(0)).collect() == [] and vp.keep_one(docs.limit(0)).collect() == []


@pytest.mark.parametrize("tile", [20_000, 40])
def test_links_connect_what_brute_force_connects(spark, tile):
    """Random fingerprints with chains and dense groups; small tiles as well."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(1500)}
    for seed in list(prints)[:20]:
        for _ in range(rng.choice([1, 3, 40])):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(seed)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long").repartition(3)
    roots = {r["node"]: r["root"] for r in rows(vp.components(vp.links(df, tile)))}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    want = collections.defaultdict(set)
    for p, c in zip(signed, classes(prints)):
        want[c].add(p)
    found = collections.defaultdict(set)
    for p in signed:
        found[roots.get(p, p)].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


def test_long_texts_in_pieces():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["The", "é", "qq" * rng.randint(1, 9)]) for _ in range(n)).encode() for n in (0, 1, 2, 3, 4, 5, 50, 300)]
    whole = [plain_fingerprint(t.decode()) for t in texts]
    for limit in (1, 7, 100, 1 << 22):
        assert vp.fingerprints_of(texts, limit).tolist() == whole


# op8 and op10

def plain_ids():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.WORD_BPE)


def test_kept_words_do_not_change_ids():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.BYTE_BPE, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words, whole, pieces = tokens.word_bpe(q.WORD_BPE), plain_ids(), tokens.byte_bpe(q.BYTE_BPE, public_tokenizers.PATTERN)
    rng = random.Random(11)
    signs = "aAbBéÉçÇßñÑ019 \n\t\r'.,!$%&*#|-_<>@ŒœŁŽİŉÿŸſµ×÷ªº\xa0\x85\x1c 漢字́Σς'sStTreVEll"
    texts = ["", " ", "<|endoftext|>", "it's we'LL", "x" * 5000, *("".join(rng.choice(signs[:rng.choice([20, 40, 99])])
             for _ in range(rng.randint(0, 60))) for _ in range(1500))]
    for text in texts:
        assert np.frombuffer(words(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
        assert np.frombuffer(pieces(text), "<u4").tolist() == plain.encode_ordinary(text), repr(text)


def test_texts_together_do_not_change_ids(monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.BYTE_BPE, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(12)
    signs = "aAbBéÉçñÑ019  \n\t\r'.,!$|-_<>stre"
    texts = ["", " ", "\n\n", "ab", " ab", "ab ", "ab  ab\n ab ", "漢 字 ab", "x" * 3000, "\xa0 ab", *("".join(rng.choice(signs)
             for _ in range(rng.randint(0, 40))) for _ in range(1500))]
    want = [plain.encode_ordinary(text) for text in texts]
    for kept, size, together in ((400_000, 1 << 26, 1 << 23), (400_000, 1 << 26, 1), (40, 1 << 26, 100), (4000, 20_000, 1000), (0, 0, 300)):
        monkeypatch.setattr(tokens, "KEPT", kept)
        monkeypatch.setattr(tokens, "KEPT_BYTES", size)
        monkeypatch.setattr(tokens, "TOGETHER", together)
        encode = tokens.byte_bpe_all.__wrapped__(q.BYTE_BPE, public_tokenizers.PATTERN)
        for _ in range(2):
            assert [ids.tolist() for ids in encode(texts)] == want
        assert list(encode([])) == []


def test_new_words_are_tokenized_in_one_call(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    import tiktoken

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    calls, own = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or own(self, text))
    monkeypatch.setattr(po, "TaskContext", Task)
    texts = [" " + " ".join(f"callword{i}x{j}" for j in range(50)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    out = list(po._packer(q.BYTE_BPE, public_tokenizers.PATTERN, 4096, 1 << 22)(iter([batch])))
    assert sum(b.num_rows for b in out) > 0 and len(calls) <= 2


def test_packed_matrices(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.BYTE_BPE, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "Ein Wort.", "é " * 3, "word " * 1000, "a b c " * 40, "a b c " * 40, "<|endoftext|>"]
    got = collections.defaultdict(dict)
    matrices = po.packed_matrices(table(spark, texts), q.BYTE_BPE, public_tokenizers.PATTERN, capacity=64, block=500)
    found = rows(matrices)
    for r in found:
        ends = r["cu_seqlens"]
        assert len(r["input_ids"]) == len(r["position_ids"]) == 64 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 64
        assert set(r["input_ids"][ends[-1]:]) <= {po.PAD}
        for doc, piece, start, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], ends, ends[1:]):
            assert start == 64 * piece and r["position_ids"][a:b] == list(range(b - a))
            got[doc][piece] = r["input_ids"][a:b]
    assert len({r["sequence_id"] for r in found}) == len(found)
    for i, text in enumerate(texts):
        ids = [x for piece in sorted(got[i]) for x in got[i][piece]]
        assert ids[-1] == po.END and plain.decode(ids[:-1]) == (text or "")
    assert po.packed_matrices(table(spark, []), q.BYTE_BPE, public_tokenizers.PATTERN).collect() == []


def test_written_matrices(spark, tmp_path):
    import public_tokenizers

    matrices = po.packed_matrices(table(spark, ["one two three", "four"]), q.BYTE_BPE, public_tokenizers.PATTERN, capacity=8)
    po.write_binary(matrices, str(tmp_path / "out"))
    raw = {r["sequence_id"]: r for r in rows(spark.read.parquet(str(tmp_path / "out")))}
    for r in rows(matrices):
        for name, column in (("ids", "input_ids"), ("positions", "position_ids"), ("cu_seqlens", "cu_seqlens")):
            assert np.frombuffer(raw[r["sequence_id"]][name], "<u4").tolist() == r[column]


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = min((f, i) for i, f in enumerate([*bins, capacity]) if f >= x)[1]
        if fit == len(bins):
            bins.append(capacity)
        bins[fit] -= x
    return len(bins)


def fewest(lengths, capacity):
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {f: k for k, f in enumerate(bins) if f >= lengths[i]}.values():
            bins[k] -= lengths[i]
            put(i + 1, bins)
            bins[k] += lengths[i]
        put(i + 1, [*bins, capacity - lengths[i]])

    put(0, [])
    return best


def test_packing_of_lengths():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 11))]
        counts = dict(collections.Counter(lengths))
        for patterns, bins in ((bc.best_fit_decreasing(counts, capacity), plain_best_fit(lengths, capacity)),
                               (bc.complete(counts, capacity), fewest(lengths, capacity))):
            used = collections.Counter()
            for inside, n in patterns:
                assert sum(inside) <= capacity
                for x in inside:
                    used[x] += n
            assert used == collections.Counter(lengths) and sum(n for _, n in patterns) == bins
        packed = po.best_fit_decreasing(lengths, capacity)
        assert sorted(i for row in packed for i in row) == list(range(len(lengths))) and len(packed) == plain_best_fit(lengths, capacity)


def test_dominance():
    assert bc.dominates((7,), (4, 3)) and bc.dominates((5, 4), (4, 4)) and not bc.dominates((5, 4), (6, 2)) and bc.dominates((6,), ())


def test_pack(spark):
    texts = [None, "", "Ein Wort.", "word " * 9000, "a b " * 700, "a b " * 700, "<|endoftext|> x", "é" * 50]
    ids = [0, 1, 2, 3, 4, 4, 5, None]
    whole = plain_ids()
    found = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows(bc.pack(table(spark, texts, ids), q.WORD_BPE)):
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want, total = collections.defaultdict(list), 0
    for i, text in zip(ids, texts):
        tokenized = whole.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(tokenized)
        for piece, a in enumerate(range(0, len(tokenized), 4096)):
            part = np.array(tokenized[a:a + 4096], "<u4")
            want[i].append((piece, a, len(part), zlib.crc32(part.tobytes())))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) == -(-total // 4096)
    assert bc.pack(table(spark, []), q.WORD_BPE).collect() == []


# op9

def test_licenses(spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = [None, "", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. under the mit license under the MIT license",
             "CC BY-NC 4.0 and cc-by-nc", "underthe mit license", "ünder the mit license", "Mit freundlichen Grüßen", "all rights reserved " * 20_000,
             "Released under the MIT License.", "GNU Lesser General Public License version 2.1", "permission is hereby granted free of charge"]
    got = {r["doc_id"]: r for r in rows(lr.license_scan(table(spark, texts)))}
    for i, text in enumerate(texts):
        words = WORDS.findall(lowered(text or ""))
        at = [(k, phrases[p]) for p in phrases for n in [len(p.split())] for k in range(len(words)) if " ".join(words[k:k + n]) == p]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at)) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(","))
    assert got[8]["labels"] == "all-rights-reserved" and got[7]["labels"] == "" and got[10]["labels"] == "lgpl-2.1"
    assert lr.license_scan(table(spark, [])).collect() == []


def test_suppression_equals_all_pairs():
    rng = random.Random(13)
    for _ in range(300):
        found = sorted({lr.Detection(a, a + rng.randint(1, 9), rng.choice("xyz"), rng.choice([10, 20]), 0.5, rng.random() < 0.2)
                        for a in [rng.randint(0, 15) for _ in range(rng.randint(0, 12))]})
        kept = []
        for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
            if d.base or not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert lr.resolved(found) == sorted(kept)


def spelled(parsed):
    """The shortest texts of a parsed pattern, one for each way through its alternatives and options."""
    texts = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            more = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in value]
        elif name == "BRANCH":
            more = [t for part in value[1] for t in spelled(part)]
        elif name == "SUBPATTERN":
            more = spelled(value[3])
        elif name == "MAX_REPEAT":
            once = spelled(value[2])
            more = ["", *once] if value[0] == 0 else [t * value[0] for t in once]
        else:
            assert name == "NOT_LITERAL"
            more = ["x" if value != ord("x") else "y"]
        texts = [t + m for t in texts for m in dict.fromkeys(more)]
    return texts


def test_keywords_stand_in_all_a_rule_matches():
    for rule in (rule for mine in lr.rules().values() for rule in mine):
        for text in spelled(re._parser.parse(rule.pattern.pattern[12:-9].decode("latin-1"))):
            assert rule.pattern.fullmatch(text.encode("latin-1")) and rule.keyword.decode("latin-1") in text, (rule, text)
    assert lr.scan(b"A paid license required for use")["labels"] == "proprietary"


def test_rules_of_the_catalog():
    found = [rule for mine in lr.rules().values() for rule in mine]
    assert len(found) >= 200 and {r.pattern.pattern[12:-9].decode() for r in found if r.base} == set(lr.BASE)
    # A keyword that a rule's own plain words lack would keep it from ever being tried.
    for rule in found:
        plain = re.sub(rb"\(\?:[^()|]*\)\?", b"", rule.pattern.pattern[12:-9])
        if not re.search(rb"[|\[\](){}+*?]", plain):
            assert rule.keyword in plain, rule
