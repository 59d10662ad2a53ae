"""The text layer against Python's own str and re on adversarial texts."""

import re

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as tx
from folioscan.rules import catalog

NBSP, NEL, LS, WIDE, LONG_S, MARK, ZWSP = map(chr, (0xA0, 0x85, 0x2028, 0x3000, 0x17F, 0xFFFF, 0x200B))

TEXTS = [
    "",
    "\n",
    "a",
    "a\n",
    "a\n\n",
    "éeval(x) eval" + NBSP + "(y)\neval\n(z)",
    "api_key = 'abcdefghij0123456789'\nAPIKEY:" + NBSP + "abcdefghij0123456789",
    "one\r\ntwo\rthree\x0bfour\x0cfive\x1csix" + NEL + "seven" + LS + "eight" + LS,
    "def f(a: int) -> int:\n\n\n  def g(x):\n def h(\n y) : pass\x1c\ndef  k()->x",
    f"password = 'hunter2hunter2'; pwd=\"12345678\"\nPA{LONG_S}{LONG_S}WORD: 'abcdefgh1'",
    f"mark {MARK} before eval({MARK}) and exec(1)\neval(2)",
    WIDE + " lead and trail " + NBSP + "\x1f",
    "x" * 33_000,
    "temperature = 0.7\nmodel='a' max_tokens=3\n" * 50,
    "logging.info('the token') print(secret)\nlogging.x(  key)",
    "http://a.b/api/login?token=1 http://c.d/x",
    "fór if x and y oré while2 except:" + ZWSP,
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_line_and_space_helpers(spark):
    rows = frame(spark, TEXTS).select(
        "text", *[F.expr(e("text")).alias(n) for n, e in dict(
            lines=tx.splitlines, s=tx.strip, l=tx.lstrip, nb=tx.not_blank, tok=tx.token_estimate, nl=tx.unify_newlines,
            n=tx.count_lines, han=tx.has_han
        ).items()]).collect()
    for r in rows:
        body = r.text.replace("\r\n", "\n").replace("\r", "\n")
        assert r.nl == body
        if "\r" not in r.text:
            assert r.lines == r.text.splitlines()
            assert r.n == len(r.lines)
        assert r.han == bool(re.search(f"[{tx.HAN_RANGE}]", r.text))
        assert r.s == r.text.strip()
        assert r.l == r.text.lstrip()
        assert r.nb == bool(r.text.strip())
        assert r.tok == int(len(r.text) / 3.5)


def test_suffix_and_name(spark):
    from pathlib import PurePosixPath

    paths = ["a.py", "x/.gitignore", ".gitignore", "x/y.tar.GZ", "noext", "a.b/c", "dir.d/e.Md", "x/.a.b"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(
        "p", F.expr(tx.suffix("p")).alias("s"), F.expr(tx.file_name("p")).alias("n")).collect()
    for r in got:
        assert r.s == PurePosixPath(r.p).suffix.lower(), r.p
        assert r.n == PurePosixPath(r.p).name


def test_decode_drops_invalid_bytes(spark):
    raw = [b"ok", b"a\xffb\xc3", b"\xe2\x82A\xef\xbf\xbdz", "é ".encode(), b"\xf0\x9f\x98"]
    got = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary").select(
        F.expr(tx.decode_utf8("b")).alias("t")).collect()
    assert [r.t for r in got] == [b.decode("utf-8", "ignore") for b in raw]


@pytest.mark.parametrize("pattern", [p.regex for p in catalog.MATCH_PATTERNS], ids=lambda p: p[:24])
def test_matches_agree_with_finditer(spark, pattern):
    got = frame(spark, TEXTS).select(
        "text", F.expr(tx.matches("text", pattern)).alias("m")).collect()
    for r in got:
        want = [(i, r.text[:m.start()].count("\n") + 1, m.group(0))
                for i, m in enumerate(re.finditer(pattern, r.text))]
        assert [tuple(x) for x in r.m] == want, r.text[:60]


def test_contains_any_ci(spark):
    words = ["you are", "system:", "1."]
    texts = TEXTS + ["YOU ARE", LONG_S + "ystem:", f"SY{LONG_S}TEM: x", "yOu aRe", "11"]
    got = frame(spark, texts).select(
        "text", F.expr(tx.contains_any_ci(
            "text", "lower(text)", tx.contains_any("text", tx.FOLDING_CHARS), words)).alias("h")).collect()
    rx = re.compile("(?i)" + "|".join(re.escape(w) for w in words))
    for r in got:
        assert r.h == bool(rx.search(r.text)), r.text[:60]


def test_one_pass_patterns_find_the_same_lines():
    pieces = ['f"', "f'", "{", "}", '"', "'", "user", "msg", ".format(", ".format (", "+ ", "+", "text", "x", "%", " "]
    import random

    rng = random.Random(7)
    for p in catalog.INJECTION_PATTERNS:
        if p.one_pass:
            plain, fast = re.compile(p.regex), re.compile(p.one_pass)
            for _ in range(20_000):
                line = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
                assert bool(plain.search(line)) == bool(fast.search(line)), (p.key, line)


@pytest.mark.parametrize("linear, plain", [
    (catalog.DEF_REGEX, r"(?m)^\s*def\s+\w+\s*\("),
    (catalog.TYPED_DEF_REGEX, r"(?m)^\s*def\s+\w+\s*\(([^)]*)\)(\s*->\s*[^:#]+)?"),
    (catalog.DOCSTRING_REGEX, r'\n\s*"""'),
    (catalog.BRANCH_REGEX, r"\b(if|for|while|except|and|or)\b"),
])
def test_counts_agree(spark, linear, plain):
    texts = TEXTS + ['def f():\n\n   \n    """a"""\n"""b"""\n\x0b"""c"""', "  def a(x) -> int:\n\tdef b(\n\n def c():\n\n\n"]
    got = frame(spark, texts).select("text", F.expr(tx.count_matches("text", linear)).alias("n")).collect()
    for r in got:
        assert r.n == len(list(re.finditer(plain, r.text))), r.text[:60]
