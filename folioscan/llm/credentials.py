"""Secret scans: credentials in several parts.

A scan finds strong credentials by pattern (an assigned secret, an access key
id, a long hex string) and, beside them, weak candidates that mean nothing
alone: the name of an account, a login or client id, a password-like value, an
endpoint.  Each candidate has a role: access identifier, secret or endpoint.
Intervals of one scope (a stretch of ``REACH`` code points around a candidate,
within one document) are joined, and a weak candidate is reported only if a
candidate of a complementary role lies within its scope: an identifier with a
secret, a secret with an identifier, an endpoint with a secret.  A weak
candidate that overlaps a strong one is not reported.

The interval join runs over each document's candidates in order: the nearest
end before and the nearest start after, by role, decide whether some interval is
within reach, so that no pairs are made.  Everything is DataFrame and SQL
functions; texts do not leave their rows, only spans are shuffled.

Defined results: a null or empty text has no spans (the digest is that of an
empty string); rows are reported one by one, also if they repeat or have a null
doc_id; extra columns are ignored; an empty table gives no rows; of equal spans
of one kind there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

REACH = 240


@dataclass(frozen=True)
class Kind:
    """What a pattern finds.  ``least``, ``most``: the code points that ``group`` may have."""

    name: str
    role: str
    pattern: str
    hint: str  # a cheap test that any text with a match passes
    strong: bool = False
    group: int = 0
    least: int = 1
    most: int = 2**31 - 1


QUOTED = r"""["']?\x20*[:=]\x20*["']?"""
# In the order in which equal starts are reported.
KINDS = (
    Kind("assign", "secret", rf"(?i:password|passwd|secret|token|api_?key){QUOTED}([A-Za-z0-9+/_.=-]+)",
         r"(?i:password|passwd|secret|token|api_?key)", True, 1, 6),
    Kind("access", "identifier", r"AKIA[A-Z0-9]+", "AKIA", True, 0, 20),
    Kind("hex", "secret", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", True, 0, 24),
    Kind("login", "identifier", rf"(?i:user_?name|user_?id|login|account(?:_?id)?|client_?id|access_?key_?id){QUOTED}([A-Za-z0-9@._+-]+)",
         r"(?i:user|login|account|client|access)", False, 1, 3),
    Kind("value", "secret", rf"(?i:pwd|pass|passphrase|private_?key|auth|credential|signature){QUOTED}([A-Za-z0-9+/_.=!-]+)",
         r"(?i:pwd|pass|private|auth|credential|signature)", False, 1, 8),
    Kind("base64", "secret", r"[A-Za-z0-9+/]{40,}", r"[A-Za-z0-9+/]{40}", False, 0, 40, 40),
    Kind("endpoint", "endpoint", r"(?i:https?|wss?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@%&=+-]+", "://"),
    Kind("host", "endpoint", rf"(?i:host(?:_?name)?|endpoint|server|base_?url|region|bucket){QUOTED}([A-Za-z0-9._:/-]+)",
         r"(?i:host|endpoint|server|url|region|bucket)", False, 1, 4),
)
PART = 256  # matches that are walked at a time
STRONG = tuple(k.name for k in KINDS if k.strong)
COMPLEMENT = {"identifier": "secret", "secret": "identifier", "endpoint": "secret"}


def _found(text: Column, rank: int, kind: Kind) -> Column:
    """An array of the matches of a kind: rank, start, end.  What a pattern
    splits a text into and what it matches, in turn, give the places."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    sizes = F.zip_with(
        F.zip_with(F.split(text, kind.pattern, -1), whole, lambda gap, match: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(match).alias("size"))),
        value, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.char_length(v).alias("value")))
    empty = F.array().cast("array<struct<rank:int,start:int,end:int>>")

    def after(acc: Column, x: Column) -> Column:
        return acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))  # the last gap has no match

    def walk(part: Column, at: Column) -> Column:
        """The spans of a part that begins at a place, which is kept beside them."""
        return F.aggregate(
            part, F.struct(at.alias("at"), empty.alias("spans")),
            lambda acc, x: F.struct(
                after(acc, x).alias("at"),
                F.when(x["value"].between(kind.least, kind.most), F.concat(acc["spans"], F.array(F.struct(
                    F.lit(rank).alias("rank"), (acc["at"] + x["gap"]).alias("start"),
                    (acc["at"] + x["gap"] + x["size"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
            lambda acc: acc["spans"])

    def places(parts: Column) -> Column:
        """Where each part begins."""
        return F.aggregate(
            parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")),
            lambda acc, part: F.struct(
                F.aggregate(part, F.struct(acc["at"].alias("at")), lambda own, x: F.struct(after(own, x).alias("at")), lambda own: own["at"]).alias("at"),
                F.concat(acc["begins"], F.array(acc["at"])).alias("begins")),
            lambda acc: acc["begins"])

    def parted(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(held) - 1) / PART).cast("int")), lambda i: F.slice(held, i * PART + 1, F.lit(PART)))

    # Appending copies an array, so matches are walked in parts; `array` and `transform` make Spark evaluate each once.
    parts = F.transform(F.array(sizes), parted)
    walked = F.transform(parts, lambda p: F.flatten(F.zip_with(p, places(p), walk)))[0]
    return F.when(text.rlike(kind.hint), walked).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id and one candidate (rank, start, end); a row without any has
    one line of nulls.  ``row`` names an input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[_found(text, i, k) for i, k in enumerate(KINDS)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "doc_id", F.inline_outer("found"))


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Strong candidates, and weak ones with a complementary candidate within
    ``reach`` and no strong one over them."""
    role = F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), F.col("rank") + 1)
    strong = F.col("rank") < len(STRONG)
    spans = spans.withColumns({"role": role, "strong": strong})
    in_order = Window.partitionBy("row").orderBy("start", "end", "rank")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # All that follow, as what comes before in reverse: a frame up to the end would be summed up anew for each row.
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)

    def by_role(pick) -> Column:
        return F.coalesce(*[F.when(F.col("role") == mine, pick(other)) for mine, other in COMPLEMENT.items()])

    # Of what starts before, the furthest end; of what starts after, the nearest start.
    end_before = by_role(lambda r: F.max(F.when(F.col("role") == r, F.col("end"))).over(before))
    start_after = by_role(lambda r: F.min(F.when(F.col("role") == r, F.col("start"))).over(after))
    covered = (F.coalesce(F.max(F.when(strong, F.col("end"))).over(before), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(F.when(strong, F.col("start"))).over(after), F.lit(2**31 - 1)) < F.col("end"))
    near = (F.col("start") - end_before <= reach) | (start_after - F.col("end") <= reach)
    spans = spans.withColumn("kept", F.col("strong") | (F.coalesce(near, F.lit(False)) & ~covered))
    return spans.select("row", "doc_id", "rank", "start", "end", "strong", "kept")


def _joined(rows: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row."""
    spans = linked(candidates(docs), reach)
    each = F.struct("start", "rank", "end")
    rows = spans.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("rank") == i, True)).alias(f"n_{name}") for i, name in enumerate(STRONG)],
        F.sort_array(F.collect_list(F.when(F.col("kept") & F.col("strong"), each))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), each))).alias("all"))
    return rows.select(
        "doc_id", *[f"n_{name}" for name in STRONG], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_linked"))
