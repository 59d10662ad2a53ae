"""The registered queries and the pipeline on the given small tables."""

import zlib
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from folioscan.llm import bin_completion as bc, byte_cnn as cnn, oracle, queries as q, surrogates as sg
from folioscan.llm.common import table
from test_llm_operators import WORDS, classes, plain_fingerprint, plain_ids

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_registry():
    names = list(q.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(entry_points.queries()) and set(oracle.STATEMENTS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", oracle.STATEMENTS)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.QUERIES[name](spark, SF)
    want = con.execute(oracle.STATEMENTS[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())


def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    model = cnn.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    items = [f" {' '.join(WORDS.findall(r['text'].lower()))} " for r in table(spark, SF, "benchmark").collect()]
    good = [i for i in docs if cnn.probabilities(model, [docs[i].encode()])[0] >= cnn.ACCEPT]
    roots = classes([plain_fingerprint(docs[i]) for i in good])
    single = [i for k, i in enumerate(good) if roots[k] == k]
    clean = [i for i in single if not any(item in f" {' '.join(WORDS.findall(docs[i].lower()))} " for item in items)]
    whole, want = plain_ids(), {}
    for i in clean:
        ids = whole.encode(sg.replaced(docs[i], q.SURROGATE_KEY)[0], add_special_tokens=False).ids + [1]
        for piece, a in enumerate(range(0, len(ids), bc.CAPACITY)):
            want[i, piece] = (a, len(ids[a:a + bc.CAPACITY]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:a + bc.CAPACITY])))
    found = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    assert 0 < len(clean) < len(single) < len(good) < len(docs)
    assert len({r["sequence_id"] for r in found}) == -(-sum(n for _, n, _ in want.values()) // bc.CAPACITY)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names, name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
