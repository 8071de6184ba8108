import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from check import TABLES, canonical
from cumulus.llm import bpe
from cumulus.llm.mixing import mix
from cumulus.session import materialise
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_ngram_join import brute as join_brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_mixing", "op6_topk", "op7_line_dedup", "op8_embedding_dedup", "op9_ngram_join"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = canonical(entry_points.queries()[name](spark, SF).toPandas()), canonical(con.execute(entry_points.oracle_sql()[name]).df())
    assert got[1] == want[1] and got[0] and repr(got[0]) == repr(want[0])


def test_registered():
    names = entry_points.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_stages(spark):
    """Each stage's output against brute force over what the stage before it wrote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], SF), name))
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert set(rows[1]) == {k for k, r in rows[0].items() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    kept = {k: t for k, t, _, lost in lines_brute([(k, r["text"]) for k, r in rows[1].items()]) if not lost or t.strip()}
    assert {k: r["text"] for k, r in rows[2].items()} == kept
    assert set(rows[3]) == {k for k, _, _, c in join_brute([(k, r["text"]) for k, r in rows[2].items()]) if k == c}
    assert set(rows[4]) == set(rows[3]) == set(rows[5])
    enc = bpe.encoding(bpe.read_ranks(bpe.rank_file()), bpe.public_tokenizers.PATTERN)
    for k, r in rows[5].items():
        assert r["ids"] == enc.encode_ordinary(rows[4][k]["text"]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(rows[4][k]["text"].encode()).hexdigest()
    assert corpus_pipeline.run(spark, SF).count() == len(rows[5])


def test_mixed_order_outlives_the_files(spark):
    """The result carries the mixed order after the stage's table is written, read and written again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = materialise(corpus_pipeline.mix_sources(spark, docs, SF), "mix_sources")
    assert len(mixed.inputFiles()) > 1
    out = materialise(corpus_pipeline.encode_texts(spark, mixed, SF).repartition(5), "encode").collect()
    want = [r["doc_id"] for r in sorted(mix(docs).collect(), key=lambda r: (r["__slot"], r["__place"]))]
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in out) == list(range(len(want)))
