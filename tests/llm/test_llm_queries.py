"""The queries and the pipeline on the smallest tables, against DuckDB where there is SQL."""

import os

import duckdb
import pytest

from rowtide.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_templates": {"page_id", "host", "path", "rule", "verdict"}, "op2_simhash": {"doc_id", "fingerprint", "component_id"}, "op3_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op4_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op5_decontaminate": {"doc_id", "item_id"}, "op6_passages": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_bwt_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op8_quality": {"doc_id", "held_out", "score", "predicted"}, "op9_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_imatch": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def normal(df):
    return sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), "NULL").astype(str).values))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert COLUMNS[name] <= set(got.columns) and (len(got) or name == "op5_decontaminate")
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert normal(got) == normal(con.execute(ORACLES[name]).fetchdf())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) < len(texts) and all(r["round_trip"] for r in got)
    assert len({r["doc_id"] for r in got}) == len(got) and {r["doc_id"] for r in got} <= set(texts)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "decontamination", "byte_bpe"]


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    docs = docs.union(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
