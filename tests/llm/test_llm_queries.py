"""The registered queries over the smallest tables: contract columns, and the same rows as SQL."""

import duckdb
import pytest

import corpus_pipeline
from custspark.llm.queries import ORACLE, QUERIES

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}

COLUMNS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4": "page_id payload_bytes payload_digest record_type refers_to",
    "op5": "doc_id n_words n_removed kept_sha256",
    "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7": "doc_id n_shingles component_id",
    "op8": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10": "doc_id size text_crc32 law shard slot grown_shard",
    "op11": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12": "lang source part item value rank",
    "op13": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {name} as select * from '{small_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in result.description}
    got = sorted((repr(tuple(r)) for r in df.select(*names).collect()))
    want = sorted(repr(r) for r in result.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_document_once(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns = COLUMNS[name.split("_")[0]].split()
    assert df.columns[: len(columns)] == columns
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in df.collect()) == ids


def test_pipeline_stages_work_on_what_is_kept(spark, small_dir):
    """Each stage against its operator's own tests: here what it may drop and change."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name in ("quality rules", "n-gram Jaccard join"):
            assert all(before[i] == t for i, t in after.items())
        else:
            assert set(after) == set(before)
        docs, before = spark.createDataFrame(out.collect(), out.schema), after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir)
    final = {r["doc_id"] for r in last.collect()}
    assert final == set(before)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small_dir).collect()} == final
