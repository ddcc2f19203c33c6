"""The registered queries: contract columns, and agreement with their check SQL."""

from __future__ import annotations

import pytest
from oracle import compare, connect
from pagetide.llm import queries

COLUMNS = {
    "op1": ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"],
    "op2": ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint"],
    "op3": ["page_id bigint", "url string", "text string", "n_chars bigint"],
    "op4": ["vec_id bigint", "n_links bigint", "component_id bigint", "kept boolean"],
    "op5": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
    "op6": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op7": ["doc_id bigint", "n_words bigint", "n_removed bigint", "kept_sha256 string"],
    "op8": ["doc_id bigint", "n_shingles bigint", "component_id bigint", "kept boolean"],
    "op9": ["doc_id bigint", "contaminated boolean"],
    "op10": ["doc_id bigint", "toxic boolean"],
    "op11": ["doc_id bigint", "n_chars bigint", "edited_sha256 string", "fingerprint string", "edited_fingerprint string",
             "near_edited double", "near_next double"],
    "op12": ["doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint",
             "runs_sha256 string", "collapsed_sha256 string"],
    "op13": ["item_id bigint", "rank int", "doc_id bigint", "score bigint"],
}
TABLE = {"op2": "pages", "op3": "pages", "op4": "embeddings"}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    op = name.split("_")[0]
    assert set(COLUMNS[op]) <= {f"{c} {t}" for c, t in df.dtypes}
    if name in queries.ORACLES:
        assert compare(df, connect(sf_dir), queries.ORACLES[name]) == ""
    else:
        assert df.count() == spark.read.parquet(f"{sf_dir}/{TABLE.get(op, 'documents')}.parquet").count()
