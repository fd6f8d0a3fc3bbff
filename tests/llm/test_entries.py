"""The registered queries against their SQL, and their columns."""

from pathlib import Path

import duckdb
import pytest

from stepfold.llm import entries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op2_mixing": "doc_id size source_size target taken",
    "op3_nearest": "query_id rank vec_id score",
    "op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_repeats": "doc_id n_words n_removed kept_sha256",
    "op6_licenses": "doc_id license coverage n_licenses spans",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_ranked_search": "item_id rank doc_id score",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_embedding_dedup": "vec_id n_links component_id kept",
}


def test_every_operator_is_registered():
    assert set(entries.queries()) == set(COLUMNS) and set(entries.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = entries.queries()[name](spark, DIR)
    assert df.columns == COLUMNS[name].split()
    got = sorted(map(tuple, df.collect()), key=str)
    if name not in ("op3_nearest", "op11_ranked_search", "op13_embedding_dedup"):
        assert len(got) == 200
    if name in entries.oracle_sql():
        con = duckdb.connect()
        for p in Path(DIR).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.sql(entries.oracle_sql()[name])
        assert sorted(want.select(*df.columns).fetchall(), key=str) == got
