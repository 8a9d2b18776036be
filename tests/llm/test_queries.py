"""Queries with SQL against DuckDB, as the driver runs them; all queries for their columns."""

import pytest
from compare import compare, duck
from conftest_paths import SF_SMALL

from tidepool.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}
ROWS = {"op12_whitening": 500 * 16, "op13_centroids": 500}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    ok, why = compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), ORACLE[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, SF_SMALL)
    assert got.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert got.count() == ROWS.get(name, 200)
