"""Registered queries next to their SQL in DuckDB. All of them with CARGOLINE_ALL_QUERIES=1, else a cross-section."""

import os

import pytest

from tests.compare import compare, connect
import __spark_entry__ as entry

SF_DIR = os.environ.get("CARGOLINE_SF_DIR", "/root/testdata/sf0.001")
SOME = ["clean_basic", "standardize", "scan_preamble_csv", "dict_supervised", "dict_from_labelled", "match_phrase", "hs_mapping",
        "draft_taxonomy", "classify_cascade", "nb_predict", "accuracy_breakdown", "calibration_bins", "top_companies",
        "taxonomy_resolve", "retention_top10", "cluster_descriptions", "match_semantic", "semantic_dedup", "dict_route", "kind_rules", "linear_predict",
        "match_history_table", "keyword_maximal", "page_rows_deep",
        "scan_mixed_files", "taxonomy_merge", "label_fill_taxonomy", "classify_with_model"]
NAMES = list(entry.queries()) if os.environ.get("CARGOLINE_ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    message, _, _, _ = compare(spark, connect(SF_DIR), entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert not message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
