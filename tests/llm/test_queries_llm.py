"""Registered queries over the smallest tables: the SQL where there is one, shapes and counts elsewhere."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from ledgerline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ann": ["query_id", "rank", "vec_id", "score"],
    "op2_lattice": ["vec_id", "n_links", "component_id", "kept"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken", "shard_words"],
    "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_pages": ["page_id", "url", "text", "n_chars"],
    "op7_urls": ["page_id", "host", "path", "rule", "verdict", "template", "purity"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_line_dedup": ["doc_id", "text", "lines_before", "lines_after"],
    "op11_turns": [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ],
    "op12_licences": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op13_interactions": [
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley",
    ],
}


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and set(QUERIES) | {"pipeline"} <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["op3_mixing", "op7_urls", "op9_sharding", "op13_interactions"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert QUERIES[name](spark, SF).columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    want = con.sql(ORACLES[name]).to_arrow_table().to_pylist()
    got = QUERIES[name](spark, SF).toArrow().to_pylist()
    def key(row):
        return sorted((k, str(v)) for k, v in row.items())

    assert sorted(map(key, got)) == sorted(map(key, want))
