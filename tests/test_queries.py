"""Registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import pandas as pd
import pytest

from folioworks import registry

DIR = "/root/testdata/sf0.001"
SOME = ("chat_overview", "error_sessions", "retrieve_overview", "history_window", "section_rollup", "resolve_aliases", "split_chapters", "bm25_query_all", "hybrid_retrieve", "case_metrics", "check_order", "normalize_questions", "stream_timeline", "hourly_states", "read_telemetry_parts", "tokenize_lemmas", "html_to_text_of_turns", "split_text", "split_table_aware", "chunks_of_documents", "split_forms", "reference_context", "session_table", "indexed_knn", "bm25_top_everywhere", "resolve_aliases_in_turn")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return None if v is None or v is pd.NA else str(v) if not isinstance(v, int) else float(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{file}')")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    table = lambda df: sorted([tuple(map(str, map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)])
    assert table(got) == table(want)


def test_every_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def test_parent_context_resolves_every_indexable_chunk(spark, tmp_path):
    sentence = "Some words of a long section stand here. "
    rows = [(1, "# One\n\n" + sentence * 120, "en", "web", 0), (2, "short text", "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = {r["chunk_id"]: r for r in registry.QUERIES["build_chunks"](spark, str(tmp_path)).collect()}
    want = {}
    for r in chunks.values():
        if r["is_indexed"]:
            want[r["chunk_id"]] = (r["doc_id"], len(chunks.get(r["parent_chunk_id"], r)["text"]))
    got = {r["chunk_id"]: (r["doc_id"], r["context_chars"]) for r in registry.QUERIES["parent_context"](spark, str(tmp_path)).collect()}
    assert got == want and len([r for r in chunks.values() if r["chunk_type"] == "split_child"]) > 3


def test_reference_context_carries_texts_up_to_the_operators_own_limits(spark, tmp_path):
    text = "".join(f"{i} " for i in range(2500))
    spark.createDataFrame([(7, text, "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 7)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    [row] = registry.QUERIES["reference_context"](spark, str(tmp_path)).collect()
    assert 2000 < len(text) < 20_000 and any(text.strip() in str(v) for v in row)


def _entry(without: str) -> subprocess.CompletedProcess:
    code = f"import sys; sys.modules[{without!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_does_without_the_training_data_operators_and_hides_no_other_error():
    assert _entry("folioworks.llm").stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))]
    assert _entry("corpus_pipeline").stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))]
    broken = _entry("duckdb") if not os.path.isdir("folioworks/llm") else _entry("zstandard")
    assert not os.path.isdir("folioworks/llm") or "zstandard" in broken.stderr
