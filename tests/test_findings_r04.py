"""What the findings of round 4 showed."""

import datetime as dt
import random
import time

import pytest

from folioworks import registry
from folioworks.plans.index_queries import Data, built


def compared(spark, folder, name):
    """Rows of a query and of its SQL on the tables of a folder, sorted."""
    import duckdb

    con = duckdb.connect()
    for path in folder.iterdir():
        con.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("last", ["view", "error"])
def test_ends_to_come_do_not_put_the_stuck_requests_clock_forward(spark, tmp_path, last):
    at = lambda minute, second=0: dt.datetime(2024, 1, 1, 0, minute, second)
    rows = [(1, at(1), "error"), (2, at(4), "error"), (3, at(4, 1), "error"), (4, at(4, 59), "error"), (5, at(2), "click"), (6, at(10), last)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got, want = compared(spark, tmp_path, "stream_stuck")
    assert got == want == [(1,), (2,)]


def test_a_text_is_split_a_few_times_not_once_for_each_piece(spark):
    from pyspark.sql import functions as F

    from folioworks.functions import splitting, text

    parts = [f"piece {i} of a long text that goes on" for i in range(20_000)]
    began = time.time()
    [row] = spark.createDataFrame([(". ".join(parts),)], "t string").select(text.overlapped(F.split("t", r"\. "), 40).alias("p")).collect()
    assert row["p"] == splitting.overlapped(parts, 40)
    assert time.time() - began < 30  # splitting for each piece takes minutes


def moved(spark):
    """(rows, bytes) that this session has written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages), sum(s.shuffleWriteBytes() for s in stages)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents that all share words with all queries; (folder, bytes of text)."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    words = [word() for _ in range(400)]
    others = [word() for _ in range(3000)]
    texts = [" ".join(["common", "words", *rng.choices(words, k=4), *rng.choices(others, k=90)]) for _ in range(4000)]
    rows = [(i, t, ["en", "de"][i % 2], f"src{i % 20}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(["common", "words", *rng.choices(words, k=3)])) for i in range(40)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, sum(map(len, texts))


def test_scores_of_chunks_stay_where_the_chunks_are(spark, corpus):
    folder, _ = corpus
    built(Data(spark, str(folder)))
    before = moved(spark)[0]
    got, want = compared(spark, folder, "rrf")
    assert got == want and len(got) > 40 * 20
    assert moved(spark)[0] - before < 40 * 4000 / 2  # of as many scores


@pytest.mark.parametrize("name", ["hybrid_retrieve", "hint_match", "case_metrics", "tune_k"])
def test_texts_that_are_no_hits_stay_where_they_are(spark, corpus, name):
    folder, text = corpus
    built(Data(spark, str(folder)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for hits of very many queries
    try:
        before = moved(spark)[1]
        got, want = compared(spark, folder, name)
        assert got == want
        assert moved(spark)[1] - before < text / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_one_chunk_are_put_together(spark, tmp_path):
    from folioworks.operators import index as I

    rows = [(1, "x", "red fox"), (1, "x", "red"), (2, "x", "fox"), (3, "x", None), (1, "y", "blue")]
    index = I.bm25_index(spark.createDataFrame(rows, "chunk_id long, cluster string, text string"), path=f"file://{tmp_path}/index")
    assert sorted(map(tuple, index.postings.collect())) == [("x", "fox", 1, 1), ("x", "fox", 2, 1), ("x", "red", 1, 2), ("y", "blue", 1, 1)]
    assert sorted(map(tuple, index.lengths.collect())) == [("x", 1, 3), ("x", 2, 1), ("x", 3, 0), ("y", 1, 1)]


def test_texts_do_not_move_once_for_each_reference(spark, tmp_path):
    rng = random.Random(8)
    texts = [(i, "  " + "".join(rng.choices("abcdefghij klmnopq\n", k=15_000 + 9_000 * (i % 3))), f"src{i}") for i in range(12)]
    spark.createDataFrame([*texts, (12, None, "none"), (13, "", "empty")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(k, n, rng.randrange(16) if k % 5 == 0 else rng.randrange(12)) for k in range(200) for n in range(1, 3 + k % 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = moved(spark)[1]
    got, want = compared(spark, tmp_path, "reference_context")
    assert moved(spark)[1] - before < 1_000_000 < sum(len(context or "") for _, context, *_ in got) / 8
    key = lambda r: r[0]
    assert sorted(got, key=key) == sorted(want, key=key) and any("skipped" in notes for _, _, notes, _ in got) and any(context is None for _, context, *_ in got)
