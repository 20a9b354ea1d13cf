"""Merged telemetry states, tables read in parts from a database, lemmas by endings."""

import random

import pytest
from pyspark.sql import functions as F

from folioworks.operators import index as I
from folioworks.operators import telemetry_states as H
from folioworks.sources import files


def test_states_merge_to_what_the_rows_say(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"2024-0{1 + i % 2}-{1 + i % 27:02d} {i % 24:02d}:10:00", rng.choice(["ok", "ok", "ok", "error", "in_progress"]), rng.choice([None, rng.lognormvariate(5, 2)]) if i % 50 == 0 else rng.lognormvariate(5, 2), f"s{rng.randrange(3000)}", ["m1", "m2"][i % 3 == 0]) for i in range(20_000)]
    df = spark.createDataFrame([*rows, (None, "ok", 1.0, "s", "m1")], "ts string, status string, ms double, session string, model string").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"file://{tmp_path}/states"
    states = lambda some: H.hourly_states(some, "ts", durations=["ms"], distinct=["session"], by=["model"])
    H.write_states(states(df.where("status = 'none'")), path)
    H.write_states(states(df), path)
    H.write_states(states(df.where("month(ts) = 2")), path)  # a month again
    held = spark.read.parquet(path)
    assert held.agg(F.sum("rows")).first()[0] == 20_000
    since, until = F.lit("2024-01-05 07:30:00").cast("timestamp"), F.lit("2024-02-11 03:59:59").cast("timestamp")
    inside = df.where("ts >= '2024-01-05 07:00:00' AND ts < '2024-02-11 03:00:00'")
    for by in ([], ["model"]):
        for r in H.merged_states(held, since, until, by=by).collect():
            own = [x for x in inside.collect() if not by or x["model"] == r["model"]]
            ms = sorted(x["ms"] for x in own if x["status"] == "ok" and x["ms"] is not None)
            assert r["rows"] == len(own) and r["ok"] == sum(x["status"] == "ok" for x in own) and r["ms_n"] == len(ms)
            assert r["ms_avg"] == pytest.approx(sum(ms) / len(ms))
            for share, got in ((0.5, r["ms_p50"]), (0.95, r["ms_p95"])):
                assert abs(sum(v <= got for v in ms) / len(ms) - share) <= H.RANK_ERROR
            sessions = len({x["session"] for x in own})
            assert abs(r["session_distinct"] - sessions) <= H.COUNT_ERROR * sessions
    empty = H.merged_states(held, F.lit("2030-01-01").cast("timestamp"), F.lit("2031-01-01").cast("timestamp")).first()
    assert (empty["rows"], empty["ms_p50"], empty["session_distinct"]) == (0, None, 0)


def test_a_table_is_read_in_parts_of_its_key(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(10 + 3 * i if i % 40 else None, float(i)) for i in range(1000)], "id long, v double")
    rows.write.jdbc(url, "telemetry", "overwrite")
    got = files.read_telemetry_parts(spark, url, "telemetry", "id", rows_per_part=150)
    assert got.rdd.getNumPartitions() == 7
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    some = got.where("v > 900").select("v")
    assert sorted(r["v"] for r in some.collect()) == [float(i) for i in range(901, 1000)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,900.0)" in plan.split("PushedFilters")[1] and "id" not in plan.split("ReadSchema")[1]
    rows.where("false").write.jdbc(url, "nothing", "overwrite")
    assert files.read_telemetry_parts(spark, url, "nothing", "id").collect() == []


def test_lemmas_of_unknown_words_go_by_the_longest_ending(spark):
    pairs = [("walking", "walk"), ("talking", "talk"), ("king", "king"), ("cities", "city"), ("ladies", "lady"), ("cats", "cat"), ("dogs", "dog"), ("went", "go"), ("столы", "стол"), ("коты", "кот")]
    lemmas = spark.createDataFrame(pairs, "form string, lemma string")
    endings = {r["ending"]: (r["cut"], r["added"]) for r in I.learn_endings(lemmas).collect()}
    assert endings["ing"] == (3, "") and endings["king"] in ((0, ""), (3, "")) and endings["ies"] == (3, "y") and endings["s"] == (1, "")
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(["walking", "running", "parties", "maps", "is", "дубы", "went", "42", "sing"])], "i int, term string")
    got = {r["i"]: r["term"] for r in I.lemmatized(tokens, lemmas, I.learn_endings(lemmas)).collect()}
    assert got == {0: "walk", 1: "runn", 2: "party", 3: "map", 4: "is", 5: "дуб", 6: "go", 7: "42", 8: "sing"}
    assert I.lemmatized(tokens, None) is tokens and {r["term"] for r in I.lemmatized(tokens, lemmas).collect()} >= {"walk", "running"}


def test_sections_keep_their_order_and_chunks_their_totals(spark, tmp_path):
    (tmp_path / "sections").mkdir()
    (tmp_path / "sections" / "d1.json").write_text('{"z": {"title": "last", "text": "1"}, "a": {"title": "first", "text": "2"}, "m": {"text": "3"}}')
    (tmp_path / "sections" / "bad.json").write_text('{"z": ')
    got = files.read_sections(spark, f"{tmp_path}/sections")
    assert [(r["pos"], r["section_id"]) for r in got.orderBy("pos").collect()] == [(0, "z"), (1, "a"), (2, "m")]
    chunks = spark.createDataFrame([("c1", "a", True, "x"), ("c2", "a", False, "x"), ("c3", "b", True, "y")], "chunk_id string, doc_id string, is_indexed boolean, cluster string")
    files.write_chunks(chunks, f"{tmp_path}/chunks", f"{tmp_path}/totals")
    files.write_chunks(chunks.where("cluster = 'y'").unionByName(chunks.where("chunk_id = 'c3'").withColumn("chunk_id", F.lit("c4"))), f"{tmp_path}/chunks", f"{tmp_path}/totals")
    totals = spark.read.parquet(f"{tmp_path}/totals")
    assert sorted((r["cluster"], r["doc_id"], r["chunk_count"], r["indexed_count"]) for r in totals.collect()) == [("x", "a", 2, 1), ("y", "b", 2, 2)]
