"""Search by bounds against search of everything, tables kept by streams, aliases of aliases, TF-IDF vectors."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.operators import index as I
from folioworks.operators import lexical_top as L
from folioworks.operators import sections as S
from folioworks.operators import vector_index as V
from folioworks.streaming.streams import SessionTable


def clustered(n, dims, centres, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    v = middle[rng.integers(0, centres, n)] + 0.08 * rng.normal(size=(n, dims))
    return v.astype(np.float32).astype(float).tolist()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(clustered(3000, 8, 12))]
    same = [(10_000 + i, rows[5][1], i % 3) for i in range(1500)]  # a third of all vectors is one and the same
    odd = [(20_000, [0.0] * 8, 0), (20_001, None, 0), (20_002, [float("nan")] * 8, 0), (20_003, [1.0, None] + [0.0] * 6, 0), (20_004, [], 0)]
    return spark.createDataFrame(rows + same + odd, "chunk_id long, embedding array<float>, cluster int").repartition(4).cache()


def test_indexed_neighbours_are_those_of_all_vectors(spark, vectors, tmp_path):
    index = V.write_vector_index(vectors, f"file://{tmp_path}/index", lists=24, rounds=3)
    assert index.vectors.count() == 4501 and index.lists.agg(F.sum("n")).first()[0] == 4501
    asked = vectors.where("chunk_id % 100 = 7 OR chunk_id IN (5, 20000, 20001, 10003)").select(F.col("chunk_id").alias("query_id"), "embedding")
    for where in (None, F.col("cluster") == 1, F.col("cluster") == 9):
        got, work = V.indexed_knn(asked, index, 7, where, work=True)
        want = I.knn(asked, vectors, 7, where)
        table = lambda df: Counter((r["query_id"], r["rank"], round(r["distance"], 9)) for r in df.collect())
        assert table(got) == table(want)
        ids = {(r["query_id"], r["chunk_id"]): r["distance"] for r in want.collect()}
        # chunks of one distance may change places only where the plain product tells equal vectors apart
        last = {q: max(d for (p, _), d in ids.items() if p == q) for q, _ in ids}
        assert all((r["query_id"], r["chunk_id"]) in ids or abs(r["distance"] - last[r["query_id"]]) < 1e-9 for r in got.collect())
        if where is None:
            compared = {r["query_id"]: r["compared"] for r in work.collect()}
            few = [n for q, n in compared.items() if q < 10_000 and q != 5]
            assert sum(few) / len(few) < 0.5 * 4501  # bounds keep most vectors away from most queries


def test_index_of_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    index = V.write_vector_index(none, f"file://{tmp_path}/none", lists=4)
    assert V.indexed_knn(none.withColumnRenamed("chunk_id", "query_id"), index, 3).collect() == []


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}{d}" for a in "kmtrsp" for b in "aeiou" for c in "lnst" for d in ("", "o", "u", "i", "eh")]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(i, ["x", "y"][i % 5 == 0], " ".join(rng.choices(words, weights, k=rng.randrange(3, 60)))) for i in range(2500)]
    rows += [(5000 + i, "x", "mal common text of many chunks") for i in range(1200)] + [(9000, "z", "mal"), (9001, "z", None)]
    return spark.createDataFrame(rows, "chunk_id long, cluster string, text string").repartition(4).cache()


@pytest.mark.parametrize("slot_rows", [4096, 8])
def test_lexical_bounds_lose_nothing(spark, chunks, tmp_path, monkeypatch, slot_rows):
    monkeypatch.setattr(L, "SLOT_ROWS", slot_rows)
    index = I.bm25_index(chunks, path=f"file://{tmp_path}/index")
    blocks = L.write_blocks(index, f"file://{tmp_path}/blocks")
    rng = random.Random(2)
    terms = [r["term"] for r in blocks.terms.where("cluster = 'x'").orderBy(F.desc("df"), "term").collect()]
    asked = [(k, " ".join(terms[:4] + rng.sample(terms[-150:], 2))) for k in range(12)] + [(50, "mal"), (51, "nowhere"), (52, ""), (53, terms[0]), (54, "common text mal mal")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    got, read = L.bm25_top(queries, blocks, 5, work=True)
    assert rows(got) == rows(I.bm25_query(queries, index, 5))
    assert rows(L.bm25_top(queries, blocks, 5, everywhere=True)) == rows(I.bm25_query_all(queries, index, 5))
    one = queries.withColumn("cluster", F.lit("y"))
    assert rows(L.bm25_top(one, blocks, 5)) == rows(I.bm25_query(one, index, 5))
    if slot_rows == 8:  # of the blocks of a query's terms, many stay unread
        one = queries.where("query_id = 3").withColumn("cluster", F.lit("x"))
        _, read = L.bm25_top(one, blocks, 3, work=True)
        own = blocks.blocks.where("cluster = 'x'").join(one.select(F.explode(I.tokenize(F.col("text"))).alias("term")).distinct(), "term", "left_semi")
        assert 0 < read.count() < 0.5 * own.count()


def test_a_batch_given_again_changes_nothing(spark, tmp_path):
    rng = random.Random(1)
    events = [(rng.randrange(40), f"2024-01-01 00:{rng.randrange(60):02d}:00", rng.choice(["ok", "error", "in_progress"]), rng.choice([None, 3, 5])) for _ in range(600)]
    frame = lambda rows: spark.createDataFrame(rows, "session_id long, ts string, status string, tokens long").withColumn("ts", F.col("ts").cast("timestamp"))
    batches = [events[:150], events[150:160], [], events[160:400], events[400:]]
    table = SessionTable(spark, f"file://{tmp_path}/sessions", buckets=4)

    def state():
        return sorted(map(tuple, table.read().collect()))

    assert state() == []
    for k, batch in enumerate(batches):
        table.merge(frame(batch), k)
        once = state()
        table.merge(frame(batch), k)  # tried again after it was committed
        assert state() == once
        if k:
            table.merge(frame(batches[k - 1]), k - 1)  # an old one
            assert state() == once
    want = frame(events).groupBy("session_id").agg(F.min("ts"), F.max("ts"), F.count_if(F.col("status") != "in_progress"), F.count_if(F.col("status") == "error"), F.coalesce(F.sum("tokens"), F.lit(0)))
    assert state() == sorted(map(tuple, want.collect()))


def test_a_batch_that_failed_before_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    frame = lambda n: spark.createDataFrame([(k % 3, "ok", 1) for k in range(n)], "session_id long, status string, tokens long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    table, second = SessionTable(spark, f"file://{tmp_path}/failing", buckets=2), frame(6)
    table.merge(frame(9), 0)
    before = sorted(map(tuple, table.read().collect()))

    def lost(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lost)  # rows are written, the commit is not
        with pytest.raises(OSError, match="lost"):
            table.merge(second, 1)
    assert sorted(map(tuple, table.read().collect())) == before
    table.merge(second, 1)
    assert {r["session_id"]: r["request_count"] for r in table.read().collect()} == {0: 5, 1: 5, 2: 5}


def brute_aliases(wanted, sections):
    import re

    packed = lambda s: re.sub(r"\s+", "", s)
    bare = lambda s: s.split("(")[0].strip()
    pool, out = dict(sections), []
    for w in wanted:
        found, how = None, "not_found"
        form = packed(bare(w))
        m = re.fullmatch(r"(0409\d+)", form) or re.match(r"форм[ыа](\d+)", form)
        tried = [("exact", w), ("spaces", packed(w)), ("note", bare(w)), ("note", packed(bare(w))), ("range", None)] + ([("form", "форма" + m[1]), ("form", "форма " + m[1])] if m else [])
        for name, key in tried:
            if name == "range":
                r = re.fullmatch(r"(п\.|сч\.|гл\.)(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)", packed(bare(w)))
                parts = [t for k, t in pool.items() if r and (n := re.fullmatch(r"(п\.|сч\.|гл\.)(\d+(?:\.\d+)?)", packed(k))) and n[1] == r[1] and float(r[2]) <= float(n[2]) <= float(r[3])]
                if "\n\n".join(parts):
                    found, how = "\n\n".join(parts), name
                    break
            elif key in pool:
                found, how = pool[key], name
                break
        if how not in ("exact", "not_found"):
            pool[w] = found
        out.append((w, how, found))
    return out


def test_aliases_of_aliases(spark):
    sections = {"п.1": "one", "п.2": "two", "п.3": "", "сч.7": "", "п.2.5": "two and a half", "форма 0409115": "a form", "гл. 4": "chapter"}
    wanted = ["п. 2", "п.1-3", "п.1-3(part)", "п. 1-3 (part)", "п.1 (x)", "п.1-2 (again)", "гл.4", "гл. 4", "сч.1-9", "формы 0409115", "0409115 (old)", "п.1-3", "п.8-9", "п. 8-9", ""]
    rng = random.Random(5)
    asked, rows = [], []
    for doc in range(6):
        own = wanted if doc == 0 else rng.choices(wanted, k=12)
        kept = sections if doc < 2 else dict(rng.sample(list(sections.items()), 4))
        asked += [(doc, i, w) for i, w in enumerate(own)]
        rows += [(doc, i, k, t) for i, (k, t) in enumerate(kept.items())]
    got = S.resolve_aliases_in_turn(spark.createDataFrame(asked, "doc_id long, pos int, wanted_id string"), spark.createDataFrame(rows, "doc_id long, pos int, section_id string, text string"))
    found = {(r["doc_id"], r["pos"]): (r["wanted_id"], r["strategy"], r["text"]) for r in got.collect()}
    for doc in range(6):
        own = [w for d, _, w in asked if d == doc]
        want = brute_aliases(own, {k: t for d, _, k, t in rows if d == doc})
        assert [found[doc, i] for i in range(len(own))] == want
    assert [found[0, i][1] for i in range(4)] == ["spaces", "range", "note", "spaces"]


def test_tfidf_by_hand(spark):
    rows = [(1, "a b b"), (2, "A c"), (3, None), (4, " "), (5, "a")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    got = {r["chunk_id"]: r["embedding"] for r in I.tfidf_vectors(chunks, I.fit_tfidf(chunks, 1 << 12)).collect()}
    idf = {"a": math.log(6 / 4), "b": math.log(6 / 2), "c": math.log(6 / 2)}
    assert sorted(v for v in got[1] if v) == pytest.approx(sorted(np.array([idf["a"], 2 * idf["b"]]) / math.hypot(idf["a"], 2 * idf["b"])), abs=1e-6)
    assert [sum(1 for v in got[k] if v) for k in (2, 3, 4, 5)] == [2, 0, 0, 1] and max(got[5]) == pytest.approx(1)
    held = [{i for i, v in enumerate(got[k]) if v} for k in (1, 2, 5)]
    assert held[2] == held[0] & held[1]


def test_a_stored_index_follows_its_table(spark, tmp_path):
    from folioworks.plans.index_queries import Data, built

    def put(n):
        rows = [(i, f"word{i} common", "en", "web") for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    put(5)
    one, again = built(Data(spark, str(tmp_path))), built(Data(spark, str(tmp_path)))
    assert one.stats.first()["n"] == 5 and one.postings.inputFiles() == again.postings.inputFiles()
    put(8)
    assert built(Data(spark, str(tmp_path))).stats.first()["n"] == 8
