"""The pipeline's stages against brute-force versions, one after another."""

from collections import Counter

import corpus_pipeline
from folioworks.llm import components, mixing, neardup, packing, pii, quality_rules
from folioworks.sources import scratch
from tests.llm.test_operators import SCHEMA, brute_components, copies, odd_rows, plain_spans


def test_stages_in_turn(spark):
    rows = odd_rows() + [(1000 + i, t, "en", ["a", "b"][i % 2], len(t), 1, "", i, "", "") for i, t in copies(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "personal data", "mixing sources to target weights", "best-fit packing"]
    before, columns = docs, docs.columns
    results = []
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, "unused").cache()
        results.append(before)
    assert all(r.columns == columns for r in results[:-1])

    good = [r.asDict() for r in results[0].collect()]
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.judge(docs).collect()}
    want = [r for r in rows if verdict[(r[0], len((r[1] or "").split()))]]
    assert Counter(r["doc_id"] for r in good) == Counter(r[0] for r in want)

    groups, _ = brute_components([(r["doc_id"], r["text"]) for r in good], 5, 80)
    left = Counter({r["doc_id"] for r in good if r["doc_id"] is not None and groups.get(r["doc_id"], r["doc_id"]) == r["doc_id"]})
    left += Counter(r["doc_id"] for r in good if r["doc_id"] is None)  # rows of one id are one document
    assert Counter(r["doc_id"] for r in results[1].collect()) == left

    assert all(not any(plain_spans(r["text"]).values()) for r in results[2].collect()) and results[2].count() == results[1].count()
    sizes = Counter()
    for r in results[2].collect():
        sizes[r["doc_id"]] += len(r["text"].encode().split())
    mixed = Counter()
    for r in results[3].collect():
        mixed[r["doc_id"]] += len(r["text"].encode().split())
    assert all(mixed[d] <= 3 * sizes[d] for d in mixed) and abs(sum(mixed.values()) - sum(sizes.values())) <= 64
    assert Counter({d: n for d, n in mixed.items() if n}) == Counter({r["doc_id"]: r["n"] for r in results[4].groupBy("doc_id").sum("n_tokens").toDF("doc_id", "n").collect()})
    assert pii.EMPTY_SHA


def test_places_of_copies_are_told_apart_by_their_text(spark):
    texts = [(1, "a b c " * 30), (1, "a b " * 10), (2, "x " * 25)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int")
    got = {(r["doc_id"], r["text_id"]): r["n_tokens"] for r in corpus_pipeline.pack(spark, docs, "unused").collect()}
    ids = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    assert got == {(i, ids[t]): len(t.split()) for i, t in texts}


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_reads_documents(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def python_in_a_stage(plan):
    """The most Python functions that one task works at a time: those in turn without an exchange between them."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.inputPlan())
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        most.append(sum(below) if name != "UnionExec" else max(below))
        own = most[-1] + any(x in name for x in ("InArrow", "InPandas", "EvalPython"))
        most.append(own)
        return 0 if "Exchange" in name else own

    most = [0]
    walk(plan)
    return max(most)


def test_a_task_takes_one_python_worker(spark, tmp_path, monkeypatch):
    rows = odd_rows() + [(1000 + i, t, "en", ["a", "b"][i % 2], len(t), 1, "", i, "", "") for i, t in copies(4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    most, cut = {}, scratch.cut

    def seen(df, name):
        most[name] = max(most.get(name, 0), python_in_a_stage(df._jdf.queryExecution().executedPlan()))
        return cut(df, name)

    for module in (components, corpus_pipeline, mixing, neardup, packing):
        monkeypatch.setattr(module, "cut", seen)
    result = corpus_pipeline.run(spark, str(tmp_path))
    most["result"] = python_in_a_stage(result._jdf.queryExecution().executedPlan())
    assert {"prefixes", "sets", "stage"} <= set(most) and most["sets"] == 1
    assert {name: n for name, n in most.items() if n > 1} == {}


def test_the_labelled_table_needs_no_python_workers(spark):
    table = pii.labelled_table(spark)
    assert [(r["words"], r["tags"]) for r in table.collect()] == pii.labelled_rows()
    assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()
