"""Operators on small tables: the quirks that the driver's tables do not show."""

import datetime

from pyspark.sql import functions as F

from folioworks.functions import text as X
from folioworks.operators import checks as K
from folioworks.operators import chunking as C
from folioworks.operators import index as I
from folioworks.operators import pages as P
from folioworks.operators import retrieval as R
from folioworks.operators import sections as S
from folioworks.operators import telemetry as T
from folioworks.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_markdown_tree(spark):
    md = "lost\n# A\none\n### C\n\ndeep\n## B\n##### no\n# D"
    tree = S.section_rollup(S.section_tree(S.md_headings(spark.createDataFrame([(1, md), (2, "plain ")], "doc_id long, text string"))))
    got = {(r["doc_id"], r["section_id"]): (r["parent_section_id"], r["path"], r["text"], r["is_leaf"]) for r in tree.collect()}
    assert got[(1, "h1_1")] == (None, ["h1_1"], "one\n\ndeep\n\n##### no", False)
    assert got[(1, "h3_1")] == ("h1_1", ["h1_1", "h3_1"], "deep", True)
    assert got[(1, "h2_1")][0] == "h1_1" and got[(1, "h1_2")] == (None, ["h1_2"], "", True)
    assert got[(2, "h1_1")] == (None, ["h1_1"], "plain ", True)


def test_chunks_of_large_and_small_sections(spark):
    long = "word " * 300
    md = f"# Top\nintro\n## Small\nshort\n## Large\n{long}"
    docs = spark.createDataFrame([("d", md)], "doc_id string, text string")
    catalog = spark.createDataFrame([("d", "synthetic", "law", None, "c", "1.2.2023")], "doc_id string, source_type string, doc_type string, doc_subtype string, cluster string, approval_date string")
    tree = S.section_rollup(S.section_tree(S.md_headings(docs)))
    chunks = C.build_chunks(tree, catalog, F.lit("2024-01-01")).cache()
    got = {r["chunk_id"]: r for r in chunks.collect()}
    assert got["d__h1_1__ord_1__parent"]["is_indexed"] is False and got["d__h1_1__ord_1__parent"]["as_of_date"] == "2023-02-01"
    assert got["d__h1_1__h2_1__ord_2__0"]["parent_chunk_id"] == "d__h1_1__ord_1__parent"
    children = [r for r in got.values() if r["chunk_type"] == "split_child"]
    assert {r["parent_chunk_id"] for r in children} == {"d__h1_1__h2_2__ord_3__parent"} and all(r["chunk_total"] == len(children) for r in children)
    assert C.chunk_totals(chunks).first()["indexed_count"] == len(children) + 1
    small = spark.createDataFrame([("d", None, None, 5)], "doc_id string, child_max int, overlap int, parent_max int")
    again = {r["chunk_id"]: r["parent_chunk_id"] for r in C.build_chunks(tree, catalog, F.lit("2024-01-01"), small).collect()}
    assert "d__h1_1__ord_1__parent" not in again and again["d__h1_1__h2_1__ord_2__0"] is None


def test_tokens(spark):
    df = spark.createDataFrame([("По ст. 7.1 и 115-ФЗ, № 3624 - У, ПОД/ФТ, abc12; 115 фз",)], "t string")
    got = df.select(I.tokenize(F.col("t")).alias("t")).first()["t"]
    assert got == ["по", "ст.7.1", "и", "115-фз", "115", "фз", "3624-у", "3624", "под/фт", "под", "фт", "abc12", "фз"]


def test_idf_floor_and_scores(spark):
    chunks = spark.createDataFrame([("c", 1, "cat dog"), ("c", 2, "cat"), ("c", 3, "cat bird"), ("e", 4, "fish")], "cluster string, chunk_id long, text string")
    index = I.bm25_index(chunks)
    idf = {(r["cluster"], r["term"]): r["idf"] for r in index[1].collect()}
    assert 0 < idf[("c", "dog")] and abs(idf[("c", "cat")]) < idf[("c", "dog")]
    found = I.bm25_query_all(spark.createDataFrame([(1, "dog bird")], "query_id int, text string"), index)
    assert {r["chunk_id"] for r in found.collect()} == {1, 3}


def test_rrf_keeps_first_seen_on_ties(spark):
    lists = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (1, 2, 2, "b")], "query_id int, list int, rank int, chunk_id string")
    got = {r["chunk_id"]: (r["rank"], round(r["score"], 6)) for r in R.rrf(lists).collect()}
    assert got == {"b": (1, round(2 / 62, 6)), "a": (2, round(1 / 61, 6)), "c": (3, round(1 / 61, 6))}


def test_metrics_count_cases_without_hits_and_pass_one(spark):
    cases = spark.createDataFrame([(1, "x", 7, ""), (2, "x", 8, "п. 3.1")], "case_id int, difficulty string, expected_doc_id int, source_hint string")
    hits = spark.createDataFrame([(1, 1, 7, "s", "t"), (1, 2, 7, "s", "t")], "case_id int, rank int, doc_id int, section_title string, text string")
    got = {r["case_id"]: r for r in R.case_metrics(R.graded_relevance(hits, cases), cases, 5).collect()}
    assert got[1]["ndcg_doc"] > 1 and got[1]["precision_doc"] == 0.4 and got[2]["recall_doc"] == 0.0
    match = spark.createDataFrame([("п. 3.1", "раздел 3.1", ""), ("п. 3.1", "x", "см. 3.1"), ("", "x", "y"), ("Ёж", "ежи", "")], "h string, s string, t string")
    assert [r[0] for r in match.select(R.hint_match(F.col("h"), F.col("s"), F.col("t"))).collect()] == [True, True, False, True]


def test_tune_k_without_a_feasible_k(spark):
    cases = spark.createDataFrame([(1, "x", 7, "")], "case_id int, difficulty string, expected_doc_id int, source_hint string")
    rel = spark.createDataFrame([(1, 3, 1, 1)], "case_id int, rank int, rel_doc int, rel_hint int")
    got = R.tune_k(rel, cases, (2, 3, 5), min_recall=2.0).collect()
    assert [r["k"] for r in got if r["recommended"]] == [3] and not any(r["feasible"] for r in got)


def test_html_grid_spans_nested_tables_and_noise():
    html = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><article><h1>Head</h1><p>a  b<br>c</p><table><caption>Cap</caption><tr><td rowspan=2>r|1</td><td colspan=2>x</td></tr><tr><td>y</td><td>z</td></tr></table><div class='ad'>no</div></article></body></html>"
    title, text, _, error = P.extract(html, P.Profile())
    assert title == "Head" and error is None
    assert text == "Head\na b\nc\n\nCap\n⟦TABLE id=T1⟧\n| r\\|1 | x | x |\n| --- | --- | --- |\n| r\\|1 | y | z |\n⟦/TABLE⟧"
    assert P.extract("<p>x", P.Profile(containers=("div#none",)))[3] == "no container"
    assert P.decode("тест".encode("cp1251")) == "тест" and P.decode("<meta charset=windows-1251>тест".encode()).endswith("тест")


def test_text_columns(spark):
    df = spark.createDataFrame([("сло-\nво -\n⟦x\n\n\n\nend", "от 31.02.2020, 01/03/2021 и 5 мая 2022 года")], "a string, b string")
    r = df.select(X.normalize_text(F.col("a")).alias("a"), X.extract_dates(F.col("b")).alias("b")).first()
    assert r["a"] == "слово -\n⟦x\n\nend" and r["b"] == [datetime.date(2021, 3, 1), datetime.date(2022, 5, 5)]
    table = spark.createDataFrame([([["a|b", " c\n d "], ["1"]],), ([[None, " "]],)], "r array<array<string>>").select(X.format_table(F.col("r"), F.lit("T1")).alias("t"))
    assert [r["t"] for r in table.collect()] == ["⟦TABLE id=T1⟧\n| a\\|b | c d |\n| --- | --- |\n| 1 |  |\n⟦/TABLE⟧", ""]


def test_error_sessions_put_unknown_shares_first(spark):
    s = spark.createDataFrame([("a", 10, 5), ("b", 0, 1), ("c", 3, 0)], "session_id string, request_count long, error_count long")
    assert [(r["session_id"], r["error_pct"]) for r in T.error_sessions(s).collect()] == [("b", None), ("a", 50.0)]


def test_run_totals_of_a_parse_session_count_skips_as_ok(spark):
    sessions = spark.createDataFrame([("s", datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 0, 1)), ("t", datetime.datetime(2024, 1, 1), None)], "session_id string, started_at timestamp, finished_at timestamp")
    results = spark.createDataFrame([("s", "ok", 1), ("s", "skipped", 0), ("s", "failed", 0)], "session_id string, status string, chunks long")
    got = {r["session_id"]: (r["docs_ok"], r["docs_failed"], r["duration_sec"]) for r in T.run_totals(sessions, results, "parse").collect()}
    assert got == {"s": (2, 1, 60.0), "t": (0, 0, None)}


def test_reference_context_budget(spark):
    refs = spark.createDataFrame([("d", 1, "r", "a", ""), ("d", 2, "r", "b", ""), ("d", 3, "r", "c", ""), ("e", 1, "r", "gone", "")], "doc_id string, pos int, ref_doc string, section_id string, note string")
    sections = spark.createDataFrame([("r", "a", "A", "x" * 500), ("r", "b", "B", "y" * 700), ("r", "c", "C", "z")], "doc_id string, section_id string, title string, text string")
    got = {r["doc_id"]: r for r in K.reference_context(refs, sections, 600, 1000).collect()}
    assert got["d"]["notes"] == "r b: shortened; r c: skipped" and got["e"]["missing"] == "r gone" and got["e"]["context"] is None


def test_readers_skip_malformed_files(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.json").write_text('{"doc_id": "a", "questions": [{"id": "1", "question": "?"}]}')
    (tmp_path / "q/b.json").write_text('{"doc_id": ')
    assert rows(files.read_questions(spark, str(tmp_path / "q")), "doc_id", "id", "question") == [("a", "1", "?")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/doc-1.json").write_text('{"п.1": {"title": "T", "text": "x", "metadata": {"tables": [{"table_id": "T1"}]}}, "п.2": {"text": "y"}}')
    (tmp_path / "s/bad.json").write_text("[")
    assert rows(files.read_sections(spark, str(tmp_path / "s")), "doc_id", "section_id", "text") == [("doc-1", "п.1", "x"), ("doc-1", "п.2", "y")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/d.json").write_text('{"doc_id": "d", "sections": [{"section_id": "h1_1", "level": 1, "text": "a", "children": [{"section_id": "h2_1", "level": 2, "text": "b"}]}]}')
    assert rows(files.read_section_tree(spark, str(tmp_path / "t")), "section_id", "level") == [("h1_1", 1), ("h2_1", 2)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.json").write_text('{"doc_id": "d", "chunked_at": "2024", "chunks": [{"chunk_id": "1", "text": "t"}]}')
    assert rows(files.read_chunks(spark, str(tmp_path / "c")), "chunk_id", "chunked_at") == [("1", "2024")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/note.md").write_text("# A")
    assert rows(files.read_markdown(spark, str(tmp_path / "m")), "doc_id", "text") == [("note", "# A")]
    (tmp_path / "r").mkdir()
    for name, head in (("a", b"%PDF-1"), ("b", b"PK\x03\x04"), ("c", b"{\\rtf1"), ("d", b"<html>")):
        (tmp_path / "r" / name).write_bytes(head)
    assert sorted(r["format"] for r in files.read_raw(spark, str(tmp_path / "r")).collect()) == ["html", "pdf", "rtf", "zip"]


def test_sections_of_a_regulation_keep_the_best_of_repeats(spark):
    from folioworks.operators import sections as S

    rows = [
        (1, 0, "гл.2", None, "Глава 2. См. предыдущую редакцию и ещё очень длинный текст"), (1, 1, "п.2.1", "гл.2", "2.1. см. будущую"), (1, 2, "гл.2", None, "Глава 2. Общее"), (1, 3, "п.2.1", "гл.2", "2.1. норма"),
        (1, 4, "гл.3", None, "Глава 33. Не та"), (1, 5, "гл.3", None, "3.1. Пункт вместо заголовка"), (1, 6, "Приложение 1", None, "текст без заголовка"), (1, 7, "Приложение 1", None, "Приложение N 1 к Положению"),
    ]
    x = S.child_counts(spark.createDataFrame(rows, "doc_id long, pos int, section_id string, parent_section_id string, text string"))
    assert [r["children"] for r in x.orderBy("pos").collect()] == [1, 0, 1, 0, 0, 0, 0, 0]
    top = {r["section_id"]: (r["pos"], r["text"]) for r in S.dedupe_sections(x.where("parent_section_id IS NULL"), S.chapter_priority()).collect()}
    assert top == {"гл.2": (0, rows[2][4]), "гл.3": (4, rows[4][4]), "Приложение 1": (6, rows[7][4])}
    points = {r["section_id"]: r["text"] for r in S.dedupe_sections(x.where("parent_section_id IS NOT NULL"), S.point_priority()).collect()}
    assert points == {"п.2.1": "2.1. норма"}


def test_a_code_stands_where_its_first_section_does(spark):
    from folioworks.operators.sections import code_rows

    rows = [(1, "s2", 0, "| 101 | short |"), (1, "s10", 1, "\n| 101 | the longest of all |"), (1, "s1", 2, "| 101 | mid one |")]
    docs = spark.createDataFrame(rows, "doc_id long, section_id string, pos int, text string")
    [got] = code_rows(docs).collect()
    assert (got["section_id"], got["line"], got["title"]) == ("s2", 0, "the longest of all")


def test_each_of_two_equal_tables_has_its_own_context(spark):
    from folioworks.operators.checks import table_context
    from folioworks.operators.sections import table_blocks

    block = "⟦TABLE id=T1⟧\n| a |\n| --- |\n| 1 |\n⟦/TABLE⟧"
    docs = spark.createDataFrame([(1, f"first\n{block}\nmiddle\n{block}\nlast"), (2, None)], "doc_id long, text string")
    blocks = table_blocks(docs)
    assert [r["start"] for r in blocks.orderBy("pos").collect()] == [7, 7 + len(block) + 8]
    got = sorted(r["context"] for r in table_context(blocks, docs, around=8).collect())
    assert got == sorted([f"first\n{block}\nmiddle", f"middle\n{block}\nlast"])


def test_nearest_neighbours_leave_out_vectors_that_are_not_whole(spark):
    from folioworks.operators.index import knn

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (7, []), (8, [2.0, 0.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [3.0])], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["chunk_id"]) for r in knn(q, v, 2, block=2, query_block=1).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1), (10, 2, 8), (12, 1, 6)]
    assert knn(q.where("false"), v).count() == 0 == knn(q, v.where("false")).count()


def test_spans_of_cells_reach_below_the_last_row():
    rows = P.grid([[("a", 1, 2), ("b", 5, 1)], [("c", 1, 1), ("d", 1, 300)]])
    assert len(rows[0]) == 6 and rows[1][:3] == ["a", "c", "d"] and len(rows) == 301 and rows[-1][:3] == ["", "", "d"]
    page = '<article><table><tr><td colspan="100000000">x</td><td rowspan=" 3 ">y<b>z</b></td></tr></table></article>'
    lines = P.extract(page, P.Profile())[1].split("\n")
    assert len(lines) == 6 and lines[1].count("| x ") == 1000 and lines[4].endswith("| y z |")


class Tree:
    """A tree of a page's elements and a recursive reading of it, to hold the one-pass reader against."""

    def __init__(self, html):
        from html.parser import HTMLParser

        class Parser(HTMLParser):
            def handle_starttag(p, tag, attrs):  # noqa: N805
                node = (tag, {k: v or "" for k, v in attrs}, [])
                p.open[-1][2].append(node)
                p.open += [node] if tag not in P.VOID else []

            def handle_startendtag(p, tag, attrs):  # noqa: N805
                p.open[-1][2].append((tag, {k: v or "" for k, v in attrs}, []))

            def handle_endtag(p, tag):  # noqa: N805
                at = [i for i, n in enumerate(p.open) if i and n[0] == tag]
                del p.open[at[-1] if at else len(p.open) :]

            def handle_data(p, data):  # noqa: N805
                p.open[-1][2].append(data)

        parser = Parser(convert_charrefs=True)
        parser.open = [("", {}, [])]
        root = parser.open[0]
        parser.feed(html)
        parser.close()
        self.root = root

    def nodes(self, node=None):
        for c in (node or self.root)[2]:
            if not isinstance(c, str):
                yield c
                yield from self.nodes(c)

    def texts(self, node):
        for c in node[2]:
            if isinstance(c, str):
                yield c
            else:
                yield from self.texts(c)

    def cleaned(self, node, noise):
        out, tables = [], [0]

        def visit(node):
            for c in node[2]:
                if isinstance(c, str):
                    out.append(c)
                elif any(P._matches(s, c[0], c[1]) for s in noise):
                    continue
                elif c[0] == "table":
                    kids = [x for x in c[2] if not isinstance(x, str)]
                    rows = [r for k in kids for r in ([k] if k[0] == "tr" else [x for x in k[2] if x[0] == "tr" and not isinstance(x, str)] if k[0] in ("thead", "tbody", "tfoot") else [])]
                    cells = [[(" ".join(" ".join(self.texts(d)).split()), P._span(d[1].get("colspan"), 1000), P._span(d[1].get("rowspan"), 65534)) for d in r[2] if not isinstance(d, str) and d[0] in ("td", "th")] for r in rows]
                    caption = next((" ".join("".join(self.texts(k)).split()) for k in kids if k[0] == "caption"), "")
                    if any(cells):
                        tables[0] += 1
                        block = P.pipe_block(P.grid(cells), f"T{tables[0]}", caption)
                        out.append(f"\n\n{block}\n\n" if block else "")
                else:
                    out.extend(["\n"] if c[0] in P.BLOCKS else [])
                    visit(c)

        visit(node)
        import re

        return re.sub("\n{3,}", "\n\n", "\n".join(" ".join(x.split()) for x in "".join(out).split("\n"))).strip()

    def extract(self, profile):
        nodes = list(self.nodes())
        named = {t: next((" ".join("".join(self.texts(n)).split()) for n in nodes if n[0] == t), None) for t in ("h1", "title")}
        found = next((n for s in profile.containers for n in nodes if P._matches(s, n[0], n[1])), None)
        whole = len("".join(self.cleaned(self.root, profile.noise).split()))
        return named["h1"] or named["title"], None if found is None else self.cleaned(found, profile.noise), whole, "no container" if found is None else None


def test_one_pass_reads_what_a_tree_gives():
    import random

    rng, profile = random.Random(7), P.Profile(containers=("article.a", "#x", "main", "table", "body"))
    tags = ["p", "div", "table", "tr", "td", "th", "tbody", "article", "main", "body", "script", "nav", "h1", "title", "caption", "br", "span", "b"]
    for _ in range(1500):
        parts = []
        for _ in range(rng.randrange(1, 50)):
            tag, r = rng.choice(tags), rng.random()
            if rng.random() < 0.15:
                parts.append("<table><tr><td>a b<b>c</b>")
            parts.append(f"<{tag}{rng.choice(['', ' class=ad', ' class="a b"', ' colspan=2', ' rowspan=3', ' id=x'])}>" if r < 0.45 else f"</{tag}>" if r < 0.7 else f"<{tag}/>" if r < 0.73 else rng.choice(["text ", "more\n", " ", "a b", "&amp;"]))
        html = "".join(parts)
        assert P.extract(html, profile) == Tree(html).extract(profile), html


def test_a_deeply_nested_page_gives_its_text():
    deep = 100_000
    for html in ("<div>" * deep + "deep" + "</div>" * deep, "<div>" * deep + "deep" + "</p>" * deep, "<table><tr><td>" * (deep // 3) + "deep"):
        title, text, size, error = P.extract(f"<title>t</title><body>{html}", P.Profile())
        assert "deep" in text and title == "t" and error is None and size >= 4


def test_overlap_in_columns_equals_the_plain_function(spark):
    from folioworks.functions import splitting
    from folioworks.functions.text import overlapped

    parts = [["one two three", "four", "", "a" * 30, "x y"], ["alone"], []]
    got = [r["p"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p array<string>").select("i", overlapped(F.col("p"), 8).alias("p")).orderBy("i").collect()]
    assert got == [splitting.overlapped(p, 8) for p in parts]


def test_retrieval_reads_texts_once_to_index_and_once_to_attach(spark, tmp_path):
    from folioworks.plans.index_queries import Data, hybrid

    spark.createDataFrame([(i, f"word{i % 7} other words {i}", "en", "web") for i in range(40)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i % 3) for i in range(40)], "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"word{i} words") for i in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits, facts = hybrid(Data(spark, str(tmp_path)))
    for df in (hits, facts):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") > 0 and sum("documents.parquet" in str(f) for f in df.inputFiles()) <= len(spark.read.parquet(f"{tmp_path}/documents.parquet").inputFiles())
        assert hits.count() == 25


def test_index_is_stored_and_clusters_are_replaced_alone(spark, tmp_path):
    from folioworks.operators.index import bm25_index, read_index, rebuild_dirty

    rows = [("a", 1, "red fox"), ("a", 2, "red red"), ("b", 3, "blue fox"), ("b", 4, None)]
    chunks = spark.createDataFrame(rows, "cluster string, chunk_id long, text string")
    path = f"{tmp_path}/index"
    bm25_index(chunks, path=path)
    changed = chunks.where("cluster = 'b'").unionByName(spark.createDataFrame([("b", 5, "blue bird")], chunks.schema))
    dirty = spark.createDataFrame([("b",), ("c",)], "cluster string")
    _, left = rebuild_dirty(changed, dirty, path)
    index = read_index(spark, path, "cluster string, chunk_id long")
    assert sorted((r["cluster"], r["chunk_id"], r["term"], r["tf"]) for r in index.postings.collect()) == [("a", 1, "fox", 1), ("a", 1, "red", 1), ("a", 2, "red", 2), ("b", 3, "blue", 1), ("b", 3, "fox", 1), ("b", 5, "bird", 1), ("b", 5, "blue", 1)]
    assert sorted((r["cluster"], r["n"], r["avg_len"]) for r in index.stats.collect()) == [("a", 2, 2.0), ("b", 3, 4 / 3)]
    assert [r["cluster"] for r in left.collect()] == ["c"]
