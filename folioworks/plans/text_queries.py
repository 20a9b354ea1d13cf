"""Queries on texts: sections, tables, chunks, aliases. Where the driver's documents have no headings, tables or anchors,
texts are made of its other tables by Spark: Markdown of conversations, tables of orders, laws and regulations of the
orders of a customer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import text as X
from folioworks.operators import chunking as C
from folioworks.operators import sections as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Texts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @staticmethod
    def _joined(x: DataFrame, by: str, order: str, part: str, glue: str = "\n") -> DataFrame:
        """One text for each value of by: part of each row, in the order given."""
        listed = F.sort_array(F.collect_list(F.struct(F.expr(order).alias("o"), F.expr(part).alias("p"))))
        return x.groupBy(F.expr(by).alias("doc_id")).agg(F.array_join(F.transform(listed, lambda r: r["p"]), glue).alias("text"))

    @property
    def markdown(self) -> DataFrame:
        level = "CASE role WHEN 'system' THEN '#' WHEN 'user' THEN '##' ELSE '###' END"
        return self._joined(self.read("conversations"), "conv_id", "turn", f"concat({level}, ' ', role, ' ', turn, '\n', text)")

    @property
    def orders(self) -> DataFrame:
        """Orders numbered within their customer."""
        return self.read("orders").selectExpr(
            "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "CAST(o_totalprice AS BIGINT) AS price", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n"
        )

    @property
    def tables(self) -> DataFrame:
        """A document for each order with its lines as a table."""
        cells = "array(CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), l_returnflag)"
        rows = F.sort_array(F.collect_list(F.expr(f"struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, {cells} AS c)")))
        head = F.array(F.array(*map(F.lit, ("line", "part", "quantity", "flag"))))
        x = self.read("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(head, F.transform(rows, lambda r: r["c"])).alias("rows"))
        return x.withColumn("block", X.format_table(F.col("rows"), F.lit("T1"))).withColumn("text", F.concat(F.lit("Order "), "doc_id", F.lit("\n\n"), "block", F.lit("\n\nend")))

    @property
    def laws(self) -> DataFrame:
        return self._joined(self.orders, "o_custkey", "n", "concat('Статья ', n, '. ', o_orderpriority, '\nЗаказ ', o_orderkey, ' на сумму ', price, '.')")

    @property
    def regulations(self) -> DataFrame:
        point = "concat(n, '.', m, '. деталь ', l_partkey, ' количество ', CAST(l_quantity AS INT))"
        lines = self.read("lineitem").selectExpr("l_orderkey AS o_orderkey", "l_partkey", "l_quantity", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS m")
        x = self.orders.join(lines, "o_orderkey")
        heads = self.orders.selectExpr("o_custkey", "n", "0 AS m", "concat('Глава ', n, '. Заказ ', o_orderkey) AS p")
        every = x.selectExpr("o_custkey", "n", "m", f"{point} AS p").unionByName(heads)
        return self._joined(every, "o_custkey", "struct(n, m)", "p")

    @property
    def sections(self) -> DataFrame:
        """Sections as rows: points, and one form for each order."""
        points = self.orders.selectExpr("o_custkey AS doc_id", "n AS pos", "concat('п.', n) AS section_id", "concat('заказ ', o_orderkey) AS text")
        forms = self.orders.selectExpr("o_custkey AS doc_id", "1000 + n AS pos", "concat('форма 0409', 100 + n) AS section_id", "concat('форма заказа ', o_orderkey) AS text")
        return points.unionByName(forms)

    @property
    def catalog(self) -> DataFrame:
        return self.documents.selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN 'synthetic' ELSE 'real' END AS source_type", "'law' AS doc_type", "source AS doc_subtype", "lang AS cluster", "concat('0', 1 + doc_id % 9, '.11.2023') AS approval_date")

    @property
    def run_chunks(self) -> DataFrame:
        """Chunks of documents whose every character is made the same letter: their pieces are plain cuts, which SQL can
        follow."""
        docs = self.documents.selectExpr("doc_id", "repeat(char(97 + doc_id % 26), length(text)) AS text")
        tree = S.section_rollup(S.section_tree(S.md_headings(docs)))
        return C.build_chunks(tree, self.catalog, F.lit("2024-01-01"))

    @property
    def chunks(self) -> DataFrame:
        return C.chunk_texts(self.documents.select("doc_id", "text"), self.catalog, F.lit("2024-01-01"))


BIND = """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS m FROM lineitem),
md AS (SELECT conv_id AS doc_id, string_agg(concat(CASE role WHEN 'system' THEN '#' WHEN 'user' THEN '##' ELSE '###' END, ' ', role, ' ', turn, chr(10), text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
lh AS (SELECT *, CASE WHEN regexp_matches(s, '^(#{1,4})\\s+(.*\\S.*)$') THEN 1 ELSE 0 END AS is_h FROM l),
lo AS (SELECT *, CAST(sum(is_h) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ord FROM lh),
h AS (SELECT doc_id, ord AS "order", CAST(max(CASE WHEN is_h = 1 THEN length(regexp_extract(s, '^(#{1,4})\\s+(.*\\S.*)$', 1)) END) AS INTEGER) AS level,
  max(CASE WHEN is_h = 1 THEN trim(regexp_extract(s, '^(#{1,4})\\s+(.*\\S.*)$', 2)) END) AS title, coalesce(trim(string_agg(CASE WHEN is_h = 0 THEN s END, chr(10) ORDER BY i), concat(' ', chr(10), chr(13), chr(9))), '') AS own_text
  FROM lo WHERE ord > 0 GROUP BY 1, 2),
hs AS (SELECT *, concat('h', level, '_', row_number() OVER (PARTITION BY doc_id, level ORDER BY "order")) AS section_id FROM h),
hp AS (SELECT a.*, (SELECT max(b."order") FROM hs b WHERE b.doc_id = a.doc_id AND b."order" < a."order" AND b.level < a.level) AS up FROM hs a),
tr AS (SELECT doc_id, "order", section_id, CAST(NULL AS VARCHAR) AS parent, section_id AS path FROM hp WHERE up IS NULL
  UNION ALL SELECT c.doc_id, c."order", c.section_id, p.section_id, concat(p.path, '/', c.section_id) FROM hp c JOIN tr p ON c.doc_id = p.doc_id AND c.up = p."order"),
blocks AS (SELECT l_orderkey AS doc_id, concat('⟦TABLE id=T1⟧', chr(10), '| line | part | quantity | flag |', chr(10), '| --- | --- | --- | --- |', chr(10),
  string_agg(concat('| ', l_linenumber, ' | ', l_partkey, ' | ', CAST(l_quantity AS INTEGER), ' | ', l_returnflag, ' |'), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), chr(10), '⟦/TABLE⟧') AS block, count(*) AS n FROM lineitem GROUP BY 1),
sec AS (SELECT o_custkey AS doc_id, n AS pos, concat('п.', n) AS section_id, concat('заказ ', o_orderkey) AS text FROM o
  UNION ALL SELECT o_custkey, 1000 + n, concat('форма 0409', 100 + n), concat('форма заказа ', o_orderkey) FROM o)
"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Texts], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Texts(spark, sf_dir))
        if sql:
            ORACLES[name] = BIND + sql
        return f

    return add


@query("md_headings", "SELECT * FROM h")
def _(t: Texts) -> DataFrame:
    return S.md_headings(t.markdown)


@query("section_tree", 'SELECT doc_id, "order", section_id, parent AS parent_section_id, path FROM tr')
def _(t: Texts) -> DataFrame:
    return S.section_tree(S.md_headings(t.markdown)).select("doc_id", "order", "section_id", "parent_section_id", F.array_join("path", "/").alias("path"))


@query("section_rollup", """
, r AS (SELECT a.doc_id, a.section_id, coalesce(string_agg(CASE WHEN b.own_text <> '' THEN b.own_text END, concat(chr(10), chr(10)) ORDER BY b."order"), '') AS text, count(*) = 1 AS is_leaf
  FROM tr x JOIN hs a USING (doc_id, section_id) JOIN tr y ON y.doc_id = x.doc_id AND (y.path = x.path OR starts_with(y.path, concat(x.path, '/'))) JOIN hs b ON b.doc_id = y.doc_id AND b.section_id = y.section_id GROUP BY 1, 2)
SELECT doc_id, section_id, text, CAST(length(text) AS INTEGER) AS char_count, is_leaf FROM r""")
def _(t: Texts) -> DataFrame:
    return S.section_rollup(S.section_tree(S.md_headings(t.markdown))).select("doc_id", "section_id", "text", "char_count", "is_leaf")


@query("format_table", "SELECT doc_id, block FROM blocks")
def _(t: Texts) -> DataFrame:
    return t.tables.select("doc_id", "block")


@query("table_blocks", """SELECT doc_id, 0 AS pos, 'T1' AS table_id, '| line | part | quantity | flag |' AS header, '| --- | --- | --- | --- |' AS separator, CAST(n AS INTEGER) AS n_rows, block AS raw, CAST(length(concat('Order ', doc_id)) + 3 AS INTEGER) AS start FROM blocks""")
def _(t: Texts) -> DataFrame:
    return S.table_blocks(t.tables.select("doc_id", "text")).withColumn("n_rows", F.size("rows")).drop("rows")


@query("table_stats", "SELECT doc_id, 'T1' AS table_id, CAST(n AS INTEGER) AS row_count, 4 AS column_count FROM blocks")
def _(t: Texts) -> DataFrame:
    return S.table_stats(S.table_blocks(t.tables.select("doc_id", "text")))


@query("table_ids", "SELECT doc_id, 'T1' AS ids FROM blocks")
def _(t: Texts) -> DataFrame:
    return t.tables.select("doc_id", F.array_join(X.table_ids(F.col("text")), ",").alias("ids"))


@query("mask_tables", "SELECT doc_id, concat('Order ', doc_id, chr(10), chr(10), regexp_replace(block, '[^\n]', ' ', 'g'), chr(10), chr(10), 'end') AS masked FROM blocks")
def _(t: Texts) -> DataFrame:
    return S.mask_tables(t.tables.select("doc_id", "text"))


@query("compact_table", """
, r AS (SELECT l_orderkey AS doc_id, concat('| ', l_linenumber, ' | ', l_partkey, ' | ', CAST(l_quantity AS INTEGER), ' | ', l_returnflag, ' |') AS row, count(*) OVER (PARTITION BY l_orderkey) AS n,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
s AS (SELECT doc_id, k, row FROM r WHERE n <= 4 OR k <= 2 OR k > n - 2 UNION ALL SELECT DISTINCT doc_id, 2.5, concat('| ... | Пропущено ', n - 4, ' строк для сокращения prompt |') FROM r WHERE n > 4)
SELECT doc_id, 'T1' AS table_id, concat('⟦TABLE id=T1⟧', chr(10), '| line | part | quantity | flag |', chr(10), '| --- | --- | --- | --- |', chr(10), string_agg(row, chr(10) ORDER BY k), chr(10), '⟦/TABLE⟧') AS compact FROM s GROUP BY 1""")
def _(t: Texts) -> DataFrame:
    return S.compact_table(S.table_blocks(t.tables.select("doc_id", "text")), max_rows=4)


def packed_sql(parts: str, glue: str, limit: str) -> str:
    """Runs of non-empty parts, as long as they fit into limit: a fold with the runs so far and the open one."""
    fold = f"""list_reduce(list_transform(list_filter({parts}, lambda v: v <> ''), lambda v: {{'done': CAST([] AS VARCHAR[]), 'run': v}}),
  lambda a, b: CASE WHEN length(a.run) + length({glue}) + length(b.run) > {limit} THEN {{'done': list_append(a.done, a.run), 'run': b.run}} ELSE {{'done': a.done, 'run': concat(a.run, {glue}, b.run)}} END)"""
    return f"list_transform([{fold}], lambda z: CASE WHEN z IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_append(z.done, z.run) END)[1]"


def split_sql(name: str, source: str, key: str, limit: int, overlap: int) -> str:
    """CTEs that end in name (key, index, total, text): the texts of source cut level by level, at ever finer separators, and
    the overlaps put before the pieces."""
    out, before = [f"{name}_0 AS (SELECT {key}, [coalesce(text, '')] AS l, coalesce(text, '') AS whole FROM {source})"], f"{name}_0"
    for k, glue in enumerate(("concat(chr(10), chr(10))", "chr(10)", "'. '", "'; '", "', '", "' '")):
        cut = packed_sql(f"string_split(t, {glue})", glue, str(limit))
        out.append(f"{name}_{k + 1} AS (SELECT {key}, whole, flatten(list_transform(l, lambda t: CASE WHEN length(t) <= {limit} OR NOT contains(t, {glue}) THEN [t] ELSE {cut} END)) AS l FROM {before})")
        before = f"{name}_{k + 1}"
    widths = f"list_transform(range(0, CAST(length(t) AS BIGINT), {limit}), lambda i: substr(t, i + 1, {limit}))"
    out.append(f"{name}_7 AS (SELECT {key}, whole, CASE WHEN length(whole) <= {limit} THEN [whole] ELSE flatten(list_transform(l, lambda t: CASE WHEN length(t) <= {limit} THEN [t] ELSE {widths} END)) END AS l FROM {before})")
    tail = f"CASE WHEN contains(right(l[i - 1], {overlap}), ' ') THEN substr(right(l[i - 1], {overlap}), instr(right(l[i - 1], {overlap}), ' ') + 1) ELSE right(l[i - 1], {overlap}) END"
    piece = f"CASE WHEN i = 1 OR {overlap} = 0 OR {tail} = '' THEN l[i] ELSE concat({tail}, ' ', l[i]) END"
    out.append(f"{name} AS (SELECT {key}, CAST(i - 1 AS INTEGER) AS index, CAST(len(l) AS INTEGER) AS total, {piece} AS text FROM (SELECT *, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS i FROM {name}_7))")
    return ", " + ",\n".join(out)


@query("split_table_aware", f"""
, tg AS (SELECT l_orderkey AS doc_id, list(concat('| ', l_linenumber, ' | ', l_partkey, ' | ', CAST(l_quantity AS INTEGER), ' | ', l_returnflag, ' |') ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rows FROM lineitem GROUP BY 1),
tf AS (SELECT doc_id, block, {packed_sql('rows', 'chr(10)', '160 - 83')} AS runs FROM tg JOIN blocks USING (doc_id)),
th AS (SELECT doc_id, list_concat(list_concat([concat('Order ', doc_id)], CASE WHEN length(block) <= 160 THEN [block] ELSE
  list_transform(runs, lambda r: concat('⟦TABLE id=T1⟧', chr(10), '| line | part | quantity | flag |', chr(10), '| --- | --- | --- | --- |', chr(10), r, chr(10), '⟦/TABLE⟧')) END), ['end']) AS parts FROM tf),
tp AS (SELECT doc_id, {packed_sql('parts', 'concat(chr(10), chr(10))', '160')} AS l FROM th)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS index, CAST(len(l) AS INTEGER) AS total, unnest(l) AS text FROM tp""")
def _(t: Texts) -> DataFrame:
    return C.split_text(t.tables.select("doc_id", "text"), 160, 0)


@query("split_text", split_sql("cut", "documents", "doc_id", 800, 120) + "SELECT * FROM cut")
def _(t: Texts) -> DataFrame:
    return C.split_text(t.documents.select("doc_id", "text"), table_aware=False)


@query("split_articles", "SELECT o_custkey AS doc_id, CAST(n - 1 AS INTEGER) AS pos, concat('ст.', n) AS section_id, o_orderpriority AS title, concat('Заказ ', o_orderkey, ' на сумму ', price, '.') AS text, false AS service FROM o")
def _(t: Texts) -> DataFrame:
    return S.split_articles(t.laws)


CHAPTERS = """
, p AS (SELECT o_custkey AS doc_id, n, m, concat('п.', n, '.', m) AS section_id, concat('гл.', n) AS parent_section_id, concat(n, '.', m, '. деталь ', l_partkey, ' количество ', CAST(l_quantity AS INTEGER)) AS text FROM o JOIN li ON l_orderkey = o_orderkey),
c AS (SELECT o_custkey AS doc_id, o.n, 0 AS m, concat('гл.', o.n) AS section_id, CAST(NULL AS VARCHAR) AS parent_section_id, concat('Заказ ', o_orderkey) AS title,
  concat_ws(chr(10), concat('Глава ', o.n, '. Заказ ', o_orderkey), (SELECT string_agg(text, chr(10) ORDER BY m) FROM p WHERE p.doc_id = o_custkey AND p.n = o.n)) AS text FROM o),
u AS (SELECT * FROM c UNION ALL SELECT doc_id, n, m, section_id, parent_section_id, '', text FROM p)"""


@query("split_chapters", CHAPTERS + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, m) - 1 AS INTEGER) AS pos, section_id, parent_section_id, title, text FROM u")
def _(t: Texts) -> DataFrame:
    return S.split_chapters(t.regulations)


@query("dedupe_sections", """
, d AS (SELECT o_custkey AS doc_id, n - 1 AS pos, concat('ст.', 1 + n % 3) AS section_id, concat(o_orderpriority, ' ', o_orderkey) AS text FROM o),
r AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, section_id) AS place, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY length(text) DESC, pos) AS k FROM d)
SELECT doc_id, section_id, place AS pos, text FROM r WHERE k = 1""")
def _(t: Texts) -> DataFrame:
    x = t.orders.selectExpr("o_custkey AS doc_id", "n - 1 AS pos", "concat('ст.', 1 + n % 3) AS section_id", "concat(o_orderpriority, ' ', o_orderkey) AS text", "false AS service")
    return S.dedupe_sections(x, S.article_priority()).select("doc_id", "section_id", "pos", "text")


@query("dedupe_chapters", """
, d AS (SELECT o_custkey AS doc_id, n - 1 AS pos, 1 + n % 3 AS k, n % 4 AS kind, CASE n % 4 WHEN 0 THEN concat('Глава ', 1 + n % 3, '. ', o_orderpriority) WHEN 1 THEN concat(1 + n % 3, '.1. ', o_orderpriority) WHEN 2 THEN concat('Глава ', 31 + n % 3, ' ', o_orderpriority) ELSE concat('см. предыдущую редакцию ', o_orderpriority) END AS text FROM o),
r AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, k) AS place, row_number() OVER (PARTITION BY doc_id, k ORDER BY CASE kind WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END, length(text) DESC, pos) AS best FROM d)
SELECT doc_id, concat('гл.', k) AS section_id, place AS pos, text FROM r WHERE best = 1""")
def _(t: Texts) -> DataFrame:
    text = "CASE n % 4 WHEN 0 THEN concat('Глава ', 1 + n % 3, '. ', o_orderpriority) WHEN 1 THEN concat(1 + n % 3, '.1. ', o_orderpriority) WHEN 2 THEN concat('Глава ', 31 + n % 3, ' ', o_orderpriority) ELSE concat('см. предыдущую редакцию ', o_orderpriority) END AS text"
    x = t.orders.selectExpr("o_custkey AS doc_id", "n - 1 AS pos", "concat('гл.', 1 + n % 3) AS section_id", "CAST(NULL AS STRING) AS parent_section_id", text)
    return S.dedupe_sections(S.child_counts(x), S.chapter_priority()).select("doc_id", "section_id", "pos", "text")


@query("code_rows", """
, c AS (SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS code, l_returnflag AS title, concat(l_partkey, ' | ', l_returnflag) AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY k) AS j FROM c WHERE length(code) BETWEEN 3 AND 5)
SELECT doc_id, code, title, text, 's' AS section_id, CAST(k - 1 AS INTEGER) AS line FROM r WHERE j = 1""")
def _(t: Texts) -> DataFrame:
    rows = t._joined(t.read("lineitem"), "l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)", "concat('| ', l_partkey, ' | ', l_returnflag, ' |')")
    return S.code_rows(rows.withColumn("section_id", F.lit("s")))


PATTERNS = (r"(?iu)^\s*форма\s+(0409\d{3})\b", r"(?iu)код\s+формы\s+по\s+окуд[^\n]{0,80}?(0409\d{3})\b", r"^\s*(0409\d{3})\b")


@query("split_by_pattern", "SELECT o_custkey AS doc_id, n AS pos, concat('форма 0409', 100 + n) AS section_id, concat('0409', 100 + n) AS title, concat('заказ ', o_orderkey) AS text FROM o")
def _(t: Texts) -> DataFrame:
    forms = t._joined(t.orders, "o_custkey", "n", "concat('Форма 0409', 100 + n, '\nзаказ ', o_orderkey)")
    return S.split_by_pattern(forms, PATTERNS)


@query("split_forms", CHAPTERS + """
SELECT o_custkey AS doc_id, CAST(n AS INTEGER) AS pos, concat('форма 0409', 100 + n) AS section_id, CAST(NULL AS VARCHAR) AS parent_section_id, concat('0409', 100 + n) AS title, concat('заказ ', o_orderkey) AS text FROM o WHERE o_custkey % 2 = 0
UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, m) - 1 AS INTEGER), section_id, parent_section_id, title, text FROM u WHERE doc_id % 2 = 1""")
def _(t: Texts) -> DataFrame:
    """Forms of every other customer, and the regulations of the rest, which hold no form and are split by chapters."""
    forms = t._joined(t.orders.where("o_custkey % 2 = 0"), "o_custkey", "n", "concat('Форма 0409', 100 + n, '\nзаказ ', o_orderkey)")
    return S.split_forms(forms.unionByName(t.regulations.where("doc_id % 2 = 1")), PATTERNS).withColumn("pos", F.col("pos").cast("int"))


@query("route_parser", """
SELECT doc_id, CASE WHEN doc_id = 7 THEN 'special' WHEN source = 'src1' THEN 'law' WHEN source = 'src2' THEN 'regulation' END AS parser, CASE WHEN doc_id = 7 OR source IN ('src1', 'src2') THEN 'ok' ELSE 'no_parser' END AS status FROM documents""")
def _(t: Texts) -> DataFrame:
    return S.route_parser(t.documents.select("doc_id"), t.catalog, {"7": "special"}, {"src1": "law", "src2": "regulation"})


@query("flatten_sections", "SELECT o_custkey AS doc_id, concat('ст.', 1 + n % 3) AS section_id, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Texts) -> DataFrame:
    return S.flatten_sections(t.orders.selectExpr("o_custkey AS doc_id", "concat('ст.', 1 + n % 3) AS section_id"))[1]


@query("section_gate", """
, g AS (SELECT o_custkey AS doc_id, count(*) AS n, max(length(o_orderpriority)) AS most, sum(length(o_orderpriority)) AS chars FROM o GROUP BY 1),
r AS (SELECT c_custkey AS doc_id, CASE WHEN n IS NULL THEN 'no_sections' WHEN n < 3 THEN 'too_few' WHEN most > 0.85 * chars THEN 'dominant' END AS reason FROM customer LEFT JOIN g ON doc_id = c_custkey)
SELECT doc_id, reason IS NULL AS passed, reason FROM r""")
def _(t: Texts) -> DataFrame:
    sections = t.orders.selectExpr("o_custkey AS doc_id", "o_orderpriority AS text")
    return S.section_gate(sections, t.read("customer").select(F.col("c_custkey").alias("doc_id")))


@query("page_gate", """
SELECT page_id, CASE WHEN strlen(html) < 1500 THEN 'short_body' WHEN length(html) < 3000 AND NOT ends_with(url, '/print') THEN 'contents_only' END AS reason FROM pages""")
def _(t: Texts) -> DataFrame:
    pages = t.read("pages").selectExpr("page_id", "url", "octet_length(html) AS body_chars", "html AS text")
    return S.page_gate(pages, min_body=1500).select("page_id", "reason")


@query("pick_source", """
, c AS (SELECT o_custkey AS doc_id, left(o_orderpriority, 1) AS priority, o_orderkey AS attempt, CASE o_orderstatus WHEN 'F' THEN 'manual_odt' WHEN 'O' THEN 'browser_html' ELSE 'manual_pdf' END AS kind, o_orderkey % 6 AS n_sections, price > 150000 AS passed FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, attempt, kind) AS k FROM c WHERE passed AND (kind <> 'browser_html' OR n_sections >= 3)),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT c_custkey AS doc_id, kind, attempt, CASE WHEN n.n IS NULL THEN 'no_sources' WHEN kind IS NULL THEN 'failed' WHEN kind = 'manual_pdf' THEN 'manual_pdf' ELSE 'ok' END AS status
FROM customer LEFT JOIN n ON n.doc_id = c_custkey LEFT JOIN (SELECT * FROM f WHERE k = 1) f ON f.doc_id = c_custkey""")
def _(t: Texts) -> DataFrame:
    x = t.orders.selectExpr(
        "o_custkey AS doc_id", "left(o_orderpriority, 1) AS priority", "o_orderkey AS attempt", "CASE o_orderstatus WHEN 'F' THEN 'manual_odt' WHEN 'O' THEN 'browser_html' ELSE 'manual_pdf' END AS kind", "o_orderkey % 6 AS n_sections", "price > 150000 AS passed"
    )
    return S.pick_source(x, t.read("customer").select(F.col("c_custkey").alias("doc_id")))


@query("wanted_sections", """
, w AS (SELECT concat('doc-', o_custkey % 50) AS ref_doc, concat('ст.', n % 7) AS section_id, min(o_orderkey) AS seen FROM o GROUP BY 1, 2)
SELECT ref_doc, section_id, CAST(row_number() OVER (PARTITION BY ref_doc ORDER BY seen) - 1 AS INTEGER) AS pos FROM w""")
def _(t: Texts) -> DataFrame:
    catalog = t.orders.selectExpr("o_orderkey AS pos", "array(named_struct('doc', concat('doc-', o_custkey % 50), 'sections', array(named_struct('id', concat('ст.', n % 7), 'note', '')))) AS references")
    return S.wanted_sections(catalog)


_WANTED = ("п.1", "п. 2", "п.3 (см. заказ)", "п.2-4", "формы 0409102", "п.9999")


@query("resolve_aliases", """
, w AS (SELECT DISTINCT doc_id, unnest(['п.1', 'п. 2', 'п.3 (см. заказ)', 'п.2-4', 'формы 0409102', 'п.9999']) AS wanted_id FROM sec),
k AS (SELECT *, CASE wanted_id WHEN 'п.1' THEN 'exact' WHEN 'п. 2' THEN 'spaces' WHEN 'п.3 (см. заказ)' THEN 'note' WHEN 'формы 0409102' THEN 'form' WHEN 'п.2-4' THEN 'range' END AS s,
  CASE wanted_id WHEN 'п.1' THEN 'п.1' WHEN 'п. 2' THEN 'п.2' WHEN 'п.3 (см. заказ)' THEN 'п.3' WHEN 'формы 0409102' THEN 'форма 0409102' END AS id FROM w),
t AS (SELECT k.doc_id, wanted_id, s, CASE WHEN s = 'range' THEN (SELECT string_agg(text, concat(chr(10), chr(10)) ORDER BY pos) FROM sec WHERE sec.doc_id = k.doc_id AND section_id IN ('п.2', 'п.3', 'п.4'))
  ELSE (SELECT max(text) FROM sec WHERE sec.doc_id = k.doc_id AND section_id = id) END AS text FROM k)
SELECT doc_id, wanted_id, CASE WHEN text IS NULL THEN 'not_found' ELSE s END AS strategy, text, CAST(length(text) AS INTEGER) AS text_length FROM t""")
def _(t: Texts) -> DataFrame:
    wanted = t.sections.select("doc_id").distinct().withColumn("wanted_id", F.explode(F.array(*map(F.lit, _WANTED))))
    return S.resolve_aliases(wanted, t.sections)


_IN_TURN = ("п. 2", "п.1-3", "п.1-3(часть)", "п. 1-3 (часть)", "п.9999", "формы 0409102", "п.1-3 (вся)", "п. 2-9 (ещё)", "0409101")


@query("resolve_aliases_in_turn", r"""
, keyed AS (SELECT doc_id, list(section_id ORDER BY pos) AS ks, list(text ORDER BY pos) AS ts FROM sec GROUP BY 1),
r AS (
  SELECT doc_id, 0 AS i, ks, ts, '' AS w, '' AS strategy, CAST(NULL AS VARCHAR) AS text FROM keyed
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN text IS NULL OR strategy = 'exact' THEN ks ELSE list_append(ks, w) END, CASE WHEN text IS NULL OR strategy = 'exact' THEN ts ELSE list_append(ts, text) END, w, strategy, text
  FROM (
    SELECT doc_id, i, ks, ts, w, CASE WHEN p0 > 0 THEN 'exact' WHEN p1 > 0 THEN 'spaces' WHEN p2 > 0 OR p3 > 0 THEN 'note' WHEN rt <> '' THEN 'range' WHEN p4 > 0 OR p5 > 0 THEN 'form' ELSE 'not_found' END AS strategy,
      CASE WHEN p0 > 0 THEN ts[p0] WHEN p1 > 0 THEN ts[p1] WHEN p2 > 0 THEN ts[p2] WHEN p3 > 0 THEN ts[p3] WHEN rt <> '' THEN rt WHEN p4 > 0 THEN ts[p4] WHEN p5 > 0 THEN ts[p5] END AS text
    FROM (
      SELECT *, coalesce(list_position(ks, w), 0) AS p0, coalesce(list_position(ks, regexp_replace(w, '\s+', '', 'g')), 0) AS p1, coalesce(list_position(ks, b), 0) AS p2, coalesce(list_position(ks, regexp_replace(b, '\s+', '', 'g')), 0) AS p3,
        coalesce(list_position(ks, concat('форма', f)), 0) AS p4, coalesce(list_position(ks, concat('форма ', f)), 0) AS p5,
        array_to_string(list_transform(list_filter(range(1, len(ks) + 1), lambda j: lo IS NOT NULL AND coalesce(TRY_CAST(regexp_extract(regexp_replace(ks[j], '\s+', '', 'g'), '^п\.(\d+(?:\.\d+)?)$', 1) AS DOUBLE) BETWEEN lo AND hi, false)), lambda j: ts[j]), concat(chr(10), chr(10))) AS rt
      FROM (
        SELECT *, TRY_CAST(nullif(regexp_extract(regexp_replace(b, '\s+', '', 'g'), '^п\.(\d+)-(\d+)$', 1), '') AS DOUBLE) AS lo, TRY_CAST(nullif(regexp_extract(regexp_replace(b, '\s+', '', 'g'), '^п\.(\d+)-(\d+)$', 2), '') AS DOUBLE) AS hi,
          coalesce(nullif(regexp_extract(regexp_replace(b, '\s+', '', 'g'), '^(0409\d+)$', 1), ''), regexp_extract(regexp_replace(b, '\s+', '', 'g'), '^форм[ыа](\d+)', 1)) AS f
        FROM (SELECT doc_id, i, ks, ts, ws[i + 1] AS w, trim(split_part(ws[i + 1], '(', 1)) AS b FROM r, (SELECT [%s] AS ws) WHERE i < len(ws))))))
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, w AS wanted_id, strategy, text, CAST(length(text) AS INTEGER) AS text_length FROM r WHERE i > 0""" % ", ".join(f"'{w}'" for w in _IN_TURN))
def _(t: Texts) -> DataFrame:
    wanted = t.sections.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*map(F.lit, _IN_TURN))).alias("pos", "wanted_id"))
    return S.resolve_aliases_in_turn(wanted, t.sections)


@query("range_sections", "SELECT doc_id, 'п.2-4' AS wanted_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY pos) AS text FROM sec WHERE section_id IN ('п.2', 'п.3', 'п.4') GROUP BY 1")
def _(t: Texts) -> DataFrame:
    return S.range_sections(t.sections.select("doc_id").distinct().withColumn("wanted_id", F.lit("п.2-4")), t.sections)


CHUNKS = split_sql("cut", "documents", "doc_id", 800, 120) + """
, s AS (SELECT doc_id, text, length(text) AS n, concat(doc_id, '__h1_1__ord_1__') AS head FROM documents),
e AS (SELECT doc_id, concat(head, CASE WHEN n <= 800 THEN '0' ELSE 'parent' END) AS chunk_id, CAST(NULL AS VARCHAR) AS parent_chunk_id, CASE WHEN n <= 800 THEN 'leaf' ELSE 'split_parent' END AS chunk_type, 0 AS chunk_index, 1 AS chunk_total, text FROM s
  UNION ALL SELECT doc_id, concat(head, index), concat(head, 'parent'), 'split_child', index, total, cut.text FROM s JOIN cut USING (doc_id) WHERE n > 800),
c AS (SELECT chunk_id, doc_id, parent_chunk_id, chunk_type, chunk_type <> 'split_parent' AS is_indexed, chunk_index, chunk_total, e.text, CAST(length(e.text) AS INTEGER) AS char_count, lang AS cluster, source, concat('2023-11-0', 1 + doc_id % 9) AS as_of_date, doc_id % 4 = 0 AS internal
  FROM e JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id))"""


@query("chunks_of_documents", CHUNKS + " SELECT chunk_id, doc_id, parent_chunk_id, chunk_type, is_indexed, chunk_index, chunk_total, text, char_count, cluster, as_of_date, internal AS is_internal FROM c")
def _(t: Texts) -> DataFrame:
    return t.chunks.select("chunk_id", "doc_id", "parent_chunk_id", "chunk_type", "is_indexed", "chunk_index", "chunk_total", "text", "char_count", "cluster", "as_of_date", "is_internal")


@query("build_chunks", CHUNKS + """ SELECT chunk_id, doc_id, 'h1_1' AS section_id, parent_chunk_id, chunk_type, is_indexed, CAST(NULL AS VARCHAR) AS parent_section_id, 'h1_1' AS path, 1 AS level, 1 AS order_in_doc, chunk_index, chunk_total, CASE WHEN internal THEN 'synthetic' ELSE 'real' END AS source_type,
'law' AS doc_type, source AS doc_subtype, cluster, internal AS is_internal, as_of_date, text, char_count, false AS contains_table, '' AS table_ids, '' AS table_summary FROM c""")
def _(t: Texts) -> DataFrame:
    return t.chunks.withColumns({c: F.array_join(c, "/") for c in ("path", "table_ids")})


@query("chunk_parents", """
, s AS (SELECT doc_id, text, lang, length(text) AS n FROM documents WHERE NOT regexp_matches(text, '(^|\n)#{1,4}\\s+.*\\S'))
SELECT concat(doc_id, '__h1_1__ord_1__', CASE WHEN n <= 800 THEN '0' ELSE 'parent' END) AS chunk_id, doc_id, CASE WHEN n <= 800 THEN 'leaf' ELSE 'split_parent' END AS chunk_type, n <= 800 AS is_indexed, CAST(n AS INTEGER) AS char_count, lang AS cluster,
concat('2023-11-0', 1 + doc_id % 9) AS as_of_date, doc_id % 4 = 0 AS is_internal FROM s""")
def _(t: Texts) -> DataFrame:
    plain = t.documents.where("NOT text RLIKE '(^|\\n)#{1,4}\\\\s+.*\\\\S'").select("doc_id")
    x = t.chunks.where("chunk_type <> 'split_child'").join(plain, "doc_id", "left_semi")
    return x.select("chunk_id", "doc_id", "chunk_type", "is_indexed", "char_count", "cluster", "as_of_date", "is_internal")


@query("chunk_totals", CHUNKS + " SELECT doc_id, count(*) AS chunk_count, count_if(is_indexed) AS indexed_count FROM c GROUP BY 1")
def _(t: Texts) -> DataFrame:
    return C.chunk_totals(t.chunks)


@query("chunk_metadata", CHUNKS + """ SELECT chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, 'h1_1' AS section_id, coalesce(parent_chunk_id, '') AS parent_chunk_id, chunk_type, '' AS parent_section_id, CASE WHEN internal THEN 'synthetic' ELSE 'real' END AS source_type, 'law' AS doc_type,
source AS doc_subtype, cluster, as_of_date, 1 AS level, chunk_index, chunk_total, false AS contains_table, '' AS table_ids FROM c""")
def _(t: Texts) -> DataFrame:
    return C.chunk_metadata(t.chunks)


@query("indexable_chunks", CHUNKS + " SELECT chunk_id, doc_id, chunk_index, chunk_total FROM c WHERE is_indexed")
def _(t: Texts) -> DataFrame:
    return C.indexable_chunks(t.chunks).select("chunk_id", "doc_id", "chunk_index", "chunk_total")


@query("parent_context", CHUNKS + " SELECT c.chunk_id, c.doc_id, CAST(length(coalesce(p.text, c.text)) AS INTEGER) AS context_chars FROM c LEFT JOIN c p ON p.chunk_id = c.parent_chunk_id WHERE c.is_indexed")
def _(t: Texts) -> DataFrame:
    chunks = t.chunks
    hits = C.indexable_chunks(chunks).select("chunk_id", "doc_id")
    return C.parent_context(hits, chunks).select("chunk_id", "doc_id", F.length("context").alias("context_chars"))


RUNS = """
, d AS (SELECT doc_id, length(text) AS n, repeat(chr(CAST(97 + doc_id % 26 AS INTEGER)), CAST(length(text) AS INTEGER)) AS t, source, lang, doc_id % 4 = 0 AS internal FROM documents),
k AS (SELECT *, 'leaf' AS chunk_type, '0' AS suffix, 0 AS i, 1 AS total, t AS body FROM d WHERE n <= 800 UNION ALL SELECT *, 'split_parent', 'parent', 0, 1, t FROM d WHERE n > 800
  UNION ALL SELECT doc_id, n, t, source, lang, internal, 'split_child', CAST(i AS VARCHAR), i, CAST(ceil(n / 800.0) AS INTEGER), concat(CASE WHEN i > 0 THEN concat(left(t, 120), ' ') ELSE '' END, substr(t, CAST(800 * i + 1 AS BIGINT), 800)) FROM (SELECT *, unnest(generate_series(0, CAST(ceil(n / 800.0) AS BIGINT) - 1)) AS i FROM d WHERE n > 800)),
c AS (SELECT doc_id, concat(doc_id, '__h1_1__ord_1__', suffix) AS chunk_id, CASE WHEN chunk_type = 'split_child' THEN concat(doc_id, '__h1_1__ord_1__parent') END AS parent_chunk_id, chunk_type, chunk_type <> 'split_parent' AS is_indexed, CAST(i AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS chunk_total, body AS text, lang AS cluster,
  source, internal, n, concat('2023-11-0', 1 + doc_id % 9) AS as_of_date FROM k)"""


@query("build_chunks_of_runs", RUNS + " SELECT chunk_id, doc_id, parent_chunk_id, chunk_type, is_indexed, chunk_index, chunk_total, text, CAST(length(text) AS INTEGER) AS char_count, cluster, as_of_date FROM c")
def _(t: Texts) -> DataFrame:
    return t.run_chunks.select("chunk_id", "doc_id", "parent_chunk_id", "chunk_type", "is_indexed", "chunk_index", "chunk_total", "text", "char_count", "cluster", "as_of_date")


@query("chunk_totals_of_runs", RUNS + " SELECT doc_id, count(*) AS chunk_count, count_if(is_indexed) AS indexed_count FROM c GROUP BY 1")
def _(t: Texts) -> DataFrame:
    return C.chunk_totals(t.run_chunks)


@query("chunk_metadata_of_runs", RUNS + """ SELECT chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, 'h1_1' AS section_id, coalesce(parent_chunk_id, '') AS parent_chunk_id, chunk_type, '' AS parent_section_id, CASE WHEN internal THEN 'synthetic' ELSE 'real' END AS source_type, 'law' AS doc_type,
source AS doc_subtype, cluster, as_of_date, 1 AS level, chunk_index, chunk_total, false AS contains_table, '' AS table_ids FROM c""")
def _(t: Texts) -> DataFrame:
    return C.chunk_metadata(t.run_chunks)


@query("indexable_chunks_of_runs", RUNS + " SELECT chunk_id, doc_id, chunk_index, chunk_total FROM c WHERE is_indexed")
def _(t: Texts) -> DataFrame:
    return C.indexable_chunks(t.run_chunks).select("chunk_id", "doc_id", "chunk_index", "chunk_total")


@query("parent_context_of_runs", RUNS + " SELECT c.chunk_id, c.doc_id, coalesce(p.text, c.text) AS context FROM c LEFT JOIN c p ON p.chunk_id = c.parent_chunk_id WHERE c.is_indexed")
def _(t: Texts) -> DataFrame:
    chunks = t.run_chunks
    return C.parent_context(C.indexable_chunks(chunks).select("chunk_id", "doc_id"), chunks)


@query("add_overlap", """, s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS p, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents),
t AS (SELECT doc_id, i, p, lag(p) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s),
u AS (SELECT *, CASE WHEN contains(right(b, 40), ' ') THEN substr(right(b, 40), instr(right(b, 40), ' ') + 1) ELSE right(b, 40) END AS tail FROM t)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN b IS NULL OR tail = '' THEN p ELSE concat(tail, ' ', p) END AS piece FROM u""")
def _(t: Texts) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.overlapped(F.split("text", r"\. "), 40)).alias("pos", "piece"))


@query("inject_summaries", "SELECT doc_id, concat('Order ', doc_id, chr(10), chr(10), CASE WHEN doc_id % 3 > 0 THEN concat('Сводка таблицы T1: order ', doc_id, chr(10), chr(10)) ELSE '' END, block, chr(10), chr(10), 'end') AS text FROM blocks")
def _(t: Texts) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("T1"), F.concat(F.lit("order "), "doc_id")))
    return C.inject_summaries(t.tables.select("doc_id", "text", said.alias("summaries")))


@query("split_table", "SELECT doc_id, 'T1' AS table_id, n AS rows, block AS rejoined FROM blocks")
def _(t: Texts) -> DataFrame:
    """Fragments of every table put together again: each has the frame, and the rows between are those of the table."""
    parts = C.split_tables(S.table_blocks(t.tables.select("doc_id", "text")), 120).withColumn("l", F.split("text", "\n"))
    framed = parts.select("doc_id", "table_id", "index", F.slice("l", 1, 3).alias("top"), F.expr("slice(l, 4, size(l) - 4)").alias("rows"), F.element_at("l", -1).alias("end"))
    whole = framed.groupBy("doc_id", "table_id", "top", "end").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("index", "rows"))), lambda p: p["rows"])).alias("r"))
    return whole.select("doc_id", "table_id", F.size("r").cast("long").alias("rows"), F.array_join(F.concat("top", "r", F.array("end")), "\n").alias("rejoined"))


@query("chunk_profile", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1600 ELSE 800 END AS child_max, CASE WHEN doc_id % 5 = 0 THEN 80 ELSE 120 END AS overlap, 3500 AS parent_max FROM documents")
def _(t: Texts) -> DataFrame:
    own = t.documents.where("doc_id % 5 = 0").selectExpr("doc_id", "1600 AS child_max", "80 AS overlap", "CAST(NULL AS INT) AS parent_max")
    return C.chunk_profile(t.documents, own)


@query("chunk_id", "SELECT o_orderkey AS order_id, concat('D-', o_custkey, '__гл_', n, '__', regexp_replace(o_orderpriority, '[^0-9A-Za-z_-]', '_', 'g'), '__ord_', n, '__parent') AS chunk_id FROM o")
def _(t: Texts) -> DataFrame:
    path = F.array(F.concat(F.lit("гл."), "n"), F.col("o_orderpriority"))
    return t.orders.select(F.col("o_orderkey").alias("order_id"), X.chunk_id(F.concat(F.lit("D-"), "o_custkey"), path, F.col("n"), F.lit("parent")).alias("chunk_id"))


@query("as_of_date", """SELECT o_orderkey AS order_id, CASE WHEN n % 3 = 0 THEN '2024-01-01' ELSE concat(2000 + n % 24, '-', lpad(CAST(1 + n % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + n % 31 AS VARCHAR), 2, '0')) END AS as_of_date FROM o""")
def _(t: Texts) -> DataFrame:
    given = F.expr("CASE WHEN n % 3 = 0 THEN concat('undated ', n) ELSE concat(1 + n % 31, '.', 1 + n % 12, '.', 2000 + n % 24) END")
    return t.orders.select(F.col("o_orderkey").alias("order_id"), X.as_of_date(given, F.lit("2024-01-01")).alias("as_of_date"))


@query("select_documents", "SELECT doc_id, source AS doc_subtype FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0")
def _(t: Texts) -> DataFrame:
    return C.select_documents(t.catalog, cluster="en", source="real").select("doc_id", "doc_subtype")


@query("normalize_text", """SELECT doc_id, regexp_replace(regexp_replace(concat(replace(text, '. ', concat('-', chr(10))), chr(10), chr(10), chr(10), 'end'), '([0-9A-Za-z_À-ɏ])-\n([0-9A-Za-z_À-ɏ])', '\\1\\2', 'g'), '\n{3,}', concat(chr(10), chr(10)), 'g') AS text FROM documents""")
def _(t: Texts) -> DataFrame:
    hyphened = F.concat(F.replace("text", F.lit(". "), F.lit("-\n")), F.lit("\n\n\nend"))
    return t.documents.select("doc_id", X.normalize_text(hyphened).alias("text"))


@query("extract_dates", "SELECT o_orderkey AS order_id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d FROM orders UNION ALL SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-05-09') FROM orders")
def _(t: Texts) -> DataFrame:
    said = F.concat(F.lit("от "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" и 9 мая "), F.date_format("o_orderdate", "yyyy"), F.lit(" г., не 31.02.2020"))
    x = t.read("orders").select(F.col("o_orderkey").alias("order_id"), F.explode(X.extract_dates(said)).alias("d"))
    return x.select("order_id", F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("last_revision_date", "SELECT o_orderkey AS doc_id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS revised FROM orders")
def _(t: Texts) -> DataFrame:
    said = F.concat(F.lit("Закон, последняя редакция "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(", вступит 01.01.2999"))
    x = S.last_revision_date(t.read("orders").select(F.col("o_orderkey").alias("doc_id"), said.alias("text")), F.lit("2024-01-01").cast("date"))
    return x.select("doc_id", F.date_format("revised", "yyyy-MM-dd").alias("revised"))


@query("clip_document", """
, c AS (SELECT doc_id, text, length(text) AS n FROM documents),
m AS (SELECT *, concat(left(text, 300), chr(10), chr(10), '...[DOCUMENT TRUNCATED]...', chr(10), chr(10), substr(text, greatest(0, n // 2 - 150) + 1, 300), chr(10), chr(10), '...[DOCUMENT TRUNCATED]...', chr(10), chr(10), right(text, 300)) AS cut FROM c)
SELECT doc_id, CASE WHEN n > 900 THEN left(cut, 900) ELSE text END AS text, n > 900 AS clipped FROM m""")
def _(t: Texts) -> DataFrame:
    return t.documents.select("doc_id", X.clip_document(F.col("text"), 900).alias("text"), (F.length("text") > 900).alias("clipped"))


@query("token_estimate", "SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS tokens FROM documents")
def _(t: Texts) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))
