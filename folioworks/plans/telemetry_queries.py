"""Telemetry queries on the driver's tables, with their SQL.

Orders stand for requests (key, customer = session, price = duration, status F/O/P = ok/in_progress/error), each with
one model call; line items for retrieved chunks and documents; events for pipeline sessions and results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators import telemetry as T
from folioworks.operators import telemetry_states as H
from folioworks.sources.scratch import scratch_path

DAYS = 365


class Log:
    """The telemetry tables made of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def requests(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey AS request_id", "concat('session-', o_custkey) AS session_id", "concat(o_orderpriority, ' order ', o_orderkey) AS query_text",
            "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'in_progress' ELSE 'error' END AS status", "o_totalprice AS total_duration_ms",
            "o_orderdate AS requested_at", "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at", "CAST(o_orderkey % 7 AS INT) AS retrieved_chunks_n",
        )

    @property
    def calls(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "concat('call-', o_orderkey) AS call_id", "o_orderkey AS request_id", "o_orderpriority AS model", "o_orderkey % 900 AS prompt_tokens", "o_custkey % 300 AS completion_tokens",
            "o_orderkey % 900 + o_custkey % 300 AS total_tokens", "o_totalprice / 2 AS duration_ms", "CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status", "o_orderdate AS called_at",
        )

    @property
    def chunks(self) -> DataFrame:
        return self.read("lineitem").selectExpr("l_orderkey AS request_id", "l_linenumber AS rank", "concat('doc-', l_partkey % 400) AS doc_id", "l_discount AS score")

    @property
    def ret_requests(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey AS request_id", "concat(o_orderpriority, ' order ', o_orderkey) AS query_text", "o_orderpriority AS cluster", "5 AS top_k", "CAST(o_orderkey % 20 AS INT) AS semantic_hits",
            "CAST(o_custkey % 20 AS INT) AS bm25_hits", "CAST((o_orderkey + o_custkey) % 9 AS INT) AS bm25_semantic_overlap", "CAST(o_orderkey % 6 AS INT) AS result_hits", "o_orderkey % 11 = 0 AS bm25_fallback",
            "o_totalprice AS total_duration_ms", "o_totalprice / 4 AS semantic_duration_ms", "o_totalprice / 8 AS bm25_duration_ms",
            "CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status", "o_orderdate AS created_at",
        )

    @property
    def pipeline(self) -> tuple[DataFrame, DataFrame]:
        """Sessions: the users of events; results: their events."""
        events = self.read("events")
        results = events.selectExpr(
            "concat('run-', user_id) AS session_id", "ts", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status", "CAST(event_id % 5 AS BIGINT) AS chunks",
            "event_type AS check_name", "CASE WHEN event_id % 2 = 0 THEN 'document' ELSE 'questions' END AS artifact_type", "value >= 10 AS passed",
        )
        sessions = results.groupBy("session_id").agg(
            F.min("ts").alias("started_at"), F.when(T.tally(F.col("status") == "failed") < 20, F.max("ts")).alias("finished_at"),
            F.count(F.lit(1)).alias("docs_total"), T.tally(F.col("status") == "ok").alias("docs_ok"), T.tally(F.col("status") == "failed").alias("docs_failed"),
        )
        return sessions, results

    def now(self) -> Column:
        return T.latest(self.read("orders"), "o_orderdate")


BIND = """
WITH requests AS (SELECT o_orderkey AS request_id, concat('session-', o_custkey) AS session_id, concat(o_orderpriority, ' order ', o_orderkey) AS query_text,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'in_progress' ELSE 'error' END AS status, o_totalprice AS total_duration_ms, o_orderdate AS requested_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at, CAST(o_orderkey % 7 AS INTEGER) AS retrieved_chunks_n FROM orders),
calls AS (SELECT concat('call-', o_orderkey) AS call_id, o_orderkey AS request_id, o_orderpriority AS model, o_orderkey % 900 AS prompt_tokens, o_custkey % 300 AS completion_tokens,
  o_orderkey % 900 + o_custkey % 300 AS total_tokens, o_totalprice / 2 AS duration_ms, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status, o_orderdate AS called_at FROM orders),
chunks AS (SELECT l_orderkey AS request_id, l_linenumber AS rank, concat('doc-', l_partkey % 400) AS doc_id, l_discount AS score FROM lineitem),
ret_requests AS (SELECT o_orderkey AS request_id, concat(o_orderpriority, ' order ', o_orderkey) AS query_text, o_orderpriority AS cluster, 5 AS top_k, CAST(o_orderkey % 20 AS INTEGER) AS semantic_hits,
  CAST(o_custkey % 20 AS INTEGER) AS bm25_hits, CAST((o_orderkey + o_custkey) % 9 AS INTEGER) AS bm25_semantic_overlap, CAST(o_orderkey % 6 AS INTEGER) AS result_hits, o_orderkey % 11 = 0 AS bm25_fallback,
  o_totalprice AS total_duration_ms, o_totalprice / 4 AS semantic_duration_ms, o_totalprice / 8 AS bm25_duration_ms, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status, o_orderdate AS created_at FROM orders),
results AS (SELECT concat('run-', user_id) AS session_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status, event_id % 5 AS chunks, event_type AS check_name,
  CASE WHEN event_id % 2 = 0 THEN 'document' ELSE 'questions' END AS artifact_type, value >= 10 AS passed FROM events),
sessions AS (SELECT session_id, min(ts) AS started_at, CASE WHEN count_if(status = 'failed') < 20 THEN max(ts) END AS finished_at, count(*) AS docs_total, count_if(status = 'ok') AS docs_ok, count_if(status = 'failed') AS docs_failed FROM results GROUP BY 1),
chat AS (SELECT session_id, min(requested_at) AS created_at, max(coalesce(completed_at, requested_at)) AS last_active_at, count_if(status <> 'in_progress') AS request_count, count_if(status = 'error') AS error_count,
  coalesce(sum(total_tokens), 0) AS total_tokens FROM requests LEFT JOIN (SELECT request_id, total_tokens FROM calls) USING (request_id) GROUP BY 1),
t AS (SELECT max(o_orderdate) AS now FROM orders)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Callable[[Log], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Log(spark, sf_dir))
        ORACLES[name] = BIND + sql
        return f

    return add


WINDOW = f"now - INTERVAL {DAYS} DAY"


@query("chat_overview", f"""
, a AS (SELECT count(*) AS total_requests, count_if(status = 'ok') AS ok_count, count_if(status = 'error') AS error_count, count_if(status = 'in_progress') AS in_progress_count,
    avg(total_duration_ms) FILTER (WHERE status = 'ok') AS avg_latency_ms, quantile_cont(total_duration_ms, 0.95) FILTER (WHERE status = 'ok') AS p95_latency_ms, count(DISTINCT session_id) AS active_sessions
    FROM requests, t WHERE requested_at >= {WINDOW}),
b AS (SELECT coalesce(sum(total_tokens), 0) AS total_tokens FROM calls, t WHERE called_at >= {WINDOW} AND status = 'ok'),
c AS (SELECT count(*) AS stuck_count FROM requests, t WHERE status = 'in_progress' AND requested_at < now - INTERVAL 5 MINUTE)
SELECT *, 100.0 * error_count / total_requests AS error_pct FROM a, b, c""")
def _(x: Log) -> DataFrame:
    return T.chat_overview(x.requests, x.calls, x.now(), 24 * DAYS)


@query("hourly_states", """
SELECT count(*) AS rows, count_if(status = 'ok') AS ok, count_if(status = 'error') AS error, count_if(status = 'in_progress') AS in_progress, count_if(status = 'ok' AND total_duration_ms IS NOT NULL) AS n,
round(avg(total_duration_ms) FILTER (WHERE status = 'ok'), 4) AS mean, true AS p50_is_near, true AS p95_is_near, true AS sessions_are_near
FROM requests, t WHERE requested_at >= date_trunc('hour', now - INTERVAL 300 DAY) AND requested_at < date_trunc('hour', now - INTERVAL 20 DAY)""")
def _(x: Log) -> DataFrame:
    """States by hour, written and merged for a window; what sketches say is held against the window's rows."""
    path, now = scratch_path(x.spark, "states"), x.now()
    H.write_states(H.hourly_states(x.requests, "requested_at", durations=["total_duration_ms"], distinct=["session_id"]), path)
    since, until = now - F.expr("INTERVAL 300 DAYS"), now - F.expr("INTERVAL 20 DAYS")
    got = H.merged_states(x.spark.read.parquet(path), since, until)
    rows = x.requests.where((F.col("requested_at") >= F.date_trunc("hour", since)) & (F.col("requested_at") < F.date_trunc("hour", until)))
    d, share = F.when(F.col("status") == "ok", F.col("total_duration_ms")), lambda c: F.avg(F.when(F.col("d").isNotNull(), F.col("d") <= F.col(c)).cast("double"))
    exact = rows.select(d.alias("d"), "session_id").crossJoin(got.select("total_duration_ms_p50", "total_duration_ms_p95"))  # one row
    exact = exact.agg(share("total_duration_ms_p50").alias("r50"), share("total_duration_ms_p95").alias("r95"), F.count_distinct("session_id").alias("sessions"))
    near = lambda c, s: F.abs(F.col(c) - s) <= H.RANK_ERROR + 1 / F.col("total_duration_ms_n")  # noqa: E731 (and one row's own share)
    return got.crossJoin(exact).select(
        "rows", "ok", "error", "in_progress", F.col("total_duration_ms_n").alias("n"), F.round("total_duration_ms_avg", 4).alias("mean"), near("r50", 0.5).alias("p50_is_near"), near("r95", 0.95).alias("p95_is_near"),
        (F.abs(F.col("session_id_distinct") - F.col("sessions")) <= H.COUNT_ERROR * F.col("sessions")).alias("sessions_are_near"),
    )


@query("chat_timeline", f"SELECT strftime(requested_at, '%Y-%m-%d %H:00') AS hour, count(*) AS total, count_if(status = 'error') AS errors FROM requests, t WHERE requested_at >= {WINDOW} GROUP BY 1")
def _(x: Log) -> DataFrame:
    return T.chat_timeline(x.requests, x.now(), 24 * DAYS)


_TOKENS = "strftime(called_at, '%Y-%m-%d') AS day, sum(total_tokens) AS total_tokens, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, count(*) AS calls FROM calls, t"


@query("chat_tokens", f"SELECT {_TOKENS} WHERE called_at >= {WINDOW} AND status = 'ok' GROUP BY 1")
def _(x: Log) -> DataFrame:
    return T.chat_tokens(x.calls, x.now(), DAYS)


@query("llm_tokens", f"SELECT {_TOKENS} WHERE called_at >= {WINDOW} GROUP BY 1")
def _(x: Log) -> DataFrame:
    return T.llm_tokens(x.calls, x.now(), DAYS)


@query("llm_timeline", f"SELECT strftime(called_at, '%Y-%m-%d %H:00') AS hour, count(*) AS calls, count_if(status = 'error') AS errors FROM calls, t WHERE called_at >= {WINDOW} GROUP BY 1")
def _(x: Log) -> DataFrame:
    return T.llm_timeline(x.calls, x.now(), 24 * DAYS)


@query("chat_recent", """
SELECT request_id, left(session_id, 8) AS session_short, left(query_text, 120) AS query_preview, r.status, total_duration_ms, total_tokens, retrieved_chunks_n, requested_at
FROM requests r LEFT JOIN calls c USING (request_id) ORDER BY requested_at DESC NULLS FIRST, request_id, call_id LIMIT 20""")
def _(x: Log) -> DataFrame:
    return T.chat_recent(x.requests, x.calls)


@query("stuck_requests", """
SELECT request_id, left(session_id, 8) AS session_short, left(query_text, 80) AS query_preview, round(epoch(now - requested_at) / 60.0, 1) AS minutes_ago
FROM requests, t WHERE status = 'in_progress' AND requested_at < now - INTERVAL 5 MINUTE ORDER BY requested_at, request_id LIMIT 10""")
def _(x: Log) -> DataFrame:
    return T.stuck_requests(x.requests, x.now())


@query("slow_requests", f"""
SELECT request_id, left(session_id, 8) AS session_short, left(query_text, 80) AS query_preview, total_duration_ms FROM requests, t
WHERE status = 'ok' AND total_duration_ms > 30000 AND requested_at >= {WINDOW} ORDER BY total_duration_ms DESC, request_id LIMIT 10""")
def _(x: Log) -> DataFrame:
    return T.slow_requests(x.requests, x.now(), 24 * DAYS)


@query("error_sessions", """
SELECT session_id, request_count, error_count, round(100.0 * error_count / nullif(request_count, 0), 1) AS error_pct FROM chat
WHERE error_count > 0 ORDER BY error_pct DESC NULLS FIRST, request_count DESC, session_id LIMIT 10""")
def _(x: Log) -> DataFrame:
    return T.error_sessions(T.session_rollup(x.requests, x.calls))


@query("session_rollup", "SELECT * FROM chat")
def _(x: Log) -> DataFrame:
    return T.session_rollup(x.requests, x.calls)


_TOP = """SELECT doc_id, count(*) AS appearances, count(DISTINCT request_id) AS unique_requests, coalesce(avg(score), 0) AS avg_score, round(avg(rank), 1) AS avg_rank
FROM chunks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


@query("chat_top_docs", _TOP)
def _(x: Log) -> DataFrame:
    return T.chat_top_docs(x.chunks)


@query("retrieve_top_docs", _TOP)
def _(x: Log) -> DataFrame:
    return T.retrieve_top_docs(x.chunks)


@query("llm_overview", f"""
SELECT count(*) AS total_calls, count_if(status = 'ok') AS ok_count, count_if(status = 'error') AS error_count, quantile_cont(duration_ms, 0.5) FILTER (WHERE status = 'ok') AS p50_ms,
avg(duration_ms) FILTER (WHERE status = 'ok') AS avg_ms, quantile_cont(duration_ms, 0.95) FILTER (WHERE status = 'ok') AS p95_ms, sum(total_tokens) AS total_tokens, sum(prompt_tokens) AS prompt_tokens,
sum(completion_tokens) AS completion_tokens, avg(total_tokens) FILTER (WHERE status = 'ok') AS avg_tokens FROM calls, t WHERE called_at >= {WINDOW}""")
def _(x: Log) -> DataFrame:
    return T.llm_overview(x.calls, x.now(), 24 * DAYS)


@query("llm_recent", """
SELECT call_id, request_id, left(query_text, 120) AS query_preview, model, c.status, duration_ms, total_tokens, called_at
FROM (SELECT * FROM calls ORDER BY called_at DESC NULLS FIRST, call_id LIMIT 20) c LEFT JOIN requests USING (request_id)""")
def _(x: Log) -> DataFrame:
    return T.llm_recent(x.calls, x.requests)


@query("llm_models", f"SELECT model, count(*) AS calls, count_if(status = 'error') AS errors, avg(duration_ms) AS avg_ms, sum(total_tokens) AS total_tokens FROM calls, t WHERE called_at >= {WINDOW} GROUP BY 1")
def _(x: Log) -> DataFrame:
    return T.llm_models(x.calls, x.now(), DAYS)


@query("llm_context_chunks", """
SELECT call_id, request_id, left(query_text, 120) AS query_preview, doc_id, rank, score, called_at
FROM (SELECT * FROM calls ORDER BY called_at DESC NULLS FIRST, call_id LIMIT 20) c LEFT JOIN requests USING (request_id) JOIN chunks USING (request_id) WHERE trim(doc_id) <> ''""")
def _(x: Log) -> DataFrame:
    return T.llm_context_chunks(x.calls, x.requests, x.chunks)


@query("retrieve_overview", f"""
, n AS (SELECT * FROM ret_requests, t WHERE created_at >= {WINDOW}),
d AS (SELECT request_id, count(DISTINCT doc_id) AS n_docs FROM chunks WHERE request_id IN (SELECT request_id FROM n) GROUP BY 1)
SELECT count(*) AS total_requests, count_if(status = 'ok') AS ok_count, count_if(status = 'error') AS error_count, quantile_cont(total_duration_ms, 0.5) FILTER (WHERE status = 'ok') AS p50_ms,
quantile_cont(total_duration_ms, 0.95) FILTER (WHERE status = 'ok') AS p95_ms, avg(total_duration_ms) AS avg_total_ms, avg(semantic_duration_ms) AS avg_semantic_ms, avg(bm25_duration_ms) AS avg_bm25_ms,
count_if(bm25_fallback) AS fallback_count, avg(bm25_semantic_overlap) AS avg_overlap, avg(result_hits) AS avg_hits, avg(CASE WHEN result_hits = 0 THEN 100.0 ELSE 0.0 END) AS empty_pct,
avg(CASE WHEN result_hits < top_k THEN 100.0 ELSE 0.0 END) AS low_result_pct, avg(coalesce(n_docs, 0)) AS avg_docs FROM n LEFT JOIN d USING (request_id)""")
def _(x: Log) -> DataFrame:
    return T.retrieve_overview(x.ret_requests, x.chunks, x.now(), 24 * DAYS)


@query("retrieve_recent", """
SELECT request_id, left(query_text, 120) AS query_preview, cluster, status, semantic_hits, bm25_hits, bm25_semantic_overlap, result_hits, total_duration_ms, created_at
FROM ret_requests ORDER BY created_at DESC NULLS FIRST, request_id LIMIT 20""")
def _(x: Log) -> DataFrame:
    return T.retrieve_recent(x.ret_requests)


@query("pipeline_sessions", """
SELECT session_id, started_at, finished_at, coalesce(epoch(finished_at - started_at), 0.0) AS duration_sec, docs_total, docs_ok, docs_failed, finished_at IS NULL AS is_running
FROM sessions ORDER BY started_at DESC NULLS FIRST, session_id LIMIT 10""")
def _(x: Log) -> DataFrame:
    sessions, _ = x.pipeline
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return T.pipeline_sessions(sessions.withColumn("duration_sec", seconds / 1e6))


@query("validation_summary", """
, l AS (SELECT session_id FROM sessions ORDER BY started_at DESC NULLS FIRST, session_id LIMIT 1),
r AS (SELECT check_name, artifact_type, count(*) AS total, count_if(passed) AS passed FROM results WHERE session_id IN (SELECT session_id FROM l) GROUP BY GROUPING SETS ((), (check_name, artifact_type)))
SELECT *, round(100.0 * passed / total, 1) AS pass_rate FROM r""")
def _(x: Log) -> DataFrame:
    return T.validation_summary(*x.pipeline)


@query("run_totals", """
, r AS (SELECT session_id, count(*) AS docs_total, count_if(status = 'ok') AS docs_ok, count_if(status = 'failed') AS docs_failed, count_if(status = 'skipped') AS docs_skipped, sum(chunks) AS chunks FROM results GROUP BY 1)
SELECT session_id, CAST(date_diff('second', date_trunc('second', started_at), date_trunc('second', finished_at)) AS DOUBLE) AS duration_sec, r.docs_total, r.docs_ok, r.docs_failed, docs_skipped, chunks
FROM sessions JOIN r USING (session_id)""")
def _(x: Log) -> DataFrame:
    return T.run_totals(*x.pipeline)


@query("request_facts", """
SELECT request_id, session_id, query_text, CASE WHEN completed_at IS NULL THEN 'in_progress' WHEN status = 'error' THEN 'error' ELSE 'ok' END AS status,
CASE WHEN completed_at IS NOT NULL THEN 3600000.0 END AS total_duration_ms, CASE WHEN status = 'ok' THEN length(query_text) END AS response_chars,
CAST(CASE WHEN completed_at IS NULL THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS retrieved_chunks_n, CASE WHEN status = 'error' THEN 'failed' END AS error_msg
FROM requests LEFT JOIN (SELECT request_id, count(*) AS n FROM chunks GROUP BY 1) USING (request_id)""")
def _(x: Log) -> DataFrame:
    starts = x.requests.select("request_id", "session_id", "query_text", "requested_at")
    return T.request_facts(starts, _ends(x))


@query("context_facts", """
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank, doc_id, score) AS INTEGER) AS rank, doc_id, score
FROM chunks JOIN requests USING (request_id) WHERE completed_at IS NOT NULL""")
def _(x: Log) -> DataFrame:
    return T.context_facts(_ends(x))


@query("call_facts", """
SELECT request_id, o_orderpriority AS model, CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'ok' END AS status, o_orderkey % 900 + o_custkey % 300 AS total_tokens
FROM orders JOIN requests ON request_id = o_orderkey WHERE completed_at IS NOT NULL""")
def _(x: Log) -> DataFrame:
    return T.call_facts(_ends(x))


def _ends(x: Log) -> DataFrame:
    """End events: chunks in rank order, the response, the error."""
    lists = x.chunks.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("chunks"))
    done = x.requests.where("completed_at IS NOT NULL").join(x.calls.select("request_id", "model", "total_tokens"), "request_id")
    return done.join(lists, "request_id", "left").selectExpr(
        "request_id", "completed_at", "CASE WHEN status = 'ok' THEN query_text ELSE '' END AS response_text", "CASE WHEN status = 'error' THEN 'failed' END AS error_msg", "chunks", "model", "total_tokens"
    )


@query("history_window", """
, m AS (SELECT conv_id AS session_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT * FROM m WHERE (role = 'assistant' AND trim(coalesce(text, '')) <> '') OR (role = 'user' AND nr = 'assistant' AND trim(coalesce(nt, '')) <> '')),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM k)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS position, turn, role, text FROM r WHERE r <= 4""")
def _(x: Log) -> DataFrame:
    return T.history_window(x.read("conversations").withColumnRenamed("conv_id", "session_id"), 4)


@query("recent_rows", f"SELECT request_id, status, requested_at FROM requests, t WHERE requested_at >= {WINDOW}")
def _(x: Log) -> DataFrame:
    return T.recent_rows(x.requests, "requested_at", x.now(), 24 * DAYS).select("request_id", "status", "requested_at")


@query("preview_columns", "SELECT request_id, left(session_id, 8) AS session_short, left(query_text, 120) AS query_preview FROM requests")
def _(x: Log) -> DataFrame:
    return T.with_previews(x.requests).select("request_id", "session_short", "query_preview")
