"""Statistics of chat, model-call, retrieval and pipeline telemetry.

Every function takes and returns DataFrames. `as_of` stands for the present moment; it is a column or a timestamp, so
that a run can be repeated. Time windows are filters on the event's own time, which reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOW_MS = 30_000
STUCK_MINUTES = 5


def latest(df: DataFrame, ts: str) -> Column:
    """The greatest value of a time column, as a literal: what `now` means for a finished log."""
    return F.lit(df.agg(F.max(ts)).first()[0])


def recent_rows(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows not older than some hours."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))


def tally(condition: Column) -> Column:
    return F.count_if(condition)


def total(name: str) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(name), F.lit(0))


def when_ok(name: str) -> Column:
    return F.when(F.col("status") == "ok", F.col(name))


def percentile(name: str, share: float, accuracy: int | None = None) -> Column:
    """Of ok rows; exact, which holds all values of a window in one buffer, or to 1 / accuracy of the ranks."""
    return F.percentile(when_ok(name), F.lit(share)) if accuracy is None else F.percentile_approx(when_ok(name), share, accuracy)


def with_previews(df: DataFrame, query_chars: int = 120) -> DataFrame:
    """session_short (8 characters) and query_preview."""
    return df.withColumn("session_short", F.substring("session_id", 1, 8)).withColumn("query_preview", F.substring("query_text", 1, query_chars))


def stuck(requests: DataFrame, as_of: Column) -> DataFrame:
    old = F.col("requested_at") < as_of - F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES")
    return requests.where((F.col("status") == "in_progress") & old)


def chat_overview(requests: DataFrame, calls: DataFrame, as_of: Column, hours: int = 24, accuracy: int | None = None) -> DataFrame:
    """One row: counts by status, latency of ok requests, sessions, tokens of ok calls, requests stuck at any age."""
    now = recent_rows(requests, "requested_at", as_of, hours).agg(
        F.count(F.lit(1)).alias("total_requests"),
        *[tally(F.col("status") == s).alias(f"{s}_count") for s in ("ok", "error", "in_progress")],
        F.avg(when_ok("total_duration_ms")).alias("avg_latency_ms"),
        percentile("total_duration_ms", 0.95, accuracy).alias("p95_latency_ms"),
        F.count_distinct("session_id").alias("active_sessions"),
    )
    tokens = recent_rows(calls, "called_at", as_of, hours).where("status = 'ok'").agg(total("total_tokens").alias("total_tokens"))
    waiting = stuck(requests, as_of).agg(F.count(F.lit(1)).alias("stuck_count"))
    share = F.when(F.col("total_requests") > 0, 100.0 * F.col("error_count") / F.col("total_requests")).otherwise(F.lit(0.0))
    return now.crossJoin(tokens).crossJoin(waiting).withColumn("error_pct", share)  # three tables of one row


def timeline(df: DataFrame, ts: str, as_of: Column, hours: int, names: tuple[str, str] = ("total", "errors")) -> DataFrame:
    """Rows and errors of each hour."""
    hour = F.date_format(ts, "yyyy-MM-dd HH:00").alias("hour")
    return recent_rows(df, ts, as_of, hours).groupBy(hour).agg(F.count(F.lit(1)).alias(names[0]), tally(F.col("status") == "error").alias(names[1]))


def chat_timeline(requests: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return timeline(requests, "requested_at", as_of, hours)


def llm_timeline(calls: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return timeline(calls, "called_at", as_of, hours, ("calls", "errors"))


def llm_tokens(calls: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Tokens and calls of each day, whatever their status."""
    day = F.date_format("called_at", "yyyy-MM-dd").alias("day")
    sums = [total(c).alias(c) for c in ("total_tokens", "prompt_tokens", "completion_tokens")]
    return recent_rows(calls, "called_at", as_of, 24 * days).groupBy(day).agg(*sums, F.count(F.lit(1)).alias("calls"))


def chat_tokens(calls: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Tokens and calls of each day, ok calls only."""
    return llm_tokens(calls.where("status = 'ok'"), as_of, days)


def chat_recent(requests: DataFrame, calls: DataFrame, n: int = 20) -> DataFrame:
    """The latest n rows of requests joined with their calls: a request with two calls is two rows. At most n requests
    can be among them, so only those are joined."""
    order = [F.desc_nulls_first("requested_at"), "request_id"]
    some = requests.orderBy(*order).limit(n)
    joined = some.join(calls.select("request_id", "call_id", "total_tokens"), "request_id", "left")
    x = with_previews(joined.orderBy(*order, F.asc_nulls_last("call_id")).limit(n))
    return x.select("request_id", "session_short", "query_preview", "status", "total_duration_ms", "total_tokens", "retrieved_chunks_n", "requested_at")


def stuck_requests(requests: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    x = with_previews(stuck(requests, as_of).orderBy(F.asc_nulls_last("requested_at"), "request_id").limit(n), 80)
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("requested_at").cast("timestamp"))
    return x.select("request_id", "session_short", "query_preview", F.round(seconds / 60.0, 1).alias("minutes_ago"))


def slow_requests(requests: DataFrame, as_of: Column, hours: int = 24, n: int = 10) -> DataFrame:
    slow = recent_rows(requests, "requested_at", as_of, hours).where(f"status = 'ok' AND total_duration_ms > {SLOW_MS}")
    x = with_previews(slow.orderBy(F.desc("total_duration_ms"), "request_id").limit(n), 80)
    return x.select("request_id", "session_short", "query_preview", "total_duration_ms")


def error_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Worst sessions by error share, an unknown share (no finished request) first."""
    share = F.round(F.try_divide(100.0 * F.col("error_count"), F.nullif(F.col("request_count"), F.lit(0))), 1)
    x = sessions.where("error_count > 0").withColumn("error_pct", share)
    x = x.orderBy(F.desc_nulls_first("error_pct"), F.desc("request_count"), "session_id").limit(n)
    return x.select("session_id", "request_count", "error_count", "error_pct")


def top_documents(chunks: DataFrame, doc: Column, n: int) -> DataFrame:
    """Appearances, requests, mean score and rank of documents. Counting (document, request) first spreads a document
    that very many requests retrieved over many tasks."""
    pairs = chunks.groupBy(doc.alias("doc_id"), "request_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.count("score").alias("ns"), F.sum("rank").alias("r"), F.count("rank").alias("nr")
    )
    x = pairs.groupBy("doc_id").agg(
        F.sum("n").alias("appearances"),
        F.count("request_id").alias("unique_requests"),
        F.coalesce(F.try_divide(F.sum("s"), F.sum("ns")), F.lit(0.0)).alias("avg_score"),
        F.round(F.try_divide(F.sum("r").cast("double"), F.sum("nr")), 1).alias("avg_rank"),
    )
    return x.orderBy(F.desc("appearances"), F.asc_nulls_last("doc_id")).limit(n)


def chat_top_docs(chunks: DataFrame, n: int = 10) -> DataFrame:
    return top_documents(chunks, F.col("doc_id"), n)


def retrieve_top_docs(ret_chunks: DataFrame, n: int = 10) -> DataFrame:
    """As chat_top_docs, null documents together with blank ones, which leave after the cut to n."""
    return top_documents(ret_chunks, F.coalesce("doc_id", F.lit("")), n).where("doc_id <> ''")


def llm_overview(calls: DataFrame, as_of: Column, hours: int = 24, accuracy: int | None = None) -> DataFrame:
    """One row: counts, latency of ok calls, token sums of all calls, mean tokens of ok ones."""
    return recent_rows(calls, "called_at", as_of, hours).agg(
        F.count(F.lit(1)).alias("total_calls"),
        *[tally(F.col("status") == s).alias(f"{s}_count") for s in ("ok", "error")],
        percentile("duration_ms", 0.5, accuracy).alias("p50_ms"),
        F.avg(when_ok("duration_ms")).alias("avg_ms"),
        percentile("duration_ms", 0.95, accuracy).alias("p95_ms"),
        *[total(c).alias(c) for c in ("total_tokens", "prompt_tokens", "completion_tokens")],
        F.avg(when_ok("total_tokens")).alias("avg_tokens"),
    )


def llm_recent(calls: DataFrame, requests: DataFrame, n: int = 20) -> DataFrame:
    some = calls.orderBy(F.desc_nulls_first("called_at"), "call_id").limit(n)
    x = some.join(requests.select("request_id", "query_text"), "request_id", "left")
    return x.select("call_id", "request_id", F.substring("query_text", 1, 120).alias("query_preview"), "model", "status", "duration_ms", "total_tokens", "called_at")


def llm_models(calls: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    return recent_rows(calls, "called_at", as_of, 24 * days).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), tally(F.col("status") == "error").alias("errors"), F.avg("duration_ms").alias("avg_ms"), total("total_tokens").alias("total_tokens")
    )


def llm_context_chunks(calls: DataFrame, requests: DataFrame, chunks: DataFrame, n: int = 20) -> DataFrame:
    """Context of the latest n calls: the cut comes before the joins, blank documents leave at the end."""
    some = calls.orderBy(F.desc_nulls_first("called_at"), "call_id").limit(n).select("call_id", "request_id", "called_at")
    x = some.join(requests.select("request_id", "query_text"), "request_id", "left").join(chunks, "request_id", "left")
    x = x.where("doc_id IS NOT NULL AND trim(doc_id) <> ''")
    return x.select("call_id", "request_id", F.substring("query_text", 1, 120).alias("query_preview"), "doc_id", "rank", "score", "called_at")


def retrieve_overview(ret_requests: DataFrame, ret_chunks: DataFrame, as_of: Column, hours: int = 24, accuracy: int | None = None) -> DataFrame:
    """One row: counts, latencies, fallbacks, overlap, empty and low-result shares, documents per request (a request
    without chunks counts 0)."""
    now = recent_rows(ret_requests, "created_at", as_of, hours)
    docs = ret_chunks.join(now.select("request_id"), "request_id", "left_semi").groupBy("request_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    x = now.join(docs, "request_id", "left")
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return x.agg(
        F.count(F.lit(1)).alias("total_requests"),
        *[tally(F.col("status") == s).alias(f"{s}_count") for s in ("ok", "error")],
        percentile("total_duration_ms", 0.5, accuracy).alias("p50_ms"),
        percentile("total_duration_ms", 0.95, accuracy).alias("p95_ms"),
        *[F.avg(f"{c}_duration_ms").alias(f"avg_{c}_ms") for c in ("total", "semantic", "bm25")],
        tally(F.col("bm25_fallback")).alias("fallback_count"),
        F.avg("bm25_semantic_overlap").alias("avg_overlap"),
        F.avg("result_hits").alias("avg_hits"),
        share(F.col("result_hits") == 0).alias("empty_pct"),
        share(F.col("result_hits") < F.col("top_k")).alias("low_result_pct"),
        F.avg(F.coalesce("n_docs", F.lit(0))).alias("avg_docs"),
    )


def retrieve_recent(ret_requests: DataFrame, n: int = 20) -> DataFrame:
    x = ret_requests.orderBy(F.desc_nulls_first("created_at"), "request_id").limit(n)
    return x.select("request_id", F.substring("query_text", 1, 120).alias("query_preview"), "cluster", "status", "semantic_hits", "bm25_hits", "bm25_semantic_overlap", "result_hits", "total_duration_ms", "created_at")


def pipeline_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    x = sessions.orderBy(F.desc_nulls_first("started_at"), "session_id").limit(n)
    return x.select("session_id", "started_at", "finished_at", F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"), "docs_total", "docs_ok", "docs_failed", F.col("finished_at").isNull().alias("is_running"))


def validation_summary(sessions: DataFrame, checks: DataFrame) -> DataFrame:
    """Checks of the latest session: for each check and kind of artifact, and in all (grouping columns null)."""
    last = sessions.orderBy(F.desc_nulls_first("started_at"), "session_id").limit(1).select("session_id")
    x = checks.join(F.broadcast(last), "session_id")  # one row
    x = x.rollup("check_name", "artifact_type")
    x = x.agg(F.count(F.lit(1)).alias("total"), tally(F.col("passed")).alias("passed"), F.grouping_id().alias("g"))
    return x.where("g <> 1").withColumn("pass_rate", F.round(100.0 * F.col("passed") / F.col("total"), 1)).drop("g")


def session_rollup(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Per chat session: first and last activity, finished requests, errors, tokens."""
    tokens = calls.groupBy("request_id").agg(F.sum("total_tokens").alias("tokens"))
    x = requests.join(tokens, "request_id", "left")
    return x.groupBy("session_id").agg(
        F.min("requested_at").alias("created_at"),
        F.max(F.coalesce("completed_at", "requested_at")).alias("last_active_at"),
        tally(F.col("status") != "in_progress").alias("request_count"),
        tally(F.col("status") == "error").alias("error_count"),
        total("tokens").alias("total_tokens"),
    )


def request_facts(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Start and end events -> one row for each request: status, duration, response length, number of chunks."""
    x = starts.join(ends, "request_id", "left")
    done = F.col("completed_at").isNotNull()
    status = F.when(~done, "in_progress").when(F.col("error_msg").isNotNull(), "error").otherwise("ok")
    seconds = F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("requested_at").cast("timestamp"))
    return x.select(
        "request_id", "session_id", "query_text", status.alias("status"), (seconds * 1000.0).alias("total_duration_ms"),
        F.length(F.nullif(F.col("response_text"), F.lit(""))).alias("response_chars"), F.size(F.coalesce("chunks", F.array())).alias("retrieved_chunks_n"), "error_msg",
    )


def call_facts(ends: DataFrame) -> DataFrame:
    """One call row for each end event whose model is known."""
    return ends.where("model IS NOT NULL").select("request_id", "model", F.when(F.col("error_msg").isNotNull(), "error").otherwise("ok").alias("status"), "total_tokens")


def context_facts(ends: DataFrame) -> DataFrame:
    """One row for each retrieved chunk of an end event, ranks from 1."""
    x = ends.select("request_id", F.posexplode("chunks").alias("pos", "chunk"))
    return x.select("request_id", (F.col("pos") + 1).alias("rank"), F.col("chunk.doc_id").alias("doc_id"), F.col("chunk.score").alias("score"))


#: Outcomes that count as ok; the parser's sessions count what they skipped as ok too.
OK_OUTCOMES = {"chunk": ("ok",), "index": ("ok",), "parse": ("ok", "manual_pdf", "skipped", "no_sources", "no_parser")}


def run_totals(sessions: DataFrame, results: DataFrame, kind: str = "chunk") -> DataFrame:
    """Per pipeline session: documents by outcome, chunks, duration in seconds."""
    x = results.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("docs_total"),
        tally(F.col("status").isin(*OK_OUTCOMES[kind])).alias("docs_ok"),
        tally(F.col("status") == "failed").alias("docs_failed"),
        tally(F.col("status") == "skipped").alias("docs_skipped"),
        total("chunks").alias("chunks"),
    )
    seconds = F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    y = sessions.select("session_id", seconds.cast("double").alias("duration_sec")).join(x, "session_id", "left")
    return y.na.fill(0, ["docs_total", "docs_ok", "docs_failed", "docs_skipped", "chunks"])


def history_window(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each session, oldest first; an exchange counts only if its reply is not empty.

    messages (session_id, turn, role, text): a user's message is followed by the assistant's reply in the next turn.
    """
    w = Window.partitionBy("session_id").orderBy("turn")
    x = messages.withColumn("_next_role", F.lead("role").over(w)).withColumn("_next_text", F.lead("text").over(w))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    dead_reply = (F.col("role") == "assistant") & blank(F.col("text"))
    unanswered = (F.col("role") == "user") & ((F.col("_next_role") != "assistant") | F.col("_next_role").isNull() | blank(F.col("_next_text")))
    x = x.where(F.col("role").isin("user", "assistant") & ~dead_reply & ~unanswered)
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).where(F.col("_r") <= n)
    position = F.row_number().over(w).alias("position")
    return x.select("session_id", position, "turn", "role", "text")
