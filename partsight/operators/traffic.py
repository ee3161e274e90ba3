"""Pagination, attempts, replies, endpoints, access funnels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.rules import traffic as R


def _case(value: Column, table: dict[str, str], other: Column | None = None) -> Column:
    out = F.when(F.lit(False), "")
    for key, result in table.items():
        out = out.when(value == key, result)
    return out.otherwise(other) if other is not None else out


# -- F06, F07 ------------------------------------------------------------------------------------


def audit_pagination(
    entries: DataFrame, *, limit: int, start_offset: int = 0, offset_max: int = R.OFFSET_MAX,
    max_pages: int | None = None, max_items: int | None = None, stop_on_short_page: bool = True,
    pages: DataFrame | None = None,
) -> DataFrame:
    """why and where each listing run ended, and what it saw until then.

    ``entries`` holds one row per entry a server sent (``run_id, page_no, item_id, parsed``);
    ``pages`` (``run_id, page_no``) adds pages without entries. Ids are reduced to their first page
    with a ``min``; the running sums work on one row per page.
    """
    first_seen = (
        entries.where("parsed").groupBy("run_id", "item_id").agg(F.min("page_no").alias("page_no"))
        .groupBy("run_id", "page_no").agg(F.count(F.lit(1)).alias("new_ids"))
    )
    sent = entries.groupBy("run_id", "page_no").agg(
        F.count(F.lit(1)).alias("raw_count"), F.count_if("parsed").alias("items")
    )
    if pages is not None:
        sent = pages.select("run_id", "page_no").distinct().join(sent, ["run_id", "page_no"], "left")
    per_page = sent.join(first_seen, ["run_id", "page_no"], "left").fillna(
        0, ["raw_count", "items", "new_ids"]
    )
    so_far = Window.partitionBy("run_id").orderBy("page_no").rowsBetween(
        Window.unboundedPreceding, 0
    )
    walked = per_page.withColumns(
        {
            "page_index": F.count(F.lit(1)).over(so_far),
            "items_seen": F.sum("raw_count").over(so_far),
            "parsed_seen": F.sum("items").over(so_far),
            "ids_seen": F.sum("new_ids").over(so_far),
        }
    )
    no = F.lit(False)
    stop = (
        F.when(F.col("raw_count") == 0, "empty_page")
        .when((F.col("items") > 0) & (F.col("new_ids") == 0), "no_new_ids")
        .when(F.lit(stop_on_short_page) & (F.col("raw_count") < limit), "short_page")
        .when(F.col("items_seen") >= max_items if max_items is not None else no, "max_items")
        .when(start_offset + F.col("items_seen") > offset_max, "offset_cap")
        .when(F.col("page_index") >= max_pages if max_pages is not None else no, "max_pages")
    )
    stats = F.struct(
        F.col("page_index").alias("pages"), "items_seen",
        (F.col("parsed_seen") - F.col("ids_seen")).alias("duplicates"), "stop",
    )
    at_stop = F.when(F.col("stop").isNotNull(), F.col("page_no"))
    return (
        walked.withColumn("stop", stop)
        .groupBy("run_id")
        .agg(
            F.coalesce(
                F.min_by(stats, at_stop), F.max_by(stats, F.col("page_no"))
            ).alias("s")
        )
        .select("run_id", "s.pages", "s.items_seen", "s.duplicates",
                F.coalesce("s.stop", F.lit("log_ends")).alias("stop_reason"))
    )


def page_bounds_ok(limit: Column, offset: Column) -> Column:
    """F07."""
    return limit.between(*R.PAGE_LIMIT) & offset.between(0, R.OFFSET_MAX)


# -- F08, F10, F11, F12 --------------------------------------------------------------------------


def error_kind(status: Column, transport: Column) -> Column:
    """NULL for a success."""
    return (
        F.when(status.isNull() & transport.contains("timeout"), "timeout")
        .when(status.isNull(), "network")
        .when(status.between(200, 299), None)
        .when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "server")
        .otherwise("client")
    )


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """error kind and what the caller's retry layer should do."""
    kind = error_kind(F.col("status"), F.coalesce("transport", F.lit("")))
    return attempts.withColumn("error_kind", kind).withColumn(
        "retry_class", _case(F.col("error_kind"), R.RETRY_CLASS)
    )


def retry_after_seconds(value: Column, now: Column) -> Column:
    """seconds or an HTTP date; the past means 0, unusable means NULL, capped."""
    text = F.trim(value)
    number = text.try_cast("double")
    date = F.try_to_timestamp(
        F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1),
        F.lit("dd MMM yyyy HH:mm:ss"),
    )
    until = (F.unix_micros(date) - F.unix_micros(now)) / 1e6
    seconds = F.coalesce(number, until)
    usable = F.when(~F.isnan(seconds), seconds)
    return F.when(
        usable.isNotNull(), F.least(F.greatest(usable, F.lit(0.0)), F.lit(float(R.MAX_RETRY_AFTER_S)))
    )


def int_header(value: Column) -> Column:
    """``X-RateLimit-*`` headers: an integer or nothing."""
    text = F.trim(value)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def attempt_stats(classified: DataFrame) -> DataFrame:
    """attempts per endpoint, priority and outcome."""
    return classified.groupBy(
        "endpoint", "priority", F.coalesce("error_kind", F.lit("ok")).alias("outcome")
    ).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max("duration_ms").alias("max_ms"),
        F.sum(F.round(F.col("duration_ms") * 100).cast("bigint")).alias("sum_ms_x100"),
    )


def send_outcomes(attempts: DataFrame) -> DataFrame:
    """delivered / not_delivered / unknown with the reason. ``message_id`` is the id in the
    reply (NULL when the body had none)."""
    status = F.col("status")
    http = F.concat(F.lit("http_"), status.cast("string"))
    ok = status.between(200, 299)
    outcome = (
        F.when(
            status.isNull(),
            _case(F.col("transport"), {k: v[0] for k, v in R.TRANSPORT_OUTCOMES.items()},
                  F.lit("unknown")),
        )
        .when(ok & F.col("message_id").isNull(), "unknown")
        .when(ok, "delivered")
        .when(status.isin(*R.DEFINITE_REJECTIONS), "not_delivered")
        .otherwise("unknown")
    )
    reason = (
        F.when(
            status.isNull(),
            _case(F.col("transport"), {k: v[1] for k, v in R.TRANSPORT_OUTCOMES.items()},
                  F.lit("transport_error")),
        )
        .when(ok & F.col("message_id").isNull(), "malformed_2xx")
        .otherwise(http)
    )
    return attempts.withColumns({"outcome": outcome, "reason": reason})


# -- F13 -----------------------------------------------------------------------------------------


def check_content_hash(texts: DataFrame, authorisations: DataFrame, key: str) -> DataFrame:
    """the text to send must be the authorised one (SHA-256) and not blank."""
    return (
        texts.withColumn("text_sha256", F.sha2(F.col("text"), 256))
        .join(authorisations.select(key, F.col("sha256").alias("authorised")), key, "left")
        .withColumn(
            "verdict",
            F.when(F.col("text").rlike(r"^(?U)\s*$"), "empty_text")
            .when(F.col("authorised").isNull(), "not_authorised")
            .when(F.col("authorised") != F.col("text_sha256"), "text_differs")
            .otherwise("ok"),
        )
    )


# -- F15 -----------------------------------------------------------------------------------------


def template_regex(template: str) -> str:
    """``/a/{id}`` -> a full-match pattern; a placeholder is one non-empty path segment."""
    pieces = re.split(r"\{\w+\}", template)
    return "^" + "[^/]+".join(re.escape(p).replace("/", "/") for p in pieces) + "$"


def match_endpoints(
    requests: DataFrame, endpoints: tuple[tuple[str, str, str], ...] = R.ENDPOINTS
) -> DataFrame:
    """the first endpoint whose method and path template fit, else ``forbidden``. The table is
    a constant, so it becomes one CASE expression and no join."""
    out = F.when(F.lit(False), "")
    for name, method, template in endpoints:
        out = out.when(
            (F.upper("method") == method) & F.col("path").rlike(template_regex(template)), name
        )
    return requests.withColumn("endpoint", out.otherwise("forbidden"))


# -- F16, F17 ------------------------------------------------------------------------------------


def access_funnel(steps: DataFrame) -> DataFrame:
    """F16: the four steps of each run (1 token, 2 account, 3 items, 4 messenger). A failed token
    step ends the run; without an account id the messenger step is skipped."""

    def failed(n: int) -> Column:
        return F.max(F.when(F.col("step_no") == n, F.coalesce("error_kind", F.lit("")))).alias(f"e{n}")

    runs = steps.groupBy("run_id").agg(
        F.min(F.right("account_id", F.lit(3))).alias("account_tail"), *[failed(n) for n in (1, 2, 3, 4)]
    )
    ended = F.col("e1") != ""

    def state(n: int) -> Column:
        e = F.col(f"e{n}")
        result = F.when(e == "", "ok").otherwise(e)
        if n == 1:
            return result
        result = F.when(ended, "not_run").otherwise(result)
        if n == 4:
            result = F.when(~ended & (F.col("e2") != ""), "skipped").otherwise(result)
        return result

    out = runs.select(
        "run_id",
        F.when(ended | (F.col("e2") != ""), "").otherwise(F.col("account_tail")).alias("account_tail"),
        *[state(n).alias(f"step{n}") for n in (1, 2, 3, 4)],
    )
    every = F.lit(True)
    for n in (1, 2, 3, 4):
        every = every & (F.col(f"step{n}") == "ok")
    return out.withColumn("all_ok", every)


def listing_filter(
    rows: DataFrame, *, id_column: str = "item_id", item_ids: list | None = None,
    unread_only: bool | None = None, chat_types: list[str] | None = None,
    statuses: list[str] | None = None, updated_from: Column | None = None,
    category: int | None = None,
) -> DataFrame:
    """listing arguments as predicates; ``None`` means all. They reach the file scan."""
    if item_ids:
        rows = rows.where(F.col(id_column).isin(item_ids))
    if unread_only:
        rows = rows.where(~F.col("is_read"))
    if chat_types:
        rows = rows.where(F.col("chat_type").isin(chat_types))
    if statuses:
        rows = rows.where(F.col("status").isin(statuses))
    if updated_from is not None:
        rows = rows.where(F.col("updated_at") >= updated_from)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows
