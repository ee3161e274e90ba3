"""Queries of area F (API pages and traffic)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.operators import rate, traffic
from partsight.plans.registry import query
from partsight.sources import pages as pg
from partsight.sources.domain import Domain, with_domain

NOW = "TIMESTAMP '2024-01-01 11:59:00'"


# -- pages -----------------------------------------------------------------------------------------


def _message_pages(d: Domain) -> DataFrame:
    """Message pages of at most fifty turns, derived from the conversations; some entries and some
    envelopes are damaged."""
    entry = F.to_json(
        F.struct(
            F.when(F.col("conv_id") % 9 != F.col("turn") + 1, F.concat_ws("-", "conv_id", "turn"))
            .alias("id"),
            F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.lit("soon"))
            .otherwise((1700000000 + F.col("turn") * 60).cast("string")).alias("created_text"),
            F.col("role").alias("type"),
            F.struct(F.col("text")).alias("content"),
            (F.col("turn") % 2 == 0).alias("is_read"),
        )
    )
    # Numbers stay numbers, so "created" is spliced in by hand.
    entry = F.regexp_replace(entry, r'"created_text":"(\d+)"', r'"created":$1')
    entry = F.regexp_replace(entry, "created_text", "created")
    pages = (
        d["conversations"]
        .withColumn("page_no", F.expr("turn div 50"))
        .groupBy("conv_id", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))).alias("es"))
    )
    array = F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]"))
    body = (
        F.when(F.col("conv_id") % 3 == 0, array)
        .when(F.col("conv_id") % 10 == 1, F.lit('{"messages": null}'))
        .when(F.col("conv_id") % 10 == 2, F.lit('{"chats": []}'))
        .otherwise(F.concat(F.lit('{"messages":'), array, F.lit("}")))
    )
    return pages.select("conv_id", "page_no", body.alias("body"))


@query("page_messages", """
    SELECT conv_id, CAST(turn // 50 AS BIGINT) AS page_no,
      NOT (conv_id % 3 <> 0 AND conv_id % 10 = 2) AS shape_ok,
      CAST(CASE WHEN conv_id % 3 <> 0 AND conv_id % 10 IN (1, 2) THEN 0 ELSE count(*) END AS BIGINT)
        AS entries,
      CAST(CASE WHEN conv_id % 3 <> 0 AND conv_id % 10 IN (1, 2) THEN 0 ELSE
        count(*) FILTER (conv_id % 9 <> turn + 1 AND (conv_id + turn) % 11 <> 0) END AS BIGINT)
        AS kept
    FROM conversations GROUP BY conv_id, turn // 50""")
def page_messages(d: Domain) -> DataFrame:
    """F02 + F04."""
    entries = pg.list_entries(_message_pages(d), "messages_list")
    fields = pg.issue_fields(F.col("entry"), "message")
    return entries.groupBy("conv_id", "page_no", "shape_ok").agg(
        F.count("entry").alias("entries"),
        F.count_if(F.col("entry").isNotNull() & (F.size(fields) == 0)).alias("kept"),
    )


@query("schema_issues", """
    SELECT conv_id, CAST(turn % 50 AS INTEGER) AS "index", concat_ws(',',
      CASE WHEN (conv_id + turn) % 11 = 0 THEN 'created' END,
      CASE WHEN conv_id % 9 = turn + 1 THEN 'id' END) AS fields
    FROM conversations WHERE (conv_id % 3 = 0 OR conv_id % 10 NOT IN (1, 2))
      AND (conv_id % 9 = turn + 1 OR (conv_id + turn) % 11 = 0)""")
def schema_issues(d: Domain) -> DataFrame:
    """index and field names only, never values."""
    entries = pg.list_entries(_message_pages(d), "messages_list")
    bad = pg.parse_entries(entries, "message").where(~F.col("kept"))
    return bad.select("conv_id", "index", F.array_join("issues", ",").alias("fields"))


def _chat_pages(d: Domain) -> DataFrame:
    """Chat pages of up to 50 chats, from the customers; every 20th id is missing."""
    chat = F.to_json(
        F.struct(
            F.when(F.col("c_custkey") % 20 != 7, F.col("c_custkey").cast("string")).alias("id"),
            F.lit(1700000000).alias("created"),
            F.struct(F.lit("item").alias("type"), F.struct(F.col("c_custkey").alias("id")).alias("value"))
            .alias("context"),
            F.array(F.struct(F.col("c_name").alias("name"))).alias("users"),
            F.col("c_acctbal").alias("unknown_field"),
        )
    )
    pages = d["customer"].groupBy(F.expr("c_custkey div 50").alias("page_no")).agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", chat.alias("e")))).alias("es")
    )
    body = F.concat(F.lit('{"chats":['), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]}"))
    return pages.select("page_no", body.alias("body"))


@query("page_items", """
    SELECT c_custkey // 50 AS page_no, c_custkey % 50 AS "index", CASE WHEN c_custkey % 20 <> 7
      THEN CAST(c_custkey AS STRING) ELSE '' END AS chat_id, c_custkey % 20 <> 7 AS kept
    FROM customer""")
def page_items(d: Domain) -> DataFrame:
    """F01."""
    entries = pg.parse_entries(pg.list_entries(_chat_pages(d), "chats_list"), "chat")
    return entries.select(
        "page_no", F.col("index").cast("bigint").alias("index"),
        F.coalesce(F.try_variant_get("entry", "$.id", "string"), F.lit("")).alias("chat_id"), "kept",
    )


@query("page_objects", """
    SELECT p_partkey AS object_id, CASE WHEN p_partkey % 6 = 0 THEN 'vas' ELSE '' END AS issues,
      p_type AS status FROM part""")
def page_objects(d: Domain) -> DataFrame:
    """item details, one object per part."""
    body = F.to_json(
        F.struct(
            F.col("p_type").alias("status"), F.col("p_size").alias("autoload_item_id"),
            F.when(F.col("p_partkey") % 6 == 0, F.lit("x")).alias("vas"),
        )
    )
    pages = d["part"].select(F.col("p_partkey").alias("object_id"), body.alias("body"))
    parsed = pg.parse_objects(pages, "item_detail")
    return parsed.select(
        "object_id", F.array_join("issues", ",").alias("issues"),
        F.try_variant_get("entry", "$.status", "string").alias("status"),
    )


@query("api_code", with_domain("attempt", """
    SELECT attempt_id, CASE k % 6 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN 'c' || k
      WHEN 2 THEN 'first' WHEN 3 THEN 'plain' ELSE '' END AS api_code FROM attempt"""))
def api_code(d: Domain) -> DataFrame:
    """bodies of all shapes, derived from the attempts."""
    k = F.col("k").cast("string")
    body = (
        F.when(F.col("k") % 6 == 0, F.concat(F.lit('{"error":{"code":'), k, F.lit("}}")))
        .when(F.col("k") % 6 == 1, F.concat(F.lit('{"code":"c'), k, F.lit('","error":"other"}')))
        .when(F.col("k") % 6 == 2, F.lit('{"errors":[{"code":"first"},{"code":"second"}]}'))
        .when(F.col("k") % 6 == 3, F.lit('{"error":"plain"}'))
        .when(F.col("k") % 6 == 4, F.lit('{"code":{"deep":1}}'))
        .otherwise(F.lit("<html>"))
    )
    return d["attempt"].select(
        "attempt_id", F.coalesce(pg.error_code(body), F.lit("")).alias("api_code")
    )


# -- pagination ------------------------------------------------------------------------------------


@query("pagination_audit", with_domain("page_entry", """,
    firsts AS (SELECT run_id, item_id, min(page_no) AS page_no FROM page_entry WHERE parsed
               GROUP BY ALL),
    pages AS (SELECT e.run_id, e.page_no, count(*) AS raw, count(*) FILTER (parsed) AS items
              FROM page_entry e GROUP BY ALL),
    p AS (SELECT pages.*, coalesce(n, 0) AS new_ids FROM pages LEFT JOIN (SELECT run_id, page_no,
            count(*) AS n FROM firsts GROUP BY ALL) f
          ON f.run_id = pages.run_id AND f.page_no = pages.page_no),
    w AS (SELECT *, row_number() OVER x AS idx, sum(raw) OVER x AS seen, sum(items) OVER x AS ps,
            sum(new_ids) OVER x AS ids FROM p WINDOW x AS (PARTITION BY run_id ORDER BY page_no)),
    s AS (SELECT *, CASE WHEN items > 0 AND new_ids = 0 THEN 'no_new_ids' WHEN raw < 14
            THEN 'short_page' WHEN seen >= 400 THEN 'max_items' WHEN seen > 350 THEN 'offset_cap'
            WHEN idx >= 12 THEN 'max_pages' END AS stop FROM w),
    e AS (SELECT run_id, coalesce(min(page_no) FILTER (stop IS NOT NULL), max(page_no)) AS page_no
          FROM s GROUP BY run_id)
    SELECT s.run_id, idx AS pages, CAST(seen AS BIGINT) AS items_seen,
      CAST(ps - ids AS BIGINT) AS duplicates, coalesce(stop, 'log_ends') AS stop_reason
    FROM s JOIN e ON e.run_id = s.run_id AND e.page_no = s.page_no"""))
def pagination_audit(d: Domain) -> DataFrame:
    """F06."""
    return traffic.audit_pagination(
        d["page_entry"], limit=14, offset_max=350, max_pages=12, max_items=400
    )


@query("page_bounds", with_domain("page_entry", """
    SELECT page_no, count(*) FILTER (page_no % 120 BETWEEN 1 AND 99
      AND entry_no % 1500 BETWEEN 0 AND 1000) AS in_bounds, count(*) AS requests
    FROM page_entry GROUP BY page_no"""))
def page_bounds(d: Domain) -> DataFrame:
    """F07."""
    ok = traffic.page_bounds_ok(F.col("page_no") % 120, F.col("entry_no") % 1500)
    return d["page_entry"].groupBy("page_no").agg(
        F.count_if(ok).alias("in_bounds"), F.count(F.lit(1)).alias("requests")
    )


# -- attempts --------------------------------------------------------------------------------------

_KIND = """CASE WHEN status IS NULL AND transport LIKE '%timeout%' THEN 'timeout'
  WHEN status IS NULL THEN 'network' WHEN status BETWEEN 200 AND 299 THEN 'ok'
  WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 THEN 'rate_limited'
  WHEN status BETWEEN 500 AND 599 THEN 'server' ELSE 'client' END"""


@query("attempt_class", with_domain("attempt", f"""
    SELECT attempt_id, {_KIND} AS error_kind, CASE {_KIND} WHEN 'ok' THEN '' WHEN 'auth' THEN 'auth'
      WHEN 'rate_limited' THEN 'rate_limited' WHEN 'client' THEN 'permanent'
      ELSE 'retryable_read' END AS retry_class FROM attempt"""))
def attempt_class(d: Domain) -> DataFrame:
    """F08."""
    return traffic.classify_attempts(d["attempt"]).select(
        "attempt_id", F.coalesce("error_kind", F.lit("ok")).alias("error_kind"),
        F.coalesce("retry_class", F.lit("")).alias("retry_class"),
    )


_RETRY = f"""CASE WHEN try_cast(trim(retry_after) AS DOUBLE) IS NOT NULL
      THEN CASE WHEN isnan(try_cast(trim(retry_after) AS DOUBLE)) THEN NULL
           ELSE try_cast(trim(retry_after) AS DOUBLE) END
      ELSE epoch(try_strptime(trim(retry_after), '%a, %d %b %Y %H:%M:%S GMT')) - epoch({NOW}) END"""


@query("retry_after", with_domain("attempt", f"""
    SELECT attempt_id, CAST(CASE WHEN ({_RETRY}) IS NULL THEN -1
      ELSE round(least(greatest({_RETRY}, 0), 900) * 1000) END AS BIGINT) AS retry_ms, coalesce(try_cast(trim(limit_header) AS BIGINT), -99) AS limit_value
    FROM attempt"""))
def retry_after(d: Domain) -> DataFrame:
    """F10."""
    seconds = traffic.retry_after_seconds(F.col("retry_after"), F.expr(NOW))
    return d["attempt"].select(
        "attempt_id",
        F.coalesce(F.round(seconds * 1000).cast("bigint"), F.lit(-1)).alias("retry_ms"),
        F.coalesce(traffic.int_header(F.col("limit_header")), F.lit(-99)).alias("limit_value"),
    )


@query("attempt_stats", with_domain("attempt", f"""
    SELECT endpoint, priority, {_KIND} AS outcome, count(*) AS attempts, max(duration_ms) AS max_ms,
      CAST(sum(CAST(round(duration_ms * 100) AS BIGINT)) AS BIGINT) AS sum_ms_x100
    FROM attempt GROUP BY ALL"""))
def attempt_stats(d: Domain) -> DataFrame:
    """F11."""
    return traffic.attempt_stats(traffic.classify_attempts(d["attempt"]))


@query("send_outcome", with_domain("attempt", """
    SELECT attempt_id, CASE WHEN status IS NULL THEN CASE transport WHEN 'connect_error'
        THEN 'not_delivered' ELSE 'unknown' END
      WHEN status BETWEEN 200 AND 299 THEN CASE WHEN k % 5 = 0 THEN 'unknown' ELSE 'delivered' END
      WHEN status IN (400, 401, 403, 404, 422, 429) THEN 'not_delivered' ELSE 'unknown' END
      AS outcome,
      CASE WHEN status IS NULL THEN CASE transport WHEN 'connect_error' THEN 'not_sent_connect'
        WHEN 'read_timeout' THEN 'timeout_after_send' ELSE 'write_incomplete' END
      WHEN status BETWEEN 200 AND 299 AND k % 5 = 0 THEN 'malformed_2xx'
      ELSE 'http_' || CAST(status AS STRING) END AS reason FROM attempt"""))
def send_outcome(d: Domain) -> DataFrame:
    """F12."""
    rows = d["attempt"].withColumn(
        "message_id", F.when(F.col("k") % 5 != 0, F.col("attempt_id").cast("string"))
    )
    return traffic.send_outcomes(rows).select("attempt_id", "outcome", "reason")


@query("content_hash_check", """
    SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN turn = 6
      THEN 'not_authorised' WHEN (conv_id + turn) % 5 = 0 THEN 'text_differs' ELSE 'ok' END
      AS verdict, sha256(text) AS text_sha256 FROM conversations""")
def content_hash_check(d: Domain) -> DataFrame:
    """authorisations as stored hashes; every fifth was given for another text."""
    texts = d["conversations"].withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    tampered = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat("text", F.lit("!")))
    auth = texts.where("turn <> 6").select(
        "key", F.sha2(F.coalesce(tampered, F.col("text")), 256).alias("sha256")
    )
    return traffic.check_content_hash(texts, auth, "key").select(
        "conv_id", "turn", "verdict", "text_sha256"
    )


def _rated(d: Domain) -> DataFrame:
    """The attempts squeezed in time, so limits are met and broken."""
    base = F.expr("unix_micros(started_at) - 1704067200000000")
    return d["attempt"].select(
        "attempt_id", "endpoint", "priority", "status",
        F.timestamp_micros(F.lit(1704067200000000) + F.floor(base / 50)).alias("started_at"),
        traffic.retry_after_seconds(F.col("retry_after"), F.col("started_at")).alias("retry_after_s"),
    )


@query("rate_replay")
def rate_replay(d: Domain) -> DataFrame:
    """attempts within their minute's allowance and outside of pauses, per endpoint."""
    judged = rate.window_rate(rate.with_pauses(_rated(d)))
    return judged.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("over") & ~F.col("paused")).alias("compliant"),
        F.count_if("paused").alias("paused"), F.max("in_window").alias("busiest"),
    )


@query("rate_window", with_domain("attempt", f""",
    a AS (SELECT attempt_id, endpoint, 1704067200000000 +
      CAST(floor((epoch_us(started_at) - 1704067200000000) / 50.0) AS BIGINT) AS us FROM attempt),
    c AS (SELECT *, count(*) OVER (PARTITION BY endpoint ORDER BY us
      RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM a),
    l AS (SELECT *, CASE endpoint WHEN 'chats_list' THEN 33 WHEN 'messages_list' THEN 33
      WHEN 'items_list' THEN 30 WHEN 'item_detail' THEN 510 ELSE 32 END AS allowed FROM c)
    SELECT endpoint, max(n) AS busiest, count(*) FILTER (n > allowed) AS over_limit,
      CAST(sum(n) AS BIGINT) AS sum_in_window FROM l GROUP BY endpoint"""))
def rate_window(d: Domain) -> DataFrame:
    """trailing-minute counts."""
    return rate.window_rate(_rated(d)).groupBy("endpoint").agg(
        F.max("in_window").alias("busiest"), F.count_if("over").alias("over_limit"),
        F.sum("in_window").alias("sum_in_window"),
    )


# -- endpoints, funnel, filters --------------------------------------------------------------------

_SITE = (
    ("article", "GET", "/{lang}/{id}"),
    ("language_root", "GET", "/{lang}"),
    ("section", "GET", "/{lang}/{section}/{id}"),
)


@query("endpoint_audit", """
    SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'forbidden'
      WHEN regexp_full_match(p, '/[^/]+/[^/]+') THEN 'article'
      WHEN regexp_full_match(p, '/[^/]+') THEN 'language_root'
      WHEN regexp_full_match(p, '/[^/]+/[^/]+/[^/]+') THEN 'section' ELSE 'forbidden' END AS endpoint
    FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '')
          AS p FROM pages)""")
def endpoint_audit(d: Domain) -> DataFrame:
    """an access log against path templates; every ninth request has another method."""
    log = d["pages"].select(
        "page_id",
        F.when(F.col("page_id") % 9 == 0, "DELETE").otherwise("GET").alias("method"),
        F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "").alias("path"),
    )
    return traffic.match_endpoints(log, _SITE).select("page_id", "endpoint")


@query("step_funnel", with_domain("step_log", """,
    r AS (SELECT run_id, max(right(account_id, 3)) AS tail,
      max(coalesce(error_kind, '')) FILTER (step_no = 1) AS e1,
      max(coalesce(error_kind, '')) FILTER (step_no = 2) AS e2,
      max(coalesce(error_kind, '')) FILTER (step_no = 3) AS e3,
      max(coalesce(error_kind, '')) FILTER (step_no = 4) AS e4 FROM step_log GROUP BY run_id)
    SELECT run_id, CASE WHEN e1 <> '' OR e2 <> '' THEN '' ELSE tail END AS account_tail,
      CASE WHEN e1 = '' THEN 'ok' ELSE e1 END AS step1,
      CASE WHEN e1 <> '' THEN 'not_run' WHEN e2 = '' THEN 'ok' ELSE e2 END AS step2,
      CASE WHEN e1 <> '' THEN 'not_run' WHEN e3 = '' THEN 'ok' ELSE e3 END AS step3,
      CASE WHEN e1 <> '' THEN 'not_run' WHEN e2 <> '' THEN 'skipped' WHEN e4 = '' THEN 'ok'
           ELSE e4 END AS step4, e1 = '' AND e2 = '' AND e3 = '' AND e4 = '' AS all_ok FROM r"""))
def step_funnel(d: Domain) -> DataFrame:
    """F16."""
    return traffic.access_funnel(d["step_log"])


@query("listing_filter", """
    SELECT p_partkey AS item_id, p_type AS status, CAST(p_size AS BIGINT) AS category FROM part
    WHERE p_type IN ('SMALL', 'LARGE') AND p_partkey % 97 IN (3, 5, 8) AND p_retailprice >= 950""")
def listing_filter(d: Domain) -> DataFrame:
    """every criterion that applies to items at once."""
    items = d["part"].select(
        F.col("p_partkey").alias("item_id"), F.col("p_type").alias("status"),
        F.col("p_size").cast("bigint").alias("category"),
        F.col("p_retailprice").alias("updated_at"), (F.col("p_partkey") % 97).alias("shelf"),
    )
    found = traffic.listing_filter(
        items, id_column="shelf", item_ids=[3, 5, 8], statuses=["SMALL", "LARGE"],
        updated_from=F.lit(950.0),
    )
    return found.select("item_id", "status", "category")
