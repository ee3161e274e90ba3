"""Derived domain tables: catalogue, vehicles, stock, messages, jobs and so on, computed from the
driver tables by plain SQL that Spark and DuckDB both run. They are inputs, not the work under
test, so one text serves both engines; ``Dialect`` hides the few spelling differences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from partsight.sources.tables import TABLES, read_table


class Dialect:
    """Spelling differences between the two engines."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def ref(self, table: str) -> str:
        return "{" + table + "}" if self.spark else table

    def each(self, *values: int) -> str:
        joined = ", ".join(str(v) for v in values)
        return f"explode(array({joined}))" if self.spark else f"unnest([{joined}])"

    def array(self, *items: str) -> str:
        joined = ", ".join(items)
        return f"array({joined})" if self.spark else f"[{joined}]"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def secs(self, ts: str) -> str:
        """Timestamp to whole epoch seconds."""
        return f"unix_seconds({ts})" if self.spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def ts(self, secs: str) -> str:
        """Epoch seconds to timestamp."""
        return f"timestamp_seconds({secs})" if self.spark else f"make_timestamp(CAST(({secs}) * 1000000 AS BIGINT))"

    def json_int(self, column: str, key: str) -> str:
        if self.spark:
            return f"CAST(get_json_object({column}, '$.{key}') AS BIGINT)"
        return f"CAST(json_extract_string({column}, '$.{key}') AS BIGINT)"


SPARK, DUCK = Dialect(True), Dialect(False)

Binding = Callable[[Dialect], str]
BINDINGS: dict[str, tuple[tuple[str, ...], Binding]] = {}


def binding(name: str, *needs: str) -> Callable[[Binding], Binding]:
    def register(fn: Binding) -> Binding:
        BINDINGS[name] = (needs, fn)
        return fn

    return register


class Domain:
    """The derived tables of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def _built(self) -> dict[str, DataFrame]:
        return {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in TABLES:
                self._built[name] = read_table(self.spark, self.sf_dir, name)
            else:
                needs, fn = BINDINGS[name]
                inputs = {n: self.table(n) for n in needs}
                self._built[name] = self.spark.sql(fn(SPARK), **inputs)
        return self._built[name]

    __getitem__ = table


def with_domain(names: str, body: str) -> str:
    """DuckDB text: the ``WITH`` clause of the named derived tables, then ``body`` (which may go
    on with further comma-separated CTEs by starting with a comma)."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for need in BINDINGS[name][0]:
            visit(need)
        order.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n][1](DUCK)})" for n in order)
    return f"WITH {ctes}\n{body}"


# ----------------------------------------------------------------------------------------------
# Catalogue
# ----------------------------------------------------------------------------------------------


def _sku(key: str) -> str:
    return f"CASE WHEN {key} % 10 = 0 THEN 'SYN-' ELSE 'P-' END || CAST({key} AS STRING)"


@binding("product", "part")
def _product(d: Dialect) -> str:
    return f"""
    SELECT p_partkey AS product_id, {_sku('p_partkey')} AS sku, p_name AS title,
           p_type AS part_type,
           CASE WHEN p_partkey % 11 = 0 THEN 'refurbished' WHEN p_partkey % 4 = 0 THEN 'used'
                ELSE 'new' END AS condition,
           CASE WHEN p_partkey % 13 = 0 THEN 'stocked_set' WHEN p_partkey % 17 = 0
                THEN 'virtual_set' ELSE 'single' END AS set_kind,
           p_brand AS brand,
           CASE WHEN p_partkey % 10 = 0 THEN 'synthetic' ELSE 'real' END AS data_origin
    FROM {d.ref('part')}"""


@binding("product_oem", "part")
def _product_oem(d: Dialect) -> str:
    n = f"CAST(2000000000 + (p_partkey * 7919 + k * 104729) % 1000000000 AS STRING)"
    return f"""
    SELECT product_id, sku, oem_id,
           CASE WHEN oem_id % 3 = 0 THEN 'A ' || substring(n, 1, 3) || ' ' || substring(n, 4, 3)
                     || '-' || substring(n, 7, 2) || ' ' || substring(n, 9, 2)
                WHEN oem_id % 3 = 1 THEN 'a' || n ELSE substring(n, 1, 5) || '.' || substring(n, 6, 5)
           END AS oem_number
    FROM (SELECT p_partkey AS product_id, {_sku('p_partkey')} AS sku, p_partkey * 2 + k AS oem_id,
                 {n} AS n
          FROM (SELECT p_partkey, {d.each(0, 1)} AS k FROM {d.ref('part')}) x) y"""


@binding("fitment", "part")
def _fitment(d: Dialect) -> str:
    null_s = "CAST(NULL AS STRING)"
    return f"""
    SELECT record_id, sku, make, model, chassis_code, year_from, year_to, facelift, status,
           CASE WHEN h % 5 = 0 THEN {d.array("'AMG-Line'")}
                WHEN h % 5 = 1 THEN {d.array("'Exclusive'", "'avantgarde'")} END AS trim_line,
           CASE WHEN h % 4 = 1 THEN {d.array('4', '6')} WHEN h % 4 = 2 THEN {d.array('0')} END
               AS parktronic_sensors,
           CASE WHEN h % 6 = 1 THEN {d.array('true')} WHEN h % 6 = 2 THEN {d.array('false')} END
               AS headlamp_washer,
           CASE WHEN h % 9 = 1 THEN {d.array('true')} END AS front_camera,
           evidence_kind,
           CASE WHEN h % 23 = 0 THEN '  ' WHEN h % 29 = 0 THEN {null_s}
                ELSE 'ref-' || CAST(record_id AS STRING) END AS evidence_ref,
           CASE WHEN h % 31 <> 0 THEN {d.ts('1500000000 + h * 60')} END AS evidence_verified_at,
           data_origin, 'catalogue' AS source
    FROM (
      SELECT p_partkey * 4 + k AS record_id, p_partkey, {_sku('p_partkey')} AS sku,
             'Make' || CAST(p_partkey % 3 AS STRING) AS make,
             'Model ' || CAST(p_partkey % 5 AS STRING) AS model,
             CASE WHEN (p_partkey + k) % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS chassis_code,
             CASE WHEN (p_partkey + k) % 7 = 0 THEN NULL ELSE 1995 + p_size % 20 END AS year_from,
             CASE WHEN (p_partkey + k) % 6 = 0 THEN NULL ELSE 1999 + p_size % 20 + k * 2 END
                 AS year_to,
             CASE (p_partkey + k * 5) % 4 WHEN 0 THEN true WHEN 1 THEN false END AS facelift,
             CASE WHEN (p_partkey + k) % 8 = 0 THEN 'incompatible'
                  WHEN (p_partkey + k * 3) % 9 = 0 THEN 'needs_verification'
                  ELSE 'verified' END AS status,
             CASE (p_partkey * 3 + k) % 12
                  WHEN 0 THEN 'visual_similarity' WHEN 1 THEN 'body_code_only'
                  WHEN 2 THEN NULL WHEN 3 THEN 'synthetic_fixture'
                  WHEN 4 THEN 'manufacturer_doc' WHEN 5 THEN 'owner_confirmed'
                  WHEN 6 THEN 'listing_title' ELSE 'oem_catalog' END AS evidence_kind,
             CASE WHEN p_partkey % 10 = 0 THEN 'synthetic' ELSE 'real' END AS data_origin,
             p_partkey * 31 + k * 17 AS h
      FROM (SELECT *, {d.each(0, 1, 2, 3)} AS k FROM {d.ref('part')} WHERE p_partkey % 19 <> 0) x
      WHERE k <= p_partkey % 4
    ) y"""


@binding("vehicle", "customer")
def _vehicle(d: Dialect) -> str:
    return f"""
    SELECT c_custkey AS vehicle_id,
           CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'make-' || CAST(c_custkey % 3 AS STRING) END
               AS make,
           CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'MODEL ' || CAST(c_custkey % 5 AS STRING) END
               AS model,
           CASE WHEN c_custkey % 4 = 0 THEN NULL
                ELSE 'brand ' || CAST(1 + c_custkey % 25 AS STRING) END AS chassis_code,
           CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE 1996 + c_custkey % 23 END AS year,
           CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS facelift,
           CASE c_custkey % 4 WHEN 0 THEN 'amg line' WHEN 1 THEN 'Avantgarde' WHEN 2 THEN 'base'
               END AS trim_line,
           CASE WHEN c_custkey % 6 < 5 THEN (c_custkey % 4) * 2 END AS parktronic_sensors,
           CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END
               AS headlamp_washer,
           CASE WHEN c_custkey % 7 < 3 THEN true END AS front_camera
    FROM {d.ref('customer')}"""


@binding("candidate", "orders", "lineitem")
def _candidate(d: Dialect) -> str:
    """The parts each customer asks about: what they have in their orders."""
    return f"""
    SELECT DISTINCT o_custkey AS vehicle_id, {_sku('l_partkey')} AS sku
    FROM {d.ref('orders')} JOIN {d.ref('lineitem')} ON l_orderkey = o_orderkey"""


@binding("bundle", "orders")
def _bundle(d: Dialect) -> str:
    return f"""
    SELECT 'SET-' || CAST(o_orderkey AS STRING) AS set_sku, o_custkey AS vehicle_id,
           CASE WHEN o_orderkey % 3 = 0 THEN 'stocked_set' ELSE 'virtual_set' END AS set_kind,
           CASE WHEN o_orderkey % 50 = 0 THEN 'synthetic' ELSE 'real' END AS data_origin
    FROM {d.ref('orders')}"""


@binding("set_component", "lineitem")
def _set_component(d: Dialect) -> str:
    return f"""
    SELECT 'SET-' || CAST(l_orderkey AS STRING) AS set_sku, {_sku('l_partkey')} AS component_sku,
           CAST(1 + CAST(sum(l_quantity) AS BIGINT) % 40 AS BIGINT) AS qty,
           max(l_linenumber) % 5 <> 0 AS present, max(l_linenumber) % 6 = 0 AS optional
    FROM {d.ref('lineitem')} GROUP BY l_orderkey, l_partkey"""


# ----------------------------------------------------------------------------------------------
# Inventory
# ----------------------------------------------------------------------------------------------


@binding("stock_line", "lineitem")
def _stock_line(d: Dialect) -> str:
    """One stock line per (part, supplier); every seventh part has no stock line at all."""
    return f"""
    SELECT 'ST-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS stock_ref,
           {_sku('l_partkey')} AS sku, 'WH-' || CAST(l_suppkey % 7 AS STRING) AS location,
           CAST(sum(l_quantity) AS BIGINT) AS physical_qty,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT)
               AS external_reserved_qty,
           CAST(sum(CASE WHEN l_linestatus = 'O' AND l_partkey % 5 <> 0 THEN l_quantity ELSE 0 END)
               AS BIGINT) AS available_qty,
           max(l_shipdate) AS fetched_at
    FROM {d.ref('lineitem')} WHERE l_partkey % 7 <> 3 GROUP BY l_partkey, l_suppkey"""


@binding("price", "part")
def _price(d: Dialect) -> str:
    return f"""
    SELECT {_sku('p_partkey')} AS sku, CAST(round(p_retailprice * 100) AS BIGINT) AS amount_minor,
           CASE WHEN p_partkey % 4 = 0 THEN 'EUR' ELSE 'RUB' END AS currency,
           {d.ts('940000000 + (p_partkey * 86400 * 7) % 60000000')} AS fetched_at
    FROM {d.ref('part')} WHERE p_partkey % 9 <> 4"""


@binding("photo", "lineitem")
def _photo(d: Dialect) -> str:
    return f"""
    SELECT DISTINCT 'ST-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)
               AS stock_ref,
           CAST(l_linenumber AS BIGINT) AS sort_order,
           'ph-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS photo_key
    FROM {d.ref('lineitem')}"""


@binding("sku_request", "part")
def _sku_request(d: Dialect) -> str:
    """Requests for items; some name an SKU in lower case, some one that does not exist."""
    return f"""
    SELECT p_partkey AS request_id,
           CASE WHEN p_partkey % 12 = 5 THEN 'NO-SUCH-' || CAST(p_partkey AS STRING)
                WHEN p_partkey % 3 = 0 THEN ' ' || lower({_sku('p_partkey')}) || ' '
                ELSE {_sku('p_partkey')} END AS sku,
           CASE WHEN p_partkey % 20 = 1 THEN 'down' WHEN p_partkey % 20 = 2 THEN 'degraded'
                ELSE 'up' END AS health
    FROM {d.ref('part')}"""


@binding("search_request", "customer", "product_oem", "product", "vehicle")
def _search_request(d: Dialect) -> str:
    """Searches: by SKU, by part number, some with vehicle and type criteria on top."""
    # Each side grows with the input and passes for small: nothing is to be broadcast.
    hint = "/*+ MERGE(p, o) */ " if d.spark else ""
    return f"""
    SELECT {hint}v.vehicle_id AS query_id,
           CASE WHEN v.vehicle_id % 2 = 0 THEN lower(p.sku) END AS sku,
           CASE WHEN v.vehicle_id % 2 = 1 OR v.vehicle_id % 6 = 0 THEN o.oem_number END
               AS oem_number,
           CASE WHEN v.vehicle_id % 5 = 0 THEN 'Make' || CAST(p.product_id % 3 AS STRING) END
               AS make,
           CASE WHEN v.vehicle_id % 10 = 0 THEN 'model' || CAST(p.product_id % 5 AS STRING) END
               AS model,
           CASE WHEN v.vehicle_id % 7 = 0 THEN v.chassis_code
                WHEN v.vehicle_id % 7 = 1 THEN p.brand
                WHEN v.vehicle_id % 7 = 2 THEN substring(p.title, 1, 4) END AS chassis_code,
           CASE WHEN v.vehicle_id % 4 = 1 THEN p.part_type WHEN v.vehicle_id % 16 = 3
                THEN 'no_type' END AS part_type
    FROM {d.ref('vehicle')} v
    JOIN {d.ref('product')} p ON p.product_id = v.vehicle_id
    JOIN {d.ref('product_oem')} o ON o.oem_id = p.product_id * 2"""


@binding("fetch_log", "events")
def _fetch_log(d: Dialect) -> str:
    return f"""
    SELECT event_id AS fetch_id, 'warehouse-' || CAST(user_id % 40 AS STRING) AS source, ts,
           CASE WHEN event_type = 'error' THEN 'connection_down'
                WHEN event_type = 'signup' AND value > 60 THEN 'timeout' END AS error,
           value AS duration_s
    FROM {d.ref('events')}"""


# ----------------------------------------------------------------------------------------------
# Messages, drafts, outbox, jobs
# ----------------------------------------------------------------------------------------------


@binding("inbound_message", "conversations")
def _inbound_message(d: Dialect) -> str:
    """The same message may come from the webhook, the poller and the import."""
    return f"""
    SELECT 'm-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id,
           conv_id AS conversation_id,
           CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'assistant' ELSE 'system'
               END AS author_role,
           CASE role WHEN 'user' THEN 'in' ELSE 'out' END AS direction,
           CASE k WHEN 0 THEN 'webhook' WHEN 1 THEN 'poller' ELSE 'import' END AS source,
           {d.ts('1700000000 + conv_id * 97 + turn * 60')} AS created_at,
           {d.ts('1700000000 + conv_id * 97 + turn * 60 + k * 30 + (conv_id + turn + k) % 3 * 40')}
               AS received_at,
           length(text) AS text_length
    FROM (SELECT *, {d.each(0, 1, 2)} AS k FROM {d.ref('conversations')}) x
    WHERE k = 0 OR (conv_id + turn * 3 + k) % 3 = 0"""


@binding("stored_message", "conversations")
def _stored_message(d: Dialect) -> str:
    """What is already stored: the first turns of every fourth conversation."""
    return f"""
    SELECT 'm-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id,
           conv_id AS conversation_id, turn + 1 AS seq
    FROM {d.ref('conversations')} WHERE conv_id % 4 = 0 AND turn < 2"""


@binding("conversation_state", "customer", "orders")
def _conversation_state(d: Dialect) -> str:
    return f"""
    SELECT c_custkey AS conversation_id,
           CASE WHEN c_custkey % 6 = 0 THEN 'paused' ELSE 'active' END AS automation,
           CASE WHEN c_custkey % 6 = 0 AND c_custkey % 18 <> 0 THEN 'owner_takeover' END
               AS paused_reason,
           CASE WHEN c_custkey % 8 = 0 THEN 'closed' WHEN c_custkey % 8 = 7 THEN 'unheard_of'
                ELSE 'offer_presented' END AS state,
           CASE WHEN c_custkey % 16 = 0 THEN 'inactive' WHEN c_custkey % 8 = 5 THEN 'owner_closed'
               END AS close_reason,
           5 + c_custkey % 7 AS last_inbound_seq, c_custkey % 9 AS last_processed_seq,
           CAST(1 + c_custkey % 3 AS BIGINT) AS state_version
    FROM {d.ref('customer')}"""


@binding("draft", "orders")
def _draft(d: Dialect) -> str:
    return f"""
    SELECT o_orderkey AS draft_id, o_custkey AS conversation_id,
           5 + (o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 7 AS based_on_seq,
           CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'P' THEN 'approved'
                ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'sent' ELSE 'stale' END END AS status,
           o_orderdate AS created_at
    FROM {d.ref('orders')}"""


@binding("outbound", "lineitem")
def _outbound(d: Dialect) -> str:
    return f"""
    SELECT l_orderkey * 16 + l_linenumber AS outbound_id, l_orderkey AS draft_id,
           CAST(1 AS BIGINT) AS generation, CAST(l_linenumber AS BIGINT) AS part_no,
           CAST(7 AS BIGINT) AS part_count,
           CASE WHEN l_linenumber > 1 AND (l_orderkey + l_linenumber) % 3 = 0 THEN 'pending'
                WHEN l_orderkey % 5 = 0 THEN 'pending'
                WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 'failed'
                WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN 'unknown' ELSE 'sent' END AS status,
           CASE WHEN l_linenumber = 7 THEN 'image' ELSE 'text' END AS kind,
           CASE WHEN l_linenumber <> 7 AND l_orderkey % 40 <> 1 THEN l_returnflag END AS body_text,
           CAST(NULL AS BIGINT) AS photo_id, CAST(0 AS BIGINT) AS version
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag
          FROM {d.ref('lineitem')} GROUP BY l_orderkey, l_linenumber) x"""


@binding("job", "events")
def _job(d: Dialect) -> str:
    """Jobs with twins: several rows may share (kind, dedup_key)."""
    return f"""
    SELECT job_id, kind, dedup_key, status, run_after, attempts, max_attempts, claimed_by,
           last_error_code, version
    FROM (
      SELECT event_id AS job_id,
             CASE event_type WHEN 'error' THEN 'reply' WHEN 'click' THEN 'ingest'
                  ELSE 'followup' END AS kind,
             'c' || CAST(user_id * 50 + {d.idiv('event_id', '211')} AS STRING) AS dedup_key,
             CASE WHEN event_id % 4 = 0 THEN 'queued' WHEN event_id % 4 = 1 THEN 'running'
                  WHEN event_id % 8 = 2 THEN 'dead' WHEN event_id % 8 = 6 THEN 'superseded'
                  ELSE 'done' END AS status,
             ts AS run_after, {d.json_int('props', 'k')} % 14 AS attempts,
             CAST(12 AS BIGINT) AS max_attempts,
             CASE WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 3 = 0 THEN NULL
                  ELSE 'worker-' || CAST(event_id % 3 AS STRING) END END AS claimed_by,
             CASE WHEN event_id % 7 = 0 THEN 'timeout' END AS last_error_code,
             CAST(event_id % 4 AS BIGINT) AS version
      FROM {d.ref('events')}
    ) x"""


@binding("queued_job", "job")
def _queued_job(d: Dialect) -> str:
    """The queue as a table that keeps its key rule: one queued row per (kind, dedup_key)."""
    return f"""
    SELECT j.* FROM {d.ref('job')} j
    JOIN (SELECT kind, dedup_key, min(job_id) AS job_id FROM {d.ref('job')}
          WHERE status = 'queued' GROUP BY kind, dedup_key) k USING (kind, dedup_key, job_id)"""


@binding("enqueue_request", "events")
def _enqueue_request(d: Dialect) -> str:
    return f"""
    SELECT event_id AS request_id,
           CASE event_type WHEN 'error' THEN 'reply' WHEN 'click' THEN 'ingest'
                ELSE 'followup' END AS kind,
           'c' || CAST(user_id * 50 + {d.idiv('event_id', '190')} AS STRING) AS dedup_key,
           {d.ts(f"{d.secs('ts')} - 3600 + event_id % 5000")} AS run_after
    FROM {d.ref('events')}"""


@binding("audit_event", "events")
def _audit_event(d: Dialect) -> str:
    return f"""
    SELECT event_id AS audit_id, ts, 'user-' || CAST(user_id AS STRING) AS actor,
           CASE event_type WHEN 'error' THEN 'job_dead' WHEN 'view' THEN 'set_automation_mode'
                WHEN 'click' THEN 'set_kill_switch' ELSE 'send' END AS action,
           {d.json_int('props', 'k')} AS entity_id,
           CASE WHEN event_type = 'error' THEN 'alert' ELSE 'ok' END AS result,
           CASE WHEN event_type = 'error' THEN 'worker_lost' END AS reason_code
    FROM {d.ref('events')}"""


@binding("setting_change", "events")
def _setting_change(d: Dialect) -> str:
    """Applied settings changes; ``version`` grows with every change of a store's settings."""
    return f"""
    SELECT 'store-' || CAST(user_id AS STRING) AS setting_id, event_id AS version, ts,
           CASE WHEN event_type IN ('error', 'click') THEN 'kill_switch' ELSE 'automation_mode'
               END AS field,
           CASE event_type WHEN 'error' THEN 'true' WHEN 'click' THEN 'false'
                WHEN 'view' THEN 'draft_only' ELSE 'approve_to_send' END AS new_value
    FROM {d.ref('events')}"""


@binding("cas_proposal", "job")
def _cas_proposal(d: Dialect) -> str:
    """Up to three proposed changes per job, some against an outdated status or version."""
    return f"""
    SELECT job_id * 4 + k AS proposal_id, job_id,
           CASE WHEN (job_id + k) % 5 = 0 THEN 'done' ELSE status END AS expected_status,
           CASE WHEN (job_id + k) % 7 = 0 THEN version + 1 ELSE version END AS expected_version,
           CASE k WHEN 0 THEN 'done' WHEN 1 THEN 'dead' ELSE 'queued' END AS new_status
    FROM (SELECT *, {d.each(0, 1, 2)} AS k FROM {d.ref('job')}) x WHERE k <= job_id % 3"""


# ----------------------------------------------------------------------------------------------
# API traffic
# ----------------------------------------------------------------------------------------------


@binding("attempt", "events")
def _attempt(d: Dialect) -> str:
    return f"""
    SELECT event_id AS attempt_id,
           CASE user_id % 5 WHEN 0 THEN 'chats_list' WHEN 1 THEN 'messages_list'
                WHEN 2 THEN 'items_list' WHEN 3 THEN 'item_detail' ELSE 'accounts_self' END
               AS endpoint,
           CASE WHEN user_id % 3 = 0 THEN 'bulk' ELSE 'live' END AS priority,
           ts AS started_at, value AS duration_ms,
           CASE WHEN event_type = 'view' AND k % 10 = 0 THEN NULL
                WHEN event_type = 'error' THEN CASE k % 10 WHEN 0 THEN 401 WHEN 1 THEN 403
                     WHEN 2 THEN 429 WHEN 3 THEN 500 WHEN 4 THEN 503 WHEN 5 THEN 302
                     WHEN 6 THEN 404 WHEN 7 THEN 422 WHEN 8 THEN 418 ELSE 400 END
                ELSE CASE WHEN k % 2 = 0 THEN 200 ELSE 201 END END AS status,
           CASE WHEN event_type = 'view' AND k % 10 = 0 THEN CASE k % 6 WHEN 0 THEN
                'connect_error' WHEN 2 THEN 'read_timeout' ELSE 'write_error' END END AS transport,
           CASE k % 9 WHEN 0 THEN ' 30 ' WHEN 1 THEN '12.5' WHEN 2 THEN '-4' WHEN 3 THEN ''
                WHEN 4 THEN 'soon' WHEN 5 THEN '86400' WHEN 6 THEN 'Mon, 01 Jan 2024 12:00:00 GMT'
                WHEN 7 THEN 'nan' END AS retry_after,
           CASE k % 4 WHEN 0 THEN ' 60' WHEN 1 THEN 'x' WHEN 2 THEN '-1' END AS limit_header,
           k AS k, user_id
    FROM (SELECT *, {d.json_int('props', 'k')} AS k FROM {d.ref('events')}) x"""


@binding("page_entry", "events")
def _page_entry(d: Dialect) -> str:
    """Listing runs, one row per entry the server sent. Ids repeat within and across pages."""
    page = d.idiv("event_id", "500")
    return f"""
    SELECT 'r-' || CAST(user_id % 20 AS STRING) AS run_id, {page} AS page_no,
           event_id AS entry_no,
           'i-' || CAST(({d.json_int('props', 'k')} + 7 * {page}) % 150 AS STRING) AS item_id,
           event_type <> 'signup' OR event_id % 7 > 0 AS parsed
    FROM {d.ref('events')}"""


@binding("step_log", "events")
def _step_log(d: Dialect) -> str:
    """Access-check runs of four steps each, with the error a step would meet."""
    return f"""
    SELECT event_id AS run_id, CAST(step_no AS BIGINT) AS step_no,
           'acc' || CAST(100000 + user_id * 37 AS STRING) AS account_id,
           CASE WHEN event_type IN ('error', 'view') AND (k + step_no * 3) % 4 = 0 THEN
                CASE (k + step_no) % 7 WHEN 0 THEN 'auth' WHEN 1 THEN 'rate_limited'
                     WHEN 2 THEN 'server' WHEN 3 THEN 'timeout' WHEN 4 THEN 'network'
                     WHEN 5 THEN 'unexpected_payload' ELSE 'client' END END AS error_kind
    FROM (SELECT *, {d.json_int('props', 'k')} AS k, {d.each(1, 2, 3, 4)} AS step_no
          FROM {d.ref('events')}) x"""


# ----------------------------------------------------------------------------------------------
# Texts
# ----------------------------------------------------------------------------------------------


@binding("part_text", "documents")
def _part_text(d: Dialect) -> str:
    """Draft parts: each document is one part of a draft; ten documents make a draft."""
    return f"""
    SELECT {d.idiv('doc_id', '10')} AS draft_id, doc_id % 10 AS part_index, text,
           doc_id % 3 = 0 AS is_owner_edit, doc_id % 5 = 0 AS completion_confirmed,
           doc_id % 7 = 0 AS payment_confirmed, doc_id % 11 = 0 AS fitment_verified
    FROM {d.ref('documents')}"""


@binding("note", "documents")
def _note(d: Dialect) -> str:
    return f"""
    SELECT doc_id AS note_id, text, source AS folder FROM {d.ref('documents')}"""


@binding("page_path", "pages")
def _page_path(d: Dialect) -> str:
    """URL split into host and path segments."""
    bare = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"
    split = f"split({bare}, '/')" if d.spark else f"string_split({bare}, '/')"
    keep = f"filter({split}, x -> x <> '')" if d.spark else f"list_filter({split}, lambda x: x <> '')"
    return f"SELECT page_id, url, {keep} AS segments FROM {d.ref('pages')}"
