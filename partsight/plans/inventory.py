"""Queries of area D (inventory search and claims)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.functions.keys import oem_key, sku_key
from partsight.operators import inventory as inv
from partsight.plans.registry import query
from partsight.sources.domain import DUCK, Domain, with_domain

AS_OF = "TIMESTAMP '2000-06-01 00:00:00'"
MAX_AGE = "INTERVAL '700' DAY"


def _as_of():
    return F.expr(AS_OF)


def _s(column: str):
    return F.coalesce(F.unix_seconds(column), F.lit(-1)).alias("as_of_s")


@query(
    "oem_norm",
    with_domain("product_oem", """SELECT oem_id,
      upper(regexp_replace(oem_number, '[\\s\\-./]+', '', 'g')) AS oem_key FROM product_oem"""),
)
def oem_norm(d: Domain) -> DataFrame:
    """D01."""
    return d["product_oem"].select("oem_id", oem_key(F.col("oem_number")).alias("oem_key"))


_KEYED = """
q AS (SELECT query_id, upper(trim(sku)) AS q_sku,
        upper(regexp_replace(oem_number, '[\\s\\-./]+', '', 'g')) AS q_oem,
        lower(regexp_replace(make, '[^A-Za-z0-9]+', '', 'g')) AS q_make,
        lower(regexp_replace(model, '[^A-Za-z0-9]+', '', 'g')) AS q_model,
        lower(regexp_replace(chassis_code, '[^A-Za-z0-9]+', '', 'g')) AS q_chassis_code, part_type
      FROM search_request),
oem AS (SELECT DISTINCT sku, upper(regexp_replace(oem_number, '[\\s\\-./]+', '', 'g')) AS k
        FROM product_oem),
spec AS (SELECT DISTINCT sku, lower(regexp_replace(make, '[^A-Za-z0-9]+', '', 'g')) AS make,
        lower(regexp_replace(model, '[^A-Za-z0-9]+', '', 'g')) AS model,
        lower(regexp_replace(chassis_code, '[^A-Za-z0-9]+', '', 'g')) AS chassis FROM fitment),
pair AS (
  SELECT q.*, p.sku, lower(regexp_replace(p.title, '[^A-Za-z0-9]+', '', 'g')) AS t
  FROM q, product p
  WHERE (q.q_sku IS NULL OR upper(p.sku) = q.q_sku)
    AND (q.q_oem IS NULL OR EXISTS (SELECT 1 FROM oem WHERE oem.sku = p.sku AND oem.k = q.q_oem))
    AND (q.part_type IS NULL OR q.part_type = p.part_type)),
judged AS (
  SELECT *, q_make IS NOT NULL OR q_model IS NOT NULL OR q_chassis_code IS NOT NULL AS given,
    (q_make IS NOT NULL OR q_model IS NOT NULL OR q_chassis_code IS NOT NULL) AND EXISTS (
      SELECT 1 FROM spec s WHERE s.sku = pair.sku
        AND (q_make IS NULL OR s.make = q_make) AND (q_model IS NULL OR s.model = q_model)
        AND (q_chassis_code IS NULL OR s.chassis = q_chassis_code)) AS in_catalog,
    coalesce(contains(t, q_chassis_code), false) AS in_title
  FROM pair)"""
_SEARCH = with_domain("search_request product product_oem fitment", "," + _KEYED)


@query(
    "product_search",
    _SEARCH
    + """
    SELECT query_id, sku, array_to_string(list_filter([
      CASE WHEN q_sku IS NOT NULL THEN 'sku' END, CASE WHEN q_oem IS NOT NULL THEN 'oem_number' END,
      CASE WHEN in_catalog THEN 'catalog_applicability' END,
      CASE WHEN in_title THEN 'title_mention' END], lambda x: x IS NOT NULL), '|') AS match_basis
    FROM judged WHERE NOT given OR in_catalog OR in_title""",
)
def product_search(d: Domain) -> DataFrame:
    """D02."""
    hits = inv.search_products(
        d["search_request"], d["product"], d["product_oem"], d["fitment"]
    )
    return hits.withColumn("match_basis", F.array_join("match_basis", "|"))


@query(
    "search_basis",
    with_domain(
        "vehicle product fitment",
        """, spec AS (SELECT DISTINCT lower(regexp_replace(coalesce(chassis_code, ''),
               '[^A-Za-z0-9]+', '', 'g')) AS c, CAST(NULL AS STRING) AS make FROM vehicle
             WHERE chassis_code IS NOT NULL)
        SELECT c AS chassis_key, count(*) AS hits, min(sku) AS first_sku FROM (
          SELECT DISTINCT spec.c, f.sku FROM spec JOIN fitment f
            ON lower(regexp_replace(f.chassis_code, '[^A-Za-z0-9]+', '', 'g')) = spec.c)
        GROUP BY c""",
    ),
)
def search_basis(d: Domain) -> DataFrame:
    """Applicability hits per distinct chassis code; vehicles sharing a code share its hits."""
    wanted = (
        d["vehicle"].where("chassis_code IS NOT NULL")
        .select(F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("oem_number"),
                F.lit(None).cast("string").alias("make"), F.lit(None).cast("string").alias("model"),
                "chassis_code", F.lit(None).cast("string").alias("part_type"))
        .distinct()
        .withColumn("query_id", F.col("chassis_code"))
    )
    hits = inv.search_products(wanted, d["product"], d["product_oem"], d["fitment"])
    return (
        hits.where(F.array_contains("match_basis", "catalog_applicability"))
        .groupBy(F.regexp_replace(F.lower("query_id"), "[^a-z0-9]+", "").alias("chassis_key"))
        .agg(F.count(F.lit(1)).alias("hits"), F.min("sku").alias("first_sku"))
    )


@query(
    "freshness",
    with_domain(
        "stock_line",
        f"""SELECT location, count(*) FILTER (fetched_at > {AS_OF}) AS from_future,
          count(*) FILTER (fetched_at BETWEEN {AS_OF} - {MAX_AGE} AND {AS_OF}) AS fresh,
          count(*) FILTER (fetched_at < {AS_OF} - {MAX_AGE}) AS too_old
        FROM stock_line GROUP BY location""",
    ),
)
def freshness(d: Domain) -> DataFrame:
    """D04."""
    at = F.col("fetched_at")
    fresh = inv.is_fresh(at, _as_of(), MAX_AGE)
    return d["stock_line"].groupBy("location").agg(
        F.count_if(at > _as_of()).alias("from_future"),
        F.count_if(fresh).alias("fresh"),
        F.count_if(~fresh & (at <= _as_of())).alias("too_old"),
    )


def _read_oracle(at: str, absent: str) -> str:
    return f"""CASE WHEN health = 'down' THEN 'unavailable' WHEN p.sku IS NULL OR {at} IS NULL
        THEN 'not_found' WHEN {at} BETWEEN {AS_OF} - {MAX_AGE} AND {AS_OF} THEN 'fresh'
        ELSE 'stale' END AS read_status,
      CASE WHEN health = 'down' THEN 'connection_down' WHEN p.sku IS NULL THEN 'unknown_sku'
        WHEN {at} IS NULL THEN '{absent}' END AS why"""


_STOCK = f"""
totals AS (SELECT sku, sum(available_qty) AS qty, min(fetched_at) AS got FROM stock_line
           GROUP BY sku),
reads AS (
  SELECT q.request_id, upper(trim(q.sku)) AS sku_key, q.health,
    CASE WHEN p.sku IS NULL THEN NULL ELSE coalesce(t.got, {AS_OF}) END AS got, t.qty, p.sku
  FROM sku_request q LEFT JOIN product p ON upper(p.sku) = upper(trim(q.sku))
  LEFT JOIN totals t ON t.sku = p.sku),
judged AS (SELECT request_id, sku_key, health, qty, got, {_read_oracle('got', 'no_stock')}
           FROM reads p),
gated AS (
  SELECT *, CASE WHEN health = 'down' THEN 'inventory_down:' || why
      WHEN read_status <> 'fresh' THEN 'read_' || read_status || ':' || coalesce(why, 'unknown')
      END AS blocked FROM judged)"""
_GATED = with_domain("sku_request product stock_line", "," + _STOCK)


@query(
    "availability_claim",
    _GATED
    + f"""
    SELECT request_id, sku_key, read_status,
      CASE WHEN blocked IS NOT NULL THEN 'unknown' WHEN coalesce(qty, 0) > 0 THEN 'available'
           ELSE 'not_available' END AS status,
      CAST(CASE WHEN blocked IS NULL THEN coalesce(qty, 0) ELSE -1 END AS BIGINT) AS sellable_qty,
      CASE WHEN blocked IS NOT NULL THEN blocked WHEN coalesce(qty, 0) <= 0
           THEN 'no_sellable_stock' ELSE '' END AS reason,
      CASE WHEN blocked IS NULL THEN {DUCK.secs('got')} ELSE -1 END AS as_of_s FROM gated""",
)
def availability_claim(d: Domain) -> DataFrame:
    """D05 + D06."""
    claims = inv.availability_claims(
        d["sku_request"], d["product"], d["stock_line"], _as_of(), MAX_AGE
    )
    return claims.select(
        "request_id", "sku_key", "read_status", "status",
        F.coalesce("sellable_qty", F.lit(-1)).alias("sellable_qty"),
        F.coalesce("reason", F.lit("")).alias("reason"), _s("as_of"),
    )


@query("claim_gate", _GATED + """
    SELECT health, read_status, coalesce(blocked, 'pass') AS gate, count(*) AS requests
    FROM gated GROUP BY ALL""")
def claim_gate(d: Domain) -> DataFrame:
    """Why claims are refused, by health and read status."""
    claims = inv.availability_claims(
        d["sku_request"], d["product"], d["stock_line"], _as_of(), MAX_AGE
    ).join(d["sku_request"].select("request_id", "health"), "request_id")
    return claims.groupBy(
        "health", "read_status",
        F.when(F.col("status") == "unknown", F.col("reason")).otherwise("pass").alias("gate"),
    ).agg(F.count(F.lit(1)).alias("requests"))


_PRICE = with_domain(
    "sku_request product price",
    f""", reads AS (
      SELECT q.request_id, upper(trim(q.sku)) AS sku_key, q.health, c.fetched_at AS got,
        c.amount_minor, c.currency, p.sku
      FROM sku_request q LEFT JOIN product p ON upper(p.sku) = upper(trim(q.sku))
      LEFT JOIN price c ON c.sku = p.sku),
    judged AS (SELECT p.*, {_read_oracle('got', 'no_price')} FROM reads p),
    claims AS (SELECT *, CASE WHEN health = 'down' THEN 'inventory_down:' || why
        WHEN read_status <> 'fresh' THEN 'read_' || read_status || ':' || coalesce(why, 'unknown')
        END AS blocked FROM judged)""",
)


@query(
    "price_claim",
    _PRICE
    + f"""
    SELECT request_id, sku_key, CASE WHEN blocked IS NULL THEN 'exact' ELSE 'unknown' END AS status,
      CASE WHEN blocked IS NULL THEN amount_minor ELSE -1 END AS amount_minor,
      CASE WHEN blocked IS NULL THEN currency ELSE '' END AS currency,
      coalesce(blocked, '') AS reason,
      CASE WHEN blocked IS NULL THEN {DUCK.secs('got')} ELSE -1 END AS as_of_s FROM claims""",
)
def price_claim(d: Domain) -> DataFrame:
    """D08."""
    claims = inv.price_claims(d["sku_request"], d["product"], d["price"], _as_of(), MAX_AGE)
    return claims.select(
        "request_id", "sku_key", "status",
        F.coalesce("amount_minor", F.lit(-1)).alias("amount_minor"),
        F.coalesce("currency", F.lit("")).alias("currency"),
        F.coalesce("reason", F.lit("")).alias("reason"), _s("as_of"),
    )


@query(
    "item_snapshot",
    with_domain(
        "sku_request product stock_line price",
        f""", t AS (SELECT sku, count(*) AS stock_lines, sum(physical_qty) AS physical_qty,
             sum(available_qty) AS available_qty, min(stock_ref) AS first_stock_ref,
             min(fetched_at) AS stock_at FROM stock_line GROUP BY sku),
        reads AS (
          SELECT q.request_id, upper(trim(q.sku)) AS sku_key, q.health, p.sku, p.title, t.* EXCLUDE
            (sku), c.amount_minor, CASE WHEN p.sku IS NOT NULL
              THEN coalesce(least(t.stock_at, c.fetched_at), {AS_OF}) END AS got
          FROM sku_request q LEFT JOIN product p ON upper(p.sku) = upper(trim(q.sku))
          LEFT JOIN t ON t.sku = p.sku LEFT JOIN price c ON c.sku = p.sku),
        judged AS (SELECT p.*, {_read_oracle('got', 'no_item')} FROM reads p)
        SELECT request_id, read_status, coalesce(why, '') AS reason, coalesce(title, '') AS title,
          coalesce(stock_lines, 0) AS stock_lines,
          CAST(coalesce(physical_qty, 0) AS BIGINT) AS physical_qty,
          CAST(coalesce(available_qty, 0) AS BIGINT) AS available_qty,
          coalesce(first_stock_ref, '') AS first_stock_ref,
          coalesce(amount_minor, -1) AS amount_minor FROM judged""",
    ),
)
def item_snapshot(d: Domain) -> DataFrame:
    """D07."""
    items = inv.item_snapshots(
        d["sku_request"], d["product"], d["stock_line"], d["price"], _as_of(), MAX_AGE
    )
    return items.select(
        "request_id", "read_status", F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("title", F.lit("")).alias("title"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stock_lines", "physical_qty", "available_qty")],
        F.coalesce("first_stock_ref", F.lit("")).alias("first_stock_ref"),
        F.coalesce("amount_minor", F.lit(-1)).alias("amount_minor"),
    )


@query(
    "stock_photos",
    with_domain(
        "stock_line photo",
        """SELECT s.sku, s.stock_ref, p.sort_order, p.photo_key FROM photo p
           JOIN stock_line s ON s.stock_ref = p.stock_ref""",
    ),
)
def stock_photos(d: Domain) -> DataFrame:
    """D09."""
    return inv.stock_photos(d["stock_line"], d["photo"]).select(
        "sku", "stock_ref", "sort_order", "photo_key"
    )


@query("read_status", _PRICE + """
    SELECT read_status, coalesce(why, '') AS reason, count(*) AS requests FROM judged GROUP BY ALL""")
def read_status(d: Domain) -> DataFrame:
    """D10 over price reads."""
    facts = d["product"].select("sku", F.lit(True).alias("known")).join(d["price"], "sku", "left")
    reads = inv.read_status(d["sku_request"], facts, _as_of(), MAX_AGE, "no_price")
    return reads.groupBy("read_status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("requests")
    )


@query(
    "source_health",
    with_domain(
        "fetch_log",
        f""", seen AS (SELECT * FROM fetch_log WHERE ts <= TIMESTAMP '2024-01-25 00:00:00'),
        r AS (SELECT source, arg_max(coalesce(error, ''), (ts, fetch_id)) AS e,
              arg_max(duration_s, (ts, fetch_id)) AS dur,
              max(ts) FILTER (error IS NULL) AS ok FROM seen GROUP BY source)
        SELECT source, CASE WHEN e <> '' THEN 'down' WHEN ok IS NULL
            OR ok < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL '2' HOUR OR dur > 50
            THEN 'degraded' ELSE 'up' END AS status,
          CASE WHEN e <> '' THEN e WHEN ok IS NULL OR ok < TIMESTAMP '2024-01-25 00:00:00'
            - INTERVAL '2' HOUR THEN 'stale_data' WHEN dur > 50 THEN 'slow' ELSE '' END AS reason,
          coalesce({DUCK.secs('ok')}, -1) AS as_of_s FROM r""",
    ),
)
def source_health(d: Domain) -> DataFrame:
    """D11."""
    at = F.expr("TIMESTAMP '2024-01-25 00:00:00'")
    health = inv.source_health(d["fetch_log"], at, "INTERVAL '2' HOUR", 50.0)
    return health.select(
        "source", "status", F.coalesce("reason", F.lit("")).alias("reason"), _s("last_success_at")
    )


@query(
    "offer_total",
    _PRICE
    + """, lines AS (SELECT o_orderkey AS offer_id, CASE WHEN l_partkey % 10 = 0 THEN 'SYN-'
        ELSE 'P-' END || CAST(l_partkey AS STRING) AS k, CAST(l_quantity AS BIGINT) AS qty
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey ),
    r AS (SELECT offer_id, count(*) AS n_lines,
        count(*) FILTER (blocked IS NOT NULL OR request_id IS NULL) AS n_unknown,
        sum(qty * CASE WHEN blocked IS NULL THEN amount_minor END) AS total,
        min(CASE WHEN blocked IS NULL THEN currency END) AS c1,
        max(CASE WHEN blocked IS NULL THEN currency END) AS c2
      FROM lines LEFT JOIN claims ON sku_key = k GROUP BY offer_id)
    SELECT offer_id, n_lines, n_unknown,
      CAST(CASE WHEN n_unknown = 0 AND c1 = c2 THEN total ELSE -1 END AS BIGINT) AS total_minor,
      CASE WHEN n_unknown = 0 AND c1 = c2 THEN c1 ELSE '' END AS currency FROM r""",
)
def offer_total(d: Domain) -> DataFrame:
    """D12."""
    claims = inv.price_claims(d["sku_request"], d["product"], d["price"], _as_of(), MAX_AGE)
    lines = d["lineitem"].join(d["orders"], F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("offer_id"),
        F.expr("CASE WHEN l_partkey % 10 = 0 THEN 'SYN-' ELSE 'P-' END "
               "|| CAST(l_partkey AS STRING)").alias("sku"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )
    totals = inv.offer_totals(lines, claims)
    return totals.select(
        "offer_id", "n_lines", "n_unknown",
        F.coalesce("total_minor", F.lit(-1)).alias("total_minor"),
        F.coalesce("currency", F.lit("")).alias("currency"),
    )
