"""Queries of area C (catalogue, fitment, sets)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.operators import fitment as fit
from partsight.operators import inventory as inv
from partsight.operators import sets as st
from partsight.plans.registry import query
from partsight.rules import catalog as R
from partsight.sources import catalog_store as store
from partsight.sources.domain import DUCK, Domain, with_domain

MODE = "test"
AS_OF = "TIMESTAMP '2000-06-01 00:00:00'"
MAX_AGE = "INTERVAL '700' DAY"


def _matched(d: Domain) -> DataFrame:
    records = fit.collapse_records(fit.assess_evidence(d["fitment"], MODE))
    return fit.match_records(d["candidate"], d["vehicle"], records)


def _verdicts(d: Domain) -> DataFrame:
    return fit.product_verdicts(_matched(d), d["product"])


# -- oracle building blocks ----------------------------------------------------------------------

_K = "lower(regexp_replace({}, '[^A-Za-z0-9]+', '', 'g'))"


def _k(x: str) -> str:
    return _K.format(x)


def _tri(given: str, ok: str) -> str:
    return f"CASE WHEN {given} IS NULL THEN 'unknown' WHEN {ok} THEN 'match' ELSE 'mismatch' END"


def _name_check(a: str) -> str:
    tri = _tri(f"v.{a}", f"{_k('r.' + a)} = {_k('v.' + a)}")
    return f"CASE WHEN v.chassis_code IS NULL OR v.{a} IS NOT NULL THEN {tri} END"


_ASSESSED = """
assessed AS (
  SELECT *, data_origin = 'synthetic' AS synthetic, CASE
    WHEN evidence_kind IS NULL THEN 'evidence_missing'
    WHEN evidence_kind IN ('visual_similarity', 'customer_statement', 'llm_output',
                           'listing_title', 'body_code_only') THEN 'evidence_kind_not_evidence'
    WHEN trim(coalesce(evidence_ref, '')) = '' THEN 'evidence_ref_missing'
    WHEN evidence_verified_at IS NULL THEN 'evidence_verified_at_missing'
    WHEN evidence_kind = 'synthetic_fixture' AND data_origin <> 'synthetic'
         THEN 'synthetic_evidence_on_real_record'
    WHEN evidence_kind = 'synthetic_fixture' THEN NULL
    WHEN data_origin = 'synthetic' THEN 'synthetic_record_claims_real_evidence' END AS rejection
  FROM fitment)"""

_CHECKED = f"""
checked AS (
  SELECT c.vehicle_id, c.sku, r.record_id, r.status, r.rejection IS NULL AS accepted, r.rejection,
    r.synthetic,
    {_name_check('make')} AS make, {_name_check('model')} AS model,
    {_tri('v.chassis_code', _k('r.chassis_code') + ' = ' + _k('v.chassis_code'))} AS chassis_code,
    CASE WHEN r.year_from IS NULL AND r.year_to IS NULL THEN NULL
         WHEN v.year IS NOT NULL THEN CASE WHEN v.year BETWEEN coalesce(r.year_from, -9999)
              AND coalesce(r.year_to, 99999) THEN 'match' ELSE 'mismatch' END
         WHEN r.facelift IS NULL THEN 'unknown' END AS year,
    CASE WHEN r.facelift IS NOT NULL THEN {_tri('v.facelift', 'v.facelift = r.facelift')} END
         AS facelift,
    CASE WHEN r.trim_line IS NOT NULL THEN {_tri('v.trim_line',
        'list_contains(list_transform(r.trim_line, lambda x: ' + _k('x') + '), '
        + _k('v.trim_line') + ')')} END AS trim_line,
    CASE WHEN r.parktronic_sensors IS NOT NULL THEN {_tri('v.parktronic_sensors',
        'list_contains(r.parktronic_sensors, v.parktronic_sensors)')} END AS parktronic_sensors,
    CASE WHEN r.headlamp_washer IS NOT NULL THEN {_tri('v.headlamp_washer',
        'list_contains(r.headlamp_washer, v.headlamp_washer)')} END AS headlamp_washer,
    CASE WHEN r.front_camera IS NOT NULL THEN {_tri('v.front_camera',
        'list_contains(r.front_camera, v.front_camera)')} END AS front_camera
  FROM candidate c JOIN vehicle v ON v.vehicle_id = c.vehicle_id
  JOIN assessed r ON r.sku = c.sku),
outcomes AS (
  SELECT *, CASE WHEN list_contains([{', '.join(R.ATTRIBUTE_ORDER)}], 'mismatch') THEN 'mismatch'
    WHEN list_contains([{', '.join(R.ATTRIBUTE_ORDER)}], 'unknown') THEN 'partial'
    ELSE 'full' END AS outcome,
    list_contains([year, facelift, trim_line, parktronic_sensors, headlamp_washer, front_camera],
                  'match') AS discriminating
  FROM checked)"""

_MISS = ", ".join(
    f"bool_or(outcome = 'partial' AND accepted AND status <> 'needs_verification' "
    f"AND coalesce({a}, '') = 'unknown') AS miss_{a}"
    for a in R.ATTRIBUTE_ORDER
)
_MISS_LIST = "[" + ", ".join(f"CASE WHEN miss_{a} THEN '{a}' END" for a in R.ATTRIBUTE_ORDER) + "]"
_VERDICT = f"""
flags AS (
  SELECT vehicle_id, sku, bool_or(outcome <> 'mismatch') AS applicable,
    bool_or(status = 'verified' AND accepted) AS excluding,
    bool_or(outcome = 'full' AND status = 'verified' AND accepted AND discriminating) AS ver,
    bool_or(outcome = 'full' AND status = 'incompatible' AND accepted) AS inc,
    min(CASE WHEN outcome = 'partial' AND accepted AND status <> 'needs_verification'
        THEN record_id END) AS r0,
    min(CASE WHEN outcome <> 'mismatch' AND status = 'needs_verification' THEN record_id END) AS r1,
    min(CASE WHEN outcome <> 'mismatch' AND status <> 'needs_verification' AND NOT accepted
        THEN record_id END) AS r2,
    min(CASE WHEN outcome = 'full' AND status = 'verified' AND accepted THEN record_id END) AS r3,
    {_MISS}, bool_or(synthetic) AS syn
  FROM outcomes GROUP BY vehicle_id, sku),
judged AS (
  SELECT c.vehicle_id, c.sku, f.*EXCLUDE (vehicle_id, sku),
    CASE WHEN f.sku IS NULL THEN 'no_fitment_record'
         WHEN NOT applicable AND excluding THEN 'outside_verified_range'
         WHEN NOT applicable THEN 'no_record_matches_vehicle'
         WHEN ver AND inc THEN 'conflicting_records' WHEN ver THEN 'verified_record_matches'
         WHEN inc THEN 'explicit_incompatible_record' END AS single,
    p.data_origin = 'synthetic' AS syn_product
  FROM candidate c LEFT JOIN flags f ON f.vehicle_id = c.vehicle_id AND f.sku = c.sku
  LEFT JOIN product p ON p.sku = c.sku),
verdict AS (
  SELECT vehicle_id, sku,
    CASE single WHEN 'verified_record_matches' THEN 'verified'
         WHEN 'explicit_incompatible_record' THEN 'incompatible' ELSE 'needs_verification' END
      AS status,
    CASE WHEN single IS NOT NULL THEN [single] ELSE list_transform(list_sort(list_filter([
      {{'at': r0, 'rank': 0, 'name': 'missing_vehicle_attributes'}},
      {{'at': r1, 'rank': 1, 'name': 'record_not_verified'}},
      {{'at': r2, 'rank': 2, 'name': 'evidence_not_accepted'}},
      {{'at': r3, 'rank': 3, 'name': 'body_code_only'}}], lambda s: s.at IS NOT NULL)),
      lambda s: s.name) END AS reasons,
    CASE WHEN single IS NOT NULL THEN [] ELSE
      list_filter({_MISS_LIST}, lambda a: a IS NOT NULL) END AS missing,
    coalesce(syn, false) OR syn_product AS synthetic
  FROM judged)"""

_BASE = "candidate vehicle fitment product"
FITMENT_CTES = with_domain(_BASE, "," + _ASSESSED + "," + _CHECKED)
VERDICT_CTES = FITMENT_CTES + "," + _VERDICT


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so both engines compare the same values."""
    return df.withColumns(
        {
            c: F.array_join(c, "|")
            for c in ("reasons", "missing_attributes")
            if c in df.columns
        }
    )


_FLAT = """array_to_string(reasons, '|') AS reasons,
  array_to_string(missing, '|') AS missing_attributes"""


# -- queries -------------------------------------------------------------------------------------


@query(
    "fitment_match",
    FITMENT_CTES
    + f"""
    SELECT vehicle_id, sku, record_id, outcome,
      {', '.join(f"coalesce({a}, '-') AS check_{a}" for a in R.ATTRIBUTE_ORDER)} FROM outcomes""",
)
def fitment_match(d: Domain) -> DataFrame:
    """C04-C06 on single records (not collapsed): every check and the outcome."""
    records = fit.assess_evidence(d["fitment"], MODE)
    m = fit.match_records(d["candidate"], d["vehicle"], records).where("record_id IS NOT NULL")
    return m.select(
        "vehicle_id", "sku", "record_id", "outcome",
        *[F.coalesce(f"check_{a}", F.lit("-")).alias(f"check_{a}") for a in R.ATTRIBUTE_ORDER],
    )


@query(
    "fitment_outcome",
    FITMENT_CTES
    + """
    SELECT vehicle_id, count(*) FILTER (outcome = 'full') AS full_matches,
      count(*) FILTER (outcome = 'partial') AS partial_matches,
      count(*) FILTER (outcome = 'mismatch') AS mismatches FROM outcomes GROUP BY vehicle_id""",
)
def fitment_outcome(d: Domain) -> DataFrame:
    """Outcomes per vehicle."""
    records = fit.assess_evidence(d["fitment"], MODE)
    m = fit.match_records(d["candidate"], d["vehicle"], records).where("record_id IS NOT NULL")
    return m.groupBy("vehicle_id").agg(
        F.count_if(F.col("outcome") == "full").alias("full_matches"),
        F.count_if(F.col("outcome") == "partial").alias("partial_matches"),
        F.count_if(F.col("outcome") == "mismatch").alias("mismatches"),
    )


@query(
    "evidence_policy",
    with_domain("fitment", "," + _ASSESSED)
    + """
    SELECT record_id, rejection IS NULL AS accepted, coalesce(rejection, '') AS rejection,
           synthetic FROM assessed""",
)
def evidence_policy(d: Domain) -> DataFrame:
    """C07."""
    return fit.assess_evidence(d["fitment"], MODE).select(
        "record_id", "accepted", F.coalesce("rejection", F.lit("")).alias("rejection"), "synthetic"
    )


_VERDICT_OUT = f"""
    SELECT vehicle_id, sku, status, {_FLAT}, synthetic,
      list_contains(reasons, 'outside_verified_range') AS owner_only,
      len(missing) > 0 AS customer_can_resolve FROM verdict"""


@query("fitment_verdict", VERDICT_CTES + _VERDICT_OUT)
def fitment_verdict(d: Domain) -> DataFrame:
    """C08 + C10: the flagship."""
    return _flat(_verdicts(d))


@query("fitment_evidence")
def fitment_evidence(d: Domain) -> DataFrame:
    """The records behind each verdict."""
    matched = fit.match_records(
        fit.judged_candidates(_verdicts(d)), d["vehicle"], fit.assess_evidence(d["fitment"], MODE)
    )
    return fit.verdict_evidence(matched)


@query(
    "fitment_batch",
    VERDICT_CTES
    + """
    SELECT vehicle_id, count(*) AS candidates, count(*) FILTER (status = 'verified') AS verified,
      count(*) FILTER (status = 'incompatible') AS incompatible,
      count(*) FILTER (status = 'needs_verification') AS undecided,
      count(*) FILTER (list_contains(reasons, 'outside_verified_range')) AS owner_only
    FROM verdict GROUP BY vehicle_id""",
)
def fitment_batch(d: Domain) -> DataFrame:
    """C11: all candidates of every vehicle at once, summed up per vehicle."""
    return _verdicts(d).groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "incompatible").alias("incompatible"),
        F.count_if(F.col("status") == "needs_verification").alias("undecided"),
        F.count_if("owner_only").alias("owner_only"),
    )


_SET_MISS = ", ".join(f"bool_or(coalesce(list_contains(v.missing, '{a}'), false)) AS miss_{a}"
                      for a in R.ATTRIBUTE_ORDER)


@query(
    "fitment_set",
    VERDICT_CTES
    + ", "
    + with_domain("bundle set_component", "")[len("WITH "):]
    + f""",
    rolled AS (
      SELECT b.vehicle_id, b.set_sku, bool_or(coalesce(v.status, '') = 'incompatible') AS inc,
        bool_and(coalesce(v.status, '') = 'verified') AS ver,
        bool_or(coalesce(list_contains(v.reasons, 'outside_verified_range'), false)) AS outside,
        bool_or(coalesce(v.synthetic, false)) AS syn, {_SET_MISS}
      FROM bundle b JOIN set_component s ON s.set_sku = b.set_sku
      LEFT JOIN verdict v ON v.vehicle_id = b.vehicle_id AND v.sku = s.component_sku
      WHERE NOT s.optional AND (b.set_kind <> 'stocked_set' OR s.present)
      GROUP BY b.vehicle_id, b.set_sku)
    SELECT b.vehicle_id, b.set_sku,
      CASE WHEN r.set_sku IS NULL THEN 'needs_verification' WHEN inc THEN 'incompatible'
           WHEN ver THEN 'verified' ELSE 'needs_verification' END AS status,
      CASE WHEN r.set_sku IS NULL THEN 'no_fitment_record' WHEN inc THEN 'component_incompatible'
           WHEN ver THEN 'all_components_verified'
           WHEN outside THEN 'component_needs_verification|outside_verified_range'
           ELSE 'component_needs_verification' END AS reasons,
      CASE WHEN r.set_sku IS NULL OR inc OR ver THEN '' ELSE
        array_to_string(list_filter({_MISS_LIST}, lambda a: a IS NOT NULL), '|') END
        AS missing_attributes,
      b.data_origin = 'synthetic' OR coalesce(syn, false) AS synthetic
    FROM bundle b LEFT JOIN rolled r ON r.vehicle_id = b.vehicle_id AND r.set_sku = b.set_sku""",
)
def fitment_set(d: Domain) -> DataFrame:
    """C12."""
    return _flat(fit.set_verdicts(d["bundle"], d["set_component"], _verdicts(d)))


@query(
    "fitment_questions",
    VERDICT_CTES
    + f"""
    SELECT vehicle_id, attribute, candidates, CAST(row_number() OVER (PARTITION BY vehicle_id
      ORDER BY candidates DESC, list_position({list(R.ATTRIBUTE_ORDER)}, attribute)) AS INTEGER)
      AS position
    FROM (SELECT vehicle_id, attribute, count(*) AS candidates
          FROM (SELECT vehicle_id, unnest(missing) AS attribute FROM verdict
                WHERE status = 'needs_verification') GROUP BY ALL)""",
)
def fitment_questions(d: Domain) -> DataFrame:
    """C13."""
    return fit.rank_questions(_verdicts(d))


_CLAIM_CTE = f"""
claim AS (
  SELECT p.sku, CASE WHEN NOT fresh THEN 'unknown' WHEN qty > 0 THEN 'available'
         ELSE 'not_available' END AS status,
         CASE WHEN fresh THEN greatest(qty, 0) END AS sellable_qty,
         CASE WHEN NOT fresh THEN 'read_stale:unknown' WHEN qty <= 0 THEN 'no_sellable_stock' END
           AS reason,
         CASE WHEN fresh THEN fetched_at END AS as_of
  FROM (SELECT p.sku, coalesce(sum(available_qty), 0) AS qty,
               coalesce(min(fetched_at), {AS_OF}) AS fetched_at,
               coalesce(min(fetched_at), {AS_OF}) BETWEEN {AS_OF} - {MAX_AGE} AND {AS_OF} AS fresh
        FROM product p LEFT JOIN stock_line s ON s.sku = p.sku GROUP BY p.sku) p)"""
_SETS = with_domain("product stock_line bundle set_component", "," + _CLAIM_CTE)


def _claims(d: Domain) -> DataFrame:
    """Availability claims of all products, as the set roll-up takes them."""
    requests = d["product"].select(
        F.col("product_id").alias("request_id"), "sku", F.lit("up").alias("health")
    )
    return inv.availability_claims(
        requests, d["product"], d["stock_line"], F.expr(AS_OF), MAX_AGE
    ).withColumnRenamed("sku_key", "sku")


def _set_claims(d: Domain) -> DataFrame:
    """Component claims plus the kits' own: every second kit carries the claim of one product."""
    kits = d["bundle"].where("set_kind = 'stocked_set'").select(
        "set_sku", F.expr("'P-' || CAST(vehicle_id AS STRING)").alias("sku")
    )
    claims = _claims(d)
    own = kits.join(claims, "sku").drop("sku").withColumnRenamed("set_sku", "sku")
    return claims.unionByName(own.select(*claims.columns))


def _set_out(df: DataFrame) -> DataFrame:
    return df.select(
        "set_sku", "status", F.coalesce("complete_sets", F.lit(-1)).alias("complete_sets"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce(F.unix_seconds("as_of"), F.lit(-1)).alias("as_of_s"),
        "n_missing", "n_unknown",
        F.coalesce(F.col("complete").cast("string"), F.lit("unknown")).alias("complete"),
    )


@query(
    "set_availability",
    _SETS
    + f""",
    per AS (
      SELECT b.set_sku, count(s.component_sku) FILTER (NOT s.optional) AS req,
        count(*) FILTER (NOT s.optional AND coalesce(c.status, 'unknown') = 'unknown') AS unk,
        count(*) FILTER (NOT s.optional AND c.status <> 'unknown'
                         AND c.sellable_qty // s.qty = 0) AS mis,
        min(c.sellable_qty // s.qty) FILTER (NOT s.optional) AS units,
        min(c.as_of) FILTER (NOT s.optional) AS as_of
      FROM bundle b LEFT JOIN set_component s ON s.set_sku = b.set_sku
      LEFT JOIN claim c ON c.sku = s.component_sku
      WHERE b.set_kind = 'virtual_set' GROUP BY b.set_sku),
    st AS (SELECT *, CASE WHEN req = 0 OR unk > 0 THEN 'unknown' WHEN units > 0 THEN 'available'
                     ELSE 'not_available' END AS status FROM per)
    SELECT set_sku, status,
      CAST(CASE WHEN status = 'unknown' THEN -1 ELSE units END AS BIGINT) AS complete_sets,
      CASE WHEN req = 0 THEN 'set_has_no_components' WHEN unk > 0 THEN 'component_unknown'
           WHEN units = 0 THEN 'missing_components' ELSE '' END AS reason,
      CASE WHEN status = 'unknown' THEN -1 ELSE {DUCK.secs('as_of')} END AS as_of_s,
      CASE WHEN req = 0 THEN 0 ELSE mis END AS n_missing,
      CASE WHEN req = 0 THEN 0 ELSE unk END AS n_unknown,
      CASE WHEN status = 'unknown' THEN 'unknown' WHEN mis = 0 AND status = 'available'
           THEN 'true' ELSE 'false' END AS complete FROM st""",
)
def set_availability(d: Domain) -> DataFrame:
    """C14 + C16."""
    sets = d["bundle"].where("set_kind = 'virtual_set'")
    return _set_out(st.set_availability(sets, d["set_component"], _claims(d)))


@query(
    "set_availability_stocked",
    _SETS
    + f""",
    per AS (
      SELECT b.set_sku, b.vehicle_id,
        count(*) FILTER (NOT s.optional AND NOT s.present) AS mis
      FROM bundle b LEFT JOIN set_component s ON s.set_sku = b.set_sku
      WHERE b.set_kind = 'stocked_set' GROUP BY b.set_sku, b.vehicle_id),
    own AS (SELECT per.*, coalesce(c.status, 'unknown') AS status, c.sellable_qty, c.as_of,
              CASE WHEN c.sku IS NULL THEN 'no_claim' ELSE coalesce(c.reason, '') END AS reason
            FROM per LEFT JOIN claim c ON c.sku = 'P-' || CAST(vehicle_id AS STRING))
    SELECT set_sku, status, CAST(coalesce(sellable_qty, -1) AS BIGINT) AS complete_sets, reason,
      coalesce({DUCK.secs('as_of')}, -1) AS as_of_s, mis AS n_missing,
      CAST(status = 'unknown' AS BIGINT) AS n_unknown,
      CASE WHEN status = 'unknown' THEN 'unknown' WHEN mis = 0 AND status = 'available'
           THEN 'true' ELSE 'false' END AS complete FROM own""",
)
def set_availability_stocked(d: Domain) -> DataFrame:
    """C15 + C16."""
    sets = d["bundle"].where("set_kind = 'stocked_set'")
    return _set_out(st.set_availability(sets, d["set_component"], _set_claims(d)))


@query(
    "set_components",
    _SETS
    + """
    SELECT b.set_sku, s.component_sku, s.qty,
      CAST(CASE WHEN b.set_kind = 'virtual_set' AND coalesce(c.status, 'unknown') <> 'unknown'
           THEN c.sellable_qty // s.qty ELSE -1 END AS BIGINT) AS set_units,
      CASE WHEN s.optional THEN 'ok'
           WHEN b.set_kind = 'stocked_set' THEN CASE WHEN s.present THEN 'ok' ELSE 'missing' END
           WHEN coalesce(c.status, 'unknown') = 'unknown' THEN 'unknown'
           WHEN c.sellable_qty // s.qty = 0 THEN 'missing' ELSE 'ok' END AS state
    FROM bundle b JOIN set_component s ON s.set_sku = b.set_sku
    LEFT JOIN claim c ON c.sku = s.component_sku""",
)
def set_components(d: Domain) -> DataFrame:
    """The component rows behind the set claims."""
    lines = st.set_component_states(d["bundle"], d["set_component"], _claims(d))
    return lines.select(
        "set_sku", "component_sku", "qty",
        F.coalesce("set_units", F.lit(-1)).alias("set_units"), "state",
    )


@query(
    "vehicle_known",
    with_domain(
        "vehicle",
        "SELECT vehicle_id, CAST("
        + " + ".join(f"CAST({a} IS NOT NULL AS INTEGER)" for a in R.ATTRIBUTE_ORDER)
        + """ AS INTEGER) AS n_known, coalesce(chassis_code, '') AS chassis_code,
        coalesce(CAST(facelift AS STRING), '') AS facelift FROM vehicle""",
    ),
)
def vehicle_known(d: Domain) -> DataFrame:
    """C19."""
    return fit.known_attributes(d["vehicle"]).select(
        "vehicle_id", "n_known",
        F.coalesce(F.col("known")["chassis_code"], F.lit("")).alias("chassis_code"),
        F.coalesce(F.col("known")["facelift"], F.lit("")).alias("facelift"),
    )


@query(
    "origin_guard",
    with_domain(
        "fitment",
        """SELECT CASE WHEN data_origin = 'synthetic'
                 OR coalesce(evidence_kind, '') = 'synthetic_fixture'
            THEN 'refused' ELSE 'allowed' END AS decision, status, count(*) AS records
           FROM fitment GROUP BY ALL""",
    ),
)
def origin_guard(d: Domain) -> DataFrame:
    """C18 in production mode."""
    allowed, refused = fit.origin_guard(d["fitment"], "production")
    both = allowed.withColumn("decision", F.lit("allowed")).unionByName(
        refused.withColumn("decision", F.lit("refused"))
    )
    return both.groupBy("decision", "status").agg(F.count(F.lit(1)).alias("records"))


@query(
    "catalog_load",
    with_domain(
        "product product_oem fitment",
        """, o AS (SELECT sku, count(*) AS n_oems, min(oem_number) AS min_oem FROM product_oem
             GROUP BY sku),
        f AS (SELECT sku, count(*) AS n_records, count(DISTINCT chassis_code) AS n_chassis,
              min(year_from) AS first_year, max(year_to) AS last_year FROM fitment GROUP BY sku)
        SELECT p.sku, p.set_kind, coalesce(n_oems, 0) AS n_oems, coalesce(min_oem, '') AS min_oem,
          coalesce(n_records, 0) AS n_records, coalesce(n_chassis, 0) AS n_chassis,
          CAST(coalesce(first_year, -1) AS BIGINT) AS first_year,
          CAST(coalesce(last_year, -1) AS BIGINT) AS last_year
        FROM product p LEFT JOIN o ON o.sku = p.sku LEFT JOIN f ON f.sku = p.sku""",
    ),
)
def catalog_load(d: Domain) -> DataFrame:
    """C02."""
    return store.load_catalog(d["product"], d["product_oem"], d["fitment"])


@query("catalog_write")
def catalog_write(d: Domain) -> DataFrame:
    """C17: write the catalogue tables and read back their row counts."""
    return store.write_catalog(
        d.spark,
        {
            "product": d["product"],
            "product_oem_number": d["product_oem"],
            "fitment": d["fitment"],
            "set_component": d["set_component"],
        },
    )


_DUP = "SELECT '{rule}' AS rule, CAST({key} AS STRING) AS item FROM {frm}"


@query(
    "catalog_dq",
    with_domain(
        "product fitment set_component stock_line photo bundle",
        """SELECT rule, count(*) AS violations, min(item) AS first_item FROM (
          SELECT 'unknown_fitment_sku' AS rule, sku AS item FROM fitment
            WHERE sku NOT IN (SELECT sku FROM product WHERE set_kind <> 'stocked_set')
          UNION ALL SELECT 'unknown_component', component_sku FROM set_component
            WHERE component_sku NOT IN (SELECT sku FROM product WHERE set_kind <> 'stocked_set')
          UNION ALL SELECT 'photo_of_unknown_stock', photo_key FROM photo
            WHERE stock_ref NOT IN (SELECT stock_ref FROM stock_line)
          UNION ALL SELECT 'duplicate_component_qty', set_sku FROM set_component
            GROUP BY set_sku, qty HAVING count(*) > 1
          UNION ALL SELECT 'set_without_components', set_sku FROM bundle
            WHERE set_sku NOT IN (SELECT set_sku FROM set_component)
        ) GROUP BY rule""",
    ),
)
def catalog_dq(d: Domain) -> DataFrame:
    """Reference and duplicate checks of a data set; stocked sets are left out of the product
    side, so unknown references exist."""
    known = d["product"].where("set_kind <> 'stocked_set'")
    checks = [
        store.unknown_references(d["fitment"], "sku", known, "sku", "unknown_fitment_sku"),
        store.unknown_references(
            d["set_component"], "component_sku", known, "sku", "unknown_component"
        ),
        store.unknown_references(
            d["photo"], "stock_ref", d["stock_line"], "stock_ref", "photo_of_unknown_stock",
            item="photo_key",
        ),
        store.duplicate_keys(d["set_component"], ["set_sku", "qty"], "duplicate_component_qty"),
        store.unknown_references(
            d["bundle"], "set_sku", d["set_component"], "set_sku", "set_without_components"
        ),
    ]
    return store.violation_summary(checks)


@query("condition_dq")
def condition_dq(d: Domain) -> DataFrame:
    """Conditions as JSON objects derived from the records, some of them damaged."""
    bad = F.expr(
        "CASE WHEN record_id % 13 = 0 THEN '{\"sunroof\": true}' "
        "WHEN record_id % 17 = 0 THEN '{\"parktronic_sensors\": true}' "
        "WHEN record_id % 19 = 0 THEN '{\"trim_line\": \"\"}' "
        "WHEN record_id % 23 = 0 THEN '[1]' END"
    )
    docs = d["fitment"].withColumn(
        "conditions", F.coalesce(bad, F.to_json(F.struct(*R.CONDITIONS)))
    )
    return (
        fit.condition_violations(docs)
        .groupBy("violation")
        .agg(F.count(F.lit(1)).alias("records"))
    )
