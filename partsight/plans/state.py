"""Queries of area E (messages, jobs, drafts, outbox, rules)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.operators import jobs as jb
from partsight.operators import messages as ms
from partsight.operators import outbox as ob
from partsight.operators import quality as dq
from partsight.plans.registry import query
from partsight.rules import quality as QR
from partsight.sources.domain import DUCK, Domain, with_domain

NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _now():
    return F.expr(NOW)


def _secs(column: str, name: str):
    return F.coalesce(F.unix_seconds(column), F.lit(-1)).alias(name)


_NEW = """
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id
    ORDER BY received_at, source) AS rn FROM inbound_message) WHERE rn = 1),
fresh AS (SELECT * FROM firsts WHERE message_id NOT IN (SELECT message_id FROM stored_message)),
numbered AS (SELECT f.*, coalesce(s.last_seq, 0) + row_number() OVER (
    PARTITION BY f.conversation_id ORDER BY created_at, message_id) AS seq
  FROM fresh f LEFT JOIN (SELECT conversation_id, max(seq) AS last_seq FROM stored_message
    GROUP BY conversation_id) s ON s.conversation_id = f.conversation_id)"""
_MESSAGES = with_domain("inbound_message stored_message", "," + _NEW)


@query("msg_dedup", _MESSAGES + f"""
    SELECT message_id, conversation_id, source, {DUCK.secs('received_at')} AS received_s
    FROM fresh""")
def msg_dedup(d: Domain) -> DataFrame:
    """E01."""
    kept = ms.dedup_messages(d["inbound_message"], d["stored_message"])
    return kept.select("message_id", "conversation_id", "source", _secs("received_at", "received_s"))


def _numbered(d: Domain) -> DataFrame:
    kept = ms.dedup_messages(d["inbound_message"], d["stored_message"])
    return ms.assign_sequence(kept, d["stored_message"])


@query("msg_seq", _MESSAGES + """
    SELECT message_id, conversation_id, author_role, seq FROM numbered""")
def msg_seq(d: Domain) -> DataFrame:
    """E02."""
    return _numbered(d).select("message_id", "conversation_id", "author_role", "seq")


@query("last_inbound", _MESSAGES + """
    SELECT conversation_id, coalesce(max(seq) FILTER (author_role = 'customer'), -1)
      AS last_inbound_seq, max(seq) AS last_seq FROM numbered GROUP BY conversation_id""")
def last_inbound(d: Domain) -> DataFrame:
    """E03."""
    return ms.last_inbound(_numbered(d)).fillna(-1)


_FENCED = with_domain("draft conversation_state", """, fenced AS (
    SELECT d.*, c.last_processed_seq, CASE WHEN c.conversation_id IS NULL THEN 'no_conversation'
      WHEN d.based_on_seq = c.last_inbound_seq THEN 'valid' ELSE 'stale' END AS fence
    FROM draft d LEFT JOIN conversation_state c ON c.conversation_id = d.conversation_id)""")


@query("draft_fresh", _FENCED + " SELECT draft_id, conversation_id, based_on_seq, fence FROM fenced")
def draft_fresh(d: Domain) -> DataFrame:
    """E04."""
    return ms.fence_drafts(d["draft"], d["conversation_state"]).select(
        "draft_id", "conversation_id", "based_on_seq", "fence"
    )


@query("draft_open_dedup", _FENCED + """
    , open AS (SELECT conversation_id, based_on_seq, min(draft_id) AS open_id FROM draft
      WHERE status IN ('proposed', 'approved') GROUP BY ALL),
    want AS (SELECT conversation_id, based_on_seq, min(draft_id) AS first_id, count(*) AS requests,
      max(last_processed_seq) AS before FROM fenced WHERE fence = 'valid' GROUP BY ALL)
    SELECT w.conversation_id, w.based_on_seq, coalesce(open_id, first_id) AS draft_id,
      open_id IS NOT NULL AS replayed, requests,
      greatest(before, w.based_on_seq) AS last_processed_seq
    FROM want w LEFT JOIN open o ON o.conversation_id = w.conversation_id
      AND o.based_on_seq = w.based_on_seq""")
def draft_open_dedup(d: Domain) -> DataFrame:
    """E05."""
    valid = ms.fence_drafts(d["draft"], d["conversation_state"]).where("fence = 'valid'")
    return ms.open_drafts(valid, d["draft"])


@query("due_topk", with_domain("job", f"""
    SELECT kind, job_id, CAST(position AS INTEGER) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY kind ORDER BY run_after, job_id) AS position
      FROM job WHERE status = 'queued' AND run_after <= {NOW}) WHERE position <= 20
    UNION ALL SELECT 'any', job_id, 0 FROM (SELECT * FROM job WHERE status = 'queued'
      AND run_after <= {NOW} ORDER BY run_after, job_id LIMIT 25)"""))
def due_topk(d: Domain) -> DataFrame:
    """The next 20 per kind and the next 25 overall (a top-k report)."""
    per_kind = jb.due_jobs_per_kind(d["job"], _now(), 20).select("kind", "job_id", "position")
    overall = jb.due_jobs(d["job"], _now(), 25).select(
        F.lit("any").alias("kind"), "job_id", F.lit(0).alias("position")
    )
    return per_kind.unionByName(overall)


@query("enqueue_merge", with_domain("queued_job enqueue_request", f""",
    w AS (SELECT kind, dedup_key, min(run_after) AS want, count(*) AS requests
          FROM enqueue_request GROUP BY kind, dedup_key),
    j AS (SELECT coalesce(q.kind, w.kind) AS kind, coalesce(q.dedup_key, w.dedup_key) AS dedup_key,
            q.job_id, q.run_after AS have, q.last_error_code, w.want, w.requests
          FROM queued_job q FULL JOIN w ON w.kind = q.kind AND w.dedup_key = q.dedup_key),
    a AS (SELECT *, CASE WHEN job_id IS NULL THEN 'inserted' WHEN requests IS NULL THEN 'unchanged'
            WHEN last_error_code IS NOT NULL THEN 'in_backoff' WHEN want < have
            THEN 'pulled_forward' ELSE 'unchanged' END AS action FROM j)
    SELECT kind, dedup_key, coalesce(job_id, -1) AS job_id, action, coalesce(requests, 0)
      AS requests, {DUCK.secs("CASE WHEN action = 'in_backoff' THEN have ELSE least(have, want) END")}
      AS run_after_s FROM a"""))
def enqueue_merge(d: Domain) -> DataFrame:
    """E07."""
    merged = jb.merge_enqueue(d["queued_job"], d["enqueue_request"])
    return merged.select(
        "kind", "dedup_key", F.coalesce("job_id", F.lit(-1)).alias("job_id"), "action", "requests",
        _secs("run_after", "run_after_s"),
    )


def _requeue_sql(selection: str, attempts: str, after: str, table: str = "job") -> str:
    return f""", back AS (SELECT job_id, kind, dedup_key, version, {attempts} AS attempts,
        {after} AS after_s FROM {table} WHERE {selection}),
    per AS (SELECT kind, dedup_key, min(job_id) AS first_id, max(attempts) AS most FROM back
            GROUP BY kind, dedup_key),
    twin AS (SELECT kind, dedup_key, min(job_id) AS twin_id FROM job WHERE status = 'queued'
             GROUP BY kind, dedup_key),
    plan AS (SELECT per.*, twin_id FROM per LEFT JOIN twin USING (kind, dedup_key)),
    moved AS (SELECT b.job_id, twin_id IS NULL AND b.job_id = first_id AS wins, b.attempts, most,
                after_s, version + 1 AS version FROM back b JOIN plan USING (kind, dedup_key)),
    heirs AS (SELECT j.job_id, most, {DUCK.secs('j.run_after')} AS after_s, j.version
              FROM job j JOIN plan USING (kind, dedup_key)
              WHERE j.status = 'queued' AND twin_id IS NOT NULL AND j.attempts < most)"""


_TOUCHED = """
    SELECT job_id, CASE WHEN wins THEN 'queued' ELSE 'superseded' END AS status,
      CASE WHEN wins THEN most ELSE attempts END AS attempts,
      CASE WHEN wins THEN after_s ELSE -1 END AS run_after_s, version FROM moved
    UNION ALL SELECT job_id, 'queued', most, after_s, version FROM heirs"""


def _touched(df: DataFrame) -> DataFrame:
    return df.select("job_id", "status", "attempts", _secs("run_after", "run_after_s"), "version")


@query("requeue_merge", with_domain("job", _requeue_sql(
    "status = 'running' AND claimed_by = 'worker-1'", "attempts",
    f"{DUCK.secs(NOW)} + 60") + _TOUCHED))
def requeue_merge(d: Domain) -> DataFrame:
    """Everything worker-1 was running goes back after a minute."""
    mine = d["job"].where("status = 'running' AND claimed_by = 'worker-1'")
    return _touched(
        jb.requeue(d["job"], mine, run_after=F.expr(f"{NOW} + INTERVAL '60' SECOND"),
                   error_code="lock_busy")
    )


@query("job_defer", with_domain("job", _requeue_sql(
    "status = 'running' AND claimed_by = 'worker-2'", "greatest(attempts - 1, 0)",
    f"{DUCK.secs(NOW)} + 900") + _TOUCHED))
def job_defer(d: Domain) -> DataFrame:
    """Put back until a given time, the attempt is refunded."""
    mine = d["job"].where("status = 'running' AND claimed_by = 'worker-2'")
    return _touched(
        jb.requeue(d["job"], mine, run_after=F.expr(f"{NOW} + INTERVAL '900' SECOND"),
                   error_code="circuit_open", refund=1)
    )


@query("dead_revive", with_domain("job", _requeue_sql("status = 'dead'", "0", DUCK.secs(NOW)) + """
    SELECT job_id, CASE WHEN wins THEN 'queued' ELSE 'superseded' END AS status,
      CAST(0 AS BIGINT) AS attempts, CASE WHEN wins THEN after_s ELSE -1 END AS run_after_s, version
    FROM moved"""))
def dead_revive(d: Domain) -> DataFrame:
    """E15."""
    dead = d["job"].where("status = 'dead'")
    return _touched(jb.requeue(d["job"], dead, run_after=_now(), reset_attempts=True))


_BACKOFF = "CAST(least(3600, 10 * pow(2, greatest(attempts - 1, 0))) AS BIGINT)"


@query("retry_plan", with_domain("job", f"""
    SELECT job_id, attempts, CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'requeue' END
      AS next_status, CASE WHEN attempts >= max_attempts THEN -1 ELSE {_BACKOFF} END
      AS delay_ceiling_s, attempts >= max_attempts AS alert FROM job WHERE status = 'running'"""))
def retry_plan(d: Domain) -> DataFrame:
    """E09."""
    return jb.failures(d["job"].where("status = 'running'")).select(
        "job_id", "attempts", "next_status",
        F.coalesce("delay_ceiling_s", F.lit(-1)).alias("delay_ceiling_s"), "alert",
    )


@query("orphans", with_domain("job", _requeue_sql(
    "status = 'running' AND claimed_by IS DISTINCT FROM 'worker-1' AND attempts < max_attempts",
    "attempts", f"{DUCK.secs(NOW)} + {_BACKOFF}") + _TOUCHED + """
    UNION ALL SELECT job_id, 'dead', attempts, -1, version + 1 FROM job WHERE status = 'running'
      AND claimed_by IS DISTINCT FROM 'worker-1' AND attempts >= max_attempts"""))
def orphans(d: Domain) -> DataFrame:
    """E13."""
    return _touched(jb.recover_orphans(d["job"], "worker-1", _now()))


@query("cas_resolve", with_domain("job cas_proposal", """,
    m AS (SELECT p.*, p.expected_status = j.status AND p.expected_version = j.version AS ok,
          j.version AS v FROM cas_proposal p JOIN job j ON j.job_id = p.job_id),
    w AS (SELECT job_id, min(proposal_id) AS winner FROM m WHERE ok GROUP BY job_id)
    SELECT proposal_id, m.job_id, CASE WHEN NOT ok THEN 'conflict' WHEN proposal_id = winner
      THEN 'applied' ELSE 'lost_race' END AS result,
      CASE WHEN proposal_id = winner THEN v + 1 ELSE -1 END AS new_version
    FROM m LEFT JOIN w ON w.job_id = m.job_id"""))
def cas_resolve(d: Domain) -> DataFrame:
    """E12."""
    return jb.resolve_cas(d["job"], d["cas_proposal"]).withColumn(
        "new_version", F.coalesce("new_version", F.lit(-1))
    )


@query("job_complete", with_domain("job", """
    SELECT job_id, status = 'running' AND coalesce(claimed_by, '') = 'worker-' ||
      CAST(1 + job_id % 2 AS STRING) AS applied FROM job"""))
def job_complete(d: Domain) -> DataFrame:
    """Two workers report completions, not always for jobs they hold."""
    done = d["job"].select(
        "job_id", F.expr("'worker-' || CAST(1 + job_id % 2 AS STRING)").alias("worker")
    )
    return jb.complete_jobs(d["job"], done).select("job_id", "applied")


_SETTINGS = "SELECT 1 AS id, false AS kill_switch, 'approve_to_send' AS automation_mode"


@query("send_eligible", with_domain("outbound draft conversation_state", """
    SELECT o.outbound_id, CASE WHEN coalesce(c.automation, '') <> 'active' THEN 'automation'
      WHEN o.part_no = 1 AND NOT coalesce(c.last_inbound_seq = d.based_on_seq, false)
        THEN 'draft_stale'
      WHEN o.part_no > 1 AND NOT EXISTS (SELECT 1 FROM outbound p WHERE p.draft_id = o.draft_id
        AND p.generation = o.generation AND p.part_no = o.part_no - 1 AND p.status = 'sent')
        THEN 'previous_part' ELSE '' END AS blocked_by
    FROM outbound o LEFT JOIN draft d ON d.draft_id = o.draft_id
    LEFT JOIN conversation_state c ON c.conversation_id = d.conversation_id
    WHERE o.status = 'pending'"""))
def send_eligible(d: Domain) -> DataFrame:
    """E10."""
    return ob.send_eligibility(
        d["outbound"], d["draft"], d["conversation_state"], d.spark.sql(_SETTINGS)
    ).select("outbound_id", "blocked_by")


@query("outbox_stop", with_domain("outbound draft conversation_state", """,
    started AS (SELECT DISTINCT draft_id, generation FROM outbound
      WHERE status IN ('sending', 'sent', 'unknown', 'needs_owner', 'failed')),
    r AS (SELECT d.conversation_id, count(*) AS cancelled_parts,
            bool_or(s.draft_id IS NOT NULL) AS broken
          FROM outbound o JOIN draft d ON d.draft_id = o.draft_id
          LEFT JOIN started s ON s.draft_id = o.draft_id AND s.generation = o.generation
          WHERE o.status = 'pending' GROUP BY d.conversation_id)
    SELECT r.conversation_id, cancelled_parts, broken AND c.automation = 'active' AS paused,
      CASE WHEN broken AND c.automation = 'active' THEN state_version + 1 ELSE state_version END
        AS new_state_version
    FROM r JOIN conversation_state c ON c.conversation_id = r.conversation_id"""))
def outbox_stop(d: Domain) -> DataFrame:
    """E11."""
    return ob.stop_groups(d["outbound"], d["draft"], d["conversation_state"]).select(
        "conversation_id", "cancelled_parts", "paused", "new_state_version"
    )


@query("audit_alerts", with_domain("audit_event", """
    SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, action, coalesce(reason_code, '') AS reason_code,
      count(*) AS alerts, count(DISTINCT entity_id) AS entities
    FROM audit_event WHERE result = 'alert' GROUP BY ALL"""))
def audit_alerts(d: Domain) -> DataFrame:
    """Appended, read back, summed up per day."""
    feed = ob.alert_feed(ob.append_audit(d["audit_event"]))
    return feed.groupBy(
        F.col("day").cast("string").alias("day"), "action",
        F.coalesce("reason_code", F.lit("")).alias("reason_code"),
    ).agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("entity_id").alias("entities"))


@query("settings_current", with_domain("setting_change", """
    SELECT setting_id,
      coalesce(arg_max(new_value, version) FILTER (field = 'kill_switch'), '') AS kill_switch,
      coalesce(arg_max(new_value, version) FILTER (field = 'automation_mode'), '')
        AS automation_mode, max(version) AS version,
      count(*) FILTER (new_value IN ('true', 'draft_only')) AS stops
    FROM setting_change GROUP BY setting_id"""))
def settings_current(d: Domain) -> DataFrame:
    """E17."""
    return ob.current_settings(d["setting_change"]).fillna("")


_ROW_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) AS violations FROM {t} "
    f"WHERE NOT coalesce({p}, true) HAVING count(*) > 0"
    for t, rules in QR.ROW_RULES.items()
    for r, p in rules.items()
)


@query("dq_row_rules", with_domain(" ".join(QR.ROW_RULES), _ROW_SQL))
def dq_row_rules(d: Domain) -> DataFrame:
    """Each table is read once for all of its rules."""
    return reduce(
        DataFrame.unionByName,
        [dq.violation_counts(d[t], t, rules) for t, rules in QR.ROW_RULES.items()],
    )


_KEY_TABLES = {t for _, t, _, _ in QR.UNIQUE_RULES} | {
    x for _, t, _, o, _ in QR.REFERENCE_RULES for x in (t, o)
}
_KEY_SQL = " UNION ALL ".join(
    [
        f"SELECT '{r}' AS rule, 'unique' AS kind, count(*) AS keys, "
        f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT count(*) AS n FROM {t} "
        f"WHERE {c} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
        for r, t, k, c in QR.UNIQUE_RULES
    ]
    + [
        f"SELECT '{r}' AS rule, 'reference' AS kind, count(DISTINCT {c}) AS keys, count(*) AS excess "
        f"FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {oc} FROM {o})"
        for r, t, c, o, oc in QR.REFERENCE_RULES
    ]
)


@query("dq_key_rules", with_domain(" ".join(sorted(_KEY_TABLES)), _KEY_SQL))
def dq_key_rules(d: Domain) -> DataFrame:
    """E20."""
    checks = [dq.duplicate_keys(d[t], r, k, c) for r, t, k, c in QR.UNIQUE_RULES]
    checks += [dq.missing_references(d[t], r, c, d[o], oc) for r, t, c, o, oc in QR.REFERENCE_RULES]
    return reduce(DataFrame.unionByName, checks)


@query("inventory_dq", with_domain("stock_line price", """
    SELECT location AS scope, count(*) AS rows_checked,
      count(*) FILTER (available_qty > physical_qty) AS over_physical,
      count(*) FILTER (physical_qty < 0 OR available_qty < 0 OR external_reserved_qty < 0)
        AS negative FROM stock_line GROUP BY location
    UNION ALL SELECT currency, count(*), count(*) FILTER (length(currency) <> 3),
      count(*) FILTER (amount_minor < 0) FROM price GROUP BY currency"""))
def inventory_dq(d: Domain) -> DataFrame:
    """Quantity and currency invariants."""
    rules = {**QR.ROW_RULES["stock_line"]}
    stock = dq.row_violations(d["stock_line"], rules).groupBy(F.col("location").alias("scope")).agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.col("available_qty") > F.col("physical_qty")).alias("over_physical"),
        F.count_if(F.size("violations") > 0).alias("negative"),
    )
    bad = F.array_contains("violations", "currency")
    price = dq.row_violations(d["price"], QR.ROW_RULES["price"]).groupBy(
        F.col("currency").alias("scope")
    ).agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(bad).alias("over_physical"),
        F.count_if(F.array_contains("violations", "amount_minor")).alias("negative"),
    )
    return stock.unionByName(price)
