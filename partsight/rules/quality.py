"""Row and key rules of the stored tables, as data. Every predicate says what a good row satisfies
and is plain SQL; a NULL result counts as satisfied, as a CHECK constraint does."""

from __future__ import annotations

from partsight.rules import catalog as R

# Allowed words.
CONVERSATION_STATES = (
    "new_request", "awaiting_info", "researching", "offer_presented", "awaiting_selection",
    "awaiting_confirmation", "reservation_pending", "completed", "closed",
)
CLOSE_REASONS = ("customer_withdrew", "inactive", "owner_closed")
AUTOMATION_STATES = ("active", "paused")
PAUSED_REASONS = (
    "owner_takeover", "owner_intervened", "owner_modified", "send_unknown", "group_incomplete",
    "unknown_author", "unsupported_content", "llm_outage", "budget", "restore_gap",
)
AUTHOR_ROLES = ("customer", "assistant", "owner_manual", "system", "unknown")
DIRECTIONS = ("in", "out")
JOB_STATUSES = ("queued", "running", "done", "dead", "superseded")
DRAFT_STATUSES = (
    "proposed", "approved", "rejected", "stale", "superseded", "sent", "sent_by_owner",
)
OUTBOUND_STATUSES = (
    "pending", "sending", "sent", "unknown", "needs_owner", "failed", "cancelled",
)
OUTBOUND_KINDS = ("text", "image")


def _in(column: str, words: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


ROW_RULES: dict[str, dict[str, str]] = {
    "conversation_state": {
        "state": _in("state", CONVERSATION_STATES),
        "close_reason": _in("close_reason", CLOSE_REASONS),
        "automation": _in("automation", AUTOMATION_STATES),
        "paused_reason": _in("paused_reason", PAUSED_REASONS),
        "paused_has_reason": "automation <> 'paused' OR paused_reason IS NOT NULL",
        "closed_reason": "(state = 'closed') = (close_reason IS NOT NULL)",
    },
    "inbound_message": {
        "author_role": _in("author_role", AUTHOR_ROLES),
        "direction": _in("direction", DIRECTIONS),
    },
    "job": {"status": _in("status", JOB_STATUSES)},
    "draft": {"status": _in("status", DRAFT_STATUSES)},
    "outbound": {
        "status": _in("status", OUTBOUND_STATUSES),
        "kind": _in("kind", OUTBOUND_KINDS),
        "body": "(kind = 'text' AND body_text IS NOT NULL) "
        "OR (kind = 'image' AND photo_id IS NOT NULL)",
        "part_no": "part_no BETWEEN 1 AND part_count",
    },
    "audit_event": {"reason_short": "length(reason_code) <= 200"},
    "product": {
        "condition": _in("condition", R.PRODUCT_CONDITIONS),
        "set_kind": _in("set_kind", R.SET_KINDS),
        "origin": _in("data_origin", R.DATA_ORIGINS),
        "synthetic_sku": "(data_origin = 'synthetic') = (sku LIKE 'SYN-%')",
    },
    "fitment": {
        "status": _in("status", R.FITMENT_STATUSES),
        "evidence_type": _in("evidence_kind", R.EVIDENCE_TYPES),
        "years": "year_from <= year_to",
        "verified_evidence": "status <> 'verified' OR (evidence_ref IS NOT NULL AND "
        "trim(evidence_ref) <> '' AND evidence_verified_at IS NOT NULL AND ("
        + _in("coalesce(evidence_kind, '')", R.QUALIFYING_EVIDENCE)
        + " OR (coalesce(evidence_kind, '') = 'synthetic_fixture' AND data_origin = 'synthetic')))",
        "synthetic_evidence": "coalesce(evidence_kind, '') <> 'synthetic_fixture' "
        "OR data_origin = 'synthetic'",
    },
    "set_component": {"qty": "qty > 0", "not_self": "set_sku <> component_sku"},
    "stock_line": {
        "physical_qty": "physical_qty >= 0",
        "external_reserved_qty": "external_reserved_qty >= 0",
        "available_qty": "available_qty >= 0",
    },
    "price": {
        "amount_minor": "amount_minor >= 0",
        "currency": "length(currency) = 3 AND upper(currency) = currency",
    },
}

# (rule, table, key columns, condition under which the key must be unique)
UNIQUE_RULES: tuple[tuple[str, str, tuple[str, ...], str], ...] = (
    ("message_id", "inbound_message", ("message_id",), "true"),
    ("job_queued_key", "job", ("kind", "dedup_key"), "status = 'queued'"),
    ("draft_open_per_seq", "draft", ("conversation_id", "based_on_seq"),
     "status IN ('proposed', 'approved')"),
    ("outbound_part", "outbound", ("draft_id", "generation", "part_no"), "true"),
    ("product_sku", "product", ("sku",), "true"),
    ("stock_ref", "stock_line", ("stock_ref",), "true"),
)

# (rule, table, column, referenced table, referenced column)
REFERENCE_RULES: tuple[tuple[str, str, str, str, str], ...] = (
    ("message_conversation", "inbound_message", "conversation_id", "conversation_state",
     "conversation_id"),
    ("draft_conversation", "draft", "conversation_id", "conversation_state", "conversation_id"),
    ("outbound_draft", "outbound", "draft_id", "draft", "draft_id"),
    ("photo_stock", "photo", "stock_ref", "stock_line", "stock_ref"),
    ("price_product", "price", "sku", "product", "sku"),
)
