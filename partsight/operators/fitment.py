"""Does a part fit a vehicle?

Matching is an equi-join of candidate pairs with the records of the part; every attribute check is
a column expression, and the verdict is one ``groupBy`` of flags and minima (map-side combined), so
neither a hot part nor a hot vehicle is gathered into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.functions.keys import text_key
from partsight.operators.joins import shuffled
from partsight.rules import catalog as R

MATCH, MISMATCH, UNKNOWN = "match", "mismatch", "unknown"
_SPEC = ("make", "model", "chassis_code", "year_from", "year_to", "facelift")


def _verdict(ok: Column) -> Column:
    return F.when(ok, MATCH).otherwise(MISMATCH)


def _ask(given: Column, ok: Column) -> Column:
    """Unknown when the customer did not say, else match or mismatch."""
    return F.when(given.isNull(), UNKNOWN).otherwise(_verdict(ok))


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def known_attributes(vehicles: DataFrame) -> DataFrame:
    """The attributes the customer named, as a name -> text map."""
    names = F.array(*[F.lit(a) for a in R.ATTRIBUTE_ORDER])
    values = F.array(*[F.col(a).cast("string") for a in R.ATTRIBUTE_ORDER])
    known = F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())
    return vehicles.select("vehicle_id", known.alias("known"), F.size(known).alias("n_known"))


_TEXT = ("make", "model", "chassis_code")


def keyed_vehicles(vehicles: DataFrame) -> DataFrame:
    """C04 once per vehicle, not once per pair: text attributes as comparison keys."""
    return vehicles.withColumns({a: text_key(F.col(a)) for a in (*_TEXT, *R.TEXT_CONDITIONS)})


def keyed_records(records: DataFrame) -> DataFrame:
    """C04 once per record."""
    return records.withColumns(
        {
            **{a: text_key(F.col(a)) for a in _TEXT},
            **{a: F.transform(a, text_key) for a in R.TEXT_CONDITIONS},
        }
    )


def attribute_checks(spec: str = "r", vehicle: str = "v") -> dict[str, Column]:
    """One outcome column per attribute; NULL where the record does not constrain it. Texts
    are comparison keys already."""

    def s(name: str) -> Column:
        return F.col(f"{spec}.{name}")

    def v(name: str) -> Column:
        return F.col(f"{vehicle}.{name}")

    by_chassis = v("chassis_code").isNotNull()
    checks = {
        name: F.when(
            ~(by_chassis & v(name).isNull()),
            _ask(v(name), s(name) == v(name)),
        )
        for name in ("make", "model")
    }
    checks["chassis_code"] = _ask(v("chassis_code"), s("chassis_code") == v("chassis_code"))
    has_range = s("year_from").isNotNull() | s("year_to").isNotNull()
    in_range = (s("year_from").isNull() | (v("year") >= s("year_from"))) & (
        s("year_to").isNull() | (v("year") <= s("year_to"))
    )
    checks["year"] = F.when(has_range & v("year").isNotNull(), _verdict(in_range)).when(
        has_range & s("facelift").isNull(), UNKNOWN
    )
    checks["facelift"] = F.when(
        s("facelift").isNotNull(), _ask(v("facelift"), s("facelift") == v("facelift"))
    )
    for name in R.TEXT_CONDITIONS:
        checks[name] = F.when(
            s(name).isNotNull(), _ask(v(name), F.array_contains(s(name), v(name)))
        )
    for name in R.INT_CONDITIONS:
        wanted = s(name).cast("array<bigint>")
        checks[name] = F.when(
            s(name).isNotNull(), _ask(v(name), F.array_contains(wanted, v(name).cast("bigint")))
        )
    for name in R.BOOL_CONDITIONS:
        checks[name] = F.when(s(name).isNotNull(), _ask(v(name), F.array_contains(s(name), v(name))))
    return checks


def _outcome() -> Column:
    """C06, over the ``check_*`` columns."""
    cols = [F.coalesce(F.col(f"check_{a}"), F.lit("")) for a in R.ATTRIBUTE_ORDER]
    return (
        F.when(_any([c == MISMATCH for c in cols]), MISMATCH)
        .when(_any([c == UNKNOWN for c in cols]), "partial")
        .otherwise("full")
    )


def assess_evidence(records: DataFrame, mode: str = "test") -> DataFrame:
    """``accepted``, ``rejection`` and ``synthetic`` per record, rules in their fixed order.

    Production mode is a matter of ``origin_guard``: synthetic rows never get this far.
    """
    kind = F.col("evidence_kind")
    synthetic = F.col("data_origin") == "synthetic"
    is_fixture = kind == R.SYNTHETIC_EVIDENCE
    rejection = (
        F.when(kind.isNull(), "evidence_missing")
        .when(kind.isin(*R.NON_EVIDENCE), "evidence_kind_not_evidence")
        .when(F.trim(F.coalesce("evidence_ref", F.lit(""))) == "", "evidence_ref_missing")
        .when(F.col("evidence_verified_at").isNull(), "evidence_verified_at_missing")
        .when(is_fixture & ~synthetic, "synthetic_evidence_on_real_record")
        .when(is_fixture & F.lit(mode != "test"), "synthetic_evidence_not_accepted")
        .when(is_fixture, None)
        .when(~kind.isin(*R.QUALIFYING_EVIDENCE), "evidence_kind_not_evidence")
        .when(synthetic, "synthetic_record_claims_real_evidence")
    )
    return records.withColumn("rejection", rejection).withColumns(
        {"accepted": F.col("rejection").isNull(), "synthetic": synthetic}
    )


def origin_guard(rows: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(allowed, refused). Synthetic rows are refused in production, the default mode."""
    bad = F.col("data_origin") == "synthetic"
    if "evidence_kind" in rows.columns:
        bad = bad | F.coalesce(F.col("evidence_kind") == R.SYNTHETIC_EVIDENCE, F.lit(False))
    if mode != "production":
        bad = F.lit(False)
    return rows.where(~bad), rows.where(bad)


def collapse_records(records: DataFrame) -> DataFrame:
    """Records of a part that match and count alike become one row with the smallest id.

    A verdict depends on nothing else, so this is exact; it keeps a part with a huge number of
    records from multiplying its candidates.
    """
    keys = ["sku", *_SPEC, *R.CONDITIONS, "status", "accepted"]
    return keyed_records(records).groupBy(*keys).agg(
        F.min("record_id").alias("record_id"), F.bool_or("synthetic").alias("synthetic")
    )


def match_records(candidates: DataFrame, vehicles: DataFrame, records: DataFrame) -> DataFrame:
    """C05 + C06: one row per (vehicle, part, record); parts without a record keep one row with a
    NULL ``record_id``. ``candidates`` holds ``vehicle_id, sku``; further columns are passed on.

    Neither side is broadcast, as both grow; the rows stay together by part for a ``groupBy`` after it.
    """
    joined = (
        candidates.alias("c")
        .join(shuffled(keyed_vehicles(vehicles)).alias("v"), F.col("c.vehicle_id") == F.col("v.vehicle_id"))
        .join(shuffled(keyed_records(records)).alias("r"), F.col("c.sku") == F.col("r.sku"), "left")
    )
    keep = [c for c in records.columns if c not in ("sku", *_SPEC, *R.CONDITIONS)]
    checked = joined.select(
        "c.*",
        *[f"r.{c}" for c in keep],
        *[
            F.when(F.col("r.record_id").isNotNull(), check).alias(f"check_{name}")
            for name, check in attribute_checks().items()
        ],
    )
    return checked.withColumn("outcome", F.when(F.col("record_id").isNotNull(), _outcome()))


def _row_flags(matched: DataFrame) -> DataFrame:
    applicable = F.col("outcome") != MISMATCH
    full = F.col("outcome") == "full"
    status, accepted = F.col("status"), F.col("accepted")
    discriminating = _any(
        [
            F.coalesce(F.col(f"check_{a}") == MATCH, F.lit(False))
            for a in R.ATTRIBUTE_ORDER
            if a not in R.IDENTITY_ATTRIBUTES
        ]
    )
    undecided = status == "needs_verification"
    return matched.withColumns(
        {
            "is_applicable": applicable,
            "is_excluding": (status == "verified") & accepted,
            "is_verified": full & (status == "verified") & accepted & discriminating,
            "is_incompatible": full & (status == "incompatible") & accepted,
            "says_missing": applicable & (F.col("outcome") == "partial") & accepted & ~undecided,
            "says_unverified": applicable & undecided,
            "says_rejected": applicable & ~undecided & ~accepted,
            "says_body_code": full & accepted & (status == "verified"),
        }
    )


_REASONS = (
    ("says_missing", "missing_vehicle_attributes"),
    ("says_unverified", "record_not_verified"),
    ("says_rejected", "evidence_not_accepted"),
    ("says_body_code", "body_code_only"),
)


def product_verdicts(matched: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """C08 + C10: the verdict per (vehicle, part).

    Reasons come out in the order in which records (by id) first raise them: each of the four
    possible reasons keeps only its smallest record id. ``matched`` is the output of
    ``match_records``.
    """
    flags = _row_flags(matched)
    aggs = [
        F.count("record_id").alias("n_records"),
        *[
            F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
            for c in ("is_applicable", "is_excluding", "is_verified", "is_incompatible")
        ],
        *[F.min(F.when(F.col(c), F.col("record_id"))).alias(c) for c, _ in _REASONS],
        *[
            F.coalesce(
                F.bool_or(F.col("says_missing") & (F.col(f"check_{a}") == UNKNOWN)), F.lit(False)
            ).alias(f"miss_{a}")
            for a in R.ATTRIBUTE_ORDER
        ],
        F.coalesce(F.bool_or("synthetic"), F.lit(False)).alias("synthetic"),
    ]
    grouped = flags.groupBy("vehicle_id", "sku").agg(*aggs)
    if products is not None:
        origin = products.select("sku", (F.col("data_origin") == "synthetic").alias("syn_product"))
        grouped = (
            grouped.join(shuffled(origin), "sku", "left")
            .withColumn("synthetic", F.col("synthetic") | F.coalesce("syn_product", F.lit(False)))
            .drop("syn_product")
        )

    both = F.col("is_verified") & F.col("is_incompatible")
    case = [
        (F.col("n_records") == 0, "needs_verification", "no_fitment_record"),
        (~F.col("is_applicable") & F.col("is_excluding"), "needs_verification",
         "outside_verified_range"),
        (~F.col("is_applicable"), "needs_verification", "no_record_matches_vehicle"),
        (both, "needs_verification", "conflicting_records"),
        (F.col("is_verified"), "verified", "verified_record_matches"),
        (F.col("is_incompatible"), "incompatible", "explicit_incompatible_record"),
    ]
    status, single = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for cond, s, r in case:
        status, single = status.when(cond, s), single.when(cond, r)
    raised = F.filter(
        F.array(
            *[
                F.struct(F.col(c).alias("at"), F.lit(i).alias("rank"), F.lit(r).alias("reason"))
                for i, (c, r) in enumerate(_REASONS)
            ]
        ),
        lambda x: x["at"].isNotNull(),
    )
    missing = F.filter(
        F.array(*[F.when(F.col(f"miss_{a}"), F.lit(a)) for a in R.ATTRIBUTE_ORDER]),
        lambda a: a.isNotNull(),
    )
    decided = grouped.withColumns(
        {"status": F.coalesce(status, F.lit("needs_verification")), "single": single}
    )
    empty = F.array().cast("array<string>")
    return decided.select(
        "vehicle_id",
        "sku",
        "status",
        F.when(F.col("single").isNotNull(), F.array("single"))
        .otherwise(F.transform(F.array_sort(raised), lambda x: x["reason"]))
        .alias("reasons"),
        F.when(F.col("single").isNull(), missing).otherwise(empty).alias("missing_attributes"),
        "synthetic",
    ).withColumns(
        {
            "owner_only": F.array_contains("reasons", "outside_verified_range"),
            "customer_can_resolve": F.size("missing_attributes") > 0,
        }
    )


def judged_candidates(verdicts: DataFrame) -> DataFrame:
    """Candidates with the first reason of their verdict, for ``match_records`` to pass on: a short row
    goes to the records, so that the checks of every record need not go to the verdicts.

    A pair without a record has no evidence and is left out.
    """
    reason = F.col("reasons")[0]
    return verdicts.select("vehicle_id", "sku", reason.alias("reason")).where(reason != "no_fitment_record")


def verdict_evidence(matched: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The records behind each verdict, one row each (``position`` is the record id order).

    The list stays in rows, so a part with very many records needs no huge array. Without ``verdicts``,
    ``matched`` are the matches of ``judged_candidates``.
    """
    flags = _row_flags(matched.where(F.col("record_id").isNotNull()))
    if verdicts is not None:
        judged = verdicts.select("vehicle_id", "sku", F.col("reasons")[0].alias("reason"))
        flags = flags.join(judged, ["vehicle_id", "sku"])
    reason = F.col("reason")
    used = (
        F.when(reason == "outside_verified_range", F.col("is_excluding"))
        .when(reason == "no_record_matches_vehicle", F.lit(True))
        .when(reason == "conflicting_records", F.col("is_verified") | F.col("is_incompatible"))
        .when(reason == "verified_record_matches", F.col("is_verified"))
        .when(reason == "explicit_incompatible_record", F.col("is_incompatible"))
        .otherwise(F.col("is_applicable"))
    )
    checks = F.filter(
        F.array(
            *[
                F.when(
                    F.col(f"check_{a}").isNotNull(),
                    F.struct(F.lit(a).alias("attribute"), F.col(f"check_{a}").alias("outcome")),
                )
                for a in R.ATTRIBUTE_ORDER
            ]
        ),
        lambda c: c.isNotNull(),
    )
    return flags.where(F.coalesce(used, F.lit(False))).select(
        "vehicle_id", "sku", "record_id", F.col("status").alias("record_status"), "outcome",
        checks.alias("checks"), "accepted", "rejection",
    )


def set_verdicts(
    sets: DataFrame, components: DataFrame, verdicts: DataFrame, own: DataFrame | None = None
) -> DataFrame:
    """The verdict of a set from its required members and, if it has records, its own."""
    lines = (
        sets.join(components, "set_sku")
        .where(~F.col("optional") & ((F.col("set_kind") != "stocked_set") | F.col("present")))
        .select("vehicle_id", "set_sku", F.col("component_sku").alias("sku"))
    )
    members = lines.join(verdicts, ["vehicle_id", "sku"], "left")
    if own is not None:
        with_records = own.where(~F.array_contains("reasons", "no_fitment_record"))
        members = members.unionByName(
            sets.select("vehicle_id", "set_sku", F.col("set_sku").alias("sku")).join(
                with_records, ["vehicle_id", "sku"]
            )
        )
    status = F.coalesce("status", F.lit("needs_verification"))
    flags = members.groupBy("vehicle_id", "set_sku").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.bool_or(status == "incompatible").alias("any_incompatible"),
        F.bool_and(status == "verified").alias("all_verified"),
        F.bool_or(F.coalesce("owner_only", F.lit(False))).alias("outside"),
        F.bool_or(F.coalesce("synthetic", F.lit(False))).alias("member_synthetic"),
        *[
            F.bool_or(
                F.coalesce(F.array_contains("missing_attributes", a), F.lit(False))
            ).alias(f"miss_{a}")
            for a in R.ATTRIBUTE_ORDER
        ],
    )
    joined = sets.join(flags, ["vehicle_id", "set_sku"], "left")
    none = F.col("n_members").isNull()
    settled = F.col("any_incompatible") | F.col("all_verified")
    missing = F.filter(
        F.array(*[F.when(F.col(f"miss_{a}"), F.lit(a)) for a in R.ATTRIBUTE_ORDER]),
        lambda a: a.isNotNull(),
    )
    needs = F.lit("component_needs_verification")
    return joined.select(
        "vehicle_id",
        "set_sku",
        F.when(none, "needs_verification")
        .when(F.col("any_incompatible"), "incompatible")
        .when(F.col("all_verified"), "verified")
        .otherwise("needs_verification")
        .alias("status"),
        F.when(none, F.array(F.lit("no_fitment_record")))
        .when(F.col("any_incompatible"), F.array(F.lit("component_incompatible")))
        .when(F.col("all_verified"), F.array(F.lit("all_components_verified")))
        .when(F.col("outside"), F.array(needs, F.lit("outside_verified_range")))
        .otherwise(F.array(needs))
        .alias("reasons"),
        F.when(none | settled, F.array().cast("array<string>"))
        .otherwise(missing)
        .alias("missing_attributes"),
        ((F.col("data_origin") == "synthetic") | F.coalesce("member_synthetic", F.lit(False))).alias(
            "synthetic"
        ),
    )


def rank_questions(verdicts: DataFrame) -> DataFrame:
    """What to ask each customer, most useful first; at most nine rows per vehicle."""
    order = F.array(*[F.lit(a) for a in R.ATTRIBUTE_ORDER])
    return (
        verdicts.where(F.col("status") == "needs_verification")
        .select("vehicle_id", F.explode("missing_attributes").alias("attribute"))
        .groupBy("vehicle_id", "attribute")
        .agg(F.count(F.lit(1)).alias("candidates"))
        .withColumn(
            "position",
            F.expr(
                "row_number() OVER (PARTITION BY vehicle_id ORDER BY candidates DESC, "
                f"array_position(array({', '.join(repr(a) for a in R.ATTRIBUTE_ORDER)}), attribute))"
            ),
        )
    )


def condition_violations(records: DataFrame, conditions: str = "conditions") -> DataFrame:
    """Condition entries with an unknown key or a value of the wrong type, from a JSON object
    column; bool is not int, text must not be empty, a list means "any of"."""
    doc = F.try_parse_json(F.col(conditions))
    kinds = {
        **{c: ("STRING",) for c in R.TEXT_CONDITIONS},
        **{c: ("BIGINT",) for c in R.INT_CONDITIONS},
        **{c: ("BOOLEAN",) for c in R.BOOL_CONDITIONS},
    }
    keys = F.json_object_keys(F.col(conditions))
    pieces = [F.when(keys.isNull(), F.array(F.lit("not_an_object")))
              .otherwise(F.transform(
                  F.array_except(keys, F.array(*[F.lit(c) for c in kinds])),
                  lambda k: F.concat(F.lit("unknown_key:"), k)))]
    for name, allowed in kinds.items():
        raw = F.get_json_object(F.col(conditions), f"$.{name}")
        value = F.try_variant_get(doc, f"$.{name}", "variant")
        shape = F.schema_of_variant(value)
        ok = shape.isin(*allowed, *[f"ARRAY<{a}>" for a in allowed])
        if name in R.TEXT_CONDITIONS:
            ok = ok & (raw != "") & ~F.coalesce(raw.contains('""'), F.lit(False))
        present = F.array_contains(keys, name)
        pieces.append(
            F.when(present & ~F.coalesce(ok, F.lit(False)), F.array(F.lit(f"bad_value:{name}")))
        )
    found = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in pieces])
    return records.withColumn("violation", F.explode(found))
