"""Verdict rules on a small catalogue, order independence, sets."""

from __future__ import annotations

import json
from datetime import datetime

from partsight.operators import fitment as fit
from partsight.operators import sets as st
from partsight.sources import catalog_store as store

NOW = datetime(2024, 1, 1)
SCHEMA = (
    "record_id long, sku string, make string, model string, chassis_code string, year_from int, "
    "year_to int, facelift boolean, status string, trim_line array<string>, "
    "parktronic_sensors array<int>, headlamp_washer array<boolean>, front_camera array<boolean>, "
    "evidence_kind string, evidence_ref string, evidence_verified_at timestamp, data_origin string"
)


def _record(i, sku, *, years=(None, None), facelift=None, status="verified", trim=None, sensors=None,
            kind="oem_catalog", ref="r", at=NOW, origin="real", chassis="W213"):
    return (i, sku, "Mercedes-Benz", "E-Class", chassis, *years, facelift, status, trim, sensors, None,
            None, kind, ref, at, origin)


RECORDS = [
    _record(1, "full", years=(2016, 2020)),
    _record(2, "body"),
    _record(3, "facelift", facelift=True),
    _record(4, "incompatible", years=(2016, 2020), status="incompatible"),
    _record(5, "outside", years=(2005, 2010)),
    _record(6, "photo", years=(2016, 2020), kind="visual_similarity"),
    _record(7, "both", years=(2016, 2020)), _record(8, "both", years=(2016, 2021), status="incompatible"),
    _record(9, "open", years=(2016, 2020), status="needs_verification"),
    _record(10, "trim", trim=["AMG-Line", "Exclusive"]),
    _record(11, "sensors", sensors=[6], years=(2016, 2020)),
    _record(12, "synthetic", years=(2016, 2020), kind="synthetic_fixture", origin="synthetic"),
    _record(13, "claims_real", years=(2016, 2020), origin="synthetic"),
    _record(14, "mixed", facelift=True), _record(15, "mixed", status="needs_verification"),
]


def _verdicts(spark, vehicle, records=RECORDS, parts=4, mode="test"):
    skus = sorted({r[1] for r in records} | {"nothing"})
    names = ("make", "model", "chassis_code", "year", "facelift", "trim_line", "parktronic_sensors",
             "headlamp_washer", "front_camera")
    schema = ("vehicle_id long, make string, model string, chassis_code string, year int, facelift boolean,"
              "trim_line string, parktronic_sensors int, headlamp_washer boolean, front_camera boolean")
    v = spark.createDataFrame([(1, *[vehicle.get(n) for n in names])], schema)
    c = spark.createDataFrame([(1, s) for s in skus], "vehicle_id long, sku string")
    r = fit.assess_evidence(spark.createDataFrame(records, SCHEMA).repartition(parts), mode)
    out = fit.product_verdicts(fit.match_records(c, v, fit.collapse_records(r)))
    return {x.sku: (x.status, x.reasons, x.missing_attributes) for x in out.collect()}


KNOWN = {"chassis_code": "w 213", "year": 2018}


def test_verdict_rules(spark):
    got = _verdicts(spark, KNOWN)
    nv = "needs_verification"
    assert got["full"] == ("verified", ["verified_record_matches"], [])
    assert got["body"] == (nv, ["body_code_only"], [])
    assert got["facelift"] == (nv, ["missing_vehicle_attributes"], ["facelift"])
    assert got["incompatible"] == ("incompatible", ["explicit_incompatible_record"], [])
    assert got["outside"] == (nv, ["outside_verified_range"], [])
    assert got["photo"] == (nv, ["evidence_not_accepted"], [])
    assert got["both"] == (nv, ["conflicting_records"], [])
    assert got["open"] == (nv, ["record_not_verified"], [])
    assert got["trim"] == (nv, ["missing_vehicle_attributes"], ["trim_line"])
    assert got["sensors"] == (nv, ["missing_vehicle_attributes"], ["parktronic_sensors"])
    assert got["synthetic"] == ("verified", ["verified_record_matches"], [])
    assert got["claims_real"] == (nv, ["evidence_not_accepted"], [])
    assert got["mixed"] == (nv, ["missing_vehicle_attributes", "record_not_verified"], ["facelift"])
    assert got["nothing"] == (nv, ["no_fitment_record"], [])


def test_answers_settle_candidates(spark):
    got = _verdicts(spark, {**KNOWN, "facelift": True, "trim_line": "amg line", "parktronic_sensors": 6})
    assert {s for s, v in got.items() if v[0] == "verified"} == {
        "full", "facelift", "trim", "sensors", "synthetic", "mixed"}


def test_other_chassis_is_outside(spark):
    got = _verdicts(spark, {"chassis_code": "W212", "year": 2018})
    assert got["full"][1] == ["outside_verified_range"]
    assert got["photo"][1] == ["no_record_matches_vehicle"]


def test_unknown_car_asks_for_identity(spark):
    assert _verdicts(spark, {})["full"][2] == ["make", "model", "chassis_code", "year"]


def test_development_mode_ignores_synthetic_evidence(spark):
    assert _verdicts(spark, KNOWN, mode="development")["synthetic"][1] == ["evidence_not_accepted"]


def test_order_does_not_matter(spark):
    assert _verdicts(spark, KNOWN) == _verdicts(spark, KNOWN, RECORDS[::-1], parts=1)


def test_questions(spark):
    rows = [(1, "a", "needs_verification", ["facelift", "year"]), (1, "b", "needs_verification", ["facelift"]),
            (1, "c", "verified", ["year"]), (1, "d", "needs_verification", ["make"])]
    df = spark.createDataFrame(rows, "vehicle_id long, sku string, status string, missing_attributes array<string>")
    asked = fit.rank_questions(df).orderBy("position").collect()
    assert [r.attribute for r in asked] == ["facelift", "make", "year"]


def test_evidence_of_judged_candidates(spark):
    names = ("make", "model", "chassis_code", "year", "facelift", "trim_line", "parktronic_sensors",
             "headlamp_washer", "front_camera")
    schema = ("vehicle_id long, make string, model string, chassis_code string, year int, facelift boolean,"
              "trim_line string, parktronic_sensors int, headlamp_washer boolean, front_camera boolean")
    cars = ((1, KNOWN), (2, {**KNOWN, "facelift": True}), (3, {}), (3, {"chassis_code": "W212", "year": 2018}))
    v = spark.createDataFrame([(i, *[car.get(n) for n in names]) for i, car in cars], schema)
    skus = sorted({r[1] for r in RECORDS}) + ["nothing", None]
    c = spark.createDataFrame([(i, s) for i in (1, 2, 3, None) for s in skus], "vehicle_id long, sku string")
    r = fit.assess_evidence(spark.createDataFrame(RECORDS, SCHEMA))
    verdicts = fit.product_verdicts(fit.match_records(c, v, fit.collapse_records(r)))
    joined = fit.verdict_evidence(fit.match_records(c, v, r), verdicts)
    passed = fit.verdict_evidence(fit.match_records(fit.judged_candidates(verdicts), v, r))
    assert joined.columns == passed.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, passed.collect()))
    first = [x for x in passed.where("vehicle_id = 1").collect() if x.sku in ("both", "outside", "photo", "mixed")]
    assert sorted((x.sku, x.record_id) for x in first) == [
        ("both", 7), ("both", 8), ("mixed", 14), ("mixed", 15), ("outside", 5), ("photo", 6)]


def test_conditions(spark):
    docs = ['{"trim_line": "amg"}', '{"trim_line": ["a", "b"]}', '{"parktronic_sensors": true}', '{"sunroof": 1}',
            '{"headlamp_washer": 1}', '{"trim_line": ""}', "[1]", '{"parktronic_sensors": [4, 6]}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, conditions string")
    got = {(r.i, r.violation) for r in fit.condition_violations(df).collect()}
    assert got == {(2, "bad_value:parktronic_sensors"), (3, "unknown_key:sunroof"),
                   (4, "bad_value:headlamp_washer"), (5, "bad_value:trim_line"), (6, "not_an_object")}


def test_sets(spark):
    sets = spark.createDataFrame([("S1", "virtual_set"), ("S2", "virtual_set"), ("S3", "virtual_set"),
                                  ("S4", "stocked_set"), ("S5", "virtual_set")], "set_sku string, set_kind string")
    lines = spark.createDataFrame(
        [("S1", "a", 2, True, False), ("S1", "b", 1, True, False), ("S1", "c", 1, True, True),
         ("S2", "a", 9, True, False), ("S3", "x", 1, True, False), ("S4", "a", 1, False, False)],
        "set_sku string, component_sku string, qty int, present boolean, optional boolean")
    claims = spark.createDataFrame(
        [("a", "available", 5, None, NOW), ("b", "available", 7, None, NOW), ("S4", "available", 3, None, NOW)],
        "sku string, status string, sellable_qty long, reason string, as_of timestamp")
    got = {r.set_sku: (r.status, r.complete_sets, r.reason, r.complete)
           for r in st.set_availability(sets, lines, claims).collect()}
    assert got == {
        "S1": ("available", 2, None, True), "S2": ("not_available", 0, "missing_components", False),
        "S3": ("unknown", None, "component_unknown", None), "S4": ("available", 3, None, False),
        "S5": ("unknown", None, "set_has_no_components", None),
    }


def test_catalogue_documents(spark, tmp_path):
    doc = {
        "dataset": "d", "data_origin": "real", "source": "s", "snapshot_at": "2024-01-01T00:00:00Z",
        "vehicle_specs": [{"id": "v1", "make": "M", "model": "E", "chassis_code": "W213", "year_from": 2016}],
        "products": [{"sku": "p1", "title": "t", "oem_numbers": ["A 1", "A 2"]}, {"sku": "p1"}],
        "fitments": [{"id": "f1", "sku": "p1", "vehicle_spec": "v1", "conditions": {"trim_line": "amg"}},
                     {"id": "f2", "sku": "nope", "vehicle_spec": "v1", "conditions": {"sunroof": True}}],
        "set_components": [], "stock": [{"ref": "r", "sku": "p1", "available_qty": 2}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    tables = store.read_dataset(spark, str(tmp_path))
    assert {n: t.count() for n, t in tables.items()} == {
        "vehicle_specs": 1, "products": 2, "fitments": 2, "set_components": 0, "stock": 1, "prices": 0, "photos": 0}
    checks = [
        store.unknown_references(tables["fitments"], "sku", tables["products"], "sku", "unknown_sku"),
        store.duplicate_keys(tables["products"], ["sku"], "duplicate_sku"),
    ]
    assert {(r.rule, r.violations, r.first_item) for r in store.violation_summary(checks).collect()} == {
        ("unknown_sku", 1, "nope"), ("duplicate_sku", 1, "p1")}
    assert [r.violation for r in fit.condition_violations(tables["fitments"]).collect()] == ["unknown_key:sunroof"]
