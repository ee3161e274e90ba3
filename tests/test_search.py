"""Searches against plain Python over every request and product: nulls, repeated keys, few or no criteria."""

from __future__ import annotations

import random
from collections import Counter

from partsight.operators.inventory import search_products

REQUESTS = "query_id long, sku string, oem_number string, make string, model string, chassis_code string, part_type string"
PRODUCTS, OEMS = "sku string, title string, part_type string", "sku string, oem_number string"
FITMENTS = "sku string, make string, model string, chassis_code string"


def _key(value):
    return None if value is None else "".join(c for c in value.lower() if c.isalnum())


def _expected(requests, products, oems, fitments) -> Counter:
    """As the reference and the query's SQL have it: every criterion that is given must hold."""
    number = str.maketrans("", "", " -./")
    found = Counter()
    for q, sku, oem, *vehicle, kind in requests:
        wanted = [*map(_key, vehicle)]
        for p, title, part_type in products:
            if sku is not None and (p is None or sku.strip().upper() != p.upper()) or kind is not None and kind != part_type:
                continue
            if oem is not None and not any(p is not None and s == p and o.translate(number).upper() == oem.translate(number).upper() for s, o in oems):
                continue
            given = any(w is not None for w in wanted)
            listed = given and any(
                p is not None and s == p and all(w is None or w == _key(v) for w, v in zip(wanted, spec, strict=True)) for s, *spec in fitments
            )
            mentioned = wanted[2] is not None and title is not None and wanted[2] in _key(title)
            if not given or listed or mentioned:
                basis = (("sku", sku is not None), ("oem_number", oem is not None), ("catalog_applicability", listed), ("title_mention", mentioned))
                found[(q, p, tuple(name for name, holds in basis if holds))] += 1
    return found


def _check(spark, requests, products, oems, fitments):
    found = search_products(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(products, PRODUCTS),
        spark.createDataFrame(oems, OEMS), spark.createDataFrame(fitments, FITMENTS),
    )
    assert Counter((r.query_id, r.sku, tuple(r.match_basis)) for r in found.collect()) == _expected(requests, products, oems, fitments)


def test_pairs_that_a_key_or_a_null_left_out(spark):
    products = [("P-1", "Door W-213", "door"), ("P-2", "Lamp", "lamp"), ("P-2", "Lamp W213", None), (None, "w 213 glass", "door"), ("P-4", None, "lamp")]
    oems = [("P-1", "A 213-885"), ("P-2", "A.213/885"), ("P-2", "a213885"), (None, "A 213-885")]
    fitments = [("P-4", None, "E", "W213"), ("P-1", "Merc", None, "S212"), (None, "Merc", "E", "W213"), ("P-2", None, None, None)]
    asked = [
        (None, None, None, None, "w213", None), (None, None, None, None, None, "lamp"), (None, None, None, None, None, None),
        (None, None, None, None, "-", None), (None, None, None, None, "--", "door"), (None, None, "merc", None, None, None),
        (None, None, None, "e", None, None), ("p-4", None, None, None, "W 213", None), (None, "A213885", None, None, "S212", None),
        (None, None, None, None, "W2́13", None), (" p-2 ", "A213885", None, None, None, "lamp"), (None, None, "", None, None, None),
    ]
    requests = [(i, *a) for i, a in enumerate(asked)] + [(None, *asked[0]), (3, *asked[0]), (3, "P-1", *asked[5][1:]), (3, "P-1", None, "Opel", None, None, None)]
    _check(spark, requests, products, oems, fitments)


def test_searches_of_any_criteria_equal_every_pair_looked_at(spark):
    rnd = random.Random(5)

    def one(*values):
        return rnd.choice((None, None, *values))

    products = [(one(*(f"P-{i}" for i in range(20))), one("Door W213", "lamp s-212", "w213/s212"), one("door", "lamp")) for _ in range(40)]
    oems = [(one(*(f"P-{i}" for i in range(20))), f"A {rnd.randrange(6)}-1") for _ in range(30)]
    fitments = [(one(*(f"P-{i}" for i in range(20))), one("M 1", "m2"), one("E", "C"), one("W213", "S-212")) for _ in range(60)]
    requests = [
        (one(1, 2, 3), one(*(f"p-{i} " for i in range(20))), one("a0.1", "A31"), one("M1", "M2"), one("e", "c", ""), one("w 213", "S212", "."), one("door", "lamp"))
        for _ in range(120)
    ]
    _check(spark, requests, products, oems, fitments)
