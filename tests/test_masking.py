"""Golden texts, offsets against Python, and long hostile texts."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from partsight.functions import text as tx
from partsight.functions.spans import spans, unicode_regex
from partsight.operators import masking as mk

MASKED = [
    ("Звоните 8 900 123-45-67 или пишите ivan@mail.ru", "Звоните [PHONE_1] или пишите [EMAIL_1]"),
    ("+7 (900) 123-45-67 и 89001234567", "[PHONE_1] и [PHONE_1]"),
    ("мой тг: @ivan_petrov, vk.com/ivan1", "мой тг: [SOCIAL_1], [SOCIAL_2]"),
    ("карта 4111 1111 1111 1111.", "карта [CARD_1]."),
    ("в 2024 4111111111111111, 4111-1111-1111-1111", "в 2024 [CARD_1], [CARD_1]"),
    ("12 8 900 123-45-67", "12 [PHONE_1]"),
    ("VIN WDB2130421A123456", "VIN [VIN_1]"),
    ("номер А123ВС77", "номер [PLATE_1]"),
    ("сайт www.site.ru/abc.", "сайт [URL_1]."),
    ("89OO1234567", "[PHONE_1]"),
    ("８９００１２３４５６７", "[PHONE_1]"),
    ("telegram ivan123", "telegram [SOCIAL_1]"),
    ("http://example.com и http://EXAMPLE.com/", "[URL_1] и [URL_1]"),
    ("+49 151 23456789", "[PHONE_1]"),
    ("a@b.ru, c@d.ru, A@B.RU", "[EMAIL_1], [EMAIL_2], [EMAIL_1]"),
]
KEPT = [
    "A 213 885 14 00", "цена 15000 руб", "г.Москва", "4111 1111 1111 1112", "A 960 880 01 05",
    "А000ВС77", "А123ВС00", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "1234567", "артикул 2138851400", "2019-2021", "", "без номера",
]


def test_masked_texts(spark):
    df = spark.createDataFrame(MASKED, "text string, want string")
    bad = [(r.text, r.masked, r.want) for r in mk.mask_texts(df).collect() if r.masked != r.want]
    assert bad == []


def test_kept_texts(spark):
    df = spark.createDataFrame([(t,) for t in KEPT], "text string")
    assert [r.text for r in mk.mask_texts(df).collect() if r.masked != r.text] == []


def test_spans_point_at_the_original(spark):
    text = "те​л: ８９００１２３４５６７ и é é ivan@mail.ru"
    df = spark.createDataFrame([(text,)], "text string")
    found = {s.type: text[s.start : s.end] for s in mk.mask_texts(df).first().spans}
    assert found == {"PHONE": "８９００１２３４５６７", "EMAIL": "ivan@mail.ru"}


def test_long_texts_are_masked_whole(spark):
    text = "а б " * 20_000 + "ivan@mail.ru " * 500 + "x" * 60_000 + " 89001234567"
    df = spark.createDataFrame([(text,), ("ivan@mail.ru",), (None,)], "text string")
    rows = {r.text: (r.masked, r.mask_status) for r in mk.mask_texts(df).collect()}
    want = text.replace("ivan@mail.ru", "[EMAIL_1]").replace("89001234567", "[PHONE_1]")
    assert rows == {text: (want, "masked"), "ivan@mail.ru": ("[EMAIL_1]", "masked"), None: (None, "no_text")}
    fits, long = mk.route_oversize(df, limit=50)
    assert (fits.count(), long.count()) == (2, 1)


def test_addresses_of_many_labels(spark):
    host = "a." * 300 + "ru"
    df = spark.createDataFrame([(t,) for t in (f"u@{host}", host, "x.ru.1", "a@b.ru.12", "г.Москва")], "text string")
    got = {r.text: r.masked for r in mk.mask_texts(df).collect()}
    assert got == {f"u@{host}": "[EMAIL_1]", host: "[URL_1]", "x.ru.1": "[URL_1].1", "a@b.ru.12": "[EMAIL_1].12",
                   "г.Москва": "г.Москва"}


def test_mapping_keeps_the_first_value(spark):
    df = spark.createDataFrame([("89001234567 и +7 900 123 45 67",)], "text string")
    assert mk.token_mappings(df).first().mapping == {"[PHONE_1]": "89001234567"}


@pytest.mark.parametrize("pattern", ["a+", r"\b\w", r"\d\d", "b(?=a)", "^x|y$"])
def test_span_offsets_equal_python(spark, pattern):
    texts = ["aabaa", "", "a", "xay", "12345 б6", "😀a😀aa", "bab a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", spans("t", unicode_regex(pattern, ignore_case=False)).alias("s")).collect()
    for r in got:
        want = [m.span() for m in re.finditer(pattern, r.t) if m.end() > m.start()]
        assert [(s.start, s.end) for s in r.s] == want, r.t


def test_normalisation(spark):
    cases = [
        ("a\u0007b", "ab", 0, 1), ("a​b", "ab", 1, 0), ("№ ⁸ ①", "№ 8 1", 0, 0),
        ("е́", "е", 0, 0), ("٤", "4", 0, 0), ("ｆｕｌｌ", "full", 0, 0), ("plain", "plain", 0, 0),
        ("￼x", "x", 1, 0), ("…", "...", 0, 0), ("x́y", "xy", 0, 0),
    ]
    df = spark.createDataFrame([(t,) for t, *_ in cases], "text string")
    got = {r.text: (r.nt, len(r.hidden), len(r.invalid)) for r in tx.with_views(df).collect()}
    assert got == {t: (n, h, i) for t, n, h, i in cases}


def test_clean_rows_skip_python(spark):
    texts = ["plain ascii", "Россия и ёж", "naïve café", "a – b", "а́"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.c for r in df.select(tx.is_clean(F.col("text")).alias("c")).collect()] == [
        True, True, True, True, False,
    ]


def test_part_numbers(spark):
    df = spark.createDataFrame([("Ищу A 213 885-14 00 или 90915-10003",)], "text string")
    keys = [c.key for c in mk.part_number_candidates(df).first().candidates]
    assert "A2138851400" in keys and "9091510003" in keys
    assert len(keys) == len(set(keys))


@pytest.mark.parametrize(
    "text", ["a." * 10000, "1 " * 10000, "@" * 20000, "8-" * 10000, "а б " * 5000, "a@b" * 6000,
             "www." * 5000, "телег " * 3000, "+" * 20000, "(9" * 10000],
)
def test_hostile_texts_finish(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    mk.mask_texts(df).collect()
    start = time.perf_counter()
    assert mk.mask_texts(df).first().mask_status == "masked"
    assert time.perf_counter() - start < 8


def test_a_batch_is_normalised_in_small_parts():
    """Ten thousand texts of a batch are not held at once, and offsets are four bytes each."""
    import pandas as pd

    from partsight.functions import text as tx

    texts = [None if i % 7 == 0 else "e​x１" * (i % 4) for i in range(1000)]
    parts = list(tx._normalise_udf.func(iter([pd.Series(texts, dtype=object), pd.Series([], dtype=object)])))
    assert len(parts) > 1 and max(map(len, parts)) <= tx._ROWS_AT_ONCE
    rows = pd.concat(parts)
    assert list(rows["text"]) == [None if t is None else "ex1" * (len(t) // 4) for t in texts]
    third = rows.iloc[3]
    assert third["starts"].itemsize == 4 and list(third["starts"]) == [0, 2, 3, 4, 6, 7, 8, 10, 11]
    assert list(third["ends"]) == [1, 3, 4, 5, 7, 8, 9, 11, 12] and [s["start"] for s in third["hidden"]] == [1, 5, 9]


def test_texts_of_one_partition_are_dealt_over_the_cores(spark):
    texts = spark.createDataFrame([(i, f"tel {i}: +7 900 123-45-67") for i in range(640)], "id long, text string").coalesce(1)
    found = mk.mask_texts(texts).select("id", "masked", F.spark_partition_id().alias("p"))
    assert found.agg(F.countDistinct("p")).first()[0] >= 8
    assert found.where("masked = concat('tel ', id, ': [PHONE_1]')").count() == 640
