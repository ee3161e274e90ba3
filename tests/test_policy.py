"""Golden texts per code, context rules, literals, templates, verdicts, no leaks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from partsight.functions import literals as lit
from partsight.functions import text as tx
from partsight.operators import policy as pol
from partsight.rules import policy as R

CASES = [
    ("Скидка будет", {"PROMISE_DISCOUNT"}), ("Скидки нет", set()), ("Не даём скидок", set()),
    ("Не уступить вам просто нельзя!", {"PROMISE_DISCOUNT"}),
    ("нет проблем, скидка", {"PROMISE_DISCOUNT"}),
    ("позвоните мне", {"CONTACT_REDIRECT"}), ("Позв оните", {"CONTACT_REDIRECT", "OBFUSCATION"}),
    ("Деталь подойдёт", {"UNVERIFIED_FITMENT"}), ("Подойдёт ли деталь?", set()),
    ("Проверим, подойдёт", set()), ("не подойдёт", set()),
    ("Возврат по правилам Авито", set()), ("Возврат в течение недели", {"PROMISE_RETURN"}),
    ("Заказ оформлен", {"COMPLETION_CLAIM"}), ("Оплата получена", {"PAYMENT_RECEIVED_CLAIM"}),
    ("цена 15000 руб.", {"CURRENCY", "DIGITS_NOT_ALLOWED"}), ("СТО рядом", set()),
    ("сто рублей", {"CURRENCY", "NUMBER_WORD"}), ("переведите на карту", {"PAYMENT_OFF_PLATFORM"}),
    ("тел 89001234567", {"CONTACT_PHONE"}), ("пишите ivan@mail.ru", {"CONTACT_EMAIL"}),
    ("сайт www.foo.ru", {"URL_NOT_ALLOWED"}), ("Я менеджер", {"HUMAN_CLAIM"}),
    ("доставим завтра", {"PROMISE_DELIVERY_DATE"}), ("{{total}}", {"UNRENDERED_TOKEN"}),
    ("  ", {"EMPTY_PART"}), ("whatsapp", {"CONTACT_CHANNEL"}), ("ok great", set()),
    ("Cкидка", {"PROMISE_DISCOUNT", "OBFUSCATION"}), ("a​b", {"OBFUSCATION"}),
    ("a\u0007b", {"INVALID_TEXT"}), ("х" * 600, {"PART_TOO_LONG"}),
    ("т е л е г р а м", {"CONTACT_CHANNEL", "OBFUSCATION"}), ("ѕcript", {"OBFUSCATION"}),
    ("Mercedesа", set()), ("гарантия год", {"PROMISE_WARRANTY"}),
    ("Бронирую для вас", {"COMPLETION_CLAIM"}), ("Никому не продам", {"COMPLETION_CLAIM"}),
    ("деталь ваша", {"COMPLETION_CLAIM"}), ("снял с продажи", {"COMPLETION_CLAIM"}),
    ("посылка едет", {"COMPLETION_CLAIM"}), ("Платёж поступил", {"PAYMENT_RECEIVED_CLAIM"}),
    ("Оплатите на киви", {"PAYMENT_OFF_PLATFORM"}), ("Юкасса", {"PAYMENT_OFF_PLATFORM"}),
    ("Иван на связи", {"HUMAN_CLAIM"}), ("с уважением, Иван", {"HUMAN_CLAIM"}), ("Ivan here", {"HUMAN_CLAIM"}),
    ("иван на связи", set()), ("обсудим цену", {"PROMISE_DISCOUNT"}),
    ("Kargo yarın teslim", {"PROMISE_DELIVERY_DATE"}), ("Пишите в личку", {"CONTACT_CHANNEL", "CONTACT_REDIRECT"}),
    ("номер детали", set()), ("отправлю фото завтра", set()), ("Оплата картой при получении", {"PAYMENT_TERMS_OUTSIDE_RULE"}),
    ("Я бот-помощник", set()), ("Меня зовут помощник", set()), ("меня зовут Олег", {"HUMAN_CLAIM"}),
    ("привезём через неделю", {"PROMISE_DELIVERY_DATE"}), ("Спасибо за оплату", {"PAYMENT_RECEIVED_CLAIM"}),
    ("foo.ru.1", {"URL_NOT_ALLOWED", "DIGITS_NOT_ALLOWED"}), ("foo (dot) ru", {"URL_NOT_ALLOWED", "CONTACT_EMAIL"}),
    ("ok", set()), ("нал", {"PAYMENT_TERMS_OUTSIDE_RULE"}), ("refund", {"PROMISE_RETURN"}), ("two lira", {"NUMBER_WORD", "CURRENCY"}),
    ("х" * 5000 + " позвоните мне", {"PART_TOO_LONG", "CONTACT_REDIRECT"}), (" ".join("абвг" * 300), {"OBFUSCATION", "PART_TOO_LONG"}),
]


def _parts(spark, texts):
    return spark.createDataFrame(
        [(i, 0, t, i % 2 == 0, False, False) for i, t in enumerate(texts)],
        "draft_id int, part_index int, text string, is_owner_edit boolean, "
        "completion_confirmed boolean, payment_confirmed boolean",
    )


def test_codes(spark):
    got: dict[int, set[str]] = {i: set() for i in range(len(CASES))}
    for r in pol.find(_parts(spark, [t for t, _ in CASES])).collect():
        got[r.draft_id].add(r.code)
    assert [(t, got[i], w) for i, (t, w) in enumerate(CASES) if got[i] != w] == []


def test_findings_hold_no_text(spark):
    found = pol.find(_parts(spark, ["canary-77@mail.ru скидка"]))
    assert set(found.columns) == {"draft_id", "part_index", "code", "start", "end", "is_percent"}
    assert not any("canary" in str(v) for r in found.collect() for v in r)


def test_literals_lift_numbers(spark):
    parts = _parts(spark, ["цена 15 000 ₽", "цена 15 001 ₽", "цена 115 000 ₽"])
    literals = spark.createDataFrame([(i, "15 000 ₽") for i in range(3)], "draft_id int, literal string")
    left = pol.lift_by_literals(pol.find(parts), pol.literal_regions(parts, literals))
    assert {r.draft_id for r in left.collect()} == {1, 2}


def test_template_spans(spark):
    parts = _parts(spark, ["скидка 5%", "скидка", "Заказ оформлен", "Заказ оформлен"])
    spans = spark.createDataFrame(
        [(0, 0, "rule_payment", 0, 9), (1, 0, "rule_generic", 0, 6), (2, 0, "confirmation", 0, 14),
         (3, 0, "confirmation", 0, 14)],
        "draft_id int, part_index int, kind string, s_start int, s_end int",
    )
    flags = spark.createDataFrame(
        [(0, False, False), (1, False, False), (2, True, False), (3, False, False)],
        "draft_id int, completion_confirmed boolean, payment_confirmed boolean",
    )
    left = {(r.draft_id, r.code) for r in pol.lift_by_templates(pol.find(parts), spans, flags).collect()}
    assert left == {(0, "PROMISE_DISCOUNT"), (3, "COMPLETION_CLAIM")}


def test_verdicts(spark):
    parts = _parts(spark, ["скидка", "тел 89001234567", "привет", "скидка"])
    _, verdicts, drafts = pol.check_parts(parts)
    got = {r.draft_id: (r.allowed, r.overridable, tuple(r.codes)) for r in verdicts.collect()}
    assert got == {
        0: (False, True, ("PROMISE_DISCOUNT",)), 1: (False, False, ("CONTACT_PHONE",)),
        2: (True, False, ()), 3: (False, False, ("PROMISE_DISCOUNT",)),
    }
    assert {r.draft_id: (r.allowed, r.overridable) for r in drafts.collect()} == {
        0: (False, True), 1: (False, False), 2: (True, False), 3: (False, False),
    }


@pytest.mark.parametrize(
    "url,ok",
    [("https://www.market.example/item/12", True), ("market.example", True), ("https://evil-market.example", False),
     ("https://market.example//x", False), ("https://market.example/?q=foo.com", False),
     ("https://market.example/12345", False), ("https://market.example/telegram", False)],
)
def test_url_allowlist(spark, url, ok):
    expr = pol.url_allowed_sql("url", ("market.example",))
    assert spark.createDataFrame([(url,)], "url string").selectExpr(f"{expr} AS ok").first().ok is ok


def test_literal_variants(spark):
    rows = [("15000 ₽", "price"), ("2 шт", "quantity"), ("E200", "model"), ("205/55 r16", "tire"),
            ("A2138851400", "oem"), ("2,0", "engine_volume"), ("W213", "other")]
    df = spark.createDataFrame(rows, "v string, k string")
    got = {r.k: r.f for r in df.select("k", lit.literal_variants(F.col("v"), F.col("k")).alias("f")).collect()}
    assert got["price"][:4] == ["15000 ₽", "15 000 ₽", "15 000₽", "15 000 руб."]
    assert got["model"] == ["E200", "E 200"]
    assert got["oem"] == ["A2138851400", "A 213 885 14 00"]
    assert got["tire"][1:] == ["205/55 R16", "205/55R16", "205 / 55 R16"]
    assert got["engine_volume"] == ["2,0", "2.0"]
    assert got["other"] == ["W213"]


def test_sizes(spark):
    texts = ["a" * 1000, "a" * 1001, "😀" * 251, "ж" * 501, "é" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", tx.part_fits(F.col("text")).alias("fits"),
                       tx.first_index_beyond(F.col("text")).alias("i")).collect():
        fits = len(r.text.encode()) <= 1000 and len(r.text.encode("utf-16-le")) // 2 <= 1000
        n = next((k for k in range(len(r.text)) if len(r.text[: k + 1].encode()) > 1000), len(r.text))
        assert (r.fits, r.i) == (fits, n)


def test_needed_words_are_necessary(spark):
    """A text that matches a pattern holds one of the words the probe asks for."""
    assert pol._needed_words(r"\bскид(?:к|оч)\w*|\bуступ\w*") == ["скид", "уступ"]
    assert pol._needed_words(r"(?<!a)\s?р\.?(?!\w)") == ["р"]
    assert pol._needed_words(r"[0-9]+") is None
    assert pol._needed_words(r"ab?c|x(?:yy|zzz)?") == ["a", "x"]
    assert pol._alternatives(r"a|(b|c)|[|]|\|") == ["a", "(b|c)", "[|]", r"\|"]


def test_words_left_out_without_cyrillic_cannot_occur():
    signs = [chr(i) for i in range(0x10000) if not 0x400 <= i <= 0x45F and not 0xD800 <= i < 0xE000]
    folds = {"cyr": str.maketrans(*tx.LAT_TO_CYR), "lat": str.maketrans(*tx.CYR_TO_LAT), "nt": {}}
    reached = {view: set("".join(signs).translate(fold).lower()) for view, fold in folds.items()}
    words = {(pol._VIEW[script], w) for _, script, p in R.RULES for w in pol._needed_words(p) or ()}
    words |= {(pol._VIEW[script], stem) for _, script, stems in R.SPLIT_STEMS for stem in stems}
    gated = {(view, w) for view, w in words if pol._needs_cyrillic(view, w)}
    assert len(gated) > len(words) // 2
    assert all(set(w) - reached[view] for view, w in gated)
    # A word of look-alikes alone is looked for in every text.
    assert not pol._needs_cyrillic("cyr", "рекх") and pol._needs_cyrillic("nt", "рекх")


@pytest.mark.parametrize("text", ["Oплата получена", "нeт, cкидкa будет"])
def test_words_with_some_look_alikes_are_found(spark, text):
    parts = spark.createDataFrame([(1, 0, text)], "draft_id long, part_index int, text string")
    assert {r.code for r in pol.find(parts).collect()} & {"PAYMENT_RECEIVED_CLAIM", "PROMISE_DISCOUNT"}


def test_cyrillic_words_are_not_looked_for_one_by_one():
    codes = dict.fromkeys(c for c, script, _ in R.RULES if script == "cyr")
    assert any("has_cyrillic AND (" in pol._by_code(R.RULES, code) for code in codes)


def test_signs_that_may_be_foreign_are_looked_at(spark):
    signs = spark.createDataFrame([(chr(i),) for i in [*range(1, 0xD800), *range(0xE000, 0x11000), 0x1D400, 0x20000]], "c string")
    foreign = signs.where(F.expr(tx.rlike_sql("c", tx.unicode_regex(tx._FOREIGN, ignore_case=False))))
    assert foreign.count() > 40_000 and foreign.where(~F.col("c").rlike(tx._MAY_BE_FOREIGN)).count() == 0
    text = "Größe, naïve “Ёлка” – 5 €…"
    assert spark.range(1).where(F.lit(text).rlike(tx._MAY_BE_FOREIGN)).count() == 0


def test_texts_without_cyrillic_are_scanned_for_what_can_match_there(spark):
    """What a pattern loses matches no text of Latin letters, folded or not; the rest matches as before."""
    assert pol._without_cyrillic("cyr", r"\bна\s(?:карту|счёт)\b|\bскидк\w*|з?[й(]ок") == r"\bна\s(?:карту)\b|з?[й(]ок"
    assert pol._without_cyrillic("cyr", r"жди|(?:щи|юг)+") is None and pol._without_cyrillic("lat", r"a(?:б|c)?(?!д)") == r"a(?:б|c)?(?!д)"
    cut = {}
    for code, script, pattern in R.RULES:
        rest = pol._without_cyrillic(pol._VIEW[script], pattern)
        if rest != pattern:
            cut[pattern] = (pol._VIEW[script], code, rest)
    assert len(cut) > 20
    back = str.maketrans(tx.LAT_TO_CYR[1][:24], tx.LAT_TO_CYR[0][:24])
    spoken = sorted({w for _, _, p in R.RULES for w in pol._needed_words(p) or ()})
    rnd = random.Random(2)
    texts = ["".join(c for c in " ".join(rnd.choices([*spoken, "5"], k=400)).translate(back) if not "Ѐ" <= c <= "ӿ") for _ in range(20)]
    texts += ["Ha kapTy, aBaHc, 5 p. T.p. Bk; BcTaHeT; CTo TpoE; MoE HoMep; BepHy BaM "]
    views = tx.with_views(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    found = 0
    for pattern, (view, _, rest) in cut.items():
        whole = F.size(F.expr(tx.spans_sql(view, tx.unicode_regex(pattern))))
        less = F.lit(0) if rest is None else F.size(F.expr(tx.spans_sql(view, tx.unicode_regex(rest))))
        row = views.agg(F.sum(whole).alias("whole"), F.sum(less).alias("less")).collect()[0]
        assert row.whole == row.less, pattern
        found += row.whole
    assert found > 10


def test_many_findings_of_one_part_are_told_apart(spark):
    """Findings of one text are numbers until they are rows; equal ones count once, places and codes come back."""
    text = " ".join(str(i) for i in range(400)) + " ﬁ5"
    got = pol.find(spark.createDataFrame([(1, 0, text)], "draft_id long, part_index int, text string"))
    assert "array_distinct" in got._jdf.queryExecution().optimizedPlan().toString()
    digits = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text)]
    rows = got.where("code = 'DIGITS_NOT_ALLOWED'").collect()
    assert sorted((r.start, r.end) for r in rows) == digits
    pairs = [f for f in got._jdf.queryExecution().optimizedPlan().toString().split("array_distinct(") if f.startswith("concat(transform(basic")]
    assert pairs and all("shiftleft" in f for f in pairs)


def test_detectors_run_once_for_both_verdicts(spark):
    rows = [(1, 0, "Оплата получена 5", True, True, True), (1, 1, "скидка", True, False, False)]
    parts = spark.createDataFrame(rows, "draft_id long, part_index int, text string, is_owner_edit boolean, completion_confirmed boolean, payment_confirmed boolean")
    _, verdicts, drafts = pol.check_parts(parts, spark.createDataFrame([(1, "5")], "draft_id long, literal string"))
    for found in (verdicts, drafts):
        assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "PROMISE_DISCOUNT" in drafts.collect()[0].codes
