"""Queries of area B (policy classification).

The corpus has no Cyrillic, so the context rules run on sentences put together with part names; what
they must yield follows from the sentence, which gives the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.functions import literals as lit
from partsight.functions import text as tx
from partsight.operators import policy as pol
from partsight.plans.registry import query
from partsight.rules import policy as R
from partsight.sources.domain import Domain, with_domain


def _parts(d: Domain) -> DataFrame:
    return d["part_text"]


def _said(d: Domain, *sentences: str) -> DataFrame:
    """Draft parts that say one of the sentences (``{}`` is the part name)."""
    text = F.lit(None).cast("string")
    for i, sentence in reversed(list(enumerate(sentences))):
        head, _, tail = sentence.partition("{}")
        said = F.concat(F.lit(head), F.col("p_name"), F.lit(tail)) if "{}" in sentence else F.lit(sentence)
        text = F.when(F.col("p_partkey") % len(sentences) == i, said).otherwise(text)
    return d["part"].select("p_partkey", "p_name").select(
        F.col("p_partkey").alias("draft_id"), F.lit(0).alias("part_index"), text.alias("text"),
        (F.col("p_partkey") % 2 == 0).alias("is_owner_edit"),
        (F.col("p_partkey") % 4 < 2).alias("completion_confirmed"),
        (F.col("p_partkey") % 8 < 4).alias("payment_confirmed"),
    )


def _codes(findings: DataFrame, *codes: str) -> DataFrame:
    return findings.where(F.col("code").isin(*codes)).groupBy("draft_id", "code").agg(
        F.count(F.lit(1)).alias("findings")
    )


def _expected(n: int, cases: dict[int, tuple[str, ...]], findings: int = 1) -> str:
    """Oracle: which codes the sentences yield."""
    rows = [
        f"SELECT p_partkey AS draft_id, '{code}' AS code, CAST({findings} AS BIGINT) AS findings "
        f"FROM part WHERE p_partkey % {n} = {i}"
        for i, codes in cases.items() for code in codes
    ]
    return " UNION ALL ".join(rows)


# -- sizes and segments ------------------------------------------------------------------------------


@query("part_size", """
    SELECT doc_id, length(text) AS code_points, CAST(strlen(text) AS BIGINT) AS utf8_bytes,
      length(text) + length(regexp_replace(text, '[\\x{0000}-\\x{FFFF}]', '', 'g')) AS utf16_units,
      strlen(text) <= 1000 AND length(text) + length(regexp_replace(text,
        '[\\x{0000}-\\x{FFFF}]', '', 'g')) <= 1000 AS fits FROM documents""")
def part_size(d: Domain) -> DataFrame:
    """B01."""
    t = F.col("text")
    return d["documents"].select(
        "doc_id", F.length(t).cast("bigint").alias("code_points"),
        F.octet_length(t).cast("bigint").alias("utf8_bytes"), tx.utf16_units(t).alias("utf16_units"),
        tx.part_fits(t).alias("fits"),
    )


#: Characters in front of the first one beyond 1000 bytes (UTF-16 units are never more than bytes).
_FITTING = "len([k FOR k IN range(1, least(length({0}), 1000) + 1) IF strlen(left({0}, k)) <= 1000])"


@query("part_overflow", f"SELECT doc_id, {_FITTING.format('text')} AS first_beyond FROM documents")
def part_overflow(d: Domain) -> DataFrame:
    """B02."""
    return d["documents"].select("doc_id", tx.first_index_beyond(F.col("text")).alias("first_beyond"))


@query("text_segments", """
    WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text,
      '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+')) AS seg FROM documents)
    SELECT doc_id, count(*) AS sentences, max(length(seg)) AS longest,
      CAST(sum(length(seg)) AS BIGINT) AS chars FROM s GROUP BY doc_id""")
def text_segments(d: Domain) -> DataFrame:
    """B14."""
    rows = d["documents"].withColumn("segs", tx.segments("text", tx.SENTENCE_END))
    sizes = F.transform("segs", lambda s: s["end"] - s["start"])
    return rows.select(
        "doc_id", F.size("segs").cast("bigint").alias("sentences"),
        F.array_max(sizes).cast("bigint").alias("longest"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chars"),
    ).where("sentences > 0")


# -- findings ----------------------------------------------------------------------------------------


@query("policy_basic", f"""
    WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN left(text, 9) || chr(7) || substr(text, 10)
        WHEN 2 THEN left(text, 9) || chr(8203) || substr(text, 10) WHEN 3 THEN ' ' ELSE text END AS text FROM documents)
    SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'INVALID_TEXT:9:10' WHEN 2 THEN 'OBFUSCATION:9:10' WHEN 3 THEN 'EMPTY_PART:0:1' ELSE '' END
      || CASE WHEN strlen(text) > 1000 THEN CASE WHEN doc_id % 5 IN (1, 2) THEN ',' ELSE '' END || 'PART_TOO_LONG:' ||
        {_FITTING.format('text')} || ':' || length(text) ELSE '' END AS codes FROM t""")
def policy_basic(d: Domain) -> DataFrame:
    """All codes with their places; documents with a control character, a hidden one, or nothing but a blank among them."""
    t, k = F.col("text"), F.col("doc_id") % 5

    def with_sign(sign: str) -> F.Column:
        return F.concat(F.left(t, F.lit(9)), F.lit(sign), F.substring(t, F.lit(10), F.length(t)))

    text = F.when(k == 1, with_sign("\u0007")).when(k == 2, with_sign("\u200b")).when(k == 3, F.lit(" ")).otherwise(t)
    basic = pol.basic_findings(tx.with_views(d["documents"].select("doc_id", text.alias("text"))))
    codes = F.transform("basic", lambda f: F.concat_ws(":", f["code"], f["start"], f["end"]))
    return basic.select("doc_id", F.array_join(codes, ",").alias("codes"))


_WORDS = (
    ("DIGITS_NOT_ALLOWED", "text", "[0-9]+"),
    ("W_THE", "text", "the[a-z]*"),
    ("W_AND", "text", "and"),
    ("W_UND", "text", "und[a-z]*"),
)


@query("policy_findings", with_domain("part_text", """,
    t AS (SELECT draft_id, part_index, text FROM part_text),
    f AS (SELECT draft_id, part_index, 'W_THE' AS code,
        len(regexp_extract_all(text, '(?i)the[a-z]*')) AS n FROM t
      UNION ALL SELECT draft_id, part_index, 'W_AND', len(regexp_extract_all(text, '(?i)and')) FROM t
      UNION ALL SELECT draft_id, part_index, 'W_UND',
        len(regexp_extract_all(text, '(?i)und[a-z]*')) FROM t)
    SELECT draft_id, part_index, code, CAST(n AS BIGINT) AS findings FROM f WHERE n > 0"""))
def policy_findings(d: Domain) -> DataFrame:
    """B04 with a caller's rule table (words the corpus has)."""
    found = pol.find(_parts(d), rules=_WORDS)
    return found.where(F.col("code").startswith("W_")).groupBy("draft_id", "part_index", "code").agg(
        F.count(F.lit(1)).alias("findings")
    )


_FAMILIES = (
    "Пишите в телеграм, {}", "Предоплата за {}", "Оплата наличными", "Я менеджер магазина",
    "Позвоните мне", "Отдам {} со скидкой", "Доставим {} завтра", "Заказ оформлен, {}",
    "Оплата получена", "Возможна гарантия на {}", "{} стоит сто рублей", "{{{{total}}}} {}",
)


@query("policy_rules", _expected(12, {
    0: ("CONTACT_CHANNEL", "CONTACT_REDIRECT"), 1: ("PAYMENT_OFF_PLATFORM",),
    2: ("PAYMENT_TERMS_OUTSIDE_RULE",), 3: ("HUMAN_CLAIM",), 4: ("CONTACT_REDIRECT",),
    5: ("PROMISE_DISCOUNT",), 6: ("PROMISE_DELIVERY_DATE",), 7: ("COMPLETION_CLAIM",),
    8: ("PAYMENT_RECEIVED_CLAIM",), 9: ("PROMISE_WARRANTY",), 10: ("NUMBER_WORD", "CURRENCY"),
    11: ("UNRENDERED_TOKEN",)}))
def policy_rules(d: Domain) -> DataFrame:
    """One sentence per family, with the shipped rules."""
    said = _said(d, *[s.replace("{{{{", "{{").replace("}}}}", "}}") for s in _FAMILIES[:11]],
                 "{{total}} for parts")
    return _codes(pol.find(said), *R.CODES)


@query("policy_corpus")
def policy_corpus(d: Domain) -> DataFrame:
    """B03-B14 with the shipped rules over the whole corpus, by code."""
    return pol.find(_parts(d)).groupBy("code").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("draft_id").alias("drafts")
    )


@query("policy_split_stems", _expected(4, {
    0: ("CONTACT_REDIRECT", "OBFUSCATION"), 1: ("PROMISE_DISCOUNT", "OBFUSCATION"),
    2: ("CONTACT_CHANNEL", "OBFUSCATION")}))
def policy_split_stems(d: Domain) -> DataFrame:
    """B06."""
    said = _said(d, "Позв оните, {}", "бес платно {}", "{} what-sapp", "{} есть")
    return _codes(pol.find(said), "CONTACT_REDIRECT", "PROMISE_DISCOUNT", "CONTACT_CHANNEL", "OBFUSCATION")


@query("policy_literal_regions", """
    SELECT p_partkey AS draft_id, CAST(CASE p_partkey % 4 WHEN 0 THEN length(p_name) + 1
      WHEN 1 THEN length(p_name) + 1 WHEN 2 THEN length(p_name) + 3 END AS INTEGER) AS r_start,
      CAST(length(p_name) + CASE p_partkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 10 WHEN 2 THEN 11 END
        AS INTEGER) AS r_end
    FROM part WHERE p_partkey % 4 < 3""")
def policy_literal_regions(d: Domain) -> DataFrame:
    """B07: "15 000 ₽" however it is spaced, but not inside a longer number."""
    said = _said(d, "{} 15 000 ₽", "{} 15  000 ₽.", "{}: (15 000 ₽", "{} 115 000 ₽5")
    said = said.withColumn(
        "text", F.when(F.col("draft_id") % 4 == 2, F.replace("text", F.lit(": ("), F.lit("  ("))).otherwise(F.col("text"))
    )
    literals = said.select("draft_id", F.lit("15 000 ₽").alias("literal"))
    regions = pol.literal_regions(said, literals)
    return regions.select("draft_id", "r_start", "r_end")


@query("policy_literals", _expected(4, {2: ("DIGITS_NOT_ALLOWED",), 3: ("DIGITS_NOT_ALLOWED",)}))
def policy_literals(d: Domain) -> DataFrame:
    """B09 for literals: numbers from the record pass, others do not."""
    said = _said(d, "{} 15000", "{}", "{} 15001", "{} 150000")
    literals = said.select("draft_id", F.lit("15000").alias("literal"))
    left = pol.lift_by_literals(pol.find(said), pol.literal_regions(said, literals))
    return _codes(left, "DIGITS_NOT_ALLOWED")


@query("policy_negation", _expected(5, {0: ("PROMISE_DISCOUNT",), 3: ("PROMISE_DISCOUNT",)}))
def policy_negation(d: Domain) -> DataFrame:
    """B12 + B15: a negated promise passes, a double negation does not."""
    said = _said(d, "Скидка на {}", "Скидки нет, {}", "Не даём скидок", "Не уступить вам нельзя",
                 "Возврат по правилам Авито")
    return _codes(pol.find(said), "PROMISE_DISCOUNT", "PROMISE_RETURN")


@query("policy_hedge", _expected(4, {0: ("UNVERIFIED_FITMENT",)}))
def policy_hedge(d: Domain) -> DataFrame:
    """Questions and announced checks pass, claims do not."""
    said = _said(d, "{} подойдёт. Ура", "Подойдёт ли {}?", "Проверим, подойдёт {}", "{} не подойдёт")
    return _codes(pol.find(said), "UNVERIFIED_FITMENT")


@query("policy_claims", """
    SELECT p_partkey AS draft_id, 'COMPLETION_CLAIM' AS code, CAST(1 AS BIGINT) AS findings FROM part
      WHERE p_partkey % 4 IN (0, 2) AND NOT p_partkey % 4 < 2
    UNION ALL SELECT p_partkey, 'PAYMENT_RECEIVED_CLAIM', 1 FROM part
      WHERE p_partkey % 4 = 1 AND NOT p_partkey % 8 < 4""")
def policy_claims(d: Domain) -> DataFrame:
    """A claim in a confirmation span passes only if the record confirms it."""
    said = _said(d, "Заказ оформлен", "Оплата получена", "Заказ оформлен", "{}")
    spans = said.select("draft_id", "part_index", F.lit("confirmation").alias("kind"),
                        F.lit(0).alias("s_start"), F.lit(200).alias("s_end"))
    flags = said.select("draft_id", "completion_confirmed", "payment_confirmed")
    left = pol.lift_by_templates(pol.find(said), spans, flags)
    return _codes(left, "COMPLETION_CLAIM", "PAYMENT_RECEIVED_CLAIM")


# -- joins on finding rows ---------------------------------------------------------------------------

_FOUND = """
found AS (
  SELECT l_orderkey AS draft_id, l_linenumber % 3 AS part_index,
    CASE l_suppkey % 8 WHEN 0 THEN 'DIGITS_NOT_ALLOWED' WHEN 1 THEN 'CURRENCY' WHEN 2
      THEN 'PROMISE_RETURN' WHEN 3 THEN 'PAYMENT_TERMS_OUTSIDE_RULE' WHEN 4 THEN 'NUMBER_WORD'
      WHEN 5 THEN 'CONTACT_PHONE' WHEN 6 THEN 'HUMAN_CLAIM' ELSE 'COMPLETION_CLAIM' END AS code,
    CAST(l_partkey % 90 AS INTEGER) AS start,
    CAST(l_partkey % 90 + 1 + l_quantity AS INTEGER) AS "end",
    l_suppkey % 8 = 4 AND l_partkey % 5 = 0 AS is_percent
  FROM lineitem),
span AS (
  SELECT o_orderkey AS draft_id, k AS part_index, CASE (o_orderkey + k) % 5 WHEN 0
      THEN 'rule_payment' WHEN 1 THEN 'rule_generic' WHEN 2 THEN 'offer' WHEN 3 THEN 'confirmation'
      ELSE 'bot_disclosure' END AS kind, CAST(o_custkey % 40 AS INTEGER) AS s_start,
    CAST(o_custkey % 40 + 60 AS INTEGER) AS s_end
  FROM orders, (VALUES (0), (1), (2)) v(k))"""
_SPARK_FOUND = (
    _FOUND.split("),\nspan AS")[0].replace("\nfound AS (", "").replace('"end"', "`end`")
    .replace("FROM lineitem", "FROM {lineitem}")
)
_SPARK_SPANS = (
    _FOUND.split("span AS (")[1].rsplit(")", 1)[0]
    .replace("FROM orders, (VALUES (0), (1), (2)) v(k)",
             "FROM (SELECT *, explode(array(0, 1, 2)) AS k FROM {orders})")
)


def _found(d: Domain) -> DataFrame:
    return d.spark.sql(_SPARK_FOUND, lineitem=d["lineitem"])


def _spans(d: Domain) -> DataFrame:
    return d.spark.sql(_SPARK_SPANS, orders=d["orders"])


_EXEMPT_SQL = " OR ".join(
    f"(f.code = '{c}' AND s.kind IN ({', '.join(repr(k) for k in ks)}))" for c, ks in R.EXEMPT_IN.items()
)
_LEFT = f"""WITH {_FOUND},
flagged AS (SELECT *, draft_id % 2 = 0 AS completion_confirmed FROM found),
left_over AS (SELECT f.* FROM flagged f WHERE NOT EXISTS (SELECT 1 FROM span s
  WHERE s.draft_id = f.draft_id AND s.part_index = f.part_index AND s.s_start <= f.start
    AND f."end" <= s.s_end AND ({_EXEMPT_SQL} OR (f.is_percent AND s.kind = 'rule_payment'))
    AND (f.code <> 'COMPLETION_CLAIM' OR f.completion_confirmed)))"""


def _left(d: Domain) -> DataFrame:
    flags = d["orders"].select(
        F.col("o_orderkey").alias("draft_id"), (F.col("o_orderkey") % 2 == 0).alias("completion_confirmed"),
        F.lit(False).alias("payment_confirmed"),
    )
    return pol.lift_by_templates(_found(d), _spans(d), flags)


@query("policy_exempt", _LEFT + """
    SELECT draft_id, part_index, code, start, "end" FROM left_over""")
def policy_exempt(d: Domain) -> DataFrame:
    """B09 + B16 on finding rows."""
    return _left(d).select("draft_id", "part_index", "code", "start", "end")


_PARTS_SQL = """, parts AS (SELECT o_orderkey AS draft_id, k AS part_index,
      o_orderkey % 3 = 0 AS is_owner_edit FROM orders, (VALUES (0), (1), (2)) v(k)),
    pc AS (SELECT draft_id, part_index, code, count(*) AS n, min((start, "end")) AS first
           FROM left_over GROUP BY ALL),
    pv AS (SELECT draft_id, part_index, CAST(sum(n) AS BIGINT) AS findings,
        bool_or(code IN ('EMPTY_PART', 'PART_TOO_LONG', 'INVALID_TEXT', 'PAYMENT_CARD',
                         'CONTACT_PHONE')) AS hard,
        string_agg(code, '|' ORDER BY first, code) AS codes FROM pc GROUP BY ALL),
    verdict AS (SELECT p.*, v.findings IS NULL AS allowed,
        is_owner_edit AND v.findings IS NOT NULL AND NOT coalesce(v.hard, false) AS overridable,
        coalesce(v.findings, 0) AS findings, coalesce(v.codes, '') AS codes
      FROM parts p LEFT JOIN pv v ON v.draft_id = p.draft_id AND v.part_index = p.part_index)"""


def _order_parts(d: Domain) -> DataFrame:
    return d["orders"].select(
        F.col("o_orderkey").alias("draft_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("part_index"),
        (F.col("o_orderkey") % 3 == 0).alias("is_owner_edit"),
    )


@query("policy_part_verdict", _LEFT + _PARTS_SQL + """
    SELECT draft_id, part_index, allowed, overridable, findings, codes FROM verdict""")
def policy_part_verdict(d: Domain) -> DataFrame:
    """B17."""
    verdicts = pol.part_verdicts(_order_parts(d), _left(d))
    return verdicts.select(
        "draft_id", "part_index", "allowed", "overridable", "findings",
        F.array_join("codes", "|").alias("codes"),
    )


@query("policy_draft_verdict", _LEFT + _PARTS_SQL + """,
    dc AS (SELECT draft_id, string_agg(code, '|' ORDER BY first, code) AS codes FROM (
             SELECT draft_id, code, min((part_index, start, "end")) AS first FROM left_over
             GROUP BY ALL) GROUP BY draft_id)
    SELECT v.draft_id, count(*) AS parts, bool_and(allowed) AS allowed,
      bool_or(is_owner_edit) AND NOT bool_and(allowed) AND bool_and(allowed OR overridable)
        AS overridable, coalesce(max(dc.codes), '') AS codes
    FROM verdict v LEFT JOIN dc ON dc.draft_id = v.draft_id GROUP BY v.draft_id""")
def policy_draft_verdict(d: Domain) -> DataFrame:
    """B18."""
    left = _left(d)
    verdicts = pol.draft_verdicts(pol.part_verdicts(_order_parts(d), left), left)
    return verdicts.select(
        "draft_id", "parts", "allowed", "overridable", F.array_join("codes", "|").alias("codes")
    )


@query("policy_check")
def policy_check(d: Domain) -> DataFrame:
    """B01-B20 end to end over the corpus, with literals and template spans."""
    parts = _parts(d)
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{2,6}"), F.lit(0)))
    literals = parts.select("draft_id", F.explode(numbers).alias("literal")).distinct()
    spans = parts.select(
        "draft_id", "part_index", F.lit("rule_generic").alias("kind"), F.lit(0).alias("s_start"),
        F.lit(200).alias("s_end"),
    )
    _, _, drafts = pol.check_parts(parts, literals.where("literal <> ''"), spans)
    return drafts.withColumn("codes", F.array_join("codes", "|"))


@query("policy_pii_codes", """
    WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'SOCIAL'
      WHEN 2 THEN 'URL' WHEN 3 THEN 'CARD' WHEN 4 THEN 'PHONE' WHEN 5 THEN 'VIN' ELSE 'PLATE' END
      AS type FROM events)
    SELECT event_id, CASE type WHEN 'PHONE' THEN 'CONTACT_PHONE' WHEN 'EMAIL' THEN 'CONTACT_EMAIL'
      WHEN 'SOCIAL' THEN 'CONTACT_SOCIAL' WHEN 'URL' THEN 'URL_NOT_ALLOWED' WHEN 'CARD'
      THEN 'PAYMENT_CARD' ELSE 'DIGITS_NOT_ALLOWED' END AS code FROM t""")
def policy_pii_codes(d: Domain) -> DataFrame:
    """Values of all seven types in a sentence, and the code each one gets."""
    k = F.col("event_id") % 7
    n = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    value = (
        F.when(k == 0, F.concat(F.lit("u"), n, F.lit("@mail.ru")))
        .when(k == 1, F.concat(F.lit("@user_"), n))
        .when(k == 2, F.concat(F.lit("https://example.com/a"), n))
        .when(k == 3, F.lit("4111 1111 1111 1111"))
        .when(k == 4, F.concat(F.lit("+7 900 123 "), F.substring(n, 1, 2), F.lit(" "), F.substring(n, 3, 2)))
        .when(k == 5, F.concat(F.lit("WDB2130421A12"), n))
        .otherwise(F.lit("А123ВС77"))
    )
    parts = d["events"].select("event_id").select(
        F.col("event_id").alias("draft_id"), F.lit(0).alias("part_index"),
        F.concat(F.lit("See: "), value, F.lit(" .")).alias("text"),
    )
    wanted = (*R.PII_CODES.values(), "DIGITS_NOT_ALLOWED")
    return pol.find(parts, rules=R.RULES).where(F.col("code").isin(*wanted)).select(
        F.col("draft_id").alias("event_id"), "code"
    ).distinct()


_HOSTS = ("example.com", "example.org")


@query("url_allowlist", """
    WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
      regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) AS path,
      regexp_extract(url, '\\?(.*)$', 1) AS query FROM pages)
    SELECT page_id, regexp_full_match(url, '(?i)https?://[a-z0-9.-]+\\.[a-z]{2,24}(/[a-z0-9._~/-]*)?(\\?[a-z0-9._~=&-]*)?')
      AND (host IN ('example.com', 'example.org') OR host LIKE '%.example.com'
           OR host LIKE '%.example.org')
      AND path NOT LIKE '%//%' AND NOT regexp_matches(query, '(?i)[a-z0-9-]+\\.[a-z]{2,}')
      AND NOT regexp_matches(path || query, '[0-9]{5,}') AS allowed FROM u""")
def url_allowlist(d: Domain) -> DataFrame:
    """B11 on the page URLs."""
    return d["pages"].select("page_id", F.expr(pol.url_allowed_sql("url", _HOSTS)).alias("allowed"))


@query("literal_variants", """
    WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'price' WHEN 1 THEN 'quantity'
        WHEN 2 THEN 'model' WHEN 3 THEN 'tire' ELSE 'engine_volume' END AS kind,
      CASE p_partkey % 5 WHEN 0 THEN CAST(1000 + p_partkey * 7 AS STRING) || ' ₽'
        WHEN 1 THEN CAST(p_size AS STRING) || ' шт'
        WHEN 2 THEN 'E' || CAST(100 + p_partkey % 900 AS STRING)
        WHEN 3 THEN CAST(150 + p_size AS STRING) || '/55 r16'
        ELSE CAST(p_size AS STRING) || ',5' END AS value,
      CAST(1000 + p_partkey * 7 AS STRING) AS num, CAST(p_size AS STRING) AS n,
      CAST(100 + p_partkey % 900 AS STRING) AS m, CAST(150 + p_size AS STRING) AS w FROM part),
    g AS (SELECT *, CASE WHEN length(num) > 6 THEN num[:-7] || ' ' || num[-6:-4] || ' ' || num[-3:]
                    ELSE num[:-4] || ' ' || num[-3:] END AS gr FROM v),
    f AS (SELECT p_partkey, value, CASE kind
      WHEN 'price' THEN [gr || ' ₽', gr || '₽', gr || ' руб.', gr || ' руб', num || ' ₽', num || '₽',
                         num || ' руб.', num || ' руб']
      WHEN 'quantity' THEN [n || ' шт.', n || ' шт', n || 'шт.', n || 'шт']
      WHEN 'model' THEN ['E' || m, 'E ' || m]
      WHEN 'tire' THEN [w || '/55 R16', w || '/55R16', w || ' / 55 R16']
      ELSE [n || '.5', n || ',5'] END AS forms FROM g)
    SELECT p_partkey, variant FROM (
      SELECT p_partkey, value AS variant FROM f UNION SELECT p_partkey, unnest(forms) FROM f)""")
def literal_variants(d: Domain) -> DataFrame:
    """B08."""
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, "price").when(k == 1, "quantity").when(k == 2, "model").when(
        k == 3, "tire").otherwise("engine_volume")
    value = (
        F.when(k == 0, F.concat((1000 + F.col("p_partkey") * 7).cast("string"), F.lit(" ₽")))
        .when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(" шт")))
        .when(k == 2, F.concat(F.lit("E"), (100 + F.col("p_partkey") % 900).cast("string")))
        .when(k == 3, F.concat((150 + F.col("p_size")).cast("string"), F.lit("/55 r16")))
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    )
    rows = d["part"].select("p_partkey", kind.alias("kind"), value.alias("value"))
    return rows.select(
        "p_partkey", F.explode(lit.literal_variants(F.col("value"), F.col("kind"))).alias("variant")
    )


@query("policy_input_dq", f"""WITH {_FOUND},
    p AS (SELECT doc_id // 10 AS draft_id, doc_id % 10 AS part_index, length(text) AS chars
          FROM documents)
    SELECT coalesce(CASE WHEN p.chars IS NULL THEN 'no_such_part' WHEN NOT (s_start >= 0
      AND s_start < s_end AND s_end <= chars) THEN 'out_of_range' END, 'ok') AS problem, kind,
      count(*) AS spans
    FROM span s LEFT JOIN p ON p.draft_id = s.draft_id AND p.part_index = s.part_index
    GROUP BY ALL""")
def policy_input_dq(d: Domain) -> DataFrame:
    """B19."""
    checked = pol.check_spans(_spans(d), _parts(d))
    return checked.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem"), "kind").agg(
        F.count(F.lit(1)).alias("spans")
    )
