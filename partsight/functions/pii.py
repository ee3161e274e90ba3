"""Personal data in normalised text, as array expressions over the view columns.

Expects the columns of ``with_views``. Everything stays in one row: no shuffle, no self-join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.functions.spans import (
    head_sql, quote, rlike_sql, span_sql, spans_sql, trimmed_sql, unicode_regex,
)
from partsight.functions.markdown import let
from partsight.functions.text import to_original
from partsight.rules import pii as P

CANDIDATE = "array<struct<type:string,rank:int,start:int,end:int>>"


def _typed(found: str, pii_type: str) -> str:
    return (
        f"transform({found}, s -> struct('{pii_type}' AS type, {P.TYPES.index(pii_type)} AS rank, "
        "s.start AS start, s.`end` AS `end`))"
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digits_sql(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _links(view: str) -> list[str]:
    """Addresses, handles and links of one view."""
    sign, slash = f"contains({view}, '@')", f"contains({view}, '/')"
    dotted = rlike_sql(view, rf"(?iu)\.(?:{P.LATIN_TLDS})")
    dotted_cyr = rlike_sql(view, rf"(?iu)\.(?:{P.CYRILLIC_TLDS})")
    web = rlike_sql(view, r"(?i)://|www\.")
    word = rlike_sql(view, rf"(?iu)(?<![a-zа-яё])(?:{P.HANDLE_STEMS})")

    def at(pattern: str, probe: str, **kw: str) -> str:
        return spans_sql(view, unicode_regex(pattern), probe=probe, **kw)

    def cut(found: str) -> str:
        return trimmed_sql(view, found, P.TRAILING_PUNCTUATION)

    def head(found: str, pattern: str) -> str:
        return head_sql(view, found, unicode_regex(pattern))

    value = span_sql(view)
    host = (
        f"regexp_replace(substring_index(regexp_replace(lower({value}), '^https?://', ''), '/', 1), "
        f"{quote(r'^(?:www|m)[.]')}, '')"
    )
    hosts = ", ".join(quote(h) for h in P.SOCIAL_HOSTS)
    longest, shortest = P.HANDLE_LENGTH[1], P.HANDLE_LENGTH[0]
    # One scan finds the tokens for both kinds of bare hosts.
    bare = at(P.DOTTED, f"({dotted} OR {dotted_cyr})")
    named = (
        f"filter({at(P.KEYWORD_HANDLE, word, before='$1', wrap='$2')}, s -> s.`end` - s.start "
        f"BETWEEN {shortest} AND {longest} AND NOT rlike({value}, {quote(P.NOT_A_HANDLE)}))"
    )
    handles = (
        f"filter({at(P.HANDLE, sign)}, s -> s.`end` - s.start BETWEEN {shortest + 1} AND {longest + 1} "
        f"AND {rlike_sql(value, '^@[^0-9_.]')})"
    )
    return [
        _typed(head(at(P.MAIL_TOKEN, sign), P.MAIL), "EMAIL"),
        _typed(cut(f"filter({at(P.LINK_TOKEN, slash)}, s -> {host} IN ({hosts}))"), "SOCIAL"),
        _typed(cut(handles), "SOCIAL"),
        _typed(cut(named), "SOCIAL"),
        _typed(cut(at(P.URL_SCHEME, web)), "URL"),
        _typed(cut(head(bare, P.BARE_HOST)), "URL"),
        _typed(cut(head(bare, P.BARE_HOST_CYRILLIC)), "URL"),
    ]


def is_card(value: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    digits = _digits(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _is_card_sql(value: str) -> str:
    digits = _digits_sql(value)
    return f"length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits})"


def _is_phone_sql(value: str) -> str:
    """Russian numbering and grouping rules, read off the digits with one blank per separator."""
    plus = f"startswith(trim(LEADING '(' FROM {value}), '+')"
    spaced = f"trim(regexp_replace({value}, '[^0-9]+', ' '))"
    n = f"length({_digits_sql(value)})"
    # Groups of the ten core digits: none, all single, or a break after three (then 5, 6, 7, 8).
    core = r"(?:\d{10}|\d(?: \d){9}|\d{3} \d{2} ?\d ?\d ?\d ?\d{2})"
    is_mobile = f"({n} = 11 AND {rlike_sql(spaced, '^[78] ?9')})"
    mobile = f"(NOT {plus} OR startswith({spaced}, '7'))"
    starts = f"IF({plus}, {rlike_sql(spaced, '^7 ?[3-9]')}, {rlike_sql(spaced, '^[78] ?[3-9]')})"
    city = f"({n} = 11 AND {starts} AND {rlike_sql(spaced, rf'^{chr(92)}d ?{core}$')})"
    short = (
        f"({n} = 10 AND NOT {plus} AND startswith({spaced}, '9') "
        f"AND {rlike_sql(spaced, f'^{core}$')})"
    )
    return f"IF({is_mobile}, {mobile}, {city} OR {short})"


_WINDOW = (
    "struct<start:int,end:int,n:int,gap:int,four:boolean,groups:int,first:boolean,text:string,before:string,after:string>"
)
_CARD_GAPS, _GROUPED_GAPS, _PHONE_GAPS, _APART = range(4)


def _gap_sql(gap: str) -> str:
    """The narrowest kind of number that allows what stands between two digit groups."""

    def of(characters: str, most: int) -> str:
        return f"length({gap}) <= {most} AND translate({gap}, {quote(characters)}, '') = ''"

    return (
        f"CASE WHEN {of(P.CARD_GAP, 1)} THEN {_CARD_GAPS} WHEN {of(P.GROUPED_CARD_GAP, 2)} THEN {_GROUPED_GAPS} "
        f"WHEN {of(P.PHONE_GAP, 3)} THEN {_PHONE_GAPS} ELSE {_APART} END"
    )


def windows_sql(view: str) -> str:
    """Runs of neighbouring digit groups (the letter O counts as a digit) that a number may be: n digits,
    the widest gap, whether all groups have four, whether no group stands before at a card's gap, the
    text, three characters before and one after.

    One scan cuts out the chains of groups that a number's gaps join and that hold ten digits; only their groups
    are looked at. Chains and groups come from splits, so nothing is cut out of the text by position.
    """
    digit, gap = rf"[0-9{P.O_LETTERS}]", rf"[{re.escape(P.PHONE_GAP)}]"
    chain = rf"(?={digit}(?:{gap}{{0,3}}+{digit}){{9}}){digit}++(?:{gap}{{1,3}}+{digit}++)*+"
    chains = spans_sql(view, chain, with_text=True)
    apart = f"split({view}, {quote(chain)}, -1)"
    most = P.CARD_DIGITS[1]
    may_be = (
        f"w.n >= 10 AND ((w.n <= {P.FOREIGN_DIGITS[1]} AND (contains(before, '+') OR (w.n <= {P.PHONE_DIGITS[1]} AND rlike(a.text, '^[789]')))) "
        f"OR (w.n >= {P.CARD_DIGITS[0]} AND (w.four OR k = 0 OR first)))"
    )
    window = (
        "struct(c.start + a.start AS start, c.start + get(g, i + k).`end` AS `end`, w.n AS n, "
        "IF(k = 0, 0, array_max(transform(sequence(1, k), x -> get(kinds, i + x)))) AS gap, w.four AS four, k + 1 AS groups, first, "
        "array_join(transform(sequence(0, k), x -> concat(IF(x = 0, '', get(p, i + x)), get(g, i + x).text)), '') AS text, "
        "before, IF(i + k + 1 < size(g), left(get(p, i + k + 1), 1), left(get(e, j + 1), 1)) AS after)"
    )
    none = f"CAST(array() AS array<{_WINDOW}>)"
    # How many of the windows that begin here have too few digits, and how many not too many: the others are never built.
    n = "acc.n + get(l, i + k)"
    sizes = (
        f"aggregate(sequence(0, least({most - 1}, size(g) - 1 - i)), struct(0 AS n, 0 AS few, 0 AS fit), (acc, k) -> "
        f"struct({n} AS n, acc.few + CAST({n} < {P.PHONE_DIGITS[0]} AS INT) AS few, acc.fit + CAST({n} <= {most} AS INT) AS fit))"
    )
    built = (
        "get(transform(array(struct(aggregate(sequence(0, k), 0, (x, y) -> x + get(l, i + y)) AS n, "
        f"forall(sequence(0, k), x -> get(l, i + x) = {P.CARD_GROUP}) AS four)), w -> IF({may_be}, {window}, NULL)), 0)"
    )
    each = f"filter(transform(sequence(z.few, z.fit - 1), k -> {built}), x -> x IS NOT NULL)"
    first = f"i = 0 OR get(kinds, i) > {_CARD_GAPS}"
    # What stands in front of a chain's first group may end in a short chain: only what follows its digits counts.
    before = f"right(IF(i = 0, regexp_extract(right(get(e, j), 3), {quote(f'[^0-9{P.O_LETTERS}]*$')}, 0), get(p, i)), 3)"
    each = f"get(transform(array({first}), first -> get(transform(array({before}), before -> {each}), 0)), 0)"
    each = f"get(transform(array({sizes}), z -> IF(z.fit > z.few, {each}, {none})), 0)"
    each = f"flatten(transform(g, (a, i) -> {each}))"
    each = f"get(transform(array(transform(g, x -> length(x.text))), l -> {each}), 0)"
    each = f"get(transform(array(transform(p, x -> {_gap_sql('x')})), kinds -> {each}), 0)"
    each = f"get(transform(array(split(c.text, {quote(digit + '+')}, -1)), p -> {each}), 0)"
    each = f"get(transform(array({spans_sql('c.text', digit + '+', probe='true', with_text=True)}), g -> {each}), 0)"
    found = f"get(transform(array({apart}), e -> flatten(transform(t, (c, j) -> {each}))), 0)"
    return f"get(transform(array({chains}), t -> IF(size(t) = 0, {none}, {found})), 0)"


def _leftmost(found: str) -> str:
    """Of overlapping spans the one that begins first, of those the longest."""
    order = f"array_sort(transform({found}, s -> struct(s.start AS start, -s.`end` AS stop)))"
    kept = (
        f"aggregate({order}, struct(0 AS top, '' AS out), (acc, s) -> IF(s.start >= acc.top, "
        "struct(-s.stop AS top, concat(acc.out, s.start, ',', -s.stop, ';') AS out), acc), acc -> acc.out)"
    )
    return (
        f"transform(filter(split({kept}, ';'), x -> x <> ''), x -> struct("
        "CAST(split_part(x, ',', 1) AS INT) AS start, CAST(split_part(x, ',', 2) AS INT) AS `end`))"
    )


def _cards() -> str:
    run = f"(s.first OR s.groups = 1) AND s.gap = {_CARD_GAPS}"
    grouped = f"s.gap <= {_GROUPED_GAPS} AND s.four AND s.groups = {P.CARD_GROUPS}"
    free = f"NOT {rlike_sql('s.before', '[0-9A-Za-z]$')} AND NOT {rlike_sql('s.after', '[0-9A-Za-z]')}"
    return f"filter(windows, s -> s.n >= {P.CARD_DIGITS[0]} AND ({run} OR {grouped}) AND {free} AND {_is_card_sql('s.text')})"


#: What may stand in front of a dialled number.
_LEAD = r"\+?[ \t]?[(]?$"


def _phones() -> str:
    """Numbers as they are dialled at home or abroad; a plus and a bracket in front belong to them."""
    head = f"regexp_extract(s.before, {quote(_LEAD)}, 0)"
    # A blank belongs to the number only behind a plus; a bracket only if it is closed inside.
    bracket = "IF(endswith(h, '(') AND contains(s.text, ')'), '(', '')"
    lead = f"IF(startswith(h, '+'), IF(endswith(h, '(') AND {bracket} = '', left(h, length(h) - 1), h), {bracket})"
    lead = f"get(transform(array({head}), h -> {lead}), 0)"
    digits_enough = "length(regexp_replace(s.text, '[^0-9]', '')) >= 2"
    found = (
        f"transform(filter(windows, s -> s.n <= {P.FOREIGN_DIGITS[1]} AND {digits_enough}), s -> get(transform(array({lead}), l -> struct("
        "s.start - length(l) AS start, s.`end` AS `end`, s.n AS n, left(s.before, length(s.before) - length(l)) AS before, s.after AS after, "
        f"concat(l, translate(s.text, '{P.O_LETTERS}', '0000')) AS text)), 0))"
    )
    before_plus, after_digit = r"[\p{L}0-9+]$", r"[\p{L}0-9]"
    free = f"NOT {rlike_sql('s.before', before_plus)} AND NOT {rlike_sql('s.after', after_digit)}"
    # A lone Latin letter and a blank before a ten-digit number: a part number.
    after_letter = rlike_sql("s.before", r"(?:^|[^\p{L}\p{N}])[A-Za-z][ \t]$")
    part_number = f"(NOT startswith(s.text, '+') AND s.n = 10 AND {after_letter})"
    home = f"s.n <= {P.PHONE_DIGITS[1]} AND NOT {part_number} AND {_is_phone_sql('s.text')}"
    foreign = f"startswith(s.text, '+') AND NOT startswith({_digits_sql('s.text')}, '7')"
    return f"filter({found}, s -> {free} AND (({home}) OR ({foreign})))"


def _vins(view: str) -> str:
    """Whole words of 17 characters of the set that end in four digits and have a letter."""
    words = spans_sql(view, unicode_regex(rf"(?<!\w)\w{{{P.VIN_LENGTH}}}(?!\w)"), probe=rlike_sql(view, f"[0-9]{{{P.VIN_LAST_DIGITS}}}"))
    value = span_sql(view)
    only = f"translate(upper({value}), '{P.VIN_LETTERS}0123456789', '') = ''"
    ends = rlike_sql(value, f"[0-9]{{{P.VIN_LAST_DIGITS}}}$")
    return f"filter({words}, s -> {only} AND {ends} AND {rlike_sql(value, chr(92) + 'p{L}')})"


def _plates(view: str) -> str:
    """What has the form of a plate, if number and region are given out; with blanks only in capitals."""
    of = {"L": f"[{P.PLATE_LETTERS}]", "d": "[0-9]", "r": "[0-9]"}
    form = r"[ 	]?".join("".join(of[c] for c in part) for part in P.PLATE_FORM.removesuffix(" ?r").split()) + "[0-9]?"
    words = spans_sql(view, unicode_regex(rf"(?<!\w){form}(?!\w)"), probe=rlike_sql(view, "[0-9]{3}"))
    value = span_sql(view)
    digits = _digits_sql(value)
    region = f"substring({digits}, 4)"
    issued = (
        f"left({digits}, 3) <> '000' AND IF(length({region}) = 3, contains('{P.PLATE_LONG_REGIONS}', left({region}, 1)), {region} <> '00')"
    )
    blank = rlike_sql(value, r"[ 	]")
    return f"filter({words}, s -> {issued} AND (NOT {blank} OR {value} = upper({value})))"


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``, all hits of all detectors (they may overlap)."""
    every = [
        *_links("nt"),
        f"IF(lat <> nt, concat({', '.join(_links('lat'))}), CAST(array() AS {CANDIDATE}))",
        _typed(_leftmost(_cards()), "CARD"),
        _typed(_leftmost(_phones()), "PHONE"),
        _typed(_vins("nt"), "VIN"),
        _typed(_plates("nt"), "PLATE"),
    ]
    return (
        rows.withColumn("windows", F.expr(windows_sql("nt")))
        .withColumn("candidates", F.expr(f"array_distinct(concat({', '.join(every)}))"))
        .drop("windows")
    )


def with_detections(rows: DataFrame) -> DataFrame:
    """Adds ``pii``: the longest candidates that do not overlap, in order of position. Equal
    length goes to the higher-priority type, then to the earlier one."""
    one = "struct<start:int,end:int,rank:int,type:string>"
    none = f"CAST(array() AS array<{one}>)"
    placed = "array_sort(transform(candidates, c -> struct(c.start, c.`end`, c.rank, c.type)))"
    ranked = (
        "transform(array_sort(transform(acc.cur, c -> struct(c.start - c.`end` AS shorter, c.rank, "
        "c.start, c.`end`, c.type))), c -> struct(c.start, c.`end`, c.rank, c.type))"
    )
    best = (
        f"array_sort(aggregate({ranked}, {none}, (a, c) -> IF(exists(a, x -> "
        "x.start < c.`end` AND c.start < x.`end`), a, concat(a, array(c)))))"
    )
    code = "c -> concat(c.start, ',', c.`end`, ',', c.type, ';')"
    settled = f"array_join(transform(IF(size(acc.cur) < 2, acc.cur, {best}), {code}), '')"
    # Candidates that touch, also through others, form a cluster, and only within one can they
    # compete. The fold keeps the current cluster and writes settled ones to a string, so a text
    # with thousands of detections stays linear.
    chosen = (
        f"aggregate({placed}, struct(-1 AS top, {none} AS cur, '' AS out), (acc, c) -> "
        "IF(c.start < acc.top, "
        "struct(greatest(acc.top, c.`end`) AS top, concat(acc.cur, array(c)) AS cur, acc.out AS out), "
        f"struct(c.`end` AS top, array(c) AS cur, concat(acc.out, {settled}) AS out)), "
        f"acc -> concat(acc.out, {settled}))"
    )
    spans = (
        f"transform(filter(split({chosen}, ';'), x -> x <> ''), x -> struct("
        "CAST(split_part(x, ',', 1) AS INT) AS start, CAST(split_part(x, ',', 2) AS INT) AS `end`, "
        "split_part(x, ',', 3) AS type))"
    )
    empty = "CAST(array() AS array<struct<start:int,end:int,type:string>>)"
    return (
        with_candidates(rows)
        .withColumn("pii", F.expr(f"IF(size(candidates) = 0, {empty}, {spans})"))
        .drop("candidates")
    )


def value_key(pii_type: Column, value: Column) -> Column:
    """Equal keys of one type are the same value."""
    low = F.lower(value)
    handle = F.when(pii_type == "SOCIAL", F.regexp_replace(low, "^@", "")).otherwise(low)
    link = F.regexp_replace(F.regexp_replace(handle, "^https://", ""), "^http://", "")
    link = F.rtrim(F.regexp_replace(link, r"^www\.", ""), F.lit("/"))
    code = F.translate(F.upper(F.regexp_replace(value, r"(?U)\s+", "")), *P.PLATE_FOLD)
    return (
        F.when(pii_type == "PHONE", F.right(_digits(value), F.lit(10)))
        .when(pii_type == "CARD", _digits(value))
        .when(pii_type.isin("VIN", "PLATE"), code)
        .when(pii_type.isin("SOCIAL", "URL"), link)
        .otherwise(low)
    )


def _text_of(view: str, span: Column) -> Column:
    return F.substring(F.col(view), span["start"] + 1, span["end"] - span["start"])


_SEP = "\u0001"


def with_tokens(rows: DataFrame) -> DataFrame:
    """A03 + A06: adds ``spans``: type, token and original offsets of every detection. Numbers
    count per type by first appearance in the text."""
    nt = "nt"
    keyed = F.transform(
        "pii",
        lambda s: F.struct(
            s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"),
            F.concat(s["type"], F.lit(_SEP), value_key(s["type"], _text_of(nt, s))).alias("key"),
        ),
    )

    def keys_of(pii_type: str) -> Column:
        return F.filter("__keys", lambda k: F.startswith(k, F.lit(pii_type + _SEP)))

    by_type = F.create_map(*[x for t in P.TYPES for x in (F.lit(t), keys_of(t))])

    def token(s: Column, keys: Column) -> Column:
        number = F.array_position(F.element_at(keys, s["type"]), s["key"])
        return F.concat(F.lit("["), s["type"], F.lit("_"), number.cast("string"), F.lit("]"))

    def placed(s: Column, keys: Column) -> Column:
        start, end = to_original(s["start"], s["end"])
        return F.struct(
            s["type"].alias("type"), start.alias("start"), end.alias("end"), token(s, keys).alias("token")
        )

    # The optimiser would put the map into the function over the spans and build it for each of them.
    spans = let(by_type, lambda keys: F.transform("__keyed", lambda s: placed(s, keys)))

    return (
        rows.withColumn("__keyed", keyed)
        .withColumn("__keys", F.array_distinct(F.transform("__keyed", lambda s: s["key"])))
        .withColumn("spans", spans)
        .drop("__keyed", "__keys")
    )


def masked_text(text: str = "text") -> Column:
    """The text with every span replaced by its token; the rest stays as it is."""
    pieces = (
        f"concat(transform(spans, (s, i) -> concat(substring({text}, IF(i = 0, 0, get(spans, i - 1).`end`) "
        f"+ 1, s.start - IF(i = 0, 0, get(spans, i - 1).`end`)), s.token)), "
        f"array(substring({text}, get(spans, size(spans) - 1).`end` + 1)))"
    )
    return F.expr(f"IF(size(spans) = 0, {text}, array_join({pieces}, ''))")


def token_mapping(text: str = "text") -> Column:
    """Token -> first original value. Restricted: only for an output kept apart."""
    value = f"substring({text}, s.start + 1, s.`end` - s.start)"
    tokens = "transform(spans, s -> s.token)"
    first = f"transform(array_distinct({tokens}), t -> get(spans, array_position({tokens}, t) - 1))"
    return F.expr(
        f"map_from_entries(transform({first}, s -> struct(s.token AS token, {value} AS value)))"
    )
