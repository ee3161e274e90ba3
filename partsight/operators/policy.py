"""Policy findings and verdicts over draft parts.

``find`` judges every part in its own row (no shuffle) and yields one row per finding. Literals and
template spans then lift findings by equi-joins on (draft, part) with a containment condition, and
the verdicts are two levels of ``groupBy``. A part over the size limit is scanned like any
other; its length is one more finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.functions import pii
from partsight.functions import text as tx
from partsight.functions.literals import literal_pattern
from partsight.functions.spans import (
    CLOSE, NO_SPANS, OPEN, explode_rows, head_sql, inside_sql, quote, rlike_sql, span_sql, spans_sql,
    trimmed_sql, unicode_regex,
)
from partsight.operators.ordered import stored
from partsight.rules import policy as R
from partsight.rules.pii import TRAILING_PUNCTUATION

PART = ["draft_id", "part_index"]
FINDING = "array<struct<code:string,start:int,end:int>>"
_NONE = f"CAST(array() AS {FINDING})"
_VIEW = {"cyr": "cyr", "lat": "lat", "text": "nt"}
_CASED = ("UNRENDERED_TOKEN", "DIGITS_NOT_ALLOWED")
#: Codes of findings that no rule table names.
_OWN_CODES = (
    "EMPTY_PART", "PART_TOO_LONG", "INVALID_TEXT", "OBFUSCATION", "URL_NOT_ALLOWED", "UNRENDERED_TOKEN", "CONTACT_SOCIAL", *R.PII_CODES.values(),
)


def _coded(found: str, code: str) -> str:
    return (
        f"transform({found}, s -> struct('{code}' AS code, CAST(s.start AS INT) AS start, "
        "CAST(s.`end` AS INT) AS `end`))"
    )


def _alternatives(pattern: str) -> list[str]:
    """A pattern split at its top-level bars."""
    parts, depth, in_class, cut, i = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append(pattern[cut:i])
            cut = i + 1
        i += 1
    return [*parts, pattern[cut:]]


def _needed_words(pattern: str) -> list[str] | None:
    """Texts (lower case) of which one must occur in every match of a pattern: per alternative the
    run of plain letters, or the group of such runs, that is hardest to meet. None if there is
    none."""
    words: list[str] = []
    for alt in _alternatives(pattern):
        options, run, i = [], "", 0

        def close() -> None:
            nonlocal run
            if run:
                options.append([run.lower()])
            run = ""

        while i < len(alt):
            ch = alt[i]
            if ch == "(":
                depth, end = 0, i
                while True:
                    if alt[end] == "\\":
                        end += 1
                    elif alt[end] == "(":
                        depth += 1
                    elif alt[end] == ")":
                        depth -= 1
                    if depth == 0:
                        break
                    end += 1
                close()
                body, after = alt[i:end + 1], alt[end + 1 : end + 3]
                if body.startswith("(?:") and not (after[:1] in ("?", "*") or after == "{0"):
                    inner = _needed_words(body[3:-1])
                    if inner:
                        options.append(inner)
                i = end + 1
                continue
            if ch == "[":
                close()
                i = alt.index("]", i + 2) + 1
                continue
            if ch == "\\":
                close()
                i += 2
                continue
            if ch.isalnum() or ch == "-":
                if alt[i + 1 : i + 2] in ("?", "*", "{"):
                    close()
                else:
                    run += ch
            elif ch == "{":
                close()
                i = alt.index("}", i)
            else:
                close()
            i += 1
        close()
        if not options:
            return None
        words += max(options, key=lambda ws: min(len(w) for w in ws))
    return words


#: Letters that folding look-alikes can put into a view without a Cyrillic letter in the text.
_FOLDED = {"cyr": frozenset(tx.LAT_TO_CYR[1].lower()), "lat": frozenset(), "nt": frozenset()}


def _needs_cyrillic(view: str, word: str) -> bool:
    """Can a (lower-case) word occur in the view only if the text has a Cyrillic letter itself?"""
    return any("\u0400" <= ch <= "\u045f" and ch not in _FOLDED[view] for ch in word)


def _probe(view: str, tests: dict[str, str]) -> str:
    """One of the tests (by word); those of words that need Cyrillic only where ``has_cyrillic``."""
    gated = [t for w, t in tests.items() if _needs_cyrillic(view, w)]
    free = [t for w, t in tests.items() if not _needs_cyrillic(view, w)]
    if gated:
        free.append(f"(has_cyrillic AND ({' OR '.join(gated)}))")
    return f"({' OR '.join(free)})"


def _group_end(pattern: str, i: int) -> int:
    """Where the group or class that opens at ``i`` closes."""
    if pattern[i] == "[":
        i += 2 if pattern[i + 1] == "^" else 1
        while pattern[i] != "]":
            i = _group_end(pattern, i) + 1 if pattern[i] == "[" else i + 2 if pattern[i] == "\\" else i + 1
        return i
    i += 1
    while pattern[i] != ")":
        i = _group_end(pattern, i) + 1 if pattern[i] in "([" else i + 2 if pattern[i] == "\\" else i + 1
    return i


def _without_cyrillic(view: str, pattern: str) -> str | None:
    """The pattern without the alternatives that match no text of the view unless the text itself has a
    Cyrillic letter; None if nothing is left."""
    kept = []
    for alt in _alternatives(pattern):
        i, out = 0, ""
        while i < len(alt):
            end = _group_end(alt, i) if alt[i] in "([" else alt.index("}", i) if alt[i] == "{" else i + 1 if alt[i] == "\\" else i
            item, i = alt[i : end + 1], end + 1
            if alt[i : i + 1] not in ("?", "*", "{"):
                if item.startswith("(?:"):
                    inner = _without_cyrillic(view, item[3:-1])
                    item = None if inner is None else f"(?:{inner})"
                elif len(item) == 1 and _needs_cyrillic(view, item.lower()):
                    item = None
                if item is None:
                    break
            out += item
        else:
            kept.append(out)
    return "|".join(kept) if kept else None


def _scan(view: str, pattern: str, *, ignore_case: bool) -> str:
    """The spans of a pattern in the texts that hold a word that one of its alternatives needs."""
    alts = _alternatives(pattern)
    words = _needed_words(pattern)
    probe = None
    if words is not None:
        # A word that contains another listed word adds nothing.
        short = {w for w in words if not any(o != w and o in w for o in words)}
        probe = _probe(view, {w: f"contains(low_{view}, {quote(w)})" for w in sorted(short)})
    bounded = [a.removeprefix(r"\b") for a in alts if a.startswith(r"\b")]
    others = [f"(?:{a})" for a in alts if not a.startswith(r"\b")]
    joined = "|".join(
        ([r"\b(?:" + "|".join(f"(?:{a})" for a in bounded) + ")"] if bounded else []) + others
    )
    return spans_sql(view, unicode_regex(joined, ignore_case=ignore_case), probe=probe)


def _by_code(rules, code: str) -> str:
    """The spans of one code: one combined pattern per view.

    A text is scanned only if it holds a word that one of the alternatives needs; plain substring
    tests on the lower-cased view (``low_*``) settle that for most texts and codes. A text without a
    Cyrillic letter is scanned for what can match there only.
    """
    per_view: dict[str, list[str]] = {}
    for c, script, pattern in rules:
        if c == code:
            per_view.setdefault(script, []).extend(_alternatives(pattern))
    parts = []
    for script, alts in per_view.items():
        view, pattern, ignore_case = _VIEW[script], "|".join(alts), code not in _CASED
        whole, rest = _scan(view, pattern, ignore_case=ignore_case), _without_cyrillic(view, pattern)
        if rest is None:
            whole = f"IF(has_cyrillic, {whole}, {NO_SPANS})"
        elif rest != pattern:
            whole = f"IF(has_cyrillic, {whole}, {_scan(view, rest, ignore_case=ignore_case)})"
        parts.append(whole)
    if not parts:
        return NO_SPANS
    return f"array_distinct(concat({', '.join(parts)}))" if len(parts) > 1 else parts[0]


# -- context (B12-B15) -------------------------------------------------------------------------------


def _around(view: str, ends: str, span: str = "s") -> str:
    """The segment that holds a span, with its terminating character."""
    no_end = ends.replace("[", "[^", 1)
    head = f"regexp_extract(substring({view}, 1, {span}.start), {quote(no_end + '*$')}, 0)"
    tail = (
        f"regexp_extract(substring({view}, {span}.`end` + 1), "
        f"{quote('^' + no_end + '*' + ends + '?')}, 0)"
    )
    return f"concat({head}, {span_sql(view, span)}, {tail})"


def _before(view: str, n: int, span: str = "s") -> str:
    return (
        f"substring({view}, greatest({span}.start - {n}, 0) + 1, least({span}.start, {n}))"
    )


def negated_sql(span: str = "s") -> str:
    """Negated right before or right after, unless the clause holds a double negation."""
    before = rlike_sql(_before("cyr", 60, span), unicode_regex(R.NEGATION_BEFORE))
    after = rlike_sql(f"substring(cyr, {span}.`end` + 1, 80)", unicode_regex(R.NEGATION_AFTER))
    clause = _around("cyr", tx.CLAUSE_END, span)
    tokens = f"regexp_count({clause}, {quote(unicode_regex(R.NEGATION_TOKEN))})"
    return f"(({before} OR {after}) AND {tokens} < 2)"


def hedged_sql(span: str = "s") -> str:
    """The sentence is a question or announces a check."""
    hedge = unicode_regex(R.HEDGE)
    return " OR ".join(
        f"{rlike_sql(_around(v, tx.SENTENCE_END, span), hedge)}" for v in ("cyr", "lat")
    )


def split_stems_sql() -> list[str]:
    """Stems spelled across separators. The letters are matched with separators in between on
    the view itself, which is the same as matching on the compact view and mapping back; a match
    without a separator inside is an ordinary word and is left to the rules."""
    out = []
    for code, script, stems in R.SPLIT_STEMS:
        gap = f"{tx.COMPACT_SEPARATORS}*"
        pattern = "|".join(gap.join(stem) for stem in stems)
        view = _VIEW[script]
        # All letters of one stem must occur at all.
        probe = _probe(view, {
            stem: "(" + " AND ".join(f"contains(low_{view}, '{ch}')" for ch in sorted(set(stem))) + ")"
            for stem in stems
        })
        found = (
            f"filter({spans_sql(view, unicode_regex(pattern), probe=probe)}, "
            f"s -> {rlike_sql(span_sql(view), unicode_regex(tx.COMPACT_SEPARATORS))})"
        )
        out += [_coded(found, code), _coded(found, "OBFUSCATION")]
    return out


def _url_spans(token: str, part: str | None, probe: str) -> str:
    found = spans_sql("nt", unicode_regex(token), probe=rlike_sql("nt", probe))
    return found if part is None else head_sql("nt", found, unicode_regex(part))


def url_allowed_sql(url: str, allowlist: tuple[str, ...]) -> str:
    """A clean http(s) URL on an allowed host, without a domain in the query, five digits in a
    row or a channel name."""
    if not allowlist:
        return "false"
    form = unicode_regex(R.CLEAN_URL)
    host, path, query = (
        f"lower(regexp_extract({url}, {quote(form)}, {i}))" for i in (1, 2, 3)
    )
    hosts = " OR ".join(
        f"{host} = {quote(h)} OR endswith({host}, {quote('.' + h)})" for h in allowlist
    )
    words = f"regexp_replace(concat({path}, ' ', {query}), '[-_/.?=&~]+', ' ')"
    channel = "|".join(f"(?:{p})" for c, _, p in R.RULES if c == "CONTACT_CHANNEL")
    return (
        f"({rlike_sql(url, form)} AND ({hosts}) AND NOT contains({path}, '//') "
        f"AND NOT {rlike_sql(query, '[a-z0-9-]+[.][a-z]{2,}')} "
        f"AND NOT {rlike_sql(f'concat({path}, {query})', '[0-9]{5,}')} "
        f"AND NOT {rlike_sql(words, unicode_regex(channel))})"
    )


# -- findings ----------------------------------------------------------------------------------------


def basic_findings(parts: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``basic`` (empty, invalid, hidden, too long; original offsets). Expects the view columns."""
    t = F.col(text)

    def coded(found: str, code: str) -> Column:
        return F.expr(_coded(found, code))

    whole = F.array(
        F.struct(F.lit("EMPTY_PART").alias("code"), F.lit(0).alias("start"),
                 F.length(t).alias("end"))
    )
    fits = tx.part_fits(t, R.MAX_UTF16_UNITS, R.MAX_UTF8_BYTES)
    long = F.array(
        F.struct(
            F.lit("PART_TOO_LONG").alias("code"),
            tx.first_index_beyond(t, R.MAX_UTF16_UNITS, R.MAX_UTF8_BYTES).cast("int").alias("start"),
            F.length(t).alias("end"),
        )
    )
    none = F.expr(_NONE)
    empty = F.col("nt").rlike(r"^(?U)\s*$")
    return parts.withColumn(
        "basic",
        F.concat(
            coded("invalid", "INVALID_TEXT"), coded("hidden", "OBFUSCATION"),
            F.when(empty, whole).otherwise(none),
            F.when(~empty & ~fits, long).otherwise(none),
        ),
    )


def find(
    parts: DataFrame, *, rules=R.RULES, url_allowlist: tuple[str, ...] = (), text: str = "text"
) -> DataFrame:
    """One row per finding: ``draft_id, part_index, code, start, end, is_percent`` in original
    offsets, before literals and template spans lift any.

    ``parts`` holds ``draft_id, part_index`` and the text, and may hold ``fitment_verified``. The
    order of work follows the rules: detections and URLs first, because what they explain is not
    judged again as digits, currency or number words.
    """
    keep = [*PART, *[c for c in ("fitment_verified",) if c in parts.columns]]
    basic = basic_findings(tx.with_views(parts.select(*keep, text), text), text)
    staged = pii.with_detections(basic).withColumns({
        **{f"low_{v}": F.lower(v) for v in ("nt", "cyr", "lat")},
        # With the small letters that only ignoring case makes equal to those of the rules.
        "has_cyrillic": F.col("nt").rlike("[\u0400-\u045f\u1c80-\u1c8f]"),
    })

    url = trimmed_sql(
        "nt",
        "array_distinct(concat(" + ", ".join(
            _url_spans(token, part, probe) for token, part, probe in R.URL_GENERIC
        ) + "))",
        TRAILING_PUNCTUATION,
    )
    types = ", ".join(f"'{t}'" for t in R.PII_CODES)
    staged = staged.withColumns(
        {
            "known": F.expr(f"filter(pii, s -> s.type IN ({types}))"),
            "urls": F.expr(url),
            "unrendered": F.expr(_by_code(rules, "UNRENDERED_TOKEN")),
        }
    ).withColumn(
        "links", F.expr(f"concat(transform(known, s -> struct(s.start, s.`end`)), urls)")
    ).withColumn("consumed", F.expr("concat(links, unrendered)"))

    allowed = url_allowed_sql(span_sql("nt"), url_allowlist)
    code_of = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in R.PII_CODES.items())
    found = [
        f"transform(filter(known, s -> NOT (s.type = 'URL' AND {allowed})), "
        f"s -> struct(CASE s.type {code_of} END AS code, s.start AS start, s.`end` AS `end`))",
        _coded(f"filter(urls, s -> NOT {allowed})", "URL_NOT_ALLOWED"),
        _coded(
            f"filter({spans_sql('nt', '@', probe="contains(nt, '@')")}, s -> NOT {inside_sql('s', 'links')})", "CONTACT_SOCIAL"
        ),
        _coded("unrendered", "UNRENDERED_TOKEN"),
        *split_stems_sql(),
    ]
    codes = list(dict.fromkeys(c for c, _, _ in rules))
    for code in codes:
        if code == "UNRENDERED_TOKEN":
            continue
        hits = _by_code(rules, code)
        if code in R.NEGATABLE:
            hits = f"filter({hits}, s -> NOT {negated_sql()})"
            if code == "PROMISE_RETURN":
                after = rlike_sql(
                    "substring(cyr, s.`end` + 1, 80)", unicode_regex(R.PLATFORM_RULES_AFTER)
                )
                hits = f"filter({hits}, s -> NOT {after})"
        elif code == "UNVERIFIED_FITMENT":
            denied = rlike_sql(_before("cyr", 20), unicode_regex(R.NEGATION_BEFORE))
            verified = "fitment_verified" if "fitment_verified" in keep else "false"
            hits = f"IF({verified}, {NO_SPANS}, filter({hits}, s -> NOT ({denied} OR {hedged_sql()})))"
        elif code in R.NUMBERS:
            if code == "CURRENCY":
                cut = f"trim(TRAILING {quote(TRAILING_PUNCTUATION)} FROM {span_sql('nt')})"
                hits = (
                    f"transform({hits}, s -> struct(s.start AS start, IF(s.`end` - s.start > 1, "
                    f"s.start + length({cut}), s.`end`) AS `end`))"
                )
            if code == "NUMBER_WORD":
                skip = ", ".join(quote(w) for w in R.NUMBER_WORD_SKIP)
                hits = f"filter({hits}, s -> {span_sql('nt')} NOT IN ({skip}))"
            # The optimiser would put a column that is named once into the function and compute it for each hit.
            left = f"filter(hits, s -> NOT {inside_sql('s', 'c')})"
            left = f"get(transform(array({hits}), hits -> get(transform(array(consumed), c -> {left}), 0)), 0)"
            hits = left
        found.append(_coded(hits, code))

    staged = staged.withColumns(
        {
            "obf": F.concat(
                tx.foreign_spans("nt"), tx.mixed_script_spans("nt"), tx.spaced_letter_spans("nt")
            ),
            "found": F.expr(f"concat({', '.join(found)})"),
        }
    ).withColumn("found", F.expr("concat(" + _coded("obf", "OBFUSCATION") + ", found)"))

    # A finding is one number until it is a row: equal structs are only found by comparing all with all.
    names = list(dict.fromkeys([*_OWN_CODES, *(c for c, _, _ in R.SPLIT_STEMS), *codes]))
    width = (63 - len(names).bit_length()) // 2
    listed = F.array(*map(F.lit, names))

    def number(code: Column, start: Column, end: Column) -> Column:
        place = F.array_position(listed, code).cast("long")
        return F.shiftleft(place, 2 * width).bitwiseOR(F.shiftleft(start.cast("long"), width)).bitwiseOR(end.cast("long"))

    def placed(f: Column) -> Column:
        return number(f["code"], *tx.to_original(f["start"], f["end"]))

    early = F.transform("basic", lambda f: number(f["code"], f["start"], f["end"]))
    every = F.array_distinct(F.concat(early, F.transform("found", placed)))
    part = F.lit((1 << width) - 1)
    found = F.struct(
        F.element_at(listed, F.shiftright("f", 2 * width).cast("int")).alias("code"),
        F.shiftright("f", width).bitwiseAND(part).cast("int").alias("start"), F.col("f").bitwiseAND(part).cast("int").alias("end"),
    )
    percent = F.expr(f"f.code = 'NUMBER_WORD' AND {span_sql(text, 'f')} = '%'")
    return explode_rows(staged, every, "f", *PART, text).withColumn("f", found).select(
        *PART, "f.code", "f.start", "f.end", percent.alias("is_percent")
    )


# -- literals and template spans ---------------------------------------------------------------------


def literal_regions(parts: DataFrame, literals: DataFrame, text: str = "text") -> DataFrame:
    """Where allowed literals occur, in original offsets. ``literals`` holds ``draft_id,
    literal``; every literal is looked for in the parts of its own draft only."""
    views = tx.with_views(parts.select(*PART, text), text).select(*PART, "lat", "starts", "ends")
    patterns = literals.dropDuplicates(["draft_id", "literal"]).select(
        "draft_id", literal_pattern(F.col("literal")).alias("pattern"),
        F.regexp_extract("literal", "[0-9]+", 0).alias("digits"),
    ).where(F.col("pattern").isNotNull())
    # Its first digits stand in the text as they are: most texts of a draft are settled without making a pattern.
    hit = views.join(patterns, "draft_id").where(F.expr("contains(lat, digits) AND rlike(lat, pattern)"))
    marked = F.expr(
        f"split(regexp_replace(lat, pattern, {quote(OPEN + '$0' + CLOSE)}), "
        f"{quote(f'[{OPEN}{CLOSE}]')}, -1)"
    )
    found = F.expr(
        f"aggregate(pieces, struct(0 AS pos, false AS inside, {NO_SPANS} AS out), (acc, p) -> "
        "struct(acc.pos + length(p) AS pos, NOT acc.inside AS inside, IF(acc.inside, concat(acc.out,"
        " array(struct(acc.pos AS start, acc.pos + length(p) AS `end`))), acc.out) AS out), "
        "acc -> acc.out)"
    )
    rows = hit.withColumn("pieces", marked).withColumn("regions", found)
    start, end = tx.to_original(F.col("r.start"), F.col("r.end"))
    long = explode_rows(rows, F.col("regions"), "r", *PART, "starts", "ends")
    return long.select(*PART, start.alias("r_start"), end.alias("r_end")).distinct()


def lift_by_literals(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """B09 for literals: number-like findings wholly inside a literal are lifted."""
    f, r = findings.alias("f"), regions.alias("r")
    inside = (
        (F.col("f.draft_id") == F.col("r.draft_id"))
        & (F.col("f.part_index") == F.col("r.part_index"))
        & (F.col("r.r_start") <= F.col("f.start"))
        & (F.col("f.end") <= F.col("r.r_end"))
        & F.col("f.code").isin(*R.LITERAL_EXEMPT)
    )
    return f.join(r, inside, "left_anti")


def _exempts(code: Column, kind: Column) -> Column:
    ok = F.lit(False)
    for c, kinds in R.EXEMPT_IN.items():
        ok = ok | ((code == c) & kind.isin(*kinds))
    return ok


def lift_by_templates(findings: DataFrame, spans: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """B09 + B16: findings inside a template span of a kind that exempts their code are lifted. A
    claim is lifted only if the record confirms it too (``completion_confirmed`` and
    ``payment_confirmed`` of the draft). ``spans``: ``draft_id, part_index, kind, s_start, s_end``;
    ``is_percent`` on a finding lets a percent sign pass in a payment rule."""
    f = findings
    confirmed = F.lit(True)
    if flags is not None:
        f = f.join(flags.select("draft_id", "completion_confirmed", "payment_confirmed"),
                   "draft_id", "left")
        confirmed = (
            F.when(F.col("f.code") == "COMPLETION_CLAIM", F.col("f.completion_confirmed"))
            .when(F.col("f.code") == "PAYMENT_RECEIVED_CLAIM", F.col("f.payment_confirmed"))
            .otherwise(True)
        )
    exempt = _exempts(F.col("f.code"), F.col("s.kind"))
    if "is_percent" in findings.columns:
        exempt = exempt | (F.col("f.is_percent") & (F.col("s.kind") == "rule_payment"))
    f, s = f.alias("f"), spans.alias("s")
    inside = (
        (F.col("f.draft_id") == F.col("s.draft_id"))
        & (F.col("f.part_index") == F.col("s.part_index"))
        & (F.col("s.s_start") <= F.col("f.start"))
        & (F.col("f.end") <= F.col("s.s_end"))
        & exempt
        & F.coalesce(confirmed, F.lit(False))
    )
    return f.join(s, inside, "left_anti").select(*findings.columns)


def check_spans(spans: DataFrame, parts: DataFrame, text: str = "text") -> DataFrame:
    """Template spans that are not usable, with the reason."""
    sizes = parts.select(*PART, F.length(text).alias("chars"))
    problem = (
        F.when(F.col("chars").isNull(), "no_such_part")
        .when(~F.coalesce(F.col("kind").isin(*R.SPAN_KINDS), F.lit(False)), "unknown_kind")
        .when(
            ~((F.col("s_start") >= 0) & (F.col("s_start") < F.col("s_end"))
              & (F.col("s_end") <= F.col("chars"))),
            "out_of_range",
        )
    )
    return spans.join(sizes, PART, "left").withColumn("problem", problem)


# -- verdicts ----------------------------------------------------------------------------------------


def part_verdicts(parts: DataFrame, findings: DataFrame) -> DataFrame:
    """B17 + B20: every part is allowed, denied, or denied but overridable (owner edit without a
    hard-block code); distinct codes in order of first appearance (at most 25 per part)."""
    per_code = findings.groupBy(*PART, "code").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("start", "end")).alias("first")
    )
    per_part = per_code.groupBy(*PART).agg(
        F.sum("n").alias("findings"),
        F.bool_or(F.col("code").isin(*R.HARD_BLOCK)).alias("hard"),
        F.array_sort(F.collect_list(F.struct("first", "code"))).alias("ordered"),
    )
    joined = parts.select(*PART, "is_owner_edit").join(per_part, PART, "left")
    return joined.select(
        *PART, "is_owner_edit",
        F.col("findings").isNull().alias("allowed"),
        (F.col("is_owner_edit") & F.col("findings").isNotNull() & ~F.col("hard")).alias("overridable"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce(F.transform("ordered", lambda x: x["code"]),
                   F.array().cast("array<string>")).alias("codes"),
        F.lit(R.RULES_VERSION).alias("rules_version"),
    ).withColumn("overridable", F.coalesce("overridable", F.lit(False)))


def draft_verdicts(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """All parts allowed; overridable iff denied and every denied part is."""
    rolled = verdicts.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("parts"),
        F.bool_and("allowed").alias("allowed"),
        F.bool_or("is_owner_edit").alias("warn_only"),
        F.bool_and(F.col("allowed") | F.col("overridable")).alias("all_overridable"),
    )
    codes = (
        findings.groupBy("draft_id", "code")
        .agg(F.min(F.struct("part_index", "start", "end")).alias("first"))
        .groupBy("draft_id")
        .agg(F.array_sort(F.collect_list(F.struct("first", "code"))).alias("ordered"))
    )
    return rolled.join(codes, "draft_id", "left").select(
        "draft_id", "parts", "allowed", "warn_only",
        (F.col("warn_only") & ~F.col("allowed") & F.col("all_overridable")).alias("overridable"),
        F.coalesce(F.transform("ordered", lambda x: x["code"]),
                   F.array().cast("array<string>")).alias("codes"),
        F.lit(R.RULES_VERSION).alias("rules_version"),
    )


def check_parts(
    parts: DataFrame, literals: DataFrame | None = None, spans: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole check: (findings, part verdicts, draft verdicts)."""
    findings = find(parts, **options)
    if literals is not None:
        findings = lift_by_literals(findings, literal_regions(parts, literals))
    if spans is not None:
        flags = parts.groupBy("draft_id").agg(
            F.bool_and("completion_confirmed").alias("completion_confirmed"),
            F.bool_and("payment_confirmed").alias("payment_confirmed"),
        )
        findings = lift_by_templates(findings, spans, flags)
    # Read by both verdicts: the detectors run once.
    findings = stored(findings, "findings")
    verdicts = part_verdicts(parts, findings)
    return findings, verdicts, draft_verdicts(verdicts, findings)
