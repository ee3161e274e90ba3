"""Notes taken apart: lines, fences, headings, fields, tables, links and tags as array expressions.

A note is split where its marks stand and each piece is judged by its neighbours; nothing is scanned
twice and a note never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "CAST(array() AS array<struct<style:string,embed:boolean,target:string>>)"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def let(value: Column, of) -> Column:
    """``of`` a value that is computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), 0)


def without(value: Column, characters: str) -> Column:
    """Has the value none of the characters?"""
    return F.translate(value, characters, "") == value


def only_digits(value: Column, least: int, most: int) -> Column:
    return F.length(value).between(least, most) & (F.translate(value, "0123456789", "") == "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


# -- fences ------------------------------------------------------------------------------------------

_FENCE_LINE = r"(?m)^[ \t]*(?:`{3}|~{3}).*$"


def _fence_lines(text: Column) -> tuple[Column, Column]:
    """The fence lines of a text, and for each a letter: o(pens), c(loses) or i(nside another)."""
    marks = F.regexp_extract_all(text, F.lit(_FENCE_LINE), F.lit(0))

    def step(acc: Column, mark: Column) -> Column:
        bare = F.ltrim(F.translate(mark, "\t", " "))
        run = F.regexp_extract(bare, "^(`+|~+)", 1)
        opens, closes = acc["open"] == "", bare.startswith(acc["open"])
        return F.struct(
            F.when(opens, run).when(closes, "").otherwise(acc["open"]).alias("open"),
            F.concat(acc["kinds"], F.when(opens, "o").when(closes, "c").otherwise("i")).alias("kinds"),
        )

    start = F.struct(F.lit("").alias("open"), F.lit("").alias("kinds"))
    return marks, F.aggregate(marks, start, step, lambda acc: acc["kinds"])


def without_fences(text: Column) -> Column:
    """The text without fenced code; a fence that nothing closes takes the rest."""
    _, kinds = _fence_lines(text)
    pieces = F.split(text, _FENCE_LINE, -1)
    outside = let(kinds, lambda k: F.filter(pieces, lambda p, i: (i == 0) | (F.substring(k, i, F.lit(1)) == "c")))
    return F.when(text.contains("```") | text.contains("~~~"), F.array_join(outside, "")).otherwise(text)


def fence_words(text: Column) -> Column:
    """The word behind each opening fence, if there is one."""
    marks, kinds = _fence_lines(text)
    opening = let(kinds, lambda k: F.filter(marks, lambda m, i: F.substring(k, i + 1, F.lit(1)) == "o"))
    words = F.transform(opening, lambda m: F.regexp_extract(F.ltrim(F.translate(m, "`~\t", "   ")), r"^[\w-]*", 0))
    return F.filter(words, lambda w: w != "")


# -- headings, fields, tables ------------------------------------------------------------------------


def _heading_level(line: Column) -> Column:
    """The number of signs in front of a heading, else 0."""
    n = F.length(line) - F.length(F.ltrim(line, F.lit("#")))
    return F.when(line.startswith("#"), let(n, lambda k: _level(line, k))).otherwise(0)


def _level(line: Column, n: Column) -> Column:
    named = F.ltrim(F.translate(F.substring(line, n + 1, F.length(line)), "\t", " ")) != ""
    blank = F.substring(line, n + 1, F.lit(1)).isin(" ", "\t")
    return F.when(n.between(1, 6) & blank & named, n).otherwise(0)


def headings(text: Column) -> Column:
    """(level, name) of each heading."""

    def one(line: Column, level: Column) -> Column:
        name = strip(F.substring(line, level + 1, F.length(line)))
        plain = strip(F.rtrim(name, F.lit("#")))
        return F.struct(level.alias("level"), F.when(plain == "", name).otherwise(plain).alias("name"))

    marked = F.filter(lines(text), lambda x: x.startswith("#"))
    found = F.transform(marked, lambda x: let(_heading_level(x), lambda level: one(x, level)))
    return F.filter(found, lambda h: h["level"] > 0)


def without_headings(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: _heading_level(x) == 0), "\n")


_MARKS = "[]()`:|"


def _line_field(line: Column) -> Column:
    """(k, v) of a line ``key:: value``; k is empty where the line is none. List marks and bold signs go."""
    head = F.ltrim(F.translate(F.substring_index(line, "::", 1), "\t", " "))
    value = F.substring(line, F.length(F.substring_index(line, "::", 1)) + 3, F.length(line))
    first, second = F.substring(head, 1, 1), F.substring(head, 2, 1)
    numbered = F.regexp_replace(head, r"^[0-9]+[.)] +", "")
    item = (
        F.when(first.isin("-", "*", "+") & (second == " "), F.substring(head, F.lit(3), F.length(head)))
        .when(first == ">", F.substring(head, F.lit(2), F.length(head)))
        .otherwise(numbered)
    )
    item = F.ltrim(item)
    bold = F.substring(item, 1, 2).isin("**", "__")
    key = F.when(bold, F.substring(item, F.lit(3), F.length(item))).otherwise(item)
    key = F.when(F.right(key, F.lit(2)).isin("**", "__"), F.substring(key, F.lit(1), F.length(key) - 2)).otherwise(key)
    good = (key != "") & without(key, _MARKS) & ~F.substring(key, 1, 1).isin("*", "_") & ~value.startswith(":")
    return F.struct(F.when(good, key).otherwise("").alias("k"), F.ltrim(F.translate(value, "\t", " ")).alias("v"))


def _bracket_field(piece: Column) -> Column:
    """(k, v) of what follows an opening bracket."""
    inner = F.get(F.split(piece, r"[\])]", 2), 0)
    key = F.substring_index(inner, "::", 1)
    good = (inner != piece) & inner.contains("::") & (key != "") & without(inner, "\n") & without(key, "`:|")
    value = F.ltrim(F.substring(inner, F.length(key) + 3, F.length(inner)))
    return F.struct(F.when(good, key).otherwise("").alias("k"), value.alias("v"))


def inline_fields(text: Column) -> Column:
    """(k, v) of ``key:: value`` lines, then of bracketed fields."""
    of_lines = F.transform(F.filter(lines(text), lambda x: x.contains("::")), _line_field)
    opened = F.filter(F.split(text, r"[\[(]", -1), lambda p, i: (i > 0) & p.contains("::"))
    return F.filter(F.concat(of_lines, F.transform(opened, _bracket_field)), lambda f: f["k"] != "")


def _is_rule(line: Column) -> Column:
    """Is the line what stands under a table's head?"""
    cells = F.split(F.trim(F.trim(F.translate(line, "\t", " ")), F.lit("|")), r"\|")
    dashes = F.transform(cells, lambda c: F.regexp_replace(F.trim(c), "^:|:$", ""))
    plain = F.forall(dashes, lambda c: (c != "") & (F.translate(c, "-", "") == ""))
    return plain & (F.length(F.get(dashes, 0)) >= 3)


def tables(text: Column) -> Column:
    """(head, lines) of each table: a line with a bar, a rule under it, and the lines with a bar that follow."""
    kept = F.transform(lines(text), lambda x: F.when(x.contains("|") | (x.contains("---") & _is_rule(x)), x).otherwise("\u0004"))
    blocks = F.transform(F.split(F.array_join(kept, "\n"), "\u0004"), lambda b: F.filter(F.split(b, "\n"), lambda x: x != ""))

    def one(block: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(block), F.lit(1))),
            lambda i: F.coalesce(F.get(block, i - 1).contains("|") & F.get(block, i).contains("-") & _is_rule(F.get(block, i)), F.lit(False)),
        )
        rule = F.get(at, 0)
        rest = F.slice(block, rule + 2, F.size(block))
        stop = F.array_position(F.transform(rest, lambda x: x.contains("|")), False)
        rows = F.when(stop > 0, F.slice(rest, F.lit(1), stop.cast("int") - 1)).otherwise(rest)
        return F.when(rule.isNotNull(), F.struct(F.get(block, rule - 1).alias("head"), rows.alias("lines")))

    return F.filter(F.transform(F.filter(blocks, lambda b: F.size(b) > 1), one), lambda t: t.isNotNull())


# -- links and tags ----------------------------------------------------------------------------------


def _wiki_target(piece: Column) -> Column:
    """The target that begins a piece behind ``[[``; empty if it is none."""
    inner = F.substring_index(piece, "]]", 1)
    return F.when(piece.contains("]]") & without(inner, "]\n"), inner).otherwise("")


def _cut(value: Column, n: Column) -> Column:
    """The value without its last ``n`` characters."""
    return F.substring(value, F.lit(1), F.length(value) - n)


def _wiki_links(text: Column) -> Column:
    def one(pieces: Column, piece: Column, i: Column) -> Column:
        embed = F.get(pieces, i - 1).endswith("!")
        return F.struct(F.lit("wiki").alias("style"), embed.alias("embed"), F.when(i > 0, _wiki_target(piece)).otherwise("").alias("target"))

    found = let(F.split(text, r"\[\[", -1), lambda pieces: F.transform(pieces, lambda p, i: one(pieces, p, i)))
    return F.filter(found, lambda x: x["target"] != "")


def _label(before: Column) -> Column:
    return F.substring_index(before, "[", -1)


def _md_target(before: Column, piece: Column) -> Column:
    """The target of a link whose label ends one piece and whose target begins the next; empty if it is none."""
    inner = F.substring_index(piece, ")", 1)
    target = F.get(F.split(inner, r"\s", 2), 0)
    title = F.trim(F.substring(inner, F.length(target) + 1, F.length(inner)))
    titled = (title == "") | ((F.length(title) > 1) & title.startswith('"') & title.endswith('"'))
    good = before.contains("[") & without(_label(before), "]\n") & piece.contains(")") & titled
    return F.when(good, target).otherwise("")


def _md_links(text: Column) -> Column:
    def one(before: Column, piece: Column) -> Column:
        embed = _cut(before, F.length(_label(before)) + 1).endswith("!")
        target = F.when(before.isNotNull(), _md_target(before, piece)).otherwise("")
        return F.struct(F.lit("md").alias("style"), embed.alias("embed"), target.alias("target"))

    found = let(F.split(text, r"\]\(", -1), lambda pieces: F.transform(pieces, lambda p, i: one(F.get(pieces, i - 1), p)))
    return F.filter(found, lambda x: x["target"] != "")


def links(text: Column) -> Column:
    """(style, embed, target) of the links: ``[[target]]``, then ``[label](target)``."""
    return F.when(text.contains("["), F.concat(_wiki_links(text), _md_links(text))).otherwise(F.expr(_NONE))


def _unmarked(value: Column) -> Column:
    """Without the ``!`` that makes what follows an embed."""
    return F.when(value.endswith("!"), _cut(value, F.lit(1))).otherwise(value)


def without_links(text: Column) -> Column:
    """The text without its links."""

    def of_wiki(piece: Column, following: Column, i: Column) -> Column:
        rest = let(
            _wiki_target(piece),
            lambda t: F.when(i == 0, piece).when(t != "", F.substring(piece, F.length(t) + 3, F.length(piece)))
            .otherwise(F.concat(F.lit("[["), piece)),
        )
        return F.when(_wiki_target(following) != "", _unmarked(rest)).otherwise(rest)

    def of_md(before: Column, piece: Column, following: Column, i: Column) -> Column:
        # Behind a link goes what its target was, in front of one its label.
        ends, begins = _md_target(before, piece) != "", _md_target(piece, following) != ""
        rest = F.when(i == 0, piece).when(ends, F.substring(piece, F.instr(piece, ")") + 1, F.length(piece)))
        rest = rest.otherwise(F.concat(F.lit("]("), piece))
        return let(rest, lambda r: F.when(begins, _unmarked(_cut(r, F.length(_label(r)) + 1))).otherwise(r))

    def joined(pieces: Column, of) -> Column:
        return F.array_join(F.transform(pieces, of), "")

    plain = let(F.split(text, r"\[\[", -1), lambda ps: joined(ps, lambda p, i: of_wiki(p, F.get(ps, i + 1), i)))
    bare = let(F.split(plain, r"\]\(", -1), lambda ps: joined(ps, lambda p, i: of_md(F.get(ps, i - 1), p, F.get(ps, i + 1), i)))
    return F.when(text.contains("["), bare).otherwise(text)


_NO_TAG = " \t\r\n#[](){}.,;:!?\"'`"


def tag_count(text: Column) -> Column:
    """Words behind a ``#`` that no word, slash, ampersand or other ``#`` stands in front of."""

    def is_tag(before: Column, piece: Column, i: Column) -> Column:
        free = F.when(before == "", i == 1).otherwise(~F.right(before, F.lit(1)).rlike(r"(?U)[\w/&]"))
        first = F.substring(piece, 1, 1)
        return (i > 0) & free & (first != "") & ~F.lit(_NO_TAG).contains(first) & ~first.rlike(r"\s")

    return let(F.split(text, "#", -1), lambda ps: F.size(F.filter(ps, lambda p, i: is_tag(F.get(ps, i - 1), p, i))))


# -- values ------------------------------------------------------------------------------------------

_SCHEMES = ("http://", "https://", "ftp://", "www.")


def is_url(value: Column) -> Column:
    low = F.lower(value)
    begins = F.lit(False)
    for scheme in _SCHEMES:
        begins = begins | (low.startswith(scheme) & (F.length(low) > len(scheme)))
    return begins & ~value.rlike(r"\s")


def _is_time(value: Column) -> Column:
    """hh:mm, with seconds, a fraction and a zone or not."""
    bare = F.regexp_replace(value, r"Z$|[+-][0-9]{2}:?[0-9]{2}$", "")
    whole, fraction = F.substring_index(bare, ".", 1), F.get(F.split(bare, r"\.", 2), 1)
    parts = F.split(whole, ":")
    return (
        F.size(parts).between(2, 3) & F.forall(parts, lambda p: only_digits(p, 2, 2))
        & F.coalesce(only_digits(fraction, 1, 40), F.lit(True))
    )


def is_date(value: Column) -> Column:
    """Year, month and day by dashes, with a time or not; or three numbers by dots or slashes."""
    day, rest = F.substring(value, 1, 10), F.substring(value, F.lit(11), F.length(value))
    ymd = F.split(day, "-")
    lengths = F.array(*map(F.lit, (4, 2, 2)))
    iso = (F.size(ymd) == 3) & F.forall(
        F.arrays_zip(ymd.alias("p"), lengths.alias("n")), lambda x: (F.length(x["p"]) == x["n"]) & only_digits(x["p"], 2, 4)
    )
    timed = (rest == "") | (F.substring(rest, 1, 1).isin("T", " ") & _is_time(F.substring(rest, F.lit(2), F.length(rest))))
    dmy = F.split(F.translate(value, "/", "."), r"\.")
    dotted = (F.size(dmy) == 3) & only_digits(F.get(dmy, 0), 1, 2) & only_digits(F.get(dmy, 1), 1, 2) & only_digits(F.get(dmy, 2), 2, 4)
    found = F.coalesce(F.when(value.contains("-"), iso & timed).otherwise(dotted), F.lit(False))
    return F.when(F.substring(value, 1, 1).between("0", "9"), found).otherwise(False)


def is_number(value: Column) -> Column:
    """Digits, in one run or in groups of three by blanks, with a sign and a fraction or not."""
    bare = F.when(F.substring(value, 1, 1).isin("+", "-"), F.substring(value, F.lit(2), F.length(value))).otherwise(value)
    halves = F.split(F.translate(bare, ",  ", ".  "), r"\.")
    groups = F.split(F.get(halves, 0), " ")
    grouped = only_digits(F.get(groups, 0), 1, 3) & F.forall(
        F.slice(groups, F.lit(2), F.size(groups)), lambda g: only_digits(g, 3, 3)
    )
    whole = F.when(F.size(groups) == 1, only_digits(F.get(groups, 0), 1, 10_000)).otherwise(grouped)
    found = F.when(F.size(halves) == 1, whole).when(F.size(halves) == 2, whole & only_digits(F.get(halves, 1), 1, 10_000)).otherwise(False)
    return F.when(F.substring(value, 1, 1).isin("+", "-", *"0123456789"), found).otherwise(False)


def is_money(value: Column, words: tuple[str, ...], signs: str) -> Column:
    """A number with a currency: a sign, or one word and perhaps its dot."""

    def named(unsigned: Column, word: Column) -> Column:
        bare = F.replace(F.replace(unsigned, F.concat(word, F.lit(".")), F.lit("")), word, F.lit(""))
        signed = (word == "") & (F.length(unsigned) < F.length(value))
        return F.when(signed | word.isin(*words), let(strip(F.when(signed, unsigned).otherwise(bare)), is_number)).otherwise(False)

    unsigned = F.translate(F.lower(value), signs, "")
    found = let(unsigned, lambda u: let(F.regexp_extract(u, r"\p{L}+", 0), lambda w: named(u, w)))
    return F.when(value.rlike("[0-9]"), found).otherwise(False)
