"""What a value looks like. Columns in, columns out; values are never kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partsight.functions import markdown as M
from partsight.functions.markdown import strip
from partsight.rules import profile as R


def unquote(value: Column) -> Column:
    s = strip(value)
    quoted = s.rlike(r"(?s)^(\"|').*\1$") & (F.length(s) >= 2)
    return F.when(quoted, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def shape(value: Column, limit: int = 32) -> Column:
    """Digits ``#``, Latin ``A``, Cyrillic ``Я``, other letters ``Ω``, some separators as they
    are, anything else ``?``; longer values end in ``…``."""
    s = strip(value)
    head = F.substring(s, 1, limit)
    # Control characters as placeholders keep the steps from undoing each other.
    marked = F.translate(head, "\x04\x05\x06\x07", "????")
    for pattern, mark in (
        (r"\p{Nd}", "\x04"), ("[A-Za-z]", "\x05"), (r"[\u0400-\u04ff&&\p{L}]", "\x06"), (r"\p{L}", "\x07"),
        ("[^- ./_\x04-\x07]", "?"),
    ):
        marked = F.regexp_replace(marked, pattern, mark)
    marked = F.translate(marked, "\x04\x05\x06\x07", "#AЯΩ")
    return F.concat(marked, F.when(F.length(s) > limit, "…").otherwise(""))


def id_key(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"(?U)[\s\-./_]+", ""))


def is_idlike(value: Column) -> Column:
    """A code rather than a price, a date or a word."""
    return M.let(strip(value), _is_idlike)


def _is_idlike(s: Column) -> Column:
    digits = F.length(F.regexp_replace(s, r"\P{Nd}", ""))
    alnum = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))
    blanks = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    plain = ~s.rlike("[^0-9A-Za-zА-Яа-яЁё _/.-]") & ~F.substring(s, 1, 1).isin("-", ".", "/", " ", "_")
    plain = plain & F.length(s).between(4, 35) & (blanks <= 4) & (digits >= 3) & (digits >= alnum * 0.4)
    return F.when(plain, ~s.rlike(r"\p{L}{5}") & ~M.is_date(s) & ~(M.is_number(s) & (digits < 7))).otherwise(False)


def target_name(target: Column) -> Column:
    """The file a link points to, without alias, heading and folder, lower case."""
    bare = strip(F.regexp_replace(target, r"(?s)[|#].*$", ""))
    return F.lower(F.regexp_replace(F.translate(bare, "\\", "/"), r"(?s)^.*/", ""))


def is_image_target(target: Column) -> Column:
    return target_name(target).rlike(rf"[^.].*\.(?:{'|'.join(R.IMAGE_EXTENSIONS)})$")


def value_type(value: Column) -> Column:
    """The first type that fits, in a fixed order."""
    return M.let(strip(unquote(value)), _type_of)


def _type_of(s: Column) -> Column:
    low = F.lower(s)
    # What a value of links alone is: 2 for an image among them, 1 for others, 0 for none.
    linked = F.when(
        s.contains("["),
        M.let(
            F.transform(M.links(s), lambda x: x["target"]),
            lambda t: F.when((F.size(t) == 0) | (F.translate(M.without_links(s), " ,;\t", "") != ""), 0)
            .when(F.exists(t, is_image_target), 2)
            .otherwise(1),
        ),
    ).otherwise(0)
    return M.let(linked, lambda kind: _type_by(s, low, kind))


def _type_by(s: Column, low: Column, linked: Column) -> Column:
    return (
        F.when((s == "") | low.isin("null", "~"), R.T_EMPTY)
        .when(low.isin(*R.BOOL_WORDS), R.T_BOOL)
        .when(linked == 2, R.T_IMAGE)
        .when(linked == 1, R.T_LINK)
        .when(M.is_url(s), R.T_URL)
        .when(M.is_date(s), R.T_DATE)
        .when(M.is_money(s, R.CURRENCY_WORDS, R.CURRENCY_SIGNS), R.T_MONEY)
        .when(is_idlike(s), R.T_CODE)
        .when(M.is_number(s), R.T_NUMBER)
        .otherwise(R.T_TEXT)
    )


def safe_label(name: Column, limit: int = 48) -> Column:
    """A name, or its shape or length when it looks like a value."""
    n = strip(F.regexp_replace(F.replace(name, F.lit("`"), F.lit("'")), r"(?U)\s+", " "))
    digits = F.length(F.regexp_replace(n, r"\P{Nd}", ""))
    looks = (digits >= 4) | n.contains("@") | n.contains("://") | F.lower(n).startswith("www.")
    return (
        F.when(n == "", "<boş ad>")
        .when(F.length(n) > limit, F.concat(F.lit("<uzun ad: "), F.length(n).cast("string"), F.lit(" karakter>")))
        .when(looks, F.concat(F.lit("<değer benzeri ad: "), shape(n), F.lit(">")))
        .otherwise(n)
    )


def bucket(size: Column, steps, beyond: str, *, inclusive: bool) -> Column:
    out = F.when(F.lit(False), "")
    for top, label in steps:
        out = out.when(size <= top if inclusive else size < top, label)
    return out.otherwise(beyond)


def size_bucket(size: Column) -> Column:
    return bucket(size, R.SIZE_BUCKETS, R.SIZE_BEYOND, inclusive=False)


def embed_bucket(n: Column) -> Column:
    return bucket(n, R.EMBED_BUCKETS, R.EMBED_BEYOND, inclusive=True)


def extension_label(ext: Column) -> Column:
    """A plain extension, "none" or "other"."""
    return (
        F.when(ext == "", R.NO_EXTENSION)
        .when(ext.rlike(r"^\.[a-z0-9]{1,8}$"), ext)
        .otherwise(R.OTHER)
    )
