"""Phrases of word lists as regular expressions.

A phrase is a row of blank-separated items: a word (``стем*`` for any ending, ``_`` for a
blank that may lack), ``@LIST`` for one of a
word list, ``?item`` for an optional one, ``~n`` for up to n words of any kind and
``!@LIST`` for a word that must not come next. ``ё`` also stands for ``е``. Punctuation that ends a
sentence never lies inside a phrase.
"""

from __future__ import annotations

#: What may stand between two words of a phrase.
BETWEEN = r"[\s,:;\"'«»()–—-]+"


def word(item: str) -> str:
    body = item.removesuffix("*").replace(".", r"\.").replace("ё", "[её]").replace("_", r"\s*")
    return body + (r"\w*" if item.endswith("*") else "")


def any_of(words: str) -> str:
    return "(?:" + "|".join(word(w) for w in words.split()) + ")"


def phrase(text: str, lists: dict[str, str]) -> str:
    """The pattern of a phrase, between word boundaries."""

    def item(token: str) -> str:
        return any_of(lists[token[1:]]) if token.startswith("@") else word(token)

    out, rest = r"\b", text.split()
    for i, token in enumerate(rest):
        last = i == len(rest) - 1
        if token.startswith("!"):
            out += rf"\b(?!{BETWEEN}{item(token[1:])}\b)" + ("" if last else BETWEEN)
        elif token.startswith("~"):
            out += rf"(?:\w+{BETWEEN}){{0,{token[1:]}}}?"
        elif token.startswith("?"):
            out += f"(?:{item(token[1:])}{BETWEEN})?"
        else:
            out += item(token) + ("" if last or rest[i + 1].startswith("!") else BETWEEN)
    return out + r"\b"


def rules(code: str, script: str, phrases: str, lists: dict[str, str]) -> list[tuple[str, str, str]]:
    """One rule per line of ``phrases``."""
    lines = [line.strip() for line in phrases.strip().splitlines()]
    return [(code, script, phrase(line, lists)) for line in lines if line]
