"""Full-text search: tokens of a document, and a web-style query as its parts or as a boolean Column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, and words that are joined to one name: of hosts, paths, addresses and hyphenated words. In Java and in Python.
WORD, COMPOUND = r"[\p{L}\p{N}]+", r"/?[\p{L}\p{N}]+(?:[-._/@:+]+[\p{L}\p{N}]+)+|/[\p{L}\p{N}]+"
_WORD, _COMPOUND = (re.compile(x.replace(r"[\p{L}\p{N}]", r"[^\W_]")) for x in (WORD, COMPOUND))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; no stems and no stop words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def compounds(text: Column) -> Column:
    """Lower-case compound tokens: each name of joined words, and the host and the path of one that has both."""
    whole = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(COMPOUND), 0)
    return F.array_distinct(F.flatten(F.transform(whole, lambda x: F.when(F.locate("/", x) > 1, F.array(x, F.substring_index(x, "/", 1), F.concat(F.lit("/"), F.substring(x, F.locate("/", x) + 1, F.length(x))))).otherwise(F.array(x)))))


def parts_of(compound: str) -> list[str]:
    """The same for one compound of plain code."""
    at = compound.find("/")
    return [compound, compound[:at], compound[at:]] if at > 0 else [compound]


def positions(text: str) -> dict[str, list[int]]:
    """Where each token of a lower-case text stands: words by number from 0, compounds where their first word does."""
    found: dict[str, list[int]] = {}
    starts = []
    for i, m in enumerate(_WORD.finditer(text)):
        found.setdefault(m[0], []).append(i)
        starts.append(m.start())
    at = 0
    for m in _COMPOUND.finditer(text):
        for part, shift in zip(parts_of(m[0]), (0, 0, m[0].find("/")), strict=False):
            while at < len(starts) and starts[at] < m.start() + shift:
                at += 1
            held = found.setdefault(part, [])
            if not held or held[-1] != at:
                held.append(at)
    return found


@dataclass(frozen=True)
class Term:
    """Words in a row, or one compound token, that a document has to have or must not have."""

    words: tuple[str, ...]
    minus: bool = False


def parse(query: str) -> list[list[Term]]:
    """The parts of a query of which any may answer, each a list of terms that all must: words are all needed, "..." is a
    row of words, a leading - rules out, and `or` between two parts lets either do. A name of joined words is one
    token, but within quotes its words. A query without words has no parts."""
    any_of: list[list[Term]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if plain.lower() == "or" and not minus:
            any_of.append([])
            continue
        text = (quoted or plain).lower()
        whole = _COMPOUND.search(text) if plain else None
        if whole and whole[0] == text.strip("-._@:+,;!?()[]{}'\""):
            any_of[-1].append(Term((whole[0],), bool(minus)))
        elif words := _WORD.findall(text):
            any_of[-1].append(Term(tuple(words), bool(minus)))
    return [part for part in any_of if part]


def _holds(of: Column, names: Column | None, words: tuple[str, ...]) -> Column:
    """The words in a row."""
    if len(words) == 1:
        whole = _COMPOUND.fullmatch(words[0])
        return F.array_contains(names, words[0]) if whole and names is not None else F.array_contains(of, words[0])
    row = F.array(*map(F.lit, words))
    starts = F.sequence(F.lit(1), F.greatest(F.size(of) - len(words) + 1, F.lit(1)))
    return F.array_contains(of, words[0]) & F.exists(starts, lambda i: F.slice(of, i, len(words)) == row)


def matches(of: Column, query: str, names: Column | None = None) -> Column:
    """Whether a token array `of`, with its text's compounds `names`, answers a query; one without words matches nothing."""
    ready = [reduce(Column.__and__, (~_holds(of, names, x.words) if x.minus else _holds(of, names, x.words) for x in part)) for part in parse(query)]
    return reduce(Column.__or__, ready) if ready else F.lit(False)


def pattern(part: str) -> str:
    """The pattern of a substring search, in which % and _ of the part are wild cards and a backslash takes the next
    character as it is."""
    out, text = "", f"%{part}%"
    i = 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            i += 1
            out += f"\\{text[i]}" if text[i] in "%_\\" else text[i]
        else:
            out += text[i]
        i += 1
    return out


def literals(part: str) -> list[str]:
    """The runs of plain characters of a substring search, in lower case."""
    out, found, i, text = [], "", 0, pattern(part)
    while i < len(text):
        if text[i] in "%_":
            out.append(found)
            found = ""
        else:
            i += text[i] == "\\"
            found += text[i]
        i += 1
    return [x.lower() for x in [*out, found] if x]


def contains(text: Column, part: str) -> Column:
    """Case-insensitive substring search in which % and _ of the part are wild cards, as in ILIKE."""
    return F.coalesce(text.ilike(pattern(part)), F.lit(False))
