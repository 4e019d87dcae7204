"""Boolean trigram queries of regular expressions.

A query is True (no trigram is mandatory), or ("and" | "or", frozenset of trigrams and queries).
Trigrams are in lower case, as the index is built on lower-cased texts; so case never loses a candidate.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as grammar

#: Sets of exact strings above this size are turned into a query and forgotten.
MOST_STRINGS = 64
#: A character class of more members than this counts as any character.
MOST_CHARS = 8

Query = bool | tuple[str, frozenset]


def both(a: Query, b: Query) -> Query:
    return _joined("and", a, b)


def either(a: Query, b: Query) -> Query:
    return True if a is True or b is True else _joined("or", a, b)


def _joined(kind: str, a: Query, b: Query) -> Query:
    parts: set = set()
    for q in (a, b):
        if q is not True:
            parts |= q[1] if q[0] == kind or len(q[1]) == 1 else {q}
    if kind == "or":  # what demands more than another alternative adds nothing
        parts = {x for x in parts if not any(y != x and _demands(y) < _demands(x) for y in parts)}
    return (kind, frozenset(parts)) if parts else True


def _demands(part) -> frozenset:
    if isinstance(part, str):
        return frozenset({part})
    return part[1] if part[0] == "and" else frozenset({part})


def _of_strings(strings: set[str]) -> Query:
    """Each text holds one of the strings."""
    query: Query | None = None
    for s in strings:
        grams = frozenset(s[i : i + 3] for i in range(len(s) - 2))
        one: Query = ("and", grams) if grams else True
        query = one if query is None else either(query, one)
    return True if query is None else query


def _chars(items: list) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHARS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHARS else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """The exact strings that a sequence matches (None: not known), and the query that any match meets besides."""
    run, known = {""}, True  # strings since the last unknown part; whether there was none
    query: Query = True
    for kind, value in items:
        part, more = _part(kind, value)
        query = both(query, more)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
        else:
            query = both(query, _of_strings(run))
            run, known = part or {""}, False
    return (run, query) if known else (None, both(query, _of_strings(run)))


def _part(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, True
    if kind is op.IN:
        return _chars(value), True
    if kind is op.AT:
        return {""}, True
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), True
        each = [both(q, True if strings is None else _of_strings(strings)) for strings, q in parts]
        query = each[0]
        for q in each[1:]:
            query = either(query, q)
        return None, query
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, body = value
        inner, query = _walk(body)
        if inner is not None and (least, most) == (0, 1):
            return inner | {""}, True
        if inner is not None and least == most <= 8 and len(inner) ** least <= MOST_STRINGS:
            strings = {""}
            for _ in range(least):
                strings = {a + b for a in strings for b in inner}
            return strings, query
        if not least:
            return None, True
        return None, query if inner is None else both(query, _of_strings(inner))
    return None, True


def trigram_query(regex: str) -> Query:
    """What the lower-cased text of any match must hold."""
    strings, query = _walk(grammar.parse(regex))
    return query if strings is None else both(query, _of_strings(strings))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return set().union(*({x} if isinstance(x, str) else trigrams(x) for x in query[1]))


def holds(query: Query, text: str) -> bool:
    """Brute force, for tests."""
    if query is True:
        return True
    parts = [x in text if isinstance(x, str) else holds(x, text) for x in query[1]]
    return all(parts) if query[0] == "and" else any(parts)
