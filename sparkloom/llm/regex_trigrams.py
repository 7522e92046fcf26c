"""Boolean trigram queries from regular expressions.

``trigram_query(pattern)`` gives a condition on the trigrams of a text that every text with a match
satisfies: ``("and", ...)``, ``("or", ...)``, ``("gram", "abc")``, or ``ANY`` where a match needs none.
Patterns are parsed by the standard library; what it cannot say anything about counts as ``ANY``.
Texts and trigrams are compared in lower case, so the condition holds in either case.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

ANY = ("and",)
#: Sets of literal strings larger than this are given up for a weaker condition.
MOST = 32


def _parts(kind: str, parts: tuple) -> list:
    """The parts, those of the same kind opened, each once and in a fixed order."""
    return sorted({q for p in parts for q in (p[1:] if p[0] == kind else (p,))}, key=repr)


def _and(*parts):
    flat = _parts("and", parts)
    return flat[0] if len(flat) == 1 else ("and", *flat)


def _or(*parts):
    flat = _parts("or", parts)
    asks = [frozenset(q[1:] if q[0] == "and" else (q,)) for q in flat]
    # a or (a and b) is a; an empty "and" takes in everything
    flat = [q for q, x in zip(flat, asks) if not any(y < x for y in asks)]
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _grams(text: str):
    return _and(*[("gram", text[i : i + 3]) for i in range(len(text) - 2)])


def _strings(items) -> tuple[list[str] | None, tuple]:
    """(all strings a sequence can match, or None if they are too many; a condition on its matches)."""
    exact: list[str] | None = [""]
    seen: tuple = ANY
    whole = True

    def flush():
        nonlocal exact, seen
        if exact:
            seen = _and(seen, _or(*[_grams(x) for x in exact]))
        exact = [""]

    for op, arg in items:
        if op is sre.LITERAL:
            more, cond = [chr(arg).lower()], ANY
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            more, cond = sorted({chr(c).lower() for _, c in arg}), ANY
        elif op is sre.SUBPATTERN:
            more, cond = _strings(arg[-1])
        elif op is sre.BRANCH:
            branches = [_strings(b) for b in arg[1]]
            cond = _or(*[c if x is None else _and(c, _or(*[_grams(s) for s in x])) for x, c in branches])
            more = None if any(x is None for x, _ in branches) else sorted({s for x, _ in branches for s in x})
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner, cond = _strings(sub)
            if low == 0:
                more, cond = (sorted({"", *inner}) if inner is not None and high == 1 else None), ANY
            else:
                more = inner if low == high == 1 else None
        elif op is sre.AT:
            more, cond = [""], ANY
        else:
            more, cond = None, ANY
        seen = _and(seen, cond)
        if more is None or len(exact) * len(more) > MOST:
            whole = False
            flush()
            exact = list(more) if more is not None and len(more) <= MOST else [""]
        else:
            exact = sorted({a + b for a in exact for b in more})
    if whole:
        return exact, seen
    flush()
    return None, seen


def trigram_query(pattern: str) -> tuple:
    exact, cond = _strings(parser.parse(pattern))
    return cond if exact is None else _and(cond, _or(*[_grams(x) for x in exact]))


def grams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*[grams_of(q) for q in query[1:]])
