"""Patterns of Python's dialect in Java's, and the literal text that each of their matches holds."""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's flags for Python's meaning of \s, \w, \b, case and line ends.
FLAGS = "(?idmuU)"
#: Signs that ignoring case takes for i, s or k, though their small forms differ (or are longer).
_ODD, _PLAIN = "İıſK", "iisk"
_FLAG_SIGNS = {re.I: "i", re.M: "m", re.S: "s", re.X: "x"}
_AT = {
    c.AT_BEGINNING: "^", c.AT_BEGINNING_STRING: r"\A", c.AT_END: "$", c.AT_END_STRING: r"\z", c.AT_BOUNDARY: r"\b", c.AT_NON_BOUNDARY: r"\B",
}
#: Python's white space holds four separators more than Java's.
_CATEGORY = {
    c.CATEGORY_DIGIT: r"\d", c.CATEGORY_NOT_DIGIT: r"\D", c.CATEGORY_SPACE: r"\s\x1c-\x1f", c.CATEGORY_NOT_SPACE: r"\S&&[^\x1c-\x1f]", c.CATEGORY_WORD: r"\w", c.CATEGORY_NOT_WORD: r"\W",
}


def _sign(code: int) -> str:
    if code > 0xFFFF:
        return rf"\x{{{code:x}}}"
    ch = chr(code)
    return ch if ch.isalnum() and ch.isascii() else f"\\u{code:04x}"


def _small(items: list) -> list:
    """A set with the small forms of its capitals beside them, for texts without capitals."""
    out = list(items)
    for op, av in items:
        if op is c.LITERAL:
            out.append((op, _folded_code(av)))
        elif op is c.RANGE:
            if av[1] > 127:
                raise _Unfit
            lo, hi = max(av[0], 65), min(av[1], 90)
            if lo <= hi:
                out.append((op, (lo + 32, hi + 32)))
    return out


class _Unfit(ValueError):
    """A pattern that small letters don't serve."""


def _folded_code(code: int) -> int:
    if code > 127:
        raise _Unfit
    return ord(chr(code).lower())


def _set(items: list) -> str:
    if len(items) == 1 and items[0][0] is c.CATEGORY:
        return f"[{_CATEGORY[items[0][1]]}]"
    negated, out = "", ""
    for op, av in items:
        if op is c.NEGATE:
            negated = "^"
        elif op is c.LITERAL:
            out += _sign(av)
        elif op is c.RANGE:
            out += f"{_sign(av[0])}-{_sign(av[1])}"
        else:
            out += f"[{_CATEGORY[av]}]"
    return f"[{negated}{out}]"


def _repeat(low: int, high: int) -> str:
    if high is c.MAXREPEAT and low < 2:
        return "*+"[low]
    return "?" if (low, high) == (0, 1) else f"{{{low},{'' if high is c.MAXREPEAT else high}}}"


def _repeated(tree, small: bool) -> str:
    one = len(tree) == 1 and tree[0][0] in (c.LITERAL, c.NOT_LITERAL, c.ANY, c.IN)
    return _written(tree, small) if one else f"(?:{_written(tree, small)})"


def _written(tree, small: bool = False) -> str:
    out = ""
    for op, av in tree:
        if op is c.LITERAL:
            out += _sign(_folded_code(av) if small else av)
        elif op is c.NOT_LITERAL:
            out += _set([(c.NEGATE, None), *(_small([(c.LITERAL, av)]) if small else [(c.LITERAL, av)])])
        elif op is c.ANY:
            out += "."
        elif op is c.IN:
            out += _set(_small(av) if small else av)
        elif op is c.AT:
            out += _AT[av]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            out += _repeated(av[2], small) + _repeat(av[0], av[1]) + {c.MAX_REPEAT: "", c.MIN_REPEAT: "?", c.POSSESSIVE_REPEAT: "+"}[op]
        elif op is c.SUBPATTERN:
            group, more, less, inner = av
            if small and (more | less) & re.I:
                raise _Unfit
            flags = "".join(s for f, s in _FLAG_SIGNS.items() if more & f), "".join(s for f, s in _FLAG_SIGNS.items() if less & f)
            head = "(" if group is not None else f"(?{flags[0]}{'-' if flags[1] else ''}{flags[1]}:"
            out += f"{head}{_written(inner, small)})"
        elif op is c.ATOMIC_GROUP:
            out += f"(?>{_written(av, small)})"
        elif op is c.BRANCH:
            out += f"(?:{'|'.join(_written(x, small) for x in av[1])})"
        elif op in (c.ASSERT, c.ASSERT_NOT):
            out += f"(?{'<' if av[0] < 0 else ''}{'=' if op is c.ASSERT else '!'}{_written(av[1], small)})"
        elif op is c.GROUPREF:
            out += rf"(?:\{av})"
        elif op is c.FAILURE:
            out += "(?!)"
        else:
            raise ValueError(f"Java has no form of {str(op).lower()} in a pattern")
    return out


def java(pattern: str, flags: int = re.IGNORECASE | re.MULTILINE) -> str:
    """A pattern of Python's dialect with its flags, as Spark's functions take it.

    Groups keep their numbers, names go; sets, look-around, lazy, possessive and atomic parts, back-references and inline flags keep
    their meaning. A condition on a group has no form in Java and is refused.
    """
    tree = _parser.parse(pattern, flags)
    on = tree.state.flags
    return "(?d" + "".join(s for f, s in _FLAG_SIGNS.items() if on & f and s != "x") + ("" if on & re.A else "uU") + ")" + _written(tree)


def java_of_folded(pattern: str, flags: int = re.IGNORECASE | re.MULTILINE) -> str | None:
    """As java(), for a pattern that ignores case, to be tried on folded() text: without case to ignore, Java finds literals far faster.

    Folding keeps every sign's place, so that matches stand where they do in the text. None where the pattern heeds case or names
    letters beyond ASCII. A pattern that begins with a choice looks first whether the sign is one with which a match can begin.
    """
    tree = _parser.parse(pattern, flags)
    on = tree.state.flags
    if not on & re.I or on & re.A:
        return None
    try:
        return "(?d" + "".join(s for f, s in _FLAG_SIGNS.items() if on & f and s in "ms") + "U)" + _look(tree) + _written(tree, small=True)
    except _Unfit:
        return None


def _begins(tree) -> tuple[list[str], bool]:
    """(signs, in small letters, and sets of them of which each match that isn't empty begins with one; whether a match may be empty)."""
    out: list[str] = []
    for op, av in tree:
        if op in (c.AT, c.ASSERT, c.ASSERT_NOT):  # they only forbid some of the matches
            continue
        if op is c.LITERAL:
            own, empty = [_sign(_folded_code(av))], False
        elif op is c.IN and av[0][0] is not c.NEGATE:
            own, empty = [x for item in _small(av) for x in _signs(*item)], False
        elif op is c.SUBPATTERN or op is c.ATOMIC_GROUP:
            own, empty = _begins(av[3] if op is c.SUBPATTERN else av)
        elif op is c.BRANCH:
            each = [_begins(x) for x in av[1]]
            own, empty = [s for signs, _ in each for s in signs], any(e for _, e in each)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            own, empty = _begins(av[2])
            empty |= av[0] == 0
        else:
            raise _Unfit
        out += own
        if not empty:
            return out, False
    return out, True


def _signs(op, av) -> list[str]:
    """An item of a set, sign by sign, as Java looks single signs up at once."""
    if op is c.CATEGORY:
        return [f"[{_CATEGORY[av]}]"]
    return [_sign(x) for x in (range(av[0], av[1] + 1) if op is c.RANGE else [av])]


def _look(tree) -> str:
    """A look at the first sign, so that most places cost no try of the pattern; none before a literal, which Java seeks fast itself."""
    if not len(tree) or tree[0][0] is c.LITERAL:
        return ""
    try:
        signs, empty = _begins(tree)
    except _Unfit:
        return ""
    return "" if empty else f"(?=[{''.join(dict.fromkeys(signs))}])"


def _runs(tree) -> list[str]:
    """Literal runs that each match of a sequence holds; an empty one stands where something else may come in between."""
    runs = [""]
    for op, av in tree:
        if op is c.LITERAL:
            runs[-1] += chr(av)
        elif op is c.SUBPATTERN or op is c.ATOMIC_GROUP:
            inner = _runs(av[3] if op is c.SUBPATTERN else av)
            runs[-1] += inner[0]
            runs += inner[1:]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            if av[0] > 0:  # at least once: its first run follows what is before, its last one ends it
                inner = _runs(av[2])
                runs[-1] += inner[0]
                runs += inner[1:]
            runs.append("")
        elif op is not c.AT and op not in (c.ASSERT, c.ASSERT_NOT):
            runs.append("")
    return runs


def _flat(tree) -> list:
    """The items of a sequence, with those of groups without a number or flags in their place."""
    return [x for op, av in tree for x in (_flat(av[3]) if op is c.SUBPATTERN and av[0] is None and not av[1] and not av[2] else [(op, av)])]


def _refers(tree) -> bool:
    """Whether a sequence holds a back-reference or sets flags."""
    for op, av in tree:
        if op in (c.GROUPREF, c.GROUPREF_EXISTS) or (op is c.SUBPATTERN and (av[1] or av[2])):
            return True
        inner = av[1] if op is c.BRANCH else [av[3]] if op is c.SUBPATTERN else [av[2]] if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) else [av] if op is c.ATOMIC_GROUP else [av[1]] if op in (c.ASSERT, c.ASSERT_NOT) else []
        if any(_refers(x) for x in inner):
            return True
    return False


def _endless(tree) -> bool:
    """Whether a sequence holds any signs without a bound."""
    for op, av in tree:
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and av[1] is c.MAXREPEAT and any(x is c.ANY for x, _ in av[2]):
            return True
        inner = av[1] if op is c.BRANCH else [av[3]] if op is c.SUBPATTERN else [av[2]] if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) else [av] if op is c.ATOMIC_GROUP else [av[1]] if op in (c.ASSERT, c.ASSERT_NOT) else []
        if any(_endless(x) for x in inner):
            return True
    return False


def _before(items: list) -> list:
    """What stands right before the end of each match of a sequence, in bounded length: the items behind the last one without a bound, and one turn of that."""
    out: list = []
    for op, av in reversed(items):
        if op is c.SUBPATTERN and len(items) and not av[1] and not av[2]:
            inner = _flat(av[3])
            part = _before(inner)
            out = part + out
            if part != inner:
                return out
            continue
        if op in (c.MAX_REPEAT, c.MIN_REPEAT) and av[1] is c.MAXREPEAT:
            return (_before(_flat(av[2])) if av[0] else []) + out
        if op not in (c.LITERAL, c.NOT_LITERAL, c.IN, c.ANY, c.AT, c.BRANCH, c.MAX_REPEAT, c.MIN_REPEAT) or not _bounded([(op, av)]):
            return out
        out = [(op, av), *out]
    return out


def _bounded(tree) -> bool:
    """Whether Java sees a longest match of a sequence, so that it may stand in a look behind."""
    for op, av in tree:
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            if av[1] is c.MAXREPEAT or av[1] > 20 or not _bounded(av[2]):
                return False
        elif op is c.BRANCH or op is c.SUBPATTERN:
            if not all(_bounded(x) for x in (av[1] if op is c.BRANCH else [av[3]])):
                return False
        elif op not in (c.LITERAL, c.NOT_LITERAL, c.IN, c.ANY, c.AT):
            return False
    return True


def sought(pattern: str, flags: int = re.IGNORECASE | re.MULTILINE) -> list[str]:
    """Patterns for folded() text that are all found wherever java_of_folded() of this one is, and in little else, each beginning with one of its literals.

    Java leaps from literal to literal, so that a text without a match is gone through far faster; what stands before the literal is
    looked for behind it. None for the literal with which the pattern begins, as Java seeks that one anyway. What follows a gap that
    crosses lines is left out, as each literal would seek it up to the text's end.
    """
    tree = _parser.parse(pattern, flags)
    low = java_of_folded(pattern, flags)
    if low is None or _refers(tree):
        return []
    items = _flat(tree)
    runs, out, k = [], [], 0
    while k < len(items):
        end = k
        while end < len(items) and items[end][0] is c.LITERAL:
            end += 1
        if k and end - k >= 4:
            runs.append((k, end))
        k = end + 1
    for k, end in sorted(runs, key=lambda r: r[0] - r[1])[:3]:
        held, before = _written(items[k:end], small=True), _written(_before(items[:k]), small=True)
        near = next((j for j in range(end, len(items)) if flags & re.S and _endless(items[j : j + 1])), len(items))
        out.append(low[: low.index(")") + 1] + held + (f"(?<={before}{held})" if before else "") + _written(items[end:near], small=True))
    return out


def literal(pattern: str) -> str:
    """The longest text, folded as folded() does, that each match of a Python pattern holds; empty if there is none."""
    return max((fold(r) for r in _runs(_parser.parse(pattern, re.IGNORECASE))), key=len)


def literals(pattern: str) -> list[str]:
    """All texts, folded as folded() does, that each match of a Python pattern holds, the longest first; of short ones only the longest."""
    runs = sorted({fold(r) for r in _runs(_parser.parse(pattern, re.IGNORECASE))} - {""}, key=lambda r: (-len(r), r))
    return [r for r in runs if len(r) > 2] or runs[:1]


def fold(text: str) -> str:
    return text.translate(str.maketrans(_ODD, _PLAIN)).lower()


def folded(text: Column) -> Column:
    """Text in small letters, such that what a pattern finds ignoring case holds the pattern's literals."""
    for odd, plain in zip(_ODD, _PLAIN):  # sought as they are; translate() looks each sign of the text up
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)
