"""Parser definitions carry Python regular expressions; Spark runs Java ones."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

try:  # the parse tree moved in Python 3.11
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Ported:
    java: str
    n_groups: int
    names: tuple  # ((name, index), ...) in group order
    optional: frozenset  # names of groups that may not take part in a match
    anchored: bool
    literal: str  # longest text every match must contain ('' if unknown)


@lru_cache(maxsize=None)
def port(pattern: str) -> Ported:
    """Translate one pattern and read off what the compiler needs to know."""
    compiled = re.compile(pattern)
    tree = _p.parse(pattern)
    names = tuple(sorted(compiled.groupindex.items(), key=lambda kv: kv[1]))
    optional_ids: set[int] = set()
    _optional_groups(tree, False, optional_ids)
    flags = "(?d" + ("s" if compiled.flags & re.DOTALL else "") + (
        "i" if compiled.flags & re.IGNORECASE else "") + (
        "m" if compiled.flags & re.MULTILINE else "") + ")"
    anchored = bool(len(tree)) and tree[0] == (_c.AT, _c.AT_BEGINNING) and not compiled.flags & re.MULTILINE
    literal = "" if compiled.flags & re.IGNORECASE else _required_literal(tree)
    return Ported(
        java=flags + _unname(pattern, compiled.groupindex),
        n_groups=compiled.groups,
        names=names,
        optional=frozenset(n for n, i in names if i in optional_ids),
        anchored=anchored,
        literal=literal,
    )


def _unname(pattern: str, index) -> str:
    """Named groups become plain ones; named back references become numbers."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            # Java treats '[' and '&&' inside a class as operators
            out.append("\\[" if ch == "[" else "\\&" if ch == "&" else ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            for lead in ("^", "]"):  # a leading ']' is literal
                if pattern.startswith(lead, i):
                    out.append("\\]" if lead == "]" else lead)
                    i += 1
            continue
        m = re.compile(r"\(\?P<\w+>").match(pattern, i)
        if m:
            out.append("(")
            i = m.end()
            continue
        m = re.compile(r"\(\?P=(\w+)\)").match(pattern, i)
        if m:
            out.append(f"\\{index[m.group(1)]}")
            i = m.end()
            continue
        m = re.compile(r"\(\?[aiLmsux]+\)").match(pattern, i)
        if m:  # global flags are set in the prefix
            i = m.end()
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def _optional_groups(tree, inside: bool, found: set[int]) -> None:
    for op, arg in tree:
        if op is _c.SUBPATTERN:
            gid, _, _, sub = arg
            if inside and gid:
                found.add(gid)
            _optional_groups(sub, inside, found)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", None)):
            lo, _, sub = arg
            _optional_groups(sub, inside or lo == 0, found)
        elif op is _c.BRANCH:
            for sub in arg[1]:
                _optional_groups(sub, True, found)


def _required_literal(tree) -> str:
    runs, cur = [], []

    def walk(t):
        for op, arg in t:
            if op is _c.LITERAL:
                cur.append(chr(arg))
                continue
            if op is _c.SUBPATTERN and not arg[1]:
                walk(arg[3])
                continue
            if op is _c.AT:
                continue
            runs.append("".join(cur))
            cur.clear()

    walk(tree)
    runs.append("".join(cur))
    return max(runs, key=len)
