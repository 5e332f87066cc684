"""Small building blocks of string expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from logloom.functions import sql as F
from logloom.functions.sql import E

#: A noncharacter, never part of interchanged text, between the groups of one match.
MARK = "﷐"
#: Fixed value: the white space of Unicode.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: E, use: Callable[[E], E]) -> E:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def decoded(payload: E) -> E:
    """The text of a payload, wrong bytes replaced, line ends dropped."""
    return F.rtrim(F.make_valid_utf8(payload.cast("string")), F.lit("\r\n"))


def stripped(text: E) -> E:
    """Without Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACE))


def unmarked(text: E) -> E:
    """The text with the mark between groups, should it hold one, made a replacement character: lines are written by
    others, and a mark of theirs is not to be read as one of ours."""
    return F.when(text.contains(MARK), F.replace(text, F.lit(MARK), F.lit("\ufffd"))).otherwise(text)


def count_of(text: E, char: str) -> E:
    """How often an ASCII character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def numbered(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with its named groups made plain ones, and name -> group number. Java knows no names with `_`."""
    out, names, groups, at, in_class = [], {}, 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at:at + 2])
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            # a bracket right behind the opening one is an ordinary character
            follow = pattern[at + 1:at + 2] == "^"
            if pattern[at + 1 + follow:at + 2 + follow] == "]":
                out.append(pattern[at:at + 1 + follow] + "\\]")
                at += 2 + follow
                continue
        elif c == "(":
            if m := re.match(r"\(\?P<(\w+)>", pattern[at:]):
                groups += 1
                names[m[1]] = groups
                out.append("(")
                at += m.end()
                continue
            if pattern.startswith("(?P", at):
                raise ValueError("named references are not supported")
            if pattern[at + 1:at + 2] != "?":
                groups += 1
        out.append(c)
        at += 1
    return "".join(out), names


#: `.` stops at line feeds alone. Classes such as \\d stay ASCII: Java pays for Unicode ones on every character.
FLAGS = "(?d)"


def captured(text: E, pattern: str, groups: list[int], anchored: bool = False, rest: bool = False) -> E:
    """The given groups of the first match as an array, and with rest what follows the match; null without a match.

    One run of the pattern yields all groups: the match is replaced by its groups with a mark between them."""
    before = "^" if anchored else "(?s:^.*?)"
    total = re.compile(pattern).groups
    wanted = "".join(f"{MARK}${g}" for g in groups) + (f"{MARK}${total + 1}" if rest else "")
    replaced = F.regexp_replace(unmarked(text), f"{FLAGS}{before}(?:{pattern})(?s:(.*))\\z", f"{wanted}{MARK}")
    return let(F.split(replaced, MARK, -1), lambda p: F.when(F.size(p) > 1, F.slice(p, 2, len(groups) + rest)))
