"""Weighted context-free grammars over text, parsed by Earley's algorithm with regular expressions as terminals.

A grammar is text, one rule a line: `name weight -> symbol symbol ...`. A symbol in quotes is a literal, one
between slashes a regular expression, anything else a rule name; `name=symbol` captures what the symbol covers.
The score of a parse is the product of the weights of its rules; of several parses of one text the highest
scoring is kept (of equal ones the first found, rules being tried in order).

A terminal matches in one way at a place, so terminals that follow one another are one terminal, each part of it
atomic: rules are compiled so, and a rule that is the only one of its name and has terminals alone is put where
its name stands. What is left to the chart are the places where rules are chosen; there only the rules are looked
at whose first character can be the next one. Alternatives of the start that are bound to score less than a parse
that has been found are not tried.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from re import _constants as _ops, _parser

_RULE = re.compile(r"(\w+)\s+([0-9.]+)\s*->\s*(.*)")
_SYMBOL = re.compile(r"""(?:(\w+)=)?(?:"((?:[^"\\]|\\.)*)"|/((?:[^/\\]|\\.)*)/|(\w+))(?=\s|$)""")


@dataclass(frozen=True)
class Rule:
    name: str
    weight: float  # logarithm
    symbols: tuple[tuple[str | None, str | None, str | None], ...]  # capture, pattern or None, name or None


@dataclass(frozen=True)
class Terminal:
    """Terminals in a row: one pattern, and the captured parts of it as (name, group)."""

    match: object
    captures: tuple[tuple[str, int], ...]
    parts: tuple[object, ...]
    first: frozenset[int] | None  # None where it can be empty

    def reach(self, text: str, position: int) -> int:
        """How far the terminals one after the other come."""
        for part in self.parts:
            m = part(text, position)
            if not m:
                break
            position = m.end()
        return position


@dataclass(frozen=True)
class State:
    """A rule with a dot before one of its symbols; the next state is one further."""

    name: str
    weight: float
    terminal: Terminal | None
    awaits: str | None  # name of the rule that is to follow; with neither the rule is complete
    capture: str | None


#: An item is one number: its state, and behind so many bits the place where its rule began.
_BITS = 40
_PLACE = (1 << _BITS) - 1

_EVERY = frozenset(range(128))
_REPEATS = (_ops.MAX_REPEAT, _ops.MIN_REPEAT, _ops.POSSESSIVE_REPEAT)


def _first(tree) -> tuple[frozenset[int], bool]:
    """ASCII characters that a match of a parsed pattern can begin with, and whether it can be empty. What is not told
    here counts as any character."""
    found: frozenset[int] = frozenset()
    for op, value in tree:
        if op is _ops.LITERAL:
            return found | {value, *map(ord, chr(value).swapcase()[:1])}, False
        if op is _ops.IN:
            some = set()
            for kind, item in value:
                if kind is _ops.LITERAL:
                    some |= {item, *map(ord, chr(item).swapcase()[:1])}
                elif kind is _ops.RANGE and item[1] < 128:
                    some |= {c for k in range(item[0], item[1] + 1) for c in (k, *map(ord, chr(k).swapcase()))}
                elif kind is _ops.CATEGORY and item is _ops.CATEGORY_DIGIT:
                    some |= set(range(48, 58))
                else:
                    return _EVERY, False
            return found | some, False
        if op in (_ops.ASSERT, _ops.ASSERT_NOT, _ops.AT):
            continue
        if op is _ops.SUBPATTERN or op is _ops.ATOMIC_GROUP:
            more, empty = _first(value[-1] if op is _ops.SUBPATTERN else value)
        elif op is _ops.BRANCH:
            parts = [_first(p) for p in value[1]]
            more, empty = frozenset().union(*(p[0] for p in parts)), any(p[1] for p in parts)
        elif op in _REPEATS:
            more, empty = _first(value[2])
            empty = empty or value[0] == 0
        else:
            return _EVERY, False
        found |= more
        if not empty:
            return found, False
    return found, True


def _read(text: str) -> list[Rule]:
    rules = []
    for line in filter(None, map(str.strip, text.splitlines())):
        m = _RULE.fullmatch(line)
        if not m:
            raise ValueError(f"not a rule: {line}")
        symbols, at = [], 0
        while at < len(m[3]):
            s = _SYMBOL.match(m[3], at)
            if not s:
                raise ValueError(f"not a symbol: {m[3][at:]}")
            pattern = None
            if s[3] is not None:
                pattern = s[3].replace(r"\/", "/")
            elif s[2] is not None:
                pattern = re.escape(re.sub(r"\\(.)", r"\1", s[2]))
            symbols.append((s[1], pattern, s[4]))
            at = s.end()
            while at < len(m[3]) and m[3][at].isspace():
                at += 1
        rules.append(Rule(m[1], math.log(float(m[2])), tuple(symbols)))
    return rules


class Grammar:
    """loose: rules whose terminals do not count as attempts when nothing else parses (see Parse.unparsed)."""

    def __init__(self, text: str, start: str, loose: tuple[str, ...] = ()):
        rules: dict[str, list[Rule]] = {}
        for rule in _read(text):
            rules.setdefault(rule.name, []).append(rule)
        for rule in (r for alternatives in rules.values() for r in alternatives):
            for _, pattern, name in rule.symbols:
                if pattern is None and name not in rules:
                    raise ValueError(f"no rule {name}")
        self.start, self.loose = start, frozenset(loose)
        self.states: list[State] = []
        self.begins: dict[str, list[int]] = {}  # name -> states that begin its rules
        for name, alternatives in rules.items():
            self.begins[name] = [self._compiled(rule, rules) for rule in alternatives]
        self.chosen: dict[tuple[str, str], list[int]] = {}
        bounds = {number: self._most(rule, rules, ()) for number, rule in zip(self.begins[start], rules[start])}
        #: alternatives of the start whose score is bounded are tried last, and only if they can win
        self.late = [n for n, most in bounds.items() if most < math.inf]
        self.early = [n for n in self.begins[start] if n not in self.late]
        self.bound = max((bounds[n] for n in self.late), default=-math.inf)

    def _most(self, rule: Rule, rules: dict[str, list[Rule]], above: tuple[str, ...]) -> float:
        """The highest score that a rule can have; infinite where it repeats."""
        if rule.name in above:
            return math.inf
        way = (*above, rule.name)
        return rule.weight + sum(max(self._most(r, rules, way) for r in rules[name]) for _, pattern, name in rule.symbols if pattern is None)

    def _begins_at(self, name: str, char: str) -> list[int]:
        """States that begin the rules of a name where the next character (empty at the end) is this one."""
        key = (name, char if char < "\x80" else "\x80")
        found = self.chosen.get(key)
        if found is None:
            def can(number: int) -> bool:
                terminal = self.states[number].terminal
                return terminal is None or terminal.first is None or key[1] == "\x80" or (char != "" and ord(char) in terminal.first)

            found = self.chosen[key] = [n for n in self.begins[name] if can(n)]
        return found

    def _compiled(self, rule: Rule, rules: dict[str, list[Rule]]) -> int:
        begin, weight = len(self.states), rule.weight
        row: list[str] = []
        names: list[str] = []
        made: list[tuple[Terminal | None, str | None, str | None]] = []

        def close() -> None:
            if row:
                pattern = re.compile("".join(row), re.S)
                captures = tuple((name.split("__")[0], pattern.groupindex[name]) for name in names)
                first, empty = _first(_parser.parse(pattern.pattern, re.S))
                parts = tuple(re.compile(p, re.S).match for p in row)
                made.append((Terminal(pattern.match, captures, parts, None if empty else first), None, None))
                row.clear()
                names.clear()

        def terminals(symbols) -> tuple[str, float] | None:
            """One pattern for symbols that are terminals, or stand for a single rule of such."""
            parts, more = [], 0.0
            for capture, pattern, name in symbols:
                if pattern is None:
                    alone = rules[name]
                    inner = terminals(alone[0].symbols) if len(alone) == 1 and name != rule.name else None
                    if inner is None:
                        return None
                    body, more = inner[0], more + inner[1] + alone[0].weight
                else:
                    body = f"(?>{pattern})"
                if capture:
                    label = f"{capture}__{len(names)}"
                    names.append(label)
                    body = f"(?P<{label}>{body})"
                parts.append(body)
            return "".join(parts), more

        for symbol in rule.symbols:
            kept = len(names)
            got = terminals([symbol])
            if got is not None:
                row.append(got[0])
                weight += got[1]
                continue
            del names[kept:]
            close()
            made.append((None, symbol[2], symbol[0]))
        close()
        for terminal, name, capture in [*made, (None, None, None)]:
            self.states.append(State(rule.name, weight, terminal, name, capture))
        return begin

    def parse(self, text: str, trace: bool = False) -> "Parse":
        """The best parse of the whole text, and with trace how far the attempts came that are not loose.

        An item is a state and its rule's origin; charts[position] maps it to (score, trail), the trail being the linked list of
        captures behind its dot. Positions are those that terminals reach. A rule that begins with a terminal enters
        the chart behind it, so what does not match costs one look."""
        best, reached = self._parsed(text, self.early, trace) if self.early else (None, 0)
        if self.late and (best is None or best[0] < self.bound):
            other, further = self._parsed(text, self.late, trace)
            if other is not None and (best is None or other[0] > best[0]):
                best = other
            reached = max(reached, further)
        if best is None:
            return Parse(text, -math.inf, None, reached)
        spans: dict[str, tuple[int, int]] = {}
        _collect(best[1], spans)
        return Parse(text, best[0], spans, reached)

    def _parsed(self, text: str, start: list[int], trace: bool) -> tuple[tuple | None, int]:
        """(score and trail of the best parse by these alternatives of the start, how far attempts came)."""
        states, loose, end, chosen = self.states, self.loose, len(text), self.chosen
        charts: dict[int, dict[int, tuple]] = {0: {}}
        waits: dict[int, dict[str, list[int]]] = {}
        agenda = [0]
        reached, best = 0, None
        while agenda:
            position = min(agenda) if len(agenda) > 1 else agenda[0]
            agenda.remove(position)
            chart = charts[position]
            waiting: dict[str, list[int]] = {}
            waits[position] = waiting
            finished: dict[str, list] = {}
            queue = list(chart)
            pending = [""] if position == 0 else []
            char = text[position:position + 1]
            while queue or pending:
                if pending:
                    # predict a rule at this position; the start is named by nothing
                    name = pending.pop()
                    numbers = (chosen.get((name, char)) or self._begins_at(name, char)) if name else start
                    for number in numbers:
                        state = states[number]
                        terminal = state.terminal
                        if terminal is None:
                            item = number << _BITS | position
                            if item not in chart:
                                chart[item] = (state.weight, None)
                                queue.append(item)
                            continue
                        m = terminal.match(text, position)
                        if trace and state.name not in loose:
                            reached = max(reached, terminal.reach(text, position))
                        if m is None:
                            continue
                        to = m.end()
                        trail = (None, None, [(n, *m.span(g)) for n, g in terminal.captures]) if terminal.captures else None
                        item = number + 1 << _BITS | position
                        target = charts.get(to)
                        if target is None:
                            target = charts[to] = {}
                            agenda.append(to)
                        known = target.get(item)
                        if known is None or state.weight > known[0]:
                            target[item] = (state.weight, trail)
                            if to == position:
                                queue.append(item)
                    continue
                item = queue.pop()
                score, trail = chart[item]
                state = states[item >> _BITS]
                name = state.awaits
                if name is not None:
                    known = waiting.get(name)
                    if known is None:
                        waiting[name] = [item]
                        pending.append(name)
                    elif item not in known:
                        known.append(item)
                    if finished:
                        for done, inside in finished.get(name, ()):
                            self._advance(chart, queue, item, (score, trail), done, inside, position, position)
                elif state.terminal is not None:
                    terminal = state.terminal
                    m = terminal.match(text, position)
                    if trace and state.name not in loose:
                        reached = max(reached, terminal.reach(text, position))
                    if m is None:
                        continue
                    to = m.end()
                    if terminal.captures:
                        trail = (trail, None, [(n, *m.span(g)) for n, g in terminal.captures])
                    item += 1 << _BITS
                    target = charts.get(to)
                    if target is None:
                        target = charts[to] = {}
                        agenda.append(to)
                    known = target.get(item)
                    if known is None or score > known[0]:
                        target[item] = (score, trail)
                        if to == position:
                            queue.append(item)
                else:
                    name, origin = state.name, item & _PLACE
                    if position == end and origin == 0 and name == self.start and (best is None or score > best[0]):
                        best = (score, trail)
                    if origin == position:
                        finished.setdefault(name, []).append((score, trail))
                    before = charts[origin]
                    for parent in waits[origin].get(name, ()):
                        self._advance(chart, queue, parent, before[parent], score, trail, origin, position)
        return best, reached

    def _advance(self, chart, queue, parent, parent_state, score, trail, start, position) -> None:
        parent_score, parent_trail = parent_state
        name = self.states[parent >> _BITS].capture
        item, total = parent + (1 << _BITS), parent_score + score
        known = chart.get(item)
        if known is None or total > known[0]:
            if name:
                trail = (parent_trail, trail, [(name, start, position)])
            elif trail is None:
                trail = parent_trail
            elif parent_trail is not None:
                trail = (parent_trail, trail, ())
            chart[item] = (total, trail)
            queue.append(item)


def _collect(trail, spans: dict[str, tuple[int, int]]) -> None:
    """The captured spans; of a name captured more than once the last."""
    pending = [trail]
    while pending:
        node = pending.pop()
        if node is None:
            continue
        before, inside, captured = node
        for name, start, end in captured:
            spans.setdefault(name, (start, end))
        pending += [before, inside]


@dataclass(frozen=True)
class Parse:
    """spans: what was captured, None if nothing parses. unparsed: where the furthest attempt stopped, if traced."""

    text: str
    score: float
    spans: dict[str, tuple[int, int]] | None
    unparsed: int

    def get(self, name: str) -> str | None:
        span = self.spans and self.spans.get(name)
        return None if span is None else self.text[span[0]:span[1]]
