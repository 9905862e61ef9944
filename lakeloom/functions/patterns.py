"""Whether a regular expression can run away on executors: ambiguity of its automaton.

A backtracking matcher takes exponential time where one text can be read in two ways around a loop. The pattern's
positions form an automaton without empty steps; it is ambiguous in this way if some pair of different runs over
the same characters starts in one state and meets there again. This is a search over pairs of positions,
no guess from the pattern's looks: `(ab+c)+` is fine, `(a|aa)*` is not.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

#: Positions of an automaton that are looked at; patterns that come to more are refused.
MOST_POSITIONS = 400
#: A repetition of more than `UNROLLED` times counts as one without end.
UNROLLED = 12

_CATEGORY = {
    op.CATEGORY_DIGIT: lambda c: c.isdigit(),
    op.CATEGORY_NOT_DIGIT: lambda c: not c.isdigit(),
    op.CATEGORY_SPACE: lambda c: c.isspace(),
    op.CATEGORY_NOT_SPACE: lambda c: not c.isspace(),
    op.CATEGORY_WORD: lambda c: c.isalnum() or c == "_",
    op.CATEGORY_NOT_WORD: lambda c: not (c.isalnum() or c == "_"),
}


class TooLarge(ValueError):
    """A pattern of more positions than are looked at."""


class _Automaton:
    """Positions of a pattern, what each reads, and which follow which; `twice` holds steps that there are two ways to take."""

    def __init__(self, tree, fold: bool, branches: bool) -> None:
        self.fold, self.branches = fold, branches
        self.alike = False  # two ways that read nothing of their own to tell them apart
        self.reads: list[tuple] = []
        self.follow: list[set[int]] = []
        self.twice: set[tuple[int, int]] = set()
        self._sequence(tree)

    def _position(self, kind, value) -> tuple[set[int], set[int], bool]:
        if len(self.reads) >= MOST_POSITIONS:
            raise TooLarge
        self.reads.append((kind, value))
        self.follow.append(set())
        here = {len(self.reads) - 1}
        return here, set(here), False

    def _step(self, ends: set[int], starts: set[int]) -> None:
        for a in ends:
            for b in starts:
                if b in self.follow[a]:
                    self.twice.add((a, b))
                self.follow[a].add(b)

    def _sequence(self, items) -> tuple[set[int], set[int], bool]:
        """First positions, last positions, and whether the empty text matches."""
        first, last, empty = set(), set(), True
        for kind, value in items:
            f, l, e = self._item(kind, value)
            self._step(last, f)
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def _repeat(self, low: int, high, body) -> tuple[set[int], set[int], bool]:
        endless = high == op.MAXREPEAT or high > UNROLLED
        copies = min(low, UNROLLED) if endless else high
        first, last, empty = set(), set(), True
        for n in range(max(1, copies)):
            f, l, e = self._sequence(body)
            self.alike |= e and bool(f) and high != op.MAXREPEAT and high > UNROLLED  # of so many bodies any may be the empty ones
            e = e or n >= low
            self._step(last, f)
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
            if endless and n == max(1, copies) - 1:
                self._step(l, f)
        return first, last, empty

    def _item(self, kind, value) -> tuple[set[int], set[int], bool]:
        if kind is op.IN and self.branches and value[0][0] is not op.NEGATE:
            # The parser makes one set of branches of a character each; apart, they show whether they overlap.
            parts = [self._position(op.IN, [item]) for item in value]
            return set().union(*(f for f, _, _ in parts)), set().union(*(l for _, l, _ in parts)), False
        if kind in (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN):
            return self._position(kind, value)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            return self._repeat(*value)
        if kind is op.SUBPATTERN:
            return self._sequence(value[-1])
        if kind is op.ATOMIC_GROUP:
            return self._sequence(value)
        if kind is op.BRANCH:
            first, last, empty = set(), set(), False
            for branch in value[1]:
                f, l, e = self._sequence(branch)
                self.alike |= empty and e  # equal beginnings are taken out of branches, so equal branches end up empty
                first, last, empty = first | f, last | l, empty or e
            return first, last, empty
        if kind in (op.GROUPREF, op.GROUPREF_EXISTS):  # stands for anything
            return self._repeat(0, op.MAXREPEAT, [(op.ANY, None)])
        if kind in (op.ASSERT, op.ASSERT_NOT):
            self._sequence(value[1])  # a loop of its own, that nothing leads to
        return set(), set(), True

    def characters(self) -> list[str]:
        """Characters that tell all positions apart: the ends of ranges and their neighbours, and one of each kind."""
        found = set("a_0 \n-!Zé가")
        for kind, value in self.reads:
            for k, v in value if kind is op.IN else [(kind, value)]:
                for code in (v,) if k in (op.LITERAL, op.NOT_LITERAL) else v if k is op.RANGE else ():
                    found |= {chr(c) for c in (code - 1, code, code + 1) if 0 <= c < 0x110000 and not 0xD800 <= c < 0xE000}
        return sorted(found)

    def can_read(self, position: int, char: str) -> bool:
        kind, value = self.reads[position]
        forms = {char, char.lower(), char.upper()} if self.fold else {char}
        if kind is op.ANY:
            return True
        if kind is op.LITERAL:
            return chr(value) in forms
        if kind is op.NOT_LITERAL:
            return chr(value) not in forms
        hit = lambda k, v: any(len(c) == 1 and (ord(c) == v if k is op.LITERAL else v[0] <= ord(c) <= v[1] if k is op.RANGE else _CATEGORY[v](c) if k is op.CATEGORY and v in _CATEGORY else False) for c in forms)
        negated = value[0][0] is op.NEGATE
        return any(hit(k, v) for k, v in value[negated:]) != negated

    def ambiguous(self) -> bool:
        """Whether two different runs over one text lead from some state back to it."""
        if self.alike:
            return True
        chars = self.characters()
        reads = [{c for c in chars if self.can_read(p, c)} for p in range(len(self.reads))]
        meet = lambda a, b: bool(reads[a] & reads[b])
        after = lambda pair: {(a, b) for a in self.follow[pair[0]] for b in self.follow[pair[1]] if meet(a, b)}

        def reach(start: tuple[int, int]) -> set[tuple[int, int]]:
            seen, todo = set(), [start]
            while todo:
                for pair in after(todo.pop()):
                    if pair not in seen:
                        seen.add(pair)
                        todo.append(pair)
            return seen

        for q in range(len(reads)):
            around = reach((q, q))
            if (q, q) not in around:
                continue  # in no loop
            for a, b in self.twice:
                if (a, a) in around | {(q, q)} and (b, b) in around and (q, q) in reach((b, b)) | {(b, b)}:
                    return True
            if any(a != b and (q, q) in reach((a, b)) for a, b in around):
                return True
        return False


def runs_away(pattern: str) -> bool:
    """Whether a text can make a backtracking matcher take exponential time over a pattern; True for one that is too large to tell."""
    tree = parser.parse(pattern)
    try:
        branches = "|" in re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", pattern)
        return _Automaton(tree, bool(tree.state.flags & re.IGNORECASE), branches).ambiguous()
    except TooLarge:
        return True
