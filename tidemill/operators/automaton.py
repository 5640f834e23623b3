"""An automaton for row patterns: greedy, leftmost, no row in two matches.

A pattern is a sequence of elements, each a variable with a quantifier. A thread
is a place in the pattern with the values its conditions refer to (registers) and
the rows taken by each element. All starts run side by side, so a row is looked
at once and never again:

- Threads of one start are kept in order of preference (staying in an element
  before going on). Two at one place with equal registers have one future; the
  preferred one stays. A thread that may end a match notes it and ends the less
  preferred ones.
- The first start is decided when its threads are gone. Its match, if it noted
  one, removes the starts it covers. Once it has noted one, starts up to there
  are gone for good, whatever comes.
- A later start's thread with the place and registers of an earlier start's has
  the same future and is covered by it; it is dropped, unless a match was noted
  between the two starts (``epoch``), which could cover only the earlier.

What is kept therefore depends on the pattern and the registers, not on how long
a run of rows is. The rest of a run depends on the state alone, so a state may
be given by its shape and filled in later: see ``Machine.at`` and ``Effect``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

_QUANTIFIER = re.compile(r"[*+?]?|\{\d+(,\d*)?\}")
_INF = float("inf")

Pattern = Sequence[tuple[str, str]]  # (variable, quantifier)


def bounds(quantifier: str) -> tuple[int, float]:
    """Fewest and most rows of a quantifier."""
    if not _QUANTIFIER.fullmatch(quantifier):
        raise ValueError(f"not a quantifier: {quantifier!r}")
    fixed = {"": (1, 1), "*": (0, _INF), "+": (1, _INF), "?": (0, 1)}
    if quantifier in fixed:
        return fixed[quantifier]
    low, comma, high = quantifier[1:-1].partition(",")
    return int(low), float(high) if high else (_INF if comma else int(low))


@dataclass(frozen=True)
class Ref:
    """A value of a row matched before: the last or first one of ``variable``, or of any variable (None)."""

    variable: str | None
    field: str
    which: str = "last"


@dataclass(frozen=True)
class Test:
    """A condition on the row at hand and on rows matched before it.

    ``holds`` gets the row's ``fields``, then the values of ``refs``. Where one of
    them is null, or no such row was matched, the condition does not hold.
    """

    __test__ = False  # not a test case

    fields: tuple[str, ...]
    refs: tuple[Ref, ...]
    holds: Callable[..., bool]


class Rules:
    """A compiled pattern."""

    def __init__(self, pattern: Pattern, tests: dict[str, Test] | None = None, measures: Sequence[tuple[str, str | None, str]] = ()):
        tests = tests or {}
        self.variables = list(dict.fromkeys(name for name, _ in pattern))
        unknown = set(tests) - set(self.variables)
        if unknown:
            raise ValueError(f"conditions for variables that the pattern lacks: {sorted(unknown)}")
        self.names = [name for name, _ in pattern]
        self.bit = [1 << self.variables.index(name) for name in self.names]
        limits = [bounds(q) for _, q in pattern]
        # Places: (element, rows taken of it), the count held where more make no difference.
        tops = [int(max(low, 1) if high == _INF else high) for low, high in limits]
        places = [(e, c) for e, top in enumerate(tops) for c in range(1, top + 1)]
        number = {place: i + 1 for i, place in enumerate(places)}  # 0 is the place before the pattern
        self.options: list[list[tuple[int, int]]] = []
        self.ends: list[bool] = []
        for e, c in [(-1, 0), *places]:
            found = []
            if e >= 0 and c < limits[e][1]:
                found.append((e, number[e, min(c + 1, tops[e])]))
            open_ = e < 0 or c >= limits[e][0]
            for after in range(e + 1, len(pattern)):
                if not open_:
                    break
                if limits[after][1] > 0:
                    found.append((after, number[after, 1]))
                open_ = limits[after][0] == 0
            self.options.append(found)
            self.ends.append(e >= 0 and open_)
        self.tests = [tests.get(name) for name in self.names]
        self.refs = list(dict.fromkeys(r for t in tests.values() for r in t.refs))
        self._places = [[self.refs.index(r) for r in t.refs] if t else [] for t in self.tests]
        self.measures = list(measures)  # (kind, variable or None, field)
        self.fields = sorted({f for t in tests.values() for f in t.fields} | {r.field for r in self.refs} | {f for k, _, f in self.measures if k != "count"})
        # Registers and measures that a row taken by an element changes.
        self.sets = [[(i, r) for i, r in enumerate(self.refs) if r.variable in (None, name)] for name in self.names]
        self.adds = [[(i, k, f) for i, (k, v, f) in enumerate(self.measures) if v in (None, name)] for name in self.names]
        self.first_bits = 0
        for e, _ in self.options[0]:
            self.first_bits |= self.bit[e]
        self.zero = (0,) * len(pattern)
        self.unset = (None,) * len(self.refs)
        self.nothing = tuple(0 if k == "count" else None for k, _, _ in self.measures)

    def holds(self, element: int, registers: tuple, row: dict) -> bool:
        test = self.tests[element]
        if test is None:
            return True
        values = [row[f] for f in test.fields] + [registers[i] for i in self._places[element]]
        return not any(v is None for v in values) and bool(test.holds(*values))

    def taken(self, element: int, registers: tuple, row: dict) -> tuple:
        if not self.sets[element]:
            return registers
        out = list(registers)
        for i, ref in self.sets[element]:
            if ref.which == "last" or out[i] is None:
                out[i] = row[ref.field]
        return tuple(out)

    def measured(self, element: int, values: tuple, row: dict) -> tuple:
        if not self.adds[element]:
            return values
        out = list(values)
        for i, kind, name in self.adds[element]:
            value = None if kind == "count" else row[name]
            if kind == "count":
                out[i] += 1
            elif kind == "last" or (kind == "first" and out[i] is None):
                out[i] = value
            elif value is not None and kind in ("sum", "min", "max"):
                out[i] = value if out[i] is None else {"sum": lambda a, b: a + b, "min": min, "max": max}[kind](out[i], value)
        return tuple(out)


@dataclass
class Thread:
    place: int
    registers: tuple
    counts: tuple  # rows of each element, besides those of ``parent``
    measures: tuple
    parent: tuple[int, int] | None = None  # the start and thread it comes from, in the state the run began with


@dataclass
class Noted:
    """A match a start may end with; ``epoch`` is the first of starts behind it."""

    counts: tuple | None  # None: the one the start had noted before the run began
    measures: tuple
    parent: tuple[int, int] | None
    epoch: int


@dataclass
class Start:
    origin: int  # position, or -1 - i for the i-th start of the state the run began with
    epoch: int
    noted: Noted | None
    threads: list[Thread]


Shape = tuple  # (epoch, ((epoch, epoch behind the noted match or None, ((place, registers), …)), …)), epochs by rank
RESET: Shape = (0, ())


@dataclass
class Effect:
    """What a run of rows did to a state of one shape."""

    shape: Shape
    starts: list[tuple]  # (origin, noted, [(parent, counts), …]); noted is None, "old" or (parent, counts)
    crossing: list[tuple]  # matches of starts from before: (origin, noted)


@dataclass
class State:
    """The starts behind a shape: position, counts of the noted match, counts of each thread."""

    starts: list[tuple] = field(default_factory=list)

    def _noted(self, origin: int, noted) -> tuple | None:
        if noted is None or noted == "old":
            return self.starts[-1 - origin][1] if noted == "old" else None
        return self._counts(*noted)

    def _counts(self, parent, counts) -> tuple:
        if parent is None:
            return counts
        return tuple(a + b for a, b in zip(self.starts[parent[0]][2][parent[1]], counts, strict=True))

    def _position(self, origin: int) -> int:
        return origin if origin >= 0 else self.starts[-1 - origin][0]

    def after(self, effect: Effect) -> tuple[State, list[tuple]]:
        """The state behind the run, and the matches of starts from before as (position, counts)."""
        found = [(self._position(origin), self._noted(origin, noted)) for origin, noted in effect.crossing]
        rest = [(self._position(o), self._noted(o, n), [self._counts(*t) for t in threads]) for o, n, threads in effect.starts]
        return State(rest), found


class Machine:
    """One run over rows in order."""

    def __init__(self, rules: Rules, shape: Shape = RESET):
        self.rules = rules
        self.epoch = shape[0]
        self.starts = [
            Start(
                -1 - i,
                epoch,
                Noted(None, (), None, behind) if behind is not None else None,
                [Thread(p, r, rules.zero, rules.nothing, (i, t)) for t, (p, r) in enumerate(threads)],
            )
            for i, (epoch, behind, threads) in enumerate(shape[1])
        ]
        self.found: list[tuple[int, Noted]] = []

    def idle(self, mask: int) -> bool:
        """Whether a row with this mask changes nothing."""
        return not self.starts and not mask & self.rules.first_bits

    def step(self, position: int, mask: int, row: dict) -> None:
        """The next row: the variables it may be, as bits, and its fields."""
        rules = self.rules
        starts, seen, noted = [], set(), False
        fresh = Start(position, self.epoch, None, [Thread(0, rules.unset, rules.zero, rules.nothing)])
        for start in (*self.starts, fresh):
            own, kept = set(), []
            for thread in start.threads:
                for element, place in rules.options[thread.place]:
                    if not mask & rules.bit[element] or not rules.holds(element, thread.registers, row):
                        continue
                    registers = rules.taken(element, thread.registers, row)
                    if (place, registers) in own:
                        continue
                    own.add((place, registers))
                    counts = (*thread.counts[:element], thread.counts[element] + 1, *thread.counts[element + 1 :])
                    kept.append(Thread(place, registers, counts, rules.measured(element, thread.measures, row), thread.parent))
            for i, thread in enumerate(kept):
                if rules.ends[thread.place]:
                    start.noted = Noted(thread.counts, thread.measures, thread.parent, self.epoch + 1)
                    noted = True
                    del kept[i + 1 :]
                    break
            start.threads = []
            for thread in kept:
                name = (start.epoch, thread.place, thread.registers)
                if rules.options[thread.place] and name not in seen:
                    seen.add(name)
                    start.threads.append(thread)
            if start.threads or start.noted:
                starts.append(start)
        self.epoch += noted
        self.starts = starts
        self._decide()

    def _decide(self, end: bool = False) -> None:
        while self.starts:
            first = self.starts[0]
            if first.noted:
                self.starts[1:] = [s for s in self.starts[1:] if s.epoch >= first.noted.epoch]
            if first.threads and not end:
                return
            if first.noted:
                self.found.append((first.origin, first.noted))
            self.starts.pop(0)

    def end(self) -> None:
        """No rows follow."""
        self._decide(end=True)

    def take(self) -> list[tuple[int, Noted]]:
        """Matches of starts within the run so far; those of earlier ones stay for ``effect``."""
        own = [m for m in self.found if m[0] >= 0]
        self.found = [m for m in self.found if m[0] < 0]
        return own

    def effect(self) -> Effect:
        """What the run did, once the matches within it are taken."""
        used = sorted({self.epoch, *(s.epoch for s in self.starts), *(s.noted.epoch for s in self.starts if s.noted)})
        rank = {e: i for i, e in enumerate(used)}
        note = lambda n: None if n is None else "old" if n.counts is None else (n.parent, n.counts)
        shape = (
            rank[self.epoch],
            tuple((rank[s.epoch], rank[s.noted.epoch] if s.noted else None, tuple((t.place, t.registers) for t in s.threads)) for s in self.starts),
        )
        starts = [(s.origin, note(s.noted), [(t.parent, t.counts) for t in s.threads]) for s in self.starts]
        return Effect(shape, starts, [(o, note(n)) for o, n in self.found])


def ended(shape: Shape, state: State) -> list[tuple[int, tuple]]:
    """The matches of a state behind which no rows follow."""
    out, starts = [], list(zip(shape[1], state.starts, strict=True))
    while starts:
        (_, behind, _), (position, noted, _) = starts.pop(0)
        if behind is not None:
            out.append((position, noted))
            starts = [s for s in starts if s[0][0] >= behind]
    return out
