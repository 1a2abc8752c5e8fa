"""CSS selectors over a page's elements.

A selector is read into lists of steps, and a step is one condition on an element. The page's elements are an array in
document order, an element stands at its position in it, and it knows its parent, its ancestors, its last descendant and
the sibling before it. A complex selector is evaluated from left to right: the positions that its first steps have
found decide, by these numbers, which elements the next step may take. So a step is one pass over the page's array, no
row of it leaves its task, and what a selector says becomes data for the next step instead of a deeper expression.

Supported: types, ``*``, ids, classes, attributes (``= ~= |= ^= $= *=``, quoted or not, with ``i`` and ``s``); descendants,
``>``, ``+``, ``~`` and lists; ``:not``, ``:is``, ``:where`` (any selectors), ``:has`` (of descendants and, after ``>``, of
children), ``:root``, ``:empty``, ``:first-child``, ``:last-child``, ``:only-child``, ``:nth-child``, ``:nth-last-child``
and the same of types. Anything else raises ValueError; no part of a selector is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"-?(?:[a-zA-Z_]|[^\x00-\x7f])(?:[\w-]|[^\x00-\x7f])*|--[\w-]+"
_NAME = re.compile(NAME)
_ATTRIBUTE = re.compile(rf"""\[\s*({NAME})\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|({NAME}|[\w-]+))\s*([iIsS])?\s*)?\]""")
_NTH = re.compile(r"^\s*(?:(even|odd)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


@dataclass
class Step:
    """What an element has to be; how it stands to the step before."""

    how: str = ""
    tests: list[tuple] = field(default_factory=list)


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self) -> ValueError:
        return ValueError(f"selector not supported: {self.text!r}, at {self.text[self.at : self.at + 20]!r}")

    def peek(self, *options: str) -> bool:
        return self.text.startswith(options, self.at)

    def take(self, pattern: re.Pattern) -> re.Match:
        m = pattern.match(self.text, self.at)
        if not m:
            raise self.fail()
        self.at = m.end()
        return m

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in " \t\n\r\f":
            self.at += 1
        return self.at > start

    def selectors(self, inner: bool = False, relative: bool = False) -> list[list[Step]]:
        """A list of complex selectors, up to the end or the closing bracket."""
        out = []
        while True:
            self.space()
            out.append(self.steps(relative))
            self.space()
            if self.peek(","):
                self.at += 1
            elif (self.at == len(self.text)) if not inner else self.peek(")"):
                return out
            else:
                raise self.fail()

    def steps(self, relative: bool) -> list[Step]:
        how = ""
        if relative:
            how = " "
            if self.peek(">"):
                how, self.at = ">", self.at + 1
                self.space()
        out = [self.step(how)]
        while True:
            blank = self.space()
            if self.at == len(self.text) or self.peek(",", ")"):
                return out
            how = " "
            if self.peek(">", "+", "~"):
                how, self.at = self.text[self.at], self.at + 1
                self.space()
            elif not blank:
                raise self.fail()
            out.append(self.step(how))

    def step(self, how: str) -> Step:
        step, start = Step(how), self.at
        if self.peek("*"):
            self.at += 1
        elif m := _NAME.match(self.text, self.at):
            self.at = m.end()
            step.tests.append(("tag", m[0].lower()))
        while self.at < len(self.text):
            if self.peek("#", "."):
                kind, self.at = self.text[self.at], self.at + 1
                value = self.take(re.compile(r"(?:[\w-]|[^\x00-\x7f])+") if kind == "#" else _NAME)[0]
                step.tests.append(("attr", "id", "=", value, False) if kind == "#" else ("attr", "class", "~=", value, False))
            elif self.peek("["):
                m = self.take(_ATTRIBUTE)
                value = next((x for x in m.group(3, 4, 5) if x is not None), "")
                step.tests.append(("attr", m[1].lower(), m[2] or "", value, (m[6] or "").lower() == "i"))
            elif self.peek("::"):
                raise self.fail()
            elif self.peek(":"):
                self.at += 1
                step.tests.append(self.pseudo())
            else:
                break
        if self.at == start:
            raise self.fail()
        return step

    def pseudo(self) -> tuple:
        start = self.at - 1
        name = self.take(_NAME)[0].lower()
        if self.peek("("):
            self.at += 1
            if name in ("not", "is", "where", "has"):
                inner = self.selectors(True, name == "has")
                self.at += 1
                return ("has", inner) if name == "has" else ("not" if name == "not" else "is", inner)
            end = self.text.find(")", self.at)
            if m := re.fullmatch(r"nth-(last-)?(child|of-type)", name):
                n = _NTH.match(self.text[self.at : end]) if end >= 0 else None
                if n:
                    self.at = end + 1
                    a, b = (2, 0 if n[1].lower() == "even" else 1) if n[1] else (0, int(n[5])) if n[5] else (int(n[2] + "1") if n[2] in ("", "+", "-") else int(n[2]), int((n[3] or "+") + (n[4] or "0")))
                    return ("nth", m[2], bool(m[1]), a, b)
        elif name in ("root", "empty"):
            return (name,)
        elif m := re.fullmatch(r"(first|last|only)-(child|of-type)", name):
            ends = {"first": [False], "last": [True], "only": [False, True]}[m[1]]
            return ("all", [("nth", m[2], end, 0, 1) for end in ends])
        self.at = start
        raise self.fail()


def parse(selector: str) -> list[list[Step]]:
    return _Reader(selector).selectors()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _attribute(e: Column, name: str, how: str, value: str, fold: bool) -> Column:
    a = F.element_at(e["attrs"], name)
    if not how:
        return a.isNotNull()
    words = F.split(a, r"[ \t\n\r\f]+")
    if fold:
        a, value, words = F.lower(a), value.lower(), F.transform(words, F.lower)
    v = F.lit(value)
    if how in ("^=", "$=", "*=") and not value or how == "~=" and (not value or re.search(r"\s", value)):
        return F.lit(False)
    if how == "~=":
        return F.array_contains(words, v)
    return {"=": lambda: a == v, "|=": lambda: (a == v) | F.startswith(a, F.lit(value + "-")), "^=": lambda: F.startswith(a, v), "$=": lambda: F.endswith(a, v), "*=": lambda: F.contains(a, v)}[how]()


def _test(elements: Column, e: Column, test: tuple, found: dict[int, Column]) -> Column:
    kind = test[0]
    if kind == "tag":
        return e["tag"] == test[1]
    if kind == "attr":
        return _attribute(e, *test[1:])
    if kind == "root":
        return e["parent"] < 0
    if kind == "empty":
        return (e["last"] == e["pos"]) & (e["end"] == e["start"])
    if kind == "all":
        return _all(_test(elements, e, t, found) for t in test[1])
    if kind == "nth":
        _, of, last, a, b = test
        at, n = ("nth", "of") if of == "child" else ("nth_type", "of_type")
        k = (e[n] - e[at] + 1 if last else e[at]) - b
        return k == 0 if a == 0 else (k % abs(a) == 0) & (k * (1 if a > 0 else -1) >= 0)
    if kind == "has":
        hit = F.exists(found[id(test)], lambda q: (q["pos"] > e["pos"]) & (q["pos"] <= e["last"]) & (~q["child"] | (q["parent"] == e["pos"])))
        return hit
    inside = F.array_contains(found[id(test)], e["pos"])
    return ~inside if kind == "not" else inside


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def _nested(steps: list[Step]) -> list[tuple]:
    return [t for s in steps for t in s.tests if t[0] in ("not", "is", "has")]


def _complex(elements: Column, steps: list[Step], use: Callable[[Column], Column]) -> Column:
    """use(positions found by the steps)."""

    def with_nested(todo: list[tuple], found: dict[int, Column]) -> Column:
        if not todo:
            return walk(0, None, found)
        test = todo[0]
        if test[0] == "has":
            return _has(elements, test[1], lambda q: with_nested(todo[1:], {**found, id(test): q}))
        return _listed(elements, test[1], lambda p: with_nested(todo[1:], {**found, id(test): p}))

    def walk(k: int, before: Column | None, found: dict[int, Column]) -> Column:
        if k == len(steps):
            return use(before)
        step = steps[k]

        def fits(e: Column) -> Column:
            out = _all(_test(elements, e, t, found) for t in step.tests)
            if before is not None:
                out &= {" ": lambda: F.arrays_overlap(e["above"], before), ">": lambda: F.array_contains(before, e["parent"]), "+": lambda: F.array_contains(before, e["before"]), "~": lambda: F.exists(before, lambda p: (p < e["pos"]) & (F.get(elements, p)["parent"] == e["parent"]))}[step.how]()
            return F.coalesce(out, F.lit(False))

        return _let(F.transform(F.filter(elements, fits), lambda e: e["pos"]), lambda p: walk(k + 1, p, found))

    return with_nested(_nested(steps), {})


def _listed(elements: Column, branches: list[list[Step]], use: Callable[[Column], Column]) -> Column:
    """use(positions found by any of the selectors, in document order)."""
    if len(branches) == 1:
        return _complex(elements, branches[0], use)
    each = [_complex(elements, b, lambda p: p) for b in branches]
    return _let(F.array_sort(F.array_distinct(F.concat(*each))), use)


def _has(elements: Column, branches: list[list[Step]], use: Callable[[Column], Column]) -> Column:
    """use(the elements found below, with their parent and whether they must be children)."""
    each = []
    for b in branches:
        if b[0].how == ">" and len(b) > 1:
            raise ValueError("selector not supported: steps after :has(> x)")
        child = F.lit(b[0].how == ">")
        plain = [Step("", b[0].tests), *b[1:]]
        each.append(_complex(elements, plain, lambda p: F.transform(p, lambda q: F.struct(q.alias("pos"), F.get(elements, q)["parent"].alias("parent"), child.alias("child")))))  # noqa: B023
    return _let(F.concat(*each), use)


def positions(elements: Column, selector: str) -> Column:
    """Where the elements that a selector finds stand, in document order."""
    return _listed(elements, parse(selector), lambda p: p)


def select(elements: Column, selector: str) -> Column:
    """The elements a selector finds, in document order; null where there are no elements."""
    return F.transform(positions(elements, selector), lambda p: F.get(elements, p))
