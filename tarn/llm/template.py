"""A sandboxed template language, compiled to Python closures.

Source is parsed into a syntax tree, constant subtrees are folded, and every node becomes a closure. Templates see
only the variables they are given: attributes are look-ups in mappings, there are no calls but the filters given,
and so nothing else of Python can be reached. Rendering is lazy: ``for`` draws its sequence one item at a time, and
text comes in pieces, each marked as inside or outside of ``{% generation %}``.

Statements: ``for``/``endfor``, ``if``/``elif``/``else``/``endif``, ``set``, ``generation``/``endgeneration``; comments ``{# #}``;
``-`` beside a tag's brackets trims white space there. Expressions: strings, numbers, true, false, none, names, ``a.b``,
``a[b]``, ``not and or``, comparisons, ``in``, ``+ - * / % ~``, ``x if c else y`` and ``x | filter``. In a loop: loop.index, index0, first, last.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for what it may not use."""


_PARTS = re.compile(r"\{#.*?#\}|\{\{-?.*?-?\}\}|\{%-?.*?-?%\}", re.S)
_WORDS = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>==|!=|<=|>=|[-<>+*/%~|.,()\[\]=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_SUMS = {"-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod}
#: The longest text that joining may make, and the largest number.
MOST_TEXT, MOST_NUMBER = 1 << 28, 1 << 63
_CONSTANTS = {"true": True, "false": False, "none": None}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "string": lambda x: _text(x)}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _join(x: str, y: str) -> str:
    if len(x) + len(y) > MOST_TEXT:
        raise TemplateError("the text becomes too long")
    return x + y


def _sum(sign: str, x: Any, y: Any) -> Any:
    """Arithmetic of numbers alone (texts only join), so that no template can make much out of little."""
    if sign == "+" and isinstance(x, str) and isinstance(y, str):
        return _join(x, y)
    if not isinstance(x, (int, float)) or not isinstance(y, (int, float)):
        raise TemplateError(f"{sign} needs numbers")
    z = x + y if sign == "+" else _SUMS[sign](x, y)
    if not -MOST_NUMBER <= z <= MOST_NUMBER:
        raise TemplateError("the number becomes too large")
    return z


def _lookup(of: Any, key: Any) -> Any:
    """Only mappings and sequences can be looked into."""
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


class _Expression:
    """Recursive descent over one expression's words; gives syntax trees as tuples."""

    def __init__(self, source: str):
        self.words: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            if not (m := _WORDS.match(source, at)):
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.words.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] != "string" and self.words[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, *values: str) -> str:
        if (x := self.take(*values)) is None:
            raise TemplateError(f"expected {' or '.join(values)}")
        return x

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        if (x := self.words[self.at - 1][1]).startswith("_"):
            raise TemplateError(f"the name {x} is not allowed")
        return x

    def end(self, tree: tuple) -> tuple:
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        tree = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return "choice", test, tree, self.choice()
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = "or", tree, self.both()
        return tree

    def both(self) -> tuple:
        tree = self.inverse()
        while self.take("and"):
            tree = "and", tree, self.inverse()
        return tree

    def inverse(self) -> tuple:
        if self.take("not"):
            return "not", self.inverse()
        tree = self.sum()
        while (sign := self.take(*_COMPARE, "in")) or self.peek("not"):
            if sign is None:
                self.need("not")
                self.need("in")
                tree = "not", ("in", tree, self.sum())
            elif sign == "in":
                tree = "in", tree, self.sum()
            else:
                tree = "compare", sign, tree, self.sum()
        return tree

    def sum(self) -> tuple:
        tree = self.product()
        while sign := self.take("+", "-", "~"):
            tree = ("join", tree, self.product()) if sign == "~" else ("sum", sign, tree, self.product())
        return tree

    def product(self) -> tuple:
        tree = self.filtered()
        while sign := self.take("*", "/", "%"):
            tree = "sum", sign, tree, self.filtered()
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("|"):
                tree = "filter", self.name(), tree
            elif self.take("."):
                tree = "look", tree, ("constant", self.name())
            elif self.take("["):
                key = self.choice()
                self.need("]")
                tree = "look", tree, key
            else:
                return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.take("-"):
            return "sum", "-", ("constant", 0), self.filtered()
        if self.at >= len(self.words):
            raise TemplateError("the expression ends early")
        kind, value = self.words[self.at]
        if kind == "string":
            self.at += 1
            return "constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S)
        if kind == "number":
            self.at += 1
            return "constant", float(value) if "." in value else int(value)
        name = self.name()
        return ("constant", _CONSTANTS[name.lower()]) if name.lower() in _CONSTANTS else ("name", name)


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of statements."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _PARTS.finditer(source):
        text = source[at : m.start()]
        tag = m[0]
        text = text.lstrip() if trim else text
        text = text.rstrip() if tag[2:3] == "-" and tag[1] != "#" else text
        parts.append(("text", text))
        trim = tag[1] != "#" and tag[-3:-2] == "-" and len(tag) > 4
        if tag[1] != "#":
            parts.append(("print" if tag[1] == "{" else "tag", tag[2:-2].strip("-").strip()))
        at = m.end()
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    place = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal place
        out: list[tuple] = []
        while place < len(parts):
            kind, body = parts[place]
            place += 1
            if kind == "text":
                if body:
                    out.append(("text", body))
                continue
            if kind == "print":
                e = _Expression(body)
                out.append(("print", e.end(e.choice())))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return out, body
            if word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                over = e.end(e.choice())
                out.append(("for", name, over, block("endfor")[0]))
            elif word == "if":
                arms, other, closing = [], [], body
                while True:
                    e = _Expression(closing.partition(" ")[2])
                    test = e.end(e.choice())
                    inner, closing = block("elif", "else", "endif")
                    arms.append((test, inner))
                    if closing == "else":
                        other, closing = block("endif")
                    if closing == "endif":
                        break
                out.append(("if", arms, other))
            elif word == "set":
                e = _Expression(rest)
                name = e.name()
                e.need("=")
                out.append(("set", name, e.end(e.choice())))
            elif body == "generation":
                out.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag {body!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block()[0]


def fold(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The expression with constant parts computed; what would fail stays, to fail only if it is reached."""
    kind = tree[0]
    if kind in ("constant", "name"):
        return tree
    tree = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in tree)
    if all(x[0] == "constant" for x in tree if isinstance(x, tuple)):
        try:
            return "constant", _expression(tree, filters)({})
        except TemplateError:
            raise
        except (TypeError, ZeroDivisionError, ValueError):
            return tree
    return tree


def _expression(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    kind, *rest = tree
    if kind == "constant":
        value = rest[0]
        return lambda c: value
    if kind == "name":
        name = rest[0]
        return lambda c: c.get(name)
    subs = [_expression(x, filters) for x in rest if isinstance(x, tuple)]
    if kind == "filter":
        if rest[0] not in filters:
            raise TemplateError(f"unknown filter {rest[0]}")
        apply, (f,) = filters[rest[0]], subs
        return lambda c: apply(f(c))
    if kind == "not":
        (f,) = subs
        return lambda c: not f(c)
    if kind == "choice":
        test, yes, no = subs
        return lambda c: yes(c) if test(c) else no(c)
    f, g = subs
    if kind == "sum":
        return lambda c: _sum(rest[0], f(c), g(c))
    if kind == "compare":
        of = _COMPARE[rest[0]]
        return lambda c: of(f(c), g(c))
    return {"or": lambda c: f(c) or g(c), "and": lambda c: f(c) and g(c), "in": lambda c: f(c) in (g(c) or ()), "join": lambda c: _join(_text(f(c)), _text(g(c))), "look": lambda c: _lookup(f(c), g(c))}[kind]


def _statements(trees: list[tuple], filters: Mapping[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    steps: list[Callable[[dict, bool], Iterable[Piece]]] = []
    held = ""
    for tree in [*trees, ("end",)]:
        if tree[0] == "print" and (folded := fold(tree[1], filters))[0] == "constant":
            tree = "text", _text(folded[1])
        if tree[0] == "text":  # neighbouring constants become one
            held += tree[1]
            continue
        if held:
            steps.append(lambda c, g, text=held: ((text, g),))
            held = ""
        if tree[0] == "print":
            steps.append(lambda c, g, f=_expression(folded, filters): ((_text(f(c)), g),))
        elif tree[0] == "set":

            def put(c, g, name=tree[1], f=_expression(fold(tree[2], filters), filters)):
                c[name] = f(c)
                return ()

            steps.append(put)
        elif tree[0] == "generation":
            steps.append(lambda c, g, body=_statements(tree[1], filters): body(c, True))
        elif tree[0] == "if":
            arms = [(_expression(fold(t, filters), filters), _statements(b, filters)) for t, b in tree[1]]
            steps.append(lambda c, g, arms=arms, other=_statements(tree[2], filters): next((b for t, b in arms if t(c)), other)(c, g))
        elif tree[0] == "for":

            def loop(c, g, name=tree[1], over=_expression(fold(tree[2], filters), filters), body=_statements(tree[3], filters)):
                items = iter(over(c) or ())
                inner, i, none = dict(c), 0, object()
                item = next(items, none)
                while item is not none:
                    following = next(items, none)  # one ahead, for loop.last
                    inner[name], inner["loop"] = item, {"index0": i, "index": i + 1, "first": not i, "last": following is none}
                    yield from body(inner, g)
                    item, i = following, i + 1

            steps.append(loop)

    def run(c: dict, g: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(c, g)

    return run


class Template:
    """``pieces(**variables)`` renders lazily; ``render`` gives the whole text and its generation spans."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        self.tree = parse(source)
        self._run = _statements(self.tree, {**FILTERS, **(filters or {})})

    def pieces(self, **variables: Any) -> Iterator[Piece]:
        return self._run(variables, False)

    def render(self, **variables: Any) -> tuple[str, list[tuple[int, int]]]:
        out, spans, at = [], [], 0
        for text, inside in self.pieces(**variables):
            if inside:
                if spans and spans[-1][1] == at:
                    spans[-1] = spans[-1][0], at + len(text)
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans
