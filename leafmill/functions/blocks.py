"""Script blocks of several statements as one column: declarations are bindings, functions are put in where they are called.

A block is straight-line code: var, let and const declarations, assignments (a name stands for its last value), function
declarations whose bodies are blocks with a return, and a last expression, whose value is the block's.  Lists know map, filter, join,
concat, length and [i]; texts have the usual methods.  Loops, branches, objects and whatever else a script can do raise
UnsupportedScript when the plan is built.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import UnsupportedScript, as_text, typed

#: A value: its column, and whether it is a text (None: the data's type tells), or a list of texts ("list").
Value = tuple[Column, bool | str | None]


@dataclass(frozen=True)
class Function:
    params: tuple[str, ...]
    body: str
    names: dict


_OPEN, _CLOSE = "([{", ")]}"
_LITERAL = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|//[^\n]*|/\*.*?\*/", re.S)
_STATEMENT = re.compile(r"(?:(?:var|let|const)\s+|)([A-Za-z_$]\w*)\s*(\+?=)(?!=|>)\s*(.*)$", re.S)
_DECLARED = re.compile(r"(?:var|let|const)\s+")
_UNSUPPORTED = re.compile(r"\b(?:for|while|do|if|else|switch|try|new|await|this|typeof|delete|class)\b")


def _matching(code: str, at: int) -> int:
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] in _OPEN) - (code[i] in _CLOSE)
        if not depth:
            return i
    raise UnsupportedScript(f"unclosed {code[at]} in {code!r}")


def _top(code: str, mark: str) -> list[str]:
    """Pieces between marks that stand outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(code):
        depth += (c in _OPEN) - (c in _CLOSE)
        if c == mark and not depth:
            out.append(code[last:i])
            last = i + 1
    return [*out, code[last:]]


def _choice(code: str) -> str:
    """a ? b : c as Python says it, inside brackets too."""
    pieces = _top(code, ",")
    if len(pieces) > 1:
        return ",".join(map(_choice, pieces))
    out, i = "", 0
    while i < len(code):
        if code[i] in _OPEN:
            end = _matching(code, i)
            out += code[i] + _choice(code[i + 1 : end]) + code[end]
            i = end + 1
        else:
            out += code[i]
            i += 1
    test, *rest = _top(out, "?")
    if not rest:
        return out
    rest = "?".join(rest)
    depth = open_ = 0
    for i, c in enumerate(rest):
        depth += (c in _OPEN) - (c in _CLOSE)
        if not depth and c == "?":
            open_ += 1
        elif not depth and c == ":":
            if not open_:
                return f"(({_choice(rest[:i])}) if ({test}) else ({_choice(rest[i + 1 :])}))"
            open_ -= 1
    raise UnsupportedScript(code)


class _Block:
    def __init__(self, texts: dict[str, str]):
        self.texts = texts
        self.made = 0

    def functions(self, code: str, names: dict) -> str:
        """Function expressions and arrows are named; declarations are taken out and bound."""
        while m := re.search(r"\bfunction\b\s*([A-Za-z_$]\w*)?\s*\(([^()]*)\)\s*\{", code):
            end = _matching(code, m.end() - 1)
            body = code[m.end() : end]
            name = m[1] or f"__f{self.made}"
            self.made += 1
            names[name] = Function(tuple(p.strip() for p in m[2].split(",") if p.strip()), body, names)
            code = code[: m.start()] + (" ; " if m[1] else name) + code[end + 1 :]
        while m := re.search(r"(?:\(([^()]*)\)|\b([A-Za-z_$]\w*))\s*=>\s*", code):
            at, depth = m.end(), 0
            while at < len(code) and not (depth == 0 and code[at] in ",;" + _CLOSE):
                depth += (code[at] in _OPEN) - (code[at] in _CLOSE)
                at += 1
            body = code[m.end() : at].strip()
            body = body[1:-1] if body.startswith("{") else f"return {body}"
            name = f"__f{self.made}"
            self.made += 1
            names[name] = Function(tuple(p.strip() for p in (m[1] if m[1] is not None else m[2]).split(",") if p.strip()), body, names)
            code = code[: m.start()] + name + code[at:]
        return code

    def run(self, code: str, names: dict, inside: bool = False) -> Value | None:
        """Bind what a block declares into names; its last expression's value, or a function's return."""
        value = None
        code = self.functions(code, names)
        for said in (s.strip() for s in _top(code, ";")):
            if not said:
                continue
            if inside and (m := re.match(r"return\b(.*)$", said, re.S)):
                return self.value(m[1], names)
            if _UNSUPPORTED.search(said) or re.match(r"return\b", said):
                raise UnsupportedScript(self.plain(said))
            if _DECLARED.match(said):
                for one in _top(_DECLARED.sub("", said, count=1), ","):
                    m = _STATEMENT.match(one.strip())
                    if m is None or m[2] != "=":
                        raise UnsupportedScript(self.plain(said))
                    names[m[1]] = self.value(m[3], names)
                value = None
            elif m := _STATEMENT.match(said):
                value = self.value(f"{m[1]} + ({m[3]})" if m[2] == "+=" else m[3], names)
                names[m[1]] = value
            else:
                value = self.value(said, names)
        return value

    def value(self, code: str, names: dict) -> Value | Function:
        if isinstance(f := names.get(code.strip()), Function):
            return f
        code = re.sub(r"===", "==", re.sub(r"!==", "!=", code)).replace("&&", " and ").replace("||", " or ")
        code = _choice(re.sub(r"!(?!=)", " not ", code)).replace("$", "_dollar_")
        try:
            tree = ast.parse(" ".join(code.split()), mode="eval").body
        except SyntaxError as e:
            raise UnsupportedScript(self.plain(code)) from e
        return typed(tree, names, self.more)

    def plain(self, code: str) -> str:
        return re.sub(r"__s\d+", lambda m: repr(self.texts.get(m[0], m[0])), code)

    def call(self, f: Function, args: list[Value]) -> Value:
        inner = {**f.names, **dict(zip(f.params, args, strict=False))}
        got = self.run(f.body, inner, inside=True)
        if got is None:
            raise UnsupportedScript(f"a function without a return: {self.plain(f.body)}")
        return got

    def more(self, node: ast.AST, names: dict) -> Value | None:
        """What blocks know beyond expressions."""
        of = lambda n: typed(n, names, self.more)
        if isinstance(node, ast.Name) and node.id in self.texts:
            return F.lit(self.texts[node.id]), True
        if isinstance(node, ast.List):
            return F.array(*[as_text(of(x)[0]) for x in node.elts]).cast("array<string>"), "list"
        if isinstance(node, ast.Attribute) and node.attr == "length":
            x, kind = of(node.value)
            return (F.size(x) if kind == "list" else F.char_length(as_text(x))), False
        if isinstance(node, ast.Subscript):
            x, kind = of(node.value)
            if kind == "list":
                return F.get(x, of(node.slice)[0].cast("int")), True
        if not isinstance(node, ast.Call):
            return None
        if isinstance(node.func, ast.Name) and isinstance(names.get(node.func.id), Function):
            return self.call(names[node.func.id], [of(a) for a in node.args])
        if isinstance(node.func, ast.Attribute) and (how := getattr(self, f"do_{node.func.attr}", None)):
            if isinstance(node.func.value, ast.Name) and node.func.value.id not in names and node.func.value.id not in self.texts:
                return None
            args = [names[a.id] if isinstance(a, ast.Name) and isinstance(names.get(a.id), Function) else of(a) for a in node.args]
            return how(of(node.func.value), *args)
        return None

    def _items(self, x: Value) -> Column:
        if x[1] != "list":
            raise UnsupportedScript("no list")
        return x[0]

    def do_map(self, x: Value, f: Function) -> Value:
        one = lambda item, i: as_text(self.call(f, [(item, True), (i, False)])[0])
        return F.transform(self._items(x), one), "list"

    def do_filter(self, x: Value, f: Function) -> Value:
        return F.filter(self._items(x), lambda item, i: self.call(f, [(item, True), (i, False)])[0]), "list"

    def do_join(self, x: Value, sep: Value = None) -> Value:
        return F.call_function("array_join", self._items(x), sep[0] if sep else F.lit(",")), True

    def do_concat(self, x: Value, *more: Value) -> Value:
        if x[1] == "list":
            return F.concat(x[0], *[self._items(m) for m in more]), "list"
        return F.concat(as_text(x[0]), *[as_text(m[0]) for m in more]), True

    def do_split(self, x: Value, sep: Value) -> Value:
        return F.split(as_text(x[0]), F.concat(F.lit("\\Q"), sep[0], F.lit("\\E"))), "list"

    def do_substring(self, x: Value, start: Value, stop: Value = None) -> Value:
        text = as_text(x[0])
        n = F.char_length(text)
        inside = lambda v: F.least(F.greatest(v[0].cast("int"), F.lit(0)), n)
        a, b = inside(start), inside(stop) if stop else n
        return F.substr(text, F.least(a, b) + 1, F.abs(b - a)), True

    def do_indexOf(self, x: Value, what: Value) -> Value:  # noqa: N802
        return F.instr(as_text(x[0]), what[0]) - 1, False

    def do_includes(self, x: Value, what: Value) -> Value:
        return (F.array_contains(x[0], what[0]) if x[1] == "list" else as_text(x[0]).contains(what[0])), False

    def do_startsWith(self, x: Value, what: Value) -> Value:  # noqa: N802
        return as_text(x[0]).startswith(what[0]), False

    def do_endsWith(self, x: Value, what: Value) -> Value:  # noqa: N802
        return as_text(x[0]).endswith(what[0]), False

    def do_replace(self, x: Value, find: Value, to: Value) -> Value:
        """The first occurrence of a text."""
        text = as_text(x[0])
        at = F.instr(text, find[0])
        return F.when(at > 0, F.overlay(text, to[0], at, F.char_length(find[0]))).otherwise(text), True

    def do_toString(self, x: Value) -> Value:  # noqa: N802
        return (F.array_join(x[0], ",") if x[1] == "list" else as_text(x[0])), True


def _block(script: str) -> tuple[_Block, str]:
    """The script with names for its texts, and without comments."""
    texts: dict[str, str] = {}

    def one(m: re.Match) -> str:
        if m[0][0] == "/":
            return " "
        texts[name := f"__s{len(texts)}"] = ast.literal_eval(m[0].replace("\n", "\\n"))
        return name

    return _Block(texts), _LITERAL.sub(one, script)


def run(script: str, names: dict[str, Column]) -> Column:
    """The value of a script's last expression; names are its variables, which it can set for itself alone."""
    block, code = _block(script)
    got = block.run(code, dict(names))
    if got is None:
        raise UnsupportedScript(f"no value: {script}")
    return got[0]


def embedded(content: str, names: dict[str, Column]) -> Column:
    """The <js> blocks of a text: all declarations hold in all of them, their values are added up; a text without blocks is itself."""
    parts = re.findall(r"<js>(.*?)</js>", content, re.S | re.I)
    if not parts:
        return F.lit(content)
    bound = dict(names)
    block, code = _block("\0".join(parts))
    pieces = [block.functions(p, bound) for p in code.split("\0")]
    held = []
    for p in pieces:
        *declared, last = [s for s in _top(p, ";") if s.strip()] or [""]
        if _DECLARED.match(last.strip()):
            declared, last = [*declared, last], ""
        block.run(";".join(declared), bound)
        held.append(last)
    values = [block.run(x, bound) for x in held if x.strip()]
    if not values or None in values:
        raise UnsupportedScript(f"no value: {content}")
    out = values[0]
    for k, v in enumerate(values[1:]):
        add = ast.BinOp(ast.Name(f"__a{k}"), ast.Add(), ast.Name(f"__b{k}"))
        out = typed(add, {f"__a{k}": out, f"__b{k}": v}, block.more)
    return out[0]
