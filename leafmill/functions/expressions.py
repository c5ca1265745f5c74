"""A small expression language for {{...}} templates, compiled to column expressions.

Literals, names, + - * / %, comparisons, && || !, ?:, .length, [i] and a few functions.  Python's own parser reads it after a
little rewriting; whatever else a script does raises UnsupportedScript.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


class UnsupportedScript(ValueError):
    """The expression needs a script engine."""


_CALLS = {
    "md5Encode": lambda x: F.md5(F.encode(x, "UTF-8")),
    "base64Encode": text.base64,
    "base64Decode": text.base64_decode,
    "encodeURI": lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")),
    "trim": F.trim,
    "toLowerCase": F.lower,
    "toUpperCase": F.upper,
    "String": lambda x: x.cast("string"),
    "Number": lambda x: x.try_cast("double"),
}
_BINARY = {ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / F.nullif(b, F.lit(0)), ast.Mod: lambda a, b: a % F.nullif(b, F.lit(0))}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def as_text(value: Column) -> Column:
    """A value as a script prints it: whole numbers without a fraction."""
    return F.regexp_replace(value.cast("string"), r"^(-?\d+)\.0$", "$1")


def _pythonic(script: str) -> str:
    script = script.strip().rstrip(";")
    if re.search(r"\b(var|let|const|function|return|for|while|new|await|=>)\b|=>|(?<![=!<>])=(?!=)", re.sub(r"'[^']*'|\"[^\"]*\"", "", script)):
        raise UnsupportedScript(script)
    script = re.sub(r"===", "==", re.sub(r"!==", "!=", script)).replace("&&", " and ").replace("||", " or ")
    script = re.sub(r"!(?!=)", " not ", script)
    m = re.match(r"^([^?'\"]+)\?(.+):([^:]+)$", script)
    return f"({m[2].strip()}) if ({m[1].strip()}) else ({m[3].strip()})" if m else script.strip()


def compile_expression(script: str, names: dict[str, Column]) -> Column:
    """A column for the expression; names are its variables."""
    try:
        tree = ast.parse(_pythonic(script), mode="eval").body
    except SyntaxError as e:
        raise UnsupportedScript(script) from e
    return typed(tree, names)[0]


def typed(node: ast.AST, names: dict, more=None) -> tuple[Column, bool | None]:
    """The column, and whether it is a text; None if only the data's type tells.

    A name may hold such a pair too; more(node, names) is asked first, for what this language lacks.
    """
    if more is not None and (got := more(node, names)) is not None:
        return got
    _column = lambda n, names: typed(n, names, more)
    if isinstance(node, ast.Constant):
        return F.lit(node.value), isinstance(node.value, str)
    if isinstance(node, ast.Name):
        if node.id in ("true", "false"):
            return F.lit(node.id == "true"), False
        if node.id not in names:
            raise UnsupportedScript(f"unknown name {node.id}")
        return names[node.id] if isinstance(names[node.id], tuple) else (names[node.id], None)
    if isinstance(node, ast.BinOp):
        (a, text_a), (b, text_b) = _column(node.left, names), _column(node.right, names)
        if isinstance(node.op, ast.Add):
            joined = F.concat(as_text(a), as_text(b))
            if text_a or text_b:
                return joined, True
            if text_a is False and text_b is False:
                return a + b, False
            texts = (F.typeof(a) == "string") | (F.typeof(b) == "string")
            return F.when(texts, joined).otherwise(as_text(a.try_cast("double") + b.try_cast("double"))), None
        if type(node.op) in _BINARY:
            num = lambda x, t: x if t is False else x.try_cast("double")
            return _BINARY[type(node.op)](num(a, text_a), num(b, text_b)), False
    if isinstance(node, ast.UnaryOp):
        x, _ = _column(node.operand, names)
        if isinstance(node.op, ast.USub):
            return -x, False
        if isinstance(node.op, ast.Not):
            return ~x, False
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
        return _COMPARE[type(node.ops[0])](_column(node.left, names)[0], _column(node.comparators[0], names)[0]), False
    if isinstance(node, ast.BoolOp):
        parts = [_column(v, names)[0] for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out, False
    if isinstance(node, ast.IfExp):
        (a, t), (b, _) = _column(node.body, names), _column(node.orelse, names)
        return F.when(_column(node.test, names)[0], a).otherwise(b), t
    if isinstance(node, ast.Attribute) and node.attr == "length":
        return F.char_length(_column(node.value, names)[0]), False
    if isinstance(node, ast.Subscript):
        return F.substr(_column(node.value, names)[0], _column(node.slice, names)[0].cast("int") + 1, F.lit(1)), True
    if isinstance(node, ast.Call):
        if isinstance(node.func, ast.Name) and node.func.id in _CALLS and len(node.args) == 1:
            return _CALLS[node.func.id](_column(node.args[0], names)[0]), node.func.id != "Number"
        if isinstance(node.func, ast.Attribute):
            owner = node.func.value
            if isinstance(owner, ast.Name) and owner.id == "java" and node.func.attr in _CALLS and len(node.args) == 1:
                return _CALLS[node.func.attr](_column(node.args[0], names)[0]), True
            if node.func.attr in _CALLS and not node.args:
                return _CALLS[node.func.attr](_column(owner, names)[0]), True
    raise UnsupportedScript(ast.unparse(node))


def fill(template: str, names: dict[str, Column]) -> Column:
    """A text with {{expression}} places filled in; <js> blocks of one expression too."""
    template = re.sub(r"<js>(.*?)</js>", lambda m: "{{" + m[1] + "}}", template, flags=re.S)
    pieces = re.split(r"\{\{(.+?)\}\}", template, flags=re.S)
    return F.concat(*[as_text(compile_expression(x, names)) if k % 2 else F.lit(x) for k, x in enumerate(pieces)])
