"""Formula text -> Spark Column.

A formula such as ``price * quantity``, ``(a + b) / 2 > 10`` or
``log(income)`` is read with Python's own ``ast`` module; only arithmetic,
comparisons, ``in`` lists, boolean logic, column names, numbers, texts, the
one-argument math functions and ``mean(col)`` are accepted.  ``&`` and ``|`` bind as
``and`` and ``or``, as in pandas.  Anything else is a
``ValueError``.  The formula never reaches ``F.expr`` (which would accept any
SQL function).

Arithmetic follows Python/pandas where Spark differs: ``/`` is true
division, ``//`` floors, ``%`` takes the sign of the divisor; a zero divisor
gives null (pandas gives inf).
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cols import c

# The math functions of a formula, by the name pandas gives them.
MATH = {
    "sqrt": F.sqrt, "exp": F.exp, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh,
    "tanh": F.tanh, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arcsinh": F.asinh, "arccosh": F.acosh,
    "arctanh": F.atanh, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "floor": F.floor, "ceil": F.ceil,
}


def _words_for_signs(src: str) -> str:
    """``&`` -> ``and``, ``|`` -> ``or`` (their precedence in pandas), outside of texts."""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(src).readline))
    except (tokenize.TokenError, SyntaxError):
        return src  # the parser says what is wrong
    signs = {"&": " and ", "|": " or "}
    for t in reversed(tokens):
        if t.type == tokenize.OP and t.string in signs and t.start[0] == 1:
            src = src[: t.start[1]] + signs[t.string] + src[t.end[1]:]
    return src


def _bare_names(text: str, columns: set[str]) -> str:
    """``log(a b)`` and ``a b - mean(c d)``: names with blanks need no backticks there."""
    if (m := re.fullmatch(r"log\(([^`]+)\)", text)) and m[1].strip() in columns:
        return f"log(`{m[1].strip()}`)"
    if (m := re.fullmatch(r"([^`]+?)\s*-\s*mean\(([^`]+)\)", text)) and {m[1].strip(), m[2].strip()} <= columns:
        return f"`{m[1].strip()}` - mean(`{m[2].strip()}`)"
    return text


_BACKTICK = re.compile(r"`([^`]*)`")


def compile_formula(text: str, columns: list[str],
                    mean_of: Callable[[str], float | None]) -> Column:
    """Compile ``text``; ``mean_of(col)`` supplies column means for ``mean()``."""
    names: dict[str, str] = {}

    def hide(m: re.Match) -> str:
        key = f"__q{len(names)}__"
        names[key] = m.group(1)
        return key

    src = _words_for_signs(_BACKTICK.sub(hide, _bare_names(text.strip(), set(columns))))
    try:
        tree = ast.parse(src, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"Could not evaluate formula '{text}': {e}") from None
    known = set(columns)

    def name_of(node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            n = names.get(node.id, node.id)
            if n not in known:
                raise ValueError(f"Could not evaluate formula '{text}': unknown column {n!r}")
            return n
        raise ValueError(f"Could not evaluate formula '{text}': expected a column name")

    def num(x: Column) -> Column:
        return x.cast("double")

    def conv(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return conv(node.body)
        if isinstance(node, ast.Name):
            if node.id in ("True", "False"):
                return F.lit(node.id == "True")
            return c(name_of(node))
        if isinstance(node, ast.Constant):
            if isinstance(node.value, (bool, int, float, str)):
                return F.lit(node.value)
            raise ValueError(f"Could not evaluate formula '{text}': unsupported constant")
        if isinstance(node, ast.UnaryOp):
            v = conv(node.operand)
            if isinstance(node.op, ast.USub):
                return -v
            if isinstance(node.op, ast.UAdd):
                return v
            if isinstance(node.op, (ast.Not, ast.Invert)):
                return ~v
        if isinstance(node, ast.BinOp):
            a, b = conv(node.left), conv(node.right)
            op = node.op
            if isinstance(op, ast.Add):
                return a + b
            if isinstance(op, ast.Sub):
                return a - b
            if isinstance(op, ast.Mult):
                return a * b
            if isinstance(op, ast.Div):
                return F.try_divide(num(a), num(b))
            if isinstance(op, ast.FloorDiv):
                return F.floor(F.try_divide(num(a), num(b))).cast("double")
            if isinstance(op, ast.Mod):
                q = F.floor(F.try_divide(num(a), num(b)))
                return num(a) - num(b) * q
            if isinstance(op, ast.Pow):
                return F.pow(num(a), num(b))
            if isinstance(op, ast.BitAnd):
                return a & b
            if isinstance(op, ast.BitOr):
                return a | b
        if isinstance(node, ast.BoolOp):
            vals = [conv(v) for v in node.values]
            out = vals[0]
            for v in vals[1:]:
                out = (out & v) if isinstance(node.op, ast.And) else (out | v)
            return out
        if isinstance(node, ast.Compare):
            parts = []
            left = conv(node.left)
            for op, right_node in zip(node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right_node, (ast.List, ast.Tuple)):
                    listed = left.isin([v.value for v in right_node.elts if isinstance(v, ast.Constant)])
                    if not all(isinstance(v, ast.Constant) for v in right_node.elts):
                        break
                    parts.append(~listed if isinstance(op, ast.NotIn) else listed)
                    continue
                right = conv(right_node)
                if isinstance(op, ast.Eq):
                    parts.append(left == right)
                elif isinstance(op, ast.NotEq):
                    parts.append(left != right)
                elif isinstance(op, ast.Lt):
                    parts.append(left < right)
                elif isinstance(op, ast.LtE):
                    parts.append(left <= right)
                elif isinstance(op, ast.Gt):
                    parts.append(left > right)
                elif isinstance(op, ast.GtE):
                    parts.append(left >= right)
                else:
                    break
                left = right
            else:
                out = parts[0]
                for p in parts[1:]:
                    out = out & p
                return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1 \
                and not node.keywords:
            fn = node.func.id
            if fn == "log":
                arg = num(conv(node.args[0]))
                # natural log; 0 is missing first, negatives give null
                return F.ln(F.when(arg != 0, arg))
            if fn in MATH:
                y = MATH[fn](num(conv(node.args[0]))).cast("double")
                return F.when(~F.isnan(y), y)  # outside the function's domain: missing
            if fn == "mean":
                m = mean_of(name_of(node.args[0]))
                return F.lit(m).cast("double")
        raise ValueError(f"Could not evaluate formula '{text}': unsupported syntax "
                         f"{type(node).__name__}")

    return conv(tree)


def mean_refs(text: str) -> list[str]:
    """Columns whose mean a formula uses (so they are computed in one job)."""
    src = _BACKTICK.sub(lambda m: m.group(1), text)
    return re.findall(r"\bmean\(\s*([^()]+?)\s*\)", src)
