"""Rule formulas: one arithmetic expression over named clues, compiled to a Spark column.

The text is parsed by Python's own parser; a whitelist of nodes turns it into column expressions, so
rules fold and push down like any other column and nothing is ever evaluated as code.
Divisions by zero give 0, powers keep the sign, logarithms and roots take magnitudes, comparisons give 0 or 1, and
a score that is no finite number ranks last.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH, MAX_NODES, MAX_POWER = 240, 40, 4


class RuleError(ValueError):
    """The formula is not admitted; the message says why."""


def _signed_power(x: Column, p: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), p)


FUNCTIONS = {
    "log": (1, lambda x: F.log1p(F.abs(x))),
    "sqrt": (1, lambda x: F.sqrt(F.abs(x))),
    "abs": (1, F.abs),
    "min": (2, F.least),
    "max": (2, F.greatest),
}
ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}
COMPARE = {ast.Gt: operator.gt, ast.Lt: operator.lt, ast.GtE: operator.ge, ast.LtE: operator.le}


def parse(text: str, clues: set[str]) -> ast.expr:
    """The checked tree of a formula; RuleError if it isn't admitted."""
    if not text.strip():
        raise RuleError("empty formula")
    if len(text) > MAX_LENGTH:
        raise RuleError("formula too long")
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as x:
        raise RuleError("not an expression") from x
    nodes = [n for n in ast.walk(tree) if isinstance(n, ast.expr)]
    if len(nodes) > MAX_NODES:
        raise RuleError("too many terms")
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    for n in nodes:
        _admit(n, clues, called)
    return tree


def _admit(n: ast.expr, clues: set[str], called: set[int]) -> None:
    if isinstance(n, ast.Constant):
        if isinstance(n.value, bool) or not isinstance(n.value, int | float):
            raise RuleError("only numbers are constants")
    elif isinstance(n, ast.Name):
        if id(n) not in called and n.id not in clues:
            raise RuleError(f"unknown clue {n.id}")
    elif isinstance(n, ast.Call):
        if not isinstance(n.func, ast.Name) or n.func.id not in FUNCTIONS:
            raise RuleError("unknown function")
        if n.keywords or len(n.args) != FUNCTIONS[n.func.id][0] or any(isinstance(a, ast.Starred) for a in n.args):
            raise RuleError("wrong arguments")
    elif isinstance(n, ast.BinOp):
        if isinstance(n.op, ast.Pow):
            p = n.right.operand if isinstance(n.right, ast.UnaryOp) else n.right
            if not isinstance(p, ast.Constant) or abs(p.value) > MAX_POWER:
                raise RuleError("power must be a small number")
        elif type(n.op) not in ARITHMETIC and not isinstance(n.op, ast.Div):
            raise RuleError("unknown operator")
    elif isinstance(n, ast.UnaryOp):
        if not isinstance(n.op, ast.USub | ast.UAdd):
            raise RuleError("unknown operator")
    elif isinstance(n, ast.Compare):
        if len(n.ops) != 1 or type(n.ops[0]) not in COMPARE:
            raise RuleError("one comparison at a time")
    else:
        raise RuleError(f"{type(n).__name__} is not allowed")


def _column(n: ast.expr, clues: dict[str, Column]) -> Column:
    if isinstance(n, ast.Constant):
        return F.lit(float(n.value))
    if isinstance(n, ast.Name):
        return clues[n.id]
    if isinstance(n, ast.Call):
        return FUNCTIONS[n.func.id][1](*[_column(a, clues) for a in n.args])
    if isinstance(n, ast.UnaryOp):
        x = _column(n.operand, clues)
        return -x if isinstance(n.op, ast.USub) else x
    if isinstance(n, ast.Compare):
        hit = COMPARE[type(n.ops[0])](_column(n.left, clues), _column(n.comparators[0], clues))
        return hit.cast("double")
    a, b = _column(n.left, clues), _column(n.right, clues)
    if isinstance(n.op, ast.Div):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    if isinstance(n.op, ast.Pow):
        return _signed_power(a, b)
    return ARITHMETIC[type(n.op)](a, b)


def compile_rule(text: str, clues: dict[str, Column]) -> Column:
    x = _column(parse(text, set(clues)), clues).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(float("-inf"))).otherwise(x)


def tree(text: str, clues: set[str]) -> dict:
    """The formula as nested records, for display."""

    def node(n: ast.expr) -> dict:
        if isinstance(n, ast.Constant):
            return {"kind": "number", "value": float(n.value)}
        if isinstance(n, ast.Name):
            return {"kind": "clue", "name": n.id}
        if isinstance(n, ast.Call):
            return {"kind": "call", "name": n.func.id, "args": [node(a) for a in n.args]}
        if isinstance(n, ast.UnaryOp):
            return {"kind": type(n.op).__name__.lower(), "args": [node(n.operand)]}
        if isinstance(n, ast.Compare):
            return {"kind": type(n.ops[0]).__name__.lower(), "args": [node(n.left), node(n.comparators[0])]}
        return {"kind": type(n.op).__name__.lower(), "args": [node(n.left), node(n.right)]}

    return node(parse(text, clues))
