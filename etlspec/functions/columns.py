"""Column text: Python Column expressions or SQL text, turned into a Column.

``F.col("amount") > 100`` is walked as a syntax tree and rebuilt through the
public functions and Column methods; the text is never evaluated as code.
Text that uses any other name, such as ``amount > 100``, is SQL.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_MODULES = ("F", "functions")
_SHORT = {"col": F.col, "lit": F.lit}
_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.Mod: operator.mod,
    ast.Pow: operator.pow,
    ast.BitAnd: operator.and_,
    ast.BitOr: operator.or_,
}
_UNARY = {ast.USub: operator.neg, ast.Invert: operator.invert}
_COMPARE = {
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
}
# These take Python code or whole frames, so they have no place in a spec.
_REFUSED = {"udf", "udtf", "pandas_udf", "arrow_udf", "arrow_udtf", "broadcast"}


class ColumnTextError(ValueError):
    """The text is Python, but uses something a Column expression may not."""


def compile_column(text: str) -> Column:
    """Build the Column described by ``text``."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError):
        return F.expr(text)
    if not _free_names(tree) <= {*_MODULES, *_SHORT}:
        return F.expr(text)
    value = _build(tree.body, {})
    return value if isinstance(value, Column) else F.lit(value)


def _free_names(tree: ast.AST) -> set[str]:
    bound = {a.arg for node in ast.walk(tree) if isinstance(node, ast.Lambda) for a in node.args.args}
    return {node.id for node in ast.walk(tree) if isinstance(node, ast.Name)} - bound


def _build(node: ast.AST, scope: dict):
    match node:
        case ast.Constant(value=value):
            return value
        case ast.Name(id=name) if name in scope:
            return scope[name]
        case ast.Name(id=name) if name in _SHORT:
            return _SHORT[name]
        case ast.List(elts=items) | ast.Tuple(elts=items):
            return [_build(item, scope) for item in items]
        case ast.UnaryOp(op=op, operand=operand) if type(op) in _UNARY:
            return _UNARY[type(op)](_build(operand, scope))
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return _BINARY[type(op)](_build(left, scope), _build(right, scope))
        case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARE:
            return _COMPARE[type(op)](_build(left, scope), _build(right, scope))
        case ast.Subscript(value=value, slice=index):
            return _column(value, scope)[_build(index, scope)]
        case ast.Attribute(value=ast.Name(id=module), attr=name) if module in _MODULES:
            return _function(name)
        case ast.Attribute(value=value, attr=name):
            return _member(_column(value, scope), name)
        case ast.Call(func=func, args=args, keywords=keywords):
            target = _build(func, scope)
            if isinstance(target, Column) or not callable(target):
                raise ColumnTextError(f"{ast.unparse(func)} cannot be called")
            if any(k.arg is None for k in keywords) or any(isinstance(a, ast.Starred) for a in args):
                raise ColumnTextError("unpacking is not allowed in column text")
            return target(
                *[_build(a, scope) for a in args], **{k.arg: _build(k.value, scope) for k in keywords}
            )
        case ast.Lambda(args=ast.arguments(args=params, defaults=[]), body=body):
            return _lambda([p.arg for p in params], body, scope)
    raise ColumnTextError(f"{type(node).__name__} is not allowed in column text: {ast.unparse(node)}")


def _function(name: str):
    found = getattr(F, name, None)
    public = not name.startswith("_") and name not in _REFUSED
    if public and callable(found) and getattr(found, "__module__", "").startswith("pyspark.sql.functions"):
        return found
    raise ColumnTextError(f"F.{name} is not a Spark function")


def _column(node: ast.AST, scope: dict) -> Column:
    value = _build(node, scope)
    if not isinstance(value, Column):
        raise ColumnTextError(f"{ast.unparse(node)} is not a column")
    return value


def _member(column: Column, name: str):
    if name.startswith("_"):
        raise ColumnTextError(f"{name} is not a Column method")
    return getattr(column, name)


def _lambda(params: list[str], body: ast.AST, scope: dict):
    # Spark reads the arity from the signature, so each arity is spelled out.
    def run(*values):
        return _build(body, {**scope, **dict(zip(params, values))})

    if len(params) == 1:
        return lambda x: run(x)
    if len(params) == 2:
        return lambda x, y: run(x, y)
    if len(params) == 3:
        return lambda x, y, z: run(x, y, z)
    raise ColumnTextError("a lambda in column text takes one to three arguments")
