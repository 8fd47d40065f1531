"""A whitelisted expression language over columns, compiled to Catalyst expressions."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONSTANTS = {"pi": math.pi, "e": math.e, "True": True, "False": False}

_ONE = {
    "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos,
    "atan": F.atan, "abs": F.abs, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"),
    "round": lambda x: F.bround(x, 0), "sign": F.signum, "tanh": F.tanh, "sinh": F.sinh, "cosh": F.cosh,
}
_TWO = {"atan2": F.atan2, "min": F.least, "max": F.greatest}
_REDUCE = {"mean": F.avg, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop}


class ExpressionError(ValueError):
    """The expression can't be parsed, or names something outside the whitelist."""


class _Compiler:
    def __init__(self, names: set[str]):
        self.names = names
        self.reductions: dict[str, Column] = {}

    def column(self, node: ast.AST) -> Column:
        visit = getattr(self, f"on_{type(node).__name__}", None)
        if visit is None:
            raise ExpressionError(f"{type(node).__name__} is not allowed")
        return visit(node)

    def on_Expression(self, node: ast.Expression) -> Column:
        return self.column(node.body)

    def on_Constant(self, node: ast.Constant) -> Column:
        if not isinstance(node.value, (bool, int, float)):
            raise ExpressionError(f"constant {node.value!r} is not allowed")
        return F.lit(node.value if isinstance(node.value, bool) else float(node.value))

    def on_Name(self, node: ast.Name) -> Column:
        if node.id in self.names:
            return F.col(f"`{node.id}`")
        if node.id in CONSTANTS:
            return F.lit(CONSTANTS[node.id])
        raise ExpressionError(f"unknown name {node.id}")

    def on_UnaryOp(self, node: ast.UnaryOp) -> Column:
        x = self.column(node.operand)
        if isinstance(node.op, ast.USub):
            return -x
        if isinstance(node.op, ast.UAdd):
            return x
        if isinstance(node.op, (ast.Invert, ast.Not)):
            return ~x
        raise ExpressionError("unknown unary operator")

    def on_BinOp(self, node: ast.BinOp) -> Column:
        a, b = self.column(node.left), self.column(node.right)
        inf = lambda x: F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
        # Division by zero gives what floating point gives, also under ANSI mode.
        div = lambda x, y: F.when(y == 0, inf(x)).otherwise(x / F.when(y == 0, 1.0).otherwise(y))
        match node.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return div(a, b)
            case ast.FloorDiv():
                return F.floor(div(a, b)).cast("double")
            case ast.Mod():
                return F.when(b == 0, float("nan")).otherwise(a - b * F.floor(a / F.when(b == 0, 1.0).otherwise(b)))
            case ast.Pow():
                return F.pow(a, b)
            case ast.BitAnd():
                return a & b
            case ast.BitOr():
                return a | b
            case ast.BitXor():
                return a != b
        raise ExpressionError("unknown operator")

    def on_BoolOp(self, node: ast.BoolOp) -> Column:
        out = self.column(node.values[0])
        for v in node.values[1:]:
            out = out & self.column(v) if isinstance(node.op, ast.And) else out | self.column(v)
        return out

    def on_Compare(self, node: ast.Compare) -> Column:
        parts, out = [self.column(x) for x in (node.left, *node.comparators)], None
        for o, a, b in zip(node.ops, parts, parts[1:]):
            match o:
                case ast.Eq():
                    one = a == b
                case ast.NotEq():
                    one = a != b
                case ast.Lt():
                    one = a < b
                case ast.LtE():
                    one = a <= b
                case ast.Gt():
                    one = a > b
                case ast.GtE():
                    one = a >= b
                case _:
                    raise ExpressionError("unknown comparison")
            out = one if out is None else out & one
        return out

    def on_IfExp(self, node: ast.IfExp) -> Column:
        return F.when(self.column(node.test), self.column(node.body)).otherwise(self.column(node.orelse))

    def on_Call(self, node: ast.Call) -> Column:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise ExpressionError("only plain calls of known functions are allowed")
        name, args = node.func.id, [self.column(a) for a in node.args]
        if name in _ONE and len(args) == 1:
            return _ONE[name](args[0])
        if name in _TWO and len(args) == 2:
            return _TWO[name](*args)
        if name in _REDUCE and len(args) == 1:
            return self.reduced(_REDUCE[name](args[0]))
        if name == "norm" and len(args) == 1:
            return self.reduced(F.sqrt(F.sum(args[0] * args[0])))
        if name == "dot" and len(args) == 2:
            return self.reduced(F.sum(args[0] * args[1]))
        if name == "where" and len(args) == 3:
            return F.when(args[0], args[1]).otherwise(args[2])
        if name == "clip" and len(args) == 3:
            return F.least(F.greatest(args[0], args[1]), args[2])
        raise ExpressionError(f"{name} with {len(args)} arguments is not known")

    def reduced(self, aggregate: Column) -> Column:
        name = f"reduced_{len(self.reductions)}_"
        self.reductions[name] = aggregate
        return F.col(name)


def safe_eval(df: DataFrame, expression: str, name: str = "result") -> DataFrame:
    """df with a column computed by the expression over its columns.

    Reductions (mean, sum, std, var, norm, dot) run over all rows: one aggregate whose single row is joined back.
    Reductions of reductions are refused.
    """
    try:
        tree = ast.parse(expression, mode="eval")
    except SyntaxError as e:
        raise ExpressionError(str(e)) from e
    compiler = _Compiler(set(df.columns))
    result = compiler.column(tree)
    if compiler.reductions:
        if any(x in str(a) for a in compiler.reductions.values() for x in compiler.reductions):
            raise ExpressionError("a reduction inside a reduction is not allowed")
        df = df.crossJoin(F.broadcast(df.agg(*(a.alias(n) for n, a in compiler.reductions.items()))))
    return df.withColumn(name, result).drop(*compiler.reductions)
