"""Column expressions: missing values, guarded division, and row predicates given as text."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as a double, with NaN as null; parsed in one call, since tables have thousands of columns."""
    return F.expr("nanvl(cast(`" + name.replace("`", "``") + "` as double), cast(null as double))")


def is_missing(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    test = col(name).isNull()
    return test | F.isnan(col(name)) if isinstance(kind, (T.FloatType, T.DoubleType)) else test


_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_ARITHMETIC = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Mod: "__mod__", ast.Div: "__truediv__", ast.Pow: "__pow__"}


def _tidy(text: str) -> tuple[str, dict[str, str]]:
    """Python syntax for a query text: & | ~ as and/or/not, back-quoted names as identifiers."""
    names: dict[str, str] = {}

    def name(m: re.Match) -> str:
        key = f"_quoted_{len(names)}"
        names[key] = m[1]
        return key

    text = re.sub(r"`([^`]+)`", name, text)
    words = {"&": "and", "|": "or", "~": "not"}
    tokens = [(t.type, f" {words[t.string]} " if t.type == tokenize.OP and t.string in words else t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in (tokenize.NEWLINE, tokenize.ENDMARKER, tokenize.NL)]
    return " ".join(s for _, s in tokens), names


def predicate(df: DataFrame, condition: str | Column) -> Column:
    """A boolean column from a query text such as ``Metadata_treatment == 'control' and x in [1, 2]``.

    Comparisons, chains of them, ``in``, ``and/or/not`` (also ``& | ~``), arithmetic, back-quoted
    names, ``isnull/isna/notnull/notna/isin/between`` and ``str.contains/startswith/endswith``
    are understood.  Comparisons with a missing value are false, ``!=`` and ``not in`` true.
    """
    if isinstance(condition, Column):
        return condition
    text, names = _tidy(condition)
    columns = set(df.columns)

    def value(node: ast.expr):
        match node:
            case ast.Constant():
                return node.value
            case ast.Name():
                name = names.get(node.id, node.id)
                if name not in columns:
                    raise ValueError(f"{name} is not a column")
                return number(name) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else col(name)
            case ast.List() | ast.Tuple() | ast.Set():
                return [value(x) for x in node.elts]
            case ast.UnaryOp(op=ast.USub()):
                return -value(node.operand)
            case ast.UnaryOp(op=ast.Not()):
                return ~value(node.operand)
            case ast.BoolOp():
                parts = [value(x) for x in node.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(node.op, ast.And) else out | p
                return out
            case ast.BinOp(op=ast.Div()):
                return F.try_divide(_lit(value(node.left)), _lit(value(node.right)))
            case ast.BinOp() if type(node.op) in _ARITHMETIC:
                return getattr(_lit(value(node.left)), _ARITHMETIC[type(node.op)])(value(node.right))
            case ast.Compare():
                out, left = None, value(node.left)
                for op, right in zip(node.ops, map(value, node.comparators), strict=True):
                    one = _compared(op, left, right)
                    out = one if out is None else out & one
                    left = right
                return out
            case ast.Call(func=ast.Attribute()):
                return _called(node, value)
        raise ValueError(f"not understood in a query: {ast.unparse(node)}")

    body = ast.parse(text.strip(), mode="eval").body
    out = value(body)
    if not isinstance(out, Column) or isinstance(body, ast.BinOp) or (isinstance(body, ast.UnaryOp) and isinstance(body.op, ast.USub)):
        raise ValueError(f"{condition!r} is not a condition")
    return F.coalesce(out, F.lit(False))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _compared(op: ast.cmpop, left, right) -> Column:
    if isinstance(op, (ast.In, ast.NotIn)):
        test = F.coalesce(_lit(left).isin(right), F.lit(False))
        return ~test if isinstance(op, ast.NotIn) else test
    if isinstance(right, list):  # == with a list means membership
        test = F.coalesce(_lit(left).isin(right), F.lit(False))
        return ~test if isinstance(op, ast.NotEq) else test
    if type(op) not in _COMPARE:
        raise ValueError("use == or in to compare")
    return F.coalesce(getattr(_lit(left), _COMPARE[type(op)])(right), F.lit(isinstance(op, ast.NotEq)))


def _called(node: ast.Call, value) -> Column:
    of, args = node.func.value, [value(a) for a in node.args]
    if isinstance(of, ast.Attribute) and of.attr == "str":
        text = value(of.value)
        match node.func.attr:
            case "contains":
                return F.coalesce(text.rlike(args[0]), F.lit(False))
            case "startswith":
                return F.coalesce(text.startswith(args[0]), F.lit(False))
            case "endswith":
                return F.coalesce(text.endswith(args[0]), F.lit(False))
    else:
        x = value(of)
        match node.func.attr:
            case "isnull" | "isna":
                return x.isNull()
            case "notnull" | "notna":
                return x.isNotNull()
            case "isin":
                return F.coalesce(x.isin(args[0]), F.lit(False))
            case "between":
                return F.coalesce(x.between(*args), F.lit(False))
    raise ValueError(f"not understood in a query: {ast.unparse(node)}")


def subset(df: DataFrame, samples: str | Column) -> DataFrame:
    """The rows that ``samples`` names; ``"all"`` is every row."""
    return df if isinstance(samples, str) and samples == "all" else df.filter(predicate(df, samples))


def unique_name(name: str, taken) -> str:
    taken = set(taken)
    while name in taken:
        name += "_"
    return name
