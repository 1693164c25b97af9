"""Universe predicates and code filters as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(
    r"(?P<column>[A-Za-z_][A-Za-z0-9_]*)\s*(?P<op>==|!=|>=|<=|>|<)\s*(?P<number>-?[0-9]+(?:\.[0-9]+)?)"
    r"|(?P<joint>[&|()])"
    r"|(?P<space>\s+)"
)
_REDUCIBLE = re.compile(r"\(c\)|c[&|]c")
_JOINTS = {"&": " AND ", "|": " OR ", "(": "(", ")": ")"}
#: A predicate with more alternatives than this is not taken apart (see ``universe_terms``).
MOST_TERMS = 64
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _pieces(expr: str, columns: Collection[str]) -> list[re.Match]:
    """Split a predicate into comparisons and joints, or raise ValueError."""
    if not isinstance(expr, str):
        raise ValueError(f"a universe is a text, not {type(expr).__name__}")
    found, at = [], 0
    while at < len(expr):
        piece = _PIECE.match(expr, at)
        if piece is None:
            raise ValueError(f"this universe cannot be read at place {at}: {expr!r}")
        at = piece.end()
        if piece["space"] is None:
            found.append(piece)
        if piece["column"] is not None and ("__" in piece["column"] or piece["column"] not in columns):
            raise ValueError(f"not a universe, {piece['column']!r} is not a known column: {expr!r}")
    # The grammar holds when the outline collapses to one comparison.
    outline, before = "".join(p["joint"] or "c" for p in found), None
    while outline != before:
        before, outline = outline, _REDUCIBLE.sub("c", outline)
    if outline != "c":
        raise ValueError(f"this universe is not made of comparisons of a column with a number, & | and parentheses: {expr!r}")
    return found


def validate_universe(expr: str | None, columns: Collection[str]) -> None:
    """Accept ``COLUMN op NUMBER`` joined by ``& | ( )`` over known columns; raise ValueError otherwise."""
    if expr is not None:
        _pieces(expr, columns)


def _comparison(piece: re.Match, kind: T.DataType) -> str:
    name, op, number = f"`{piece['column']}`", piece["op"], piece["number"]
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"a universe compares numbers only, {piece['column']!r} holds none")
    if "." in number or len(number) > 18:
        number += "D"
    if op == "!=":
        return f"NOT ({name} <=> {number})"  # a missing answer differs from every code
    if op in (">", ">=") and isinstance(kind, (T.FloatType, T.DoubleType)):
        return f"({name} {op} {number} AND NOT isnan({name}))"  # Spark sorts NaN above all numbers
    return f"{name} {'=' if op == '==' else op} {number}"


def universe_sql(df: DataFrame, expr: str | None) -> str:
    """The predicate as Spark SQL text. AND binds tighter than OR, as in the input."""
    if expr is None:
        return "true"
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return "".join(
        _JOINTS[p["joint"]] if p["joint"] else _comparison(p, kinds[p["column"]]) for p in _pieces(expr, kinds)
    )


def universe_terms(df: DataFrame, expr: str | None) -> set[frozenset[str]]:
    """The predicate as alternatives: it holds for a row when all comparisons of one alternative hold.

    Comparisons are SQL text, and none of them is negated, so one that is NULL may count as false. No predicate is one empty
    alternative. A predicate of more than ``MOST_TERMS`` alternatives is one comparison of its own: the whole text.
    """
    if expr is None:
        return {frozenset()}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    levels: list[tuple[set, set]] = [(set(), {frozenset()})]  # per open parenthesis: alternatives so far, the one being read
    for piece in _pieces(expr, kinds):
        so_far, current = levels.pop()
        if piece["joint"] == "(":
            levels += [(so_far, current), (set(), {frozenset()})]
        elif piece["joint"] == "|":
            levels.append((so_far | current, {frozenset()}))
        elif piece["joint"] == "&":
            levels.append((so_far, current))
        else:
            if piece["joint"] == ")":
                found = so_far | current
                so_far, current = levels.pop()
            else:
                found = {frozenset([_comparison(piece, kinds[piece["column"]])])}
            if len(found) * len(current) > MOST_TERMS:
                return {frozenset([f"({universe_sql(df, expr)})"])}
            levels.append((so_far, {a | b for a in current for b in found}))
    so_far, current = levels.pop()
    return so_far | current


def universe_filter(df: DataFrame, expr: str | None) -> Column:
    """The predicate as a column for ``where``."""
    return F.expr(universe_sql(df, expr))


def codes_sql(df: DataFrame, name: str, codes: Sequence[int]) -> str:
    """Membership in a code list as Spark SQL text; a contiguous range becomes an interval test."""
    if len(codes) == 0:
        return "false"
    if isinstance(codes, range) and codes.step == 1:
        inside = f"`{name}` BETWEEN {codes[0]} AND {codes[-1]}"
        return inside if is_integral(df, name) else f"({inside} AND `{name}` = floor(`{name}`))"
    return f"`{name}` IN ({', '.join(str(int(c)) for c in codes)})"


def in_codes(df: DataFrame, name: str, codes: Sequence[int]) -> Column:
    return F.expr(codes_sql(df, name, codes))


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _INTEGRAL)


def as_flag(condition: Column) -> Column:
    """1.0 for yes, 0.0 for no and for missing."""
    return F.when(condition, 1.0).otherwise(0.0)


def threshold_flag(value: Column, point: Column) -> Column:
    """1.0 where the value is at most the point."""
    return as_flag(value <= point)


def integer_sql(df: DataFrame, name: str) -> str:
    return f"`{name}` IS NOT NULL" if is_integral(df, name) else f"`{name}` = floor(`{name}`)"


def integer_like(df: DataFrame, name: str) -> Column:
    """True for whole numbers; missing values are not."""
    return F.expr(integer_sql(df, name))


def finite_sql(df: DataFrame, name: str) -> str:
    value = f"CAST(`{name}` AS DOUBLE)"
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"nanvl({value}, CAST(NULL AS DOUBLE))"
    return value


def finite(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into NULL."""
    return F.expr(finite_sql(df, name))
