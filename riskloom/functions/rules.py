"""Rule expressions (E1) and rule-set files.

A rule is ``{name, expr, weight}``.  Expressions are written in the style of pandas masks or of SQL conditions:
``(dpd > 30) & ~(zone == 'A')``, ``quality.isin(['IV', 'V'])``, ``dpd > 30 AND region IS NULL``.  The text is parsed,
never executed: only columns, literals, comparisons, boolean and arithmetic operators, ``IN`` / ``isin``, ``IS NULL`` /
``isna`` / ``notna`` and ``abs`` are known, and a Spark column is built from them.  Arithmetic that has no result (a
division by zero) gives a missing value; missing values make a rule false.
"""
from __future__ import annotations

import ast
import logging
import re

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config

log = logging.getLogger(__name__)

_SQL_WORDS = (
    (r"\bIS\s+NOT\s+NULL\b", ".notna()"), (r"\bIS\s+NULL\b", ".isna()"), (r"\bNOT\s+IN\b", "not in"), (r"\bIN\b", "in"),
    (r"\bAND\b", "and"), (r"\bOR\b", "or"), (r"\bNOT\b", "not"), (r"\bTRUE\b", "True"), (r"\bFALSE\b", "False"),
    (r"<>", "!="), (r"(?<![<>=!])=(?!=)", "=="),
)
_TEXT = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`([A-Za-z_]\w*)`")


class RuleError(ValueError):
    """The text is no rule: it cannot be read, or uses something that rules do not know."""


def normalize_expr(expr: str) -> str:
    """The expression with SQL words put in the one form that is parsed; text in quotes stays as it is."""
    out, at = [], 0
    for m in [*_TEXT.finditer(expr), None]:
        part = expr[at:m.start() if m else len(expr)]
        for pattern, word in _SQL_WORDS:
            part = re.sub(pattern, word, part, flags=re.IGNORECASE)
        out.append(re.sub(r"\s+\.(isna|notna)\(\)", r".\1()", part))
        if m:
            out.append(m[1] or m[0])
            at = m.end()
    return "".join(out).strip()


class _Builder:
    """Builds (column, kind) from a parsed expression; kind is bool, number or text."""

    COMPARE = {ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
    ARITHMETIC = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply, ast.Div: F.try_divide}

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def build(self, node: ast.AST) -> tuple[Column, str]:
        method = getattr(self, f"_{type(node).__name__.lower()}", None)
        if method is None:
            raise RuleError(f"a rule cannot use {type(node).__name__}")
        return method(node)

    def _of(self, node: ast.AST, kind: str) -> Column:
        column, own = self.build(node)
        if own != kind:
            raise RuleError(f"{ast.unparse(node)} is {own}, not {kind}")
        return column

    def _expression(self, node):
        return self.build(node.body)

    def _name(self, node):
        if node.id not in self.types:
            raise KeyError(node.id)
        kind, column = self.types[node.id], F.col(f"`{node.id}`")
        if isinstance(kind, T.BooleanType):
            return column, "bool"
        if isinstance(kind, T.NumericType):
            return column.cast("double"), "number"
        if isinstance(kind, T.StringType):
            return column, "text"
        raise RuleError(f"column {node.id} is of a type that rules do not know")

    def _constant(self, node):
        if isinstance(node.value, bool):
            return F.lit(node.value), "bool"
        if isinstance(node.value, (int, float)):
            return F.lit(float(node.value)), "number"
        if isinstance(node.value, str):
            return F.lit(node.value), "text"
        raise RuleError(f"a rule cannot use {node.value!r}")

    def _boolop(self, node):
        parts = [F.coalesce(self._of(v, "bool"), F.lit(False)) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out, "bool"

    def _binop(self, node):
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            a, b = (F.coalesce(self._of(x, "bool"), F.lit(False)) for x in (node.left, node.right))
            return (a & b if isinstance(node.op, ast.BitAnd) else a | b), "bool"
        if type(node.op) not in self.ARITHMETIC:
            raise RuleError(f"a rule cannot use {type(node.op).__name__}")
        return self.ARITHMETIC[type(node.op)](self._of(node.left, "number"), self._of(node.right, "number")), "number"

    def _unaryop(self, node):
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~F.coalesce(self._of(node.operand, "bool"), F.lit(False)), "bool"
        if isinstance(node.op, ast.USub):
            return -self._of(node.operand, "number"), "number"
        return self.build(node.operand)

    def _members(self, column: Column, kind: str, items: ast.AST) -> Column:
        if not isinstance(items, (ast.List, ast.Tuple, ast.Set)):
            items = ast.Tuple(elts=[items])
        same = [x for x in map(self._constant_of, items.elts) if x[1] == kind]
        return F.coalesce(column.isin(*[x[0] for x in same]), F.lit(False)) if same else F.lit(False)

    def _constant_of(self, node):
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return F.lit(-float(node.operand.value)), "number"
        if not isinstance(node, ast.Constant):
            raise RuleError("a list in a rule holds literals only")
        return self._constant(node)

    def _compare(self, node):
        out, left = F.lit(True), node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                found = self._members(*self.build(left), right)
                out = out & (~found if isinstance(op, ast.NotIn) else found)
            elif type(op) in self.COMPARE:
                (a, ka), (b, kb) = self.build(left), self.build(right)
                if {ka, kb} == {"bool", "number"}:
                    a, b, kb, ka = a.cast("double"), b.cast("double"), "number", "number"
                if ka != kb:
                    raise RuleError(f"{ast.unparse(left)} is {ka} and {ast.unparse(right)} is {kb}")
                out = out & getattr(a, self.COMPARE[type(op)])(b)
            else:
                raise RuleError(f"a rule cannot use {type(op).__name__}")
            left = right
        return out, "bool"

    def _call(self, node):
        if node.keywords:
            raise RuleError("a rule's functions have no named arguments")
        if isinstance(node.func, ast.Attribute):
            column, kind = self.build(node.func.value)
            if node.func.attr == "isin" and len(node.args) == 1:
                return self._members(column, kind, node.args[0]), "bool"
            if node.func.attr in ("isna", "isnull", "notna", "notnull") and not node.args:
                return (column.isNull() if node.func.attr.startswith("is") else column.isNotNull()), "bool"
        elif isinstance(node.func, ast.Name) and node.func.id.lower() == "abs" and len(node.args) == 1:
            return F.abs(self._of(node.args[0], "number")), "number"
        raise RuleError(f"a rule cannot call {ast.unparse(node.func)}")


def rule_column(df: DataFrame, expr: str) -> Column:
    """Boolean column for ``expr``; missing values -> false.  A rule over a column that ``df`` does not have, or
    that compares values of different kinds, is false in every row and logged.  Text that is no rule raises RuleError."""
    try:
        tree = ast.parse(normalize_expr(expr), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise RuleError(f"not a rule: {expr!r}") from e
    _check(tree, expr)
    try:
        column, kind = _Builder(df).build(tree)
        if kind == "text":
            raise RuleError(f"{expr!r} is no condition")
    except KeyError as e:
        log.warning("rule %r: no column %s, false in every row", expr, e)
        return F.lit(False)
    except RuleError as e:
        log.warning("rule %r: %s, false in every row", expr, e)
        return F.lit(False)
    return F.coalesce(column if kind == "bool" else column != 0, F.lit(False))


_KNOWN = (ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.BinOp, ast.BitAnd, ast.BitOr, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.UnaryOp, ast.Not, ast.Invert,
          ast.USub, ast.UAdd, ast.Compare, ast.Gt, ast.GtE, ast.Lt, ast.LtE, ast.Eq, ast.NotEq, ast.In, ast.NotIn, ast.Name, ast.Load, ast.Constant, ast.List, ast.Tuple,
          ast.Set, ast.Call, ast.Attribute)
_METHODS = ("isin", "isna", "isnull", "notna", "notnull")


def _check(tree: ast.AST, expr: str) -> None:
    """Refuse everything outside the short list, whatever the columns are."""
    for node in ast.walk(tree):
        if not isinstance(node, _KNOWN):
            raise RuleError(f"a rule cannot use {type(node).__name__}: {expr!r}")
        if isinstance(node, ast.Attribute) and node.attr not in _METHODS:
            raise RuleError(f"a rule cannot use .{node.attr}: {expr!r}")
        if isinstance(node, ast.Call) and not isinstance(node.func, ast.Attribute) and not (isinstance(node.func, ast.Name) and node.func.id.lower() == "abs"):
            raise RuleError(f"a rule cannot call {ast.unparse(node.func)}: {expr!r}")


def load_rules(path: str) -> tuple[list[dict], dict]:
    """Rules and zones from YAML; missing keys fall back to the defaults."""
    with open(path, encoding="utf-8") as fh:
        data = yaml.safe_load(fh) or {}
    rules = [
        {"name": str(r["name"]), "expr": normalize_expr(str(r["expr"])), "weight": float(r.get("weight", 1))}
        for r in data.get("rules", [])
    ]
    return rules, data.get("zones", config.EWS_ZONES)


def save_rules(rules: list[dict], path: str, zones: dict | None = None) -> str:
    """Write rules and zones as YAML."""
    with open(path, "w", encoding="utf-8") as fh:
        yaml.safe_dump({"rules": rules, "zones": zones or config.EWS_ZONES}, fh, allow_unicode=True,
                       sort_keys=False)
    return path
