"""Filter texts and formulas as Spark columns.

Both are short texts in Python notation.  Python's own ``ast`` reads them; the functions here only
replace each node by the Spark column that means the same, from an allow-list.  Nothing is evaluated,
and no SQL text is put together.
"""

from __future__ import annotations

import ast
import math
import re
import warnings
from decimal import Decimal
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.errors import ExpressionError
from facetry.functions.missing import column, compare, is_float, is_numeric

# Words no text may hold, the form of a number, and the spellings of request texts.
FORBIDDEN_WORDS = ("eval", "exec", "import", "__main__")
NUMBER = re.compile(r"^-?[0-9]+(?:\.[0-9]+)?(?:e-?\d+)?$")
SPELLINGS = {".and.": " & ", ".or.": " | ", ".eq.": "=="}

BACK_QUOTED = re.compile(r"""'[^']*'|"[^"]*"|`([^`]+)`""")
QUOTED = re.compile(r"""('[^']*'|"[^"]*"|`[^`]*`)""")
MOST_DIGITS = 38
COMPARATORS = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}


def expand_spellings(text: str) -> str:
    """Replace the spellings that stand for ``&``, ``|`` and ``==`` in request texts."""
    for spelling, sign in SPELLINGS.items():
        text = text.replace(spelling, sign)
    return text


def _parse(text: str) -> tuple[ast.expr, str]:
    """The tree of a text, and the text that its positions refer to.

    A name in back quotes (a Python keyword, a name with blanks) is read as a placeholder of the same meaning.
    """
    for word in FORBIDDEN_WORDS:
        if word in text:
            raise ExpressionError(f"the word {word!r} is not allowed")
    names: dict[str, str] = {}

    def placeholder(match: re.Match) -> str:
        if match[1] is None:
            return match[0]
        return names.setdefault(match[1], f"quoted_name_{len(names)}_")

    source = BACK_QUOTED.sub(placeholder, text.strip())
    try:
        tree = ast.parse(source, mode="eval").body
    except (SyntaxError, ValueError) as error:
        raise ExpressionError(f"cannot read {text!r}: {error}") from None
    given = {alias: name for name, alias in names.items()}
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            node.id = given.get(node.id, node.id)
    return tree, source


# Conditions -------------------------------------------------------------------------------------


def condition(df: DataFrame, text: str | None, invert: bool = False) -> Column | None:
    """The boolean column of a filter text, or ``None`` when the text is empty.

    A text joins comparisons by ``&``, ``|`` and parentheses.  A comparison has a column on at least
    one side, or is a range ``a < column <= b``.
    """
    if text is None or not text.strip():
        return None
    pieces = QUOTED.split(text)
    pieces[::2] = [p.replace("&", " and ").replace("|", " or ") for p in pieces[::2]]
    tree, source = _parse("".join(pieces))
    result = _Conditions(df, source).column(tree)
    return ~result if invert else result


class _Conditions:
    def __init__(self, df: DataFrame, source: str) -> None:
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.source = source
        self.number = 0

    def column(self, node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            join = and_ if isinstance(node.op, ast.And) else or_
            return reduce(join, [self.column(v) for v in node.values])
        self.number += 1
        if not isinstance(node, ast.Compare):
            raise self.error("no comparator")
        if len(node.ops) > 2:
            raise self.error("too many comparators")
        ops = [COMPARATORS.get(type(op)) for op in node.ops]
        if None in ops:
            raise self.error("the middle is not a comparator")
        if len(ops) == 2:
            return self.between(node.left, ops, node.comparators)
        return self.comparison(node.left, ops[0], node.comparators[0])

    def error(self, reason: str) -> ExpressionError:
        return ExpressionError(f"comparison {self.number} is invalid: {reason}")

    def between(self, low: ast.expr, ops: list[str], rest: list[ast.expr]) -> Column:
        middle, high = rest
        if not set(ops) <= {"<", "<="}:
            raise self.error("not a proper range (a < column <= b)")
        if not self.is_column(middle):
            raise self.error("the middle of a range must be a column")
        if not is_numeric(self.types[middle.id]):
            raise self.error("a range needs a numeric column")
        if not self.numeric_value(low) < self.numeric_value(high):
            raise self.error("the range is empty (a >= b)")
        return self.comparison(low, ops[0], middle) & self.comparison(middle, ops[1], high)

    def comparison(self, left: ast.expr, op: str, right: ast.expr) -> Column:
        names = [n.id for n in (left, right) if self.is_column(n)]
        if not names:
            raise self.error("one side must be a column")
        if len(names) == 2:
            kinds = [self.types[n] for n in names]
            if is_numeric(kinds[0]) != is_numeric(kinds[1]):
                raise self.error("the columns have different kinds of values")
        sides = [self.operand(node, self.types[names[0]]) for node in (left, right)]
        floats = [self.is_column(n) and is_float(self.types[n.id]) for n in (left, right)]
        return compare(sides[0], op, sides[1], *floats)

    def is_column(self, node: ast.expr) -> bool:
        return isinstance(node, ast.Name) and node.id in self.types

    def operand(self, node: ast.expr, dtype: T.DataType) -> Column:
        """A column, or a literal in the type of the column it is compared with.

        The literal takes the column's type, not the other way round, so that the comparison reaches
        the Parquet reader.
        """
        if self.is_column(node):
            return column(node.id)
        if is_numeric(dtype):
            value = self.numeric_value(node)
            if isinstance(dtype, T.DecimalType):
                return self.decimal_value(node, dtype)
            if isinstance(dtype, T.IntegralType):
                # Every value of a column lies on one side of what is past 64 bits.
                if not -(2**63) <= value < 2**63:
                    return F.lit(math.copysign(math.inf, 1 if value > 0 else -1))
                return F.lit(int(value)) if value == int(value) else F.lit(value)
            return F.lit(self.as_double(value)).cast(dtype)
        if not isinstance(node, ast.Constant):
            raise self.error("one side is neither a column nor a value")
        if isinstance(dtype, T.BooleanType) and not isinstance(node.value, bool):
            raise self.error("a boolean column is compared with True or False")
        if isinstance(dtype, T.StringType) and not isinstance(node.value, str):
            raise self.error("a text column is compared with a quoted text")
        return F.lit(node.value)

    def decimal_value(self, node: ast.expr, dtype: T.DecimalType) -> Column:
        """A literal that keeps all its digits: in the column's type if that holds it, else in one of its own."""
        value = Decimal((ast.get_source_segment(self.source, node) or "").replace(" ", ""))
        if abs(value.adjusted()) > MOST_DIGITS:
            return F.lit(self.as_double(value))
        digits = value.as_tuple()
        scale = max(0, -digits.exponent)
        whole = max(0, len(digits.digits) + digits.exponent)
        if scale <= dtype.scale and whole <= dtype.precision - dtype.scale:
            return F.lit(value).cast(dtype)
        if whole + scale <= MOST_DIGITS and max(whole, dtype.precision - dtype.scale) + max(scale, dtype.scale) <= MOST_DIGITS:
            return F.lit(value).cast(T.DecimalType(whole + scale, scale))
        return F.lit(float(value))

    @staticmethod
    def as_double(value: float | Decimal) -> float:
        try:
            return float(value)
        except OverflowError:
            return math.inf if value > 0 else -math.inf

    def numeric_value(self, node: ast.expr) -> int | float:
        text = (ast.get_source_segment(self.source, node) or "").replace(" ", "")
        if not NUMBER.match(text):
            raise self.error("a numeric column is compared with a number")
        return float(text) if re.search(r"[.e]", text) else int(text)


# Formulas ---------------------------------------------------------------------------------------


def _smaller_or_larger(pick: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    def either(a: Column, b: Column) -> Column:
        a, b = a.cast("double"), b.cast("double")
        unknown = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
        return F.when(unknown, a + b).otherwise(pick(a, b))

    return either


def _whole(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def apply(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0**62)), x).otherwise(step(x).cast("double"))

    return apply


def _minimum(a: Column, b: Column) -> Column:
    return _smaller_or_larger(F.least)(a, b)


def _maximum(a: Column, b: Column) -> Column:
    return _smaller_or_larger(F.greatest)(a, b)


def _minus(x: Column) -> Column:
    return F.try_subtract(F.lit(0), x)


def _absolute(x: Column) -> Column:
    return F.when(x < 0, _minus(x)).otherwise(x)


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, _absolute),
    "sqrt": (1, F.sqrt),
    "exp": (1, F.exp),
    "log": (1, F.ln),
    "log10": (1, F.log10),
    "log1p": (1, F.log1p),
    "expm1": (1, F.expm1),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
    "tan": (1, F.tan),
    "arcsin": (1, F.asin),
    "arccos": (1, F.acos),
    "arctan": (1, F.atan),
    "arctan2": (2, F.atan2),
    "sinh": (1, F.sinh),
    "cosh": (1, F.cosh),
    "tanh": (1, F.tanh),
    "floor": (1, _whole(F.floor)),
    "ceil": (1, _whole(F.ceil)),
    "round": (1, F.bround),
    "minimum": (2, _minimum),
    "maximum": (2, _maximum),
    "deg2rad": (1, F.radians),
    "rad2deg": (1, F.degrees),
    "isnan": (1, lambda x: F.isnan(x.cast("double"))),
    "where": (3, lambda test, a, b: F.when(test, a).otherwise(b)),
    "clip": (3, lambda x, low, high: _minimum(_maximum(x, low), high)),
}

# ``try_`` forms give NULL where a division by zero or an integer overflow would end the job.  Whole numbers are
# counted in 64 bits, whatever the type of their column.
ARITHMETIC = {
    ast.Add: F.try_add,
    ast.Sub: F.try_subtract,
    ast.Mult: F.try_multiply,
    ast.Div: F.try_divide,
    ast.Pow: F.pow,
}


def formula_names(text: str) -> set[str]:
    """The columns a formula reads."""
    tree, _ = _parse(text)
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - (called & set(FUNCTIONS))


def formula(df: DataFrame, text: str) -> Column:
    """The numeric column of a formula such as ``4.44 + 4*log10(teff/5770)``."""
    if not text or not text.strip():
        raise ExpressionError("no formula given")
    result = _formula_node(_parse(text)[0], df)
    if isinstance(df.select(result.alias("x")).schema["x"].dataType, T.BooleanType):
        raise ExpressionError("a formula must give a number, not a comparison")
    return result


def _is_long(value: int | float) -> bool:
    return isinstance(value, int) and -(2**63) <= value < 2**63


def _bit_difference(df: DataFrame, left: Column, right: Column) -> Column:
    """``^``, which is the bit operator and no power, and so takes whole numbers only."""
    types = [f.dataType for f in df.select(left.alias("a"), right.alias("b")).schema.fields]
    if not all(isinstance(t, T.IntegralType) for t in types):
        raise ExpressionError("'^' is not a power; write '**'")
    warnings.warn("'^' compares bits; for a power write '**'", stacklevel=2)
    return left.bitwiseXOR(right)


def _formula_node(node: ast.expr, df: DataFrame) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}

    def sub(part: ast.expr) -> Column:
        return _formula_node(part, df)

    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return F.lit(node.value).cast("bigint") if _is_long(node.value) else F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id not in types:
            raise ExpressionError(f"there is no column {node.id!r}")
        if not isinstance(types[node.id], (T.NumericType, T.BooleanType)):
            raise ExpressionError(f"column {node.id!r} is not numeric")
        whole = isinstance(types[node.id], T.IntegralType)
        return column(node.id).cast("bigint") if whole else column(node.id)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return _minus(sub(node.operand)) if isinstance(node.op, ast.USub) else sub(node.operand)
    if isinstance(node, ast.BinOp):
        if isinstance(node.op, ast.BitXor):
            return _bit_difference(df, sub(node.left), sub(node.right))
        if type(node.op) in ARITHMETIC:
            return ARITHMETIC[type(node.op)](sub(node.left), sub(node.right))
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARATORS:
        sides = [sub(part).cast("double") for part in (node.left, node.comparators[0])]
        return compare(sides[0], COMPARATORS[type(node.ops[0])], sides[1], True, True)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        arity, build = FUNCTIONS.get(node.func.id, (None, None))
        if build is None:
            raise ExpressionError(f"there is no function {node.func.id!r}")
        if len(node.args) != arity:
            raise ExpressionError(f"{node.func.id} takes {arity} value(s)")
        return build(*[sub(a) for a in node.args])
    raise ExpressionError(f"{ast.unparse(node)!r} is not allowed in a formula")
