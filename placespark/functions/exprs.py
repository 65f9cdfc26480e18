"""Column expressions built as SQL text.

Same names and call style as ``pyspark.sql.functions``. Geometry functions nest many lambdas; as text
they reach the JVM in one call per column, where the usual builders make one call per node. A ``Sql``
is a Column, so it can be used wherever DataFrame methods take one; names this module lacks come from
``pyspark.sql.functions``.
"""

from __future__ import annotations

import inspect
import itertools
import operator as op
import re

from pyspark.sql import Column
from pyspark.sql import functions as _functions
from pyspark.sql.classic.column import Column as _ClassicColumn

_numbers = itertools.count(1)
_NAME = re.compile(r"^[A-Za-z_][\w.]*$")


_PLAIN = {
    "+": op.add, "-": op.sub, "*": op.mul, "/": op.truediv, "%": op.mod, "=": op.eq, "!=": op.ne, "<": op.lt,
    "<=": op.le, ">": op.gt, ">=": op.ge, "AND": op.and_, "OR": op.or_,
}


def _is_text(value) -> bool:
    """Can the value be written as text? Columns made elsewhere cannot, unless they are plain names."""
    return isinstance(value, Sql) or not isinstance(value, Column) or bool(_NAME.match(value._jc.node().sql()))


class Sql(_ClassicColumn):
    """A Column known by its SQL text."""

    def __init__(self, text: str, name: str | None = None):
        self.text = text
        self.name_ = name
        self._made = None

    @property
    def _jc(self):
        if self._made is None:
            made = _functions.expr(self.text)
            self._made = (made.alias(self.name_) if self.name_ else made)._jc
        return self._made

    def _infix(self, operator, other, swap=False):
        if not _is_text(other):
            return _PLAIN[operator](_functions.expr(self.text), other)
        a, b = (literal(other), self.text) if swap else (self.text, literal(other))
        return Sql(f"({a} {operator} {b})")

    def __add__(self, o):
        return self._infix("+", o)

    def __radd__(self, o):
        return self._infix("+", o, True)

    def __sub__(self, o):
        return self._infix("-", o)

    def __rsub__(self, o):
        return self._infix("-", o, True)

    def __mul__(self, o):
        return self._infix("*", o)

    def __rmul__(self, o):
        return self._infix("*", o, True)

    def __truediv__(self, o):
        return self._infix("/", o)

    def __rtruediv__(self, o):
        return self._infix("/", o, True)

    def __mod__(self, o):
        return self._infix("%", o)

    def __eq__(self, o):
        return self._infix("=", o)

    def __ne__(self, o):
        return self._infix("!=", o)

    def __lt__(self, o):
        return self._infix("<", o)

    def __le__(self, o):
        return self._infix("<=", o)

    def __gt__(self, o):
        return self._infix(">", o)

    def __ge__(self, o):
        return self._infix(">=", o)

    def __and__(self, o):
        return self._infix("AND", o)

    def __or__(self, o):
        return self._infix("OR", o)

    def __invert__(self):
        return Sql(f"(NOT {self.text})")

    def __neg__(self):
        return Sql(f"(-{self.text})")

    def __getitem__(self, key):
        if isinstance(key, str):
            return Sql(f"{self.text}.{key}", key)
        return Sql(f"{self.text}[{literal(key)}]")

    def alias(self, *names, **_):
        if len(names) > 1:
            return _functions.expr(self.text).alias(*names)
        return Sql(self.text, names[0])

    def cast(self, to):
        to = to if isinstance(to, str) else to.simpleString()
        return Sql(f"CAST({self.text} AS {to})", self.name_)

    def isNull(self):  # noqa: N802
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self):  # noqa: N802
        return Sql(f"({self.text} IS NOT NULL)")

    def isin(self, *values):
        return Sql(f"({self.text} IN ({', '.join(literal(v) for v in values)}))")

    def startswith(self, other):
        return Sql(f"startswith({self.text}, {literal(other)})")

    def contains(self, other):
        return Sql(f"contains({self.text}, {literal(other)})")

    def rlike(self, other):
        return Sql(f"({self.text} RLIKE {literal(other)})")


class Case(Sql):
    """CASE under construction."""

    def __init__(self, branches):
        self.branches = branches
        super().__init__(f"CASE {' '.join(branches)} END")

    def when(self, condition, value):
        if not (_is_text(condition) and _is_text(value)):
            raise TypeError("start with pyspark's when to mix in columns made elsewhere")
        return Case([*self.branches, f"WHEN {literal(condition)} THEN {literal(value)}"])

    def otherwise(self, value):
        return Sql(f"CASE {' '.join(self.branches)} ELSE {literal(value)} END")


def literal(value) -> str:
    """SQL text of a Python value, or the text of an expression."""
    if isinstance(value, Sql):
        return value.text
    if isinstance(value, Column):
        text = value._jc.node().sql()
        if not _NAME.match(text):
            raise TypeError(f"needs an expression of this module, not {text}")
        return text
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _text(argument) -> str:
    """Arguments of functions: strings are column names."""
    return argument if isinstance(argument, str) else literal(argument)


def expr(text: str) -> Sql:
    return Sql(f"({text})")


def col(name: str) -> Sql:
    return Sql(name, name.split(".")[-1])


def lit(value) -> Sql:
    return value if isinstance(value, Sql) else Sql(literal(value))


def when(condition, value) -> Column:
    if not (_is_text(condition) and _is_text(value)):
        return _functions.when(condition, value)
    return Case([f"WHEN {literal(condition)} THEN {literal(value)}"])


def struct(*fields) -> Column:
    if not all(_is_text(f) for f in fields):
        return _functions.struct(*fields)
    parts = []
    for f in fields:
        name = f.split(".")[-1] if isinstance(f, str) else f.name_
        parts.append(f"'{name}', {_text(f)}")
    return Sql(f"named_struct({', '.join(parts)})")


def function(name: str):
    def call(*arguments):
        flat = arguments[0] if len(arguments) == 1 and isinstance(arguments[0], (list, tuple)) else arguments
        if not all(_is_text(a) for a in flat):
            return getattr(_functions, name)(*flat)
        return Sql(f"{name}({', '.join(_text(a) for a in flat)})")

    return call


for _name in (
    "abs acos array array_compact array_contains array_distinct array_max array_min array_position array_sort"
    " asin atan atan2 cbrt ceil coalesce concat concat_ws contains cos degrees element_at exp flatten floor get greatest hypot"
    " isnull least length ln log10 lower nullif pmod power radians regexp_count repeat reverse round sequence shiftleft"
    " sign sin size slice sort_array sqrt startswith substring tan translate trim try_element_at upper"
).split():
    globals()[_name] = function(_name)
log = function("ln")
pow = function("power")


def split(value, pattern) -> Sql:
    return Sql(f"split({_text(value)}, {literal(pattern)})")


def array_join(items, separator) -> Sql:
    return Sql(f"array_join({_text(items)}, {literal(separator)})")


def regexp_replace(value, pattern, replacement) -> Sql:
    return Sql(f"regexp_replace({_text(value)}, {literal(pattern)}, {literal(replacement)})")


def regexp_extract(value, pattern, group=1) -> Sql:
    return Sql(f"regexp_extract({_text(value)}, {literal(pattern)}, {literal(group)})")


def regexp_extract_all(value, pattern, group=1) -> Sql:
    return Sql(f"regexp_extract_all({_text(value)}, {literal(pattern)}, {literal(group)})")


def _lambda(body, count=None) -> str:
    count = count or len(inspect.signature(body).parameters)
    names = [f"v{next(_numbers)}" for _ in range(count)]
    inner = literal(body(*[Sql(n, n) for n in names]))
    return f"{names[0] if count == 1 else '(' + ', '.join(names) + ')'} -> {inner}"


def transform(items, body) -> Sql:
    return Sql(f"transform({_text(items)}, {_lambda(body)})")


def filter(items, body) -> Sql:  # noqa: A001
    return Sql(f"filter({_text(items)}, {_lambda(body)})")


def exists(items, body) -> Sql:
    return Sql(f"exists({_text(items)}, {_lambda(body)})")


def forall(items, body) -> Sql:
    return Sql(f"forall({_text(items)}, {_lambda(body)})")


def zip_with(a, b, body) -> Sql:
    return Sql(f"zip_with({_text(a)}, {_text(b)}, {_lambda(body)})")


def aggregate(items, start, merge) -> Sql:
    return Sql(f"aggregate({_text(items)}, {literal(start)}, {_lambda(merge)})")


def let(value, body) -> Sql:
    """Bind ``value`` once and use it many times inside ``body``."""
    return element_at(transform(array(value), body), 1)  # noqa: F821


def bind(value, body) -> Sql:
    """``let`` for anything but plain names."""
    value = value if isinstance(value, Sql) else Sql(literal(value))
    return body(value) if _NAME.match(value.text) else let(value, body)


def __getattr__(name: str):
    return getattr(_functions, name)
