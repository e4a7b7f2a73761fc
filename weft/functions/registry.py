"""The 45 scalar functions, with the semantics of SQLite.

A function outside the registry is an error. Where Spark differs (null handling of two-argument minima, base of ``log``, letters
outside ASCII, positions from 0, NaN), the expression keeps SQLite's result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import WeftError


class Clock:
    """What ``now`` is, and the counters of the connection a function may ask for."""

    def __init__(self, now: int = 0, changes: int | None = None, total_changes: int | None = None, last_insert_rowid: int | None = None):
        self.now, self.changes, self.total_changes, self.last_insert_rowid = now, changes, total_changes, last_insert_rowid


def _number(c: Column) -> Column:
    return c.cast("double")


def _no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _real(f: Callable) -> Callable:
    return lambda clock, *a: _no_nan(f(*map(_number, a)))


def _two(pick: Callable) -> Callable:
    return lambda clock, a, b: F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def _time(clock: Clock, c: Column) -> Column:
    """A timestamp without zone, in UTC, from 'now', or a date or date and time."""
    text = c.cast("string")
    return F.when(text == "now", _now(clock)).otherwise(text.try_cast("timestamp_ntz"))


def _now(clock: Clock) -> Column:
    return F.expr(f"timestampadd(SECOND, {int(clock.now)}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def _form(pattern: str) -> Callable:
    return lambda clock, c: F.date_format(_time(clock, c), pattern)


def _substr(clock: Clock, s: Column, i: Column, n: Column) -> Column:
    return F.when(i == 0, F.substring(s, F.lit(1), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(F.substring(s, i.cast("int"), n.cast("int")))


def _strftime(clock: Clock, pattern: Column) -> Column:
    """Of the current time; the codes of dates and times that have a direct counterpart."""
    codes = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}
    out = pattern
    now = _now(clock)
    for code, form in codes.items():
        out = F.replace(out, F.lit(code), F.date_format(now, form))
    return F.replace(F.replace(out, F.lit("%s"), F.lit(str(clock.now))), F.lit("%%"), F.lit("%"))


def _connection(name: str) -> Callable:
    def of(clock: Clock) -> Column:
        value = getattr(clock, name)
        if value is None:
            raise WeftError("UnsupportedFunction", f"{name} is known only after a mutation")
        return F.lit(value).cast("long")

    return of


_LOWER, _UPPER = string.ascii_lowercase, string.ascii_uppercase
#: name: (number of arguments, expression)
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "max": (2, _two(F.greatest)),
    "min": (2, _two(F.least)),
    "abs": (1, lambda clock, a: F.abs(a)),
    "acos": (1, _real(F.acos)),
    "asin": (1, _real(F.asin)),
    "atan": (1, _real(F.atan)),
    "atan2": (2, _real(F.atan2)),
    "ceil": (1, lambda clock, a: F.ceil(_number(a)).cast("long")),
    "cos": (1, _real(F.cos)),
    "exp": (1, _real(F.exp)),
    "floor": (1, lambda clock, a: F.floor(_number(a)).cast("long")),
    "ln": (1, _real(F.ln)),
    "log": (1, _real(F.log10)),
    "mod": (2, lambda clock, a, b: F.try_mod(_number(a), _number(b))),
    "pi": (0, lambda clock: F.pi()),
    "pow": (2, _real(F.pow)),
    "random": (0, lambda clock: F.xxhash64(F.rand(), F.monotonically_increasing_id())),
    "randomblob": (1, lambda clock, n: F.unhex(F.substring(F.repeat(F.sha2(F.rand().cast("string"), 256), F.ceil(n / 32).cast("int")), F.lit(1), (2 * n).cast("int")))),
    "round": (1, lambda clock, a: F.round(_number(a)).cast("long")),
    "sign": (1, lambda clock, a: F.signum(_number(a)).cast("long")),
    "sin": (1, _real(F.sin)),
    "sqrt": (1, _real(F.sqrt)),
    "tan": (1, _real(F.tan)),
    "trunc": (1, lambda clock, a: _number(a).cast("long")),
    "length": (1, lambda clock, s: F.char_length(s.cast("string")).cast("long")),
    "lower": (1, lambda clock, s: F.translate(s, _UPPER, _LOWER)),
    "upper": (1, lambda clock, s: F.translate(s, _LOWER, _UPPER)),
    "substr": (3, _substr),
    "trim": (1, lambda clock, s: F.trim(s)),
    "ltrim": (1, lambda clock, s: F.ltrim(s)),
    "rtrim": (1, lambda clock, s: F.rtrim(s)),
    "replace": (3, lambda clock, s, a, b: F.replace(s, a, b)),
    "like": (2, lambda clock, pattern, s: F.ilike(s, pattern)),
    "hex": (1, lambda clock, s: F.hex(s.cast("string"))),
    "date": (1, _form("yyyy-MM-dd")),
    "time": (1, _form("HH:mm:ss")),
    "datetime": (1, _form("yyyy-MM-dd HH:mm:ss")),
    "julianday": (1, lambda clock, c: F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), _time(clock, c)) / F.lit(86400e6) + F.lit(2440587.5)),
    "strftime": (1, _strftime),
    "ifnull": (2, lambda clock, a, b: F.coalesce(a, b)),
    "nullif": (2, lambda clock, a, b: F.nullif(a, b)),
    "now": (0, lambda clock: F.lit(clock.now).cast("long")),
    "total_changes": (0, _connection("total_changes")),
    "changes": (0, _connection("changes")),
    "last_insert_rowid": (0, _connection("last_insert_rowid")),
}


def call(name: str, args: list[Column], clock: Clock) -> Column:
    """The expression of a function; unknown names and wrong numbers of arguments are errors."""
    if name not in FUNCTIONS:
        raise WeftError("UnknownFunction", name)
    arity, make = FUNCTIONS[name]
    if arity != len(args):
        raise WeftError("WrongNumberOfArguments", f"{name} takes {arity}, not {len(args)}")
    return make(clock, *args)
