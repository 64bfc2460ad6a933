"""Column helpers with the semantics the operators need: Unicode-aware regexes, doubles, whole-text strip, softmax."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f\x85\xa0]"


def re_(pattern: str) -> str:
    """Case-insensitive, Unicode letters and classes, only a line feed ends a line."""
    return "(?iuUd)" + pattern


def has(column, pattern: str) -> Column:
    """Whether the pattern occurs; null text has none."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).rlike(re_(pattern))


def free(columns, *names: str) -> list[str]:
    """Names for columns of our own that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dbl(x: float) -> Column:
    """A double literal; bare SQL decimals give other results at thresholds."""
    return F.lit(float(x))


# What (?U)\s matches: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode's white space at both ends.  Only the ends are looked at, where a pattern goes through all of the text."""
    return F.btrim(c, F.lit(WHITE))


def is_upper(c: Column) -> Column:
    """Has a cased letter and no lower-case one."""
    return (F.upper(c) == c) & (F.lower(c) != c)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, dbl(0)), dbl(1))


def log_softmax(a: Column) -> Column:
    """Of an array; ln(sum(exp(x - max))) is taken once."""

    def of(a):
        rest = lambda top: F.struct(top.alias("top"), F.ln(F.aggregate(a, dbl(0), lambda s, x: s + F.exp(x - top))).alias("rest"))
        return once(once(F.array_max(a), rest), lambda r: F.transform(a, lambda x: x - r["top"] - r["rest"]))

    return once(a, of)


def softmax(a: Column) -> Column:
    return F.transform(log_softmax(a), F.exp)


def arg_max(a: Column) -> Column:
    """Position from 0 of the first largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays in double; 0 where one is a zero vector."""
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), dbl(0), add)
    norm = lambda v: F.sqrt(F.aggregate(v, dbl(0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(dbl(0))


def entropy(counts: list[Column]) -> Column:
    """Of counts, over the logarithm of how many aren't zero; 0 for up to one class."""
    total = sum(counts, F.lit(0)).cast("double")
    part = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(dbl(0))
    classes = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    bits = sum((part(c) for c in counts), dbl(0))
    return F.when(classes > 1, bits / F.log2(classes.cast("double"))).otherwise(dbl(0))


def rate(condition: Column) -> Column:
    """Share of rows for which the condition holds (null: it doesn't)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def correlation(x: str, y: str) -> Column:
    """Pearson's; null where one side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)
