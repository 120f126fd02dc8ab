"""Column expressions that the operators share. Undefined rates are null, never NaN."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "__missing__"
PSI_FLOOR = 1e-6
_STRIP = r"(?U)^\s+|\s+$"


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def is_blank(df: DataFrame, name: str) -> Column:
    """Null, or a string of white space only."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return c.isNull() | (F.regexp_replace(c, _STRIP, "") == "")
    return c.isNull()


def or_missing(df: DataFrame, name: str) -> Column:
    return F.when(is_blank(df, name), F.lit(MISSING)).otherwise(F.col(name).cast("string"))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def count_when(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def safe_ratio(n: Column, d: Column) -> Column:
    """Null where the denominator isn't positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double"))


def relative(change: Column, base: Column) -> Column:
    """Null where the base is zero; negative bases count."""
    return F.when(base != 0, change / base)


def money(c: Column) -> Column:
    """Cents as a decimal, so that a sum doesn't depend on the order of its rows."""
    return c.cast("decimal(18,2)")


def outside(df: DataFrame, name: str, domain: Sequence[str]) -> Column:
    """Not blank and not in the domain."""
    return ~is_blank(df, name) & ~F.col(name).isin(list(domain))


def floored_z(value: Column, mean: Column, std: Column, floor: float, fail_z: float) -> Column:
    """Distance from the mean in standard deviations of at least floor / fail_z; 0 if both are 0."""
    width = F.greatest(std, F.lit(float(floor) / fail_z))
    return F.when(value.isNull() | mean.isNull(), None).when(width <= 0, F.lit(0.0)).otherwise((value - mean) / width)


def psi_term(now: Column, before: Column) -> Column:
    p, q = F.greatest(now, F.lit(PSI_FLOOR)), F.greatest(before, F.lit(PSI_FLOOR))
    return (p - q) * F.ln(p / q)


def band(value: Column, warn: float, fail: float) -> Column:
    """pass, warn or fail; a value that can't be judged passes."""
    return F.when(value >= fail, "fail").when(value >= warn, "warn").otherwise("pass")


def severity(status: Column, fail: str = "high", warn: str = "medium") -> Column:
    return F.when(status == "fail", fail).when(status == "warn", warn).otherwise("none")


def sign_rules() -> dict[str, Column]:
    """Violations of the rules for amounts. A missing amount breaks the rules of purchases and fees."""
    amount = F.expr("try_cast(transaction_amount AS double)")
    holds = lambda c: F.coalesce(c, F.lit(False))
    kind = F.col("transaction_type")
    return {
        "purchase_not_positive": holds(kind == "purchase") & ~holds(amount > 0),
        "fee_not_positive": holds(kind == "fee") & ~holds(amount > 0),
        "paid_payment_not_negative": holds((kind == "payment") & (F.col("payment_failed") == 0)) & ~holds(amount < 0),
        "failed_payment_not_zero": holds((kind == "payment") & (F.col("payment_failed") == 1)) & ~holds(amount == 0),
    }


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda would compute it anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(words: Column, *sizes: int) -> Column:
    """Runs of words joined by spaces, size by size; none of a size where there are fewer words."""

    def runs(w: Column, n: int) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))  # slice() copies all words each time

    return let(words, lambda w: F.concat(*[runs(w, n) for n in sizes]))


def md5_bucket(term: Column, dims: int) -> Column:
    """60 bits of md5, modulo dims; where dims divides a power of 16, only the last digits matter."""
    digits = next((m for m in range(1, 15) if 16**m % dims == 0), 15)
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 16 - digits, digits), 16, 10).cast("long"), F.lit(dims)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


PERIOD = r"\b\d{4}-\d{2}(?:-\d{2})?\b"
NUMBER = r"[-+]?\$?\d[\d,]*(?:\.\d+)?%?"


def number_tokens(text: Column) -> Column:
    """Numbers of a text; the digits of period labels aren't numbers."""
    return F.regexp_extract_all(F.regexp_replace(text, PERIOD, " "), F.lit(NUMBER), F.lit(0))


def token_value(token: Column) -> Column:
    return F.regexp_replace(token, "[,$%]", "").try_cast("double")


def mentions_month(columns: Sequence[str], months: Sequence[str]) -> Column:
    """Does any column hold a month, with or without its dash?"""
    text = F.concat_ws(" ", *columns)
    return any_of([text.contains(m) | text.contains(m.replace("-", "")) for m in months])


def lineage(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
