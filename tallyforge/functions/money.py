"""Money and date normalisers as JVM-side column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from tallyforge.settings import GST_RATE, MDR_RATE, ONE_STEP_FEE_RATE

# Currency marks removed before parsing, accepted date layouts,
# and the size from which a whole number counts as paise already.
CURRENCY_MARKS = ["Rs.", "Rs", "₹", "INR", ","]
DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]
ALREADY_PAISE_ABOVE = 100_000
WHITESPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def half_even(c: Column) -> Column:
    """Round a double to the nearest whole number, ties to even."""
    return F.rint(c).cast("long")


def amount_to_paise(c: Column, unit: str = "guess") -> Column:
    """N1. Text amount to paise, NULL when it cannot be read.

    ``unit`` says what a number without decimals is: 'rupees', 'paise', or
    'guess' (above 100000 it is taken to be paise already).
    """
    s = strip(c)
    for mark in CURRENCY_MARKS:
        s = F.replace(s, F.lit(mark), F.lit(""))
    s = strip(s)
    decimal = s.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$")
    whole = s.rlike(r"^[+-]?\d+$")
    number = s.try_cast("long")
    as_whole = {
        "rupees": number * 100,
        "paise": number,
        "guess": F.when(F.abs(number) > ALREADY_PAISE_ABOVE, number).otherwise(number * 100),
    }[unit]
    return F.when(decimal, half_even(s.try_cast("double") * 100)).when(whole, as_whole)


def parse_date(c: Column) -> Column:
    """N2. First layout that reads the text as a real calendar day; else NULL."""
    s = strip(c)
    return F.coalesce(
        *[F.when(s.rlike(shape), F.try_to_date(s, layout)) for shape, layout in DATE_LAYOUTS]
    )


def blank_to_null(c: Column) -> Column:
    """N3."""
    return F.nullif(strip(c), F.lit(""))


def tax_to_paise(c: Column) -> Column:
    """N4. Blank tax is zero; unreadable text stays NULL so that it can be rejected."""
    return F.when(blank_to_null(c).isNull(), F.lit(0).cast("long")).otherwise(amount_to_paise(c))


def mdr_fee(gross: Column) -> Column:
    """N10. Contract fee of 2 %."""
    return half_even(gross * F.lit(MDR_RATE))


def gst_on_fee(gross: Column) -> Column:
    return half_even(mdr_fee(gross) * F.lit(GST_RATE))


def two_step_net(gross: Column) -> Column:
    """N8. Gross less the rounded fee less the rounded tax on that fee."""
    return gross - mdr_fee(gross) - gst_on_fee(gross)


def one_step_fee(gross: Column) -> Column:
    return half_even(gross * F.lit(ONE_STEP_FEE_RATE))


def one_step_net(gross: Column) -> Column:
    """N9. Gross less one rounded 2.36 % fee; differs from N8 by at most one paisa."""
    return gross - one_step_fee(gross)


def fee_adjusted(amount: Column, percent: Column | float) -> Column:
    """N11."""
    pct = percent if isinstance(percent, Column) else F.lit(float(percent))
    return amount - half_even(amount * (pct / F.lit(100.0)))


def fx_convert(amount: Column, rate: Column | float) -> Column:
    """N12."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return half_even(amount * r)


def difference(a: Column, b: Column) -> Column:
    """N13."""
    return F.abs(a - b)


def inr(paise: Column) -> Column:
    return paise / F.lit(100.0)


def inr_text(paise: Column) -> Column:
    """Paise as text with two decimals, by exact decimal arithmetic."""
    return (paise.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(22,2)").cast("string")
