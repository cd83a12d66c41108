"""Numbers and dates as a reader wants them; what is not known is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import col

UNKNOWN = "-"


def fixed(x, digits: int) -> Column:
    """A number with so many decimals, its own binary value rounded and an exact tie to the even side, as C prints it.

    ``format_string`` rounds the shortest decimal text instead: 4054.535 lies under the half and would go up.
    """
    c = col(x)
    return F.call_function("format_number", c, F.lit("0" + "." * (digits > 0) + "0" * digits))


def _known(x, shown: Column) -> Column:
    return F.when(col(x).isNull(), UNKNOWN).otherwise(shown)


def change(x, digits: int = 1) -> Column:
    """A return, with its sign."""
    c = col(x)
    return _known(x, F.concat(F.when(c >= 0, "+").otherwise(""), fixed(c * 100, digits), F.lit("%")))


def share(x, digits: int = 1) -> Column:
    """A proportion, without one."""
    return _known(x, F.concat(fixed(col(x) * 100, digits), F.lit("%")))


def crore(x) -> Column:
    """An amount in crore, from a thousand on in thousands and from a lakh on in lakhs of them."""
    c = col(x)
    return _known(x, F.when(F.abs(c) >= 100_000, F.concat(fixed(c / 100_000, 2), F.lit("L Cr"))).when(F.abs(c) >= 1000, F.concat(fixed(c / 1000, 1), F.lit("K Cr"))).otherwise(F.concat(fixed(c, 0), F.lit(" Cr"))))


def month(x) -> Column:
    return _known(x, F.date_format(col(x), "MMM yy"))
