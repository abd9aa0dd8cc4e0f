"""Who a record is about: the named identity rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """All leading and trailing white space gone, not only blanks."""
    c = F.col(c) if isinstance(c, str) else c
    # trimming by a set of characters is dear; few values need it
    return F.when(c.rlike(f"^[{WHITE_SPACE}]|[{WHITE_SPACE}]$"), F.trim(c, F.lit(WHITE_SPACE))).otherwise(c)


def entity_key(c: Column | str) -> Column:
    """Stripped, lower case; null where nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def _or_blank(c: str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def identity(rule: str = "canonical", icao24: str = "icao24", flight: str = "flight", reg: str = "reg") -> Column:
    """The identity of a record under one of the rules.

    canonical  first of the three that isn't blank once stripped, lower case, else 'unknown'
    bronze     first that is neither null nor '', lower case, not stripped, else 'unknown'
    silver     first that isn't null, blanks at the ends removed, lower case ('' stays ''), else 'unknown'
    stream     icao24 alone: blanks removed, lower case, '' for null; such rows are to be dropped
    producer   icao24 alone: stripped, lower case, null where empty
    """
    i, f, r = (F.col(x) for x in (icao24, flight, reg))
    unknown = F.lit("unknown")
    if rule == "canonical":
        return F.lower(F.coalesce(_or_blank(icao24), _or_blank(flight), _or_blank(reg), unknown))
    if rule == "bronze":
        full = [F.when(c.isNotNull() & (c != ""), F.lower(c)) for c in (i, f, r)]
        return F.coalesce(*full, unknown)
    if rule == "silver":
        return F.lower(F.coalesce(F.trim(i), F.trim(f), F.trim(r), unknown))
    if rule == "stream":
        return F.lower(F.coalesce(F.trim(i), F.lit("")))
    if rule == "producer":
        return entity_key(icao24)
    raise ValueError(f"no identity rule {rule!r}")
