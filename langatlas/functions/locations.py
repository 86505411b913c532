"""Column predicates over free-text owner locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: location texts that name no
# place, as listed there.
INVALID_LOCATIONS = ("undefined", "null", "0", "1", "Earth",
                     "the internet", "the interweb", "worldwide")
# Compared lower-case to lower-case (the reference mixes cases, so 'Earth' and
# 'Worldwide' slipped through one check or the other).
_INVALID_LOWER = tuple(v.lower() for v in INVALID_LOCATIONS)

# Legacy text markers of a missing location, read back as NULL.
NULL_MARKERS = ("null", "undefined")

# Fixed defaults from the reference.
MAX_DENSITY_LOCATION_LEN = 48
GEOCODE_MIN_LEN = 3
GEOCODE_MAX_LEN = 10


def normalize_location(c: Column | str) -> Column:
    """Legacy ``'null'``/``'undefined'`` texts become SQL NULL; others unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*NULL_MARKERS), F.lit(None).cast("string")).otherwise(c)


def is_place_name(c: Column | str) -> Column:
    """Not one of the known non-place texts (case-insensitive)."""
    c = F.col(c) if isinstance(c, str) else c
    return ~F.lower(c).isin(*_INVALID_LOWER)


def is_density_location(c: Column | str, max_len: int = MAX_DENSITY_LOCATION_LEN) -> Column:
    """Location kept in a language's density list (C6, location part).

    A missing location is not a place (the reference keyed it as the text
    ``"null"``, which is on the invalid list).
    """
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & is_place_name(c) & (F.length(c) <= max_len)


def is_geocodable(c: Column | str, min_len: int = GEOCODE_MIN_LEN,
                  max_len: int = GEOCODE_MAX_LEN) -> Column:
    """Location worth sending to the geocoder (C7, documented intent).

    Rejects empty/missing, too short or too long, non-place names, handles
    containing ``@`` and anything mentioning "where" (e.g. "nowhere").
    """
    c = F.col(c) if isinstance(c, str) else c
    return (c.isNotNull() & (c != "")
            & (F.length(c) >= min_len) & (F.length(c) <= max_len)
            & is_place_name(c)
            & ~c.contains("@")
            & ~F.lower(c).contains("where"))
