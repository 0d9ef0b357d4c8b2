"""Reading times written in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_DAY = r"^\d{4}-\d{1,2}-\d{1,2}"
_TIME = r"[T ]\d{1,2}:\d{2}"
_FULL = _TIME + r":\d{2}(\.\d+)?"
_ZONE = r"(Z|UTC|GMT|[+-]\d{2}:?\d{2})$"
_CLOCK = r"(?:,?[T\s]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?\s*(?i:(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?$"
_NAMED_DMY = r"^(\d{1,2})(?:st|nd|rd|th)?[-/. ]+([A-Za-z]{3,9})\.?,?[-/. ]+(\d{4})" + _CLOCK
_NAMED_MDY = r"^([A-Za-z]{3,9})\.?[-/. ]+(\d{1,2})(?:st|nd|rd|th)?,?[-/. ]+(\d{4})" + _CLOCK
_NAMED_YMD = r"^(\d{4})[-/. ]+([A-Za-z]{3,9})\.?[-/. ]+(\d{1,2})" + _CLOCK
_PLAIN = r"^(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})" + _CLOCK


def parsed(c: Column) -> Column:
    """TIMESTAMP (an instant) of a date string, null where it is none.

    Year first with -, / or . or as eight digits, or with an English month name; optional time and zone;
    blanks around are dropped. A zone offset is applied, no zone means UTC, a bare day means 00:00.
    A month without a day and a day that no calendar has give null. Independent of the session's zone.
    """
    s = F.btrim(c, F.lit(" \t\r\n\xa0"))
    u = F.translate(s, "/", "-")
    # most are told by their length and two dashes; the cast itself rejects what is no date
    at = lambda i, n=1: F.substring(u, i, n)
    size = F.length(u)
    rest = F.when(size == 10, "T00:00:00Z").when(size == 16, ":00Z").when(size == 19, "Z").when((size == 20) & u.endswith("Z"), "").when((size == 25) & at(20).isin("+", "-"), "")
    plain = F.when((at(5) == "-") & (at(8) == "-") & at(1).between("0", "9"), F.concat(u, rest)).when((size == 8) & at(1).between("0", "9"), F.concat(at(1, 4), F.lit("-"), at(5, 2), F.lit("-"), at(7, 2), F.lit("T00:00:00Z")))
    # the long way stands in a function of its own: in one method with the short way the JVM would compile neither
    return F.coalesce(plain.try_cast("timestamp"), F.get(F.transform(F.array(s), _any_notation), F.lit(0)))


def _any_notation(s: Column) -> Column:
    """The same by patterns, of a string without blanks around."""
    u = F.translate(s, "/", "-")

    def named(pattern: str, y: int, m: int, d: int) -> Column:
        x = lambda k: F.regexp_extract(s, pattern, k)
        place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(x(m), 1, 3)))
        return F.concat(x(y), F.lit("-"), place.cast("string"), F.lit("-"), x(d), _clock(x(4), x(5)))

    def _clock(time: Column, zone: Column) -> Column:
        return F.concat(F.lit("T"), F.when(time == "", "00:00:00").when(time.rlike(r"^\d{1,2}:\d{2}$"), F.concat(time, F.lit(":00"))).otherwise(time), F.when(zone == "", "Z").otherwise(F.upper(zone)))

    p = lambda k: F.regexp_extract(s, _PLAIN, k)
    text = (
        F.when(u.rlike(_DAY + "$"), F.concat(u, F.lit("T00:00:00Z")))
        .when(u.rlike(r"^\d{8}$"), F.concat(F.substring(u, 1, 4), F.lit("-"), F.substring(u, 5, 2), F.lit("-"), F.substring(u, 7, 2), F.lit("T00:00:00Z")))
        .when(u.rlike(_DAY + _TIME + "$"), F.concat(u, F.lit(":00Z")))
        .when(u.rlike(_DAY + _FULL + "$"), F.concat(u, F.lit("Z")))
        .when(u.rlike(_DAY + _FULL + _ZONE), u)
        .when(s.rlike(_PLAIN) & ~s.rlike(r"^\d{5,7}(\D|$)"), F.concat(p(1), F.lit("-"), p(3), F.lit("-"), p(4), _clock(p(5), p(6))))
        .when(s.rlike(_NAMED_DMY), named(_NAMED_DMY, 3, 2, 1))
        .when(s.rlike(_NAMED_MDY), named(_NAMED_MDY, 3, 1, 2))
        .when(s.rlike(_NAMED_YMD), named(_NAMED_YMD, 1, 2, 3))
    )
    return text.try_cast("timestamp")
