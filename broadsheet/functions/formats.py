"""String formats of the digest schema as columns (V2, V4): ``uri`` by RFC 3986,
``date`` and ``date-time`` by RFC 3339, native expressions only.

The patterns are put together from the grammar's rules. Java's regex engine backs
up by recursion, so repeats are possessive there (``java=True``); each next
character can only belong to one rule, which makes that the same language. RE2
(DuckDB) has no possessive repeats and needs none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Character classes of RFC 3986.
UNRESERVED = r"A-Za-z0-9._~\-"
SUB_DELIMS = "!$&'()*+,;="
ESCAPE = "%[0-9A-Fa-f]{2}"
SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# ---------------------------------------------------------------------------


def _ipv6() -> str:
    """``::`` may stand once for one group or more of zeros; the last two groups may
    be an IPv4 address."""
    h = "[0-9A-Fa-f]{1,4}"
    v4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
    end = f"(?:{h}:{h}|{v4})"
    forms = [f"(?:{h}:){{6}}{end}"]
    for after in range(5, -1, -1):  # groups between "::" and the last two
        before = 5 - after
        head = f"(?:(?:{h}:){{0,{before - 1}}}{h})?" if before else ""
        forms.append(f"{head}::(?:{h}:){{{after}}}{end}")
    forms += [f"(?:(?:{h}:){{0,5}}{h})?::{h}", f"(?:(?:{h}:){{0,6}}{h})?::"]
    return "(?:" + "|".join(forms) + ")"


def uri_pattern(java: bool = True) -> str:
    """RFC 3986 ``URI`` as one anchored pattern."""
    more = "+" if java else ""

    def run(extra: str, least: str = "*") -> str:
        return f"(?:[{UNRESERVED}{SUB_DELIMS}{extra}]+{more}|{ESCAPE}){least}{more}"

    segment = run(":@")
    # User info and host share characters: which it was shows at the "@" only.
    user = f"(?:(?:[{UNRESERVED}{SUB_DELIMS}:]|{ESCAPE})*@)?" if not java else f"(?:(?:[{UNRESERVED}{SUB_DELIMS}:]++|{ESCAPE})*+@)?"
    host = rf"(?:\[(?:{_ipv6()}|[vV][0-9A-Fa-f]+\.[{UNRESERVED}{SUB_DELIMS}:]+)\]|{run('')})"
    tail = f"(?:/{segment})*{more}"
    hier = f"(?://{user}{host}(?::[0-9]*)?{tail}|/(?:{run(':@', '+')}{tail})?|{run(':@', '+')}{tail}|)"
    rest = run(":@/?")
    return rf"^{SCHEME}:{hier}(?:\?{rest})?(?:#{rest})?" + (r"\z" if java else "$")


def is_uri(s: Column) -> Column:
    """Is it a URI (with a scheme, characters and escapes as RFC 3986 has them)?"""
    return F.coalesce(s.rlike(uri_pattern()), F.lit(False))


DATE_SHAPE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
TIME_SHAPE = (r"([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9]|60)(?:\.[0-9]+)?"
              r"(?:[zZ]|([+-])([01][0-9]|2[0-3]):([0-5][0-9]))")


def is_date(s: Column) -> Column:
    """RFC 3339 ``full-date``: a day that the calendar has."""
    return F.coalesce(s.rlike(rf"^{DATE_SHAPE}\z") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_date_time(s: Column) -> Column:
    """RFC 3339 ``date-time``: a day, ``T`` (or ``t`` or a blank), a time with its
    offset. Second 60 exists only where it is 23:59 in UTC."""
    shape = rf"^{DATE_SHAPE}[Tt ]{TIME_SHAPE}\z"

    def part(n: int) -> Column:
        return F.coalesce(F.regexp_extract(s, shape, n).try_cast("int"), F.lit(0))

    sign = F.when(F.regexp_extract(s, shape, 4) == "-", -1).otherwise(1)
    utc = F.pmod(part(1) * 60 + part(2) - sign * (part(5) * 60 + part(6)), F.lit(1440))
    return F.coalesce(s.rlike(shape), F.lit(False)) & is_date(F.substring(s, 1, 10)) & ((part(3) < 60) | (utc == 1439))
