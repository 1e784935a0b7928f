"""Date and number columns: edition dates, Spanish date text, thousands, paths
(F16, F17, F18, F19, F25, F26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.hosts import applied, bound

# ---------------------------------------------------------------------------
# Fixed values.
# Civil zone of the edition date.
EDITION_ZONE = "Europe/Madrid"
# Spanish month names, January first.
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio",
             "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
# Spanish weekday names, Sunday first (the order of Spark's dayofweek 1..7).
WEEKDAYS_ES = ["domingo", "lunes", "martes", "miércoles", "jueves", "viernes", "sábado"]
# No-repeat window for repositories, in days.
REPO_LOOKBACK_DAYS = 7
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edition_date_local(ts) -> Column:
    """F16: civil date in Europe/Madrid of a UTC instant (session zone is UTC)."""
    return F.to_date(F.from_utc_timestamp(_c(ts), EDITION_ZONE))


def previous_edition_dates(d, days: int = REPO_LOOKBACK_DAYS) -> Column:
    """the ``days`` dates before ``d``, newest first (d-1 .. d-days)."""
    d = _c(d)
    return F.sequence(F.date_sub(d, 1), F.date_sub(d, days), F.expr("INTERVAL -1 DAY"))


def capitalize(s: Column) -> Column:
    """Upper-case the first character only (no lower-casing of the rest)."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def _month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS_ES]), month.cast("int"))


def _ymd(s) -> tuple[Column, Column, Column]:
    parts = F.split(_c(s), "-")
    return (F.element_at(parts, 1).cast("int"), F.element_at(parts, 2).cast("int"),
            F.element_at(parts, 3).cast("int"))


def long_date_es(s) -> Column:
    """F18 long form of a ``YYYY-MM-DD`` string: ``Sábado, 18 de julio de 2026``."""
    y, m, d = _ymd(s)
    weekday = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS_ES]), F.dayofweek(F.make_date(y, m, d)))
    return F.concat(capitalize(weekday), F.lit(", "), d.cast("string"), F.lit(" de "), _month_name(m),
                    F.lit(" de "), y.cast("string"))


def short_date_es(s) -> Column:
    """F18 short form: ``18 jul`` (day not padded)."""
    _, m, d = _ymd(s)
    return F.concat(d.cast("string"), F.lit(" "), F.substring(_month_name(m), 1, 3))


def month_name_es(key) -> Column:
    """F18 month heading of a ``YYYY-MM`` key: ``Julio de 2026``."""
    parts = F.split(_c(key), "-")
    y = F.element_at(parts, 1).cast("int")
    m = F.element_at(parts, 2).cast("int")
    return F.concat(capitalize(_month_name(m)), F.lit(" de "), y.cast("string"))


def thousands_es(n) -> Column:
    """integer with '.' as thousands separator, grouping always (9312 -> 9.312)."""
    return F.replace(F.format_number(_c(n).cast("bigint"), 0), F.lit(","), F.lit("."))


def edition_path(date_str, prefix: str = "") -> Column:
    """``/y/m/d/`` (or ``/repositorios/y/m/d/`` with a prefix)."""
    parts = F.split(_c(date_str), "-")
    return F.concat(F.lit(prefix + "/"), F.element_at(parts, 1), F.lit("/"), F.element_at(parts, 2),
                    F.lit("/"), F.element_at(parts, 3), F.lit("/"))


def _rfc_format(y4: bool, sec: bool, num: bool) -> str:
    return "d MMM " + ("yyyy" if y4 else "yy") + " HH:mm" + (":ss" if sec else "") + (" Z" if num else " z")


def _parse_shapes(body: Column, text: Column) -> Column:
    """One parse per row. The shape tests form a decision tree (year digits,
    then seconds, then zone kind), so each regex test runs at most once even
    though the expression is evaluated outside generated code."""
    # other zone names have fixed offsets here, but follow the season in Java's parser
    rfc = body.rlike(r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{2,4} [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( GMT| UTC| [+-][0-9]{4})$")
    year4 = body.rlike(r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} ")
    secs = body.rlike(r" [0-9]{1,2}:[0-9]{2}:[0-9]{2}( |$)")
    offset = body.rlike(r"[+-][0-9]{4}$")

    def by_zone(y4: bool, sec: bool) -> Column:
        return F.when(offset, F.try_to_timestamp(body, F.lit(_rfc_format(y4, sec, True)))) \
            .otherwise(F.try_to_timestamp(body, F.lit(_rfc_format(y4, sec, False))))

    def by_secs(y4: bool) -> Column:
        return F.when(secs, by_zone(y4, True)).otherwise(by_zone(y4, False))

    iso = text.rlike(r"^[+-]?[0-9]{4,6}-[0-9]{2}-[0-9]{2}")
    known = F.when(rfc, F.when(year4, by_secs(True)).otherwise(by_secs(False))).when(iso, F.try_to_timestamp(text))
    return F.coalesce(known, F.when(~iso, lenient_date(text)))


# ---------------------------------------------------------------------------
# Month names by their first three letters, and zone names with
# their minutes from UTC.
MONTH_KEYS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONE_MINUTES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
                "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
# A date without a year is read as being of this one.
NO_YEAR = 2001
# ---------------------------------------------------------------------------
_TIME = r"([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2})(?:[.][0-9]+)?)? *([ap]m)?(?![a-z0-9:])"
_OFFSET = r" *(?:(?:utc|gmt|ut|z) *)?([+-])([0-9]{1,2})(?::?([0-9]{2}))?(?![0-9])"




def _lenient_sql(t: str) -> str:
    """``lenient_date`` of a lower-case text as SQL text (see ``hosts`` for the reason)."""
    months = "array(" + ", ".join(f"'{m}'" for m in MONTH_KEYS) + ")"
    zones = "map(" + ", ".join(f"'{z}', {m}" for z, m in ZONE_MINUTES.items()) + ")"
    month_of = f"array_position({months}, substring(w, 1, 3))"

    def split_up(clock: str) -> str:
        offset = f"regexp_extract({t}, r'{_TIME}{_OFFSET}', 0)"
        return bound(f"CASE WHEN {clock} = '' THEN '' ELSE {offset} END", lambda o: bound(
            f"CASE WHEN {clock} = '' THEN {t} ELSE replace({t}, CASE WHEN {o} <> '' THEN {o} ELSE {clock} END, ' ') END", lambda r: tokens(clock, o, r)))

    def tokens(clock: str, offset: str, rest: str) -> str:
        hms = ", ".join(f"coalesce(try_cast(regexp_extract({clock}, r'{_TIME}', {n}) AS int), 0) AS {c}" for n, c in ((1, "hour"), (2, "minute"), (3, "second")))
        sign, hours, more = (f"regexp_extract({offset}, r'{_TIME}{_OFFSET}', {n})" for n in (5, 6, 7))
        minutes = f"CASE WHEN {sign} = '-' THEN -1 ELSE 1 END * (coalesce(try_cast({hours} AS int), 0) * 60 + coalesce(try_cast({more} AS int), 0))"
        words = f"regexp_extract_all({rest}, '[a-z]+', 0)"
        # a word other than a month or zone after the first number is no date
        late = f"regexp_extract_all(regexp_extract({rest}, '[0-9](.*)', 1), '[a-z]+', 0)"
        return bound(f"struct({hms}, regexp_extract({clock}, r'{_TIME}', 4) AS half, CASE WHEN {offset} <> '' THEN {minutes} END AS away, "
                     f"filter(transform({words}, w -> {month_of}), m -> m > 0) AS named, "
                     f"try_element_at(filter(transform({words}, w -> try_element_at({zones}, w)), z -> z IS NOT NULL), 1) AS zone, "
                     f"transform(regexp_extract_all({rest}, '[0-9]+', 0), n -> try_cast(n AS int)) AS numbers, "
                     f"rlike({rest}, '^[a-z0-9 ,./:-]*$') AND forall({late}, w -> {month_of} > 0 OR map_contains_key({zones}, w)) AS clean)", placed)

    def placed(p: str) -> str:
        a, b, c = (f"try_element_at({p}.numbers, {k})" for k in (1, 2, 3))
        n, by_name, first_day = f"size({p}.numbers)", f"size({p}.named) > 0", f"{a} BETWEEN 1 AND 31"
        year = f"CASE WHEN {n} = 1 OR ({n} = 2 AND NOT ({by_name})) THEN {NO_YEAR} WHEN {first_day} THEN CASE WHEN {by_name} THEN {b} ELSE {c} END ELSE {a} END"
        month = f"CASE WHEN {by_name} THEN int({p}.named[0]) WHEN {n} = 3 AND NOT ({first_day}) THEN {b} ELSE {a} END"
        day = f"CASE WHEN {by_name} THEN CASE WHEN {n} = 1 OR {first_day} THEN {a} ELSE {b} END WHEN {n} = 3 AND NOT ({first_day}) THEN {c} ELSE {b} END"
        numbers = f"CASE WHEN {by_name} THEN {n} BETWEEN 1 AND 2 ELSE {n} BETWEEN 2 AND 3 END"
        clock = (f"({p}.hour < 24 OR ({p}.hour = 24 AND {p}.minute + {p}.second = 0)) AND {p}.minute < 60 AND {p}.second < 60 "
                 f"AND ({p}.half = '' OR {p}.hour BETWEEN 1 AND 12)")
        hour = f"CASE WHEN {p}.half = '' THEN {p}.hour ELSE {p}.hour % 12 + CASE WHEN {p}.half = 'pm' THEN 12 ELSE 0 END END"
        return bound(f"struct({year} AS y, {month} AS m, {day} AS d, {hour} AS hour, {p}.clean AND {numbers} AND size({p}.named) <= 1 AND {clock} AS sound)",
                     lambda d: instant(p, d))

    def instant(p: str, d: str) -> str:
        year = f"CASE WHEN {d}.y BETWEEN 0 AND 49 THEN {d}.y + 2000 WHEN {d}.y BETWEEN 50 AND 99 THEN {d}.y + 1900 ELSE {d}.y END"
        # a day that the month lacks runs on into the next month
        start = f"unix_date(make_date({year}, {d}.m, 1)) + {d}.d - 1"
        away = f"coalesce({p}.away, {p}.zone, 0)"
        return (f"CASE WHEN {d}.sound AND {d}.m BETWEEN 1 AND 12 AND {d}.d BETWEEN 1 AND 31 AND {d}.y BETWEEN 0 AND 9999 "
                f"THEN timestamp_seconds(bigint({start}) * 86400 + {d}.hour * 3600 + ({p}.minute - {away}) * 60 + {p}.second) END")

    return bound(f"regexp_extract({t}, r'{_TIME}', 0)", split_up)


def lenient_date(s) -> Column:
    """F26, free forms: a month name (its first three letters count) or numbers by
    slashes, day, year, and maybe a clock with ``am``/``pm``, a zone name or an offset, in
    any usual order; comments in parentheses go. Without a zone it is UTC.
    Two-digit years are 1950 to 2049. Null if it is no date."""
    low = F.lower(F.regexp_replace(F.trim(_c(s)), r"\([^()]*\)", " "))
    return F.when(_c(s).rlike("[0-9]"), applied(_lenient_sql, low))


def parse_feed_date(s) -> Column:
    """lenient feed date (ISO 8601 or RFC 822, weekday ignored even if wrong).

    The leading weekday is removed; RFC 822 text is parsed with the one
    pattern its shape calls for (2- or 4-digit year, with or without seconds,
    zone name or numeric offset), ISO text by the cast. Other shapes, and RFC
    text whose zone the pattern does not know, are read by ``lenient_date``. The cleaned text is
    bound once as a lambda variable, so the shape tests do not repeat it.
    """
    t = F.trim(_c(s))
    pair = F.struct(F.regexp_replace(t, r"^[A-Za-z]+,\s*", "").alias("b"), t.alias("t"))
    return F.element_at(F.transform(F.array(pair), lambda r: _parse_shapes(r["b"], r["t"])), 1)
