"""Host names of http(s) URLs as the URL standard serialises them (F1): percent
escapes decoded, full-width and upper-case letters folded, non-ASCII labels in
Punycode, IPv4 numbers in dotted decimals, IPv6 addresses shortest. Native
expressions only: the encoders are folds over the code points of a label.

The expressions are large, and built from columns one call at a time they would take
longer than the job on small inputs. So they are put together as SQL text, parsed once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Punycode's parameters (RFC 3492), characters that may not stand
# in a host, dots of other scripts, characters that vanish.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128
FORBIDDEN = r"[\x00-\x20\x22#%/:<>?@\[\\\]^`{|}\x7F]"
DOTS = "。．｡"
IGNORED = "­​⁠﻿"
# ---------------------------------------------------------------------------
WIDE = "".join(chr(0xFF01 + k) for k in range(94))
NARROW = "".join(chr(0x21 + k) for k in range(94))
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_names = count()


def bound(value: str, use: Callable[[str], str]) -> str:
    """SQL of ``use(value)`` with ``value`` computed once."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {use(name)}), 1)"


def applied(sql: Callable[[str], str], value: Column) -> Column:
    """A column computed by SQL text from ``value``."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"x -> {sql('x')}")), 1)


def text(s: str) -> str:
    """A string as a SQL literal; backslashes stand for themselves."""
    return "r'" + s + "'"


def fold(items: str, start: str, step: Callable[[str, str], str]) -> str:
    n = next(_names)
    return f"aggregate({items}, {start}, (a{n}, i{n}) -> {step(f'a{n}', f'i{n}')})"


def _digits(delta: str, bias: str) -> str:
    """``delta`` as a variable-length integer: at most 13 digits hold a long."""
    def step(acc: str, k: str) -> str:
        def placed(t: str) -> str:
            rest = f"({acc}.q - {t})"
            return (f"CASE WHEN {acc}.q < {t} THEN struct(-1L AS q, concat({acc}.out, substring('{DIGITS}', int({acc}.q) + 1, 1)) AS out) "
                    f"ELSE struct({rest} div ({BASE} - {t}) AS q, concat({acc}.out, substring('{DIGITS}', int({t} + {rest} % ({BASE} - {t})) + 1, 1)) AS out) END")
        return f"CASE WHEN {acc}.q < 0 THEN {acc} ELSE {bound(f'greatest({T_MIN}L, least({T_MAX}L, {k} - {bias}))', placed)} END"

    return fold(f"sequence({BASE}L, {13 * BASE}L, {BASE}L)", f"struct({delta} AS q, '' AS out)", step) + ".out"


def _adapted(delta: str, points: str, first: str) -> str:
    start = bound(f"{delta} div CASE WHEN {first} THEN {DAMP}L ELSE 2L END", lambda h: f"struct({h} + {h} div {points} AS d, 0L AS k)")
    done = fold("sequence(1, 13)", start, lambda a, _: f"CASE WHEN {a}.d > {(BASE - T_MIN) * T_MAX // 2} THEN struct({a}.d div {BASE - T_MIN} AS d, {a}.k + {BASE} AS k) ELSE {a} END")
    return bound(done, lambda a: f"{a}.k + ({BASE - T_MIN + 1} * {a}.d) div ({a}.d + {SKEW})")


def _state(n: str, delta: str, bias: str, h: str, out: str) -> str:
    return f"struct({n} AS n, {delta} AS delta, {bias} AS bias, {h} AS h, {out} AS out)"


def punycode_sql(label: str) -> str:
    def encoded(p: str) -> str:
        basic = f"filter({p}, c -> c < {FIRST_N})"
        n_basic = f"bigint(size({basic}))"

        def one(acc: str, c: str) -> str:  # a character of the label, for the code point acc.n
            hit = _state(f"{acc}.n", "0L", _adapted(f"{acc}.delta", f"({acc}.h + 1)", f"{acc}.h = {n_basic}"), f"{acc}.h + 1",
                         f"concat({acc}.out, {_digits(f'{acc}.delta', f'{acc}.bias')})")
            more = _state(f"{acc}.n", f"{acc}.delta + 1", f"{acc}.bias", f"{acc}.h", f"{acc}.out")
            return f"CASE WHEN {c} = {acc}.n THEN {hit} WHEN {c} < {acc}.n THEN {more} ELSE {acc} END"

        def point(acc: str, m: str) -> str:  # the next larger code point of the label
            begun = _state(m, f"{acc}.delta + ({m} - {acc}.n) * ({acc}.h + 1)", f"{acc}.bias", f"{acc}.h", f"{acc}.out")
            return bound(fold(p, begun, one), lambda a: _state(f"{a}.n + 1", f"{a}.delta + 1", f"{a}.bias", f"{a}.h", f"{a}.out"))

        head = f"concat(array_join(transform({basic}, c -> chr(c)), ''), CASE WHEN {n_basic} > 0 THEN '-' ELSE '' END)"
        rare = f"array_sort(array_distinct(filter({p}, c -> c >= {FIRST_N})))"
        return fold(rare, _state(f"{FIRST_N}L", "0L", f"{FIRST_BIAS}L", n_basic, head), point) + ".out"

    return bound(f"transform(filter(split({label}, ''), c -> c <> ''), c -> bigint(ascii(c)))", encoded)


def ascii_domain_sql(host: str) -> str:
    """Labels in lower case, non-ASCII ones as ``xn--`` and Punycode."""
    low = f"lower(translate(translate({host}, '{IGNORED}', ''), {text(WIDE.replace(chr(0xFF07), '') + DOTS)}, {text(NARROW.replace(chr(39), '') + '.' * len(DOTS))}))"
    label = rf"CASE WHEN rlike(l, r'[^\x00-\x7F]') THEN concat('xn--', {punycode_sql('l')}) ELSE l END"
    return f"array_join(transform(split({low}, '[.]', -1), l -> {label}), '.')"


def _number(part: str) -> str:
    """A part of an IPv4 address: decimal, octal (leading 0) or hexadecimal (0x);
    null if it is none, and for more than 12 digits."""
    digits = f"regexp_replace({part}, '^(0x0*|0+(?=.))', '')"
    return (f"try_cast(CASE WHEN rlike({part}, '^0x[0-9a-f]*$') THEN CASE WHEN {digits} = '' THEN '0' WHEN length({digits}) <= 9 THEN conv({digits}, 16, 10) END "
            f"WHEN rlike({part}, '^0[0-7]+$') THEN CASE WHEN length({digits}) <= 12 THEN conv({digits}, 8, 10) END "
            f"WHEN rlike({part}, '^(0|[1-9][0-9]*)$') THEN CASE WHEN length({part}) <= 10 THEN {part} END END AS bigint)")


def ipv4_sql(host: str) -> str:
    powers = "array(" + ", ".join(f"{256 ** k}L" for k in range(1, 5)) + ")"

    def made(numbers: str) -> str:
        n = f"size({numbers})"
        front = f"slice({numbers}, 1, {n} - 1)"
        last = f"element_at({numbers}, -1)"
        sound = (f"{n} BETWEEN 1 AND 4 AND forall({numbers}, q -> q IS NOT NULL) AND forall({front}, q -> q <= 255) "
                 f"AND {last} < element_at({powers}, 5 - {n})")
        whole = fold(f"transform({front}, (q, j) -> q * element_at({powers}, 3 - j))", "0L", lambda a, q: f"{a} + {q}") + f" + {last}"
        dotted = bound(whole, lambda w: "concat_ws('.', " + ", ".join(f"string(shiftright({w}, {24 - 8 * k}) & 255)" for k in range(4)) + ")")
        return f"CASE WHEN {sound} THEN {dotted} END"

    return bound(f"transform(split(regexp_replace({host}, '[.]$', ''), '[.]', -1), o -> {_number('o')})", made)


def ipv6_sql(inside: str) -> str:
    group = "[0-9a-f]{1,4}"
    groups_of = "filter(split(substring_index({h}, '::', {k}), ':'), g -> g <> '')"

    def made(low: str) -> str:
        def hexed(tail: str) -> str:
            def pairs(octets: str) -> str:
                pair = [f"lower(hex(try_element_at({octets}, {k}) * 256 + try_element_at({octets}, {k + 1})))" for k in (1, 3)]
                good = f"size({octets}) = 4 AND forall({octets}, q -> q IS NOT NULL AND q <= 255)"
                return (f"CASE WHEN {tail} = '' THEN {low} WHEN {good} THEN concat(substring({low}, 1, length({low}) - length({tail})), "
                        f"{pair[0]}, ':', {pair[1]}) END")
            return bound(f"transform(split({tail}, '[.]'), q -> CASE WHEN rlike(q, '^(0|[1-9][0-9]{{0,2}})$') THEN int(q) END)", pairs)

        def filled(h: str) -> str:
            both = f"struct({groups_of.format(h=h, k=1)} AS l, CASE WHEN contains({h}, '::') THEN {groups_of.format(h=h, k=-1)} ELSE array() END AS r)"
            shape = f"rlike({h}, '^(?:{group}(?::{group})*)?(?:::(?:{group}(?::{group})*)?)?$') AND length({h}) > 1"

            def spread(b: str) -> str:
                gap = f"(8 - size({b}.l) - size({b}.r))"
                whole = f"CASE WHEN contains({h}, '::') THEN {gap} >= 1 ELSE {gap} = 0 END"
                return (f"CASE WHEN {shape} AND {whole} THEN transform(concat({b}.l, array_repeat('0', {gap}), {b}.r), "
                        f"g -> regexp_replace(g, '^0+(?=.)', '')) END")
            return bound(both, spread)

        tail = bound(rf"regexp_extract({low}, '([0-9]+(?:[.][0-9]+){{3}})$', 1)", hexed)
        return bound(tail, filled)

    def short(groups: str) -> str:
        def cut(marks: str) -> str:
            # the first of the longest stretches of two zeros or more
            run = fold("sequence(8, 2, -1)", "0", lambda a, k: f"CASE WHEN {a} = 0 AND position(repeat('0', {k}), {marks}) > 0 THEN {k} ELSE {a} END")

            def joined(k: str) -> str:
                at = f"position(repeat('0', {k}), {marks})"
                return (f"CASE WHEN {k} = 0 THEN array_join({groups}, ':') ELSE concat(array_join(slice({groups}, 1, {at} - 1), ':'), '::', "
                        f"array_join(slice({groups}, {at} + {k}, 8), ':')) END")
            return bound(run, joined)
        return bound(f"array_join(transform({groups}, g -> CASE WHEN g = '0' THEN '0' ELSE 'x' END), '')", cut)

    return bound(bound(f"lower({inside})", made), lambda g: f"CASE WHEN {g} IS NOT NULL THEN {short(g)} END")


@cache
def host_sql(host: str) -> str:
    number = r"r'(^|[.])([0-9]+|0x[0-9a-f]*)$'"

    def judged(d: str) -> str:
        return (f"CASE WHEN rlike({d}, {text(FORBIDDEN)}) OR {d} = '' THEN NULL "
                f"WHEN rlike(regexp_replace({d}, '[.]$', ''), {number}) THEN {ipv4_sql(d)} ELSE {d} END")

    def named(h: str) -> str:
        return bound(rf"CASE WHEN rlike({h}, r'[^\x00-\x7F]') THEN {ascii_domain_sql(h)} ELSE lower({h}) END", judged)

    decoded = f"CASE WHEN contains({host}, '%') THEN try_url_decode(replace(regexp_replace({host}, '%(?![0-9A-Fa-f]{{2}})', '%25'), '+', '%2B')) ELSE {host} END"
    inside = f"substring({host}, 2, length({host}) - 2)"
    bracketed = bound(ipv6_sql(inside), lambda a: f"concat('[', {a}, ']')")
    return (rf"CASE WHEN rlike({host}, r'^\[.*\]$') THEN {bracketed} "
            rf"WHEN rlike({host}, r'^[A-Za-z0-9_.-]*[A-Za-z_-][.]?$') AND NOT rlike({host}, r'(^|[.])0[xX][0-9a-fA-F]*[.]?$') THEN lower({host}) "
            f"ELSE {bound(decoded, named)} END")


def punycode(label: Column) -> Column:
    """RFC 3492 text of a label (without ``xn--``)."""
    return applied(punycode_sql, label)


def ipv4(host: Column) -> Column:
    """An IPv4 address in any of its spellings as dotted decimals; null if it is not one."""
    return applied(ipv4_sql, host)


def ipv6(inside: Column) -> Column:
    """The text between the brackets, shortest form; null if it is no IPv6 address."""
    return applied(ipv6_sql, inside)


def serialized_host(host: Column) -> Column:
    """The host as the URL standard writes it; null if it rejects it. A plain ASCII
    name without a number at its end is only lower-cased."""
    return applied(host_sql, host)
