"""Column functions used by the rules and checks; all run inside the JVM."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtrail.schema import TACTIC_STOPWORDS

OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
#: Blocks that count as not external.
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
PUBLIC_AGAIN = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE6 = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
PUBLIC_AGAIN6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
HEXTETS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(template: str, *values: Column) -> Column:
    """The template with the values, in order, for its {}."""
    first, *rest = template.split("{}")
    return F.concat(F.lit(first), *(x for value, part in zip(values, rest, strict=True) for x in (value, F.lit(part))))


def truthy(c: Column) -> Column:
    """null where the value is null or empty."""
    return F.nullif(c, F.lit(""))


def or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def any_substring(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return F.coalesce(out, F.lit(False))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"), F.lit(False))


def first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that stands in the text as a word."""
    return F.coalesce(*(F.when(text.rlike(rf"\b{re.escape(w)}\b"), F.lit(w)) for w in words))


def first_marker(text: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(text.contains(m), F.lit(m)) for m in markers))


def web_text() -> Column:
    return F.lower(F.concat_ws(" ", *(truthy(F.col(c)) for c in ("category", "message", "tool", "url"))))


def _number(ip: Column) -> Column:
    part = F.split(ip, r"\.")
    return sum((F.get(part, F.lit(i)).cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), F.get(part, F.lit(0)).cast("bigint") * 256**3)


def _within(number: Column, blocks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        out = out | number.between(int(block[0]), int(block[-1]))
    return out


def _within6(digits: Column, blocks: tuple[str, ...]) -> Column:
    """Whether an address of 32 hexadecimal digits lies in a block."""
    out = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        out = out | digits.between(*(format(int(end), "032x") for end in (block[0], block[-1])))
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _external6(ip: Column) -> Column:
    """Whether the text is an IPv6 address outside the special blocks; of one that maps an IPv4 address that one counts."""

    def without_tail(text: Column) -> Column:
        """An IPv4 address at the end as two groups."""
        last = F.substring_index(text, ":", -1)
        pair = lambda n: F.concat_ws(":", F.hex(F.shiftright(n, 16)), F.hex(n.bitwiseAND(F.lit(0xFFFF))))
        start = F.substring(text, F.lit(1), F.length(text) - F.length(last))
        return F.when(last.rlike(IPV4), F.concat(start, F.lower(let(_number(last), pair)))).otherwise(text)

    def numbers(text: Column) -> Column:
        """The eight groups, null where the text is no address."""
        sides = F.transform(F.split(text, "::"), lambda side: F.filter(F.split(side, ":"), lambda x: x != ""))
        good = F.when(text.contains("::"), text.rlike(rf"^(?:{HEXTETS})?::(?:{HEXTETS})?$")).otherwise(text.rlike(rf"^{HEXTETS}$"))

        def filled(s: Column) -> Column:
            n = F.size(F.flatten(s))
            zeros = F.array_repeat(F.lit("0"), F.lit(8) - n)
            fits = F.when(F.size(s) == 1, n == 8).otherwise(n <= 7)
            return F.when(fits, F.concat(s[0], zeros, F.when(F.size(s) == 2, F.get(s, F.lit(1))).otherwise(F.array().cast("array<string>"))))

        return F.when(good, F.transform(let(sides, filled), lambda x: F.conv(x, 16, 10).cast("bigint")))

    def judged(n: Column) -> Column:
        mapped = (F.aggregate(F.slice(n, 1, 5), F.lit(0).cast("bigint"), lambda a, x: a + x) == 0) & (F.get(n, F.lit(5)) == 0xFFFF)
        v4 = let(F.get(n, F.lit(6)) * 65536 + F.get(n, F.lit(7)), _external4)
        digits = F.array_join(F.transform(n, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
        v6 = let(digits, lambda d: ~_within6(d, PRIVATE6) | _within6(d, PUBLIC_AGAIN6))
        return F.when(n.isNotNull(), F.when(mapped, v4).otherwise(v6))

    plain = F.lower(F.regexp_replace(ip, r"%[^%]+$", ""))
    return let(let(let(plain, without_tail), numbers), judged)


def _external4(number: Column) -> Column:
    return ~_within(number, PRIVATE) | _within(number, PUBLIC_AGAIN)


def is_external_ip(ip: Column) -> Column:
    """Whether the text is an address outside the special blocks."""
    v4 = F.when(ip.rlike(IPV4), let(_number(ip), _external4))
    return F.coalesce(F.when(ip.contains(":"), _external6(ip)).otherwise(v4), F.lit(False))


def utc_time(value: Column) -> Column:
    """A timestamp from ISO 8601 text, without a zone taken as UTC; null where it is not that."""
    text = F.trim(value)
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?)?(?=$|[.,Z+-])", "$1-$2-$3T$4:$5:$6")
    text = F.regexp_replace(F.regexp_replace(text, r"T::$", ""), r":$", "")
    text = F.regexp_replace(text, r"(:\d{2}),(\d+)", "$1.$2")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=$|[Z+-])", "$1:00:00")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$")
    zoned = F.when(text.rlike(r"T.*(Z|[+-]\d{2}(?::?\d{2})?)$|\d .*(Z|[+-]\d{2}(?::?\d{2})?)$"), text).otherwise(F.concat(text, F.when(F.length(text) > 10, F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.when(good, zoned.try_cast("timestamp"))


def to_integer(value: Column) -> Column:
    """Integers and integral decimals, as a column of integer affinity takes them; else null."""
    return F.when(value.rlike(r"^\s*[+-]?\d+(?:\.0*)?\s*$"), F.regexp_extract(value, r"([+-]?\d+)", 1).try_cast("bigint"))


def clip(value: Column, most: int) -> Column:
    text = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…[+"), (F.length(text) - most).cast("string"), F.lit(" chars truncated]"))).otherwise(text)


def tactic_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: (w != "") & ~w.isin(*TACTIC_STOPWORDS))


def severity_rank(severity: Column) -> Column:
    s = F.lower(F.trim(severity))
    return F.when(s == "low", 0).when(s == "medium", 1).when(s == "high", 2).when(s == "critical", 3)


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")
