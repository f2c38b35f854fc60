"""URL and path helpers, and the public-address test for literal IPs."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemetra.functions.scalars import col

# Non-public address ranges (private, loopback, link-local, multicast, reserved, unspecified)
# and the public exceptions inside them.
BLOCKED_V4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
]
PUBLIC_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
BLOCKED_V6 = [
    "::/3",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "3fff::/20",
    "4000::/2",
    "8000::/2",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fc00::/7",
    "fe00::/9",
    "fe80::/10",
    "ff00::/8",
]
PUBLIC_V6 = [
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
]
DEFAULT_PORTS = {"http": 80, "https": 443}

_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(F.trim(col(url)), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url) -> Column:
    authority = F.regexp_replace(F.regexp_extract(F.trim(col(url)), _AUTHORITY, 1), "^.*@", "")
    bracketed = F.regexp_extract(authority, "^\\[([^\\]]*)\\]", 1)
    return F.lower(F.when(F.startswith(authority, F.lit("[")), bracketed).otherwise(F.regexp_extract(authority, "^([^:]*)", 1)))


def port(url) -> Column:
    """Explicit port, else 443 for https and 80 for anything else; null when it is not a valid port number."""
    authority = F.regexp_replace(F.regexp_extract(F.trim(col(url)), _AUTHORITY, 1), "^.*@", "")
    given = F.regexp_extract(authority, ":([0-9]*)$", 1)
    number = given.try_cast("int")
    default = F.when(scheme(url) == "https", DEFAULT_PORTS["https"]).otherwise(DEFAULT_PORTS["http"])
    return F.when((given == "") | (number == 0), default).when(number <= 65535, number)


def origin_fault(url) -> Column:
    """Why a URL has no usable origin, or null."""
    h = host(url)
    return (
        F.when(~F.coalesce(scheme(url).isin(list(DEFAULT_PORTS)), F.lit(False)), "Only http/https URLs are allowed")
        .when(h == "", "Invalid target URL")
        .when(h == "localhost", "Local/internal targets are not allowed")
        .when(port(url).isNull(), "Invalid target URL")
    )


def origin_text(s: Column, h: Column, p: Column) -> Column:
    """scheme://host, with the port only when it is not the default one."""
    usual = ((s == "http") & (p == 80)) | ((s == "https") & (p == 443))
    base = F.concat(s, F.lit("://"), h)
    return F.when(usual, base).otherwise(F.concat(base, F.lit(":"), p.cast("string")))


def url_path(url) -> Column:
    """Path of an absolute URL, without query and fragment."""
    return F.regexp_extract(F.trim(col(url)), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalise_path(path) -> Column:
    """Absolute URL to its path, one leading slash, no trailing slashes, empty to ``/``."""
    p = F.coalesce(col(path), F.lit(""))
    absolute = p.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|//)")
    own = F.regexp_extract(p, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path_only = F.when(absolute, own).otherwise(p)
    rooted = F.when(F.startswith(path_only, F.lit("/")), path_only).otherwise(F.concat(F.lit("/"), path_only))
    trimmed = F.regexp_replace(rooted, "/+$", "")
    return F.when(trimmed == "", "/").otherwise(trimmed)


def clean_relative_path(path) -> Column:
    """Percent-decoded path with ``.``, ``..`` and doubled slashes resolved; null when it starts with ``//``."""
    raw = F.coalesce(F.nullif(col(path), F.lit("")), F.lit("/"))
    # a plus sign is data in a path, so it must survive decoding
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, "[+]", "%2B")), raw)
    rooted = F.when(F.startswith(decoded, F.lit("/")), decoded).otherwise(F.concat(F.lit("/"), decoded))
    doubled = rooted.rlike("^//([^/]|$)")
    kept = F.aggregate(
        F.split(rooted, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(~doubled, F.concat(F.lit("/"), F.concat_ws("/", kept)))


def join_url(base, path) -> Column:
    """Base URL's origin with the path; the base's own path counts only when it ends in a slash."""
    b = F.trim(col(base))
    origin = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    own = url_path(base)
    rest = F.regexp_extract(b, "^[^?#]*([?#].*)?$", 1)
    tail = F.concat(F.lit("/"), F.regexp_replace(F.trim(col(path)), "^/", ""))
    full = F.when(F.endswith(own, F.lit("/")), F.concat(F.regexp_replace(own, "/$", ""), tail)).otherwise(tail)
    return F.when(origin != "", F.concat(origin, full, rest))


def _hex_ranges(nets: list[str]) -> Column:
    """Ranges as an array of (low, high) hex texts, which compare like the addresses."""
    out = []
    for text in nets:
        net = ipaddress.ip_network(text)
        digits = 8 if net.version == 4 else 32
        low, high = (F.lit(format(int(net[i]), f"0{digits}x")) for i in (0, -1))
        out.append(F.struct(low.alias("low"), high.alias("high")))
    return F.array(*out)


def _within(hex_text: Column, nets: list[str]) -> Column:
    return F.exists(_hex_ranges(nets), lambda r: hex_text.between(r["low"], r["high"]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$"


def v4_hex(h: Column) -> Column:
    """Eight hex digits of a dotted address, or null."""
    octets = F.transform(F.split(h, "[.]"), lambda o: F.lpad(F.lower(F.hex(o.try_cast("int"))), 2, "0"))
    return F.when(h.rlike(_V4), F.array_join(octets, ""))


def _v6_digits(text: Column) -> Column:
    """Digits of an address in colon form, filling in one ``::``."""

    def fields(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        short = F.size(sides) == 2
        left, right = fields(F.get(sides, F.lit(0))), fields(F.get(sides, F.lit(1)))
        missing = 8 - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.when(short, F.greatest(missing, F.lit(0))).otherwise(0))
        fits = F.when(short, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
        return F.when(fits, F.concat(left, zeros, right))

    shape = text.rlike("^[0-9a-f:]+$") & ~text.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}")
    groups = F.transform(let(F.split(text, "::"), filled), lambda g: F.lpad(g, 4, "0"))
    return F.when(shape, F.array_join(groups, ""))


def v6_hex(h: Column) -> Column:
    """Thirty-two hex digits of an IPv6 address (also with a dotted tail), or null."""
    tail = v4_hex(F.regexp_extract(h, "([0-9.]+)$", 1))
    plain = F.when(
        F.contains(h, F.lit(".")),
        let(tail, lambda t: F.concat(F.regexp_replace(h, "[0-9.]+$", ""), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4))),
    ).otherwise(h)
    return let(plain, _v6_digits)


def _blocked_v4(digits: Column) -> Column:
    return _within(digits, BLOCKED_V4) & ~_within(digits, PUBLIC_V4)


def _blocked_v6(digits: Column) -> Column:
    """IPv4-mapped addresses lie in a reserved range, so they are blocked whatever they carry."""
    return _within(digits, BLOCKED_V6) & ~_within(digits, PUBLIC_V6)


def literal_ip_verdict(h: Column) -> Column:
    """"public", "blocked", or null when the host is not a literal address."""
    h = F.lower(h)
    # a host with a colon can only be IPv6; the other branch is never evaluated for it
    v6 = let(v6_hex(F.regexp_replace(h, "%.*$", "")), lambda d: F.when(d.isNotNull(), _blocked_v6(d)))
    v4 = let(v4_hex(h), lambda d: F.when(d.isNotNull(), _blocked_v4(d)))
    blocked = F.when(F.contains(h, F.lit(":")), v6).otherwise(v4)
    return let(blocked, lambda b: F.when(b, "blocked").when(~b, "public"))
