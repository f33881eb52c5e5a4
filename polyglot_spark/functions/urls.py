"""Which URLs may be fetched."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMPATIBLE, EngineConfig
from .text import trimmed, utf16_length

#: Hosts, and beginnings of hosts, that are not fetched.
BLOCKED = ("localhost", "127.0.0.1", "::1", "0.0.0.0")
PRIVATE = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.|127\.)"


#: Characters that no host may have, and those that vanish or become dots when a name is mapped.
FORBIDDEN = re.compile(r"[\x00-\x20\x7f#/:<>?@\[\\\]^|%\ufffd]")
VANISHING, DOTS = re.compile("[\u00ad\u034f\u200b-\u200d\u2060\ufe00-\ufe0f\ufeff]"), re.compile("[\u3002\uff0e\uff61]")
NUMBER = re.compile(r"0[xX][0-9A-Fa-f]*|[0-9]+")
#: Addresses that are not fetched; a mapped address counts as the one it stands for.
CLOSED = [ipaddress.ip_network(n) for n in ("0.0.0.0/32", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "::/128", "::1/128", "fc00::/7", "fe80::/10")]


def _number(part: str) -> int | None:
    """A part of an IPv4 address: hexadecimal, octal or decimal."""
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part)
    except ValueError:
        return None


def _address(name: str) -> str | None:
    """A name whose last part is a number, as an IPv4 address; null if it is none."""
    numbers = [_number(p) if NUMBER.fullmatch(p) else None for p in name.removesuffix(".").split(".")]
    if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def parsed_host(host: str | None) -> str | None:
    """A host as browsers understand it, null if it is none.

    Percent signs are decoded, wide and capital letters and dots of other scripts mapped,
    names beyond ASCII written as such, numbers of any base and fewer than four parts
    made into addresses and IPv6 addresses shortened.
    """
    if not host:
        return None
    if host[0] == "[":
        try:
            return f"[{ipaddress.IPv6Address(host[1:-1] if host[-1] == ']' and '%' not in host else '')}]"
        except ValueError:
            return None
    name = unquote_to_bytes(host.encode("utf-8", "replace")).decode("utf-8", "replace")
    name = DOTS.sub(".", unicodedata.normalize("NFKC", VANISHING.sub("", name)).casefold())
    name = VANISHING.sub("", unicodedata.normalize("NFKC", name))
    if not name or FORBIDDEN.search(name):
        return None
    if not name.isascii():
        try:
            name = ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in name.split("."))
        except UnicodeError:
            return None
    last = name.removesuffix(".").rsplit(".", 1)[-1]
    return _address(name) if NUMBER.fullmatch(last) else name


def closed(host: str) -> bool:
    """Whether a parsed host is one that is not fetched."""
    name = host.removesuffix(".")
    try:
        address = ipaddress.ip_address(name.strip("[]"))
    except ValueError:
        return name == "localhost" or name.endswith(".localhost")
    address = getattr(address, "ipv4_mapped", None) or address
    return any(address in net for net in CLOSED if net.version == address.version)


def strict_host(host: Column) -> Column:
    """Struct (parsed, closed) of a host."""

    @F.pandas_udf("parsed string, closed boolean")
    def judge(hosts: pd.Series) -> pd.DataFrame:
        parsed = [parsed_host(h) for h in hosts]
        return pd.DataFrame({"parsed": parsed, "closed": [p is not None and closed(p) for p in parsed]})

    return judge(host)


def url_verdict(url: Column, config: EngineConfig = COMPATIBLE) -> Column:
    """Struct (allowed, error) of a URL: http or https, not too long, not a private host.

    In strict mode hosts are parsed as browsers do before they are judged.
    """
    text = trimmed(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    web = scheme.isin("http", "https", "ftp", "ws", "wss")
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/\\?#@]*@)?(\[[^\]]*\]|[^/\\?#:]*)", 1))
    if config.url_hosts == "strict":
        # the last @ ends the user's part; tabs and line ends within a URL are dropped
        bare = F.regexp_replace(text, r"[\t\n\r]", "")
        strict = strict_host(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/\\?#]*@)?(\[[^\]]*\]|[^/\\?#:]*)", 1))
        hostless, private = strict["parsed"].isNull(), strict["closed"]
    else:
        hostless = (host == "") | host.rlike(r"[\x00-\x20<>^|%]")
        private = host.isin(*BLOCKED) | host.rlike(PRIVATE)
    # fixed values: the texts of the errors, and the order in which they are looked for
    error = (
        F.when(url.isNull(), "URL must be a string")
        .when(text == "", "URL is required")
        .when(utf16_length(text) > config.max_url_chars, "URL too long")
        .when((scheme == "") | (web & hostless), "Invalid URL")
        .when(~scheme.isin("http", "https"), "Only HTTP and HTTPS URLs are allowed")
        .when(private, "URL host not allowed")
    )
    return F.struct(error.isNull().alias("allowed"), error.alias("error"))
