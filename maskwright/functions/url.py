"""URL parts, rule patterns and their match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V

#: For the schemes of the web any number of slashes of either kind leads to the host; others need two.
URL = (r"(?i)\A([a-z][a-z0-9+.\-]*):(?:(?:(?<=\A(?:http|https|ftp|ws|wss):)[/\\]*|(?<!\A(?:http|https|ftp|ws|wss):)//)"
       r"(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^:/?#\\]*)(?::([0-9]*))?(?=[/?#\\]|\z))?([^?#]*)")
_DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_SPECIAL = ("http", "https", "ftp", "ws", "wss")


def decoded_host(host: Column) -> Column:
    """Percent-encoded ASCII bytes of a host as characters."""
    return F.when(host.rlike("%[0-9A-Fa-f]{2}"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)


def url_parts(url: Column) -> Column:
    """``struct<scheme,host,port,path>``, null when the text is no absolute URL."""
    scheme = F.lower(F.regexp_extract(url, URL, 1))
    host = F.lower(decoded_host(F.regexp_extract(url, URL, 2)))
    port = F.regexp_extract(url, URL, 3)
    path = F.regexp_extract(url, URL, 4)
    default = F.create_map(*[F.lit(x) for kv in _DEFAULT_PORTS.items() for x in kv])
    special = scheme.isin(*_SPECIAL)
    return F.when(
        url.rlike(URL) & ~(special & (host == "")),
        F.struct(
            scheme.alias("scheme"), host.alias("host"),
            F.when(port == F.coalesce(F.element_at(default, scheme), F.lit("")), "").otherwise(port).alias("port"),
            F.when(special & (path == ""), "/").when(special, F.replace(path, F.lit("\\"), F.lit("/")))
            .otherwise(path).alias("path")))


def parse_pattern(pattern: Column) -> Column:
    """Rule text to ``struct<scheme,host,port,path,subdomain>``."""
    scheme = F.regexp_extract(pattern, r"(?i)\A(https?)://", 1)
    rest = F.regexp_replace(pattern, r"\A(?:(?i:https?)|\*)://", "")
    subdomain = rest.startswith("*.")
    bare = F.when(subdomain, F.substring(rest, F.lit(3), F.length(rest))).otherwise(rest)
    authority = F.regexp_extract(bare, r"(?s)\A([^/]*)", 1)
    port = F.regexp_extract(authority, r"(?s)\A.*:([0-9]+)\z", 1)
    return F.struct(
        F.when(scheme != "", F.lower(scheme)).alias("scheme"),
        F.lower(F.regexp_replace(authority, r":[0-9]+\z", "")).alias("host"),
        F.when(port != "", port).alias("port"),
        F.when(bare.contains("/"), F.regexp_extract(bare, r"(?s)\A[^/]*(/.*)\z", 1)).alias("path"),
        subdomain.alias("subdomain"))


def host_match(host: Column, pattern_host: Column, subdomain: Column) -> Column:
    below = F.endswith(host, F.concat(F.lit("."), pattern_host))
    return F.when(subdomain, below).otherwise((host == pattern_host) | below)


def path_match(path: Column, pattern_path: Column) -> Column:
    return (
        F.when(pattern_path.isNull() | pattern_path.isin("", "/", "/*"), True)
        .when(pattern_path.endswith("*"),
              F.startswith(path, F.substring(pattern_path, F.lit(1), F.length(pattern_path) - 1)))
        .otherwise((path == pattern_path) | (path == F.concat(pattern_path, F.lit("/"))))
    )


def wildcard_match(parts: Column, rule: Column) -> Column:
    """``parts`` of a URL against a parsed rule; a null URL never matches."""
    return F.coalesce(
        parts.isNotNull()
        & (rule["scheme"].isNull() | (parts["scheme"] == rule["scheme"]))
        & host_match(parts["host"], rule["host"], rule["subdomain"])
        & (rule["port"].isNull() | (parts["port"] == rule["port"]))
        & path_match(parts["path"], rule["path"]), F.lit(False))


def restricted(url: Column) -> Column:
    """Pages that are never touched: browser pages, extension stores, no URL at all."""
    parts = url_parts(url)
    return F.coalesce(
        parts.isNull()
        | parts["scheme"].isin(*V.RESTRICTED_SCHEMES)
        | (parts["host"] == V.STORE_HOST)
        | ((parts["host"] == V.STORE_PATH_HOST) & parts["path"].startswith(V.STORE_PATH)),
        F.lit(True))
