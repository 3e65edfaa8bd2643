"""Credentials and locations in text columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: `scheme://user:password@`, the parts also with a backslash before them. The password goes
# up to the first @ or backslash behind the first colon, and must be followed by an @, or by one with a backslash before it.
# A scheme is tried from the start of a word only, once, and not from each of its letters. Where an
# address is not followed so, neither is any other up to that @ or backslash: all is passed over at once (last group),
# up to the last word that may be the scheme of an address that goes on. So each character is looked at a bounded number of times.
_LAST_WORD = r"(?=(?:(?<!\w)\w++(?::[^\\@:]*+)?)?+(?:[\\@]|\z))"
CREDENTIALS_RE = (
    r"(?s)(?<!\w)(\w++\\?://)(?:([^:]++):[^\\@]++\\?(@)|("
    r"[^:]*?(?=(?<!\w)\w++\\?:[^\\@:]*+(?:[\\@]|\z))|[^:]++:[^\\@]*?" + _LAST_WORD + "))"
)

# Schemes whose empty path reads as "/" and whose host is lower case.
WEB_SCHEMES = ["http", "https", "ws", "wss", "ftp"]

_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)[^/?#]*([^?#]*)"


def redact_credentials(text: Column) -> Column:
    """Text with the password of every `scheme://user:password@` taken out; in time in proportion to its length."""
    redacted = F.regexp_replace(text, CREDENTIALS_RE, "$1$2$3$4")
    return F.when(text.contains("://") & text.contains("@"), redacted).otherwise(text)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, _AUTHORITY, 2)
    return F.when(_is_web(url), F.lower(host)).otherwise(host)


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, _AUTHORITY, 3)
    return F.when(_is_web(url) & (path == ""), F.lit("/")).otherwise(path)


def short_location(url: Column) -> Column:
    """Host and path of a URL."""
    return F.concat(url_host(url), url_path(url))


def from_to_label(source: Column, target: Column) -> Column:
    """Label of a move: hosts only, unless both are on the same host."""
    same = url_host(source) == url_host(target)
    pair = [F.when(same, short_location(u)).otherwise(url_host(u)) for u in (source, target)]
    return F.concat(F.lit("from "), pair[0], F.lit(" to "), pair[1])


def _is_web(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1)).isin(WEB_SCHEMES)
