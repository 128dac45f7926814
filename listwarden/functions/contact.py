"""Phone, e-mail and URL building blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwarden.functions.text import strip

_HAS_SCHEME = r"(?i)^https?://"
_HOST = r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{Nd}]+", "")


def is_dialable(digits: Column) -> Column:
    """A national number, with or without the country digit."""
    return F.length(digits).isin(10, 11)


def area_code(digits: Column) -> Column:
    """The three digits before the last seven (only meaningful when dialable)."""
    return F.substring(digits, -10, 3)


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def email_local(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL or bare address: no user, port, path or final dot."""
    text = strip(url)
    full = F.when(text.rlike(_HAS_SCHEME), text).otherwise(F.concat(F.lit("http://"), text))
    host = F.rtrim(F.lower(F.regexp_extract(full, _HOST, 1)), F.lit("."))
    return F.when(text == "", F.lit("")).otherwise(host)


def label_count(host: Column) -> Column:
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return F.when(host == "", F.lit(0)).otherwise(dots + 1)


def last_labels(host: Column, count: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -count)
