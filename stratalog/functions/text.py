"""Timestamps, token classes, numbers with units, durations and the like."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# What is stripped off a token, the forms of a time, and below numbers with units.
_PUNCTUATION = "[\"'(){},;:]"
_SHAPE = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:(?:\.\d{1,9})?(?:[Zz]|[+-]\d{2}:\d{2})|(?:\.\d{3})?(?:[+-]\d{4})?)$"

# What makes a token dynamic, in order, and the class it gets.
CLASSES = (
    ("UUID", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("TS", r"\d{4}-\d{2}-\d{2}.*"),
    ("TIME", r"\d{1,2}:\d{2}:\d{2}(?:\.\d+)?"),
    ("HASH", r"[0-9a-fA-F]{32,}"),
    ("NUM", r"-?\d+(?:\.\d+)?%?"),
    ("IP", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("PROC", r"[A-Za-z][\w.-]*\[\d+\]:?"),
)
# Fixed value: patterns that count as errors.
ERROR = r"(?i)error|exception|fail|timeout|exhausted|oom|killed|panic|fatal|critical"


def tokens(line: Column) -> Column:
    """The tokens of a line between white space."""
    return F.split(F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"\s+", -1)


def strip_punctuation(token: Column) -> Column:
    return F.regexp_replace(token, f"^{_PUNCTUATION}+|{_PUNCTUATION}+$", "")


def event_time(line: Column) -> Column:
    """The time in a line, in epoch milliseconds, or null.

    Only the first token that begins like a date counts: it is tried by itself and then joined
    with the next one. A date without a time is no event time.
    """
    stripped = F.transform(tokens(line), strip_punctuation)
    at = F.array_position(F.transform(stripped, lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}")), True).cast("int")
    own = F.get(stripped, at - 1)
    both = F.concat(own, F.lit("T"), F.replace(F.get(stripped, at), F.lit(","), F.lit(".")))
    parsed = lambda x: F.when(x.rlike(_SHAPE), F.regexp_replace(F.upper(x), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    return F.when(at > 0, F.unix_millis(F.coalesce(parsed(own), parsed(both))))


def token_class(token: Column) -> Column:
    """The class of a token: one of ``CLASSES``, ``KV`` for ``key=dynamic`` with any number of keys,
    else ``STATIC``."""
    out = F.lit("STATIC")
    for name, pattern in reversed(CLASSES):
        out = F.when(token.rlike(rf"^(?:{pattern})$"), name).otherwise(out)
    anything = "|".join(f"(?:{pattern})" for _, pattern in CLASSES)
    # keys hold no ``=``; the value after any number of them is of a class
    keyed = token.rlike(rf"^[^=]+=(?:[^=]+=)*(?:{anything})$")
    return F.when(F.coalesce(token, F.lit("")) == "", "STATIC").when(out != "STATIC", out).when(keyed, "KV").otherwise("STATIC")


def normalised(line: Column) -> Column:
    """A line with each dynamic token replaced by its class in braces; ``key=value`` by its key."""

    def one(t: Column) -> Column:
        kind = token_class(strip_punctuation(t))
        key = F.substring_index(t, "=", 1)
        return F.when(kind == "STATIC", t).when(kind == "KV", F.concat(F.lit("{"), key, F.lit("}"))).otherwise(F.concat(F.lit("{"), F.lower(kind), F.lit("}")))

    return F.array_join(F.transform(tokens(line), one), " ")


def number(value: Column) -> Column:
    """The number in ``key=12.5ms``, or null."""
    return F.regexp_replace(F.regexp_replace(value, "^.*=", ""), "[a-zA-Z%]+$", "").try_cast("double")


def unit(value: Column) -> Column:
    return F.regexp_extract(value, "([a-zA-Z%]+)$", 1)


def rounded(x: Column, places: int = 2) -> Column:
    """Rounded half up."""
    return F.floor(x * 10**places + 0.5) / float(10**places)


def like_text(text: str) -> str:
    """A LIKE pattern for a substring in which ``%`` and ``_`` are wildcards and ``\\`` is itself."""
    return "%" + text.replace("\\", "\\\\") + "%"


def duration(text: str) -> timedelta:
    """``30s``, ``5m``, ``1h``, ``7d``."""
    m = re.fullmatch(r"(\d+)([dhms])", (text or "").strip())
    if m is None:
        raise ValueError(f"no duration: {text!r}")
    return timedelta(**{{"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}[m[2]]: int(m[1])})


def instant(text: str) -> int:
    """An ISO time, or ``yyyy-MM-dd HH:mm:ss`` in UTC, as epoch milliseconds."""
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"no time: {text!r}") from e
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1))


def iso_fixed(ts: Column) -> Column:
    """A timestamp in ISO form with nine fractional digits."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
