"""Scalar functions: time, numbers, entropy terms, CSV columns, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 699 days in milliseconds: the lag of a group that never uses a tag.
MAX_LAG_MS = 60_393_600_000


def parse_created_at(c: Column) -> Column:
    """'Fri Feb 28 10:00:00 +0000 2013' -> timestamp, null if it doesn't parse. The day's name is skipped."""
    return F.try_to_timestamp(F.substring(F.trim(c), 5, 60), F.lit("MMM dd HH:mm:ss Z yyyy"))


def format_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def parse_day(c: Column) -> Column:
    """dd/MM/yyyy, null if it doesn't parse."""
    return F.to_date(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def entropy_term(p: Column, q: Column) -> Column:
    """p ln(p/q), 0 where either is 0."""
    return F.when((p == 0) | (q == 0), 0.0).otherwise(p * F.log(p / q))


def information_term(p: Column, pf: Column, pc: Column) -> Column:
    """p log2(p / (pf pc)), 0 where p is 0."""
    return F.when(p == 0, 0.0).otherwise(p * F.log2(p / (pf * pc)))


def split_list(c: Column) -> Column:
    """A comma-joined list without its empty items."""
    return F.filter(F.split(c, ","), lambda x: x != "")


def split_items(c: Column, sep: str = ",") -> Column:
    """Items, trimmed; runs of separators count as one."""
    return F.filter(F.transform(F.split(c, f"[{sep}]+"), lambda x: F.trim(x)), lambda x: x != "")


def join_items(c: Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)


def is_numeric(c: Column) -> Column:
    """An integer or a decimal with '.' or ','."""
    return c.rlike(r"^-?[0-9]+([.,][0-9]+)?$")


def is_special_char(c: Column) -> Column:
    return c.rlike(r"^[.:;/\\^]$")


def two_digits(c: Column) -> Column:
    return F.call_function("format_number", c, F.lit("0.##"))


def duration(ms: Column) -> Column:
    """'h hour, m min, s sec' of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%d hour, %d min, %d sec", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def order_of_magnitude_bin(c: Column, highest: int = 6) -> Column:
    """[0,100] -> 0, (100,1e3] -> 1, ... up to (10**(highest-1), 10**highest]; null outside."""
    out = F.when(c.between(0, 100), 0)
    for k in range(3, highest + 1):
        out = out.when((c > 10 ** (k - 1)) & (c <= 10**k), k - 2)
    return out


def hash_order(seed, *keys) -> Column:
    """A reproducible random order: the md5 of seed and keys, joined by ':'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))
