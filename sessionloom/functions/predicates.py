"""Row predicates: LIKE by substring, membership, expiry, nullable flags (FLT-1 to FLT-14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(equals: dict | None = None, *more: Column) -> Column:
    """Conjunction of column = value for the values that are given, and ``more`` (FLT-1); pushed to the scan by Spark."""
    parts = [F.col(k) == v for k, v in (equals or {}).items() if v is not None] + [m for m in more if m is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def between_ms(c, since: int | None, until: int | None) -> Column | None:
    """Inclusive range of epoch milliseconds; None leaves an end open (FLT-2)."""
    col = _col(c)
    parts = [p for p in (col >= since if since is not None else None, col <= until if until is not None else None) if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def contains(c, text: str) -> Column:
    """Case-insensitive substring; wildcards in ``text`` have no meaning (FLT-4)."""
    return F.lower(_col(c)).contains(text.lower())


def contains_any(columns, text: str) -> Column:
    return reduce(lambda a, b: a | b, [contains(c, text) for c in columns])


def wild(c, pattern: str) -> Column:
    """Case-insensitive LIKE '%pattern%' where ``%`` and ``_`` are wildcards (FLT-5)."""
    return _col(c).ilike(f"%{pattern}%")


def has_path(files, path: str) -> Column:
    """Whether an array of paths holds ``path``, ignoring case (FLT-6); ``F.array_contains`` is the exact form (FLT-7)."""
    return F.exists(_col(files), lambda f: F.lower(f) == path.lower())


def any_tag(tags, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(_col(tags), F.array(*map(F.lit, wanted))), F.lit(False))


def all_tags(tags, wanted: list[str]) -> Column:
    """All distinct wanted tags are there (FLT-8)."""
    names = sorted(set(wanted))
    return F.size(F.array_intersect(_col(tags), F.array(*map(F.lit, names)))) == len(names)


def live(now: int, expires="expires_at") -> Column:
    """Not expired at ``now`` (FLT-9)."""
    return _col(expires).isNull() | (_col(expires) > now)


def unset(flag) -> Column:
    """False or null (FLT-10)."""
    return ~F.coalesce(_col(flag), F.lit(False))


def noise(content, patterns: list[str], chars: int = 500) -> Column:
    """Whether one of ``patterns`` matches within the first ``chars`` characters (FLT-12)."""
    return F.coalesce(F.substring(_col(content), 1, chars).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def dynamic_threshold(words: int) -> float:
    """Least similarity of a chunk for a query of so many words (FLT-14)."""
    return min(0.30 + 0.01 * words, 0.55)
