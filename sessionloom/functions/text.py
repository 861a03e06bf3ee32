"""Text columns: token estimates, truncation, word sets, path likeness, sizes and dates (TXT-1 to TXT-14, PRJ-10 to PRJ-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_SPANS = r"(?s)```.*?```|`[^`]+`"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimated_tokens(c) -> Column:
    """Code at 3.5 and prose at 4 characters a token, rounded up (TXT-1)."""
    text = F.coalesce(_col(c), F.lit(""))
    code = F.aggregate(F.regexp_extract_all(text, F.lit(CODE_SPANS), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.ceil(code / 3.5 + (F.length(text) - code) / 4.0).cast("long")


def simple_tokens(c) -> Column:
    """Four characters a token (TXT-2)."""
    return F.ceil(F.length(F.coalesce(_col(c), F.lit(""))) / 4.0).cast("long")


#: What makes a text look like code (TXT-3).
CODE_LIKE = [r"```", r"\b(?:function|class|def|import|const|let|var)\b\s+\w+", r"[{};]\s*$", r"=>|->|::", r"^\s*(?:#include|package|from\s+\w+\s+import)"]


def looks_like_code(c) -> Column:
    return _col(c).rlike("(?m)" + "|".join(f"(?:{p})" for p in CODE_LIKE))


def truncated(c, limit: int) -> Column:
    """The first ``limit`` characters with a mark, if there are more (PRJ-11)."""
    return F.when(F.length(_col(c)) > limit, F.concat(F.substring(_col(c), 1, limit), F.lit("... (truncated)"))).otherwise(_col(c))


def preview(c, limit: int) -> Column:
    """White space collapsed, cut at ``limit`` with an ellipsis (PRJ-12)."""
    flat = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def tokens(c) -> Column:
    """Lower-case runs of letters and digits, marks stripped (FTS-6)."""
    return F.filter(F.split(without_marks(F.lower(_col(c))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


# Letters with marks and the letters they fold to; combining marks fold to nothing.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


#: Combining marks; translate() drops characters that have no counterpart.
COMBINING = "".join(map(chr, range(0x300, 0x370)))


def folded(query: str) -> str:
    """A query as :func:`tokens` folds texts."""
    return query.lower().translate(str.maketrans(MARKED, PLAIN, COMBINING))


def without_marks(c: Column) -> Column:
    """Letters without their diacritics, in one pass; texts of ASCII alone are left as they are."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.translate(c, MARKED + COMBINING, PLAIN))


def word_set(c, longer_than: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda w: F.length(w) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty sets are alike (TXT-11)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def paths_in(c, pattern: str = r"(?:/[\w-]+)+\.\w+") -> Column:
    """Distinct file paths in a text (TXT-10)."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), F.lit(0)))


def _once(value: Column, f) -> Column:
    """``f(value)``, with ``value`` bound as a lambda variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def placed(c, pattern: str, group: int = 1) -> Column:
    """array<struct<at, whole, part>>: every match of a pattern that matches no empty text, its place (from 1) and one of its groups.

    A match lies behind the pieces and the matches before it, so its place is their running length; nothing is searched for again. Texts without a match are
    searched once and no more.
    """
    text = F.coalesce(_col(c), F.lit(""))

    def of(whole: Column, gaps: Column) -> Column:
        # the end of each match, behind a leading 0
        ends = F.aggregate(F.zip_with(gaps, whole, lambda g, w: g + F.length(w)), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        at = F.zip_with(F.slice(ends, F.lit(1), F.size(whole)), gaps, lambda e, g: e + g + 1)
        return F.transform(F.arrays_zip(at.alias("at"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")), lambda x: F.struct(x["at"].alias("at"), x["whole"].alias("whole"), x["part"].alias("part")))

    def gaps(whole: Column) -> Column:
        return F.slice(F.transform(F.split(text, pattern), lambda x: F.length(x)), F.lit(1), F.size(whole))

    found = _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: _once(gaps(w), lambda g: of(w, g)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<at:int,whole:string,part:string>>"))


def _parts(c) -> Column:
    return F.filter(F.split(_col(c), "/"), lambda p: p != "")


def path_likeness(a, b) -> Column:
    """100 if identical, 80 if one part of equally many differs, else the share of parts that agree in place (TXT-12)."""
    x, y = _parts(a), _parts(b)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(_col(a) == _col(b), 100.0).when((F.size(x) == F.size(y)) & (F.size(x) - same == 1), 80.0).when(longest == 0, 0.0).otherwise(same / longest * 100)


def migration_score(path_score, folder_score, has_db, n_files) -> Column:
    """Likeness of an old project folder (TXT-13)."""
    return _col(path_score) + 0.5 * _col(folder_score) + F.when(_col(has_db), 20).otherwise(0) + F.least(_col(n_files), F.lit(30))


def human_bytes(c) -> Column:
    n = _col(c)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).when(n < 1024**3, F.concat(F.format_number(n / 1024**2, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(n / 1024**3, 1), F.lit(" GB")))


def iso(ms) -> Column:
    """Epoch milliseconds as ISO-8601 in UTC (PRJ-10, DAT-1)."""
    at = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (_col(ms) / 1000).cast("decimal(18,6)"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis(ts) -> Column:
    """Epoch milliseconds of a timestamp without time zone."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("millis() takes a column's name")
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name}) div 1000")


def days_between(now: int, ms) -> Column:
    return F.floor((F.lit(now) - _col(ms)) / 86_400_000).cast("long")


def json_or(c, schema: str, fallback: Column) -> Column:
    """Parsed JSON, or ``fallback`` when it is null or broken (JSN-1)."""
    return F.coalesce(F.from_json(_col(c), schema), fallback)
