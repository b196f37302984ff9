"""Tag-list functions on ArrayType(StringType) columns (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import HC_RENAME, OUT_OF_SCOPE_CODES, PLACEHOLDER_HC, SUPER_GROUPS, WS_CLASS
from .text import _col, unicode_strip

_FIRST_TOKEN = f"^[{WS_CLASS}]*([^{WS_CLASS}]+)"


def first_token(c: str | Column) -> Column:
    """First whitespace-separated token ('' when there is none)."""
    return F.regexp_extract(_col(c), _FIRST_TOKEN, 1)


def split_commas(c: str | Column) -> Column:
    """Split on ',' without trimming (trim happens in the rename step)."""
    return F.split(_col(c), ",")


def top_chars_from_slash(c: str | Column) -> Column:
    """Strip, split on '/', skip literal 'None', first char of each stripped item."""
    parts = F.split(unicode_strip(c), "/")
    kept = F.filter(parts, lambda x: x != F.lit("None"))
    return F.transform(kept, lambda x: F.substring(unicode_strip(x), 1, 1))


def first_tokens_slash(c: str | Column) -> Column:
    """Split on '/', first whitespace token of each part; empty parts dropped."""
    toks = F.transform(F.split(_col(c), "/"), lambda x: first_token(x))
    return F.filter(toks, lambda x: x != F.lit(""))


def in_scope(c: str | Column, codes: list[str] = OUT_OF_SCOPE_CODES) -> Column:
    """keep unless the first token of the whole string is an excluded code.

    Null or empty text has no first token and is kept (null-safe negation).
    """
    tok = F.when(first_token(c) == "", F.lit(None)).otherwise(first_token(c))
    return ~F.coalesce(tok.isin(codes), F.lit(False))


def null_placeholders(c: str | Column, phrases: list[str] = PLACEHOLDER_HC,
                      apply: bool = False) -> Column:
    """placeholder categories -> null.

    The original step computes this and discards the result, so the default
    is the identity; ``apply=True`` applies the evident intent.
    """
    if not apply:
        return _col(c)
    return F.when(_col(c).isin(phrases), F.lit(None)).otherwise(_col(c))


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def normalise_tags(c: str | Column, mapping: dict[str, str] = HC_RENAME) -> Column:
    """Trim + lower each item, then rename with fallback to itself; null -> null."""
    m = _literal_map(mapping)

    def one(x: Column) -> Column:
        k = F.lower(unicode_strip(x))
        return F.coalesce(F.element_at(m, k), k) if mapping else k

    return F.transform(_col(c), one)


def wide_to_list(cols: list[str], numeric: set[str] | None = None) -> Column:
    """C11: non-null values of ``cols`` in column order, as strings.

    Numeric NaN counts as missing, as it does for a pandas not-null test.
    """
    numeric = numeric or set()
    items = []
    for c in cols:
        v = F.col(c)
        if c in numeric:
            v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        items.append(v.cast("string"))
    if not items:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*items))


def truncate_codes(c: str | Column, n: int = 3, trim_first: bool = False) -> Column:
    """Drop blank items, keep the first ``n`` characters of each.

    The cut is taken on the unstripped item (parity); ``trim_first`` strips first.
    """
    kept = F.filter(_col(c), lambda x: unicode_strip(x) != F.lit(""))
    if trim_first:
        return F.transform(kept, lambda x: F.substring(unicode_strip(x), 1, n))
    return F.transform(kept, lambda x: F.substring(x, 1, n))


def top_level(c: str | Column) -> Column:
    """A10: sorted distinct first characters of the non-blank items."""
    kept = F.filter(_col(c), lambda x: unicode_strip(x) != F.lit(""))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.substring(x, 1, 1))))


def label_parent(c: str | Column) -> Column:
    """Integer before the first '.', 0 when it does not parse."""
    head = F.split_part(_col(c), F.lit("."), F.lit(1))
    return F.coalesce(head.try_cast("int"), F.lit(0))


def super_group(parent: str | Column) -> Column:
    """Parent digit -> super group 1/2/3; null outside 1-8."""
    m = F.create_map(*[F.lit(x) for kv in SUPER_GROUPS.items() for x in kv])
    return F.element_at(m, _col(parent))


def as_sorted_text(c: str | Column, sep: str = "|") -> Column:
    """Order-free scalar form of a list (for reports and oracle checks)."""
    return F.array_join(F.array_sort(_col(c)), sep)
