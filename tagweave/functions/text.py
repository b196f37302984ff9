"""Text cleaning as Spark Column expressions (no UDF).

Each rule is one expression so that a whole cleaning pass compiles into a
single whole-stage-codegen projection + filter next to the parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LSTRIP_CHARS, MIN_CHAR_LEN, TEXT_RULES

# Python's str.isspace() set as literal characters, for btrim (which strips
# any character of the set from both ends: Python strip() semantics).
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Java's Unicode \s is the White_Space property; Python also counts U+001C-1F.
_RUN_WS = r"(?U)[\s\x{1C}-\x{1F}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_strip(c: str | Column) -> Column:
    """Strip Unicode whitespace from both ends (Python ``str.strip()``).

    ``btrim`` with the character set only touches the two ends, where an
    end-anchored regex would test every whitespace run of a long text.
    """
    return F.btrim(_col(c), F.lit(WS_CHARS))


def normal_form(c: str | Column) -> Column:
    """Strip + lower, the form used for phrase-list membership."""
    return F.lower(unicode_strip(c))


def not_in_list(c: str | Column, phrases: list[str]) -> Column:
    """True when the normal form is not in ``phrases``; null counts as not in.

    ``NOT (NULL IN (..))`` is NULL in SQL and would drop the row, so the
    membership test is wrapped in ``coalesce(.., false)`` first.
    """
    if not phrases:
        return F.lit(True)
    return ~F.coalesce(_listed(_col(c), phrases), F.lit(False))


def _listed(c: Column, phrases: list[str]) -> Column:
    """Normal form in ``phrases``; texts longer than every phrase are never
    lower-cased (CASE evaluates lazily), so long documents cost one trim."""
    s = unicode_strip(c)
    longest = max(len(p) for p in phrases)
    return F.when(F.length(s) <= F.lit(longest), F.lower(s).isin(phrases)).otherwise(
        F.when(s.isNotNull(), F.lit(False)))


def blank_listed(c: str | Column, phrases: list[str]) -> Column:
    """null -> '' then '' when the normal form is in ``phrases``."""
    filled = F.coalesce(_col(c), F.lit(""))
    if not phrases:
        return filled
    return F.when(_listed(filled, phrases), F.lit("")).otherwise(filled)


def no_listed_prefix(c: str | Column, prefixes: list[str]) -> Column:
    """true unless the lower-cased (unstripped) text starts with a prefix; true for null."""
    if not prefixes:
        return F.lit(True)
    text = F.lower(_col(c))
    return ~F.coalesce(reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes]), F.lit(False))


def strip_boilerplate(c: str | Column, patterns: list[str], word_boundary: bool = False,
                      longest_first: bool = False) -> Column:
    """Remove each pattern once at the start, case-insensitive, in order.

    Patterns are regexes.  They are applied one after another on the
    unstripped text, so a removal can expose text for a later pattern but
    never for an earlier one.  ``word_boundary``/``longest_first`` are opt-in
    corrections of that behaviour.
    """
    pats = sorted(patterns, key=len, reverse=True) if longest_first else list(patterns)
    out = _col(c)
    for p in pats:
        body = f"(?:{p})\\b" if word_boundary else f"(?:{p})"
        out = F.regexp_replace(out, f"(?iu)^{body}", "")
    return out


def lstrip_punct(c: str | Column, chars: str = LSTRIP_CHARS) -> Column:
    """Drop leading ASCII punctuation and whitespace (a character set)."""
    return F.ltrim(_col(c), F.lit(chars))


def collapse_ws(c: str | Column) -> Column:
    """C4: whitespace runs -> one space, then strip (``' '.join(s.split())``)."""
    return unicode_strip(F.regexp_replace(_col(c), _RUN_WS, " "))


def clean_text_column(df: DataFrame, col: str, rules: dict | str = "title",
                      word_boundary: bool = False, longest_first: bool = False) -> DataFrame:
    """F5 -> F6 -> F7 -> C2 -> C3 -> C4 on one column.

    ``rules`` is "title"/"abstract" (the fixed lists) or a dict with keys
    drop / nulls / prefixes / boiler_plate.
    """
    r = TEXT_RULES[rules] if isinstance(rules, str) else rules
    df = df.filter(not_in_list(col, r["drop"]))
    df = df.withColumn(col, blank_listed(col, r["nulls"]))
    df = df.filter(no_listed_prefix(col, r["prefixes"]))
    cleaned = collapse_ws(lstrip_punct(strip_boilerplate(
        col, r["boiler_plate"], word_boundary, longest_first)))
    return df.withColumn(col, cleaned)


def combine_title_abstract(title: str | Column, abstract: str | Column) -> Column:
    """Title + ' ' + abstract (nulls as ''), stripped."""
    return unicode_strip(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "),
                                  F.coalesce(_col(abstract), F.lit(""))))


def process_texts(df: DataFrame, title: str = "AwardTitle", abstract: str = "AwardAbstract",
                  out: str = "AllText", min_char_len: int = MIN_CHAR_LEN,
                  title_rules: dict | str = "title",
                  abstract_rules: dict | str = "abstract") -> DataFrame:
    """Title pass, abstract pass, combine (P8), minimum length (F8).

    Length is counted in code points, inclusive.
    """
    df = clean_text_column(df, title, title_rules)
    df = clean_text_column(df, abstract, abstract_rules)
    df = df.withColumn(out, combine_title_abstract(title, abstract))
    return df.filter(F.length(out) >= F.lit(min_char_len))


def lower_text(df: DataFrame, col: str = "AllText", cased: bool = False) -> DataFrame:
    """Lower-case the model text unless the task is cased."""
    return df if cased else df.withColumn(col, F.lower(col))
