"""Positions of regular-expression matches with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def located(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>>: leftmost non-overlapping matches with code-point offsets (end exclusive).

    ``split`` gives the text between the matches and ``regexp_extract_all`` the
    matches, both from the same scan order, so offsets are running sums of
    lengths.  The sums run in chunks of ``CHUNK`` matches, so that a text of very many
    matches does not copy a growing array for each of them.  The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sized = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)),
                       lambda m, g: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("n"), m.alias("m")))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")

    def walked(chunk, start):
        return F.aggregate(
            chunk, F.struct(start.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["n"]).alias("e"),
                                                      x["m"].alias("m")))).alias("out")),
            lambda acc: acc["out"])

    def starts(chunks):
        return F.aggregate(
            chunks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, c: F.struct(F.aggregate(c, acc["at"], lambda a, x: a + x["g"] + x["n"]).alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])

    chunks = _bound(sized, lambda all_of: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / CHUNK).cast("int")),
                                                      lambda c: F.slice(all_of, c * CHUNK + 1, F.lit(CHUNK))))
    placed = _bound(chunks, lambda cs: F.flatten(F.zip_with(cs, starts(cs), walked)))
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda an expression would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def part(i):
        v = F.substring(F.reverse(d), i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return v - F.when(v > 9, 9).otherwise(0)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), part), F.lit(0), lambda a, x: a + x) % 10 == 0
