"""Word splitting shared by the native operators.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Words of ``text`` in order; an empty array for null or blank text."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RUN))


def n_words(text: Column) -> Column:
    """Number of words (0 for null), as long."""
    return F.size(words(text)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars`` in ``text`` (0 for null), as long."""
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, chars, ""))).cast("long")


def running_sums(values: Column, block: int = 128) -> Column:
    """Sums of an array of integers up to and with each place.

    Appending to an array copies it, so sums grow inside blocks, whose own sums grow over blocks.
    """

    def grown(array: Column, start: Column) -> Column:
        empty = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(array, empty, lambda s, x: F.struct((s["at"] + x).cast("int").alias("at"), F.array_append(s["all"], (s["at"] + x).cast("int")).alias("all")))["all"]

    def each(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: (a + x).cast("int")))
        return F.flatten(F.transform(F.array(grown(sums, F.lit(0))), lambda before: F.transform(blocks, lambda b, k: grown(b, F.coalesce(F.get(before, k - 1), F.lit(0)))))[0])

    def whole(bound: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(bound) - 1, F.lit(0)), F.lit(block)), lambda i: F.slice(bound, i + 1, block))
        return F.transform(F.array(cut), each)[0]

    return F.transform(F.array(values), whole)[0]
