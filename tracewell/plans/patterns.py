"""Join of texts with a table of LIKE patterns, without a nested loop and with no bound on the patterns.

A text can only match a pattern if it holds all the literal parts of it. Each pattern is filed under one n-gram of its literal parts, the one that
few texts of a sample and few other patterns hold. n-grams are as long as the parts allow: short ones are few in all, so with more patterns
more of them would share one, and meet all its texts. A text is exploded to those of its n-grams under which a pattern may be filed (bitmaps
of fixed size say which), both meet by equality on the n-gram, and ``like`` decides on what has met. Each pattern is filed once and the
n-grams of a text are distinct, so no pair meets twice. Patterns without a literal say something of the length alone: they go by
the join of lengths with ranges of lengths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.bits import bitmap, in_bitmap
from tracewell.plans.intervals import interval_join
from tracewell.session import materialise

#: Longest of the short n-grams, and the longer ones; texts that say which n-grams are rare; bits of a bitmap.
GRAM = 4
LONG = (8, 16, 32)
SAMPLE = 20_000
BITS = 1 << 17
_TEXT, _PATTERN, _GRAM, _LENGTH, _LEAST, _MOST = "__text", "__pattern", "__gram", "__length", "__least", "__most"


def _grams(text: Column, n: int, character: str = ".") -> Column:
    """Distinct runs of ``n`` characters, overlapping; none where the text is shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({character}{{{n}}}))"), F.lit(1)))


def _with_grams(patterns: DataFrame) -> DataFrame:
    """Each pattern with the n-grams of its literal parts, as long as its longest part allows; without a literal none.

    Wildcards, escaped or not, and backslashes part literals: a character after a backslash begins another part.
    """
    grams = F.lit(None).cast("array<string>")
    for n in (*range(1, GRAM + 1), *LONG):
        own = _grams(F.col(_PATTERN), n, r"[^%_\\]")
        grams = F.when(F.size(own) > 0, own).otherwise(grams)
    return patterns.withColumn("__grams", grams)


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def _filed(texts: DataFrame, patterns: DataFrame, sizes: list[int]) -> DataFrame:
    """The n-gram of each pattern that few texts of a sample and few patterns hold: any would be right, a rare one meets few."""
    total = texts.count()
    drawn = F.pmod(F.xxhash64(_TEXT), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(total, 1)))
    seen = texts.where(drawn).select(F.explode(F.concat(*(_grams(F.col(_TEXT), n) for n in sizes))).alias(_GRAM))
    seen = seen.groupBy(_GRAM).agg(F.count("*").alias("__seen"))
    wanted = patterns.where(F.col("__grams").isNotNull()).select(_PATTERN, "__grams").distinct()
    each = wanted.select(_PATTERN, F.explode("__grams").alias(_GRAM))
    known = each.groupBy(_GRAM).agg(F.count("*").alias("__sharing")).join(seen, _GRAM, "left")
    meetings = (F.coalesce("__seen", F.lit(0)) + 1) * F.col("__sharing")
    rank = F.struct(meetings.alias("meetings"), F.col(_GRAM))
    return each.join(known, _GRAM).groupBy(_PATTERN).agg(F.min(rank)[_GRAM].alias(_GRAM))


def _fits(filed: DataFrame) -> Callable[[int], Callable[[Column], Column]]:
    """For each length, whether a pattern may be filed under an n-gram.

    Of many patterns the long n-grams fill any bitmap of fixed size; their beginnings and ends are short ones, which are few.
    """
    gram = F.col(_GRAM)
    ends = F.array(F.substring(gram, 1, GRAM), F.right(gram, F.lit(GRAM)))
    is_short = F.char_length(gram) <= GRAM
    short, long = filed.where(is_short), filed.where(~is_short)
    held, whole = bitmap(short, _bit(gram), BITS), bitmap(long, _bit(gram), BITS)
    edges = bitmap(long.select(F.explode(ends).alias(_GRAM)), _bit(gram), BITS)

    def of(n: int) -> Callable[[Column], Column]:
        if n <= GRAM:
            return lambda g: in_bitmap(held, _bit(g))
        places = (1, n - GRAM + 1)
        return lambda g: reduce(Column.__and__, (in_bitmap(edges, _bit(F.substring(g, p, GRAM))) for p in places)) & in_bitmap(whole, _bit(g))

    return of


def pattern_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """One row for each text and pattern that match, with the columns of both sides, which must differ.

    ``%`` is any run of characters, ``_`` any one, a backslash takes the next character literally. A NULL text or pattern matches
    nothing; repeated rows of either side match each.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    left = texts.where(F.col(text).isNotNull()).withColumn(_TEXT, fold(F.col(text).cast("string")))
    right = patterns.where(F.col(pattern).isNotNull()).withColumn(_PATTERN, fold(F.col(pattern).cast("string")))
    right = _with_grams(right)
    columns = [*texts.columns, *patterns.columns]

    # All n-grams of a pattern have one length.
    kinds = {r[0] for r in right.select(F.char_length(F.get("__grams", F.lit(0)))).distinct().collect()}
    used, found = sorted(kinds - {None}), []
    if used:
        filed = materialise(_filed(left, right, used), "filed")
        fits = _fits(filed)
        own = F.concat(*(F.filter(_grams(F.col(_TEXT), n), fits(n)) for n in used))
        named = right.join(filed, _PATTERN)
        # Neither side is known to be small: what the texts come to is not what Spark expects of the table they are in.
        met = left.withColumn(_GRAM, F.explode(own)).hint("merge").join(named, _GRAM)
        found.append(met.where(F.expr(f"{_TEXT} LIKE {_PATTERN}")).select(*columns))
    if used and None not in kinds:
        return found[0]

    # Without a literal: each character that is not a percent sign stands for one of the text.
    bare = F.regexp_replace(F.col(_PATTERN), r"\\.", "_")
    bounds = right.where(F.col("__grams").isNull()).withColumns(
        {_LEAST: F.char_length(F.regexp_replace(bare, "%", "")), _MOST: F.when(~bare.contains("%"), F.char_length(bare))}
    )
    lengths = left.withColumn(_LENGTH, F.char_length(_TEXT))
    wild = interval_join(lengths, bounds, _LENGTH, _LEAST, _MOST, closed="both")
    found.append(wild.where(F.expr(f"{_TEXT} LIKE {_PATTERN}")).select(*columns))
    return reduce(DataFrame.unionByName, found)
