"""Text columns: templates, error messages, paths, hex payloads."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the error layout and its tags.
ERROR_TEMPLATE = (
    "-" * 94
    + "\n -- Msg: #ErrMessage#"
    + "\n -- Error: #ErrNumber# Severity: #ErrSeverity# State: #ErrState##atPos#"
    + "\n "
    + "-" * 94
)
ERROR_TEMPLATE_SHORT = " Msg: #ErrMessage# Error: #ErrNumber# Severity: #ErrSeverity# State: #ErrState##atPos#"

# One UTF-16LE code unit (or surrogate pair) in hex, matched from where the last one ended.
_UTF16LE_UNIT = (
    r"(?i)\G(?:[0-9A-F]{2}(?:[0-9A-CEF][0-9A-F]|D[0-7])|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])"
)
# Units without any surrogate, in one match: each is of fixed length, so no match recurses.
_PLAIN_UNITS = r"^(?:[0-9A-Fa-f]{2}(?![Dd][89A-Fa-f])[0-9A-Fa-f]{2})*+\z"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_ignoring_case(text: str | Column, tag: str, value: str | Column) -> Column:
    """Replace every ``tag`` whatever its case. A NULL value gives NULL."""
    folded = F.collate(_col(text), "UTF8_LCASE")
    return F.collate(F.replace(folded, F.lit(tag), _col(value)), "UTF8_BINARY")


def fill_template(template: str | Column, tag: str, value: str | Column) -> Column:
    """Turn double quotes into single ones, then put ``value`` in place of ``tag``."""
    return replace_ignoring_case(F.replace(_col(template), F.lit('"'), F.lit("'")), tag, value)


def format_error_messages(errors: DataFrame, template: str = ERROR_TEMPLATE, out: str = "err_msg") -> DataFrame:
    """Fill the error template from columns number, severity, state, line, procedure and message.

    A missing line or procedure leaves no trace; a missing message (number, severity, state) gives NULL.
    """
    position = F.concat(
        F.coalesce(F.concat(F.lit(" at Line:"), F.col("line").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(" in Sql Module:"), F.col("procedure")), F.lit("")),
    )
    tags = {
        "#ErrMessage#": F.col("message"),
        "#ErrNumber#": F.col("number").cast("string"),
        "#ErrSeverity#": F.col("severity").cast("string"),
        "#ErrState#": F.col("state").cast("string"),
        "#atPos#": position,
    }
    # The template is one literal: cut it at its tags once, and let each row be a plain concatenation.
    values = {tag.lower(): value for tag, value in tags.items()}
    parts = re.split("(" + "|".join(map(re.escape, tags)) + ")", template, flags=re.IGNORECASE)
    joined = F.concat(*[values.get(p.lower(), F.lit(p)) for p in parts])
    whole = reduce(Column.__and__, [v.isNotNull() for v in tags.values()])
    # A value that itself holds a tag is filled by the steps that follow its own, in the order of the tags.
    in_turn = F.lit(template)
    for tag, value in tags.items():
        in_turn = replace_ignoring_case(in_turn, tag, value)
    plain = ~F.concat("message", position).contains("#")
    return errors.withColumn(out, F.when(whole, F.when(plain, joined).otherwise(in_turn)))


def file_path_parts(df: DataFrame, path: str, separator: str = "\\") -> DataFrame:
    """Add ``directory`` (with its last separator) and ``file_name``; without a separator all is directory."""
    tail = F.substring_index(F.col(path), separator, -1)
    has = F.instr(F.col(path), separator) > 0
    name = F.when(has, tail).when(F.col(path).isNotNull(), F.lit(""))
    return df.withColumns(
        {
            "directory": F.substring(F.col(path), F.lit(1), F.length(path) - F.length(name)),
            "file_name": name,
        }
    )


def existing_files(paths: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Add ``existing`` (1 or NULL): is the path in the listing?"""
    return paths.join(listing.select(path).distinct().withColumn("existing", F.lit(1)), path, "left")


def utf16_hex_to_text(hex_text: str | Column) -> Column:
    """Text held as the hex of UTF-16LE bytes; NULL when it is not that."""
    hex_text = _col(hex_text)
    # Most texts have no surrogate pair; only the others are taken apart unit by unit.
    sound = F.when(hex_text.rlike(_PLAIN_UNITS), F.lit(True)).otherwise(F.regexp_replace(hex_text, _UTF16LE_UNIT, "") == "")
    return F.when(sound, F.decode(F.unhex(hex_text), "UTF-16LE"))


def text_to_utf16_hex(text: str | Column) -> Column:
    return F.hex(F.encode(_col(text), "UTF-16LE"))


def match_patterns(df: DataFrame, text: str, patterns: Sequence[tuple[str, str]], label: str = "label") -> DataFrame:
    """Inner join with a literal list of (LIKE pattern, label), ignoring case: one row per pattern that matches."""
    folded = F.lower(F.col(text))
    # Each pattern is a literal of its own and so is compiled once.
    hits = [
        F.when(folded.like(p.lower()), F.struct(F.lit(p).alias("pattern"), F.lit(v).alias(label))) for p, v in patterns
    ]
    return df.withColumn("__hit", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, "__hit.pattern", f"__hit.{label}")
