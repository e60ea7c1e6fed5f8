"""Blank out literals and comments of SQL text, keeping its length and line breaks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masker() -> Callable[[str], str]:
    # Everything is local so that the function travels to the executors by value.
    opening_mark = re.compile(r"'|--|/\*")
    nesting_mark = re.compile(r"/\*|\*/")
    line_break = re.compile(r"[\r\n]")
    ink = re.compile(r"[^\r\n]")

    def mask(text: str) -> str:
        """Quotes and outer comment marks stay; what they enclose becomes blanks."""
        parts, at = [], 0
        while opening := opening_mark.search(text, at):
            start = opening.end()
            stop = resume = len(text)
            if opening.group() == "'":
                quote = text.find("'", start)
                if quote >= 0:
                    stop, resume = quote, quote + 1
            elif opening.group() == "--":
                end = line_break.search(text, start)
                if end:
                    stop = resume = end.start()
            else:
                depth = 1
                for mark in nesting_mark.finditer(text, start):
                    depth += 1 if mark.group() == "/*" else -1
                    if depth == 0:
                        stop, resume = mark.start(), mark.end()
                        break
            parts += [text[at:start], ink.sub(" ", text[start:stop]), text[stop:resume]]
            at = resume
        return "".join(parts) + text[at:]

    return mask


mask = _masker()


@F.pandas_udf(T.StringType())
def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Nested comments are not a regular language, hence Python; Arrow batches, one small pass per text."""
    for texts in batches:
        yield texts.map(mask, na_action="ignore")


def _cutter() -> Callable[[str], list[str]]:
    mask_text = _masker()
    go_line = re.compile(r"(?:\A|(?<=\n)) *[Gg][Oo] *(?:\r?\n|\Z)")

    def cut(text: str) -> list[str]:
        """The runs of lines between lines that hold only GO, each without the break after its last line."""
        if not go_line.search(text):
            return [text]
        batches, at = [], 0
        for go in go_line.finditer(mask_text(text)):
            # Masking keeps places. A line that it changed lies in a literal or a comment.
            if text[go.start() : go.end()] == go.group():
                batches.append(_unbroken(text[at : go.start()]))
                at = go.end()
        return [*batches, text[at:]]

    def _unbroken(run: str) -> str:
        return run[:-2] if run.endswith("\r\n") else run[:-1] if run.endswith("\n") else run

    return cut


cut_batches = _cutter()


@F.pandas_udf(T.ArrayType(T.StringType()))
def go_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Batches of each text: which GO lines count is known only with the nested comments, hence beside the mask."""
    for texts in batches:
        yield texts.map(cut_batches, na_action="ignore")
