"""Names out of whitespace-delimited status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import REPORT_LINES

SPACE = r"[ \t\n\x0B\f\r]+"
SECOND_WORD = r"^[^ \t\n\x0B\f\r]*[ \t\n\x0B\f\r]+([^ \t\n\x0B\f\r]+)"


def report_lines(text: Column, lines: int | None = None) -> Column:
    """The lines after the header line; with ``lines``, the first so many of them.

    Lines end in a line feed, a return, or both. With a limit the text is cut first: up to its line
    feed number ``lines`` + 1 it holds them all, however lines end.
    """
    head = text if lines is None else F.substring_index(text, "\n", lines + 1)
    fed = F.replace(F.replace(head, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    split = F.split(fed, "\n")
    return F.slice(split, 2, F.size(split) if lines is None else lines)


def second_word(line: Column) -> Column:
    """Second column of a line, null if it has none. A line that begins with space has an empty first one."""
    word = F.regexp_extract(line, SECOND_WORD, 1)
    return F.when(word != "", word)


def report_names(df: DataFrame, source: str, text: str, lines: int = REPORT_LINES) -> DataFrame:
    """Distinct ``(source, name)`` of the first ``lines`` data lines of each report; a report that failed (null text) gives none.

    ``source`` must be unique: each report is one row and is made distinct within it, so
    nothing is shuffled.
    """
    words = F.transform(report_lines(F.col(text), lines), second_word)
    names = F.array_distinct(F.filter(words, lambda w: w.isNotNull()))
    return df.select(source, F.explode(names).alias("name"))


def report_counts(df: DataFrame, source: str, text: str) -> DataFrame:
    """Status counts of every data line: ``(source, id, name, replicated, starting, running)``.

    Columns 4 to 6 of the report hold the counts; a line that lacks them gives nulls.
    """
    rows = df.select(source, F.explode(report_lines(F.col(text))).alias("line"))
    words = rows.select(source, F.split("line", SPACE).alias("w"))

    def word(i: int) -> Column:
        return F.try_element_at("w", F.lit(i))

    def number(i: int) -> Column:
        return F.when(word(i).rlike(r"^[0-9]+\z"), word(i).try_cast("int"))

    return words.filter((F.size("w") > 1) & (word(2) != "")).select(
        source,
        word(1).alias("id"),
        word(2).alias("name"),
        *[number(i).alias(n) for i, n in ((4, "replicated"), (5, "starting"), (6, "running"))],
    )
