"""Line, paragraph and cleaning expressions.

Everything works on one value of one row, so it stays in the scan stage; the state that
crosses pages of a document is carried by ``operators.structuring``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which lines and characters are removed.
TITLE_MAX_CHARS = 50
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BRACKETED = r"[(\[][^\n]*?[)\]]"
PATH_STOPWORDS = ("..", "data", "raw")
MIN_HEADER_WORDS = 3

# Every character that counts as blank when a string is split on white space.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def lines_of(text: Column) -> Column:
    """All lines of a page; a trailing newline yields a trailing empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def closes(line: Column) -> Column:
    """The line ends a paragraph."""
    return F.endswith(line, F.lit("."))


def opens_title(line: Column) -> Column:
    """A title may follow this line."""
    return closes(line) | (line == "")


def title_shaped(line: Column) -> Column:
    """Short and holding at least one upper-case letter."""
    return (F.lower(line) != line) & (F.length(line) <= TITLE_MAX_CHARS)


def without_titles(lines: Column, first_follows_opening: Column) -> Column:
    """Lines left after title removal.

    A title is title-shaped and follows, in the original sequence, a closing or empty line.
    ``first_follows_opening`` says so for the first line of the page, whose predecessor
    stands on an earlier page.
    """
    def keep(line: Column, i: Column) -> Column:
        opening = F.when(i == 0, first_follows_opening).otherwise(opens_title(F.get(lines, i - 1)))
        return ~(title_shaped(line) & opening)

    return F.filter(lines, keep)


def paragraph_pieces(lines: Column) -> Column:
    """Join lines and cut after every closing line: n closings give n + 1 pieces.

    The last piece is the open tail. Lines hold no newline, so it is a safe cut mark.
    """
    marked = F.transform(
        lines, lambda l: F.concat(l, F.when(closes(l), F.lit("\n")).otherwise(F.lit(" "))))
    return F.split(F.array_join(marked, ""), "\n", -1)


def collapse_blanks(text: Column) -> Column:
    """Runs of white space become one space; none is left at either end."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def strip_brackets(text: Column) -> Column:
    """Delete the shortest spans from an opening to a closing bracket of either kind."""
    return F.regexp_replace(text, BRACKETED, "")


def strip_punctuation(text: Column) -> Column:
    """Delete ASCII punctuation, leaving spaces as they are."""
    return F.translate(text, PUNCTUATION, "")


def clean(text: Column) -> Column:
    """Brackets out, lower case, punctuation out."""
    return strip_punctuation(F.lower(strip_brackets(text)))


def title_words(path: Column) -> Column:
    """Words of a document title taken from its path."""
    pieces = F.split(F.replace(path, F.lit("/"), F.lit(" ")), " ", -1)
    kept = F.filter(pieces, lambda w: ~w.isin(*PATH_STOPWORDS))
    return F.transform(kept, lambda w: F.replace(w, F.lit(".pdf"), F.lit("")))


def windows(words: Column, n: Column | int) -> Column:
    """All runs of ``n`` consecutive elements, joined with a space."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.size(words) - n + 1
    return F.when(
        starts > 0,
        F.transform(F.sequence(F.lit(1), starts), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def title_ngrams(words: Column, shortest: int = MIN_HEADER_WORDS) -> Column:
    """Every run of title words from the whole title down to ``shortest`` words, longest first."""
    return F.when(
        F.size(words) >= shortest,
        F.flatten(F.transform(F.sequence(F.size(words), F.lit(shortest), F.lit(-1)),
                              lambda n: windows(words, n))),
    ).otherwise(F.array().cast("array<string>"))


def remove_headers(text: Column, grams: Column, shortest_grams: Column) -> Column:
    """Delete each title run from the text, in the given order, case-sensitively.

    Every longer run contains one of the shortest runs, so a text holding none of those is
    returned at once.
    """
    touched = F.exists(shortest_grams, lambda g: F.contains(text, g))
    return F.when(
        touched, F.aggregate(grams, text, lambda acc, g: F.replace(acc, g, F.lit("")))
    ).otherwise(text)


def first_words(text: Column, n: int) -> Column:
    """First ``n`` pieces of a split on single spaces; empty pieces count."""
    return F.array_join(F.slice(F.split(text, " ", -1), 1, n), " ")


def replace_in_path(path: Column, source: str = "raw", target: str = "processed",
                    suffix: str = ".pdf", new_suffix: str = ".txt") -> Column:
    """Output path of an input file; each replacement applies to every occurrence."""
    moved = F.replace(path, F.lit(source), F.lit(target))
    return F.replace(moved, F.lit(suffix), F.lit(new_suffix))
