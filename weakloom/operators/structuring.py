"""Pages of text to numbered lines, paragraphs and clean paragraphs.

Two forms of input:

* ``document_paragraphs``: one row holds a whole document. Everything happens inside the row,
  without a shuffle.
* ``page_*``: one row holds one page. Work on lines stays inside the page; only a few numbers
  per page (does the previous page end a paragraph, how many lines and paragraph ends came
  before) go through the chunked scans of ``scan``. The text itself moves once, to meet those
  numbers, and the pieces of paragraphs that continue over a page border move once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.functions import text as tx
from weakloom.operators import scan
from weakloom.session import durable


# --- one row per document ---------------------------------------------------------------

def document_paragraphs(df: DataFrame, doc: str = "doc_id", text: str = "text",
                        path: str | None = None, cleaned: bool = True) -> DataFrame:
    """``(doc, para_id, text)`` of every closed paragraph.

    With ``path`` the title runs of the path are removed first. ``cleaned`` applies the
    cleaning steps; without it the joined paragraph is returned.
    """
    cols = [F.col(doc), tx.lines_of(F.col(text)).alias("_lines")]
    if path:
        cols.append(tx.title_words(F.col(path)).alias("_words"))
    lines = df.select(*cols)
    rest = ["_words"] if path else []
    first = F.get("_lines", F.lit(0))
    kept = lines.select(doc, *rest, tx.without_titles(F.col("_lines"), tx.closes(first)).alias("_kept"))
    pieces = kept.select(doc, *rest, tx.paragraph_pieces(F.col("_kept")).alias("_pieces"))
    # The generator takes an expression, not a column: for a column Spark would add a filter
    # on its size that repeats all of the above.
    exploded = pieces.select(doc, *rest, F.posexplode(
        F.slice("_pieces", F.lit(1), F.size("_pieces") - 1)).alias("para_id", "text"))
    exploded = exploded.select(doc, F.col("para_id").cast("long").alias("para_id"), *rest,
                               tx.collapse_blanks(F.col("text")).alias("text"))
    if path:
        exploded = with_title_grams(exploded, "_words").select(
            doc, "para_id", tx.remove_headers(F.col("text"), F.col("_grams"), F.col("_short")).alias("text"))
    return exploded.withColumn("text", tx.clean(F.col("text"))) if cleaned else exploded


def with_title_grams(df: DataFrame, words: str) -> DataFrame:
    """Add all title runs and, for the quick test, the shortest ones alone."""
    return df.select("*", tx.title_ngrams(F.col(words)).alias("_grams"),
                     tx.windows(F.col(words), tx.MIN_HEADER_WORDS).alias("_short"))


# --- one row per page -------------------------------------------------------------------

def page_lines(df: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """``(doc, page, pos, line)``: every line of every page."""
    return df.select(doc, page, F.posexplode(tx.lines_of(F.col(text))).alias("pos", "line"))


def _first_state(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """One slim row per page: what the rest of the document has to know about it.

    Everything is counted for the case that the page's first line stays; the two ``_first``
    columns say what changes if it turns out to be a title.
    """
    lines = df.select(doc, page, tx.lines_of(F.col(text)).alias("_lines"))
    first, last = F.get("_lines", F.lit(0)), F.get("_lines", F.size("_lines") - 1)
    kept = lines.select(
        doc, page, F.size("_lines").alias("n_lines"),
        tx.opens_title(last).alias("opens_next"),
        tx.closes(first).alias("first_closes"),
        tx.title_shaped(first).alias("first_title_shaped"),
        tx.without_titles(F.col("_lines"), F.lit(False)).alias("_kept"))
    return kept.select(
        doc, page, "n_lines", "opens_next", "first_closes", "first_title_shaped",
        F.size("_kept").alias("n_kept"),
        F.size(F.filter("_kept", tx.closes)).alias("n_ends"))


def page_states(df: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
                chunk: int = scan.CHUNK) -> DataFrame:
    """Per page: ``opened`` (a title may start it), lines, kept lines and paragraph ends before
    it, and the number of paragraphs of the document."""
    # The text is read once for these few numbers per page; every scan below starts from them.
    slim = scan.with_chunks(durable(_first_state(df, doc, page, text)), page, chunk)
    known = scan.previous_value(slim, [doc], page, "opens_next", "_prev")
    # The first line of a document is compared with itself.
    opened = F.coalesce(F.col("_prev"), F.col("first_closes"))
    is_title = (F.col("first_title_shaped") & opened).cast("int")
    counted = known.select(
        doc, page, "_chunk", opened.alias("opened"), "n_lines",
        (F.col("n_kept") - is_title).alias("n_kept"),
        (F.col("n_ends") - is_title * F.col("first_closes").cast("int")).alias("n_ends"))
    return scan.running_totals(
        counted, [doc], page,
        {"n_lines": "lines_before", "n_kept": "kept_before", "n_ends": "ends_before"},
        {"n_ends": "n_paragraphs"}).drop("_chunk")


def _pages_with_state(df: DataFrame, doc: str, page: str, text: str, chunk: int) -> DataFrame:
    states = page_states(df, doc, page, text, chunk)
    return df.select(doc, page, F.coalesce(text, F.lit("")).alias("_text")).join(states, [doc, page])


def numbered_lines(df: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
                   chunk: int = scan.CHUNK) -> DataFrame:
    """``(doc, page, pos, line_no, line)``: lines with their number in the document."""
    pages = _pages_with_state(df, doc, page, text, chunk)
    return pages.select(doc, page, "lines_before", F.posexplode(tx.lines_of(F.col("_text"))).alias("pos", "line")).select(
        doc, page, "pos", (F.col("lines_before") + F.col("pos")).alias("line_no"), "line")


def lines_without_titles(df: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
                         chunk: int = scan.CHUNK) -> DataFrame:
    """``(doc, page, line_no, line)`` after title removal, renumbered over the document."""
    pages = _pages_with_state(df, doc, page, text, chunk)
    split = pages.select(doc, page, "opened", "kept_before", tx.lines_of(F.col("_text")).alias("_lines"))
    kept = split.select(doc, page, "kept_before", F.posexplode(
        tx.without_titles(F.col("_lines"), F.col("opened"))).alias("pos", "line"))
    return kept.select(doc, page, (F.col("kept_before") + F.col("pos")).alias("line_no"), "line")


def title_counts(df: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
                 chunk: int = scan.CHUNK) -> DataFrame:
    """``(doc, n_titles)``: lines removed as titles. Needs the page states only, not the text."""
    states = page_states(df, doc, page, text, chunk)
    return states.groupBy(doc).agg(F.sum(F.col("n_lines") - F.col("n_kept")).alias("n_titles"))


def page_paragraphs(df: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
                    path: str | None = None, cleaned: bool = False, chunk: int = scan.CHUNK) -> DataFrame:
    """``(doc, para_id, first_page, text)``: closed paragraphs, also across pages.

    Paragraphs inside one page are finished there. Of a page only the first and the last
    piece can belong to a paragraph that spans pages; those are gathered by paragraph.
    ``path`` names a column equal on all pages of a document, whose title runs are removed.
    """
    carried = [F.col(path).alias("_path")] if path else []
    rest = ["_path"] if path else []
    states = durable(page_states(df, doc, page, text, chunk).select(doc, page, "opened", "ends_before", "n_paragraphs"))
    pages = df.select(doc, page, *carried, F.coalesce(text, F.lit("")).alias("_text")).join(states, [doc, page])
    split = pages.select(doc, page, *rest, "opened", "ends_before", "n_paragraphs",
                         tx.lines_of(F.col("_text")).alias("_lines"))
    kept = split.select(doc, page, *rest, "ends_before", "n_paragraphs",
                        tx.without_titles(F.col("_lines"), F.col("opened")).alias("_kept"))
    pieces = kept.select(
        doc, page, *rest, "ends_before", "n_paragraphs",
        # The open tail of a page holds lines unless its last line closed a paragraph.
        (~F.coalesce(tx.closes(F.get("_kept", F.size("_kept") - 1)), F.lit(True))).alias("_tail"),
        tx.paragraph_pieces(F.col("_kept")).alias("_pieces"))
    sized = pieces.withColumn("_n", F.size("_pieces"))
    # There is always a piece. The outer form only keeps Spark from adding a filter on the
    # array's size that would repeat all of the above.
    exploded = sized.select(
        doc, page, *rest, "ends_before", "n_paragraphs", "_tail", "_n",
        F.posexplode_outer("_pieces").alias("_k", "_piece")).select(
        doc, page, *rest, (F.col("ends_before") + F.col("_k")).alias("para_id"), "n_paragraphs", "_tail",
        (F.col("_k") == 0).alias("_head_piece"), (F.col("_k") == F.col("_n") - 1).alias("_last_piece"), "_piece")
    # Lines after the last closing line of the document are dropped before anything moves.
    closed = exploded.where((F.col("para_id") < F.col("n_paragraphs")) & (~F.col("_last_piece") | F.col("_tail")))
    border = F.col("_head_piece") | F.col("_last_piece")
    whole = closed.where(~border).select(
        doc, "para_id", F.col(page).alias("first_page"), *rest, F.col("_piece").alias("text"))
    parts = closed.where(border).groupBy(doc, "para_id").agg(
        F.min(page).alias("first_page"), *[F.first(c).alias(c) for c in rest],
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("at"), "_piece"))).alias("_parts"))
    joined = parts.select(doc, "para_id", "first_page", *rest, F.array_join(
        F.transform("_parts", lambda x: x["_piece"]), " ").alias("text"))
    result = whole.unionByName(joined).withColumn("text", tx.collapse_blanks(F.col("text")))
    if path:
        words = result.select("*", tx.title_words(F.col("_path")).alias("_words"))
        result = with_title_grams(words, "_words").select(
            doc, "para_id", "first_page",
            tx.remove_headers(F.col("text"), F.col("_grams"), F.col("_short")).alias("text"))
    return result.withColumn("text", tx.clean(F.col("text"))) if cleaned else result

