"""From page texts to clean paragraphs, over all documents in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weakloom.operators import structuring


def prepare_corpus(pages: DataFrame, doc: str = "doc_id", page: str | None = "page", text: str = "text",
                   path: str | None = None) -> DataFrame:
    """Clean paragraphs. ``page=None`` says that each row is a whole document."""
    if page is None:
        return structuring.document_paragraphs(pages, doc, text, path)
    return structuring.page_paragraphs(pages, doc, page, text, path, cleaned=True)
