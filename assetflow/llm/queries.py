"""All queries of this subpackage."""

from assetflow.llm import (  # noqa: F401
    chat_format, collocations, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, ngram_join, quality, source_audit, source_mix,
    token_counts, url_filter,
)
from assetflow.llm.base import LLM_QUERIES

__all__ = ["LLM_QUERIES"]
