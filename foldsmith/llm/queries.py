"""Registers the queries of this subpackage."""

from . import queries_archives, queries_filters, queries_mixing, queries_near, queries_packing, queries_pages, queries_private, queries_tokens, queries_toxicity, queries_turns, queries_whitening  # noqa: F401
