"""Operators for large training corpora: filtering, deduplication, scanning and packing of text documents.

Every operator takes a DataFrame with (at least) ``doc_id`` and ``text``, reads only the columns it names
and returns a DataFrame. Nothing outside this subpackage imports it."""
