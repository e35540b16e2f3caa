"""Operators for large training corpora (dedup, tokens, quality, filtering, WARC).

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
