"""Training-data operators: mixing, dedup, decontamination, language id, WARC,
quality rules, chat threads, licence and secret scans, and token-id files.

Nothing outside this subpackage imports it.
"""
