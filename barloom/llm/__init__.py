"""Operators for preparing text corpora: packing, extraction, language, decontamination, deduplication,
quality, archives and token counts. Nothing outside this package imports it."""
