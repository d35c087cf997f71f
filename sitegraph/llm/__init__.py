"""Operators of a training-data pipeline: sharding, near and substring
de-duplication, toxicity, WARC archives, quality rules, mixing, language-model
scoring and packing.  Nothing outside this package imports it."""
