"""Training-data operators: toxicity, URL filters, near-duplicates, tokenisation,
packing, line deduplication, personal data, chat formatting, media columns, search.

Nothing else in the library imports this subpackage.
"""
