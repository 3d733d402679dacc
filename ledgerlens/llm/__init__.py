"""Training-data operators: deduplication, identification, scoring, decontamination, tokenization.

Every operator takes a DataFrame of documents (id and text columns are parameters) and returns one
row per document, or one row per pair found. Per-document operators return the input columns packed
as one struct ``row``, so that extra input columns can never clash with result columns.

Nothing else in the library imports this subpackage.
"""
