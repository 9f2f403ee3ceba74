"""Operators of a training-data pipeline: de-duplication, filters, tokens, packing, search. Nothing else in the package imports them."""
