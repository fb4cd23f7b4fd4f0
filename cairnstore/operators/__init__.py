"""Relational operators of the blob store: DataFrame in, DataFrame out, no side effects."""
