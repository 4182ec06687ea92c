"""Training-data operators: tokenizing, dedup, scoring, scanning and filtering of text corpora.

Every operator takes a DataFrame and column names and returns a DataFrame; nothing in the
rest of the library imports this subpackage.
"""
