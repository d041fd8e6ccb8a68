"""Operators for building language-model training data from large corpora.

Every operator takes and returns DataFrames. Rows whose id repeats are the same
document and share its decision; ids are expected to be unique and not null.
"""
