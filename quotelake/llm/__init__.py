"""Training-data operators: scoring, packing, cleaning, de-duplication, search and export of text corpora.

Every operator takes DataFrames and returns DataFrames. Nothing else in the library imports this subpackage.
"""
