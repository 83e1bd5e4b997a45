"""Training-data operators. Nothing else in the library imports this subpackage.

Every operator takes a DataFrame and returns one with new columns (or a new
table); :mod:`textloom.llm.queries` holds the thin queries over the tables.
"""
