"""Training-data operators: tokenizing, mixing, filtering, deduplication, sharding and search.

Nothing else in the library imports this subpackage. Every operator is a function from DataFrames to a
DataFrame; the registered queries are in ``pulse.llm.queries``.
"""
