"""The shop analytics: DataFrames and literals in, one lazy DataFrame out.

Conventions shared by all operators:

* ``orders``, ``customers``, ``products`` and the category translation have one row per
  key (``sources.reader.key_violations`` checks it); items, payments and reviews may
  repeat an order as often and as unevenly as they like.
* Many-rowed tables are aggregated by their join key before a join wherever the result
  allows it: map-side aggregation then takes care of hot keys, and the joins get smaller.
* No side is broadcast by hand unless its size is bounded by construction. Dimension
  tables are broadcast by Spark when they are below its size threshold.
* Rows with a null group key are left out. Sums of nothing are 0, means of nothing null.
* Every order is total, so that limits and ties always give the same rows.
"""
