"""Operators of training-data pipelines over tables of documents, pages and conversations.

Nothing outside this folder imports it. Each module holds one operator with its own
interface, and the thin query `opN_<name>` that applies it to a whole table; QUERIES and
ORACLES in `registry` list them.
"""
