"""Spark jobs for large book catalogs; the text-corpus operators live in the optional subpackage llm."""
