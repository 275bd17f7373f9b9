"""Conversation analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``    readers and writers
* ``functions``  column functions (text, prompts, labels, masking)
* ``operators``  DataFrame-in, DataFrame-out operators
* ``streaming``  Structured Streaming forms of the ordered operators
* ``plans``      the query catalogue over the test tables, with DuckDB SQL
"""
