"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`leafmill.llm.queries` derives the registered query results from them.
"""
