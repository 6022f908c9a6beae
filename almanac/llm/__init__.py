"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; ``almanac.llm.registry`` lists the
queries and their SQL.
"""
