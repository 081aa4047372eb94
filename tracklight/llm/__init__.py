"""Operators for preparing language-model training data, as Spark jobs.

Thirteen operators (decontaminate, mixing, linedup, quality, htmltext, neardup, fingerprint, sharding, chat,
language, packing, merkle, hardneg), each a module of plain ``DataFrame -> DataFrame`` functions, with their registered queries in
``entry_queries``.  Nothing outside this subpackage imports it.
"""
