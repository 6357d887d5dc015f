"""Operators for building language-model training corpora on Spark.

Every module holds one operator with a general interface; ``queries`` holds the
registered queries built on them.  Nothing outside this subpackage imports it.
"""
