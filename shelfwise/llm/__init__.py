"""Operators for preparing training data at scale.

Each module holds one operator with its own interface; ``queries`` holds the
registered queries that apply them to whole tables, ``oracles`` their SQL.
Nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
