"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

One module per operator; nothing outside this folder imports it. ``queries`` holds the
registered queries (``opN_*`` and ``pipeline``) and their DuckDB SQL.
"""
