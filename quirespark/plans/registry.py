"""Registered queries of the document operators and their SQL."""

from __future__ import annotations

from quirespark.plans import box_queries, fold_sql, more_queries, page_queries, text_queries, text_sql


def _modules():
    return (box_queries, text_queries, page_queries, more_queries)


def queries():
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in (*_modules(), fold_sql, text_sql) for k, v in m.SQL.items()}
