"""Registered queries and their SQL, apart from the training-data subpackage."""

from . import documents, graph, pages, reports, units

QUERIES = {**pages.QUERIES, **units.QUERIES, **documents.QUERIES, **graph.QUERIES, **reports.QUERIES}
SQL = {**pages.SQL, **units.SQL, **documents.SQL, **graph.SQL, **reports.SQL}
