"""Compositions of operators: graph projections of relational tables, indexing, reports, registered queries."""
