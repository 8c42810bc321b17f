"""Queries over the given tables, one or more per operator, each with SQL that gives the same
result in DuckDB."""

from gridloom.catalog import cleaning, flagship, growing, importing, profiling, records, sheets

REGISTERED = {
    **flagship.QUERIES,
    **cleaning.QUERIES,
    **profiling.QUERIES,
    **importing.QUERIES,
    **records.QUERIES,
    **sheets.QUERIES,
    **growing.QUERIES,
}
