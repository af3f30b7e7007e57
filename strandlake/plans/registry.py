"""All queries over the driver's tables, with their DuckDB counterparts."""

from strandlake.plans import queries_io, queries_pileup, queries_rows, queries_sets  # noqa: F401  the others add to queries_rows

QUERIES: dict = dict(queries_rows.Q)
ORACLES: dict = dict(queries_rows.O)
