"""Named analyses (SQL and notebook versions), README findings, cleaning
pipelines, quality reports, single-operator queries and their DuckDB
oracles."""
