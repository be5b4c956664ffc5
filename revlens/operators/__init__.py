"""DataFrame -> DataFrame building blocks: distributed ordering (tiles, row
numbers, running totals, quantiles), first-per-key and mark joins, and
profiling aggregates."""
