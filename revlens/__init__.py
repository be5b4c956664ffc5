"""revlens: customer and revenue analytics on Spark DataFrames.

Layout
------
sources/    readers, the test-table adapter, sinks
functions/  Column -> Column helpers (dates, strings, maths, bins)
operators/  DataFrame -> DataFrame building blocks (distributed tiles,
            first-per-key, mark joins, medians, frequency tables)
plans/      the named analyses, cleaning pipelines and quality reports
streaming/  incremental (Structured Streaming) form of the revenue rollup
"""

from revlens.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
