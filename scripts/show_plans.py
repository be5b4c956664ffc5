"""Print the formatted physical plan of registered queries.

usage: python scripts/show_plans.py [sf_dir] name-substring ...
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from revlens.catalog import REGISTRY
    from revlens.session import build_session
    from revlens.sources.adapters import load_tables

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    tables = load_tables(spark, sf_dir)
    for name, fn in REGISTRY.items():
        if args and not any(a in name for a in args):
            continue
        print(f"==== {name}")
        fn(tables).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
