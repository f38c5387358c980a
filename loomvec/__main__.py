"""Runs queries into a folder: ``python -m loomvec --tables DIR --output DIR NAME...``.

A query that has run with the same configuration over the same tables is not
run again unless ``--force`` asks for it. Each run leaves a record of versions
and settings beside its tables.
"""

from __future__ import annotations

import argparse
import json
import platform
import time

from loomvec import queries, queries_checks, queries_manifest, queries_more  # noqa: F401  the latter three add to the first
from loomvec.session import get_session
from loomvec.sources.sinks import _put
from loomvec.stages import Runner

#: Queries of the quick mode.
QUICK = ("footer_counts", "generator_profile", "adjusted_profile", "family_delta", "h2_generator_effects")


def provenance(config: dict) -> dict:
    import numpy
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "config": config}


def parse(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loomvec", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("names", nargs="*", help="queries; none: all of the mode")
    parser.add_argument("--tables", help="folder of the Parquet tables")
    parser.add_argument("--output", help="folder for results")
    parser.add_argument("--mode", choices=("quick", "full"), default="full")
    parser.add_argument("--cores", default="*")
    parser.add_argument("--force", action="store_true", help="run again what has run")
    parser.add_argument("--list", action="store_true", help="name the queries and stop")
    found = parser.parse_args(args)
    unknown = sorted(set(found.names) - set(queries.QUERIES))
    if unknown:
        parser.error(f"unknown queries: {', '.join(unknown)}")
    if not found.list and not (found.tables and found.output):
        parser.error("--tables and --output are needed")
    return found


def main(args: list[str] | None = None) -> list[str]:
    """Names of the queries that ran."""
    asked = parse(args)
    names = asked.names or (list(QUICK) if asked.mode == "quick" else sorted(queries.QUERIES))
    if asked.list:
        print("\n".join(names))
        return []
    spark = get_session("loomvec", cores=asked.cores)
    config = {"tables": asked.tables, "mode": asked.mode}
    runner = Runner(spark, asked.output, config)
    for name in names:
        runner.add(name, lambda s, c, f=queries.QUERIES[name]: f(s, c["tables"]))
    seconds = {}
    for name in names:
        began = time.time()
        runner.table(name, force=asked.force)
        seconds[name] = round(time.time() - began, 3)
    record = provenance(config) | {"seconds": seconds, "ran": runner.ran, "tables": {n: runner.path(n) for n in names}}
    _put(spark, f"{asked.output}/run-{int(time.time())}.json", json.dumps(record, indent=1, sort_keys=True).encode())
    return runner.ran


if __name__ == "__main__":
    main()
