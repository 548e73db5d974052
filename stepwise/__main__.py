"""Command line: breadth-first search over adjacency text."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.checkpoints import from_conf
from .plans import bfs
from .plans.iterate import default_name, default_output
from .sources import adjacency, files


def main(arguments: list[str] | None = None) -> int:
    """0 if the search was made, 1 if the graph is ill-formed or the output must not be replaced."""
    parser = argparse.ArgumentParser(prog="stepwise", description=__doc__)
    parser.add_argument("--algorithm", choices=["temporal", "schimmy", "naive"], default="temporal")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", help="default: the folder output in the input")
    parser.add_argument("--name", default=default_name())
    parser.add_argument("--steps", type=int, default=1)
    parser.add_argument("--partitions", type=int, help="buckets of the graph; default: the session's shuffle partitions")
    parser.add_argument("--checkpoints", default="", help="steps, comma-separated and counted from 0")
    parser.add_argument("--steps-folder", help="keep the steps' outputs there, and go on from those that are there")
    parser.add_argument("--add-missing", action="store_true", help="give targets of edges without a vertex one")
    parser.add_argument("--verbose", action="store_true", help="print the result")
    parser.add_argument("--local-output", help="copy the result to this folder of the driver too")
    parser.add_argument("--keep-output", action="store_true", help="fail if the output exists")
    given = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName(given.name).getOrCreate()
    output = given.output or default_output(given.input)
    graph = adjacency.read(spark, given.input)
    if given.add_missing:
        graph = adjacency.add_missing(graph)
    try:
        if given.algorithm == "naive":
            out = bfs.naive(graph, given.steps, partitions=given.partitions, folder=given.steps_folder, name=given.name)
        elif given.algorithm == "schimmy":
            out = bfs.schimmy(graph, given.steps, given.partitions)
        else:
            folder = given.steps_folder and f"{given.steps_folder.rstrip('/')}/{given.name}"
            out = bfs.temporal(graph, given.steps, from_conf(given.checkpoints, given.steps), partitions=given.partitions, folder=folder)
        if given.keep_output and files.exists(spark, output):
            raise ValueError(f"{output} is there already")
    except ValueError as wrong:
        print(f"stepwise: {wrong}", file=sys.stderr)
        return 1
    adjacency.write(out, output, overwrite=not given.keep_output)
    if given.verbose or given.local_output:
        for line in files.fetch(spark, output, given.local_output, given.local_output and "result.txt"):
            if given.verbose:
                print(line)
    print(output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
