"""Command line: ``python -m edgelift.cli -d graph -q folder -ql list -k 5 -crq joint -drq ie -output_path out``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from edgelift.api import CONNECTED, SPLIT, perturb, within
from edgelift.sources import results, text

#: Long names of the methods.
ALIASES = {"JointEnum": "joint", "LookAheadEnum": "lookahead", "RWC": "rwc", "RWCH": "rwch", "ProbeEnum": "probe", "IEEnum": "ie", "RWD": "rwd", "RWDW": "rwdw"}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-d", required=True, help="data graph, text format")
    p.add_argument("-q", required=True, help="folder of query files")
    p.add_argument("-ql", required=True, help="file that lists query files")
    p.add_argument("-crq", default="joint", type=lambda x: ALIASES.get(x, x), choices=sorted(CONNECTED))
    p.add_argument("-drq", default="ie", type=lambda x: ALIASES.get(x, x), choices=sorted(SPLIT))
    p.add_argument("-time_limit", type=float, default=60)
    p.add_argument("-k", type=int, default=1)
    p.add_argument("-preprocess", default="true")
    p.add_argument("-output_path", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    graph = text.read_graph(spark, a.d).persist()
    for query in text.read_query_list(spark, a.ql, a.q):
        try:
            within(spark, a.time_limit, lambda: results.append(perturb(graph, query, k=a.k, method=(a.crq, a.drq), reduce=a.preprocess != "false"), a.output_path))  # noqa: B023
        except TimeoutError as e:
            print(f"{query.name}: {e}")


if __name__ == "__main__":
    main()
