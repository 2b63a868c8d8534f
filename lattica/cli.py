"""Command lines: edge2adj EDGELIST ADJACENCYLIST, adj2edge ADJACENCYLIST EDGELIST, sbm FILE N K P Q."""

from __future__ import annotations

import errno
import sys

USAGE = __doc__


def main(args: list[str]) -> int:
    commands = {"edge2adj": 2, "adj2edge": 2, "sbm": 5}
    if not args or commands.get(args[0]) != len(args) - 1:
        print(f"usage: python -m lattica.cli COMMAND ...\n{USAGE}", file=sys.stderr)
        return errno.EINVAL
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    name, *rest = args
    if name == "edge2adj":
        from .sources.adjacency import edgelist_to_adjacencylist

        edgelist_to_adjacencylist(spark, *rest)
    elif name == "adj2edge":
        from .sources.adjacency import adjacencylist_to_edgelist

        adjacencylist_to_edgelist(spark, *rest)
    else:
        from .operators.random_graphs import _blocks, general_sbm_edgelist

        path, n, k, p, q = rest
        general_sbm_edgelist(spark, path, *_blocks(int(n), int(k), float(p), float(q)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
