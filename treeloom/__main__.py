"""Command line: ``python -m treeloom query NAME SF_DIR OUT`` writes a query's rows as Parquet, ``queries`` lists the names; for the other jobs see ``--help``."""

from __future__ import annotations

import sys

from treeloom.plans import commands, registry
from treeloom.session import begin_run, build_session, clear, ship


def main(args: list[str]) -> int:
    if args[:1] == ["queries"]:
        print("\n".join(sorted(registry.queries())))
        return 0
    if args[:1] == ["query"] and (len(args) != 4 or args[1] not in registry.queries()):
        print("usage: python -m treeloom query NAME SF_DIR OUT")
        return 2
    if not args or "-h" in args or "--help" in args:
        return commands.main(None, args or ["--help"])
    spark = build_session()
    ship(spark)
    if args[0] != "query":
        return commands.main(spark, args)
    folder = begin_run(spark, args[1])
    registry.queries()[args[1]](spark, args[2].rstrip("/")).write.mode("errorifexists").parquet(args[3])
    clear(spark, folder)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
