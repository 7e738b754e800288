"""Command line. Exit 0 done, 1 failed, 2 unknown command or request.

python -m lodestone                                   the queries
python -m lodestone NAME SF_DIR [OUT]                 run a query
python -m lodestone stages                            the stages
python -m lodestone stage NAME SOURCE TARGET [k=v..]  run a stage from a folder of tables to another
python -m lodestone inspect FOLDER [EXPECTED..]       what a run's folder holds
python -m lodestone bridge                            one JSON request from stdin, one JSON answer to stdout
"""

from __future__ import annotations

import json
import sys


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def _told(out: dict) -> int:
    print(json.dumps(out))
    return 0 if out["ok"] else 1


def _query(args: list[str]) -> int:
    from .plans.registry import QUERIES

    if args[0] not in QUERIES or len(args) < 2:
        print(json.dumps({"ok": False, "error": {"type": "KeyError", "message": "unknown_query_or_no_folder"}}))
        return 2
    try:
        df = QUERIES[args[0]](_session(), args[1])
        if len(args) > 2:
            df.write.mode("overwrite").parquet(args[2])
        else:
            df.show(truncate=False)
    except Exception as e:  # the envelope carries the error
        return _told({"ok": False, "error": {"type": type(e).__name__, "message": str(e)[:500]}})
    return _told({"ok": True, "columns": df.columns})


def main(args: list[str]) -> int:
    from . import stages

    if not args:
        from .plans.registry import QUERIES

        print("\n".join(QUERIES))
        return 0
    command, rest = args[0], args[1:]
    if command == "stages":
        print("\n".join(f"{s.name}: {', '.join(s.inputs)} -> {', '.join(s.outputs)}" for s in stages.STAGES.values()))
        return 0
    if command == "bridge":
        return stages.bridge(_session())
    if command == "inspect" and rest:
        return _told(stages.respond(_session(), {"tool": "inspect", "input": {"folder": rest[0], "expected": rest[1:]}}))
    if command == "stage" and len(rest) >= 3 and rest[0] in stages.STAGES:
        given = {"source": rest[1], "target": rest[2]} | {k: _value(v) for k, _, v in (x.partition("=") for x in rest[3:])}
        return _told(stages.respond(_session(), {"tool": rest[0], "input": given}))
    return _query(args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
