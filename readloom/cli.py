"""python -m readloom.cli TASK CONFIG [--set key=value ...] [--dry-run]: run a task; exit code 1 on any error."""

from __future__ import annotations

import argparse
import json
import sys


def load(path: str) -> dict:
    """A JSON file, or YAML where a YAML library is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def setting(text: str) -> tuple[str, object]:
    """(key, value) of KEY=VALUE; a value that is JSON is read as such, all else is a string."""
    key, value = text.split("=", 1)
    try:
        return key, json.loads(value)
    except json.JSONDecodeError:
        return key, value


def main(args: list[str] | None = None) -> int:
    from .plans import tasks

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("task", choices=sorted(tasks.TASKS))
    parser.add_argument("config")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    parser.add_argument("--dry-run", action="store_true")
    got = parser.parse_args(args)
    try:
        config = load(got.config) | dict(setting(x) for x in got.set)
        tasks.validate(got.task, config)
        if got.dry_run:
            return 0
        from pyspark.sql import SparkSession

        tasks.run(SparkSession.builder.appName(f"readloom {got.task}").getOrCreate(), got.task, config)
    except Exception as error:  # noqa: BLE001
        print(f"{got.task}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
