"""``python -m codeloom index URL`` indexes a repository or a folder into a store, ``db upgrade`` brings an older store up to date, ``repos`` lists what it has."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .chunking.relations import PythonRelations
from .plans.engine import Engine
from .plans.store import VERSION, Store
from .sources.repositories import Volume, repository_info


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index a repository's branch, or a local folder")
    i.add_argument("url", nargs="?")
    i.add_argument("--store", default="codeloom-store")
    i.add_argument("--volume", default="codeloom-repos")
    i.add_argument("--branch", default="main")
    i.add_argument("--force", action="store_true")
    i.add_argument("--auto-prune", action="store_true")
    i.add_argument("--relations", action="store_true", help="also store calls and imports of Python files")
    d = sub.add_parser("db", help="the store's schema")
    d.add_argument("action", choices=["upgrade"])
    d.add_argument("--store", default="codeloom-store")
    r = sub.add_parser("repos", help="list the repositories of a store and their active snapshots")
    r.add_argument("--store", default="codeloom-store")
    a = p.parse_args(args)
    if a.command == "index" and not a.url:
        print("an url is needed", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("codeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "db":
        print(f"version {Store(spark, os.path.abspath(a.store)).migrate()} before, {VERSION} now")
        return 0
    engine = Engine(spark, os.path.abspath(a.store))
    if a.command == "repos":
        for x in engine.store.repositories().collect():
            print(x.url, x.branch, engine.store.active(x.id))
        return 0
    relations = PythonRelations() if a.relations else None
    if os.path.isdir(a.url) and not os.path.isdir(os.path.join(a.url, ".git")):
        info = repository_info(a.url)
        print(engine.index(a.url, info["url"], info["commit"], a.branch, force=True, prune=a.auto_prune, name=info["name"], relations=relations))
        return 0
    volume = Volume(os.path.abspath(a.volume))
    volume.update(a.url)
    commit = volume.head(a.url, a.branch)
    with volume.checkout(a.url, commit) as folder:
        print(engine.index(folder, a.url, commit, a.branch, a.force, a.auto_prune, relations=relations))
    return 0


if __name__ == "__main__":
    sys.exit(main())
