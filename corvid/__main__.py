"""Commands: ``python -m corvid crawl | reindex | migrate | index | stats | serve --products products.json``.

The products file is a list of objects with the fields of ``corvid.engine.Product``; settings come from the
environment (see ``corvid.config``).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from corvid.config import Settings
from corvid.engine import Engine, Product
from corvid.serve import serve


def products_from(path: str) -> list[Product]:
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    return [Product(**{k: tuple(v) if k == "git_source" and v else v for k, v in r.items()}) for r in rows]


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="corvid", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", help="fetch products and bring what changed into the store")
    crawl.add_argument("--force", action="store_true", help="unchanged pages too")
    reindex = commands.add_parser("reindex", help="as crawl, once or each day")
    reindex.add_argument("--daily", metavar="HH:MM", help="each day at this time, for good")
    for c in (crawl, reindex):
        c.add_argument("--product", help="one product's id; all products without it")
        c.add_argument("--limit", type=int, help="pages of each product")
    commands.add_parser("migrate", help="fit the store to the provider's vector size")
    commands.add_parser("index", help="give the store an index of cells")
    commands.add_parser("stats", help="count chunks")
    commands.add_parser("serve", help="answer questions over standard input and output")
    for c in commands.choices.values():
        c.add_argument("--products", default=os.environ.get("CORVID_PRODUCTS", "products.json"))
    given = parser.parse_args(args)
    engine = Engine(spark or SparkSession.builder.appName("corvid").getOrCreate(), products_from(given.products), settings or Settings.from_env())
    if given.command == "crawl":
        out = engine.crawl(given.product, given.limit, given.force)
    elif given.command == "reindex" and given.daily:
        hour, minute = map(int, given.daily.split(":"))
        out = {"runs": engine.reindex_daily(hour, minute)}
    elif given.command == "reindex":
        out = engine.reindex(given.product, given.limit)
    elif given.command == "migrate":
        out = {"migrated": engine.migrate()}
    elif given.command == "index":
        engine.index()
        out = {"indexed": engine.stats()["total_chunks"]}
    elif given.command == "serve":
        serve(engine, sys.stdin, sys.stdout)
        return {}
    else:
        out = engine.stats()
    print(json.dumps(out, indent=2))
    return out


if __name__ == "__main__":
    main()
