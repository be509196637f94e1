"""Command line: import a library folder or a folder of pages, and print the report."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from lorefold.operators import imports
from lorefold.operators.store import Store
from lorefold.session import local_session
from lorefold.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lorefold", description=__doc__)
    parser.add_argument("command", choices=("calibre", "html"))
    parser.add_argument("--root", required=True, help="folder to read")
    parser.add_argument("--store", required=True, help="folder of the store")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--skip-existing", action="store_true")
    parser.add_argument("--concurrency", type=int, default=2)
    args = parser.parse_args(argv)
    spark = local_session(max(1, min(args.concurrency, 8)), 8, "4g")
    store = Store(spark, args.store)
    items = store.read("items")
    known = items if items is not None else spark.createDataFrame([], "item_id string, state string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(args.root).select("path", "content")
    if args.command == "calibre":
        documents, report = imports.import_books(raw, known, args.skip_existing, args.dry_run)
    else:
        pages = files.scan_pages(raw.select("path"), args.root).join(raw, "path").select("path", F.col("content").cast("string").alias("html"))
        documents, report = imports.import_pages(pages, known, args.skip_existing)
    if not args.dry_run:
        new = documents.select("item_id", F.lit("parsed").alias("state"), "title", "path").dropDuplicates(["item_id"])
        merged = known.join(new.select("item_id"), "item_id", "left_anti").unionByName(new, allowMissingColumns=True)
        store.commit({"items": merged, f"{args.command}_sections": documents.select("item_id", F.posexplode("sections").alias("idx", "s")).select("item_id", "idx", "s.type", "s.level", "s.content")})
    rows = report.collect()
    states = [r.state for r in rows]
    print(json.dumps({"counts": {s: states.count(s) for s in sorted(set(states))}, "rows": [r.asDict() for r in rows]}, ensure_ascii=False))
    return int("failed" in states)


if __name__ == "__main__":
    sys.exit(main())
