"""python -m docloom PATH [-o FOLDER]: analyse files; specifications as JSON lines on stdout or in a folder."""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom", description="Specifications from documents.")
    p.add_argument("path", help="a file or folder")
    p.add_argument("-o", "--output", help="folder for specs and summary as JSON")
    p.add_argument("-v", "--verbose", action="store_true", help="name the stages on stderr")
    p.add_argument("--store", help="folder that keeps documents' chunks from one run to the next")
    p.add_argument("--reindex", action="store_true", help="make the chunks in the store anew")
    a = p.parse_args(argv)
    if not os.path.exists(a.path):
        print(f"no such file: {a.path}", file=sys.stderr)
        return 1
    from docloom.engine import analyse, read_pages, stored_chunks
    from docloom.session import local_session
    from docloom.sources.store import save_json

    spark = local_session(os.cpu_count() or 2)
    pages, faults = read_pages(spark, a.path)
    chunks = stored_chunks(pages, a.store, a.reindex) if a.store else None
    told = (lambda percent, stage: print(f"{percent} % {stage}", file=sys.stderr)) if a.verbose else (lambda percent, stage: None)
    specs, scope, summary = analyse(pages, chunks=chunks, progress=told)
    if a.output:
        save_json(scope, f"{a.output}/scope")
        save_json(specs, f"{a.output}/specs")
        save_json(summary, f"{a.output}/summary")
    else:
        for line in specs.toJSON().toLocalIterator():
            print(line)
    bad = faults.count()
    if bad:
        print(f"{bad} files were not taken", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
