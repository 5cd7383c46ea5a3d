"""Documents to Markdown with figures: ``python -m docweave.markdown DOCUMENTS OUT --parser MODULE:NAME [--captioner MODULE:NAME]``.

The names are called without arguments and give a layout parser and a
captioner; executors must be able to import them.
"""

from __future__ import annotations

import argparse
import logging
import sys
from importlib import import_module


def made(name: str | None):
    """What ``MODULE:NAME`` gives when called; None for None."""
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"not MODULE:NAME: {name}")
    return getattr(import_module(module), attribute)()


def main(argv: list[str] | None = None, out=print) -> int:
    from pyspark.sql import SparkSession

    from docweave.observe import timed
    from docweave.plans.enrich import enrich
    from docweave.sources import readers

    args = argparse.ArgumentParser(prog="docweave.markdown")
    args.add_argument("documents")
    args.add_argument("out")
    args.add_argument("--parser", required=True)
    args.add_argument("--captioner")
    args.add_argument("--keep-images", action="store_true", help="leave image files of an earlier run")
    a = args.parse_args(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.getOrCreate()
    try:
        if readers.is_file(spark, a.documents):
            readers.check_input(spark, a.documents)
        with timed("markdown"):
            made_of = enrich(spark, readers.resolve(spark, a.documents), a.out, made(a.parser), made(a.captioner), clean=not a.keep_images)
            out(f"{made_of.count()} documents in {a.out}")
    except Exception as e:
        out(f"No Markdown was made: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
