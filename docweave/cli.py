"""A chat loop over an index: ``python -m docweave.cli FOLDER [DOCUMENTS]``."""

from __future__ import annotations

import sys

from docweave.sources.readers import read_questions


def main(argv: list[str] | None = None, lines=None, out=print) -> int:
    from pyspark.sql import SparkSession

    from docweave.operators.prompts import sources
    from docweave.plans.engine import Engine

    argv = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, argv[0])
    try:
        engine.ensure_ready(argv[1] if len(argv) > 1 else None)
    except Exception as e:
        out(f"The index can't be made ready: {e}")
        return 1
    for line in sys.stdin if lines is None else lines:
        if line.strip().lower() in ("exit", "quit"):
            break
        for question in read_questions([line]):
            try:
                asked = spark.createDataFrame([(0, question)], "query_id int, question string")
                row = engine.answer(asked).first()
                out(row["answer"])
                out(row["context"])
                for s in sources(engine.retrieve(asked)).orderBy("rank").collect():
                    out(s["source"])
            except Exception as e:
                out(f"No answer: {e}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
