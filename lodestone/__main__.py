"""Command line: `extract-text [--input] FILE [--context N] [--output FOLDER]`, `benchmark [--dataset] FILE [--json]`, and a command for each stage with `--config FILE`."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from lodestone import stages
from lodestone.operators.candidates import extract_candidates
from lodestone.operators.evaluation import FIELDS, evaluate
from lodestone.sources.config import with_limits
from lodestone.sources.files import read_lines, read_texts


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract-text", help="candidates of plain text files")
    e.add_argument("path", nargs="?")
    e.add_argument("--input")
    e.add_argument("--context", type=int, default=2)
    e.add_argument("--output")
    b = sub.add_parser("benchmark", help="score extraction against expected values (JSON lines)")
    b.add_argument("path", nargs="?")
    b.add_argument("--dataset")
    b.add_argument("--context", type=int, default=0)
    b.add_argument("--json", action="store_true", help="one JSON object instead of lines")
    for name in stages.RUN:
        c = sub.add_parser(name.replace("_", "-"), help=f"the stage {name}")
        c.add_argument("--config", required=True)
        c.add_argument("--base")
        if name == "literature_search":
            for limit in ("per-query", "max-reviews", "max-primary"):
                c.add_argument(f"--{limit}", type=int)
        if name == "pdf_download":
            c.add_argument("--row", type=int)
    a = p.parse_args(args)
    path = getattr(a, "path", None) or getattr(a, "input", None) or getattr(a, "dataset", None)
    if a.command in ("extract-text", "benchmark") and not path:
        p.error("a file is needed")
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if a.command == "extract-text":
        found = extract_candidates(read_texts(spark, path), context=a.context)
        if a.output:
            found.write.mode("overwrite").json(a.output)
        else:
            for line in found.toJSON().toLocalIterator():
                print(line)
        return 0
    if a.command != "benchmark":
        config = stages.load_config(a.config, a.base)
        if a.command == "literature-search":
            config = with_limits(config, per_query=a.per_query, max_reviews=a.max_reviews, max_primary=a.max_primary)
        options = {"row": a.row} if a.command == "pdf-download" and a.row is not None else {}
        print(json.dumps(stages.run(spark, a.command.replace("-", "_"), config, **options)))
        return 0
    rows = read_lines(spark, path, "text string, expected array<map<string,string>>, context_sentences int").withColumn("doc_id", F.monotonically_increasing_id())
    result = score(rows.withColumn("context", F.coalesce("context_sentences", F.lit(a.context))), "context").first().asDict(recursive=True)
    if a.json:
        print(json.dumps(result))
    else:
        print("\n".join([f"{k}: {v}" for k, v in result.items() if k != "field_accuracy"] + [f"  {k}: {v}" for k, v in result["field_accuracy"].items()]))
    return 0


def score(rows, context: int | str = 0):
    """evaluate() over rows of doc_id (a row's own), text, expected (array of maps); context: sentences to both sides, or the column that has them."""
    expected = rows.select("doc_id", F.posexplode("expected").alias("n", "values"))
    c = extract_candidates(rows, context=context)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.substring("candidate_id", 5, 20).cast("long"))) - 1
    predicted = c.select("doc_id", place.alias("n"), F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f).cast("string"))]).alias("values"))
    return evaluate(rows, expected, predicted)


if __name__ == "__main__":
    raise SystemExit(main())
