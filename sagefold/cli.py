"""The command line: ``python -m sagefold.cli COMMAND ...``.

digest RAW OUT        raw pages to units and chunks
estimate CHUNKS       what their extraction costs
export REPORT DEST    files from a report's rules
status GENERATIONS    what is done and what is pending
queries SF_DIR NAME   a query of the catalogue
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import cost, digest, ledger
from .plans import catalogue
from .sources import raw, sinks
from .vocabulary import TIERS
from .workspace import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sagefold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    d = commands.add_parser("digest")
    d.add_argument("raw")
    d.add_argument("out")
    d.add_argument("--chunk-tokens", type=_chunk_tokens, default=digest.CHUNK_TOKENS)
    d.add_argument("--include-bots", action="store_true")
    e = commands.add_parser("estimate")
    e.add_argument("chunks")
    e.add_argument("--model", default="default")
    e.add_argument("--prices", nargs=2, type=float, metavar=("INPUT", "OUTPUT"))
    e.add_argument("--ratio", type=float, default=1.0)
    e.add_argument("--direct", action="store_true")
    x = commands.add_parser("export")
    x.add_argument("report", help="Parquet table of rules")
    x.add_argument("dest")
    x.add_argument("--format", type=sinks.parse_formats, default=sinks.parse_formats("all"))
    x.add_argument("--min-tier", choices=TIERS, default="consider")
    x.add_argument("--repo")
    s = commands.add_parser("status")
    s.add_argument("generations")
    q = commands.add_parser("queries")
    q.add_argument("sf_dir")
    q.add_argument("name", choices=sorted(catalogue.queries()))
    return p


def _chunk_tokens(text: str) -> int:
    if int(text) < 4000:
        raise argparse.ArgumentTypeError("at least 4000")
    return int(text)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = local_session()
    if a.command == "digest":
        prs = digest.latest(raw.load_pages(spark, a.raw), ["number"])
        units, comments = digest.units(prs.drop("read_order"), a.include_bots)
        units.write.mode("overwrite").parquet(f"{a.out}/units")
        comments.select("pr", "ref", "url", "author", "role", "date", "body", "thumbs_up").write.mode("overwrite").parquet(f"{a.out}/refs")
        digest.chunks(spark.read.parquet(f"{a.out}/units"), a.chunk_tokens).write.mode("overwrite").parquet(f"{a.out}/chunks")
    elif a.command == "estimate":
        prices = spark.createDataFrame([(a.model, *a.prices)] if a.prices else [], "model string, input_price double, output_price double")
        cost.estimate(spark.read.parquet(a.chunks).withColumn("model", F.lit(a.model)), prices, [], a.ratio, not a.direct).show(truncate=False)
    elif a.command == "export":
        for path in sinks.export(spark.read.parquet(a.report), a.dest, a.format, a.repo, a.repo or "all repositories", a.min_tier):
            print(path)
    elif a.command == "status":
        ledger.status(spark.read.parquet(a.generations)).show()
    else:
        catalogue.queries()[a.name](spark, a.sf_dir).show(50, truncate=80)


if __name__ == "__main__":
    main()
