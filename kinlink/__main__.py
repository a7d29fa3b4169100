"""python -m kinlink: normalise, block, infer and validate on files of any file system that Spark reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kinlink.operators import blocking, keys, sizing, validate
from kinlink.plans import inference
from kinlink.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinlink", description=__doc__)
    p.add_argument("--master", help="Spark master; by default what the session finds, or local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *extra: tuple) -> None:
        c = sub.add_parser(name, help=text)
        for flag, options in extra:
            c.add_argument(flag, **options)

    root, split = ("--root", {"required": True, "help": "folder of the splits' TSV files"}), ("--split", {"default": "test"})
    out, passes = ("--out", {"required": True}), ("--passes", {"nargs": "*", "choices": list(keys.PASSES), "help": "all by default"})
    command("normalise", "write the three normalised sources as Parquet", root, split, out)
    command("block", "write candidate pairs as Parquet", root, split, out, passes, ("--uniform", {"action": "store_true", "help": "default limits for all passes"}), ("--budget", {"type": int, "default": keys.MAX_TOTAL_PAIRS}))
    command("recall", "recall of each pass against the ground truth, as CSV", root, split, out, passes, ("--validation", {"action": "store_true"}))
    command("sizes", "size of each simple rule, as CSV", root, split, out, ("--most", {"type": int, "default": sizing.MOST}))
    command("infer", "from sources to both id lists", root, split, out, passes, ("--model", {}), ("--policy", {}), ("--budget", {"type": int, "default": keys.MAX_TOTAL_PAIRS}))
    command("validate", "check both id lists; exit code 1 if something is wrong", ("--matching", {"required": True}), ("--candidate", {"required": True}), ("--root", {}), split, ("--check-ids", {"action": "store_true", "help": "every id must be in S2 or S3"}))
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "validate":
        ids = lambda n: io.read_source(spark, args.root, args.split, n).select("entity_id")
        need = ids(1) if args.root else None
        known = ids(2).unionByName(ids(3)) if args.root and args.check_ids else None
        report = validate.validate(spark, args.matching, args.candidate, need, known)
        for line in report.warnings:
            print(f"warning: {line}")
        for line in report.errors:
            print(f"error: {line}")
        print("failed" if report.errors else "passed")
        return report.exit_code
    if args.command == "infer":
        done = inference.infer(spark, args.root, args.split, args.out, args.model, args.policy, args.passes, args.budget).head()
        print(f"{done.entities} entities, {done.matched} with a match")
        return 0
    if args.command == "recall":
        io.write_report(inference.blocking_report(spark, args.root, args.split, args.passes, args.validation), args.out)
        return 0
    met = inference.sides(spark, args.root, args.split, args.out if args.command == "normalise" else None)
    if args.command == "block":
        blocking.multipass(met.left, met.right, keys.passes(args.passes, args.uniform), budget=args.budget).write.mode("overwrite").parquet(args.out)
    elif args.command == "sizes":
        io.write_report(sizing.measured(met.left, met.right, most=args.most), args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"kinlink {args.command}")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(args, spark)
    except blocking.BudgetExceeded as e:
        print(f"error: {e}")
        return 1


if __name__ == "__main__":
    sys.exit(main())
