"""Command line: run recipes, look at samples, list filters and corpora."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from corpusloom.operators import REGISTRY
from corpusloom.operators.sampling import first_lines, sample
from corpusloom.plans.pipeline import Pipeline
from corpusloom.sources import catalog, corpus


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a recipe")
    run.add_argument("recipe")
    run.add_argument("--input", help="tab-separated lines; else the recipe's files")
    run.add_argument("--output", required=True)
    run.add_argument("--languages", nargs="*", default=[])
    run.add_argument("--first", type=int, help="only so many lines")
    run.add_argument("--tee", help="a folder for what each step leaves")
    look = commands.add_parser("sample", help="head, middle and tail of a corpus")
    look.add_argument("files", nargs="+")
    look.add_argument("-n", type=int, default=10)
    listing = commands.add_parser("list", help="corpora")
    listing.add_argument("pattern", nargs="?", default=catalog.PATTERN)
    filters = commands.add_parser("filters", help="filters and their parameters")
    filters.add_argument("name", nargs="?", default="")
    export = commands.add_parser("export", help="a recipe in another form")
    export.add_argument("recipe")
    export.add_argument("--form", choices=("yaml", "shell", "json"), default="yaml")
    step = commands.add_parser("step", help="one step over lines from standard input, for small texts")
    step.add_argument("step")
    step.add_argument("--languages", nargs="*", default=["src", "trg"])
    return out


def languages_of(files: list[str]) -> list[str]:
    return [f.rsplit("/", 1)[-1].rsplit(".", 2)[-2] for f in files]


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "filters":
        print(json.dumps([s.describe() for s in REGISTRY.find(args.name)], ensure_ascii=False, indent=2))
        return 0
    if args.command == "export":
        with open(args.recipe, encoding="utf-8") as file:
            recipe = Pipeline.from_json(file.read())
        print({"yaml": recipe.to_yaml, "shell": recipe.to_shell, "json": recipe.to_json}[args.form]())
        return 0
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if args.command == "run":
        with open(args.recipe, encoding="utf-8") as file:
            recipe = Pipeline.from_json(file.read())
        langs = args.languages or languages_of(recipe.files)
        df = corpus.read_tsv(spark, args.input, langs) if args.input else corpus.read_parallel(spark, dict(zip(langs, recipe.files, strict=True)))
        df = df if args.first is None else first_lines(df, args.first)
        if args.tee:
            for k, (_, left) in enumerate(recipe.trail(df, langs)):
                corpus.write_tsv(left, f"{args.tee}/step-{k}", langs)
        corpus.write_tsv(recipe.run(df, langs), args.output, langs)
    elif args.command == "sample":
        df = corpus.read_parallel(spark, {f"c{k}": f for k, f in enumerate(args.files)}, pad=False)
        for row in sample(df, args.n).drop("line_no").toLocalIterator():
            print("\t".join(row))
    elif args.command == "list":
        for row in catalog.group_files(catalog.list_files(spark, args.pattern)).orderBy("name").toLocalIterator():
            print(row["name"], *[f["lang"] for f in row["files"]], sep="\t")
    elif args.command == "step":
        recipe = Pipeline.from_json([json.loads(args.step)])
        rows = [(k, *line.rstrip("\r\n").split("\t")) for k, line in enumerate(sys.stdin)]
        df = spark.createDataFrame(rows, ", ".join(["line_no long", *[f"`{c}` string" for c in args.languages]]))
        for row in recipe.run(df, args.languages).orderBy("line_no").select(*args.languages).toLocalIterator():
            print("\t".join(row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
