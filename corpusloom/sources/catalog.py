"""What corpora there are: local files, remote entries, versions and categories."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATTERN = "data/train-parts/*.*.gz"
#: Categories that a new mapping has.
CATEGORIES = ("clean", "medium", "dirty")


def list_files(spark: SparkSession, pattern: str = PATTERN) -> DataFrame:
    """(path, size) of the files that match, hidden ones left out; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", F.col("length").alias("size"))
    return found.where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def group_files(files: DataFrame, root: str = "") -> DataFrame:
    """Corpora (name, files) from (path, size): files `<name>.<language>.gz` with one name; `files` is an
    array of (lang, path, size) in order of paths."""
    inside = F.col("path") if not root else F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}\E/", "")
    named = files.select(
        F.regexp_extract(inside, r"^(.*)\.([^./]+)\.gz$", 1).alias("name"),
        F.struct("path", F.regexp_extract(inside, r"^(.*)\.([^./]+)\.gz$", 2).alias("lang"), "size").alias("file"),
    ).where("name <> ''")
    files_in_order = F.array_sort(F.collect_list("file"))
    return named.groupBy("name").agg(F.transform(files_in_order, lambda f: F.struct(f["lang"], f["path"], f["size"])).alias("files"))


def dataset_path(name: str, template: str = PATTERN) -> str:
    """Where a corpus `name` (of one folder level at most) has its files."""
    if name.count("/") > 1 or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"not a corpus name: {name!r}")
    return posixpath.join(posixpath.dirname(template), posixpath.basename(name) if "*" not in posixpath.dirname(template) else name)


def recipe_path(name: str, template: str = PATTERN) -> str:
    return dataset_path(name, template) + ".filters.json"


def sample_path(name: str, langs: Sequence[str], template: str = PATTERN) -> str:
    folder, base = posixpath.split(dataset_path(name, template))
    return posixpath.join(folder, f".sample.{base}.{'.'.join(sorted(langs))}")


ENTRY = "id bigint, corpus string, version string, source string, target string, alignment_pairs string, size bigint, url string"


def entries_from_json(lines: DataFrame, column: str = "value", local: Sequence[str] = ()) -> DataFrame:
    """Remote entries from JSON: langs without the empty ones, pairs (null if ''), size in bytes (it comes
    in KiB), basename, and whether it is in `local`, the names of corpora that are here."""
    e = lines.select(F.from_json(column, ENTRY).alias("e")).select("e.*")
    langs = F.filter(F.array("source", "target"), lambda x: F.coalesce(x, F.lit("")) != "")
    out = e.select(
        "id", "corpus", "version", langs.alias("langs"),
        F.expr("try_cast(nullif(alignment_pairs, '') as bigint)").alias("pairs"),
        (F.col("size") * 1024).alias("size"), "url",
    )
    name = F.concat(F.col("corpus"), F.lit("-"), F.col("version"), F.lit("."), F.array_join("langs", "-"))
    return out.withColumn("basename", name).withColumn("is_local", F.col("basename").isin(list(local)) if local else F.lit(False))


def latest_versions(entries: DataFrame, keys: Sequence[str] = ("corpus", "langs")) -> DataFrame:
    """The entry with the greatest version, as text, of each corpus; of equal ones the smallest id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("version"), "id")
    return entries.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


#: Orders of a list of entries.
ORDERS = {"corpus": (F.asc, "corpus"), "size": (F.desc_nulls_last, "size"), "pairs": (F.desc_nulls_last, "pairs")}


def list_entries(
    entries: DataFrame, name: str = "", kind: str | None = None, downloadable: bool = False, latest: bool = True, order: str = "corpus"
) -> DataFrame:
    """Entries with `name` in the corpus' name, whatever the case; kind: bilingual or monolingual."""
    found = latest_versions(entries) if latest else entries
    if name:
        found = found.where(F.lower("corpus").contains(name.lower()))
    if kind:
        found = found.where(F.size("langs") > 1 if kind == "bilingual" else F.size("langs") == 1)
    if downloadable:
        found = found.where(~F.col("is_local"))
    how, column = ORDERS[order]
    return found.orderBy(how(column), "id")


def check_categories(data: dict) -> dict:
    """A mapping {categories: [{name}], mapping: {category: [corpus]}} with trimmed, non-empty, different
    names; anything else is an error."""
    names = [c["name"].strip() for c in data.get("categories", [{"name": n} for n in CATEGORIES])]
    if not all(names) or len(set(names)) != len(names):
        raise ValueError("categories need different, non-empty names")
    mapping = data.get("mapping", {})
    unknown = set(mapping) - set(names)
    if unknown:
        raise ValueError(f"no such category: {', '.join(sorted(unknown))}")
    return {"categories": [{"name": n} for n in names], "mapping": mapping}


def categories(spark: SparkSession, text: str) -> DataFrame:
    """(category, corpus) of a mapping in JSON."""
    data = check_categories(json.loads(text))
    rows = [(c, name) for c, names in data["mapping"].items() for name in names]
    return spark.createDataFrame(rows, "category string, corpus string")


def in_category(corpora: DataFrame, members: DataFrame, name: str = "name") -> DataFrame:
    """Corpora with the categories they are in."""
    of = members.groupBy("corpus").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    joined = corpora.join(of.withColumnRenamed("corpus", name), name, "left")
    return joined.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def recipe_json(steps: DataFrame) -> DataFrame:
    """Rows as compact JSON lines."""
    return steps.select(F.to_json(F.struct(*steps.columns)).alias("value"))


def entry_of(corpora: DataFrame, entries: DataFrame, name: str = "name") -> DataFrame:
    """Each corpus with the remote entry whose basename it has (the smallest id of several). A name that no entry
    has is an error when the row is read."""
    first = entries.groupBy("basename").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "basename"]), "id").alias("entry"))
    joined = corpora.join(first, F.col(name) == F.col("basename"), "left").drop("basename")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.col(name)))
    return joined.withColumn("entry", F.when(F.col("entry").isNull(), missing).otherwise(F.col("entry")))
