"""URL filter: listed rules first, then a tree of path templates per host.

Urls are cut into host and path, and the path into segments. Segments that vary become wildcards
in two ways: by shape (digits are a number) and by spread (a node of the tree with many different
children, few urls each, is one wildcard). Siblings in order of their share of blocked labels are
merged with the next one where a test of two proportions can't tell them apart. The tree grows until
every node has urls of one shape only; segments that all urls of a node share are passed at once.

A template's purity is the share of blocked urls among its labelled ones, smoothed by the purity of the
node above it, that by the next one, and so on up to the host, its parent domain and the top domain.
A node hands down its purity for the share of its urls that have labels, and what it was handed for the
rest: where nearly all are labelled and blocked, the others are likely to be bad too; a few labels say
little about them. So branches without labels are judged by the evidence around them. A template of
high purity is rejected.
The tree is built on distinct (host, shape) rows with counts, not on the urls themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, cut

#: A host backs off to its domains of 1 to so many names.
DOMAINS = 8


@dataclass(frozen=True)
class Listed:
    """A listed rule: `rule` is host/path, for the host and its subdomains and paths that start so."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    Listed("block", "com/en/"),
    Listed("allow", "example.com/en/7"),
    Listed("allow", "net/de/"),
    Listed("block", "example.net/de/8"),
    Listed("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[Listed]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    """The path's segments with runs of digits as '<n>'."""
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "<n>"))


def joined(node: Column, segments: Column) -> Column:
    """The node's name with more segments."""
    return F.when(F.size(segments) > 0, F.concat(node, F.lit("/"), F.array_join(segments, "/"))).otherwise(node)


def rest_of(segments: Column, n: Column) -> Column:
    """What follows the first `n` segments."""
    return F.slice(segments, n + 1, F.greatest(F.size(segments) - n, F.lit(0)))


def steps_of(children: DataFrame, spread_children: int, spread_share: float, merge_z: float, min_labelled: int) -> DataFrame:
    """The step that each child (host, node, child, n, blocked, allowed) becomes: itself, `*` where children
    are spread, or `~k` for the k-th group of siblings with similar rates."""
    parents = children.groupBy("host", "node").agg(F.count("*").alias("children"), F.sum("n").alias("urls"))
    labelled = F.col("blocked") + F.col("allowed")
    compared = children.withColumn("labelled", labelled).where(F.col("labelled") >= min_labelled)
    compared = compared.withColumn("rate", F.col("blocked") / F.col("labelled"))
    siblings = Window.partitionBy("host", "node").orderBy("rate", "child")
    before = {name: F.lag(name).over(siblings) for name in ("blocked", "labelled", "rate")}
    both = (F.col("blocked") + before["blocked"] + 1) / (F.col("labelled") + before["labelled"] + 2)
    error = F.sqrt(both * (1 - both) * (1 / F.col("labelled") + 1 / before["labelled"]))
    new = F.coalesce(F.col("rate") - before["rate"] >= merge_z * error, F.lit(True))
    compared = compared.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(siblings))
    size = F.count("*").over(Window.partitionBy("host", "node", "group"))
    compared = compared.withColumn("size", size).where("size > 1").select("host", "node", "child", "group")
    spread = (F.col("children") >= spread_children) & (F.col("children") >= spread_share * F.col("urls"))
    step = F.when(spread, "*").when(F.col("group").isNotNull(), F.concat(F.lit("~"), "group")).otherwise(F.col("child"))
    named = children.join(compared, ["host", "node", "child"], "left").join(parents, ["host", "node"])
    return named.select("host", "node", "child", step.alias("step"))


def templates(
    shapes: DataFrame, spread_children: int = 20, spread_share: float = 0.2, merge_z: float = 1.96, min_labelled: int = 5
) -> DataFrame:
    """Path templates of the rows (host, shape, n, blocked, allowed): adds `node`, the template, and `trail`, the
    nodes above it from the root ("") on, itself included.

    Below each node: if it has `spread_children` or more different children, and they make up
    `spread_share` of its urls or more, they are one wildcard; else siblings with `min_labelled` labels
    each are merged with the next by rate where these differ by less than `merge_z` standard errors;
    other children stay themselves. Ties of rates go by the child's name. A node whose urls have one
    shape is a template.
    """
    tree = shapes.withColumns({"node": F.lit(""), "rest": F.col("shape"), "trail": F.array(F.lit("")), "done": F.lit(False)})
    while not tree.where("not done").isEmpty():
        growing = tree.where("not done")
        ends = growing.groupBy("host", "node").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        shared = F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")
        ends = ends.select("host", "node", F.when(F.col("low") == F.col("high"), F.size("low")).otherwise(shared).alias("shared"))
        moved = growing.join(ends, ["host", "node"])
        moved = moved.withColumn("node", joined(F.col("node"), F.slice("rest", F.lit(1), F.col("shared"))))
        moved = moved.withColumn("child", F.get("rest", F.col("shared"))).withColumn("rest", rest_of(F.col("rest"), F.col("shared") + 1))
        moved = cut(moved.withColumn("trail", F.array_union("trail", F.array("node"))).drop("shared"))
        children = moved.where("child is not null").groupBy("host", "node", "child").agg(
            F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")
        )
        named = steps_of(children, spread_children, spread_share, merge_z, min_labelled)
        stepped = moved.join(named, ["host", "node", "child"], "left").withColumn("done", F.col("child").isNull())
        node = F.when(F.col("done"), F.col("node")).otherwise(F.concat("node", F.lit("/"), "step"))
        stepped = stepped.withColumn("node", node).withColumn("trail", F.array_union("trail", F.array("node")))
        tree = cut(tree.where("done").unionByName(stepped.select(*tree.columns)))
    return tree.drop("rest", "done")


def handed_down(levels: Column, smoothing: float) -> Column:
    """The purity at the end of `levels` (blocked, labelled, n), from the widest to the narrowest."""
    start = F.struct(F.lit(0.0).alias("purity"), F.lit(0.0).alias("down"))

    def narrower(above: Column, x: Column) -> Column:
        purity = (x["blocked"] + F.lit(float(smoothing)) * above["down"]) / (x["labelled"] + F.lit(float(smoothing)))
        covered = x["labelled"] / F.greatest(x["labelled"], x["n"], F.lit(1))
        return F.struct(purity.alias("purity"), (purity * covered + above["down"] * (1 - covered)).alias("down"))

    return F.aggregate(levels, start, narrower)["purity"]


def purities(tree: DataFrame, smoothing: float) -> DataFrame:
    """(host, shape, node, blocked, labelled, smoothed_purity) of the rows of `templates`."""
    counted = tree.withColumn("labelled", F.col("blocked") + F.col("allowed"))
    sums = [F.sum(c).alias(c) for c in ("blocked", "labelled", "n")]
    hosts = counted.groupBy("host").agg(*sums)
    names = F.split("host", "[.]", -1)
    wider = F.sequence(F.lit(1), F.least(F.size(names), F.lit(DOMAINS)))
    placed = hosts.withColumn("k", F.explode(wider)).withColumn("domain", F.expr("substring_index(host, '.', -k)"))
    domains = placed.groupBy("domain").agg(*sums)
    level = F.struct("k", "blocked", "labelled", "n")
    above = placed.select("host", "k", "domain").join(domains, "domain").groupBy("host").agg(F.array_sort(F.collect_list(level)).alias("above"))
    nodes = counted.select("host", "blocked", "labelled", "n", F.explode("trail").alias("node")).groupBy("host", "node").agg(*sums)
    leaves = counted.select("host", F.col("node").alias("leaf"), "trail").distinct()
    depth = leaves.select("host", "leaf", F.posexplode("trail").alias("k", "node")).join(nodes, ["host", "node"])
    depth = depth.groupBy("host", "leaf").agg(F.array_sort(F.collect_list(level)).alias("within"))
    judged = depth.join(above, "host").withColumn("smoothed_purity", handed_down(F.concat("above", "within"), smoothing))
    last = F.element_at("within", -1)
    judged = judged.select("host", F.col("leaf").alias("node"), last["blocked"].alias("blocked"), last["labelled"].alias("labelled"), "smoothed_purity")
    return tree.select("host", "shape", "node").join(judged, ["host", "node"])


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Listed] = RULES,
    labels: DataFrame | None = None,
    label_url_col: str = "url",
    label_col: str = "verdict",
    smoothing: float = 4.0,
    purity: float = 0.6,
) -> DataFrame:
    """A verdict, block or allow, on each row of `pages`.

    Returns id_col, host, path, rule (the longest listed rule that fits, else null), verdict,
    template (of the path, within its host), labelled, blocked (labels of that template) and
    smoothed_purity, which has the evidence of the nodes and domains above in it. A listed rule
    decides; else a template is blocked if its smoothed purity reaches `purity`. Labels are the urls
    that listed rules decide and those of `labels` (url, block or allow; others and null are ignored).
    A null url, or one without ://, has an empty host and path, and these share a template. Rows may
    repeat; each is judged. An empty table gives an empty result.
    """
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")

    def parsed(df: DataFrame, url: str, *more: Column) -> DataFrame:
        cutting = df.select(*more, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        listed = listed_rule(F.col("host"), F.col("path"), rules)
        return cutting.withColumn("shape", shape_of(F.col("path"))).withColumn("listed", listed)

    rows = parsed(pages, url_col, F.col(id_col).alias("id"))
    label = F.col("listed.verdict")
    marked = rows.select("host", "shape", F.lit(1).alias("n"), label.alias("label"))
    if labels is not None:
        more = parsed(labels, label_url_col, F.col(label_col).alias("label"))
        marked = marked.union(more.select("host", "shape", F.lit(0), "label"))
    shapes = cut(
        marked.groupBy("host", "shape").agg(
            F.sum("n").alias("n"),
            F.count(F.when(F.col("label") == "block", 1)).alias("blocked"),
            F.count(F.when(F.col("label") == "allow", 1)).alias("allowed"),
        )
    )
    judged = cut(purities(templates(shapes), smoothing))
    method = F.when(F.col("smoothed_purity") >= purity, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"]).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", method).alias("verdict"),
        F.col("node").alias("template"),
        "labelled",
        "blocked",
        "smoothed_purity",
    )
