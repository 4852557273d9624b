"""Mixing sources to target weights.

The words of each source, laid end to end, are packed into blocks of a fixed length. A mix is a
list of slots, dealt into output shards of a fixed number of slots; each slot takes one block.
For each shard the numbers of slots of the sources are drawn from a multinomial: every slot draws its
source with the probability of the source's share of all slots. Independent draws miss the sources'
totals by about the square root of the slots; the draws of a source beyond its total, which lie in the
last shards, go to the sources that have too few. The k-th slot of a source takes, by a pseudorandom
permutation of the source's block numbers, one for each round through the source, its k-th block. Slots
and blocks meet in a join on (source, block number).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, cut, let

#: A source's words are numbered in so many runs, so a hot source is no single sort.
RUNS = 4096
#: Shards whose draws are summed before the sums are laid end to end.
SHARD_RUN = 1024
ROUNDS = 12


@dataclass(frozen=True)
class Mix:
    """sources: a row for each source (source, sid, weight, source_size, target, blocks, slots).
    documents: a row for each input row (doc_id, source, sid, row_key, copy, size, start).
    slots: a row for each slot (sid, shard, position, round, block, words)."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """The documents' parts of each block: `offset` words into the block, `length` words."""
        size = F.lit(self.block_words)
        docs = self.documents.where("size > 0")
        first, last = F.expr(f"start div {self.block_words}"), F.expr(f"(start + size - 1) div {self.block_words}")
        docs = docs.select("*", F.explode(F.sequence(first, last)).alias("block"))
        offset = F.greatest(F.col("start") - F.col("block") * size, F.lit(0))
        end = F.least(F.col("start") + F.col("size") - F.col("block") * size, size)
        return docs.select("*", offset.alias("offset"), (end - offset).alias("length"))

    def taken(self) -> DataFrame:
        """A row for each input row, with the number of its words in the mix, repeats counted, and the first
        output shard that has one of its blocks (null if it is not in the mix)."""
        whole = F.col("words").isNull()
        uses = self.slots.groupBy("sid", "block").agg(
            F.count(F.when(whole, 1)).alias("uses"), F.max("words").alias("part"), F.min("shard").alias("shard")
        )
        uses = uses.hint("merge")  # grows with the data, though it comes from the short list of sources
        part = F.coalesce(F.col("part"), F.lit(0))
        words = F.col("uses") * F.col("length") + F.greatest(
            F.least(part, F.col("offset") + F.col("length")) - F.col("offset"), F.lit(0)
        )
        counted = (
            self.pieces()
            .join(uses, ["sid", "block"], "left")
            .withColumn("words", F.coalesce(words, F.lit(0)))
            .groupBy("sid", "start", "doc_id", "source", "size", "source_size", "target")
            .agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("shard"))).alias("first_shard"))
        )
        names = ["doc_id", "source", "size", "source_size", "target", "taken", "first_shard"]
        empty = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long"))
        return counted.select(names).union(empty.select(names))

    def spans(self) -> DataFrame:
        """For each input row and round that takes words of it: `parts`, an array of (from, length),
        in words of the document, in order, and `shard` and `position`, its first place in the mix."""
        uses = self.slots.select("sid", "block", "round", "words", "shard", "position").hint("merge")
        end = F.least(F.col("offset") + F.col("length"), F.coalesce("words", F.lit(self.block_words)))
        at = F.col("block") * self.block_words + F.col("offset") - F.col("start")
        part = F.struct(at.alias("from"), (end - F.col("offset")).alias("length"))
        return (
            self.pieces()
            .join(uses, ["sid", "block"])
            .where(end > F.col("offset"))
            .groupBy("row_key", "copy", "size", "round")
            .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min(F.struct("shard", "position")).alias("place"))
            .select("row_key", "copy", "size", "round", "parts", "place.shard", "place.position")
        )


def permute(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 that depends on `key` (swap-or-not shuffle): each
    round pairs x with (k - x) mod n and swaps the pair or not by a hash of its larger member."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        coin = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(coin == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Targets of the sources in `sizes` (source, source_size).

    Sources in order of code points, null last, get the weights in turn, repeating. The targets
    share `share` times all words by weight; none exceeds `cap` times its source, and what that
    frees goes to the others by weight. Sorted by capacity over weight, the capped sources come
    first, and the level of the others is a running sum. The result has a row for each source: a
    list as long as that of the sources' names, in one task.
    """
    row = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("sid", row).withColumn("weight", F.element_at(turn, F.col("sid") % len(weights) + 1))
    ranked = ranked.withColumn("capacity", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("ratio", F.col("capacity") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(
        F.sum("capacity").over(before), F.lit(0.0)
    )
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", rest / weight)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    target = F.least("capacity", F.coalesce(level * F.col("weight"), F.col("capacity")))
    return ranked.withColumn("target", target).drop("capacity", "ratio", "level")


def key_of_row() -> Column:
    """A hash of what the mix reads of a row. Which columns are null is hashed too: a hash of columns passes over nulls."""
    columns = ("doc_id", "source", "text")
    return F.xxhash64(*[F.col(c).isNull() for c in columns], *columns)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 17,
) -> Mix:
    """Plan a mix of `docs` (doc_id, text, source; other columns are not read).

    A document without words (null, empty, blank) is in no block and is taken 0 times. A null
    source is a source; rows may repeat, and each counts. The draw depends on ids, texts, sources
    and `seed` alone, not on the partitioning, so reruns agree. An empty table gives empty plans.
    The last block of a source may be short, and the last slot of a source takes as many words of
    its block as the target still lacks; a source so misses its target by less than a block.
    """
    row_key = key_of_row()
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_key.alias("row_key"),
        )
    ).withColumn("run", F.pmod("row_key", F.lit(RUNS)))
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    sources = runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    sources = source_targets(sources, weights, share, cap)

    size = F.col("source_size")
    sources = sources.withColumn("blocks", F.ceil(size / block_words))
    sources = sources.withColumn("full", F.coalesce(F.floor(F.try_divide("target", size)), F.lit(0)))
    sources = sources.withColumn("rest", F.round(F.col("target") - F.col("full") * size).cast("long"))
    sources = sources.withColumn("partial", F.ceil(F.col("rest") / block_words))
    sources = cut(sources.withColumn("slots", F.col("full") * F.col("blocks") + F.col("partial")))

    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("run_size").over(before), F.lit(0))).alias("r")
    known = sources.select("source", "sid", "source_size", "target").alias("s")
    starts = runs.join(known, F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.source", "run", "run_start", "sid", "source_size", "target"
    )
    within = Window.partitionBy("source", "run").orderBy("row_key", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = Window.partitionBy("source", "run", "row_key").orderBy("doc_id", "size")
    placed = sized.withColumn("inside", inside).withColumn("copy", F.row_number().over(copies)).alias("d")
    same = F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.run") == F.col("t.run"))
    documents = placed.join(starts.alias("t").hint("merge"), same).select(
        "doc_id", "d.source", "sid", "row_key", "copy", "size", "source_size", "target",
        (F.col("run_start") + F.col("inside")).alias("start"),
    )

    slots = settled(drawn_slots(sources, shard_slots, seed), sources)
    # As many tasks as there are partitions: a slot has few bytes, but its permutation takes time.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = slots.repartition(tasks, "shard", "position")
    slots = slots.withColumn("round", F.expr("turn div blocks"))
    block = permute(F.col("turn") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "sid", "round"))
    short = F.col("rest") - (F.col("partial") - 1) * block_words
    last = (F.col("partial") > 0) & (F.col("turn") == F.col("slots") - 1)
    # Never null, and said so: a join would otherwise ask, and permute twice.
    block = F.coalesce(block, F.lit(-1).cast("long")).alias("block")
    slots = slots.select("sid", "shard", "position", "round", block, F.when(last, short).alias("words"))
    return Mix(sources, documents, slots, block_words)


OF_SOURCE = ("sid", "slots", "blocks", "rest", "partial")


def drawn_slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """A row for each slot of the mix: shard, position in it, the source that it draws (OF_SOURCE) and `rank`, the
    number of slots of the shard before it with that source. Each slot draws a number below that of all slots;
    the sources own as many numbers as they have slots."""
    upper = F.sum("slots").over(Window.partitionBy(F.lit(0)).orderBy("sid"))
    infos = F.sort_array(F.collect_list(F.struct(*OF_SOURCE, "upper"))).alias("infos")
    whole = sources.withColumn("upper", upper).agg(infos, F.sum("slots").alias("all_slots")).where("all_slots > 0")
    # A given number of partitions, as the single row of the seed grows into all slots.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = whole.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(all_slots - 1) div {shard_slots}"))))
    shards = shards.repartition(tasks, "shard")
    positions = F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots), F.col("all_slots") - F.col("shard") * shard_slots) - 1)
    slots = shards.withColumn("position", F.explode(positions))
    slots = slots.withColumn("number", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "position"), F.col("all_slots")))
    owner = F.element_at("infos", F.size(F.filter("infos", lambda s: s["upper"] <= F.col("number"))) + 1)
    slots = slots.select("shard", "position", owner.alias("s")).select("shard", "position", *[f"s.{c}" for c in OF_SOURCE])
    rank = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("position")) - 1
    return cut(slots.withColumn("rank", rank))


def settled(slots: DataFrame, sources: DataFrame) -> DataFrame:
    """The slots with `turn`, the number of slots of their source before them in the mix. Draws beyond a source's
    total go, in order, to the sources that have too few."""
    counts = slots.groupBy("sid", "shard").agg(F.count("*").alias("n")).withColumn("run", F.expr(f"shard div {SHARD_RUN}"))
    counts = cut(counts)
    runs = counts.groupBy("sid", "run").agg(F.sum("n").alias("run_n"))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_n").over(earlier), F.lit(0)))
    earlier = Window.partitionBy("sid", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(runs, ["sid", "run"])
    before = before.select("sid", "shard", (F.col("run_before") + F.col("inside")).alias("before"))
    placed = slots.join(before.hint("merge"), ["sid", "shard"]).withColumn("turn", F.col("before") + F.col("rank")).drop("before", "rank")

    # What each source has drawn too much or too little, laid end to end.
    drawn = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    every = sources.select(*OF_SOURCE).join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    line = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    every = cut(every.withColumn("over", F.coalesce(F.sum(over).over(line), F.lit(0))).withColumn("under", F.coalesce(F.sum(under).over(line), F.lit(0))))
    free = every.where("drawn < slots").withColumn("turn", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)))
    free = free.select(*OF_SOURCE, "turn", (F.col("under") + F.col("turn") - F.col("drawn")).alias("at"))
    surplus = placed.where("turn >= slots").select("sid", "shard", "position", "turn").join(every.select("sid", "slots", "over"), "sid")
    surplus = surplus.select("shard", "position", (F.col("over") + F.col("turn") - F.col("slots")).alias("at"))
    names = ["shard", "position", *OF_SOURCE, "turn"]
    return placed.where("turn < slots").select(names).union(surplus.join(free.hint("merge"), "at").select(names))


def mixed_documents(docs: DataFrame, place: bool = False, **options) -> DataFrame:
    """The mix as documents: a row for each input row and round that takes words of it, with the
    columns of `docs`. A document taken whole keeps its text; else `text` has the taken words,
    joined by single spaces, and `n_chars`, where there is one, its new length. With `place`, `mix_shard` and
    `mix_position` tell where in the mix a row begins.
    """
    plan = mix_sources(docs, **options)
    spans = plan.spans().select(
        F.col("row_key").alias("__key"), F.col("copy").alias("__copy"), F.col("size").alias("__size"), F.col("parts").alias("__parts"),
        F.col("shard").alias("__shard"), F.col("position").alias("__position"),
    )
    keyed = docs.withColumn("__key", key_of_row())
    keyed = keyed.withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns))))
    total = F.aggregate("__parts", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def cut_out(w: Column) -> Column:
        pieces = F.transform("__parts", lambda p: F.slice(w, (p["from"] + 1).cast("int"), p["length"].cast("int")))
        return F.array_join(F.flatten(pieces), " ")

    text = F.when(total == F.col("__size"), F.col("text")).otherwise(let(words, cut_out))
    joined = keyed.join(spans.hint("merge"), ["__key", "__copy"]).withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    more = [F.col("__shard").alias("mix_shard"), F.col("__position").alias("mix_position")] if place else []
    return joined.select(*docs.columns, *more)
