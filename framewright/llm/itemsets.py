"""Closed frequent itemsets of baskets and their rules, by minimal generators.

Level by level, sets that are smaller than all sets between them and nothing (no subset has the
same support) are counted; a set with a subset of equal support is no minimal generator, and
neither is any set that holds it, so it is pruned. Afterwards the closure of each generator is
the intersection of the baskets that hold it, made by ``bit_and`` of their item bitmaps where
the baskets lie. Different closures are the closed sets.

Only frequent items stay in the baskets. There are at most ``per`` times the mean basket's items
of them, whatever the number of baskets, as each is in a ``per``-th of all; that bounds what one
basket holds, however many rows it has. Equal baskets become one row with a weight. All counts are
Spark aggregates of (generator, basket) rows; no table of itemsets is collected or broadcast by
hand.

Rows with a null basket or item are left out, repeated rows count once, ties in ``best_item`` go
to the smaller id, and an empty table gives no rows. Columns beyond the two named are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

LONG = "long"


def basket_items(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item)."""
    return rows.select(F.col(basket).cast(LONG).alias("basket"), F.col(item).cast(LONG).alias("item")).filter("basket is not null and item is not null").distinct()


def frequent(counted: DataFrame, baskets: int, least: int, per: int) -> DataFrame:
    return counted.filter((F.col("support") >= least) & (F.col("support") * per >= baskets))


def weighted_baskets(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, items, weight): distinct sets of frequent items of the baskets, and how many have each."""
    kept = pairs.join(items.select("item"), "item", "left_semi").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return kept.groupBy("items").agg(F.count(F.lit(1)).alias("weight")).select(F.monotonically_increasing_id().alias("id"), "items", "weight")


def without(items: Column, one: Column) -> Column:
    return F.filter(items, lambda x: x != one)


def grown(held: DataFrame, size: int) -> DataFrame:
    """(id, weight, candidate): sets of ``size`` + 1 in a basket whose two subsets without one of the last two items are generators.

    A basket's generators of one prefix are one row; each joins those after it.
    """
    prefix = F.slice("generator", 1, size - 1) if size > 1 else F.array().cast("array<bigint>")
    rows = held.select("id", "weight", prefix.alias("prefix"), F.col("generator")[size - 1].alias("tail")).groupBy("id", "weight", "prefix").agg(F.sort_array(F.collect_list("tail")).alias("tails"))
    first = rows.filter(F.size("tails") > 1).select("id", "weight", "prefix", "tails", F.posexplode("tails").alias("place", "one"))
    later = first.select("id", "weight", "prefix", "one", F.explode(F.slice("tails", F.col("place") + 2, F.size("tails"))).alias("other"))
    return later.select("id", "weight", F.concat("prefix", F.array("one", "other")).alias("candidate"))


def minimal(counted: DataFrame, generators: DataFrame, size: int) -> DataFrame:
    """Those of (candidate, support) all of whose subsets of one item less are generators of greater support."""
    parts = counted.select("candidate", "support", F.explode("candidate").alias("one")).select("candidate", "support", without(F.col("candidate"), F.col("one")).alias("generator"))
    known = generators.select("generator", F.col("support").alias("of_subset"))
    kept = parts.join(known, "generator").filter("of_subset > support").groupBy("candidate", "support").agg(F.count(F.lit(1)).alias("n"))
    return kept.filter(F.col("n") == size + 1).select(F.col("candidate").alias("generator"), "support")


def minimal_generators(pairs: DataFrame, least: int, per: int) -> tuple[int, DataFrame, DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Number of baskets, supports of frequent items, weighted baskets, items that all baskets have, and for each level (generator, support) and (id, weight, generator)."""
    baskets = pairs.select("basket").distinct().count()
    items = shared_table(frequent(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("support")), baskets, least, per))
    table = shared_table(weighted_baskets(pairs, items))
    everywhere = items.filter(F.col("support") == baskets)
    generators = shared_table(items.filter(F.col("support") < baskets).select(F.array("item").alias("generator"), "support"))
    singles = table.select("id", "weight", F.explode("items").alias("item"))
    held = shared_table(singles.select("id", "weight", F.array("item").alias("generator")).join(generators.select("generator"), "generator", "left_semi"))
    levels = []
    while not generators.isEmpty():
        levels.append((generators, held))
        size = len(levels)
        candidates = grown(held, size)
        counted = frequent(candidates.groupBy("candidate").agg(F.sum("weight").alias("support")), baskets, least, per)
        found = shared_table(minimal(counted, generators, size))
        held = shared_table(candidates.withColumnRenamed("candidate", "generator").join(found.select("generator"), "generator", "left_semi").select("id", "weight", "generator"))
        generators = found
    return baskets, items, table, everywhere, levels


def closures(table: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(items, support): intersections of the baskets that hold each generator, each once.

    A basket's items are sparse bitmaps of 64 ids; a word that some holding basket lacks is empty in the intersection.
    """
    words = table.select("id", F.explode("items").alias("item")).groupBy("id", F.floor(F.col("item") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(item, 64) as int))")).alias("bits"))
    parts = []
    for generators, held in levels:
        met = held.join(words, "id").groupBy("generator", "word").agg(F.bit_and("bits").alias("bits"), F.sum("weight").alias("n"))
        parts.append(met.join(generators, "generator").filter("n = support"))
    each = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)
    rows = reduce(DataFrame.unionByName, parts).select("generator", "support", F.explode(F.transform(each, lambda b: F.col("word") * 64 + b)).alias("item"))
    return rows.groupBy("generator", "support").agg(F.sort_array(F.collect_list("item")).alias("items")).select("items", "support").distinct()


def basket_rules(closed: DataFrame, items: DataFrame, baskets: int, percent: int) -> DataFrame:
    """(items, item, rest, support_of) of rules: an item c follows from the rest of a closed set.

    The rest's support is that of its closure, the greatest of the closed sets that hold it; they
    are looked up by the rest's rarest item.
    """
    one = items.select("item", F.col("support").alias("s"))
    flat = closed.select("items", "support", F.explode("items").alias("item")).join(one, "item")
    rare = flat.groupBy("items", "support").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "item"))), 1, 2).alias("rare"))
    split = flat.join(rare.select("items", "rare"), "items").filter(F.size("items") > 1)
    rests = split.select("items", "support", "item", "s", without(F.col("items"), F.col("item")).alias("rest"), F.when(F.col("rare")[0]["item"] == F.col("item"), F.col("rare")[1]["item"]).otherwise(F.col("rare")[0]["item"]).alias("by"))
    holders = closed.select(F.col("items").alias("holder"), F.col("support").alias("a"), F.explode("items").alias("by"))
    met = rests.join(holders, "by").filter(F.size(F.array_except("rest", "holder")) == 0).groupBy("items", "support", "item", "s").agg(F.max("a").alias("a"))
    return met.filter((100 * F.col("support") >= percent * F.col("a")) & (F.col("support") * baskets > F.col("a") * F.col("s")))


def frequent_itemsets(rows: DataFrame, basket: str, item: str, least: int = 8, per: int = 2000, percent: int = 10) -> DataFrame:
    """(items array, support, rules array of (item, a, s)) of every closed itemset that is frequent.

    Frequent: in at least ``least`` baskets and one of ``per``. A rule's confidence is at least
    ``percent`` of 100 and its lift above 1. ``rules`` are in order of their item.
    """
    pairs = shared_table(basket_items(rows, basket, item))
    baskets, items, table, everywhere, levels = minimal_generators(pairs, least, per)
    # the empty set is the generator of what all baskets have
    of_all = everywhere.agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("support").alias("support")).filter("support is not null")
    closed = shared_table(closures(table, levels).unionByName(of_all).distinct() if levels else of_all)
    rules = basket_rules(closed, items, baskets, percent).groupBy("items").agg(F.sort_array(F.collect_list(F.struct("item", "a", "s"))).alias("rules"))
    none = F.array().cast("array<struct<item:bigint,a:bigint,s:bigint>>")
    return closed.join(rules, "items", "left").select("items", "support", F.coalesce("rules", none).alias("rules"))
