"""What a name in a module stands for: definitions, renamed imports, re-exports and star exports, to their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.operators.scratch import Scratch

_KEY = ["module", "name"]


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A merge join at every size: names grow with the modules, and a broadcast would take them through the driver each round."""
    return left.join(right.hint("merge"), on, how)


def alias_ends(aliases: DataFrame, scratch: Scratch) -> DataFrame:
    """(module, name, to_module, to_name): where a chain of aliases ends; chains that end in a cycle have no end.

    Pointer doubling: each round joins the aliases with themselves, so a chain of n takes log(n) rounds. A
    pointer that still stands at an alias after as many rounds as the number of aliases has bits runs in a cycle.
    """
    links = scratch.keep(aliases.groupBy(*_KEY).agg(F.min(F.struct("to_module", "to_name")).alias("x")).select(*_KEY, "x.to_module", "x.to_name"))
    for _ in range(links.count().bit_length()):
        on = links.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("to_module").alias("_m"), F.col("to_name").alias("_n"))
        j = _met(links, on, ["to_module", "to_name"], "left")
        moved = scratch.keep(j.select(*_KEY, F.coalesce("_m", "to_module").alias("to_module"), F.when(F.col("_m").isNull(), F.col("to_name")).otherwise(F.col("_n")).alias("to_name"), F.col("_m").isNotNull().alias("_moved")))
        done = moved.where("_moved").isEmpty()
        scratch.drop(links)
        links = moved.drop("_moved")
        if done:
            break
    heads = aliases.select(F.col("module").alias("to_module"), F.col("name").alias("to_name")).distinct()
    return scratch.keep(_met(links, heads, ["to_module", "to_name"], "left_anti"))


def star_closure(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """(module, source, steps): all modules whose names a module offers by stars, with the fewest steps; pairs are doubled until none is new or shorter."""
    pairs = scratch.keep(stars.where("module <> source").select("module", "source", F.lit(1).alias("steps")).distinct())
    while True:
        far = _met(pairs, pairs.select(F.col("module").alias("source"), F.col("source").alias("_s"), F.col("steps").alias("_k")), ["source"]).where("module <> _s")
        more = scratch.keep(pairs.unionByName(far.select("module", F.col("_s").alias("source"), (F.col("steps") + F.col("_k")).alias("steps"))).groupBy("module", "source").agg(F.min("steps").alias("steps")))
        sign = lambda p: tuple(p.agg(F.count("*"), F.sum("steps")).first())
        if sign(more) == sign(pairs):
            return more
        scratch.drop(pairs)
        pairs = more


def resolved_names(defs: DataFrame, aliases: DataFrame, stars: DataFrame) -> DataFrame:
    """(module, name, node): what each name that a module offers stands for.

    defs: module, name, node. aliases: module, name, to_module, to_name (import and re-export, renamed or
    not). stars: module, source. A module's own definition comes before an alias, an alias before stars;
    of several stars the one with the fewest steps counts, then the smaller source. An alias can lead to
    a name that stars bring, and stars bring names that aliases resolve, so both are taken in turn until
    nothing is new. Names on cycles, or that lead nowhere, are left out; null modules and names too.
    """
    scratch = Scratch(defs.sparkSession, "symbols")
    own = defs.where("module is not null and name is not null").groupBy(*_KEY).agg(F.min("node").alias("node"))
    own = scratch.keep(own)
    a = _met(aliases.where("module is not null and name is not null and to_module is not null and to_name is not null"), own, _KEY, "left_anti")
    a = scratch.keep(a.select(*_KEY, "to_module", "to_name"))
    ends = alias_ends(a, scratch)
    reach = scratch.keep(star_closure(stars.where("module is not null and source is not null"), scratch))
    named = scratch.keep(own.select(*_KEY).unionByName(a.select(*_KEY)).distinct())
    known = own
    while True:
        # names by stars: not those that the module has of its own or by an alias
        by_star = _met(known.select(F.col("module").alias("source"), "name", "node"), reach, ["source"]).groupBy(*_KEY).agg(F.min_by("node", F.struct("steps", "source")).alias("node"))
        by_star = _met(by_star, named, _KEY, "left_anti")
        base = own.unionByName(by_star)
        by_alias = _met(ends, base.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), "node"), ["to_module", "to_name"]).select(*_KEY, "node")
        new = scratch.keep(base.unionByName(by_alias))
        sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("module", "name", "node").cast("decimal(38,0)"))).first())
        if sign(new) == sign(known):
            return new
        known = new
