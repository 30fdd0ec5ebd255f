"""The graph of who calls whom by name, and units that nobody calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolot.functions import measures

#: Comments that keep a unit from being reported, in lower case.
MARKERS = ("noqa: echolot", "echolot: ignore")


def suffix_index(names: DataFrame) -> DataFrame:
    """(key, unit_id) of every dotted suffix of a qualified name, and of the bare name."""
    keys = F.array_distinct(F.concat(measures.suffixes(F.col("qualified_name")), F.array("name")))
    return names.select(F.explode(keys).alias("key"), "unit_id")


def resolved(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """calls (file_path, call, ...) with a column target: the call, what it is an alias of, and it with its head so replaced."""
    head, tail = F.substring_index("call", ".", 1), F.expr("substring(call, instr(call, '.') + 1)")
    whole = aliases.select("file_path", F.col("alias").alias("call"), F.col("target").alias("whole"))
    part = aliases.select("file_path", F.col("alias").alias("head"), F.col("target").alias("part"))
    both = calls.join(whole, ["file_path", "call"], "left").withColumn("head", F.when(F.col("call").contains("."), head)).join(part, ["file_path", "head"], "left")
    targets = F.array_distinct(F.array_compact(F.array("call", "whole", F.when(F.col("part").isNotNull(), F.concat("part", F.lit("."), tail)))))
    return both.withColumn("target", F.explode(targets)).drop("whole", "head", "part")


def aliases_of(facts: DataFrame) -> DataFrame:
    return facts.where("aliases is not null").select("file_path", F.explode("aliases").alias("alias", "target"))


def references(units: DataFrame, facts: DataFrame, entry_points: list[str] = ()) -> DataFrame:
    """(unit_id, source): who refers to a unit; of calls, of main blocks in files with units, and of installed scripts."""
    index, aliases = suffix_index(units), aliases_of(facts)
    calls = units.select("file_path", F.col("uid").alias("source"), F.explode("calls").alias("call"))
    by_call = resolved(calls, aliases).join(index, F.col("target") == F.col("key")).join(units.select("unit_id", "uid"), "unit_id").where("uid <> source").select("unit_id", "source")
    with_units = units.select("file_path").distinct()
    main = facts.where("main_calls is not null").join(with_units, "file_path", "left_semi").select("file_path", F.concat(F.lit("__main__::"), F.col("file_path")).alias("source"), F.explode("main_calls").alias("call"))
    by_main = resolved(main, aliases).join(index, F.col("target") == F.col("key")).select("unit_id", "source")
    found = by_call.unionByName(by_main)
    if entry_points:
        found = found.unionByName(index.where(F.col("key").isin(list(entry_points))).select("unit_id", F.lit("project.entrypoint").alias("source")))
    return found.distinct()


def unused(units: DataFrame, refs: DataFrame, strict: bool = False, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Units that nothing refers to and that no rule excuses."""
    name, source = F.col("name"), F.col("source")
    reported = ~measures.likely_api(name, F.col("kind"), F.col("is_public"), F.col("is_dunder"), F.col("is_exported"))
    reported &= ~(name.startswith("get_") | name.startswith("set_") | name.startswith("test_") | (name == "__init__"))
    reported &= ~(source.contains("@abstractmethod") | source.contains("@abc.abstractmethod"))
    reported &= ~F.element_at(F.split("file_path", "/"), -1).contains("_test")
    for m in markers:
        reported &= ~F.lower(source).contains(m)
    if not strict:
        reported &= ~((F.col("kind") == "function") & F.col("is_public"))
    return units.where(reported).join(refs.select("unit_id").distinct(), "unit_id", "left_anti")
