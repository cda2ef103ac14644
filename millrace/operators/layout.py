"""Layout spans (doc, seq, text, x0, y0, x1, y1) to entities: names, armour, weapons, missiles, grids, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def xc() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def yc() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def is_number() -> Column:
    return F.col("text").rlike(r"^\d+$")


def first_unit(spans: DataFrame) -> DataFrame:
    """The spans with text that end above height 265: those of the first unit of a sheet. The functions below take these."""
    return spans.withColumn("text", F.trim("text")).filter((F.col("text") != "") & (F.col("y1") < fixed.UNIT_HEIGHT))


def names(spans: DataFrame) -> DataFrame:
    """doc and name: the leftmost span to the right of the first with `Type:` and at most 10 off its height."""
    mark = spans.filter(F.col("text").contains("Type:")).groupBy("doc").agg(F.min_by(F.struct("x1", yc().alias("yc")), "seq").alias("t"))
    near = spans.join(mark, "doc").filter((F.abs(yc() - F.col("t.yc")) < 10) & (F.col("x0") > F.col("t.x1")))
    return near.groupBy("doc").agg(F.min_by("text", F.struct("x0", "seq")).alias("name"))


def thrust(spans: DataFrame) -> DataFrame:
    """doc and max_thrust: the first number with x0 > 530 and y0 > 160, where a span says Maximum, or Thrust far right."""
    said = F.col("text").contains("Maximum") | (F.col("text").contains("Thrust") & (F.col("x0") > 500))
    number = is_number() & (F.col("x0") > 530) & (F.col("y0") > 160)
    return spans.groupBy("doc").agg(F.bool_or(said).alias("said"), F.min_by(F.when(number, F.col("text").try_cast("int")), F.when(number, F.col("seq"))).alias("max_thrust")).filter("said and max_thrust is not null").select("doc", "max_thrust")


def armour(spans: DataFrame) -> DataFrame:
    """doc, facing, sf, width and depth: the first number between heights 15 and 35 whose centre is in the facing's range,
    or 0."""
    number = is_number() & (F.col("y0") > 15) & (F.col("y0") < 35)
    inside = {name: number & xc().between(lo, hi) for name, lo, hi in fixed.FACINGS}
    first = [F.min_by(F.when(own, F.col("text").try_cast("int")), F.when(own, F.col("seq"))).alias(name) for name, own in inside.items()]
    every = F.array(*(F.struct(F.lit(name).alias("facing"), F.coalesce(name, F.lit(0)).alias("sf")) for name in inside))
    return spans.groupBy("doc").agg(*first).select("doc", F.explode(every).alias("f")).select("doc", "f.facing", "f.sf")


def weapons(spans: DataFrame) -> DataFrame:
    """doc, row, half, name, location, damage and range of rows between heights 215 and 265, by halves of the page."""
    half = F.when(xc() < 190, 1).when((xc() > 190) & (xc() < 340), 2)
    rows = spans.filter((F.col("y0") > 215) & (F.col("y0") < 265)).withColumns({"row": (F.bround(yc() / 5) * 5).cast("int"), "half": half})
    wide = rows.groupBy("doc", "row").agg(F.count("*").alias("n"), F.collect_list(F.struct("x0", "seq", "text", "half")).alias("all")).filter("n >= 3")
    each = wide.select("doc", "row", F.explode(F.array(F.lit(1), F.lit(2))).alias("half"), "all")
    own = F.array_sort(F.filter("all", lambda s: s["half"] == F.col("half")))
    at = lambda i: F.get("own", F.lit(i))["text"]
    named = each.withColumn("own", own).filter((F.size("own") >= 3) & ~at(0).rlike(r"^\d+$"))
    return named.select("doc", "row", "half", at(0).alias("name"), at(1).alias("location"), at(2).alias("damage"), F.coalesce(at(3), F.lit("N/A")).alias("range"))


def missiles(spans: DataFrame) -> DataFrame:
    kind = F.trim(F.replace("text", F.lit("Missile"), F.lit("")))
    rows = spans.filter((F.col("x0") < 60) & (F.col("y0") > 30) & (F.col("y0") < 150)).select("doc", kind.alias("type")).filter("type <> ''").distinct()
    return rows.withColumn("count", F.when(F.col("type").contains("TVLG"), 4).otherwise(1))


def grid(spans: DataFrame, x_min: float, x_max: float, width: int, depth: int = 10) -> DataFrame:
    """doc, column and cells: the texts that cover the column from top to bottom, filled up with Empty to `depth`."""
    step = (x_max - x_min) / width
    inside = spans.filter((yc() > 115) & (yc() < 200) & ~is_number() & xc().between(x_min - 10, x_max + 10))
    whole = lambda c: (((c - x_min) / step).cast("int"))
    first = F.least(F.greatest(whole(F.col("x0")), F.lit(0)), F.lit(width - 1))
    last = F.greatest(F.least(whole(F.col("x1")), F.lit(width - 1)), first)
    cells = inside.select("doc", yc().alias("yc"), "seq", "text", F.explode(F.sequence(first, last)).alias("column"))
    filled = cells.groupBy("doc", "column").agg(F.array_sort(F.collect_list(F.struct("yc", "seq", "text"))).alias("c"))
    every = spans.select("doc").distinct().withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    texts = F.coalesce(F.transform("c", lambda x: x["text"]), F.array().cast("array<string>"))
    return every.join(filled, ["doc", "column"], "left").select("doc", "column", F.slice(F.concat(texts, F.array_repeat(F.lit("Empty"), depth)), 1, depth).alias("cells"))


def entities(spans: DataFrame) -> DataFrame:
    """One row for each sheet (doc) that has spans of a first unit: entity_type, name, attributes, grids, and its weapons and
    missiles."""
    own = first_unit(spans)
    armoured = armour(own).select("doc", "facing", F.struct(F.col("sf").alias("SF"), F.lit(10).alias("Width"), F.col("sf").alias("Depth"), F.lit(None).cast("array<array<string>>").alias("Columns")).alias("g"))
    kind = armoured.schema["g"].dataType.simpleString()
    inside = [grid(own, a, b, w).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "cells"))), lambda c: c["cells"]).alias("c")).select("doc", F.lit(name).alias("facing"), F.struct(F.lit(None).cast("int").alias("SF"), F.lit(w).alias("Width"), F.lit(None).cast("int").alias("Depth"), F.col("c").alias("Columns")).cast(kind).alias("g")) for name, a, b, w in fixed.GRIDS]
    for g in inside:
        armoured = armoured.unionByName(g)
    grids = armoured.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("facing", "g")), lambda x, y: F.when(x["facing"] < y["facing"], -1).otherwise(1))).alias("grids"))
    arms = weapons(own).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "half", "name", "location", "damage", "range"))), lambda w: F.struct(w["name"].alias("Name"), w["location"].alias("Location"), w["damage"].alias("Damage"), w["range"].alias("Range"))).alias("Weapons"))
    rockets = missiles(own).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("type", "count"))), lambda m: F.struct(m["type"].alias("Type"), m["count"].alias("Count"))).alias("Missiles"))
    rows = own.select("doc").distinct().join(names(own), "doc", "left").join(thrust(own), "doc", "left").join(grids, "doc", "left").join(arms, "doc", "left").join(rockets, "doc", "left")
    attributes = F.when(F.col("max_thrust").isNotNull(), F.create_map(F.lit("Maximum Thrust"), F.col("max_thrust").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    none = {"Weapons": "array<struct<Name:string,Location:string,Damage:string,Range:string>>", "Missiles": "array<struct<Type:string,Count:int>>"}
    return rows.select("doc", F.lit("vehicle").alias("entity_type"), F.coalesce("name", F.lit("Unknown")).alias("name"), attributes.alias("attributes"), "grids", F.struct(*(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items())).alias("collections"))


def entity_text(name: Column, kind: Column, attributes: Column, grids: Column, arms: Column, rockets: Column) -> Column:
    """The entity as lines of text. attributes: map of strings; grids: map of struct SF, Width; arms: array of struct
    Name, Location, Damage, Range; rockets: array of struct Type, Count. Missing parts are left out."""
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n")))
    said = lambda c, other: F.coalesce(c.cast("string"), F.lit(other))
    a = F.transform(F.map_entries(attributes), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), said(e["value"], "None")))
    g = F.transform(F.map_entries(grids), lambda e: F.when(e["value"]["SF"].isNotNull(), F.concat(F.lit("- "), e["key"], F.lit(" has SF (Size Factor) "), said(e["value"]["SF"], ""), F.lit("."))).otherwise(F.concat(F.lit("- "), e["key"], F.lit(" is "), said(e["value"]["Width"], "?"), F.lit(" columns wide."))))
    w = F.transform(arms, lambda x: F.concat(F.lit("- "), said(x["Name"], "Weapon"), F.lit(" mounted on "), said(x["Location"], "Unknown"), F.lit(" (Damage: "), said(x["Damage"], "N/A"), F.lit(", Range: "), said(x["Range"], "N/A"), F.lit(")")))
    m = F.transform(rockets, lambda x: F.concat(F.lit("- "), said(x["Count"], "1"), F.lit("x "), said(x["Type"], "Missile")))
    first = F.concat(said(name, "Unknown Unit"), F.lit(" is a "), said(kind, "vehicle"), F.lit(" unit."))
    return F.concat_ws("\n", first, section("Attributes:", a), section("Armor and Grids:", g), section("Weapons:", w), section("Missiles:", m))
