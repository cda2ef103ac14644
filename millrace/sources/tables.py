"""Sources and sinks: texts, tables, entities, and merges by key. All go through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LISTINGS = "id int, neighborhood string, room_type string, price decimal(10,2), rating decimal(3,1), review_text string"


def page_marked_texts(spark: SparkSession, folder: str, catalog: DataFrame | None = None) -> DataFrame:
    """source_file and text of each .txt file but those flagged by a file of the same name and `.duplicate`; of those in
    the catalog only, if given, without files whose cap is 0 pages."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.url_decode(name).alias("source_file"), F.col("value").alias("text"))
    marks = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.duplicate").load(folder).inputFiles()  # empty files have no rows
    flags = spark.createDataFrame([(x.rsplit("/", 1)[-1].removesuffix(".duplicate"),) for x in marks], "source_file string").select(F.url_decode("source_file").alias("source_file"))
    kept = texts.join(flags, "source_file", "left_anti")
    if catalog is None:
        return kept
    read = catalog.filter(F.coalesce("max_pages", F.lit(-1)) != 0) if "max_pages" in catalog.columns else catalog
    stem = lambda c: F.regexp_replace(c, r"\.(pdf|txt)$", "")
    return read.withColumn("__stem", stem(F.col("source_file"))).join(kept.select(stem(F.col("source_file")).alias("__stem"), "text"), "__stem").drop("__stem")


def pages(docs: DataFrame) -> DataFrame:
    """source_file, page and text from page-marked texts; a text without markers is page 1."""
    parts = F.split("text", r"(?m)^--- PAGE ")
    number = F.regexp_extract("part", r"^(\d+)", 1)
    each = docs.select("source_file", F.posexplode(parts).alias("k", "part"))
    body = F.when(F.col("k") > 0, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    return each.select("source_file", F.when(F.col("k") > 0, number.try_cast("int")).otherwise(1).alias("page"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("text"), "k").filter("k > 0 or text <> ''").drop("k")


def pages_of_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """As pages, of the text files of a folder, of which a large one is many tasks' work: a page is a record of the reader,
    which cuts a file by bytes and gives each task the pages that begin in its part. Markers stand at the beginnings of
    lines that end with a line feed, and have a number; what is before a file's first marker is page 1, if it isn't blank."""
    rows = spark.read.option("lineSep", "\n--- PAGE ").option("pathGlobFilter", glob).text(path)
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    # the first record of a file keeps its marker, the others have lost theirs
    part = F.regexp_replace("value", "^--- PAGE ", "")
    number = F.regexp_extract("part", r"^(\d+)[^\n]*---[^\n]*(?:\n|\z)", 1)
    each = rows.select(name.alias("source_file"), part.alias("part")).withColumn("number", number)
    marked = F.col("number") != ""
    body = F.when(marked, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    text = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    return each.select("source_file", F.when(marked, F.col("number").try_cast("int")).otherwise(1).alias("page"), text.alias("text"), marked.alias("marked")).filter("marked or text <> ''").drop("marked")


def lines(docs: DataFrame) -> DataFrame:
    """source_file, line_no from 0, line and the page that the last marker before it names. Pages are carried along within
    each document, so nothing is shuffled."""
    page = lambda x: F.regexp_extract(x, r"^--- PAGE (\d+)", 1)
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.when(page(x) != "", page(x).try_cast("int")).alias("mark")))
    whole = docs.select("source_file", numbered.alias("l")).withColumn("m", F.filter("l", lambda x: x["mark"].isNotNull()))
    # the marks split the lines: line i has the page of the last mark before it
    at = F.transform("m", lambda x: x["line_no"])
    parts = F.transform(F.sequence(F.lit(0), F.size("m")), lambda k: F.struct(F.when(k == 0, 1).otherwise(F.get("m", k - 1)["mark"]).alias("page"), F.when(k == 0, 0).otherwise(F.get(at, k - 1)).alias("first"), F.coalesce(F.get(at, k), F.size("l")).alias("end")))
    each = whole.select("source_file", "l", F.explode(parts).alias("p")).select("source_file", F.col("p.page").alias("page"), F.explode(F.slice("l", F.col("p.first") + 1, F.greatest(F.col("p.end") - F.col("p.first"), F.lit(0)))).alias("x"))
    return each.filter(page(F.col("x.line")) == "").select("source_file", "x.line_no", "x.line", "page")


def page_text(native: Column, scanned: Column, least: int = 50) -> Column:
    """kind and text: the native text if it has `least` characters, else what a scan gave, else nothing."""
    n, s = F.trim(F.coalesce(native, F.lit(""))), F.trim(F.coalesce(scanned, F.lit("")))
    return F.when(F.char_length(n) >= least, F.struct(F.lit("native").alias("kind"), n.alias("text"))).when(s != "", F.struct(F.lit("ocr").alias("kind"), s.alias("text"))).otherwise(F.struct(F.lit("empty").alias("kind"), F.lit("").alias("text")))


def page_statistics(found: DataFrame) -> DataFrame:
    """Pages of each kind and characters of each source_file; found has source_file and p as page_text gives it."""
    of = lambda k: F.count_if(F.col("p.kind") == k).alias(k)
    return found.groupBy("source_file").agg(of("native"), of("ocr"), of("empty"), F.sum(F.char_length("p.text")).alias("chars"))


def triage(found: DataFrame) -> DataFrame:
    """TEXT, SCANNED/IMAGE or EMPTY by the first five pages (source_file, page, text, has_image)."""
    first = found.filter("page <= 5").groupBy("source_file").agg(F.sum(F.char_length("text")).alias("n"), F.bool_or("has_image").alias("image"))
    return first.select("source_file", F.when(F.col("n") > 100, "TEXT").when(F.col("image"), "SCANNED/IMAGE").otherwise("EMPTY").alias("kind"))


def listings(spark: SparkSession, path: str, limit: int | None = 500) -> DataFrame:
    """The first rows of a CSV file of listings, by id."""
    rows = spark.read.csv(path, header=True, schema=LISTINGS, escape='"')
    return rows if limit is None else rows.orderBy("id").limit(limit)


#: Fixed values of the generator.
NEIGHBOURHOODS = ["Manly", "Bondi", "Surry Hills", "Newtown", "Darlinghurst", "Parramatta"]
ROOMS = ["Entire home/apt", "Private room", "Shared room"]
REVIEWS = [
    "A lovely, quiet neighborhood perfect for families. Close to the beach.",
    "Very noisy and bustling, great for nightlife but hard to sleep.",
    "Extremely clean and modern apartment with high-speed wifi.",
    "A bit outdated but very affordable and cozy.",
    "Luxury villa with a pool and ocean views. Incredible experience.",
    "Basic room, clean but tiny. The host was very friendly.",
    "Terrible experience, the place was dirty and loud.",
    "Quiet and peaceful, the perfect romantic getaway.",
]


def made_up_listings(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n listings, the same for the same seed, however many tasks make them."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(10**6))
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (h(k) % len(xs) + 1).cast("int"))
    ids = spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"))
    return ids.select("id", pick(NEIGHBOURHOODS, 1).alias("neighborhood"), pick(ROOMS, 2).alias("room_type"), (50 + h(3) % 75001 / 100).cast("decimal(10,2)").alias("price"), (2.5 + h(4) % 26 / 10).cast("decimal(3,1)").alias("rating"), pick(REVIEWS, 5).alias("review_text"))


def entities(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Entities of a folder of JSON files that are valid and have a name, with entity_id from the file's name."""
    rows = spark.read.json(folder, multiLine=True, mode="PERMISSIVE", pathGlobFilter=glob, recursiveFileLookup=True)
    if "name" not in rows.columns:
        return rows.limit(0).withColumn("entity_id", F.lit(""))
    file = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[a-z]+$", "")
    return rows.withColumn("entity_id", F.concat(F.lit("entity_"), file)).filter("name is not null")


def json_or_empty(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """The rows of a JSON file or folder, none if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).json(path, multiLine=multi_line) if there else spark.createDataFrame([], schema)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key, the new ones' last by `order` in place of the old."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return old.join(last.select(key), key, "left_anti").select(old.columns).unionByName(last.select(old.columns))


def inserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key; a key that is there, or was there earlier by `order`, is left as it is."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(old.columns))
