"""Records of JSON arrays, read by as many tasks as the files have blocks.

A file is read as chunks that end with a closing brace, in the byte ranges Spark cuts it into. Whether a chunk begins
inside a string and how deep it lies follows from running sums over the chunks before it: sums inside a block are taken
for both possible states of its start, and one row per block tells which of them holds. The sums run over counts
taken once from each chunk, apart from its text. A record is the run of chunks from an opening brace at depth 0 to its
closing one, so no task holds more than one record; one that is a single chunk is not grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage

WRAPPERS = ("data", "records", "examples", "items")  # fixed values: keys a record list may be wrapped in
FIELDS = "map<string,string>"
BLOCK, LINE = "__block", "__line"
BARE = "["
KEYS = "|".join(WRAPPERS)
OPENING = r"\A\s*\{"


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\.", "  ")


def _outside(text: Column, inside: int) -> Column:
    """The text with structure characters inside its strings blanked, of the same length."""
    parts = F.transform(
        F.split(text, '"', -1), lambda x, i: F.when(i % 2 == inside, x).otherwise(F.regexp_replace(x, r"[{\[\]:]", " "))
    )
    return F.array_join(parts, '"')


def _braces(parts: Column, inside: int) -> Column:
    """Opening braces in the parts that lie outside strings, when the first part lies inside one or not."""
    outside = F.array_join(F.filter(parts, lambda x, i: i % 2 == inside), "")
    return (F.octet_length(outside) - F.octet_length(F.replace(outside, F.lit("{"), F.lit("")))).cast("bigint")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, line, value, quotes, open0, open1, opening), written once; ``line`` identifies a chunk."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(LINE),
        "value",
    )
    parts = rows.withColumn("__parts", F.split(_unescaped(F.col("value")), '"', -1))
    return cut_lineage(
        parts.select(
            *rows.columns,
            ((F.size("__parts") - 1) % 2).cast("bigint").alias("__quotes"),
            *[_braces(F.col("__parts"), k).alias(f"__open{k}") for k in (0, 1)],
            ((F.col(BLOCK) == 0) & F.col("value").rlike(OPENING)).alias("__opening"),
        )
    )


def _located(chunks: DataFrame) -> DataFrame:
    """Places of the chunks, without their text: ``__first`` of its file, ``__inside`` (begins inside a string),
    ``__depth`` at its start, ``__starts`` a record, ``__alone`` (and ends it) and ``__r``, records begun up to here."""
    in_block = Window.partitionBy("source", BLOCK).orderBy(LINE)
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.drop("value").withColumn("__rel", F.coalesce(F.sum("__quotes").over(earlier), F.lit(0)) % 2)
    rows = rows.withColumn("__first", (F.col(BLOCK) == 0) & (F.row_number().over(in_block) == 1))
    # the brace that opens a whole file does not count
    rows = rows.withColumn("__open0", F.col("__open0") - (F.col("__first") & F.col("__opening")).cast("bigint"))
    for k in (0, 1):  # the state in which the block begins
        state = (F.col("__rel") + k) % 2
        closes = F.when((state + F.col("__quotes")) % 2 == 0, 1).otherwise(0)
        rows = rows.withColumn(f"__step{k}", F.when(state == 0, F.col("__open0")).otherwise(F.col("__open1")) - closes)
        rows = rows.withColumn(f"__depth{k}", F.coalesce(F.sum(f"__step{k}").over(earlier), F.lit(0)))
    before = Window.partitionBy("source").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source", BLOCK).agg(F.sum("__quotes").alias("q"), F.sum("__step0").alias("t0"), F.sum("__step1").alias("t1"))
    blocks = blocks.withColumn("__from", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("t", F.when(F.col("__from") == 0, F.col("t0")).otherwise(F.col("t1")))
    blocks = blocks.select("source", BLOCK, "__from", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("__base"))
    inside = (F.col("__rel") + F.col("__from")) % 2 == 1
    known = rows.join(blocks, ["source", BLOCK]).select(
        "source", BLOCK, LINE, "__first",
        inside.alias("__inside"),
        (F.col("__base") + F.when(F.col("__from") == 0, F.col("__depth0")).otherwise(F.col("__depth1"))).alias("__depth"),
        F.when(F.col("__from") == 0, F.col("__step0")).otherwise(F.col("__step1")).alias("__step"),
        F.when(inside, F.col("__open1")).otherwise(F.col("__open0")).alias("__opens"),
    )
    known = known.withColumn("__starts", (F.col("__depth") == 0) & (F.col("__opens") > 0))
    known = known.withColumn("__alone", F.col("__starts") & (F.col("__step") == 0))
    known = cut_lineage(known.withColumn("__c", F.sum(F.col("__starts").cast("bigint")).over(in_block)).drop("__opens", "__step"))
    begun = known.groupBy("source", BLOCK).agg(F.max("__c").alias("c"))
    begun = begun.select("source", BLOCK, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"))
    placed = known.join(begun, ["source", BLOCK])
    return placed.withColumn("__r", F.col("__before") + F.col("__c")).drop("__c", "__before")


def _lead() -> Column:
    """A chunk as it counts: without the brace that opens a whole file, with a quote for the string it begins in."""
    text = F.when(F.col("__first"), F.regexp_replace("value", OPENING, " ")).otherwise(F.col("value"))
    return F.when(F.col("__inside"), F.concat(F.lit('"'), text)).otherwise(text)


def _ground(lead: str) -> Column:
    """The text before the record a chunk starts, or all of a chunk at depth 0 that starts none, with structure
    characters inside strings blanked."""
    # mostly the brace stands before any quote, then the strings of the record need not be looked at
    head = F.when(F.col("__starts"), _unescaped(F.substring_index(lead, '"', 1)))
    mask = _outside(_unescaped(F.col(lead)), 0)
    return (
        F.when(head.contains("{"), F.substring_index(head, "{", 1))
        .when(F.col("__starts"), F.substring_index(mask, "{", 1))
        .when(F.col("__depth") <= 0, mask)
    )


def _piece() -> Column:
    """What a chunk has of a record."""
    return F.when(F.col("__starts"), F.substr(_lead(), F.length("__ground") + 1)).otherwise(F.col("value"))


def _priority(key: Column) -> Column:
    """Place of a wrapper among the wrappers, from 1; 0 for a bare array."""
    return F.when(key == BARE, 0).otherwise(F.array_position(F.array(*[F.lit(k) for k in WRAPPERS]), key))


def _chosen_lists(ground: DataFrame) -> DataFrame:
    """(source, low, high): the records of each file's list, from the text between records."""
    marks = ground.select("source", "__r", "__starts", "__first", F.col("__ground").alias("b"))
    wrapped = F.regexp_extract("b", rf'"({KEYS})"\s*:\s*\[[^\[\]:]*\z', 1)
    key = F.when(F.col("__first") & F.col("b").rlike(r"\A\s*\[[^\[\]:]*\z"), BARE).otherwise(wrapped)
    lists = marks.where(F.col("__starts") & F.col("b").rlike(r"[\[\]:]")).select("source", "__r", key.alias("key"))
    lists = lists.withColumn("high", F.lead("__r").over(Window.partitionBy("source").orderBy("__r")))
    best = lists.where("key <> ''").groupBy("source").agg(
        F.min(F.struct(_priority(F.col("key")).alias("p"), F.col("__r").alias("low"), "high")).alias("l")
    )
    # a wrapper that holds no record may still come first
    named = F.transform(F.regexp_extract_all("b", F.lit(rf'"({KEYS})"\s*:\s*\['), F.lit(1)), _priority)
    seen = marks.where(F.col("b").rlike(rf'"({KEYS})"')).groupBy("source").agg(F.min(F.array_min(named)).alias("seen"))
    return best.join(seen, "source", "left").where("seen IS NULL OR seen >= l.p").select("source", "l.low", "l.high")


def _whole_files(texts: DataFrame) -> DataFrame:
    """Records of files without a list of objects: the object itself, or nothing."""
    text = F.regexp_replace("whole", r"\A\s+", "")
    lists = F.when(text.startswith("["), F.from_json(text, f"array<{FIELDS}>"))
    for key in WRAPPERS:
        wrapped = F.get_json_object(text, f"$.{key}")
        lists = lists.when(wrapped.startswith("["), F.from_json(wrapped, f"array<{FIELDS}>"))
    lists = lists.otherwise(F.array(F.from_json(text, FIELDS)))
    return texts.select("source", F.posexplode(lists).alias("ordinal", "fields"))


def _joined(pieces: str) -> Column:
    """Aggregate: the pieces of one record in file order; each ended with a brace."""
    ordered = F.array_sort(F.collect_list(F.struct(BLOCK, LINE, pieces)))
    return F.concat(F.array_join(F.transform(ordered, lambda s: s[pieces]), "}"), F.lit("}"))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """(source, ordinal, fields) of JSON files with an array of records, an object wrapping one, or a single record.

    An array is read by several tasks; ordinals are places among the objects of the list. The first wrapper in the order
    of ``WRAPPERS`` counts. Elements that are no object are left out and have no ordinal, a file that is
    empty or no JSON gives no record. A file without a list is one record and gathered as one.
    """
    chunks = _chunks(spark, path)
    rows = chunks.select(LINE, "value").join(_located(chunks), LINE).withColumn("__lead", _lead())
    rows = cut_lineage(rows.withColumn("__ground", _ground("__lead")).drop("__lead"))
    lists = cut_lineage(_chosen_lists(rows.where("__depth <= 0")))
    held = rows.where("__starts OR __depth > 0").join(lists, "source")
    held = held.where("__r >= low AND (high IS NULL OR __r < high)").withColumn("__piece", _piece())
    alone = held.where("__alone").select("source", "__r", "low", F.concat("__piece", F.lit("}")).alias("json"))
    records = alone.unionByName(held.where("NOT __alone").groupBy("source", "__r", "low").agg(_joined("__piece").alias("json")))
    # exploded, as a filter on what is parsed would parse it once more
    parsed = F.explode(F.filter(F.array(F.from_json("json", FIELDS)), lambda m: m.isNotNull()))
    listed = records.select("source", (F.col("__r") - F.col("low")).alias("ordinal"), parsed.alias("fields"))
    others = rows.join(lists, "source", "left_anti").groupBy("source").agg(_joined("value").alias("whole"))
    single = _whole_files(others).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    return listed.unionByName(single).where("fields IS NOT NULL")
