"""Text forms of sequences, patterns and dictionaries. All readers and writers take any file system that Spark knows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import Dictionary
from ..operators.sequences import Patterns, Sequences
from ..session import written

ITEM = "fid int, gid int, sid string, dfreq bigint, cfreq bigint, parentGids array<int>, noChildren int, properties array<struct<key:string,value:struct<string:string>>>"


def numbers(line, sep: str = r"[\t ]") -> F.Column:
    return F.filter(F.split(line, sep), lambda x: x != "").cast("array<int>")


def read_del(spark: SparkSession, path: str, dictionary: Dictionary, kind: str = "gid", unknown: str = "error") -> Sequences:
    """One sequence of weight 1 a line: whole numbers between tabs or spaces; an empty line is an empty sequence. kind: gid or fid."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq_id"), numbers(F.col("value")).alias("items"), F.lit(1).cast("bigint").alias("weight"))
    rows = written(lines, "sequences")
    known = dictionary.translate(rows, "items", "gid", kind, unknown=unknown) if kind == "fid" or unknown != "error" else rows
    return Sequences(known, dictionary)


def read_words(spark: SparkSession, path: str, dictionary: Dictionary | None = None) -> Sequences:
    """One sequence a line, words between white space."""
    rows = spark.read.text(path).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("items"))
    return Sequences.from_columns(rows, dictionary=dictionary)


def write_del(sequences: Sequences, path: str, kind: str = "gid") -> None:
    """The items of each sequence between tabs."""
    rows = sequences.rows if kind == "gid" else sequences.dictionary.translate(sequences.rows, "items", kind)
    rows.select(F.concat_ws("\t", F.col("items").cast("array<string>")).alias("value")).write.text(path)


def read_patterns(spark: SparkSession, path: str, dictionary: Dictionary, kind: str = "gid") -> Patterns:
    """Lines of a support and items, between tabs."""
    lines = spark.read.text(path).where("value <> ''").select(numbers(F.col("value"), "\t").alias("all"), F.split("value", "\t")[0].cast("bigint").alias("support"))
    rows = lines.select(F.expr("slice(all, 2, size(all))").alias("pattern"), "support")
    if kind == "fid":
        rows = dictionary.translate(rows, "pattern", "gid", "fid")
    return Patterns(rows.select(F.concat_ws(" ", F.col("pattern").cast("array<string>")).alias("pattern"), "support"), dictionary)


def write_patterns(patterns: Patterns, path: str, kind: str = "gid") -> None:
    rows = {"gid": patterns.gids, "fid": patterns.fids, "sid": patterns.sids}[kind]()
    rows.select(F.concat_ws("\t", F.col("support").cast("string"), F.concat_ws("\t", F.col("pattern").cast("array<string>"))).alias("value")).write.text(path)


def read_json_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """One item a line (.json or .json.gz)."""
    rows = spark.read.schema(ITEM).json(path)
    props = F.map_from_entries(F.transform(F.coalesce("properties", F.array().cast("array<struct<key:string,value:struct<string:string>>>")), lambda p: F.struct(p["key"], p["value"]["string"])))
    return Dictionary(rows.select("gid", "sid", "dfreq", "cfreq", F.coalesce("parentGids", F.array().cast("array<int>")).alias("parents"), props.alias("properties"), "fid"))


def write_json_dictionary(dictionary: Dictionary, path: str, compression: str = "none") -> None:
    """Items with fids in the order of fids, parents before children; compression may be gzip."""
    kids = dictionary.edges().groupBy(F.col("parent").alias("gid")).agg(F.count("*").cast("int").alias("noChildren"))
    rows = dictionary.items.join(kids, "gid", "left").orderBy("fid", "gid")
    props = F.transform(F.map_entries("properties"), lambda p: F.struct(p["key"].alias("key"), F.struct(p["value"].alias("string")).alias("value")))
    rows.select("fid", "gid", "sid", "dfreq", "cfreq", F.col("parents").alias("parentGids"), F.coalesce("noChildren", F.lit(0)).alias("noChildren"), props.alias("properties")).write.option("compression", compression).json(path)


def read_avro_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """An Avro item file, for sessions that have the spark-avro package."""
    rows = spark.read.format("avro").load(path)
    return Dictionary(rows.select("gid", "sid", "dfreq", "cfreq", F.col("parentGids").alias("parents"), F.expr("map_from_entries(transform(properties, p -> struct(p.key, p.value)))").alias("properties"), "fid"))


def read_del_dictionary(spark: SparkSession, path: str, statistics: bool = True) -> Dictionary:
    """The older text form: sid, cfreq, dfreq, gid, parents (or, without statistics, sid, gid, parents) between tabs; parent 0 is none."""
    c = F.split("value", "\t")
    at = 3 if statistics else 1
    zero = F.lit(0).cast("bigint")
    parents = F.filter(F.filter(F.split(F.coalesce(F.get(c, at + 1), F.lit("")), ","), lambda x: F.trim(x) != "").cast("array<int>"), lambda x: x != 0)
    rows = spark.read.text(path).where("value <> ''").select(c[at].cast("int").alias("gid"), c[0].alias("sid"), (c[2].cast("bigint") if statistics else zero).alias("dfreq"), (c[1].cast("bigint") if statistics else zero).alias("cfreq"), parents.alias("parents"), F.create_map().cast("map<string,string>").alias("properties"), c[at].cast("int").alias("fid"))
    return Dictionary(rows)


def dictionary_from(spark: SparkSession, path: str) -> Dictionary:
    """By the path's ending: .json, .json.gz, .avro, .del, else a Parquet folder."""
    if path.endswith((".json", ".json.gz")):
        return read_json_dictionary(spark, path)
    if path.endswith((".avro", ".avro.gz")):
        return read_avro_dictionary(spark, path)
    return read_del_dictionary(spark, path) if path.endswith(".del") else Dictionary.load(spark, path)
