"""Named queries for what goes in and out: readers, writers, converters, built data sets, dictionaries, streams; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import Dictionary
from ..operators.sequences import Sequences
from ..session import new_path
from ..sources import etl, files
from ..streaming import mining
from . import catalogue as c
from .compiled import compile_

TYPES = "['click', 'error', 'purchase', 'signup', 'view']"
LINE = f"string_agg(list_position({TYPES}, t)::VARCHAR, ' ' ORDER BY p)"


def joined(column: str, sep: str = " ") -> F.Column:
    return F.concat_ws(sep, F.col(column).cast("array<string>"))


# files of sequences and patterns


@c.query(c.EV + f" SELECT {LINE} AS items, 1::BIGINT AS weight FROM e GROUP BY s")
def del_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of gids, written as text and read again."""
    s, at = c.events(spark, sf_dir), new_path(spark, "del")
    files.write_del(s, at)
    return files.read_del(spark, at, s.dictionary).rows.select(joined("items").alias("items"), "weight")


@c.query(c.EV + " SELECT string_agg(t, ' ' ORDER BY p) AS items FROM e GROUP BY s")
def del_sequences_by_fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, at = c.events(spark, sf_dir).recompute_dictionary(), new_path(spark, "del")
    files.write_del(s, at, "fid")
    return files.read_del(spark, at, s.dictionary, "fid").to_sids().select(joined("items").alias("items"))


@c.query(c.SQL["bigram"])
def del_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns, written with their supports and read again."""
    found, at = c.events(spark, sf_dir).mine("(..)", 130), new_path(spark, "patterns")
    files.write_patterns(found, at)
    return files.read_patterns(spark, at, found.dictionary).text()


@c.query(f"SELECT support || chr(9) || replace(pattern, ' ', chr(9)) AS line FROM ({c.SQL['bigram']})")
def pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "patterns")
    files.write_patterns(c.events(spark, sf_dir).mine("(..)", 130), at, "sid")
    return spark.read.text(at).select(F.col("value").alias("line"))


@c.query(c.SQL["generalise_any"])
def saved_data_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "saved")
    c.tree(spark, sf_dir).save(at)
    return Sequences.load(spark, at).mine("(.^ .^)", 130).text()


@c.query(c.SQL["bigram"])
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of words, written as text and read as sequences."""
    at = new_path(spark, "words")
    c.events(spark, sf_dir).to_sids().select(joined("items").alias("value")).write.text(at)
    return files.read_words(spark, at).mine("(..)", 130).text()


# files of dictionaries

TREE_FREQS = c.EV + c.TREE + " SELECT a AS sid, count(DISTINCT s) AS dfreq, count(*) AS cfreq, CASE WHEN a IN ('click', 'view') THEN 'ENGAGE' WHEN a IN ('signup', 'purchase') THEN 'CONVERT' ELSE '' END AS parents FROM e JOIN c USING (t) GROUP BY a"


def items_of(d: Dictionary) -> DataFrame:
    names = d.items.select(F.col("gid").alias("parent"), F.col("sid").alias("name"))
    up = d.edges().join(names, "parent").groupBy(F.col("child").alias("gid")).agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("up"))
    return d.items.join(up, "gid", "left").select("sid", "dfreq", "cfreq", F.coalesce("up", F.lit("")).alias("parents"))


@c.query(TREE_FREQS)
def json_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "dictionary") + ".json"
    files.write_json_dictionary(c.tree(spark, sf_dir).dictionary, at)
    return items_of(files.read_json_dictionary(spark, at).checked())


@c.query(TREE_FREQS)
def compressed_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip dictionary, read by the ending of its path."""
    at = new_path(spark, "dictionary") + ".json.gz"
    files.write_json_dictionary(c.tree(spark, sf_dir).dictionary, at, "gzip")
    return items_of(files.dictionary_from(spark, at))


@c.query(TREE_FREQS)
def del_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older text form of a dictionary."""
    at = new_path(spark, "dictionary") + ".del"
    d = c.tree(spark, sf_dir).dictionary
    d.items.select(F.concat_ws("\t", "sid", F.col("cfreq").cast("string"), F.col("dfreq").cast("string"), F.col("gid").cast("string"), F.when(F.size("parents") == 0, "0").otherwise(joined("parents", ","))).alias("value")).write.text(at)
    return items_of(files.dictionary_from(spark, at))


@c.query(TREE_FREQS)
def parquet_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "dictionary")
    c.tree(spark, sf_dir).dictionary.save(at)
    return items_of(files.dictionary_from(spark, at))


# building

NAMES = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t, p_size % 3 + 1 AS w, p_type FROM part"


def _parse_part(row: dict) -> tuple[list, int]:
    return [(w, [row["p_type"]]) if i == 0 else w for i, w in enumerate(row["p_name"].split(" "))], row["p_size"] % 3 + 1


@c.query("WITH e AS (SELECT p_partkey AS s, unnest(string_split(p_name, ' ')) AS t, p_size % 3 + 1 AS w FROM part), d AS (SELECT DISTINCT * FROM e), f AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS t, p_type AS a FROM part), g AS (SELECT DISTINCT s, w, a FROM d JOIN f USING (t)) SELECT t AS sid, sum(w)::BIGINT AS dfreq FROM d GROUP BY t UNION ALL SELECT a, sum(w)::BIGINT FROM g GROUP BY a")
def built_by_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names; the first one is below the part's type."""
    part = c.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    return Sequences.build(part, _parse_part, "p_partkey").dictionary.items.select("sid", "dfreq")


# expressions and mining

c.mined("exact_uncaptured", c.tree, "click= (ENGAGE)", 50, c.sql_of(c.EV, c.chain(2, where="e0.t = 'click' AND e1.t IN ('click', 'view')", pick=[1]), 50))
c.mined("by_gid", c.events, "(#1) (#5)", 10, c.sql_of(c.EV, c.chain(2, where="e0.t = 'click' AND e1.t = 'view'"), 10))


@c.query(c.sql_of(c.EV + ", q AS (SELECT t, row_number() OVER (ORDER BY count(DISTINCT s) DESC, t) AS f FROM e GROUP BY t)", "SELECT a.s, a.t || ' ' || b.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p = a.p + 1 JOIN q ON a.t = q.t WHERE q.f = 1", 10))
def by_fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.events(spark, sf_dir).recompute_dictionary().mine("(##1)(.)", 10).text()


@c.query(c.SQL["context"])
def expression_of_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mines the expression that is made of another one's transducer."""
    s = c.events(spark, sf_dir)
    return s.mine(compile_("signup (.) purchase", s.dictionary).fst.to_patex(), 10, "kernel").text()


@c.query(c.EV + " SELECT DISTINCT e0.s AS seq_id, list_position(" + TYPES + ", e1.t)::VARCHAR AS pattern FROM e e0 JOIN e e1 ON e1.s = e0.s AND e1.p = e0.p + 1 JOIN e e2 ON e2.s = e0.s AND e2.p = e0.p + 2 WHERE e0.t = 'signup' AND e2.t = 'purchase'")
def outputs_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.events(spark, sf_dir).outputs("signup (.) purchase")


GAPPED = c.EV.replace("WITH e AS", "WITH f AS") + ", e AS (SELECT * FROM f WHERE t <> 'error')"
for _alg in ("growth", "lists"):

    def _gaps(spark: SparkSession, sf_dir: str, alg=_alg) -> DataFrame:
        s = c.events(spark, sf_dir)
        return s.with_rows(s.rows.withColumn("items", F.transform("items", lambda x: F.when(x == 2, -1).otherwise(x)))).mine_traditional(120, 1, 3, algorithm=alg, gaps=True).text()

    def _pivots(spark: SparkSession, sf_dir: str, alg=_alg) -> DataFrame:
        return c.events(spark, sf_dir).recompute_dictionary().mine_traditional(120, 1, 2, algorithm=alg, begin=2, end=3).text()

    _gaps.__name__, _pivots.__name__ = f"compressed_gaps_{_alg}", f"pivots_{_alg}"
    c.query(c.sql_of(GAPPED, c.GAP1, 120))(_gaps)
    PIVOTS = c.EV + ", q AS (SELECT t, row_number() OVER (ORDER BY count(DISTINCT s) DESC, t) AS f FROM e GROUP BY t)"
    TWO = "SELECT a.s, a.t AS pattern, q.f FROM e a JOIN q USING (t) UNION ALL SELECT a.s, a.t || ' ' || b.t, greatest(q.f, r.f) FROM e a JOIN e b ON a.s = b.s AND b.p BETWEEN a.p + 1 AND a.p + 2 JOIN q ON q.t = a.t JOIN q r ON r.t = b.t"
    c.query(c.sql_of(PIVOTS, f"SELECT s, pattern FROM ({TWO}) WHERE f BETWEEN 2 AND 3", 120))(_pivots)

# dictionaries


@c.query(c.EV + c.TREE + " SELECT a AS sid, count(DISTINCT s) + 5 AS dfreq, count(*) + 7 AS cfreq FROM e JOIN c USING (t) GROUP BY a UNION ALL SELECT 'refund', 0, 0")
def edited_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item and a link more, and frequencies added."""
    d = c.tree(spark, sf_dir).dictionary
    more = d.items.select("gid", F.lit(5).alias("dfreq"), F.lit(7).alias("cfreq"))
    return d.with_freqs(more, add=True).with_item("refund", ["CONVERT"]).with_parent("error", "ENGAGE").items.select("sid", "dfreq", "cfreq")


@c.query(c.EV + ", q AS (SELECT t, row_number() OVER (ORDER BY count(DISTINCT s) DESC, t)::INTEGER AS f FROM e GROUP BY t) SELECT f AS fid, lead(f) OVER (ORDER BY f) AS next, lag(f) OVER (ORDER BY f) AS previous FROM q")
def fid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.events(spark, sf_dir).recompute_dictionary().dictionary.neighbours().select("fid", "next", "previous")


@c.query("SELECT unnest(['CONVERT', 'ENGAGE', 'click', 'view', 'signup', 'purchase']) AS sid")
def ancestors_of_small_fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are or are below one of the two most frequent items, the roots."""
    d = Dictionary.of(spark, c.EVENTS)
    d = d.with_freqs(d.items.where("sid IN ('ENGAGE', 'CONVERT')").select("gid", F.lit(9).alias("dfreq"), F.lit(9).alias("cfreq"))).recompute_fids()
    return c.named(d, d.below_fid(3))


# converters

TOKENS = c.EV + """, k AS (SELECT s, p, t, t <> 'error' OR coalesce(lag(t) OVER o, '') <> 'error' AS starts FROM e WINDOW o AS (PARTITION BY s ORDER BY p)),
r AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY s ORDER BY p) AS run FROM k), m AS (SELECT s, run, any_value(t) AS t, count(*) AS n FROM r GROUP BY s, run),
i AS (SELECT s, run, CASE WHEN t = 'error' THEN rtrim(repeat('error_', n::INTEGER), '_') || '@BUG@ENTITY' ELSE t || '@' || t || '@VB' END AS item FROM m WHERE t <> 'view')"""


@c.query(TOKENS + " SELECT s AS seq_id, string_agg(item, ' ' ORDER BY run) AS items FROM i GROUP BY s")
def annotated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotated tokens: errors are an entity class, views have a tag that is left out."""
    e = c.events(spark, sf_dir).rows.select("seq_id", F.posexplode("items").alias("index", "g"))
    d = c.events(spark, sf_dir).dictionary.items.select(F.col("gid").alias("g"), F.initcap("sid").alias("word"))
    token = F.struct("index", "word", F.lower("word").alias("lemma"), F.when(F.col("word") == "View", "??").otherwise("VBZ").alias("pos"), F.when(F.col("word") == "Error", "BUG").otherwise("O").alias("ner"))
    rows, _ = etl.sentences(e.join(d, "g").groupBy(F.col("seq_id").alias("s_id")).agg(F.collect_list(token).alias("tokens")))
    return rows.select(F.col("k").alias("seq_id"), joined("items").alias("items"))


@c.query(TOKENS + ", u AS (SELECT s, unnest(CASE WHEN item LIKE '%ENTITY' THEN [item, 'BUG@ENTITY', 'ENTITY'] ELSE [item, split_part(item, '@', 2) || '@VB', 'VB'] END) AS sid FROM i) SELECT sid, count(DISTINCT s) AS dfreq FROM u GROUP BY sid")
def sentence_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c.events(spark, sf_dir)
    d = s.dictionary.items.select(F.col("gid").alias("g"), F.initcap("sid").alias("word"))
    token = F.struct("index", "word", F.lower("word").alias("lemma"), F.when(F.col("word") == "View", "??").otherwise("VBZ").alias("pos"), F.when(F.col("word") == "Error", "BUG").otherwise("O").alias("ner"))
    rows, links = etl.sentences(s.rows.select("seq_id", F.posexplode("items").alias("index", "g")).join(d, "g").groupBy(F.col("seq_id").alias("s_id")).agg(F.collect_list(token).alias("tokens")))
    return Sequences.from_columns(rows, key="k", parents=links).dictionary.items.select("sid", "dfreq")


@c.query("WITH o AS (SELECT DISTINCT o_custkey AS s, 'p' || l_partkey AS t, p_brand, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), u AS (SELECT s, unnest([t, p_brand || '@All', 'All', p_type]) AS sid FROM o) SELECT sid, count(DISTINCT s) AS dfreq FROM u GROUP BY sid HAVING count(DISTINCT s) >= 20")
def product_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products that customers rated, below category paths."""
    part = c.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("asin"), F.array(F.array(F.lit("All"), "p_brand"), F.array("p_type")).alias("categories"))
    rows, links = etl.ratings(bought(spark, sf_dir).select(F.col("o_custkey").alias("user"), F.concat(F.lit("p"), "l_partkey").alias("product"), F.lit(1.0).alias("rating"), F.col("o_orderdate").alias("timestamp")), part)
    used = links.join(rows.select(F.explode("items").alias("child")).distinct(), "child", "left_semi").unionByName(links.where("parent = 'All'"))
    return Sequences.from_columns(rows, key="user", parents=used).dictionary.items.where("dfreq >= 20").select("sid", "dfreq")


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(c.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))


MOVIES = "WITH r AS (SELECT o_custkey AS s, strftime(o_orderdate, '%Y-%m-%d') AS d, l_partkey AS m, l_quantity::BIGINT % 5 + 1 AS stars, p_type || '#' || (p_size + 1970) || '#' || l_partkey AS movie, (p_size + 1970)::VARCHAR AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def rated_movies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rated = bought(spark, sf_dir).select(F.col("o_custkey").alias("userId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("l_partkey").alias("movieId"), (F.col("l_quantity").cast("bigint") % 5 + 1).alias("rating"))
    return rated, c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movieId"), (F.col("p_size") + 1970).alias("year"), F.col("p_type").alias("title"))


@c.query(MOVIES + " SELECT s AS seq_id, string_agg(movie, ' ' ORDER BY d, m) AS items FROM r GROUP BY s")
def movie_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = etl.movies(*rated_movies(spark, sf_dir))
    return rows.select(F.col("userId").alias("seq_id"), joined("items").alias("items"))


@c.query(MOVIES + ", u AS (SELECT s, unnest([movie || '@' || stars, movie, year, stars || 'stars']) AS sid FROM r) SELECT sid, count(DISTINCT s) AS dfreq FROM u GROUP BY sid")
def movie_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links = etl.movies(*rated_movies(spark, sf_dir), deep=True)
    return Sequences.from_columns(rows, key="userId", parents=links).dictionary.items.select("sid", "dfreq")


LETTERS = "WITH e AS (SELECT p_partkey AS s, unnest(string_split(p_name, '')) AS t, unnest(range(length(p_name))) AS p FROM part)"


@c.query(c.sql_of(LETTERS, "SELECT a.s, a.t || ' ' || b.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p > a.p WHERE a.t IN ('s', 'w') AND b.t IN ('g', 't')", 5))
def letter_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters as items, as in proteins."""
    part = c.table(spark, sf_dir, "part").select("p_name")
    return Sequences.from_columns(etl.letters(part, "p_name")).mine("([s|w]).*([g|t])", 5).text()


# streams


@c.query(c.sql_of(c.EV, c.chain(2), 130).replace("SELECT pattern,", f"SELECT array_to_string(list_transform(string_split(pattern, ' '), lambda x: list_position({TYPES}, x)::VARCHAR), ' ') AS pattern,"))
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports over a stream of files, when all of them have arrived."""
    s, at = c.events(spark, sf_dir), new_path(spark, "stream")
    s.rows.select("items", "weight").repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("items array<int>, weight bigint").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    name = "streamed_" + at.rpartition("-")[2]
    q = mining.start(mining.supports(stream, s.dictionary, "(..)", 130), name, f"{at}/checkpoint", available_now=True)
    q.awaitTermination()
    return spark.table(name)
