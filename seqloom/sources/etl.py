"""Conversions of raw tables into sequences and hierarchies: (rows with items array<string>, edges (child, parent))."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TAGS = ("NN NNS NNP NNPS VB VBD VBG VBN VBP VBZ JJ JJR JJS RB RBR RBS IN DT PDT WDT PRP WP PRP$ WP$ WRB CC CD EX FW LS MD POS RP SYM TO UH").split()


def edges(df: DataFrame, child: str, parent: str) -> DataFrame:
    return df.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").distinct()


def sentences(df: DataFrame, key: str = "s_id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Annotated sentences (tokens: array of structs with index, word, lemma, pos, ner) as sequences.

    Neighbouring tokens of one entity class become one item, name@CLASS@ENTITY, below CLASS@ENTITY, below ENTITY. Any other token with a
    known tag becomes word@lemma@tag below lemma@tag, below the tag's first two letters; others are left out.
    """
    t = df.select(F.col(key).alias("k"), F.explode(tokens).alias("t")).select("k", F.col("t.index").alias("i"), F.lower("t.word").alias("word"), F.lower("t.lemma").alias("lemma"), "t.pos", F.coalesce("t.ner", F.lit("O")).alias("ner"))
    order = Window.partitionBy("k").orderBy("i")
    starts = (F.col("ner") == "O") | ~F.lag("ner").over(order).eqNullSafe(F.col("ner")) | ~F.lag("i").over(order).eqNullSafe(F.col("i") - 1)
    t = t.withColumn("run", F.sum(starts.cast("int")).over(order))
    runs = t.groupBy("k", "run").agg(F.min("i").alias("i"), F.first("ner").alias("ner"), F.first("pos").alias("pos"), F.first("lemma").alias("lemma"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), "_").alias("word"))
    entity = F.col("ner") != "O"
    tag = F.substring("pos", 1, 2)
    runs = runs.where(entity | F.col("pos").isin(TAGS))
    item = F.when(entity, F.concat_ws("@", "word", "ner", F.lit("ENTITY"))).otherwise(F.concat_ws("@", "word", "lemma", tag))
    middle = F.when(entity, F.concat_ws("@", "ner", F.lit("ENTITY"))).otherwise(F.concat_ws("@", "lemma", tag))
    runs = runs.select("k", "i", item.alias("item"), middle.alias("middle"), F.when(entity, F.lit("ENTITY")).otherwise(tag).alias("top"))
    return gathered(runs, "k", ["i"]), edges(runs, "item", "middle").unionByName(edges(runs, "middle", "top"))


def gathered(df: DataFrame, key: str, order: list[str], item: str = "item") -> DataFrame:
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(item).alias("v")))), lambda x: x["v"]).alias("items"))


def ratings(rated: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products rated by each user in the order of time. rated: user, product, rating, timestamp; products: asin, categories
    (array of paths from the top). A category is named by its path from below, so equal names in different places stay apart; the
    hierarchy is a DAG, as products may have several paths."""
    rows = gathered(rated.withColumn("item", F.col("product")), "user", ["timestamp", "product"])
    paths = products.select("asin", F.explode("categories").alias("path")).where("size(path) > 0")
    names = F.expr("transform(sequence(1, size(path)), n -> array_join(reverse(slice(path, 1, n)), '@'))")
    paths = paths.withColumn("names", names)
    links = paths.select(F.col("asin").alias("child"), F.element_at("names", -1).alias("parent"))
    up = paths.where("size(names) > 1").select(F.explode(F.expr("transform(sequence(2, size(names)), n -> struct(names[n - 1] AS child, names[n - 2] AS parent))")).alias("e")).select("e.child", "e.parent")
    return rows, links.unionByName(up).distinct()


def read_ratings_text(lines: DataFrame) -> DataFrame:
    """Movie files as lines in file order (value, file): a line 'id:' opens a movie, 'user,rating,date' lines follow it."""
    rows = lines.withColumn("__at", F.monotonically_increasing_id()).withColumn("own", F.regexp_extract("value", r"^(\d+):$", 1))
    w = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("movieId", F.last(F.when(F.col("own") != "", F.col("own")), True).over(w)).where("own = ''")
    c = F.split("value", ",")
    return rows.select(c[0].alias("userId"), c[2].alias("date"), F.col("movieId"), c[1].alias("rating"))


def movies(rated: DataFrame, titles: DataFrame, deep: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Movies rated by each user by date. rated: userId, date, movieId, rating; titles: movieId, year, title. An item is title#year#id; deep
    items end in @rating and have two parents, the movie (below its year) and Nstars."""
    name = F.concat_ws("#", "title", F.col("year").cast("string"), F.col("movieId").cast("string"))
    t = titles.select("movieId", name.alias("movie"), F.col("year").cast("string").alias("year"))
    rows = rated.join(t, "movieId")
    rows = rows.withColumn("item", F.concat_ws("@", "movie", F.col("rating").cast("string")) if deep else F.col("movie"))
    out = gathered(rows, "userId", ["date", "movieId", "item"])
    if not deep:
        return out, None
    # the links follow from the distinct ratings of movies, so that no names are made or sent for each rating
    seen = rated.select("movieId", "rating").distinct().join(t, "movieId")
    item, stars = F.concat_ws("@", "movie", F.col("rating").cast("string")), F.concat(F.col("rating").cast("string"), F.lit("stars"))
    pairs = [F.struct(a.alias("child"), b.alias("parent")) for a, b in ((item, F.col("movie")), (item, stars), (F.col("movie"), F.col("year")))]
    return out, edges(seen.select(F.explode(F.array(*pairs)).alias("e")).select("e.child", "e.parent"), "child", "parent")


def letters(df: DataFrame, column: str = "value") -> DataFrame:
    """Each character an item, as for proteins."""
    return df.select(F.filter(F.split(column, ""), lambda x: x != "").alias("items"))


def words(df: DataFrame, key: str, column: str) -> DataFrame:
    """Lower-case words of letters and digits."""
    return df.select(F.col(key), F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("items"))
