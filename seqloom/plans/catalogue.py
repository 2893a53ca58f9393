"""Named queries over the test tables and, for each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import Dictionary
from ..operators.sequences import Sequences
from .compiled import compile_
from .compiled import rewrite as rewrite_patex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The event hierarchy of the generalising queries.
EVENTS = [("ENGAGE", []), ("CONVERT", []), ("click", ["ENGAGE"]), ("view", ["ENGAGE"]), ("signup", ["CONVERT"]), ("purchase", ["CONVERT"]), ("error", [])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, hierarchy: bool = False) -> Sequences:
    """Event types of each user by time."""
    e = table(spark, sf_dir, "events")
    if hierarchy:
        s = Sequences.from_events(e, "user_id", ["ts", "event_id"], "event_type", dictionary=Dictionary.of(spark, EVENTS))
        return s.recompute_dictionary()
    types = ["click", "error", "purchase", "signup", "view"]
    return Sequences.from_events(e, "user_id", ["ts", "event_id"], "event_type", dictionary=Dictionary.of(spark, [(t, []) for t in types]))


def orders(spark: SparkSession, sf_dir: str, item: str) -> Sequences:
    """Priorities or states of each customer's orders by date."""
    return Sequences.from_events(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], item)


def baskets(spark: SparkSession, sf_dir: str) -> Sequences:
    """Parts that each customer bought, below their brand and their type (two parents each)."""
    part = table(spark, sf_dir, "part")
    links = part.select(F.concat(F.lit("p"), "p_partkey").alias("child"), F.col("p_brand").alias("parent")).unionByName(part.select(F.concat(F.lit("p"), "p_partkey").alias("child"), F.col("p_type").alias("parent")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("item", F.concat(F.lit("p"), "l_partkey"))
    return Sequences.from_events(rows, "o_custkey", ["o_orderdate", "o_orderkey", "l_linenumber", "l_partkey"], "item", parents=links)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Common table expressions: e, events with their place p from 1 and the length n; c, the closure of the event hierarchy.
EV = "WITH e AS (SELECT user_id AS s, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
TREE = ", c AS (SELECT * FROM (VALUES ('click', 'click'), ('click', 'ENGAGE'), ('view', 'view'), ('view', 'ENGAGE'), ('signup', 'signup'), ('signup', 'CONVERT'), ('purchase', 'purchase'), ('purchase', 'CONVERT'), ('error', 'error')) AS v(t, a))"
OR = "WITH e AS (SELECT o_custkey AS s, {item} AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def sql_of(source: str, pairs: str, support: int, weight: str = "") -> str:
    """pairs selects (s, pattern), possibly repeated."""
    total = "count(*)" if not weight else f"sum({weight})::BIGINT"
    return f"{source}, d AS (SELECT DISTINCT s, pattern FROM ({pairs})) SELECT pattern, {total} AS support FROM d GROUP BY pattern HAVING {total} >= {support}"


def chain(k: int, gaps: int = 1, where: str = "", pick: list[int] | None = None) -> str:
    """k consecutive places (gaps apart) as SQL, those in pick as the pattern."""
    pick = pick if pick is not None else list(range(k))
    joins = " ".join(f"JOIN e e{j} ON e{j}.s = e0.s AND e{j}.p = e0.p + {j * gaps}" for j in range(1, k))
    pattern = " || ' ' || ".join(f"e{j}.t" for j in pick)
    return f"SELECT e0.s, {pattern} AS pattern FROM e e0 {joins}" + (f" WHERE {where}" if where else "")


def mined(name: str, sequences: Callable[[SparkSession, str], Sequences], pattern: str, support: int, sql: str | None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sequences(spark, sf_dir).mine(pattern, support, **options).text()

    run.__name__ = name
    query(sql)(run)


def tree(spark: SparkSession, sf_dir: str) -> Sequences:
    return events(spark, sf_dir, True)


def priorities(spark: SparkSession, sf_dir: str) -> Sequences:
    return orders(spark, sf_dir, "o_orderpriority")


def states(spark: SparkSession, sf_dir: str) -> Sequences:
    return orders(spark, sf_dir, "o_orderstatus")


TRI, FOUR = chain(3), chain(4)
mined("bigram", events, "(..)", 130, sql_of(EV, chain(2), 130))
mined("trigram", events, "(...)", 50, sql_of(EV, TRI, 50))
mined("fourgram", events, "(.){4}", 10, sql_of(EV, FOUR, 10))
mined("ngram_2_4", events, "(.){2,4}", 10, sql_of(EV, f"{chain(2)} UNION ALL {TRI} UNION ALL {FOUR}", 10))
mined("skipgram", events, "(.).(.)", 100, sql_of(EV, chain(2, 2), 100))
GAP2 = "SELECT a.s, a.t || ' ' || b.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p BETWEEN a.p + 1 AND a.p + 3"
GAP3 = "SELECT a.s, a.t || ' ' || b.t || ' ' || c.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p BETWEEN a.p + 1 AND a.p + 3 JOIN e c ON b.s = c.s AND c.p BETWEEN b.p + 1 AND b.p + 3"
mined("bounded_gap", events, "(.)[.{0,2}(.)]{1,1}", 145, sql_of(EV, GAP2, 145))
mined("bounded_gap_2", events, "(.)[.{0,2}(.)]{1,2}", 140, sql_of(EV, f"{GAP2} UNION ALL {GAP3}", 140))
mined("subsequence_2", events, "(.).*(.)", 140, sql_of(EV, "SELECT a.s, a.t || ' ' || b.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p > a.p", 140))
mined("anchored_start", events, "^(.)(.)", 2, sql_of(EV, chain(2, where="e0.p = 1"), 2))
mined("anchored_end", events, "(..) $", 2, sql_of(EV, chain(2, where="e1.p = e1.n"), 2))
mined("anchored_both", events, "^(.).*(.) $", 2, sql_of(EV, "SELECT a.s, a.t || ' ' || b.t AS pattern FROM e a JOIN e b ON a.s = b.s WHERE a.p = 1 AND b.p = b.n AND b.n > 1", 2))
mined("context", events, "signup (.) purchase", 10, sql_of(EV, chain(3, where="e0.t = 'signup' AND e2.t = 'purchase'", pick=[1]), 10))
mined("context_2", events, "error (.{1,2}) signup", 10, sql_of(EV, f"{chain(3, where="e0.t = 'error' AND e2.t = 'signup'", pick=[1])} UNION ALL {chain(4, where="e0.t = 'error' AND e3.t = 'signup'", pick=[1, 2])}", 10))
STATES = OR.format(item="o_orderstatus")
mined("between_star", states, "F (.*) P", 5, sql_of(STATES, "SELECT a.s, string_agg(m.t, ' ' ORDER BY m.p) AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p > a.p + 1 AND a.t = 'F' AND b.t = 'P' JOIN e m ON m.s = a.s AND m.p > a.p AND m.p < b.p GROUP BY a.s, a.p, b.p", 5))
mined("union_first", events, "([click|view] purchase)", 10, sql_of(EV, chain(2, where="e0.t IN ('click', 'view') AND e1.t = 'purchase'"), 10))
mined("optional", events, "(click view? purchase)", 10, sql_of(EV, f"{chain(2, where="e0.t = 'click' AND e1.t = 'purchase'")} UNION ALL {chain(3, where="e0.t = 'click' AND e1.t = 'view' AND e2.t = 'purchase'")}", 10))
RUNS = EV + ", g AS (SELECT *, p - row_number() OVER (PARTITION BY s, t ORDER BY p) AS g FROM e), i AS (SELECT s, count(*) AS k FROM g WHERE t = 'error' GROUP BY s, g), m AS (SELECT s, max(k) AS k FROM i GROUP BY s)"
mined("plus", events, "(error+)", 2, sql_of(RUNS, "SELECT s, rtrim(repeat('error ', k)) AS pattern FROM (SELECT s, unnest(range(1, k + 1)) AS k FROM m)", 2))
mined("repeat_min", events, "(error{2,})", 2, sql_of(RUNS, "SELECT s, rtrim(repeat('error ', k)) AS pattern FROM (SELECT s, unnest(range(2, k + 1)) AS k FROM m)", 2))
mined("repeat_max", events, "(error{,2})", 2, sql_of(RUNS, "SELECT s, rtrim(repeat('error ', k)) AS pattern FROM (SELECT s, unnest(range(1, least(k, 2) + 1)) AS k FROM m)", 2))
mined("regex_subsequence", states, "(F|O)[.*(P)]?.*(O)", 3, sql_of(STATES, "SELECT a.s, a.t || ' ' || b.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p > a.p AND a.t IN ('F', 'O') AND b.t = 'O' UNION ALL SELECT a.s, a.t || ' P ' || b.t FROM e a JOIN e x ON a.s = x.s AND x.p > a.p AND x.t = 'P' JOIN e b ON x.s = b.s AND b.p > x.p AND a.t IN ('F', 'O') AND b.t = 'O'", 3))
EPISODE = " UNION ALL ".join(f"SELECT a.s, a.t || ' ' || b.t || ' ' || c.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p = a.p + {i} JOIN e c ON b.s = c.s AND c.p = b.p + {j}" for i in (1, 2, 3) for j in (1, 2, 3) if i + j <= 4)
mined("serial_episode", events, "(.)[.?.?(.) | .?(.).? | (.).?.?](.)", 120, sql_of(EV, EPISODE, 120))
UP = "SELECT x.s, a.a || ' ' || b.a AS pattern FROM e x JOIN e y ON x.s = y.s AND y.p = x.p + 1 JOIN c a ON a.t = x.t JOIN c b ON b.t = y.t"
mined("generalise_any", tree, "(.^ .^)", 130, sql_of(EV + TREE, UP, 130))
mined("generalise_bounded", tree, "(ENGAGE^)(.)", 130, sql_of(EV + TREE, "SELECT x.s, a.a || ' ' || y.t AS pattern FROM e x JOIN e y ON x.s = y.s AND y.p = x.p + 1 JOIN c a ON a.t = x.t WHERE x.t IN ('click', 'view')", 130))
mined("generalise_constant", tree, "(ENGAGE=^)(.)", 130, sql_of(EV, chain(2, where="e0.t IN ('click', 'view')").replace("e0.t || ' '", "'ENGAGE '"), 130))
mined("descendants_only", tree, "ENGAGE (CONVERT) ENGAGE", 10, sql_of(EV, chain(3, where="e0.t IN ('click', 'view') AND e1.t IN ('signup', 'purchase') AND e2.t IN ('click', 'view')", pick=[1]), 10))
mined("exact_item", tree, "(click=)(.)", 130, sql_of(EV, chain(2, where="e0.t = 'click'"), 130))
mined("priorities_gram", priorities, "(..)", 20, sql_of(OR.format(item="o_orderpriority"), chain(2), 20))
mined("quoted_item", priorities, "('1-URGENT') (.)", 20, sql_of(OR.format(item="o_orderpriority"), chain(2, where="e0.t = '1-URGENT'"), 20))
for _alg in ("kernel", "frontier", "growth"):
    mined(f"trigram_{_alg}", events, "(...)", 50, SQL["trigram"], algorithm=_alg)
    mined(f"generalise_any_{_alg}", tree, "(.^ .^)", 130, SQL["generalise_any"], algorithm=_alg)
mined("context_pruned", events, "signup (.) purchase", 10, SQL["context"], prune_irrelevant=True, algorithm="kernel")

GAP1 = "SELECT s, t AS pattern FROM e UNION ALL SELECT a.s, a.t || ' ' || b.t FROM e a JOIN e b ON a.s = b.s AND b.p BETWEEN a.p + 1 AND a.p + 2 UNION ALL SELECT a.s, a.t || ' ' || b.t || ' ' || c.t FROM e a JOIN e b ON a.s = b.s AND b.p BETWEEN a.p + 1 AND a.p + 2 JOIN e c ON b.s = c.s AND c.p BETWEEN b.p + 1 AND b.p + 2"
TREE1 = EV.replace("WITH e AS", "WITH f AS") + TREE + ", e AS (SELECT f.s, c.a AS t, f.p FROM f JOIN c ON f.t = c.t)"
for _alg in ("growth", "lists", "expression"):

    def _flat(spark: SparkSession, sf_dir: str, alg=_alg) -> DataFrame:
        return events(spark, sf_dir).mine_traditional(120, 1, 3, algorithm=alg).text()

    def _tree(spark: SparkSession, sf_dir: str, alg=_alg) -> DataFrame:
        return tree(spark, sf_dir).mine_traditional(140, 1, 3, True, algorithm=alg).text()

    _flat.__name__, _tree.__name__ = f"traditional_{_alg}", f"traditional_tree_{_alg}"
    query(sql_of(EV, GAP1, 120))(_flat)
    query(sql_of(TREE1, GAP1, 140))(_tree)


@query(sql_of(EV + ", z AS (SELECT DISTINCT s, s % 3 + 1 AS w FROM e)", chain(2), 250).replace("FROM d GROUP", "FROM d JOIN z USING (s) GROUP").replace("count(*) AS support", "sum(w)::BIGINT AS support").replace("HAVING count(*)", "HAVING sum(w)"))
def weighted_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir)
    return s.with_rows(s.rows.withColumn("weight", F.col("seq_id") % 3 + 1)).mine("(..)", 250).text()


BASKET = """WITH o AS (SELECT o_custkey AS s, 'p' || l_partkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT DISTINCT t, a FROM (SELECT 'p' || p_partkey AS t, unnest(['p' || p_partkey, p_brand, p_type]) AS a FROM part)), e AS (SELECT s, a AS t, p FROM o JOIN c USING (t))"""


@query(sql_of(BASKET, "SELECT a.s, a.t || ' ' || b.t AS pattern FROM e a JOIN e b ON a.s = b.s AND b.p = a.p + 1", 100))
def dag_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).mine("(.^ .^)", 100).text()


@query(sql_of(BASKET, "SELECT s, t AS pattern FROM e UNION ALL SELECT a.s, a.t || ' ' || b.t FROM e a JOIN e b ON a.s = b.s AND b.p BETWEEN a.p + 1 AND a.p + 2", 150))
def dag_traditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).mine_traditional(150, 1, 2, True).text()


@query(BASKET + " SELECT t AS sid, count(DISTINCT s) AS dfreq, count(*) AS cfreq FROM e GROUP BY t UNION ALL SELECT DISTINCT a, 0, 0 FROM c WHERE a NOT IN (SELECT t FROM e)")
def item_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).dictionary.items.select("sid", "dfreq", "cfreq")


@query(BASKET + ", q AS (SELECT t AS sid, count(DISTINCT s) AS dfreq FROM e GROUP BY t) SELECT sid, dfreq FROM q WHERE dfreq >= 100")
def flist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).dictionary.frequent(100).select("sid", "dfreq")


@query(EV + TREE + ", q AS (SELECT a AS sid, count(DISTINCT s) AS dfreq, (a IN ('click', 'view', 'signup', 'purchase'))::INTEGER AS depth FROM e JOIN c USING (t) GROUP BY a) SELECT sid, dfreq, row_number() OVER (ORDER BY dfreq DESC, depth, list_position(['ENGAGE', 'CONVERT', 'click', 'view', 'signup', 'purchase', 'error'], sid))::INTEGER AS fid FROM q")
def fids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).dictionary.items.select("sid", "dfreq", "fid")


PARTS = "WITH c AS (SELECT DISTINCT sid, anc FROM (SELECT 'p' || p_partkey AS sid, unnest(['p' || p_partkey, p_brand, p_type]) AS anc FROM part UNION ALL SELECT p_brand, p_brand FROM part UNION ALL SELECT p_type, p_type FROM part))"


def parts(spark: SparkSession, sf_dir: str) -> Dictionary:
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("p"), "p_partkey")
    links = part.select(name.alias("child"), F.col("p_brand").alias("parent")).unionByName(part.select(name.alias("child"), F.col("p_type").alias("parent")))
    return Dictionary.from_data(part.select(F.array(name).alias("items"), F.lit(1).alias("weight")), links)


def named(d: Dictionary, rows: DataFrame) -> DataFrame:
    return rows.join(d.items.select("gid", "sid"), "gid").select("sid")


@query(PARTS + " SELECT sid, anc FROM c")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parts(spark, sf_dir)
    names = d.items.select(F.col("gid").alias("anc"), F.col("sid").alias("name"))
    return d.closure().join(d.items.select("gid", "sid"), "gid").join(names, "anc").select("sid", F.col("name").alias("anc"))


@query(PARTS + " SELECT sid FROM c WHERE anc = 'Brand#12'")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parts(spark, sf_dir)
    return named(d, d.descendants(*[r["gid"] for r in d.lookup("sid", ["Brand#12"]).collect()]))


@query(PARTS + " SELECT DISTINCT anc AS sid FROM c WHERE sid IN ('p1', 'p2')")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parts(spark, sf_dir)
    return named(d, d.ancestors(*[r["gid"] for r in d.lookup("sid", ["p1", "p2"]).collect()]))


@query("SELECT 'p' || p_partkey AS sid FROM part")
def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).leaves().select("sid")


@query("SELECT 'p' || p_partkey AS sid, 1 AS parents FROM part UNION ALL SELECT DISTINCT p_brand, 0 FROM part")
def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary without part types."""
    d = parts(spark, sf_dir)
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("sid"))
    out = d.restrict(d.items.join(kinds, "sid", "left_anti").select("gid"))
    return out.items.select("sid", F.size("parents").alias("parents"))


@query("WITH t AS (SELECT event_type AS sid, user_id % 2 AS h, user_id FROM events) SELECT sid, count(DISTINCT user_id) AS dfreq, count(*) AS cfreq FROM t GROUP BY sid")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries of two halves of the users, merged."""
    e = table(spark, sf_dir, "events")
    halves = [Sequences.from_events(e.where(F.col("user_id") % 2 == h), "user_id", ["ts", "event_id"], "event_type").dictionary for h in (0, 1)]
    return halves[0].merge(halves[1]).items.select("sid", "dfreq", "cfreq")


@query(EV + " SELECT s AS seq_id FROM e GROUP BY s HAVING max((t = 'signup' AND p = 1)::INTEGER) = 1")
def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).relevant("^(signup)").rows.select("seq_id")


@query(f"SELECT count(*) AS patterns, sum(support)::BIGINT AS frequency FROM ({SQL['fourgram']})")
def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).mine("(.){4}", 10).stats()


@query(f"SELECT pattern, support FROM ({SQL['fourgram']}) ORDER BY support DESC, pattern LIMIT 20")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the twenty most frequent 4-grams."""
    return events(spark, sf_dir).mine("(.){4}", 10).text().orderBy(F.col("support").desc(), "pattern").limit(20)


@query(sql_of(EV, chain(2), 130).replace("SELECT pattern,", "SELECT array_to_string(list_transform(string_split(pattern, ' '), lambda x: list_position(['click', 'error', 'purchase', 'signup', 'view'], x)::VARCHAR), ' ') AS pattern,"))
def pattern_gids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).mine("(..)", 130).gids().select(F.concat_ws(" ", F.col("pattern").cast("array<string>")).alias("pattern"), "support")


@query(EV + " SELECT s AS seq_id, string_agg(list_position(['click', 'error', 'purchase', 'signup', 'view'], t)::VARCHAR, chr(9) ORDER BY p) AS line FROM e GROUP BY s")
def del_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).rows.select("seq_id", F.concat_ws("\t", F.col("items").cast("array<string>")).alias("line"))


@query(EV + " SELECT '[' || string_agg(t, ' ' ORDER BY p) || ']' || CASE WHEN s % 2 = 0 THEN '@2' ELSE '' END AS line FROM e GROUP BY s")
def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir)
    return s.with_rows(s.rows.withColumn("weight", F.when(F.col("seq_id") % 2 == 0, 2).otherwise(1))).printed()


@query(EV + ", q AS (SELECT t, row_number() OVER (ORDER BY count(DISTINCT s) DESC, t)::INTEGER AS f FROM e GROUP BY t) SELECT s AS seq_id, string_agg(f::VARCHAR, ' ' ORDER BY p) AS items FROM e JOIN q USING (t) GROUP BY s")
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).recompute_dictionary()
    return s.to_fids().select("seq_id", F.concat_ws(" ", F.col("items").cast("array<string>")).alias("items"))


@query("WITH e AS (SELECT conv_id AS s, role AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)" + sql_of("", chain(3), 5))
def role_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sequences.from_events(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role").mine("(...)", 5).text()


WORDS = "WITH w AS (SELECT doc_id AS s, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), e AS (SELECT s, unnest(w) AS t, unnest(range(len(w))) AS p FROM w)"


@query(sql_of(WORDS, chain(2), 50))
def word_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.etl import words

    return Sequences.from_columns(words(table(spark, sf_dir, "documents"), "doc_id", "text"), key="doc_id").mine("(..)", 50).text()


@query(f"SELECT t AS pattern, sum(support)::BIGINT AS support FROM (SELECT DISTINCT pattern, support, unnest(string_split(pattern, ' ')) AS t FROM ({sql_of(EV, chain(2), 135)})) GROUP BY t HAVING sum(support) >= 500")
def mined_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of frequent bigrams, weighted by the bigrams' support: results are sequences again."""
    return events(spark, sf_dir).mine("(..)", 135).sequences().mine("(.)", 500).text()


@query("SELECT '[#3|#4]' AS written WHERE false UNION ALL SELECT '(#3 #6?) #1+'")
def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = rewrite_patex("(click purchase?) ENGAGE+", Dictionary.of(spark, EVENTS), "gid")
    return spark.createDataFrame([(text,)], "written string")


@query("SELECT 3 AS states, 2 AS finals")
def transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a minimised transducer."""
    fst = compile_("^(click)(view)? $", Dictionary.of(spark, EVENTS)).fst
    return spark.createDataFrame([(fst.n, len(fst.finals))], "states int, finals int")
