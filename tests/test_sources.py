from seqloom.operators.dictionary import Dictionary
from seqloom.operators.sequences import Sequences
from seqloom.sources import etl, files
from seqloom.streaming import mining


def test_text_forms(spark, tmp_path):
    d = Dictionary.of(spark, [("x", []), ("y", ["x"]), ("z", [])])
    (tmp_path / "in.del").write_text("1 \t2\n\n3  3\t1\n")
    s = files.read_del(spark, str(tmp_path / "in.del"), d).recompute_dictionary()
    assert sorted(r["items"] for r in s.rows.collect()) == [[], [1, 2], [3, 3, 1]]
    files.write_del(s, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "1\t2", "3\t3\t1"]
    found = s.mine("(.)", 1)
    files.write_patterns(found, str(tmp_path / "patterns"))
    again = files.read_patterns(spark, str(tmp_path / "patterns"), d)
    assert sorted(map(tuple, again.text().collect())) == sorted(map(tuple, found.text().collect()))
    files.write_patterns(found, str(tmp_path / "sids"), "sid")
    assert "2\tx" in {r["value"] for r in spark.read.text(str(tmp_path / "sids")).collect()}
    saved = s.save(str(tmp_path / "saved"))
    assert saved.counted and saved.mine("(.)", 1).stats().first()["patterns"] == 3


def test_dictionary_files(spark, tmp_path):
    d = Dictionary.of(spark, [("x", []), ("y", ["x"])]).recompute_fids()
    for compression, end in (("none", "json"), ("gzip", "json")):
        at = str(tmp_path / f"d-{compression}.{end}")
        files.write_json_dictionary(d, at, compression)
        back = files.dictionary_from(spark, at)
        assert sorted((r["sid"], r["parents"], r["fid"]) for r in back.items.collect()) == [("x", [], 1), ("y", [1], 2)]
    line = '{"fid":1,"gid":7,"sid":"q","dfreq":3,"cfreq":4,"parentGids":[],"noChildren":0,"properties":[{"key":"k","value":{"string":"v"}}]}'
    (tmp_path / "p.json").write_text(line + "\n")
    assert files.dictionary_from(spark, str(tmp_path / "p.json")).items.first()["properties"] == {"k": "v"}
    (tmp_path / "old.del").write_text("x\t5\t4\t1\t0\ny\t2\t2\t2\t1,\n")
    rows = {r["sid"]: (r["gid"], r["dfreq"], r["cfreq"], r["parents"]) for r in files.dictionary_from(spark, str(tmp_path / "old.del")).items.collect()}
    assert rows == {"x": (1, 4, 5, []), "y": (2, 2, 2, [1])}
    (tmp_path / "words.txt").write_text("a b\nb  c\n")
    assert files.read_words(spark, str(tmp_path / "words.txt")).dictionary.size() == 3


def test_sentences(spark):
    token = "struct<index:int,word:string,lemma:string,pos:string,ner:string>"
    t = lambda i, w, p, n="O": (i, w, w.lower(), p, n)
    df = spark.createDataFrame([(1, [t(0, "New", "NNP", "CITY"), t(1, "York", "NNP", "CITY"), t(2, "sleeps", "VBZ"), t(3, "!", "."), t(4, "Paris", "NNP", "CITY")])], f"s_id int, tokens array<{token}>")
    rows, links = etl.sentences(df)
    assert rows.first()["items"] == ["new_york@CITY@ENTITY", "sleeps@sleeps@VB", "paris@CITY@ENTITY"]
    assert ("CITY@ENTITY", "ENTITY") in {tuple(r) for r in links.collect()}


def test_ratings_and_movies(spark):
    rated = spark.createDataFrame([("u", "p1", 5.0, 20), ("u", "p2", 4.0, 10), ("v", "p1", 1.0, 5)], "user string, product string, rating double, timestamp long")
    products = spark.createDataFrame([("p1", [["Books", "Fun"], ["Gifts"]]), ("p2", [["Books"]])], "asin string, categories array<array<string>>")
    rows, links = etl.ratings(rated, products)
    assert {r["user"]: r["items"] for r in rows.collect()} == {"u": ["p2", "p1"], "v": ["p1"]}
    s = Sequences.from_columns(rows, parents=links)
    assert not s.dictionary.is_forest()
    assert {r["pattern"] for r in s.mine("(Books=^)", 2).text().collect()} == {"Books"}
    lines = spark.createDataFrame([("7:", "f"), ("u,3,2005-01-02", "f"), ("v,5,2005-01-01", "f"), ("9:", "f"), ("u,4,2004-01-01", "f")], "value string, file string").coalesce(1)
    titles = spark.createDataFrame([("7", 1999, "T"), ("9", 2000, "U")], "movieId string, year int, title string")
    flat, none = etl.movies(etl.read_ratings_text(lines), titles)
    assert none is None and {r["userId"]: r["items"] for r in flat.collect()} == {"u": ["U#2000#9", "T#1999#7"], "v": ["T#1999#7"]}
    deep, links = etl.movies(etl.read_ratings_text(lines), titles, True)
    s = Sequences.from_columns(deep, parents=links)
    assert {r["pattern"] for r in s.mine("('1999'=^)", 2).text().collect()} == {"1999"}


def test_letters_and_events(spark):
    s = Sequences.from_columns(etl.letters(spark.createDataFrame([("SAR",), ("TXK",), ("",)], "value string")))
    assert {r["pattern"]: r["support"] for r in s.mine("([S|T]).*(.).*([R|K])", 1).text().collect()} == {"S A R": 1, "T X K": 1}
    e = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (2, 1, None), (2, 2, "a")], "u int, t int, x string")
    s = Sequences.from_events(e, "u", ["t"], "x")
    assert {r["pattern"]: r["support"] for r in s.mine("(.)", 1).text().collect()} == {"a": 2, "b": 1}


def test_stream(spark, tmp_path):
    d = Dictionary.of(spark, [("x", []), ("y", [])])
    at = str(tmp_path / "in")
    spark.createDataFrame([([1, 2], 1), ([1, 2, 2], 2)], "items array<int>, weight bigint").write.parquet(at)
    stream = spark.readStream.schema("items array<int>, weight bigint").parquet(at)
    q = mining.start(mining.supports(stream, d, "(..)", 2), "mined", str(tmp_path / "cp"))
    q.processAllAvailable()
    spark.createDataFrame([([2, 2], 5)], "items array<int>, weight bigint").write.mode("append").parquet(at)
    q.processAllAvailable()
    q.stop()
    assert {(r["pattern"], r["support"]) for r in spark.table("mined").collect()} == {("1 2", 3), ("2 2", 7)}
