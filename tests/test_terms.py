"""Terms are counted in the row of their chunk."""

from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import corpus, rank


def _rows(df, *names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


def test_terms_of_repeated_files_count_once_and_nothing_is_shuffled(spark):
    files = spark.createDataFrame([("a", "x y\nx"), ("a", "x y\nx"), ("a", "z"), ("b", "fooBar\r\nfoo"), ("c", " "), ("d", "")], "path string, text string").repartition(2)
    chunks = corpus.chunks(corpus.once(files))
    every = corpus.chunks(files).select("id", F.explode(rank.all_terms()).alias("term"))
    tf = rank.term_frequencies(chunks)
    assert _rows(tf, "id", "term", "tf") == _rows(every.groupBy("id", "term").agg(F.count("*").alias("tf")), "id", "term", "tf")
    assert _rows(rank.document_frequencies(chunks), "term", "df") == _rows(every.distinct().groupBy("term").agg(F.count("*").alias("df")), "term", "df")
    plain = rank.term_frequencies(corpus.chunks(spark.createDataFrame([("a", "x x")], "path string, text string")))
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_edges_of_files_with_repeated_paths(spark):
    files = spark.createDataFrame([("a", "one two"), ("a", "one three"), ("b", "one two four"), ("c", "four"), ("c", "four"), ("d", "two")], "path string, text string")
    assert _rows(rank.rare_term_edges(files), "src", "dst") == [("a", "b"), ("b", "c")]


def test_terms_of_a_whole_text_are_those_of_its_words(spark):
    texts = ["Ab cD", "HTTPServer x", "ΑΣ ΒΣ. Σ", "İx İ", "plain Words Ünï 12 Ⅷ K", "a_b", "", "x_ _y __z__"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    split = F.flatten(F.transform(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*)"), 1), lambda w: T.terms(w)))
    assert [r.a for r in df.select(T.terms(F.col("t")).alias("a")).collect()] == [r.a for r in df.select(split.alias("a")).collect()]
