from pyspark.sql import functions as F

from lodeline.operators import blocks, dense, lexical, search
from lodeline.plans import stored
from tests.test_blocks import shuffled


def test_queries_are_made_once(spark):
    """rrf_fuse, search_topk, search_rendered: what finds the queries and their vectors runs once, however often the routes read them."""
    docs = spark.range(60).select(F.lit("n").alias("namespace"), F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("red w"), F.col("id") % 7).alias("text"), F.lit("x").alias("subject"), F.lit("f").alias("source"))
    vectors = docs.select(F.lit("c").alias("collection_name"), "chunk_id", F.array(F.lit(1.0), F.col("chunk_id").cast("double")).cast("array<float>").alias("embedding"))
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def asked(text):
        made.add(1)
        return text

    asked = asked.asNondeterministic()
    queries = docs.limit(9).coalesce(1).select(F.col("chunk_id").alias("query_id"), "namespace", F.lit("c").alias("collection_name"), asked("text").alias("query"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("query_vec"))
    near, words = search.routes(queries, lexical.word_index(docs), vectors, 5)
    assert near.count() == words.count() == 45
    assert made.value == 9


def counted(spark, df, column):
    """The rows with a column that counts, in the accumulator, how often a row is made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(text):
        made.add(1)
        return text

    return df.withColumn(column, same.asNondeterministic()(column)), made


def test_routes_fetch_queries_by_one_job(spark):
    """search_topk: queries are not counted by one reading and fetched by another."""
    docs = spark.range(60).select(F.lit("n").alias("namespace"), F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("red w"), F.col("id") % 7).alias("text"), F.lit("x").alias("subject"), F.lit("f").alias("source"))
    index = lexical.word_index(docs)
    queries = docs.limit(9).coalesce(1).select(F.col("chunk_id").alias("query_id"), "namespace", F.col("text").alias("query"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("query_vec"))
    asked, made = counted(spark, queries, "query")
    found = lexical.bm25(asked, index, 5)
    assert made.value == 9 and found.count() == 45
    asked, made = counted(spark, queries, "query_id")
    found = dense.dense_top_k(asked, docs.select(F.col("chunk_id").alias("id"), F.array(F.lit(1.0), F.col("chunk_id").cast("double")).cast("array<float>").alias("vec")), 5)
    assert made.value == 9 and found.count() == 45
    rows, made = counted(spark, docs.select("chunk_id").coalesce(1), "chunk_id")
    few = blocks.broadcast_few(rows)
    assert few.count() == docs.join(few, "chunk_id").count() == made.value == 60
    assert blocks.broadcast_few(rows, 59).count() == 60
    assert lexical.bm25(queries.limit(0), index, 5).count() == dense.dense_top_k(queries.limit(0), docs.select(F.col("chunk_id").alias("id"), F.array(F.lit(1.0)).alias("vec")), 5).count() == 0


def test_best_are_passed_on_by_few_tasks(spark):
    """search_topk: a table of many parts doesn't have each part pass on the best of every query."""
    rows = spark.range(4_000, numPartitions=100).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("vec"))
    asked = rows.limit(20).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    df = dense.dense_top_k(asked, rows, 10)
    assert df.count() == 200 and shuffled(df) < 2_500  # 20 000


def test_stored_terms_are_one_text(spark, tmp_path):
    """search_topk: the stored index has no lists of short texts; documents without words, and without subject, count as before."""
    rows = [("n", "1", "a b a 角", "x", "f"), ("n", "2", "", "x", "f"), ("n", "3", None, None, "f"), ("n", "4", "b", None, "f"), ("m", "1", "b", "x", "f")]
    spark.createDataFrame(rows, "namespace string, chunk_id string, text string, subject string, source string").write.parquet(f"{tmp_path}/lexical_documents.parquet")
    held = stored.word_index(spark, str(tmp_path))
    assert dict(held.packed.dtypes)["words"] == "string" and "array<string>" not in dict(held.packed.dtypes).values()
    assert {(r.namespace, r.chunk_id): dict(zip(r.terms, r.tfs, strict=True)) for r in held.documents.collect()} == {("n", "1"): {"a": 2, "b": 1, "角": 1}, ("n", "2"): {}, ("n", "3"): {}, ("n", "4"): {"b": 1}, ("m", "1"): {"b": 1}}
    assert sorted(((r.namespace, r.subject or "", r.term, r.df) for r in held.terms.collect())) == [("m", "x", "b", 1), ("n", "", "b", 1), ("n", "x", "a", 1), ("n", "x", "b", 1), ("n", "x", "角", 1)]
    asked = spark.createDataFrame([("q", "n", "b 角")], "query_id string, namespace string, query string")
    assert [r.chunk_id for r in lexical.bm25(asked, held, 5).orderBy("rank").collect()] == ["1", "4"]


def test_texts_stay_where_they_lie(spark):
    """search_rendered: texts of documents that were not found are not shuffled to look for those that were; a chunk without a document stays."""
    docs = spark.range(1, 400).select(F.lit("n").alias("namespace"), F.col("id").cast("string").alias("chunk_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" long"), 1_000)).alias("text"), F.lit("x").alias("subject"), F.lit("f").alias("source"))
    vectors = spark.range(400).select(F.lit("c").alias("collection_name"), F.col("id").cast("string").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"))
    queries = spark.createDataFrame([(1, "n", "c", "7", [1.0, 0.0])], "query_id int, namespace string, collection_name string, query string, query_vec array<float>")
    index = lexical.word_index(docs)
    index.packed, index.terms, index.sizes = (df.checkpoint() for df in (index.packed, index.terms, index.sizes))
    df = search.search(queries, index, vectors)
    rows = {r.chunk_id: r.text for r in df.collect()}
    assert len(rows) == 5 and rows["0"] is None and rows["1"].startswith("1 long")
    assert shuffled(df, "dataSize") < 500_000  # bytes, of 2 000 000
    assert {r.chunk_id: r.text for r in search.bodies(df.select("query_id", "chunk_id", "rank"), docs).collect()} == rows
