"""Projections, clusters, topics and word vectors by Spark's own algorithms, in place of models that are not available."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import PCA, CountVectorizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.text import tokens


def clusters(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """(key, x, y, cluster): two principal components and the k-means cluster of each vector."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows)
    flat = PCA(k=2, inputCol="_v", outputCol="_p").fit(found).transform(found).withColumn("_p", vector_to_array("_p"))
    return flat.select(key, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), "cluster")


def topics(docs: DataFrame, k: int, text: str = "text", words: int = 8, vocabulary: int | None = None, seed: int = 7) -> DataFrame:
    """(topic, place, term, weight): the leading words of topics found by latent Dirichlet allocation (a substitute).

    The model knows every word of two texts or more, unless ``vocabulary`` bounds their number.
    """
    rows = docs.where(F.col(text).isNotNull()).select(tokens(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    if vocabulary is None:
        held = rows.select(F.explode(F.array_distinct("_t")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").count()
        vocabulary = max(held, 1)
    counter = CountVectorizer(inputCol="_t", outputCol="_v", vocabSize=vocabulary, minDF=2).fit(rows)
    model = LDA(k=k, maxIter=5, seed=seed, featuresCol="_v").fit(counter.transform(rows))
    names = docs.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "_i int, term string")
    long = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "_z"))
    # k times ``words`` rows
    return names.join(F.broadcast(long), F.col("_i") == F.col("_z.termIndices")).select("topic", "place", "term", F.col("_z.termWeights").alias("weight"))


def similar_words(docs: DataFrame, word: str, n: int, text: str = "text", size: int = 50, seed: int = 7) -> DataFrame:
    """(word, similarity): the nearest words of word vectors trained on the texts (a substitute)."""
    rows = docs.where(F.col(text).isNotNull()).select(tokens(F.col(text)).alias("_t"))
    model = Word2Vec(vectorSize=size, minCount=5, seed=seed, maxIter=1, inputCol="_t", outputCol="_v").fit(rows)
    return model.findSynonyms(word, n)
