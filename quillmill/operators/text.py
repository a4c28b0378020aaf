"""Texts: cleaning, n-grams, tf-idf, similarity of vectors and titles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.plans import checkpointed, split_join

# Frequent English words left out of counts.
STOP_WORDS = tuple("a about after all also an and any are as at be because been before between both but by can could did do does during each few for from had has have he her here his how however i if in into is it its just may more most no nor not of off on only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split())

# Accented letters and the letters they are folded to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"


#: Languages of Spark's own lists.
LISTED = ("danish", "dutch", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish")


def stop_words(language: str, tables: dict[str, Iterable[str]] | None = None) -> tuple[str, ...]:
    """Frequent words of a language by its English name: from the caller's ``tables``, or from Spark's own lists.

    For a language of neither, such as Polish or Chinese, the caller gives a table, or takes the :func:`frequent_words` of a corpus.
    """
    from pyspark.ml.feature import StopWordsRemover

    name = language.lower()
    if tables and name in tables:
        return tuple(tables[name])
    if name != "english" and name not in LISTED:
        raise ValueError(f"no list of words for {language}: give one in tables")
    return STOP_WORDS if name == "english" else tuple(StopWordsRemover.loadDefaultStopWords(name))


def frequent_words(docs: DataFrame, text: str, share: float = 0.2) -> DataFrame:
    """(word, n): the words of any script that stand in at least ``share`` of the texts."""
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("\\p{L}+"), 0))).alias("word"))
    total = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("_t"))
    return words.groupBy("word").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("_t")).drop("_t")  # one row


def clean_text(c: Column, stop_words: tuple[str, ...] = (), lowercase: bool = True, special: bool = True, accents: bool = True, numbers: bool = True, custom: tuple[str, ...] = ()) -> Column:
    """Cleaning in the fixed order: small letters, stop words, custom words, special characters, accents, numbers.

    Special characters are removed before accents are folded, so an accented letter is lost when both are asked for (the literal
    rule); apostrophes survive. Blanks are squeezed at the end.
    """
    out = F.lower(c) if lowercase else c
    for words in (stop_words, custom):
        if words:
            out = _without(out, words)
    if special:
        out = F.regexp_replace(out, "[^a-zA-Z0-9' ]+", "")
    if accents:
        out = F.translate(out, ACCENTED + ACCENTED.upper(), FOLDED + FOLDED.upper())
    if numbers:
        out = F.regexp_replace(out, "[0-9]+", "")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def _without(c: Column, words: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(F.split(c, " +"), lambda w: ~w.isin(*words)), " ")


def tokens(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of two or more ASCII letters or digits, in small letters, without stop words; accents separate."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def ngrams(docs: DataFrame, text: str, n: int, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(ngram, n) counted over all texts; stop words go before words are joined."""
    words = docs.where(F.col(text).isNotNull()).select(tokens(F.col(text), stop_words).alias("_t")).where(F.size("_t") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda i: F.array_join(F.slice("_t", i, n), " "))
    return words.select(F.explode(runs).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each row of length 1. n counts texts that are not null."""
    tf = term_frequencies(docs, key, text)
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    n = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("_n"))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)).alias("_w"))  # one row
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return weighed.join(norms, key).select(key, "term", (F.col("_w") / F.col("_l")).alias("weight"))


def word_weights(docs: DataFrame, text: str, top: int) -> DataFrame:
    """(term, n, weight): the most frequent words and their frequency relative to the first."""
    counted = docs.where(F.col(text).isNotNull()).select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.col("n").desc(), "term").limit(top)
    return best.crossJoin(F.broadcast(best.agg(F.max("n").alias("_m")))).select("term", "n", F.round(F.col("n") / F.col("_m"), 6).alias("weight"))


def with_words(docs: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Texts that hold every word of ``words``."""
    return docs.where(F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), w)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; null where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Queries, and vectors, that are multiplied at once.
QUERY_BLOCK, VECTOR_BLOCK = 10_000, 100_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query, neighbour, score, place): the k most similar vectors of each query vector, itself aside; ties to smaller keys.

    Exact search in blocks. Up to ``block`` queries reach the tasks as one matrix; more are cut into blocks, and each meets
    each block of vectors in a task of its own, all in one job. A task sends on its k best for each query only. Vectors
    that are null or of length 0 have no neighbours and are none.
    """
    kind = vectors.schema[key].dataType.simpleString()
    found = f"query {kind}, neighbour {kind}, score double"
    rows = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    asked = queries.where(F.col(vector).isNotNull()).select(key, vector)
    own = asked.limit(block + 1).toPandas()
    if len(own) <= block:
        sent = vectors.sparkSession.sparkContext.broadcast(_scaled(own, key, vector))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in it:
                yield _best(sent.value, _scaled(d, key, vector), k)

        parts = rows.mapInPandas(run, found)
    else:
        nq, nv = -(-asked.count() // block), -(-rows.count() // vector_block)
        place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        left = asked.withColumn("_q", place(nq)).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
        right = rows.withColumn("_v", place(nv)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

        def met(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            return _best(_scaled(q, key, vector), _scaled(d, key, vector), k)

        parts = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(met, found)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "neighbour"))
    return parts.withColumn("place", order).where(F.col("place") <= k)


def _scaled(d: pd.DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of length 1, those of length 0 left out."""
    m = np.stack([np.asarray(v, float) for v in d[vector]]) if len(d) else np.zeros((0, 1))
    length = np.sqrt((m * m).sum(axis=1))
    return d[key].to_numpy()[length > 0], m[length > 0] / length[length > 0, None]


def _best(queries: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    ids, names = queries[0], vectors[0]
    if not len(ids) or not len(names):
        return pd.DataFrame({"query": ids[:0], "neighbour": names[:0], "score": np.zeros(0)})
    out = []
    for at in range(0, len(ids), 512):  # so that the scores of a block stay within some hundred MB
        q = ids[at : at + 512]
        score = np.round(queries[1][at : at + 512] @ vectors[1].T, 6)
        score[q[:, None] == names[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(names, score.shape), -score), axis=1)[:, :k]
        out.append(pd.DataFrame({"query": np.repeat(q, order.shape[1]), "neighbour": names[order.ravel()], "score": np.take_along_axis(score, order, axis=1).ravel()}))
    d = pd.concat(out)
    return d[np.isfinite(d["score"])]


def trigram_text(c: Column) -> Column:
    """The text of which trigrams are taken: small ASCII letters and digits, anything else one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _signature(grams: Column, word: int) -> Column:
    """One of the four words of a signature in which each trigram sets the bit of its hash."""
    bit = lambda x: F.pmod(F.xxhash64(x), F.lit(256))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit(x) % 64).cast("int"))
    return F.aggregate(F.filter(grams, lambda x: F.floor(bit(x) / 64) == word), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(one(x)))


def trigram_pairs(a: DataFrame, b: DataFrame, key: str, text: str, least: float = 0.7, across: bool = True) -> DataFrame:
    """(a, b, jaccard): texts of two tables by the Jaccard measure of their distinct character trigrams.

    ``across`` false: the tables are one and the same, and each pair comes out once, a < b.
    Rows meet through shared trigrams, rare ones first: a text is looked up by the rarest trigrams that any text as similar
    must share with it, so common trigrams pair nothing. Texts of too unlike sizes, trigrams at places after which too few are
    left, and texts whose signatures of 256 bits differ in more bits than similar ones have unlike trigrams, make no pair.
    """
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 2)), lambda i: F.substring(t, i, F.lit(3))))
    norm = lambda df, k: df.where(F.col(text).isNotNull()).select(F.col(key).alias(k), grams(trigram_text(F.col(text))).alias(f"_{k}"))
    left, right = norm(a, "a"), norm(b, "b")
    df = left.select(F.explode("_a").alias("g")).unionAll(right.select(F.explode("_b").alias("g"))).groupBy("g").agg(F.count("*").alias("_n"))

    def prefixed(rows: DataFrame, k: str) -> DataFrame:
        bits = [f"_s{j}{k}" for j in range(4)]
        listed = rows.select(k, F.size(f"_{k}").alias("_m"), F.explode(f"_{k}").alias("g")).join(df, "g").groupBy(k, "_m").agg(F.array_sort(F.collect_list(F.struct("_n", "g"))).alias("_s"))
        keep = F.col("_m") - F.ceil(F.col("_m") * least).cast("int") + 1
        listed = listed.join(rows.select(k, *(_signature(F.col(f"_{k}"), j).alias(b) for j, b in enumerate(bits))), k)
        probes = listed.select(k, *bits, F.col("_m").alias(f"_m{k}"), F.posexplode(F.slice("_s", F.lit(1), keep)).alias(f"_p{k}", "_x"))
        return checkpointed(probes.select(k, *bits, f"_m{k}", f"_p{k}", F.col("_x.g").alias("g")))

    ma, mb, pa, pb = (F.col(c) for c in ("_ma", "_mb", "_pa", "_pb"))
    reach = F.least(pa, pb) + 1 + F.least(ma - pa, mb - pb) - 1
    unlike = sum((F.bit_count(F.col(f"_s{j}a").bitwiseXOR(F.col(f"_s{j}b"))) for j in range(4)), F.lit(0))
    can = (unlike <= (ma + mb) * ((1 - least) / (1 + least)) + 1e-6) & (F.least(ma, mb) >= F.greatest(ma, mb) * least - 1e-6) & (reach >= (ma + mb) * (least / (1 + least)) - 1e-6)
    met = split_join(prefixed(left, "a"), prefixed(right, "b"), ["g"]).where(can).select("a", "b").where(F.lit(True) if across else F.col("a") < F.col("b")).distinct()
    both = met.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_a", "_b"))
    score = common / (F.size("_a") + F.size("_b") - common)
    return both.select("a", "b", score.alias("jaccard")).where(F.col("jaccard") >= least)


def prompt_table(df: DataFrame, columns: list[str], limit: int, char_limit: int) -> str:
    """The first rows of a result as text, cut to ``char_limit``: what a question about a result table is made of."""
    rows = df.select(*columns).limit(limit).collect()
    return "\n".join([" | ".join(columns), *(" | ".join(str(v) for v in r) for r in rows)])[:char_limit]
