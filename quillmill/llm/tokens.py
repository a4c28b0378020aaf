"""Token ids of whole texts, as a column (problem 7).

The automaton of merge_automaton.py runs in Arrow-batched functions, one compiled copy in each Python
worker. The vocabulary travels as a broadcast of its merges, about 1.5 MB, a size that the vocabulary fixes
and the data cannot change. There is no shuffle: one scan, one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.merge_automaton import MergeAutomaton, automaton, emitted, read_vocabulary


def compiled(spark: SparkSession, vocabulary: str) -> Callable[[], MergeAutomaton]:
    """A function for the workers that gives the automaton of a tokenizer's JSON file.

    The file is read on the driver only; workers get its merges by broadcast.
    """
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    return lambda: automaton(sent.value)


def _texts(batch: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in batch)


def token_ids(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """Array of the token ids of ``text``, without special tokens; null and empty texts have an empty array."""
    get = compiled(spark, vocabulary)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = get().encode
        for batch in it:
            rows = [encode(x) for x in _texts(batch)]
            ends = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.fromiter((x for r in rows for x in r), np.int32, int(ends[-1]))
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(text)


def token_count(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """Number of token ids of ``text``; 0 for null and empty texts. The ids stay in the worker."""
    get = compiled(spark, vocabulary)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = get().encode
        for batch in it:
            yield pa.array([len(encode(x)) for x in _texts(batch)], pa.int32())

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "int")(text)


def text_of_ids(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """The text that a list of ids spells, by emitting the arcs' labels; null for null."""
    get = compiled(spark, vocabulary)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emits = get().decoder()
        for batch in it:
            yield pa.array([emitted(x.as_py(), emits) for x in batch], pa.string())

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def encode_corpus(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of its column ``text`` in the column ``ids``.

    Defined results: null and empty texts get an empty array; blanks and odd characters are bytes like any
    other; the spelling of a special token is ordinary text; a text of any length is encoded whole. Repeated
    rows are encoded each, an empty table stays empty, and a column already named ``ids`` is replaced. Vocabularies that normalise
    texts, such as those without capitals, do so first; texts of blanks only may then have no ids.
    """
    return df.withColumn(ids, token_ids(df.sparkSession, F.col(text), vocabulary))


def decode_corpus(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its column ``ids`` in the column ``text``; ids outside the vocabulary emit nothing."""
    return df.withColumn(text, text_of_ids(df.sparkSession, F.col(ids), vocabulary))
