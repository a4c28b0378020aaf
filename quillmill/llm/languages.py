"""Languages of documents and of their parts (problem 9): multilingual mixture inference.

A character model of each language gives the likelihood of every word. A document is a mixture: each of its sentences is
drawn from one of a set of languages with the document's proportions. Expectation-maximisation estimates the
proportions from the sentences' likelihoods; the set of languages is chosen by penalised likelihood, languages
being dropped as long as that does not cost more than their price. Neighbouring sentences are then joined to
stretches by the best path, on which a change of language has a price too.

The models are interpolated character n-grams, trained here on a bounded sample of labelled documents; labels may be
wrong, so the sample is read twice: the second time each sentence counts for the language that the first models
give it. Its words are counted by the executors, and only counts reach the driver. The models' tables, some MB whatever
the corpus, are broadcast. Documents are then read once, without a shuffle.

Every sentence counts, however short; the prices decide. Only what stands inside a sentence in quotes or brackets does not
count for its language; a quotation of sentences is sentences. A heading, and a word that stands as a sentence by itself, are
part of the sentence that follows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.plans import broadcast_if_small, written

#: Labelled documents of each language that the models are fitted on; the bound of the sample.
SAMPLE_DOCUMENTS = 1500

#: Characters of context.
ORDER = 4

#: Price of a language in a document, and of a change of language between sentences, in nats.
LANGUAGE_PRICE, CHANGE_PRICE = 6.0, 3.0

#: Part of a word's likelihood that counts: the letters of a word are not independent of each other and of its neighbours.
TEMPER = 0.6

#: Share of words, such as names, that may stand in a text of any language; it bounds what one word can say.
FOREIGN = 0.05

#: Words remembered by each Python worker.
WORD_MEMORY = 300_000

#: Words; where none are set apart, every letter is one.
WORD = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}--[\p{Han}\p{Hiragana}\p{Katakana}]]+(?:['’][\p{L}--[\p{Han}\p{Hiragana}\p{Katakana}]]+)*")
#: Ends of sentences: punctuation before white space, or line ends.
END = regex.compile(r"(?<=[.!?…][\"”»’')\]]{0,2})\s+(?=[^\s\p{Ll}])|(?<=[。！？][”」』）]{0,2})\s*|[\r\n]+")
#: What may stand inside a sentence: titles and words in quotes, remarks in brackets, mark-up and addresses.
ASIDE = regex.compile(r"«[^«»\r\n]*»|“[^“”\r\n]*”|„[^„“”\r\n]*[“”]|\"[^\"\r\n]*\"|\([^()\r\n]*\)|\[[^\[\]\r\n]*\]|<[^<>\r\n]*>|https?://\S+|\S+@\S+")
#: The end of a sentence within an aside, and marks that end a part of a text.
INNER_END = regex.compile(r"[.!?…]\s+(?=\p{Lu})|[。！？](?=\p{L})")
ADDRESS = regex.compile(r"<[^<>\r\n]*>|https?://\S+|\S+@\S+")
STOPPED = regex.compile(r"[.!?…。！？](?:\s?[\"”»’')\]」』）])*\s*$")


def folded(word: str) -> str:
    """Small letters without accents, as texts lose their accents now and then."""
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c)).replace("’", "'")


@dataclass
class Models:
    """Character models of languages; ``tables[n]`` has the log probabilities of contexts of n characters."""

    languages: list[str]
    probabilities: dict[str, np.ndarray]
    unseen: np.ndarray
    known: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, w: str) -> np.ndarray:
        """Log-likelihood of a word in each language."""
        found = self.known.get(w)
        if found is None:
            text, total = f" {folded(w)} ", np.zeros(len(self.languages))
            for i in range(1, len(text)):
                for n in range(min(ORDER, i), -1, -1):
                    p = self.probabilities.get(text[i - n : i + 1])
                    if p is not None:
                        total += p
                        break
                else:
                    total += self.unseen
            if len(self.known) >= WORD_MEMORY:
                self.known.clear()
            like = np.exp((total - total.max()) * TEMPER)
            found = self.known[w] = np.log((1 - FOREIGN) * like + FOREIGN * like.mean())
        return found

    def likelihood(self, words: list[str]) -> np.ndarray:
        return np.sum([self.word(w) for w in words], axis=0) if words else np.zeros(len(self.languages))


def fitted(counts: dict[str, Counter]) -> Models:
    """Models from the counts of folded words of each language, interpolated from long contexts to short ones."""
    languages = sorted(counts)
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for k, lang in enumerate(languages):
        for word, n in counts[lang].items():
            text = f" {word} "
            for i in range(1, len(text)):
                for m in range(min(ORDER, i) + 1):
                    grams[text[i - m : i + 1]][k] += n
    after: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    kinds: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for g, n in grams.items():
        after[g[:-1]] += n
        kinds[g[:-1]] += n > 0
    alphabet = max(30, len({g[-1] for g in grams}))
    out: dict[str, np.ndarray] = {}
    for g in sorted(grams, key=len):
        lower = out[g[1:]] if len(g) > 1 else np.full(len(languages), 1.0 / alphabet)
        weight = kinds[g[:-1]] + 1e-9
        # shared contexts: a gram counts a little in every language, so that names say nothing about it
        out[g] = (grams[g] + weight * lower) / (after[g[:-1]] + weight)
    return Models(languages, {g: np.log(np.maximum(p, 1e-12)) for g, p in out.items()}, np.full(len(languages), -math.log(10.0 * alphabet)))


def without_asides(text: str) -> str:
    """``text`` with blanks in place of what stands inside its sentences in quotes or brackets.

    What begins where a sentence begins and holds its end, and what holds the ends of two sentences or more, is no aside.
    """
    out, at, shown, first = [], 0, 0, len(text) - len(text.lstrip())
    while (m := ASIDE.search(text, at)) is not None:
        a, b = m.span()
        before = text[shown:a].rstrip(" \t") if a - shown < 200 else text[a - 200 : a].rstrip(" \t")
        opens = a <= first or before.endswith(("\n", "\r")) or STOPPED.search(before[-4:]) is not None
        ends = m.group()[0] in "«“„\"([" and (STOPPED.search(m.group()) is not None or text[b : b + 1] in (".", "!", "?", "…", "。"))
        if (opens and ends) or len(INNER_END.findall(m.group())) > 1:
            at = a + 1
        else:
            out += [text[shown:a], " " * (b - a)]
            at = shown = b
    return "".join([*out, text[shown:]])


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, with those of the headings before it.

    A line without the end of a sentence, and a single word, belong to what follows. A sentence that is an aside as a whole counts
    by its own words.
    """
    bare = without_asides(text)
    cuts, start = [], 0
    for m in END.finditer(bare):
        cuts.append((start, m.start()))
        start = m.end()
    cuts.append((start, len(text)))
    out: list[list[str]] = []
    held: list[str] = []
    for a, b in cuts:
        words = WORD.findall(bare[a:b]) or WORD.findall(ADDRESS.sub(" ", text[a:b]))
        if not words:
            continue
        held += words
        if len(words) > 1 and STOPPED.search(bare[a:b]):
            out.append(held)
            held = []
    return [*out, held] if held else out


def proportions(lik: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions of the allowed languages by expectation-maximisation, and the log-likelihood reached."""
    n, k = lik.shape
    top = lik[:, allowed].max(axis=1, keepdims=True)
    like = np.where(allowed, np.exp(np.minimum(lik - top, 0)), 0.0)
    pi = np.where(allowed, 1.0 / allowed.sum(), 0.0)
    for _ in range(rounds):
        joint = like * pi
        mix = joint.sum(axis=1, keepdims=True)
        new = (joint / mix).sum(axis=0) / n
        if np.abs(new - pi).max() < 1e-6:
            pi = new
            break
        pi = new
    return pi, float((np.log((like * pi).sum(axis=1)) + top[:, 0]).sum())


def chosen(lik: np.ndarray, price: float = LANGUAGE_PRICE) -> tuple[np.ndarray, np.ndarray]:
    """(allowed, proportions): the set of languages with the best penalised likelihood, by dropping one at a time."""
    allowed = np.zeros(lik.shape[1], bool)
    allowed[np.unique(lik.argmax(axis=1))] = True
    pi, value = proportions(lik, allowed)
    while allowed.sum() > 1:
        best = None
        for k in np.flatnonzero(allowed):
            fewer = allowed.copy()
            fewer[k] = False
            p, v = proportions(lik, fewer)
            if best is None or v > best[1]:
                best = (k, v, p)
        if best[1] + price < value:
            break
        allowed[best[0]] = False
        pi, value = best[2], best[1]
    return allowed, pi


def best_path(scores: np.ndarray, price: float = CHANGE_PRICE) -> list[int]:
    """The language of each sentence on the path of the greatest sum of scores, less the price of changes."""
    n, k = scores.shape
    total, came = scores[0].copy(), np.zeros((n, k), int)
    for t in range(1, n):
        top = int(total.argmax())
        change = total[top] - price
        came[t] = np.where(total >= change, np.arange(k), top)
        total = np.maximum(total, change) + scores[t]
    at, path = int(total.argmax()), []
    for t in range(n - 1, -1, -1):
        path.append(at)
        at = int(came[t, at])
    return path[::-1]


def stretches(models: Models, text: str | None) -> list[tuple[int, str, float]]:
    """(seg_no, language, confidence) of the longest stretches in one language; none for a text without words.

    The confidence is the mean posterior probability of the stretch's language over its sentences.
    """
    parts = sentences(text) if text else []
    if not parts:
        return []
    lik = np.stack([models.likelihood(p) for p in parts])
    allowed, pi = chosen(lik)
    with np.errstate(divide="ignore"):
        scores = np.where(allowed, lik + np.log(np.maximum(pi, 1e-300)), -1e18)
    posterior = np.exp(scores - scores.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    if allowed.sum() == 1:
        # against all languages, not only against the one that is left
        own = int(np.flatnonzero(allowed)[0])
        total = lik.sum(axis=0)
        return [(0, models.languages[own], float(1.0 / np.exp(np.minimum(total - total[own], 700)).sum()))]
    out: list[tuple[int, str, float]] = []
    path, start = best_path(scores), 0
    for t in range(1, len(path) + 1):
        if t == len(path) or path[t] != path[start]:
            out.append((len(out), models.languages[path[start]], float(posterior[start:t, path[start]].mean())))
            start = t
    return out


def sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(language, text) of at most ``size`` labelled documents of each language, chosen by the hash of their ids."""
    known = documents.where("text is not null").join(_named(labels), "lang")
    counts = {r["_l"]: r["n"] for r in known.groupBy("_l").agg(F.count("*").alias("n")).collect()}  # as many rows as languages
    # about twice the sample passes the hash, so that no more than that is sorted, however large the corpus is
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * size / n)))) if counts else F.create_map(F.lit(""), F.lit(0.0))
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(share, F.col("_l")) * 1_000_003)
    order = Window.partitionBy("_l").orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.select("_l", "doc_id", "text").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).select(F.col("_l").alias("language"), "text")


def _named(labels: DataFrame) -> DataFrame:
    """(lang, _l): how documents write a language, and its code."""
    return broadcast_if_small(labels.select(F.col("label").alias("lang"), F.col("lang").alias("_l")).where("_l is not null").distinct())


def counted(parts: Iterable[tuple[str, list[str]]], models: Models | None = None) -> dict[str, Counter]:
    """Counts of folded words by language, of (label, sentence); with models, by the language in which a sentence is surely found."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, p in parts:
        if models is not None:
            lik = models.likelihood(p)
            order = np.argsort(lik)
            if len(order) > 1 and lik[order[-1]] - lik[order[-2]] <= 3:
                continue
            lang = models.languages[int(order[-1])]
        counts[lang].update(map(folded, p))
    return counts


def trained(texts: list[tuple[str, str]], rounds: int = 2) -> Models:
    """Models of labelled texts in memory; after the first round sentences count for the language they are found in."""
    parts = [(lang, p) for lang, t in texts for p in sentences(t)]
    models = None
    for _ in range(rounds):
        models = fitted(counted(parts, models))
    return models


def trained_on(texts: DataFrame, rounds: int = 2) -> Models | None:
    """:func:`trained` of a table (language, text), counted by the executors; None for an empty table."""
    spark, models = texts.sparkSession, None
    texts = written(texts, "sample")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(models and (models.languages, models.probabilities, models.unseen))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value and Models(*sent.value)
            for batch in it:
                parts = ((lang, p) for lang, t in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in sentences(t))
                rows = [(lang, w, n) for lang, c in counted(parts, own).items() for w, n in c.items()]
                lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["language", "word", "n"])

        found = texts.mapInArrow(run, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n")).toArrow()  # the words of the sample
        counts: dict[str, Counter] = {x: Counter() for x in (models.languages if models else ())}
        for lang, word, n in zip(*(found[c].to_pylist() for c in ("language", "word", "n")), strict=True):
            counts.setdefault(lang, Counter())[word] = n
        if not any(counts.values()):
            return None
        models = fitted(counts)
    return models


def _found(documents: DataFrame, labels: DataFrame, sample_size: int) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, _l, _n): the stretches, the language of the document's label, and how many there are."""
    spark = documents.sparkSession
    models = trained_on(sample(documents, labels, sample_size))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, seg_no int, lang string, confidence double, _l string, _n int"
    if models is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((models.languages, models.probabilities, models.unseen))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Models(*sent.value)
        for batch in it:
            found = [stretches(own, t.as_py()) for t in batch.column("text")]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            no, lang, conf, many = zip(*((*s, len(f)) for f in found for s in f), strict=True) if len(at) else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), pa.array(no, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), batch.column("_l").take(at), pa.array(many, pa.int32())],
                ["doc_id", "seg_no", "lang", "confidence", "_l", "_n"],
            )

    return documents.select("doc_id", "text", "lang").join(_named(labels), "lang", "left").select("doc_id", "text", "_l").mapInArrow(run, schema)


def segmented(documents: DataFrame, labels: DataFrame, sample_size: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, seg_no, lang, confidence): the stretches of every document with words.

    Defined results: null, empty and wordless texts give no row; repeated rows are treated each; without any labelled
    document there is no model and no row; texts of any length are read whole; other columns are not read.
    """
    return _found(documents, labels, sample_size).drop("_l", "_n")


def corrected(documents: DataFrame, labels: DataFrame, sample_size: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The rows of :func:`segmented` of documents whose label is missing, unknown or wrong, and of all mixed ones."""
    return _found(documents, labels, sample_size).where("_n > 1 or _l is null or _l <> lang").drop("_l", "_n")
