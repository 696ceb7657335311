"""Text steps. Texts are always processed whole."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skipgram
from ..functions.schema import col
from ..functions.stem import porter, porter2
from ..plans.step import Fitted, look_up, mapping_tables, register, small_or_cut
from ..session import cut_lineage

# Fixed value: white space as Python's str.split() sees it; reads the same in Java and RE2.
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Fixed value: a vocabulary word is two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, WHITESPACE), lambda t: t != "")


def _text(s) -> Column:
    return col(s.column).cast("string")


register(
    "text_processing",
    "tokenize",
    apply=lambda df, s, f: df.withColumn(f"{s.column}_tokens", tokens(_text(s))).withColumn(
        f"{s.column}_token_count", F.size(f"{s.column}_tokens")
    ),
)


def stop_words(language: str) -> list[str]:
    return list(StopWordsRemover.loadDefaultStopWords(language))


def _stopwords(df, s, f):
    words = [w.lower() for w in stop_words(s.params.get("language", "english"))]
    # a long IN list of literals is looked up as a hash set
    kept = F.filter(tokens(F.lower(_text(s))), lambda t: ~t.isin(words))
    return df.withColumn(f"{s.column}_filtered", F.array_join(kept, " "))


register("text_processing", "stopwords", apply=_stopwords)


#: stems a worker remembers at once, before the words of one more text
KNOWN_WORDS = 50_000


def _stemming(df, s, f):
    """Text by text, so a worker holds few texts and a bounded number of words; repeated words are looked up, no shuffle is needed."""
    kind = s.params.get("stemmer", "porter")
    if kind not in ("porter", "snowball"):
        raise ValueError(f"unknown stemmer '{kind}'")
    if kind == "snowball" and s.params.get("language", "english") != "english":
        raise ValueError("the snowball stemmer is built for English only")
    stem = porter if kind == "porter" else porter2

    known: dict[str, str] = {}

    # plain rows, not Arrow batches: a batch of ten thousand whole texts has no bound in bytes
    @F.udf("string", useArrow=False)
    def stemmed(text: str | None) -> str | None:
        if text is None:
            return None
        words = text.lower().split()
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = stem(w)
        return " ".join([known[w] for w in words])

    return df.withColumn(f"{s.column}_stemmed", stemmed(_text(s)))


register("text_processing", "stemming", apply=_stemming)


def lemmatize(df: DataFrame, column: str, key: str, lemmas: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds ``{column}_lemmatized``: each word replaced by its lemma from the ``(word, lemma)`` table.

    The distinct words of each text are looked up in the lexicon, words that many texts hold apart from the others. ``key`` names the rows.
    """
    if not key:
        raise ValueError("lemmatization needs a key column")
    tables = tables or lexicon_tables(df, column, lemmas)
    words = tokens(F.lower(col(column).cast("string")))
    asked = df.select(col(key).alias("_k"), F.explode(F.array_distinct(words)).alias("word"))
    hits = look_up(asked, tables, "lemmas", "word", "_word").where("lemma IS NOT NULL")
    hits = hits.groupBy("_k").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "lemma")))).alias("_map"))
    joined = df.join(hits, col(key) == F.col("_k"), "left")
    text = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at("_map", w), w)), " ")
    return joined.withColumn(f"{column}_lemmatized", text).drop("_k", "_map")


def lexicon_tables(df: DataFrame, column: str, lemmas: DataFrame) -> dict[str, DataFrame]:
    """The lexicon as a fitted mapping: one lemma a word, the smallest."""
    lexicon = lemmas.groupBy(F.col("word").alias("_word")).agg(F.min("lemma").alias("lemma"))
    words = df.select(F.explode(F.array_distinct(tokens(F.lower(col(column).cast("string"))))).alias("word"))
    return mapping_tables("lemmas", lexicon, words, F.col("word"), "_word")


def _lemma_fit(df, s, found):
    """``lemmas`` is a path to a parquet table or a list of [word, lemma]."""
    given = s.params["lemmas"]
    table = df.sparkSession.read.parquet(given) if isinstance(given, str) else df.sparkSession.createDataFrame(
        [tuple(x) for x in given], "word string, lemma string"
    )
    return Fitted({}, lexicon_tables(df, s.column, table))


register(
    "text_processing",
    "lemmatization",
    fit=_lemma_fit,
    apply=lambda df, s, f: lemmatize(df, s.column, s.key or "", f.tables["lemmas"], f.tables),
)


# ---- tf-idf


def vocabulary(df: DataFrame, column: str, max_features: int = 100) -> DataFrame:
    """``(term, corpus_count, df, idf)`` of the most frequent words (ties by word)."""
    docs = df.select(F.sort_array(_words(df, column)).alias("t"))
    n = docs.count()
    # sorted words of a text: the first of each run counts the text, every one counts the word; one shuffle of sums
    marked = F.transform("t", lambda w, i: F.struct(w.alias("term"), ((i == 0) | (w != F.get("t", i - 1))).cast("int").alias("first")))
    counts = (
        docs.select(F.inline(marked))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("corpus_count"), F.sum("first").alias("df"))
    )
    top = counts.orderBy(F.desc("corpus_count"), "term").limit(max_features)
    rows = [(r["term"], r["corpus_count"], r["df"]) for r in top.collect()]
    local = df.sparkSession.createDataFrame(rows, "term string, corpus_count bigint, df bigint")
    return local.withColumn("idf", F.ln(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def _words(df: DataFrame, column: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(column).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def tfidf(df: DataFrame, column: str, key: str, vocab: DataFrame) -> DataFrame:
    """Long form ``(key, term, tfidf)``, rows scaled to length one."""
    rows = vocab.select("term", "idf").collect()
    if not rows:
        return df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, term string, tfidf double")
    words = [r["term"] for r in rows]
    known = F.filter(_words(df, column), lambda t: t.isin(words))
    found = df.select(key, F.explode(known).alias("term"))
    counts = found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counts.join(small_or_cut(vocab.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    per_key = (
        weighted.groupBy(key)
        .agg(F.collect_list(F.struct("term", "w")).alias("ws"))
        .withColumn("norm", F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    )
    return per_key.select(key, F.explode("ws").alias("x"), "norm").select(
        key, F.col("x.term").alias("term"), (F.col("x.w") / F.col("norm")).alias("tfidf")
    )


def _tfidf_fit(df, s, found):
    table = vocabulary(df, s.column, int(s.params.get("max_features", 100)))
    return Fitted({"terms": sorted(r["term"] for r in table.select("term").collect())}, {"vocab": small_or_cut(table)})


def _tfidf_apply(df, s, f):
    if not s.key:
        raise ValueError("tfidf needs a unique key column")
    long = tfidf(df, s.column, s.key, f.tables["vocab"])
    wide = long.groupBy(F.col(s.key).alias("_k")).agg(
        *[F.max(F.when(F.col("term") == t, F.col("tfidf"))).alias(f"{s.column}_tfidf_{t}") for t in f.params["terms"]]
    )
    names = [f"{s.column}_tfidf_{t}" for t in f.params["terms"]]
    return df.join(wide, col(s.key) == F.col("_k"), "left").drop("_k").na.fill(0.0, names)


register("text_processing", "tfidf", fit=_tfidf_fit, apply=_tfidf_apply)


def word_vectors(df: DataFrame, column: str, size: int = 32, min_count: int = 5, seed: int = 42, epochs: int = 5) -> DataFrame:
    """``(word, vector)`` trained on the texts of a table."""
    return skipgram.train(df.select(F.lower(col(column).cast("string")).alias("_w")), "_w", size, min_count, seed, epochs)


#: numbers of a fitted vector table that each Python worker holds
HELD_NUMBERS = 32_000_000


def vector_tables(df: DataFrame, column: str, vectors: DataFrame) -> dict[str, DataFrame]:
    """Word vectors as a fitted mapping; one too large to be held by workers is looked up by shuffle, and its commonest words are in most texts."""
    table = cut_lineage(vectors.withColumnRenamed("word", "_word"))
    numbers = table.agg(F.sum(F.size("vector"))).first()[0] or 0
    if numbers <= HELD_NUMBERS:
        return {"vectors": table}
    words = df.select(F.explode(F.array_distinct(tokens(F.lower(col(column).cast("string"))))).alias("word"))
    return mapping_tables("vectors", table, words, F.col("word"), "_word")


def _held_vectors(tables: dict[str, DataFrame], size: int):
    """Words and vectors of a fitted table for every worker; nothing if it is too large, or its vectors are of another size or repeat a word."""
    table = tables["vectors"]
    if "vectors_hot" in tables or table.count() * size > HELD_NUMBERS:
        return None
    found = table.select("_word", "vector").toArrow().combine_chunks()
    words, vectors = found["_word"], found["vector"]
    plain = not words.null_count and not vectors.null_count and pc.count_distinct(words).as_py() == len(words)
    if not plain or set(pc.list_value_length(vectors).unique().to_pylist()) - {size}:
        return None
    numbers = pc.list_flatten(vectors)
    if numbers.null_count:
        return None
    matrix = numbers.to_numpy().reshape(-1, size)
    single = matrix.astype("float32")
    sc = table.sparkSession.sparkContext
    return sc.broadcast(pa.chunked_array(words.chunks, pa.string()).combine_chunks()), sc.broadcast(single if (single == matrix).all() else matrix)


def mean_vectors(df: DataFrame, column: str, key: str, tables: dict[str, DataFrame], size: int) -> DataFrame:
    """Adds ``{column}_embedding``: the mean of the vectors of a text's words, each as often as it occurs; zeros if no word has one.

    A table of bounded size is read at once and held by every worker, which adds up its texts; in a larger one a word of a text is looked up once and
    the sums of a text's words are added before they meet. ``key`` names the rows.
    """
    if not key:
        raise ValueError("word embeddings need a key column")
    held = _held_vectors(tables, size)
    if held:
        texts = df.select(col(key).alias("_k"), F.lower(col(column).cast("string")).alias("_t"))
        found = skipgram.sums_of_vectors(texts, "_k", "_t", *held, size)
        sums = found.groupBy("_k").agg(F.sum("_n").alias("_n"), *[F.sum(f"_v{i}").alias(f"_v{i}") for i in range(size)])
    else:
        sums = _sums_by_shuffle(df, column, key, tables, size)
    means = sums.select("_k", F.array(*[F.col(f"_v{i}") / F.col("_n") for i in range(size)]).alias("_mean"))
    joined = df.join(means, col(key) == F.col("_k"), "left")
    return joined.withColumn(f"{column}_embedding", F.coalesce("_mean", F.array_repeat(F.lit(0.0), size))).drop("_k", "_mean")


def _sums_by_shuffle(df: DataFrame, column: str, key: str, tables: dict[str, DataFrame], size: int) -> DataFrame:
    counted = df.select(col(key).alias("_k"), F.sort_array(tokens(F.lower(col(column).cast("string")))).alias("_t"))
    # sorted words of a text: a word's number is the way from the start of its run to that of the next, so no pair is shuffled to be counted
    starts = F.filter(F.transform("_t", lambda w, i: F.when((i == 0) | (w != F.get("_t", i - 1)), i)), lambda i: i.isNotNull())
    counted = counted.withColumn("_s", starts)
    runs = F.transform("_s", lambda i, j: F.struct(F.get("_t", i).alias("word"), (F.coalesce(F.get("_s", j + 1), F.size("_t")) - i).cast("long").alias("n")))
    counted = counted.select("_k", F.inline(runs))
    found = look_up(counted, tables, "vectors", "word", "_word").where("vector IS NOT NULL")
    return found.groupBy("_k").agg(F.sum("n").alias("_n"), *[F.sum(F.col("n") * F.get("vector", F.lit(i))).alias(f"_v{i}") for i in range(size)])


def word_embeddings(df: DataFrame, column: str, key: str, size: int = 32, min_count: int = 5, seed: int = 42, epochs: int = 5) -> DataFrame:
    """Vectors trained on a table and applied to the same one."""
    return mean_vectors(df, column, key, vector_tables(df, column, word_vectors(df, column, size, min_count, seed, epochs)), size)


def _embeddings_fit(df, s, found):
    if not s.key:
        raise ValueError("word embeddings need a key column")
    size = int(s.params.get("size", 32))
    vectors = word_vectors(df, s.column, size, int(s.params.get("min_count", 5)), epochs=int(s.params.get("epochs", 5)))
    return Fitted({"size": size}, vector_tables(df, s.column, vectors))


register("text_processing", "word_embeddings", fit=_embeddings_fit, apply=lambda df, s, f: mean_vectors(df, s.column, s.key, f.tables, f.params["size"]))
