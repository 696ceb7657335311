"""Text steps over all documents, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.text import WHITESPACE, WORD, lemmatize, mean_vectors, tfidf, tokens, vector_tables, vocabulary, word_embeddings
from ..plans.step import Step, apply_step
from .common import query, r, rounded, table



def _tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WHITESPACE}'), lambda x: x <> '')"


_PLAIN, _LOWER = _tokens_sql("text"), _tokens_sql("lower(text)")


@query("text_tokenize", f"SELECT doc_id, len({_PLAIN})::INTEGER AS text_token_count, array_to_string({_PLAIN}, ' ') AS joined FROM documents")
def _tokenize(spark, sf):
    out = apply_step(table(spark, sf, "documents"), Step("text_processing", ["text"], "tokenize"))
    return out.select("doc_id", "text_token_count", F.array_join("text_tokens", " ").alias("joined"))


def _stop_sql() -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_ENGLISH)
    return f"SELECT doc_id, array_to_string(list_filter({_LOWER}, lambda x: NOT list_contains([{words}], x)), ' ') AS text_filtered FROM documents"


def _stopwords(spark, sf):
    out = apply_step(table(spark, sf, "documents"), Step("text_processing", ["text"], "stopwords"))
    return out.select("doc_id", "text_filtered")


# The English stop words Spark ships, needed here as text for the oracle.
STOP_ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's "
    "she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's "
    "where's who's why's would"
).split()
query("text_stopwords", _stop_sql())(_stopwords)


def _stem(kind):
    def run(spark, sf):
        out = apply_step(table(spark, sf, "documents"), Step("text_processing", ["text"], "stemming", {"stemmer": kind}))
        return out.select("doc_id", "text_stemmed")

    return run


query("text_stem")(_stem("porter"))
query("text_stem_snowball")(_stem("snowball"))

LEMMAS = [("feet", "foot"), ("children", "child"), ("cities", "city"), ("prices", "price"), ("items", "item"), ("orders", "order"), ("was", "be"), ("systems", "system"), ("pages", "page"), ("words", "word")]
_MAP = "MAP {" + ", ".join(f"'{w}': '{lemma}'" for w, lemma in LEMMAS) + "}"


@query(
    "text_lemmatize",
    f"SELECT doc_id, array_to_string(list_transform({_LOWER}, lambda x: coalesce({_MAP}[x], x)), ' ') AS text_lemmatized FROM documents",
)
def _lemmatize(spark, sf):
    lexicon = spark.createDataFrame(LEMMAS, "word string, lemma string")
    return lemmatize(table(spark, sf, "documents"), "text", "doc_id", lexicon).select("doc_id", "text_lemmatized")


@query(
    "text_tfidf",
    f"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS term FROM documents),
    v AS (SELECT term, count(*) AS c, count(DISTINCT doc_id) AS df FROM t GROUP BY term ORDER BY c DESC, term LIMIT 100),
    i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM v),
    w AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM t JOIN i USING (term) GROUP BY doc_id, term)
    SELECT doc_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS tfidf FROM w
    """,
)
def _tfidf(spark, sf):
    docs = table(spark, sf, "documents")
    return rounded(tfidf(docs, "text", "doc_id", vocabulary(docs, "text", 100)))


@query("text_embeddings")
def _embeddings(spark, sf):
    out = word_embeddings(table(spark, sf, "documents"), "text", "doc_id", size=16)
    return out.select("doc_id", F.size("text_embedding").alias("dimensions"), F.round(F.aggregate("text_embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


# a fitted vector table whose numbers both engines can work out: words of five or more documents
_VECTOR = ["len(word)", "ascii(word)", "ascii(right(word, 1)) - len(word)"]


@query(
    "text_embeddings_apply",
    f"""
    WITH t AS (SELECT doc_id, unnest({_LOWER}) AS word FROM documents),
    v AS (SELECT word, {", ".join(f"CAST({x} AS DOUBLE) AS v{i}" for i, x in enumerate(_VECTOR))} FROM t GROUP BY word HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT doc_id, {", ".join(f"avg(v{i}) AS m{i}" for i in range(3))} FROM t JOIN v USING (word) GROUP BY doc_id)
    SELECT doc_id, {", ".join(r(f"coalesce(m{i}, 0)") + f" AS e{i}" for i in range(3))} FROM documents LEFT JOIN m USING (doc_id)
    """,
)
def _embeddings_apply(spark, sf):
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("word")).groupBy("word").agg(F.count("doc_id").alias("n"))
    numbers = [F.length("word"), F.ascii("word"), F.ascii(F.right("word", F.lit(1))) - F.length("word")]
    vectors = words.where("n >= 5").select("word", F.array(*[x.cast("double") for x in numbers]).alias("vector"))
    out = mean_vectors(docs, "text", "doc_id", vector_tables(docs, "text", vectors), 3)
    return rounded(out.select("doc_id", *[F.col("text_embedding")[i].alias(f"e{i}") for i in range(3)]))
