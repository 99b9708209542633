"""Topic models over titles and abstracts.

Sentence embeddings are not available offline; TF-IDF features with LDA take their place. Every
document is used: EM passes over all rows in each iteration, the vocabulary holds every term of two
or more documents, counts and assignment run over all rows.
"""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.keywords import text_tokens
from citeloom.session import materialize, shared_dir, spread

# No limit of the vocabulary (the largest int of the JVM).
UNLIMITED = 2**31 - 1


def topic_documents(papers: DataFrame, title: str = "title", abstract: str = "abstract", min_chars: int = 20) -> DataFrame:
    """(rec_id, year, tokens) of papers with more than ``min_chars`` characters of text."""
    text = F.concat_ws(". ", title, abstract)
    tokens = F.filter(text_tokens(text), lambda t: F.length(t) > 2)
    return papers.filter(F.length(text) > min_chars).select("rec_id", "year", tokens.alias("tokens"))


def tfidf(docs: DataFrame, vocabulary: int = UNLIMITED, min_df: int = 2) -> tuple[DataFrame, list[str]]:
    """((rec_id, year, features), words): TF-IDF over the terms of ``min_df`` or more documents."""
    counts = CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocabulary, minDF=min_df).fit(docs)
    raw = materialize(spread(counts.transform(docs).select("rec_id", "year", "counts")), "counts")
    return IDF(inputCol="counts", outputCol="features").fit(raw).transform(raw).select("rec_id", "year", "features"), counts.vocabulary


def topics(papers: DataFrame, k: int = 8, vocabulary: int = UNLIMITED, iterations: int = 20, words: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(info, assignments): (topic, documents, name) and (rec_id, year, topic).

    The model (words x ``k``) and the words are held by the driver.
    """
    feats, vocab = tfidf(topic_documents(papers), vocabulary)
    shared_dir(papers.sparkSession)  # the lineage of EM is cut by checkpoints
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="em", docConcentration=[1.1], topicConcentration=1.1, featuresCol="features").fit(feats)
    named = [(r.topic, "_".join(vocab[i] for i in r.termIndices)) for r in model.describeTopics(words).collect()]  # k rows
    names = F.create_map(*[F.lit(x) for t, n in named for x in (t, n)])
    from pyspark.ml.functions import vector_to_array

    dist = vector_to_array("topicDistribution")
    best = model.transform(feats).select("rec_id", "year", (F.array_position(dist, F.array_max(dist)) - 1).cast("int").alias("topic"))
    info = best.groupBy("topic").agg(F.count(F.lit(1)).alias("documents")).withColumn("name", F.try_element_at(names, F.col("topic")))
    return info, best


def topics_over_time(assignments: DataFrame) -> DataFrame:
    return assignments.filter("year is not null").groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"))


def topics_against_keywords(info: DataFrame, keywords: DataFrame, top_n: int = 15) -> DataFrame:
    """(term, side): words of topics and of the top keywords: both, topics or keywords."""
    t = info.select(F.explode(F.split("name", "_")).alias("term")).distinct().withColumn("_t", F.lit(1))
    top = keywords.orderBy(F.desc("n"), "keyword").limit(top_n)
    k = top.select(F.explode(F.split(F.lower("keyword"), " ")).alias("term")).distinct().withColumn("_k", F.lit(1))
    side = F.when(F.col("_t").isNull(), "keywords").when(F.col("_k").isNull(), "topics").otherwise("both")
    return t.join(k, "term", "full_outer").select("term", side.alias("side"))
