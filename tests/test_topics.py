"""Topic models use every document and every term."""

import math

from citeloom.operators import topics as M


def papers(spark, texts):
    return spark.createDataFrame([(i, 2020, t, None) for i, t in enumerate(texts)], "rec_id long, year int, title string, abstract string")


def test_small_groups_are_told_apart(spark):
    groups = [["apple", "pear", "plum", "cherry"], ["engine", "piston", "gearbox", "clutch"], ["violin", "cello", "oboe", "trumpet"]]
    texts = [" ".join(g[(i + j) % 4] for j in range(3)) + f" {g[i % 4]} {g[0]}" for g in groups for i in range(12)]
    _, best = M.topics(papers(spark, texts), k=3)
    got = {r.rec_id: r.topic for r in best.collect()}
    sets = [{got[12 * g + i] for i in range(12)} for g in range(3)]
    assert all(len(x) == 1 for x in sets) and len(set.union(*sets)) == 3


def test_rare_terms_count_and_idf(spark):
    texts = [f"common common word{i // 2:05d}" for i in range(4_400)]
    feats, words = M.tfidf(M.topic_documents(papers(spark, texts)))
    assert len(words) == 2_201
    row = feats.filter("rec_id = 7").first().features
    rare = row[words.index("word00003")]
    assert abs(rare - math.log(4_401 / 3)) < 1e-9 and row[words.index("common")] == 0
