"""Theme discovery over narrative excerpts: TF-IDF -> NMF -> topic per
excerpt, labels, theme summary and phrase mentions (TXT-4..7, AGG-26/27)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import whole_word_match
from ledgerline.operators import nmf, tfidf
from ledgerline.plans.narratives import SELECTED

LABEL_TERMS = 4
SEPARATOR = " · "


UNFITTED = "topic int, theme string"


def discover(frame: DataFrame, topics: int = 6, id_col: str = "complaint_id", text_col: str = "excerpt"):
    """Assign each excerpt its strongest theme; returns ``(assigned, labels)``.

    ``assigned`` is ``frame`` plus ``topic`` (-1 when unassigned) and
    ``weight``; ``labels`` is ``topic, theme``.  With no usable vocabulary,
    or fewer than two documents or features, every row gets -1 and there are
    no labels.
    """
    found = _factorise(frame, topics, id_col, text_col, nmf.fit)
    if found is None:
        return _unassigned(frame), frame.sparkSession.createDataFrame([], UNFITTED)
    result, terms = found
    return _assigned(frame, result, id_col), labels(frame.sparkSession, result.components, terms)


class TopicSteps(NamedTuple):
    """Result of :func:`topic_steps`."""

    assigned: DataFrame  # the frame plus topic and weight
    labels: DataFrame  # topic, theme
    components: DataFrame  # topic, term_index, term, weight
    objective: DataFrame  # step, error


def topic_steps(frame: DataFrame, updates: int, topics: int = 6, id_col: str = "complaint_id", text_col: str = "excerpt") -> TopicSteps:
    """Themes after a fixed number of updates from the hash start, with H and
    the objective before each update and after the last."""
    spark = frame.sparkSession
    found = _factorise(frame, topics, id_col, text_col, lambda w, n, p, k: nmf.steps(w, n, p, k, updates))
    if found is None:
        empty = lambda schema: spark.createDataFrame([], schema)
        return TopicSteps(_unassigned(frame), empty(UNFITTED), empty("topic int, term_index int, term string, weight double"), empty("step int, error double"))
    result, terms = found
    rows = [(t, i, terms[i], float(v)) for t, row in enumerate(result.components) for i, v in enumerate(row)]  # topics x max_features
    return TopicSteps(
        _assigned(frame, result, id_col),
        labels(spark, result.components, terms),
        spark.createDataFrame(rows, "topic int, term_index int, term string, weight double"),
        spark.createDataFrame(list(enumerate(result.errors)), "step int, error double"),
    )


def labels(spark, components: np.ndarray, terms: list[str]) -> DataFrame:
    """``topic, theme``: each component's four heaviest terms, heaviest first
    (of equal weights the later term)."""
    rows = []
    for t, component in enumerate(components):
        top = np.argsort(component, kind="stable")[-LABEL_TERMS:][::-1]
        rows.append((t, SEPARATOR.join(terms[i] for i in top)))
    return spark.createDataFrame(rows, UNFITTED)


def _factorise(frame: DataFrame, topics: int, id_col: str, text_col: str, method):
    """The factorisation and the vocabulary's terms; None if there are too few
    documents or terms."""
    try:
        model = tfidf.fit(frame, id_col, text_col)
    except ValueError:
        return None
    if model.n_features == 0 or min(model.n_docs, model.n_features) < 2:
        return None
    k = min(topics, model.n_features, model.n_docs - 1)
    result = method(model.rows, model.n_docs, model.n_features, k)
    return result, [r["term"] for r in model.vocabulary.orderBy("term_index").collect()]


def _unassigned(frame: DataFrame) -> DataFrame:
    return frame.withColumn("topic", F.lit(-1)).withColumn("weight", F.lit(0.0))


def _assigned(frame: DataFrame, result: nmf.NmfResult, id_col: str) -> DataFrame:
    found = result.topics.withColumnRenamed("doc_id", "__doc")
    return (
        frame.join(found, F.col(id_col).cast("string") == F.col("__doc"), "left")
        .drop("__doc")
        .withColumn("topic", F.coalesce(F.col("topic"), F.lit(-1)))
        .withColumn("weight", F.coalesce(F.col("weight"), F.lit(0.0)))
    )


def phrase_mentions(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Per topic label term: selected excerpts of that topic mentioning the
    term as a whole word, case-insensitive (AGG-27).

    Labels are at most topics x 4 terms, so each becomes a literal pattern
    (compiled once) in one aggregate over the texts; no text is copied."""
    terms = labels.select("topic", F.posexplode(F.split("theme", SEPARATOR)).alias("position", "term")).collect()
    topic = F.col("topic")
    counts = [
        F.struct(
            F.lit(r["topic"]).alias("topic"),
            F.lit(r["position"]).alias("position"),
            F.lit(r["term"]).alias("term"),
            F.count_if((topic == r["topic"]) & whole_word_match(F.col("excerpt"), r["term"])).alias("mentions"),
            F.count_if(topic == r["topic"]).alias("texts"),
        )
        for r in terms
    ]
    selected = assigned.filter(F.col("period") == SELECTED).select("topic", "excerpt")
    if not counts:
        return selected.select("topic", F.lit(0).alias("position"), F.lit("").alias("term"), F.lit(0).cast("long").alias("mentions")).limit(0)
    return (
        selected.agg(F.array(*counts).alias("all"))
        .select(F.explode("all").alias("r"))
        .filter("r.texts > 0")
        .select("r.topic", "r.position", "r.term", "r.mentions")
    )
