"""Group-safe text classification: n-grams, TF-IDF, SVD embedding, classifiers, metrics."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.estimators import gram_product, known_terms, row_product, row_profile, term_totals, unit_weights
from panelwright.operators.ordered import global_row_number
from panelwright.runtime import one_task_a_core, stage, stage_path

# Words are runs of at least two letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
MIN_DOCS = 2
DIMENSIONS = 64
SEED = 50505


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """Adds ``terms``: words and pairs of neighbouring words, in two steps so words are found once."""
    w = F.col("_words")
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    spoken = df.withColumn("_words", words(F.col(text)))
    return spoken.withColumn("terms", F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))).drop("_words")


def term_counts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id, term, tf`` of every term."""
    return (
        with_terms(df, text)
        .select(id_column, F.explode("terms").alias("term"))
        .groupBy(id_column, "term")
        .agg(F.count("*").alias("tf"))
    )


def repeated_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Stage table ``_id`` of the ids, or the missing id, that lie on more than one row."""
    return stage(df.groupBy(F.col(id_column).alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"))


def term_profile(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Per id: terms, distinct terms, characters of all terms, first term and count of the most frequent one.

    A row with an id of its own is counted where it lies, so its terms are never shuffled. Only the terms
    of ids on several rows meet by id and term.
    """
    again = repeated_ids(df, id_column)
    several = F.col(id_column).eqNullSafe(F.col("_id"))
    kind = df.schema[id_column].dataType.simpleString()
    alone = df.join(again, several, "left_anti").select(F.col(id_column).alias("id"), words(F.col(text)).alias("words"))
    made = alone.mapInArrow(row_profile, f"id {kind}, n_terms long, n_distinct long, n_chars long, first_term string, top_count long")
    counts = term_counts(df.join(again, several, "left_semi"), id_column, text)
    met = counts.groupBy(id_column).agg(
        F.sum("tf").alias("n_terms"), F.count("*").alias("n_distinct"), F.sum(F.length("term") * F.col("tf")).alias("n_chars"),
        F.min("term").alias("first_term"), F.max("tf").alias("top_count"),
    )
    return made.withColumnRenamed("id", id_column).unionByName(met)


def group_split(df: DataFrame, family: Column) -> DataFrame:
    """Whole families go to one side: a fifth of them to the test side."""
    return df.withColumn("split", F.when(family % 5 == 0, "test").otherwise("train"))


def check_split(df: DataFrame, group: str) -> DataFrame:
    """Groups that lie on both sides."""
    sides = df.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b"))
    leaks = F.count_if(F.col("a") != F.col("b"))
    return sides.agg((leaks == 0).alias("passed"), leaks.alias("n_violations"))


def vocabulary(train: DataFrame, text: str, min_docs: int = MIN_DOCS, max_terms: int | None = None) -> DataFrame:
    """``term, df, total``: terms of at least ``min_docs`` training documents, the most frequent ones.

    A document counts its distinct terms within its own row and a task adds up many documents before
    Spark sees a term, so the only shuffle carries per-task sums by term. ``max_terms`` is a feature
    limit that the caller may ask for.
    """
    found = train.select(words(F.col(text)).alias("words")).mapInArrow(term_totals, "term string, df long, total long")
    stats = found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    known = stats.where(F.col("df") >= min_docs)
    return known if max_terms is None else known.orderBy(F.col("total").desc(), "term").limit(max_terms)


def tfidf_rows(df: DataFrame, text: str, vocab: DataFrame, n_train: Column, id_column: str, limited: bool = False) -> DataFrame:
    """Sparse rows ``id, idx, val`` with smoothed idf and length one, entries in order of ``idx``.

    A vocabulary of ``limited`` size, with ``idx`` from 0 without gaps, goes to every task, which counts its
    rows where they lie. Any other is joined: the inner join drops all terms outside it. A row has at most
    as many entries as its document has terms.
    """
    idf = F.log((1 + n_train) / (1 + F.col("df"))) + 1
    known = vocab.select("term", "idx", idf.alias("idf"))
    if limited:
        return _weighed(_term_rows(df, text, known, id_column), known, id_column)
    counts = (
        with_terms(df, text)
        .select(id_column, F.explode("terms").alias("term"))
        .join(known, "term")
        .groupBy(id_column, "idx", "idf")
        .agg(F.count("*").alias("tf"))
    )
    packed = counts.groupBy(id_column).agg(
        F.sort_array(F.collect_list(F.struct("idx", (F.col("tf") * F.col("idf")).alias("raw")))).alias("e")
    )
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, e: acc + e["raw"] * e["raw"]))
    return packed.withColumn("_length", length).select(
        id_column,
        F.transform("e", lambda e: e["idx"]).alias("idx"),
        F.transform("e", lambda e: e["raw"] / F.col("_length")).alias("val"),
    )


def _in_order(known: DataFrame, column: str):
    """A column of a vocabulary of limited size, by ``idx``."""
    return known.orderBy("idx").select(column).toArrow()[column]


def _term_rows(df: DataFrame, text: str, known: DataFrame, id_column: str) -> DataFrame:
    """``id, idx, tf``: known terms of each id that has one, with their counts, in order of ``idx``."""
    shared = known.sparkSession.sparkContext.broadcast(_in_order(known, "term").to_pylist())
    kind = df.schema[id_column].dataType.simpleString()
    found = df.select(F.col(id_column).alias("id"), words(F.col(text)).alias("words"))
    rows = found.mapInArrow(known_terms(shared), f"id {kind}, idx array<int>, tf array<long>")
    again = repeated_ids(df, id_column)
    if again.isEmpty():
        return rows
    rows, several = stage(rows), F.col("id").eqNullSafe(F.col("_id"))
    entries = rows.join(again, several, "left_semi").select("id", F.inline(F.arrays_zip("idx", "tf")))
    counts = entries.groupBy("id", "idx").agg(F.sum("tf").alias("tf"))
    packed = counts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "tf"))).alias("e"))  # at most one per known term
    return rows.join(again, several, "left_anti").unionByName(packed.select("id", F.col("e.idx").alias("idx"), F.col("e.tf").alias("tf")))


def _weighed(rows: DataFrame, known: DataFrame, id_column: str) -> DataFrame:
    shared = known.sparkSession.sparkContext.broadcast(_in_order(known, "idf").to_numpy())
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(unit_weights(shared), f"id {kind}, idx array<int>, val array<double>").withColumnRenamed("id", id_column)


def svd_basis(rows: DataFrame, n_terms: int, k: int, seed: int = SEED, passes: int = 6, extra: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of sparse rows ``idx, val`` by randomized subspace iteration.

    Every pass is one job that adds up ``A'(A Q)``, a task shuffling one sum per term; the driver keeps ``n_terms`` x (k + extra)
    numbers, so a vocabulary that is used here needs a limit. Not centred.
    """
    width = min(k + extra, n_terms)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    spark, rows = rows.sparkSession, one_task_a_core(rows)
    image = basis
    for i in range(passes):
        shared = spark.sparkContext.broadcast(basis)
        partial = rows.mapInArrow(gram_product(shared), "t int, z array<double>")
        added = partial.groupBy("t").agg(F.array(*[F.sum(F.col("z")[j]) for j in range(width)]).alias("z"))
        table = added.toArrow()  # at most one row per vocabulary term
        image = np.zeros_like(basis)
        image[table["t"].to_numpy()] = table["z"].combine_chunks().values.to_numpy().reshape(-1, width)
        shared.unpersist()
        if i < passes - 1:
            basis = np.linalg.qr(image)[0]
    values, vectors = np.linalg.eigh(basis.T @ image)
    order = np.argsort(values)[::-1][: min(k, width)]
    components = basis @ vectors[:, order]
    flip = np.sign(components[np.abs(components).argmax(axis=0), range(components.shape[1])])
    return components * np.where(flip == 0, 1, flip), np.sqrt(np.maximum(values[order], 0))


class TextModel:
    """Embedding fitted on the training side and applied to all documents.

    ``corpus``: ``doc_id, text, split`` and further columns that are left alone.
    """

    def __init__(self, corpus: DataFrame, dimensions: int = DIMENSIONS, max_terms: int | None = None):
        self.corpus = corpus
        self.texts = corpus.select("doc_id", "text", "split").hint("rebalance")
        self.dimensions = dimensions
        self.max_terms = max_terms

    @cached_property
    def train(self) -> DataFrame:
        return self.texts.where(F.col("split") == "train")

    @cached_property
    def vocab(self) -> DataFrame:
        """Vocabulary with a position per term, in order of the term."""
        ranked = global_row_number(vocabulary(self.train, "text", max_terms=self.max_terms), [F.col("term")])
        return stage(ranked.drop("n_rows").withColumn("idx", (F.col("row_number") - 1).cast("int")).drop("row_number"))

    @cached_property
    def rows(self) -> DataFrame:
        n_train = self.corpus.where(F.col("split") == "train").agg(F.count("*")).scalar()
        return stage(tfidf_rows(self.texts, "text", self.vocab, n_train, "doc_id", limited=self.max_terms is not None))

    @cached_property
    def weights(self) -> DataFrame:
        """``doc_id, term, weight``."""
        entries = self.rows.select("doc_id", F.inline(F.arrays_zip("idx", F.col("val").alias("weight"))))
        return entries.join(self.vocab.select("term", "idx"), "idx").select("doc_id", "term", "weight")

    @cached_property
    def components(self) -> np.ndarray:
        train_ids = self.corpus.where(F.col("split") == "train").select("doc_id")
        train = self.rows.join(train_ids, "doc_id", "left_semi").select("idx", "val")
        n_terms = self.vocab.count()
        return svd_basis(stage(train), n_terms, min(self.dimensions, n_terms))[0]

    @cached_property
    def embedding(self) -> DataFrame:
        """``doc_id, e``; a document without any known word has a zero vector."""
        shared = self.rows.sparkSession.sparkContext.broadcast(self.components)
        made = self.rows.mapInPandas(row_product(shared), "doc_id bigint, e array<double>")
        zero = F.array_repeat(F.lit(0.0), self.components.shape[1])
        ids = self.corpus.select("doc_id")
        return stage(ids.join(made, "doc_id", "left").withColumn("e", F.coalesce("e", zero)))


def _without_summary(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model as it is when saved and loaded: the summary of a fit on two classes holds the session, which can
    not travel inside a task once anything in it was observed."""
    path = stage_path(SparkSession.active(), "model")
    model.save(path)
    return LogisticRegressionModel.load(path)


def train_classifier(embedded: DataFrame, label: str, max_iter: int = 500) -> DataFrame:
    """Predictions of an L2-regularized logistic regression fitted on the training side.

    ``embedded``: ``doc_id, e, split, <label>``; rows without a label are neither fitted nor scored.
    Penalty 1/n corresponds to a unit cost per training row.
    """
    labelled = embedded.where(F.col(label).isNotNull())
    train = labelled.where(F.col("split") == "train")
    # A constant dimension is what the free intercept already is. Left in, its tiny deviation
    # would blow up the solver's internal scaling.
    width = train.agg(F.max(F.size("e"))).first()[0]
    deviation = train.agg(*[F.stddev_pop(F.col("e")[i]) for i in range(width)]).first()
    varying = [F.col("e")[i] for i in range(width) if deviation[i] > 1e-9]
    known = labelled.withColumn("features", array_to_vector(F.array(*varying)))
    classes = [r[0] for r in known.where(F.col("split") == "train").select(label).distinct().orderBy(label).collect()]
    codes = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    fit_rows = known.where(F.col("split") == "train").withColumn("code", codes[F.col(label)])
    n = fit_rows.count()
    model = LogisticRegression(
        labelCol="code", maxIter=max_iter, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-8
    ).fit(one_task_a_core(fit_rows))
    model = _without_summary(model)
    names = F.array(*[F.lit(c) for c in classes])
    scored = model.transform(known).withColumn("pred", F.get(names, F.col("prediction").cast("int")))
    return scored.select("doc_id", "split", F.col(label).alias("actual"), "pred")


def classification_metrics(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and macro-F1; a class that is never predicted or never true scores 0."""
    confusion = predictions.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = confusion.select("n", F.explode(F.array(
        F.struct(F.col("a").alias("class"), F.lit(1).alias("is_actual"), F.lit(0).alias("is_pred")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("is_actual"), F.lit(1).alias("is_pred")),
    )).alias("s"), (F.col("a") == F.col("p")).alias("hit"))
    per_class = sides.groupBy("s.class").agg(
        F.sum(F.when(F.col("hit") & (F.col("s.is_actual") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.col("n") * F.col("s.is_actual")).alias("support"),
        F.sum(F.col("n") * F.col("s.is_pred")).alias("predicted"),
    )
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return per_class.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.sum("support").alias("n")
    )


def predictions(topic: DataFrame, sentiment: DataFrame) -> DataFrame:
    """``doc_id, topic_true, topic_pred, sentiment_true, sentiment_pred`` of the test side."""
    t = topic.where(F.col("split") == "test").select("doc_id", F.col("actual").alias("topic_true"), F.col("pred").alias("topic_pred"))
    s = sentiment.where(F.col("split") == "test").select(
        "doc_id", F.col("actual").alias("sentiment_true"), F.col("pred").alias("sentiment_pred")
    )
    return t.join(s, "doc_id", "left")


def embeddings_wide(embedding: DataFrame, dimensions: int) -> DataFrame:
    """One column per dimension: ``doc_id, e000, e001, ...``."""
    return embedding.select("doc_id", *[F.col("e")[i].alias(f"e{i:03d}") for i in range(dimensions)])
