"""Category classifier K13-K15 and the sentiment slot K20."""

from __future__ import annotations

import unicodedata
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.functions import labels
from casework.functions.text import SCAN_COLUMNS, Scan, scan, sentiment_rule, weak_category
from casework.models.split import bounded, few, holdout, with_balance
from casework.models.stored import read_facts, write_facts
from casework.schemas import CATEGORIES
from casework.session import cut_lineage, table_path

MAX_TERMS = 10000
MIN_DOCS = 2
INVERSE_PENALTY = 2.0


def _accent_tables() -> tuple[str, str]:
    """Letters with one base letter, and combining marks to delete, derived from the Unicode tables."""
    source, target, marks = [], [], []
    for code in range(0xA0, 0x3000):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _accent_tables()


def without_accents(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _ACCENTED, _PLAIN)


def _terms(rows: DataFrame, text: str) -> DataFrame:
    """Words of two or more characters and their pairs."""
    plain = rows.withColumn("_plain", without_accents(F.col(text)))
    words = RegexTokenizer(inputCol="_plain", outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    out = pairs.transform(words.transform(plain))
    return out.withColumn("_terms", F.concat("_words", "_pairs")).drop("_plain", "_words", "_pairs")


def _scorer(idf: list[float], coefficients: list[list[float]], intercepts: list[float]):
    """Margins of a batch of sparse count vectors: every entry's coefficients are looked up by its index once for all classes."""
    weights, table, shift = np.array(idf), np.array(coefficients).T.copy(), np.array(intercepts)

    @F.arrow_udf("array<double>")
    def margins(indices: pa.Array, counts: pa.Array) -> pa.Array:
        index, n = indices.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(indices)), np.diff(indices.offsets.to_numpy()))
        w = (1 + np.log(n)) * weights[index]
        length = np.maximum(np.sqrt(np.bincount(row, w * w, len(indices))), 1e-300)
        sums = [np.bincount(row, w * table[index, c], len(indices)) / length + b for c, b in enumerate(shift)]
        flat = np.column_stack(sums).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(shift)), pa.int32()), pa.array(flat))

    return margins


@dataclass
class CategoryModel:
    """TF-IDF with 1 + ln(tf), smoothed idf + 1 and unit length, then logistic regression.

    Everything is bounded by the vocabulary and the classes. Scoring shuffles nothing: terms are counted in the JVM, and
    Arrow batches of the sparse counts meet the coefficient table in numpy, once for all classes.
    `balanced_accuracy` is the mean over the held-out classes, so that a constant guess has 1 / classes.
    """

    vocabulary: list[str]
    idf: list[float]
    coefficients: list[list[float]]
    intercepts: list[float]
    classes: list[str]
    accuracy: float
    source: str
    balanced_accuracy: float = 0.0

    def predict(self, rows: DataFrame, text: str = "complaint_text") -> DataFrame:
        """Best class, its probability and the whole distribution, rounded to four places."""
        counter = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_terms", outputCol="_counts")
        vector = F.unwrap_udt(F.col("_counts"))
        margins = _scorer(self.idf, self.coefficients, self.intercepts)
        scored = counter.transform(_terms(rows, text)).withColumn("_margins", margins(vector["indices"], vector["values"]))
        scored = scored.withColumn("_odds", F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins"))))
        scored = scored.withColumn("_p", F.transform("_odds", lambda o: o / F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)))
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        return scored.select(
            *rows.columns,
            F.element_at(names, best).alias("ml_category"),
            F.round(F.array_max("_p"), 4).alias("ml_category_prob"),
            F.map_from_arrays(names, F.transform("_p", lambda p: F.round(p, 4))).alias("ml_category_all"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        write_facts(spark, asdict(self), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CategoryModel:
        return cls(**read_facts(spark, path))


def training_rows(cases: DataFrame, fallback: DataFrame, source: str, text: str = "complaint_text") -> DataFrame:
    """`source` "labelled" takes the processed cases, "weak" rule labels on the raw text. The caller decides."""
    if source == "labelled":
        known = cases.where(F.col("processed_at").isNotNull())
        return known.where(F.col(text).isNotNull() & F.col("category").isin(*CATEGORIES)).select("id", text, "category")
    if source != "weak":
        raise ValueError(f"unknown source: {source}")
    scanned_rows, scanned = scan(fallback, text)
    return scanned_rows.select("id", text, weak_category(scanned).alias("category"))


def _vocabulary(termed: DataFrame, max_terms: int) -> tuple[list[str], list[int]]:
    """The terms of most occurrences in `MIN_DOCS` rows or more, ties by the term, and in how many rows each occurs. Counts are summed before the shuffle."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    said = termed.select(F.explode("_terms").alias("term"), one.alias("all"), none.alias("n"))
    held = termed.select(F.explode(F.array_distinct("_terms")).alias("term"), none.alias("all"), one.alias("n"))
    sums = said.unionByName(held).groupBy("term").agg(F.sum("all").alias("all"), F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    best = sums.orderBy(F.desc("all"), "term").limit(max_terms).collect()
    return [r["term"] for r in best], [r["n"] for r in best]


def _weigher(idf: list[float]):
    """Weights of a batch of sparse count vectors, each of unit length."""
    weights = np.array(idf)

    @F.arrow_udf("array<double>")
    def weighed(indices: pa.Array, counts: pa.Array) -> pa.Array:
        index, n = indices.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(indices.offsets.to_numpy())
        row = np.repeat(np.arange(len(indices)), sizes)
        w = (1 + np.log(n)) * weights[index]
        length = np.maximum(np.sqrt(np.bincount(row, w * w, len(indices))), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(w / length[row]))

    return weighed


def _prepared(termed: DataFrame, vocabulary: list[str], idf: list[float]) -> DataFrame:
    """label, features: unit vectors of the rows' known terms, without a shuffle. A vector's stored form is a struct, so the table that cuts
    the lineage is written as structs and read as vectors. Rows without a known term have an empty vector."""
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_counts")
    counts, weighed = F.unwrap_udt(F.col("_counts")), _weigher(idf)
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(len(idf)).alias("size"), counts["indices"].alias("indices"),
        weighed(counts["indices"], counts["values"]).alias("values"),
    )
    path = table_path(termed.sparkSession)
    counter.transform(termed).select("label", vector.alias("features")).write.parquet(path)
    kind = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    return termed.sparkSession.read.schema(kind).parquet(path)


def fit(rows: DataFrame, source: str, text: str = "complaint_text", max_terms: int = MAX_TERMS, max_iter: int = 100,
        max_labelled_rows: int | None = None) -> CategoryModel | None:
    """K13, on all rows unless a caller asks for `max_labelled_rows` at most. None when fewer than two classes occur. The class list is as small as the
    vocabulary.

    Ids are held out by id and class alone, so rows that share both stay together; texts join them once and are stored dealt over the cluster. Rows
    without an id are fitted on.
    """
    spark = rows.sparkSession
    known = cut_lineage(rows.select("id", "category"))
    classes = sorted(r["category"] for r in known.select("category").distinct().collect())
    if len(classes) < 2:
        return None
    order = F.array(*[F.lit(c) for c in classes])
    number = (F.array_position(order, F.col("category")) - 1).cast("double").alias("label")
    texts, own = rows.select("id", "category", text), ["id", "category"]
    if max_labelled_rows is not None:
        # Before the join, so that labels are worked out again for these rows alone.
        texts, known = texts.where(few(known, max_labelled_rows)), bounded(known, max_labelled_rows)
    named = known.where("id is not null").distinct().select(*own, number)
    train, test = holdout(named, label="label")
    marks = train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    marked = texts.where("id is not null").repartition(parts, *own).join(marks.repartition(parts, *own), own)
    if max_labelled_rows is None:
        marked = marked.unionByName(texts.where("id is null").select("*", number, F.lit(False).alias("held")))
    marked = cut_lineage(marked)
    termed = _terms(marked.where("not held").select("label", text), text)
    n = termed.count()
    vocabulary, rows_of = _vocabulary(termed, max_terms)
    idf = (np.log((1 + n) / (1 + np.array(rows_of))) + 1).tolist()
    prepared = with_balance(_prepared(termed, vocabulary, idf))
    fitted = LogisticRegression(
        weightCol="weight", maxIter=max_iter, regParam=1.0 / (INVERSE_PENALTY * n), family="multinomial"
    ).fit(prepared)
    model = CategoryModel(
        vocabulary, idf, fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist(), classes, 0.0, source
    )
    scored = model.predict(marked.where("held").select(*own, text), text)
    hit = (F.col("ml_category") == F.col("category")).cast("double")
    by_class = scored.groupBy("category").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    found = by_class.agg((F.sum("hits") / F.sum("n")).alias("a"), F.avg(F.col("hits") / F.col("n")).alias("b")).first()
    model.accuracy, model.balanced_accuracy = (round(v or 0.0, 4) for v in found)
    return model


def second_opinion(rows: DataFrame, model: CategoryModel | None, text: str = "complaint_text") -> DataFrame:
    """K14 + H27; without a model the opinion stays empty."""
    if model is None:
        empty = {"ml_category": "string", "ml_category_prob": "double", "ml_category_all": "map<string, double>"}
        scored = rows.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})
    else:
        scored = model.predict(rows, text)
    return scored.withColumn("category_confidence", labels.category_agreement(F.col("category"), F.col("ml_category")))


def sentiment_opinion(rows: DataFrame, scorer=None, text: str = "complaint_text") -> DataFrame:
    """K20 + H28: `scorer` maps a scanned text to a label column; without one the opinion stays empty.

    `sentiment_scorer_by_rule` is the built-in scorer.
    """
    out, scanned = scan(rows, text)
    label = F.lit(None).cast("string") if scorer is None else scorer(scanned)
    out = out.withColumn("ml_sentiment", labels.scorer_bucket(label)).drop(*SCAN_COLUMNS)
    return out.withColumn("sentiment_confidence", labels.sentiment_agreement(F.col("sentiment"), F.col("ml_sentiment")))


def sentiment_scorer_by_rule(scanned: Scan) -> Column:
    return labels.sentiment_bucket(sentiment_rule(scanned))
