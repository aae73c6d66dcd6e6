"""Whole enrichment L1, batch run L2 and write-back over set-based stages.

Text and vectors are read once each and stay out of every later shuffle: the labels are a projection of the text
scan, the duplicate search returns (id, original, similarity), and the labelled rows without text and vector are
checkpointed before the customer history reads them a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions import labels, risk, sla, text
from casework.models import features
from casework.models.breach import Trained
from casework.models.category import CategoryModel, second_opinion, sentiment_opinion
from casework.models.priority import PriorityModel
from casework.operators import duplicates, history, kpi, rootcause
from casework.operators.store import patch
from casework.schemas import SLA_DAYS, lookup
from casework.session import cut_lineage

ERRORS = "array<struct<stage: string, column: string, reason: string>>"
_INTAKE_INPUT = ("customer_name", "complaint_text", "account_type", "amount_involved", "location", "language")


def classified(cases: DataFrame) -> DataFrame:
    """Category, severity and sentiment by rule, and the fallback intake record."""
    out = cases
    for name in (*_INTAKE_INPUT, "channel"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double" if name == "amount_involved" else "string"))
    out, scanned = text.scan(out, "complaint_text")
    return out.withColumns(
        {
            "category": text.keyword_category(scanned),
            "severity": text.severity_rule(scanned, F.col("amount_involved")),
            "sentiment": text.sentiment_rule(scanned),
            "intake_json": F.to_json(
                text.intake_fallback({n: F.col(n) for n in _INTAKE_INPUT}), {"ignoreNullFields": "false"}
            ),
        }
    ).drop(*text.SCAN_COLUMNS)


def with_duplicates(labelled: DataFrame, cases: DataFrame, threshold: float = duplicates.DUPLICATE_THRESHOLD,
                    mode: str = "earlier", known: DataFrame | None = None, **search) -> DataFrame:
    """J2 on the cases that carry a vector; the others have no original.

    Cases in `known` are candidates and count as earlier than every new one; only those of customers with a new
    case are read into the search.
    """
    def indexed(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("embedding").isNotNull() & F.col("customer_name").isNotNull())

    vectors = indexed(cases).select(
        "id", "customer_name", "embedding", (F.unix_date("date") + 1_000_000).alias("turn"), F.lit(True).alias("asks")
    )
    if known is not None:
        concerned = vectors.select("customer_name").distinct()
        vectors = vectors.unionByName(
            indexed(known).join(concerned, "customer_name", "left_semi").select(
                "id", "customer_name", "embedding", F.lit(0).alias("turn"), F.lit(False).alias("asks")
            )
        )
    best = duplicates.detect(vectors, threshold, mode=mode, order="turn", **search)
    found = labelled.drop("duplicate_of", "similarity").join(best, "id", "left")
    return found.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def opinions(labelled: DataFrame, category: CategoryModel | None = None, sentiment=None) -> DataFrame:
    """The second opinions on category and sentiment and how they agree with the rules."""
    scored = second_opinion(labelled, category).drop("ml_category_all")
    return sentiment_opinion(scored, sentiment).withColumn("ml_sentiment_prob", F.lit(None).cast("double"))


def with_sla(cases: DataFrame, as_of=None, breach: Trained | None = None, counted_in: DataFrame | None = None) -> DataFrame:
    """H15, and K10's winner where it is given, else the rule H17; a missing filing date leaves the due date empty."""
    due = cases.withColumn("sla_due_date", sla.due_date(F.col("date"), F.col("category"), F.col("severity")))
    if breach is None:
        return due.withColumn("sla_breach_prob", sla.breach_rule(F.col("severity"), F.col("amount_involved")))
    narrow = [c for c in due.columns if c in _BREACH_INPUT]
    counted = history.complaint_counts(due.select("id", *narrow), counted_in)
    scored = breach.transform(features.sla_features(counted, as_of)).select("id", "sla_breach_prob")
    return due.drop(*_TEXT_NUMBERS).join(scored, "id", "left")


def with_resolution(cases: DataFrame, as_of, draft: bool = True) -> DataFrame:
    """H26 and H29; automatic resolutions are stamped with `as_of`."""
    is_duplicate = F.col("duplicate_of").isNotNull()
    days = lookup(F.col("category"), SLA_DAYS, SLA_DAYS["General"])
    status = labels.resolution(is_duplicate, F.col("category"), F.col("severity"), F.col("sentiment"))
    moment = F.lit(str(as_of)).cast("timestamp_ntz")
    reply = labels.standard_reply(F.col("id"), F.col("customer_name"), F.col("category"), days)
    out = cases.withColumn("status", status)
    return out.withColumns(
        {
            "draft_response": F.when(~is_duplicate, reply) if draft else F.lit(None).cast("string"),
            "resolved_at": F.when(F.col("status") != "open", moment),
            "processed_at": moment,
        }
    )


def with_priority(cases: DataFrame, as_of, counted: bool = False, model: PriorityModel | None = None) -> DataFrame:
    """K17 with a fitted priority model, else H25 rounded half to even."""
    rows = cases if counted else history.complaint_counts(cases)
    if model is not None:
        return model.score(rows, as_of).drop("customer_complaint_count")
    c = F.col
    score = risk.priority_composite(
        c("severity"), c("sentiment"), c("amount_involved"), c("customer_complaint_count"),
        F.date_diff(sla.day(as_of), c("date")), c("duplicate_of").isNotNull().cast("int"), c("sla_breach_prob"),
    )
    return rows.withColumn("priority_score", F.bround(score, 0).cast("int")).drop("customer_complaint_count")


_HISTORY = ("customer_name", "category", "sentiment", "status", "channel")
_TEXT_NUMBERS = ("complaint_text_length", "complaint_word_count", "is_fraud_keyword")
_BREACH_INPUT = (
    *features.CATEGORICAL, *_TEXT_NUMBERS, "customer_name", "amount_involved", "date", "duplicate_of",
)


def enrich(cases: DataFrame, as_of, threshold: float = duplicates.DUPLICATE_THRESHOLD, mode: str = "earlier",
           draft: bool = True, known: DataFrame | None = None, breach: Trained | None = None,
           category: CategoryModel | None = None, sentiment=None, priority: PriorityModel | None = None, **search) -> DataFrame:
    """L1: the enriched columns by id, without the text and the vector.

    A fitted model that is given scores its stage: `breach` the probability, `category` and `sentiment` (a scorer of scanned
    texts) the second opinions, `priority` the priority. Without it the rule does, and the opinions stay empty.

    History counts come from the enriched batch itself, each case included, and from the stored cases in `known`
    (which must not hold the batch's ids).
    """
    labelled = opinions(classified(cases), category, sentiment)
    labelled = (labelled if breach is None else features.text_numbers(labelled)).drop("complaint_text", "embedding")
    found = with_duplicates(labelled, cases, threshold, mode, known, **search)
    names = None
    if breach is not None:
        found = cut_lineage(found)
        names = found.select("customer_name")
        names = names if known is None else names.unionByName(known.select("customer_name"))
    decided = cut_lineage(with_resolution(with_sla(found, as_of, breach, names), as_of, draft))
    past = None
    if known is not None:
        named = F.coalesce("customer_name", F.lit(""))
        concerned = decided.select(named.alias("_concerned")).distinct()
        stored = known.join(concerned, named == F.col("_concerned"), "left_semi").select(*_HISTORY)
        past = decided.select(*_HISTORY).unionByName(stored)
    joined = history.with_history(decided, past).withColumn(
        "customer_complaint_count", F.when(F.col("customer_name").isNotNull(), F.col("filed"))
    )
    return with_priority(history.scored(joined), as_of, True, priority)


def usual_length(cases: DataFrame) -> DataFrame:
    """One row: the most frequent length of a vector, the smallest of several."""
    vector = F.col("embedding")
    return cases.where(vector.isNotNull()).agg(F.mode(F.size(vector), True))


def checked(cases: DataFrame, dimensions: int | None = None) -> DataFrame:
    """The cases with every unreadable value set to null, and `errors`: an array of (stage, column, reason), empty for a sound row.

    Dates and amounts may be text; the column then becomes a date or a number. A vector is unusable when a component is missing or
    not finite, or its length is not `dimensions` (without it: the most frequent length). A missing amount or vector is no error,
    a missing date is, as the deadline needs one. Nothing here fails a row, whatever the session's ANSI setting.
    """
    found, sound, none = [], {}, F.array().cast(ERRORS)

    def stage(name: str, column: str, reason: str, bad: Column, value: Column) -> None:
        error = F.struct(F.lit(name).alias("stage"), F.lit(column).alias("column"), F.lit(reason).alias("reason"))
        found.append(F.when(bad, F.array(error)).otherwise(none))
        sound[column] = F.when(~bad, value)

    def finite(x: Column) -> Column:
        return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))

    if "date" in cases.columns:
        day = F.col("date").try_cast("date")
        stage("deadline", "date", "unreadable filing date", day.isNull(), day)
    if "amount_involved" in cases.columns:
        amount = F.col("amount_involved").try_cast("double")
        stage("severity", "amount_involved", "unreadable amount", F.col("amount_involved").isNotNull() & ~finite(amount), amount)
    if "embedding" in cases.columns:
        vector = F.col("embedding")
        length = F.lit(dimensions) if dimensions else usual_length(cases).scalar()
        usable = (F.size(vector) == length) & F.forall(vector, finite)
        stage("duplicates", "embedding", "unusable vector", vector.isNotNull() & ~F.coalesce(usable, F.lit(False)), vector)
    errors = F.concat(none, *found)
    # The errors are read from the values as they came, so both are one projection.
    return cases.select(*[sound[c].alias(c) if c in sound else F.col(c) for c in cases.columns if c != "errors"], errors.alias("errors"))


def process_pending(table: DataFrame, as_of, with_alerts: bool = True, dimensions: int | None = None,
                    **options) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """L2: enrich the unprocessed cases, cluster all vectors once, and summarise the run.

    A row with values that cannot be read is kept without them; `errors` lists them (`checked`), `error` is the first reason.
    """
    # The table may be joined from many: the length of its vectors is looked up once, and the pending cases, which several stages read, are stored once.
    if not dimensions and "embedding" in table.columns:
        dimensions = usual_length(table).first()[0]
    table = checked(table, dimensions)
    pending = cut_lineage(table.where(F.col("processed_at").isNull()))
    done = enrich(pending, as_of, **options).withColumn("error", F.get("errors", F.lit(0))["reason"])
    # Clusters are profiled with the labels the run has just assigned.
    alerts = rootcause.detect(write_back(table.drop("errors"), done)) if with_alerts else None
    return done, alerts, kpi.run_summary(done, alerts)


def write_back(table: DataFrame, enriched: DataFrame) -> DataFrame:
    """Patch the case table with every enriched column."""
    written = [
        "category", "severity", "sentiment", "intake_json", "duplicate_of", "similarity", "draft_response",
        "sla_due_date", "sla_breach_prob", "risk_score", "risk_ombudsman", "risk_churn", "risk_social",
        "status", "resolved_at", "processed_at", "priority_score", "ml_category", "ml_category_prob", "category_confidence",
        "ml_sentiment", "ml_sentiment_prob", "sentiment_confidence",
    ]
    return patch(table, enriched.select("id", *[c for c in written if c in enriched.columns]))

