"""What serving needs beside the dashboards: request scoring, configuration, audit rows, replies of a text provider, prompts and batch plans."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import customer_type, is_true, shown, steady, with_default
from tidemark.operators import agent, features, learn, playbook, scoring, validate
from tidemark.sources.logs import typed
from tidemark.sources.stage import written

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


# Defaults of a request's categories, configuration keys and their fallbacks, audit tables.
REQUEST_DEFAULTS = {"PreferredLoginDevice": "Mobile Phone", "PreferredPaymentMode": "Debit Card", "Gender": "Male", "PreferedOrderCat": "Laptop & Accessory", "MaritalStatus": "Single"}
CONFIG = {
    "assumed_clv_usd": "500",
    "intervention_types": "Discount Offer,Loyalty Reward,Personalized Content,Proactive Support Call,Reactivation Campaign,Premium Upgrade,Service Recovery",
    "channels": "In-App Notification,Email,Push Notification,Direct Call,SMS",
    "timing_options": "Immediate,Within 24 hours,Within 1 week,During next session",
}
ACTIONS = _table(
    "id string, customer_id string, segment string, churn_probability double, uplift_score double, net_roi double, intervention_type string, channel string, timing string, "
    "message_framing string, agent_reasoning string, agentic_mode boolean, generated_at timestamp_ntz, confidence string"
)
FEEDBACK = _table("id string, retention_action_id string, customer_id string, outcome string, logged_at timestamp_ntz")
CONVERSATIONS = _table("id string, session_id string, created_at timestamp_ntz")
MESSAGES = _table("id string, conversation_id string, role string, content string, tool_calls string, created_at timestamp_ntz")
EXPORTED = {
    "customer_id": "CustomerID", "segment": "Segment", "churn_probability": "ChurnProbability", "uplift_score": "UpliftScore", "net_roi": "NetROI", "intervention_type": "InterventionType",
    "channel": "Channel", "timing": "Timing", "intervention_cost_estimate": "Cost", "confidence": "Confidence", "primary_risk_reason": "WhyAtRisk", "message_framing": "SuggestedMessage", "expected_outcome": "ExpectedOutcome",
}


def serving_tier(p: Column) -> Column:
    """Left-closed tiers of the scoring endpoint; null stays null."""
    return F.when(p.isNull(), None).when(p < 0.3, "Low Risk").when(p < 0.6, "Medium Risk").otherwise("High Risk")


def score_requests(requests: DataFrame, stats: DataFrame, key: str = "CustomerID") -> DataFrame:
    """(key, valid, errors, segment, churn_probability, churn_prediction, risk_tier, customer_type): one row for each request; scores are null where it isn't valid.

    ``stats`` are the maxima of the training rows, so a request is scaled as they were. Missing categories take their defaults; uplift is unknown and counts as 0.
    """
    given = requests.withColumns({c: F.coalesce(with_default(requests, c, None).cast("string"), F.lit(v)) for c, v in REQUEST_DEFAULTS.items()})
    checked = validate.check_requests(given)
    scored = scoring.score(scoring.assign_segments(features.composites(checked, stats)))
    p = F.when(F.col("valid"), F.col("ChurnProbability"))
    return scored.select(
        key, "valid", "errors", F.when(F.col("valid"), F.col("Segment")).alias("segment"), steady(p, 4).alias("churn_probability"),
        F.when(p.isNotNull(), is_true(p >= 0.5).cast("int")).alias("churn_prediction"), serving_tier(p).alias("risk_tier"), F.when(F.col("valid"), customer_type(F.lit(0.0), p)).alias("customer_type"),
    )


def score_by_models(requests: DataFrame, stats: DataFrame, segments: DataFrame, churn: DataFrame, codes: DataFrame | None = None, key: str = "CustomerID") -> DataFrame:
    """As ``score_requests``, by trained models: the segment of the nearest centre, and the probability of that segment's own churn model (null where it has none).

    ``stats``, ``codes``, ``segments`` and ``churn`` are what the batch run keeps (feature_stats, codes, segment_model, churn_models), so requests are scaled, coded and scored as the training rows were. A category that
    training hasn't seen counts as unknown.
    """
    given = requests.withColumns({c: F.coalesce(with_default(requests, c, None).cast("string"), F.lit(v)) for c, v in REQUEST_DEFAULTS.items()})
    checked = written(validate.check_requests(given).withColumnRenamed(key, "CustomerID"))
    fine = features.composites(checked.filter("valid"), stats)
    fine = fine if codes is None else features.encode(fine, [r[0] for r in codes.select("column").distinct().collect()], codes)  # at most five columns
    known = written(fine.drop("Segment").join(learn.segments_of(fine, segments), "CustomerID"))
    p = learn.segment_scores(known, models=churn).select("CustomerID", F.col("Segment").alias("segment"), F.col("ChurnProbability").alias("p"))
    out = checked.select("CustomerID", "valid", "errors").join(p, "CustomerID", "left")
    q = F.col("p")
    return out.select(
        F.col("CustomerID").alias(key), "valid", "errors", "segment", steady(q, 4).alias("churn_probability"), F.when(q.isNotNull(), is_true(q >= 0.5).cast("int")).alias("churn_prediction"), serving_tier(q).alias("risk_tier"),
        F.when(q.isNotNull(), customer_type(F.lit(0.0), q)).alias("customer_type"),
    )


def config_rows(spark, values: dict[str, str] | None = None) -> DataFrame:
    """The seed rows (key, value) of the configuration."""
    return spark.createDataFrame(list((CONFIG if values is None else values).items()), "key string, value string")


def config(table: DataFrame) -> DataFrame:
    """One row: the configuration's values by name, with a fallback for each missing key; lists as arrays, the lifetime value as a number."""
    row = table.filter(F.col("key").isin(*CONFIG)).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in CONFIG])
    row = row.select(*[F.coalesce(k, F.lit(v)).alias(k) for k, v in CONFIG.items()])
    return row.select(F.col("assumed_clv_usd").try_cast("double").alias("assumed_clv"), *[F.split(k, ",").alias(k) for k in CONFIG if k != "assumed_clv_usd"])


# ---------------------------------------------------------------- replies


def stripped(reply: Column) -> Column:
    """A reply without its thinking and function tags, trimmed."""
    out = F.regexp_replace(reply, r"(?is)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?is)<function=.*?</function>", ""), r"^\s+|\s+$", "")


def fenced_json(reply: Column) -> Column:
    """The text between the first fence marked json (or else the first fence) and the next; the whole text without a fence."""
    part = lambda mark: F.element_at(F.split(F.element_at(F.split(reply, mark, 2), 2), "```", 2), 1)
    return F.regexp_replace(F.when(reply.contains("```json"), part("```json")).when(reply.contains("```"), part("```")).otherwise(reply), r"^\s+|\s+$", "")


def numbers_of(json: Column) -> Column:
    """A JSON object of numbers as a map; an empty map where it is malformed, null or no object."""
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.from_json(json, T.MapType(T.StringType(), T.DoubleType())), empty)


# ---------------------------------------------------------------- audit rows


def action_rows(actions: DataFrame, customers: DataFrame) -> DataFrame:
    """The audit table's rows: actions with what is known of their customer when they are saved; those without an intervention aren't saved.

    ``trace`` (an array of structs) becomes JSON; missing columns are null.
    """
    known = customers.select("customer_id", "segment", "churn_probability", "uplift_score", "net_roi")
    rows = actions.filter(F.col("intervention_type").isNotNull()).drop("segment", "churn_probability", "uplift_score", "net_roi").join(known, "customer_id", "left")
    trace = F.to_json("trace") if "trace" in actions.columns else F.lit(None)
    rows = rows.withColumn("agent_reasoning", trace)
    return typed(rows.select(*[c for c in ACTIONS.names if c in rows.columns]), ACTIONS)


def feedback_rows(feedback: DataFrame, actions: DataFrame) -> DataFrame:
    """The feedback log's rows: feedback (id, retention_action_id, outcome, logged_at) with the customer of its action, null where there is no such action."""
    a = actions.select(F.col("id").alias("retention_action_id"), "customer_id").dropDuplicates(["retention_action_id"])
    return typed(feedback.join(a, "retention_action_id", "left"), FEEDBACK)


def conversation_rows(messages: DataFrame) -> DataFrame:
    """The conversation log's rows, one for each conversation of messages (conversation_id, session_id, created_at): it begins with its first message."""
    first = messages.groupBy("conversation_id").agg(F.min("session_id").alias("session_id"), F.min("created_at").alias("created_at"))
    return typed(first.withColumnRenamed("conversation_id", "id"), CONVERSATIONS)


def message_rows(messages: DataFrame) -> DataFrame:
    """The message log's rows from messages (conversation_id, turn, role, content, created_at, and ``tools``, an array, where there are any): ids are conversation and turn, tool calls become JSON."""
    calls = F.to_json("tools") if "tools" in messages.columns else F.lit(None)
    rows = messages.withColumn("id", F.concat_ws("-", F.col("conversation_id").cast("string"), F.col("turn").cast("string"))).withColumn("tool_calls", calls)
    return typed(rows.select(*MESSAGES.names), MESSAGES)


def new_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Random ids; they differ from run to run."""
    return df.withColumn(column, F.expr("uuid()"))


def export_columns(plans: DataFrame) -> DataFrame:
    """The 13 columns of the export, renamed; those that a plan lacks are null."""
    return plans.select(*[(F.col(c) if c in plans.columns else F.lit(None).cast("string")).alias(n) for c, n in EXPORTED.items()])


# ---------------------------------------------------------------- prompts and plans


def with_profile(customers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Customers with their segment's profile (``scoring.segment_profiles``) in columns ``profile_*``; null for a segment without one."""
    p = profiles.select(F.col("Segment").alias("segment"), *[F.col(c).alias(f"profile_{c}") for c in profiles.columns if c != "Segment"])
    return customers.join(p, "segment", "left")


def prompts(customers: DataFrame, drivers: DataFrame) -> DataFrame:
    """(customer_id, prompt): fourteen fields of a customer and its drivers, strongest first. ``drivers``: (CustomerID, Drivers). Customers ``with_profile`` get their segment's means and churn rate too."""
    d = drivers.select(F.col("CustomerID").alias("customer_id"), F.array_join(F.transform("Drivers", lambda e: F.format_string("%s %.4f", e["feature"], e["value"])), "; ").alias("why"))
    fields = F.format_string(
        "Customer %s. Segment: %s. Type: %s. Tier: %s. Churn probability %.1f%%. Uplift %.4f. Net ROI $%.2f. Tenure %.0f. Satisfaction %d of 5. Days since last order %.0f. Hours on app %.1f. Complained: %d. Orders %d. Cashback $%.2f.",
        "customer_id", "segment", "customer_type", "risk_tier", shown(F.col("churn_probability") * 100, 1), shown(F.col("uplift_score"), 4), shown(F.col("net_roi"), 2), "tenure", "satisfaction_score",
        "days_since_last_order", "hour_spend_on_app", "complain", "order_count", shown(F.col("cashback_amount"), 2),
    )
    means = [c for c in customers.columns if c.startswith("profile_")]
    parts = [F.format_string(f"{c.removeprefix('profile_')} %s", F.col(c)) for c in means]
    profile = F.concat(F.lit(" Segment profile: "), F.concat_ws(", ", *parts), F.lit(".")) if means else F.lit("")
    return customers.join(d, "customer_id", "left").select("customer_id", F.concat(fields, F.lit(" Drivers: "), F.coalesce("why", F.lit("none")), F.lit("."), profile).alias("prompt"))


def candidates(customers: DataFrame, types: tuple[str, ...] = ("Persuadable",), n: int = 50) -> DataFrame:
    """The first ``n`` customers of the types by priority, unknown ones last, ties by id."""
    return customers.filter(F.col("customer_type").isin(*types)).orderBy(F.asc_nulls_last("intervention_priority"), "customer_id").limit(n)


# The keys of a plan as replies give them.
PLAN_KEYS = (
    "primary_risk_reason", "customer_receptivity", "intervention_type", "channel", "timing", "message_framing", "intervention_cost_estimate", "expected_outcome", "confidence", "do_not_intervene_reason",
)


def playbook_replies(rows: DataFrame) -> DataFrame:
    """The default provider: a deterministic reply for each row's ``risk`` from the seed rows of the playbook table, as fenced JSON."""
    found = agent.keyword_match(rows, "risk")
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for r in playbook.SEEDS for x in (r[1], r[k])]), F.col("keyword"))
    body = F.to_json(F.struct("intervention_type", F.lit("Email").alias("channel"), F.lit("Within 24 hours").alias("timing"), F.col("keyword").alias("primary_risk_reason"), of(3).alias("message_framing"), of(4).alias("intervention_cost_estimate"), F.lit("Medium").alias("confidence")))
    return found.withColumn("reply", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).drop("keyword", "intervention_type")


class RateLimited(Exception):
    """What a text provider raises to be called again later."""


def _object_in(reply: str) -> dict:
    """The JSON object of a reply, by the rules of ``stripped`` and ``fenced_json``; an error where there is none."""
    text = re.sub(r"(?is)<think>.*?</think>|<function=.*?</function>", "", reply).strip()
    mark = "```json" if "```json" in text else "```"
    if mark in text:
        text = text.split(mark, 1)[1].split("```", 1)[0].strip()
    got = json.loads(text)
    if not isinstance(got, dict):
        raise ValueError("no JSON object")
    return got


def asking(call: Callable[[str], str], tasks: int = 4, per_second: float = 0.5, attempts: int = 3, wait: float = 2.0, question: str = "prompt") -> Callable[[DataFrame], DataFrame]:
    """A provider that asks ``call`` each row's ``question`` and adds ``reply``, ``failed`` (the reason, null if none) and ``attempts``.

    Calls are made from ``tasks`` tasks, one at a time in each and at most ``per_second`` a second, so their number and rate are bounded whatever the cluster's size. A reply without a JSON object is asked for again, up
    to ``attempts`` times in all; after ``RateLimited`` the task first waits ``wait`` seconds times the number of the attempt. Other errors end the row at once. The last reply stays with the row, failed or not. A task
    that Spark runs again asks again.
    """

    def ask(text: str) -> tuple[str | None, str | None, int]:
        reply = None
        for n in range(1, attempts + 1):
            try:
                reply = call(text)
                _object_in(reply)
                return reply, None, n
            except RateLimited:
                if n < attempts:
                    time.sleep(wait * n)
                else:
                    return reply, "Max retries exceeded.", n
            except ValueError as e:  # among them errors of the JSON parser
                if n == attempts:
                    return reply, f"JSON parse error: {e}", n
            except Exception as e:  # noqa: BLE001 - whatever the provider raises is the row's error
                return reply, str(e) or type(e).__name__, n
        return reply, "Max retries exceeded.", attempts

    def provider(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("failed", T.StringType()), T.StructField("attempts", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = 0.0
            for batch in batches:
                got = []
                for text in batch.column(question).to_pylist():
                    time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                    last = time.monotonic()
                    got.append(ask(text or ""))
                cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema.names)

        return written(rows.repartition(tasks).mapInArrow(run, schema))  # asked once, however often the result is read

    return provider


def batch_plans(
    customers: DataFrame, drivers: DataFrame, n: int = 50, types: tuple[str, ...] = ("Persuadable",), provider: Callable[[DataFrame], DataFrame] = playbook_replies, questions: DataFrame | None = None
) -> DataFrame:
    """(customer_id, segment, what is known of the customer, intervention_priority, risk, the ten keys of a plan, error, raw_response): a plan for each candidate from its strongest driver.

    ``provider`` takes rows with ``risk``, and ``prompt`` where ``questions`` (customer_id, prompt) are given, and adds ``reply`` (and ``failed``, a reason, if it knows one). Replies are cleaned and parsed; one that is no
    JSON object gives an error and is kept as ``raw_response``.
    """
    first = drivers.select(F.col("CustomerID").alias("customer_id"), F.col("Drivers")[0].alias("d"))
    rows = candidates(customers, types, n).join(first, "customer_id", "left")
    rows = rows.withColumn("risk", F.concat(F.when(F.col("d.value") > 0, "high ").otherwise("low "), F.col("d.feature"))).drop("d")
    rows = rows if questions is None else rows.join(questions.select("customer_id", "prompt"), "customer_id", "left")
    got = provider(rows).withColumn("plan", F.from_json(fenced_json(stripped(F.col("reply"))), ", ".join(f"{k} string" for k in PLAN_KEYS)))
    bad = F.coalesce(F.col("plan.intervention_type"), F.col("plan.do_not_intervene_reason")).isNull()
    failed = F.col("failed") if "failed" in got.columns else F.lit(None).cast("string")
    error = F.coalesce(failed, F.when(bad, F.lit("reply is no plan")))
    known = [c for c in ("churn_probability", "uplift_score", "net_roi") if c in customers.columns]
    return got.select("customer_id", "segment", *known, "intervention_priority", "risk", *[F.when(error.isNull(), F.col(f"plan.{k}")).alias(k) for k in PLAN_KEYS], error.alias("error"), F.when(error.isNotNull(), F.col("reply")).alias("raw_response"))


def displayed(plans: DataFrame) -> DataFrame:
    """Adds ``display``: a plan as text; its error or the reason against it where there is one."""
    shown = lambda c: F.coalesce(F.col(c), F.lit("N/A")) if c in plans.columns else F.lit("N/A")
    # The lines of a displayed plan.
    lines = [
        F.concat(F.lit("**Intervention:** "), shown("intervention_type")),
        F.concat(F.lit("**Channel:** "), shown("channel"), F.lit(" | **Timing:** "), shown("timing")),
        F.concat(F.lit("**Cost:** "), shown("intervention_cost_estimate"), F.lit(" | **Confidence:** "), shown("confidence")),
        F.lit(""),
        F.concat(F.lit("**Why they're at risk:** "), shown("primary_risk_reason")),
        F.concat(F.lit("**Will they respond?** "), shown("customer_receptivity")),
        F.lit(""),
        F.lit("**Suggested Message:**"),
        F.concat(F.lit("> "), shown("message_framing")),
        F.lit(""),
        F.concat(F.lit("**Expected Outcome:** "), shown("expected_outcome")),
    ]
    against = F.concat(F.lit("**No Intervention Recommended**\n\n"), F.col("do_not_intervene_reason"))
    return plans.withColumn("display", F.when(F.col("error").isNotNull(), F.concat(F.lit("Error generating action: "), F.col("error"))).when(F.col("do_not_intervene_reason").isNotNull(), against).otherwise(F.concat_ws("\n", *lines)))
