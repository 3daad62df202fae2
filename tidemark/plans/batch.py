"""The batch run: features, segments, churn and uplift as stages that are written, with their models and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import learn, scoring
from tidemark.operators.features import CATEGORIES, all_codes, encode, feature_stats
from tidemark.sources.stage import save_stage


def segmentation(features: DataFrame, out: str, seeds: int = 20) -> DataFrame:
    """Features with RawSegment, Segment, soft memberships and an embedding, written to ``out/segmented``; the clusters to ``out/segment_model``."""
    model = save_stage(learn.segment_model(features, seeds=seeds), f"{out}/segment_model")
    got = features
    for part in (learn.segments_of(features, model), learn.gmm_soft(features).drop("GMM_Segment"), learn.neighbour_embedding(features)):
        got = got.join(part, "CustomerID")
    return save_stage(got, f"{out}/segmented")


def churn(segmented: DataFrame, out: str, **how) -> DataFrame:
    """Segmented rows with probability, prediction, tier and drivers, written to ``out/scored``; models to ``out/churn_models``, figures to ``out/run_metrics``, importances to ``out/importance``."""
    models = save_stage(learn.churn_models(segmented, **how), f"{out}/churn_models")
    save_stage(learn.run_metrics(models), f"{out}/run_metrics")
    save_stage(learn.segment_importance(models), f"{out}/importance")
    scores = learn.segment_scores(segmented, models=models).drop("Segment")
    drivers = learn.model_drivers(segmented, models).drop("Segment")
    return save_stage(segmented.join(scores, "CustomerID").join(drivers, "CustomerID", "left"), f"{out}/scored")


def uplift(scored: DataFrame, out: str, rounds: int = 200) -> DataFrame:
    """Scored rows with uplift, quadrant and ROI, written to ``out/uplift``; the learners to ``out/uplift_models``."""
    treated = scored.withColumn("Treatment", (F.coalesce(F.col("Complain") == 1, F.lit(False)) | F.coalesce(F.col("CouponUsed") > 0, F.lit(False))).cast("int"))
    models = save_stage(learn.uplift_models(treated, rounds), f"{out}/uplift_models")
    got = treated.join(learn.uplift_scores(treated, models=models), "CustomerID")
    got = got.withColumn("CustomerType", scoring.customer_type(F.col("UpliftScore"), F.col("ChurnProbability")))
    return save_stage(scoring.intervention_roi(got), f"{out}/uplift")


def run(features: DataFrame, out: str, seeds: int = 20, rounds: int = 500, uplift_rounds: int = 200) -> DataFrame:
    """All stages; the serving table is written to ``out/customers`` and returned. Later runs, readers and request scoring start from any stage (``load_stage``)."""
    given = [c for c in CATEGORIES if c in features.columns]
    codes = save_stage(all_codes(features, given), f"{out}/codes") if given else None
    save_stage(feature_stats(features), f"{out}/feature_stats")
    rows = save_stage(encode(features, given, codes), f"{out}/features")
    rows = uplift(churn(segmentation(rows, out, seeds), out, rounds=rounds), out, uplift_rounds)
    return save_stage(scoring.serving_table(rows), f"{out}/customers")
