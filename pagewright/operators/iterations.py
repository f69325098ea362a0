"""A/B evaluation of a candidate run against a baseline run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import compact, let, reason
from ..functions.web import redact
from .skew import attach, fits_broadcast

# Compared fingerprint parts, weights of the quality proxy, thresholds.
COMPARED = ("page_hash", "schema_signature", "model", "model_endpoint_hash", "enable_field_repair",
            "reuse_verified_program", "program_spec_mode", "evaluator_version")
WEIGHTS = {"verification_score": 0.5, "field_completion_rate": 0.3, "evidence_coverage": 0.2}
GUARDED = (*WEIGHTS, "required_field_missing_rate")
EPSILON = 1e-9
MIN_GAIN, MAX_SLOWDOWN = 0.01, 0.2
QUALITY_BASIS = "verifier_completion_evidence_proxy_not_gold_accuracy"
EVALUATION_VERSION = "2"


def _metric(run: Column, name: str) -> Column:
    return F.try_element_at(run["metrics"], F.lit(name))


def mismatches(base: Column, cand: Column) -> Column:
    """Why two runs cannot be compared."""
    fp_b, fp_c = base["fingerprint"], cand["fingerprint"]

    def absent(name):
        return (F.coalesce(fp_b[name], F.lit("")) == "") | (F.coalesce(fp_c[name], F.lit("")) == "")

    no_version = base["metrics_version"].isNull() | cand["metrics_version"].isNull()
    return compact(
        *[reason(~fp_b[k].eqNullSafe(fp_c[k]), k) for k in COMPARED],
        reason(~base["workflow_type"].eqNullSafe(F.lit("extraction"))
               | ~cand["workflow_type"].eqNullSafe(F.lit("extraction")), "workflow_type"),
        *[reason(absent(k), f"missing_{k}") for k in ("page_hash", "schema_signature", "evaluator_version")],
        reason(base["task_id"] == cand["task_id"], "identical_run_ids"),
        reason(no_version, "missing_metrics_version"),
        reason(~no_version & (base["metrics_version"] != cand["metrics_version"]), "metrics_version"))


def unmeasured(base: Column, cand: Column) -> Column:
    """Guardrail metrics that are not finite, measured and within [0, 1] on both sides."""
    def bad(run, name):
        m = _metric(run, name)
        return ~F.coalesce(m["value"].between(0, 1) & ~F.isnan(m["value"]) & (m["source"] == "measured"),
                           F.lit(False))

    return compact(*[reason(bad(run, name), f"{label}.{name}")
                     for name in GUARDED for label, run in (("baseline", base), ("candidate", cand))])


def regressions(base: Column, cand: Column) -> Column:
    def worse(name):
        change = _metric(cand, name)["value"] - _metric(base, name)["value"]
        return (change if name == "required_field_missing_rate" else -change) > EPSILON

    return compact(*[reason(worse(name), name) for name in GUARDED])


def _quality(run: Column) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + _metric(run, name)["value"] * weight
    return total


def metric_deltas(base: Column, cand: Column, quality: Column) -> Column:
    both = F.map_zip_with(base["metrics"], cand["metrics"], lambda _, b, c: c["value"] - b["value"])
    extra = F.create_map(F.lit("quality_proxy"), quality, F.lit("runtime_ms"),
                         cand["runtime_ms"] - base["runtime_ms"])
    named = F.map_filter(both, lambda k, v: v.isNotNull() & ~k.isin("quality_proxy", "runtime_ms"))
    return F.map_concat(extra, named)


def decide(base: Column, cand: Column, min_gain: float = MIN_GAIN, max_slowdown: float = MAX_SLOWDOWN) -> Column:
    """STRUCT<status, reason, mismatches, unmeasured, regressions, quality_delta, latency_ratio, deltas>."""
    gathered = F.struct(mismatches(base, cand).alias("apart"), unmeasured(base, cand).alias("unknown"),
                        regressions(base, cand).alias("worse"))

    def judge(g):
        delta = F.when(F.size(g["unknown"]) == 0, _quality(cand) - _quality(base))
        slow = F.when(base["runtime_ms"] != 0, (cand["runtime_ms"] - base["runtime_ms"]) / base["runtime_ms"])
        return let(F.struct(delta.alias("d"), slow.alias("s")), lambda x: verdict(g, x))

    def verdict(g, x):
        no_runtime = F.coalesce(base["runtime_ms"], F.lit(0)) == 0
        blank = no_runtime | cand["runtime_ms"].isNull() | x["d"].isNull()

        def listed(text, names):
            return F.concat(F.lit(text), F.array_join(names, ", "))

        status = F.when((F.size(g["apart"]) > 0) | (F.size(g["unknown"]) > 0) | blank, "blocked") \
            .when((F.size(g["worse"]) > 0) | (x["d"] + EPSILON < min_gain)
                  | F.coalesce(x["s"] > max_slowdown, F.lit(False)), "rejected").otherwise("accepted")
        # Results are compared by these texts.
        why = F.when(F.size(g["apart"]) > 0, listed("incomparable fingerprints: ", g["apart"])) \
            .when(F.size(g["unknown"]) > 0, listed("guardrail measurements unavailable: ", g["unknown"])) \
            .when(blank, "quality or runtime metric unavailable") \
            .when(F.size(g["worse"]) > 0, listed("quality guardrail regression: ", g["worse"])) \
            .when(x["d"] + EPSILON < min_gain, "quality improvement is below configured threshold") \
            .when(F.coalesce(x["s"] > max_slowdown, F.lit(False)),
                  "latency regression exceeds configured threshold") \
            .otherwise("quality improvement meets threshold within latency guardrail")
        return F.struct(
            status.alias("status"), why.alias("decision_reason"), g["apart"].alias("mismatches"),
            g["unknown"].alias("unmeasured"), g["worse"].alias("regressions"), x["d"].alias("quality_delta"),
            x["s"].alias("latency_ratio"), metric_deltas(base, cand, x["d"]).alias("metric_deltas"))

    return let(gathered, judge)


def evaluate_iterations(requests: DataFrame, runs: DataFrame, iterations: DataFrame | None = None,
                        min_gain: float = MIN_GAIN, max_slowdown: float = MAX_SLOWDOWN) -> DataFrame:
    """Decide every (iteration_id, experiment_id, baseline_run_id, candidate_run_id, parent_iteration_id).

    Unknown or unfinished runs and foreign parents give ``error`` instead of a decision.
    """
    shape = ("task_id", "status", "workflow_type", "runtime_ms", "fingerprint", "metrics", "metrics_version")
    side = runs.select(F.struct(*shape).alias("_run"), F.col("task_id").alias("_id"))

    small = fits_broadcast(side)

    def lookup(df, column, name):
        return attach(df, side.select(F.col("_id").alias(column), F.col("_run").alias(name)), column, small=small)

    joined = lookup(lookup(requests, "baseline_run_id", "_b"), "candidate_run_id", "_c")
    if iterations is not None:
        parents = iterations.select(F.col("iteration_id").alias("parent_iteration_id"),
                                    F.col("experiment_id").alias("_parent"))
        joined = attach(joined, parents, "parent_iteration_id")
    else:
        joined = joined.withColumn("_parent", F.lit(None).cast("string"))

    def run_error(col, id_col):
        return F.when(F.col(col).isNull(), F.concat(F.lit("run not found: "), F.col(id_col).cast("string"))) \
            .when(F.col(col)["status"] != "completed",
                  F.concat(F.lit("run "), F.col(id_col).cast("string"), F.lit(" is not completed")))

    error = F.coalesce(
        run_error("_b", "baseline_run_id"), run_error("_c", "candidate_run_id"),
        F.when(F.col("parent_iteration_id").isNotNull() & F.col("_parent").isNull(), "parent iteration not found"),
        F.when(F.col("parent_iteration_id").isNotNull() & (F.col("_parent") != F.col("experiment_id")),
               "parent iteration belongs to a different experiment"))
    decided = joined.withColumn("error", error).withColumn("_d", F.when(
        F.col("error").isNull(), decide(F.col("_b"), F.col("_c"), min_gain, max_slowdown)))
    return decided.select(
        *requests.columns, "error", "_d.*", F.lit(QUALITY_BASIS).alias("quality_basis"),
        F.lit(EVALUATION_VERSION).alias("evaluation_version"))


def roll_back(iterations: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply rollback requests (iteration_id, rollback_reason, rollback_at); the first one counts.

    Already rolled back stays as it is; only accepted or rejected iterations change; ``error``
    says why a request had no effect.
    """
    first = requests.groupBy("iteration_id").agg(
        F.min(F.struct("rollback_at", "rollback_reason")).alias("_r"))
    known = iterations
    for name, kind in (("rollback_reason", "string"), ("rollback_at", "timestamp")):
        if name not in known.columns:
            known = known.withColumn(name, F.lit(None).cast(kind))
    joined = known.join(first, "iteration_id", "left")
    asked = F.col("_r").isNotNull()
    may = asked & F.col("status").isin("accepted", "rejected")
    kept = [c for c in iterations.columns if c not in ("status", "rollback_reason", "rollback_at")]
    return joined.select(
        *kept, F.when(may, "rolled_back").otherwise(F.col("status")).alias("status"),
        F.when(may, redact(F.col("_r.rollback_reason"))).otherwise(F.col("rollback_reason")).alias("rollback_reason"),
        F.when(may, F.col("_r.rollback_at")).otherwise(F.col("rollback_at")).alias("rollback_at"),
        F.when(asked & ~may & (F.col("status") != "rolled_back"),
               "only accepted or rejected iterations can be rolled back").alias("error"))
