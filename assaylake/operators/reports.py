"""Reports over graded runs: bootstrap intervals, the reliability report, scores of extractions, projections of stored runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.hashing import hash32
from assaylake.operators import agreement, calibration, rollup

#: Cumulated Poisson(1) probabilities: how often a row is drawn into a resample.
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759)
#: Steps of the 32-bit mixer: after each shift the number is multiplied, modulo 2**32.
MIXER = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))
#: Distance between the seeds of a row's resamples.
STRIDE = 0x9E3779B1


def draws(seeds: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """Poisson(1) counts, a row for each resample and a column for each 32-bit seed."""
    x = (seeds[None, :] + resamples[:, None] * np.uint64(STRIDE)) & np.uint64(0xFFFFFFFF)
    for shift, factor in MIXER:
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return np.searchsorted(np.array(POISSON) * 2.0**32, x.astype(np.float64).ravel(), side="right").reshape(x.shape)


def _resampled(resamples: int, rows: int = 4096, block: int = 50):
    """resample, w, wx of a task: a block of resamples times a block of rows is a matrix of counts, multiplied by the values."""

    def run(batches):
        w, wx = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            seeds, x = b.column("seed").to_numpy().astype(np.uint64), b.column("x").to_numpy()
            for i in range(0, len(x), rows):
                for k in range(0, resamples, block):
                    n = draws(seeds[i : i + rows], np.arange(k, min(k + block, resamples), dtype=np.uint64)).astype(float)
                    w[k : k + block] += n.sum(1)
                    wx[k : k + block] += n @ x[i : i + rows]
        if w.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(w), pa.array(wx)], ["b", "w", "wx"])

    return run


def bootstrap(rows: DataFrame, key: str, value: str, resamples: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Interval of the mean of ``value``: ci_low, ci_high, resamples. Rows without a value do not count.

    A row's number of draws in a resample is Poisson(1) by a hash of its key and the resample's number, which for many rows
    is drawing with replacement. Each task multiplies its rows by the counts of all resamples, so ``resamples`` partial
    sums leave it. The bounds are the sorted means at the places of alpha / 2 and 1 - alpha / 2; resamples in which no
    row is drawn have no mean.
    """
    each = rows.filter(F.col(value).isNotNull()).select(hash32("boot", F.col(key)).alias("seed"), F.col(value).cast("double").alias("x"))
    sums = each.mapInArrow(_resampled(resamples), "b int, w double, wx double").groupBy("b").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))
    sorted_ = sums.agg(F.array_sort(F.collect_list(F.col("wx") / F.nullif("w", F.lit(0)))).alias("m"))
    at = lambda p: F.round(F.get("m", F.floor(F.size("m") * F.lit(p)).cast("int")), 6)
    return sorted_.select(at(alpha / 2).alias("ci_low"), at(1 - alpha / 2).alias("ci_high"), F.size("m").alias("resamples"))


def mean_kappa(votes: DataFrame) -> DataFrame:
    """Mean over the cases of the kappa of their judges, with the runs as items; cases without one do not count."""
    k = agreement.fleiss_kappa(votes, ["run"], "vote", ["case_id"], guarded=False)
    return k.agg(F.count("kappa").alias("cases"), F.round(F.avg("kappa"), 6).alias("mean_kappa"))


def reliability_report(votes: DataFrame) -> DataFrame:
    """metric, n, value, insufficient of every measure over the labeled votes; an undefined value is null and insufficient."""
    one = lambda df, name, n, value: df.select(F.lit(name).alias("metric"), F.col(n).cast("long").alias("n"), F.col(value).cast("double").alias("value"))
    pooled = votes.withColumn("role", F.lit("all"))
    graded = calibration.graded(pooled)
    parts = [
        one(agreement.fleiss_kappa(votes, ["case_id", "run"], "vote"), "inter_judge_kappa", "items", "kappa"),
        one(agreement.cohen_kappa(votes.select(F.lit("all").alias("role"), (F.col("vote") == "BLOCK").alias("pred"), "gold_block"), "pred", "gold_block", ["role"]), "cohen_kappa_vs_gold", "n", "kappa"),
        one(calibration.ece_right_closed(pooled), "ece", "n", "ece"),
        one(calibration.brier(pooled), "brier", "n", "brier"),
        one(agreement.effective_votes(votes), "error_phi", "pairs", "mean_phi"),
        one(agreement.effective_votes(votes), "effective_votes", "k", "n_eff"),
        one(rollup.intra_judge_stability(votes).agg(F.sum("cases").alias("cases"), F.round(F.avg("stability"), 6).alias("stability")), "intra_judge_stability", "cases", "stability"),
        one(graded.agg(F.count_if(F.col("vote") != "WARN").alias("decided"), F.round(F.avg(F.when(F.col("vote") != "WARN", F.col("ok").cast("double"))), 6).alias("accuracy")), "selective_accuracy", "decided", "accuracy"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("insufficient", F.col("value").isNull())


def extraction_score(records: DataFrame, expected: DataFrame, complete: Column) -> DataFrame:
    """Of each template (template, expected_count): records found, incomplete ones, acceptance and the share of the burden met."""
    n = records.groupBy("template").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.coalesce(complete, F.lit(False))).alias("nulls"))
    j = expected.join(n, "template", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("nulls", F.coalesce("nulls", F.when(F.col("expected_count") > 0, F.col("expected_count")).otherwise(1)))
    found = F.col("count")
    accepted = (found > 0) & (found == F.col("expected_count")) & (F.col("nulls") == 0)
    counted = F.when(found == F.col("expected_count"), 1.0).when(F.col("expected_count") > 0, F.least(found, "expected_count") / F.col("expected_count")).otherwise(0.0)
    held = F.when(found > 0, (found - F.col("nulls")) / found).otherwise(0.0)
    return j.select("template", "expected_count", found.cast("long").alias("count"), F.col("nulls").cast("long").alias("nulls"), accepted.alias("accepted"), F.when(accepted, 1.0).otherwise(F.round(counted * held, 3)).alias("graded"))


def argument_score(outputs: DataFrame, body: str, required: dict[str, str]) -> DataFrame:
    """Required keys (name -> type pattern) of a JSON object that are missing or of another type, and the share satisfied."""
    value = lambda k: F.get_json_object(body, f"$.{k}")
    missing = F.array_compact(F.array(*[F.when(value(k).isNull(), F.lit(k)) for k in required]))
    wrong = F.array_compact(F.array(*[F.when(value(k).isNotNull() & ~value(k).rlike(p), F.lit(k)) for k, p in required.items()]))
    bad = F.size(missing) + F.size(wrong)
    return outputs.withColumn("missing", F.array_join(missing, ",")).withColumn("wrong", F.array_join(wrong, ",")).withColumn("graded", F.round((len(required) - bad) / len(required), 3)).withColumn("accepted", bad == 0)


def corpus_gate(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """A contract over a corpus: every finding of a clean case has to be cleared, and of a blocked one some has to stand."""
    by = findings.groupBy("case_id").agg(F.bool_and("cleared").alias("all_cleared"), F.bool_or(~F.col("cleared")).alias("stands"))
    j = cases.join(by, "case_id", "left")
    block, fine = F.col("expected_block"), F.when(F.col("expected_block"), F.coalesce("stands", F.lit(False))).otherwise(F.coalesce("all_cleared", F.lit(False)))
    return j.agg(F.count_if(block).alias("positives"), F.count_if(block & fine).alias("standing"), F.count_if(~block).alias("negatives"), F.count_if(~block & fine).alias("cleared"), F.bool_and(fine).alias("passed"))


def usage(calls: DataFrame, key: str) -> DataFrame:
    """Tokens in and out of each key's calls; keys without any have no row."""
    s = calls.groupBy(key).agg(F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"))
    return s.filter("tokens_in > 0 or tokens_out > 0")


def composite_report(buckets: DataFrame) -> DataFrame:
    """Report of each case from its findings' buckets: verdict and score of the active ones, and how many went where."""
    n = lambda b: F.count_if(F.col("bucket") == b)
    score = F.coalesce(F.max(F.when(F.col("bucket") == "active", F.col("weight"))), F.lit(0.0))
    by = buckets.groupBy("case_id").agg(score.alias("score"), n("active").alias("active"), n("suppressed").alias("suppressed"), n("ungrounded").alias("ungrounded"), n("skipped_non_gradeable").alias("skipped"))
    verdict = F.when(F.col("score") >= 0.5, "reject").when(F.col("score") > 0, "needs_review").otherwise("approve")
    words = F.concat(F.col("active").cast("string"), F.lit(" active, "), F.col("suppressed").cast("string"), F.lit(" suppressed, "), F.col("ungrounded").cast("string"), F.lit(" ungrounded, "), F.col("skipped").cast("string"), F.lit(" skipped"))
    return by.select("case_id", verdict.alias("verdict"), "score", "active", "suppressed", words.alias("reasoning"))


def reshaped(blobs: DataFrame, body: str, run_id: str) -> DataFrame:
    """Results from stored runs: verdict, decision and stages at the top, stages that are missing as NOT_APPLICABLE; each with an id of its own that points at the run it replays."""
    get = lambda p: F.get_json_object(body, p)
    stage = lambda s: F.coalesce(get(f"$.stage_results.{s}.verdict"), F.lit("NOT_APPLICABLE")).alias(s)
    findings = F.size(F.coalesce(F.from_json(get("$.findings"), "array<string>"), F.array().cast("array<string>")))
    return blobs.select(get("$.verdict").alias("verdict"), get("$.gate_decision").alias("decision"), findings.cast("long").alias("findings"), stage("structural"), stage("semantic"), F.concat(F.lit("replay-"), run_id).alias("run_id"), F.col(run_id).alias("replay_of"))


def demographics(patients: DataFrame, body: str) -> DataFrame:
    """Patients in JSON as flat rows; an unknown gender is U, an absent birth date 1900-01-01."""
    from assaylake.functions.records import GENDERS

    get = lambda p: F.get_json_object(body, p)
    gender = F.coalesce(F.create_map(*[F.lit(x) for kv in GENDERS.items() for x in kv])[get("$.gender")], F.lit("U"))
    return patients.select(get("$.id").alias("patient_id"), F.coalesce(get("$.name[0].given[0]"), F.lit("")).alias("first_name"), F.coalesce(get("$.name[0].family"), F.lit("")).alias("last_name"), F.coalesce(get("$.birthDate"), F.lit("1900-01-01")).alias("dob"), gender.alias("gender"))


def best_candidate(candidates: DataFrame, key: str) -> DataFrame:
    """Of each key the first accepted candidate, else the best graded, the earlier on ties."""
    rank = F.struct(F.col("accepted").cast("int"), F.when(F.col("accepted"), 0.0).otherwise(F.col("graded")), -F.col("place"))
    return candidates.groupBy(key).agg(F.max_by(F.struct("place", "accepted", "graded"), rank).alias("x")).select(key, "x.*")


def recommendation(panels: DataFrame, single_k: int = 5) -> DataFrame:
    """Reviewer configuration of each pack (panel, selectable): two specialists or more are a panel, else one reviewer with ``single_k`` samples, a generalist if there is one."""
    others = F.array_except("selectable", "panel")
    many = F.size("panel") >= 2
    reviewer = F.when(~many, F.coalesce(F.get(others, F.lit(0)), F.get("panel", F.lit(0))))
    return panels.withColumn("mode", F.when(many, "panel").otherwise("single")).withColumn("reviewer", reviewer).withColumn("k", F.when(~many, F.lit(single_k)))


def audited(changes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Writes of a record with the value before and after; null before the first is a creation, null after a deletion."""
    before = F.expr(f"lag({value}) over (partition by {key} order by {order})")
    rows = changes.withColumn("before", before).withColumn("after", F.col(value))
    return rows.withColumn("action", F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update"))


def timeline(log: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` runs of each key from the oldest, with the number of their segment of equal signatures."""
    kept = log.withColumn("back", F.expr(f"row_number() over (partition by {key} order by {order} desc)")).filter(F.col("back") <= n)
    changed = kept.withColumn("change", F.expr(f"if(signature <=> lag(signature) over (partition by {key} order by {order}) and row_number() over (partition by {key} order by {order}) > 1, 0, 1)"))
    return changed.withColumn("segment", F.expr(f"sum(change) over (partition by {key} order by {order} rows between unbounded preceding and current row)")).withColumn("place", F.expr(f"row_number() over (partition by {key} order by {order})")).drop("back", "change")
