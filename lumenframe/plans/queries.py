"""Queries over the driver's tables, one per operator, and their SQL counterparts.

Results that depend on the order of a summation are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import scratch
from lumenframe.functions import jpeg
from lumenframe.operators import gates, groups, normalization, pixels, quality, reporting, resampling, segmentation, tiles, tracking, tracks, validation
from lumenframe.plans import views
from lumenframe.plans.views import EVENTS_SQL, PIXELS_SQL, TRACKS_SQL, WELLS_SQL
from lumenframe.sources import images, pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (negative zero as zero); NaN as null."""
    return df.select(*[(F.round(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(*expressions: str, digits: int = 6) -> str:
    """``expr AS name`` pairs, rounded as :func:`rounded` does."""
    return ", ".join(f"round({e.rpartition(' AS ')[0]}, {digits}) + 0.0 AS {e.rpartition(' AS ')[2]}" for e in expressions)


# -- dataset level -----------------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL}, m AS (SELECT median(value) AS m FROM ev), d AS (SELECT median(abs(value - m)) AS d FROM ev, m) SELECT event_id, {r('CASE WHEN d > 0 THEN 0.6745 * (value - m) / d ELSE 0 END AS value_robust_z')} FROM ev, m, d")
def robust_z_column(spark, sf_dir):
    return normalization.robust_zscore_column(views.measurements(spark, sf_dir), "value").select("event_id", "value_robust_z")


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT median(value) AS mv, median(k) AS mk FROM ev), d AS (SELECT median(abs(value - mv)) AS dv, median(abs(k - mk)) AS dk FROM ev, m),
    z AS (SELECT event_id, CASE WHEN dv > 0 THEN 0.6745 * (value - mv) / dv ELSE 0 END AS value_robust_z, CASE WHEN dk > 0 THEN 0.6745 * (k - mk) / dk ELSE 0 END AS k_robust_z FROM ev, m, d)
    SELECT event_id, {r('value_robust_z AS value_robust_z', 'k_robust_z AS k_robust_z', 'greatest(abs(value_robust_z), abs(k_robust_z)) AS adaptive_score')},
      CASE WHEN greatest(abs(value_robust_z), abs(k_robust_z)) >= 3.5 THEN 'ADAPTIVE_OUTLIER' ELSE '' END AS flags FROM z"""
)
def adaptive_qc(spark, sf_dir):
    out = normalization.adaptive_dataset_qc(views.measurements(spark, sf_dir), metrics=("value", "k"))
    return out.select("event_id", "value_robust_z", "k_robust_z", "adaptive_score", "flags")


_REF = "m AS (SELECT median({v}) AS m FROM {t} WHERE {c}), d AS (SELECT median(abs({v} - m)) AS d, stddev_samp({v}) AS s FROM {t}, m WHERE {c})"


@query(f"WITH {EVENTS_SQL}, {_REF.format(v='value', t='ev', c='event_id % 5 = 0')} SELECT event_id, {r('(value - m) / CASE WHEN d > 0 THEN 1.4826 * d WHEN s > 0 THEN s ELSE 1 END AS z')} FROM ev, m, d")
def robust_z_reference(spark, sf_dir):
    return normalization.robust_zscore_reference(views.measurements(spark, sf_dir), "value", F.col("event_id") % 5 == 0, output="z").select("event_id", "z")


@query(f"WITH {EVENTS_SQL}, {_REF.format(v='value', t='ev', c='true')} SELECT event_id, {r('CASE WHEN d > 0 THEN (value - m) / (1.4826 * d) ELSE 0 END AS z')} FROM ev, m, d")
def robust_z_self(spark, sf_dir):
    return normalization.robust_zscore_self(views.measurements(spark, sf_dir), "value", output="z").select("event_id", "z")


@query(f"WITH {EVENTS_SQL}, b AS (SELECT median(value) AS b FROM ev WHERE event_type = 'click') SELECT event_id, {r('value / b AS value_normalized')} FROM ev, b")
def normalize_controls_ratio(spark, sf_dir):
    return normalization.normalize_to_controls_ratio(views.measurements(spark, sf_dir), "value", "event_type", "click").select("event_id", "value_normalized")


@query(f"WITH {EVENTS_SQL}, b AS (SELECT median(value) AS b FROM ev WHERE event_type = 'click') SELECT event_id, {r('100 * value / b AS value_percent_control')} FROM ev, b")
def percent_control(spark, sf_dir):
    return normalization.percent_control(views.measurements(spark, sf_dir), "value", "event_type", "click").select("event_id", "value_percent_control")


@query(f"WITH {EVENTS_SQL}, {_REF.format(v='value', t='ev', c=chr(39).join(['event_type = ', 'click', '']))} SELECT event_id, {r('(value - m) / CASE WHEN d > 0 THEN 1.4826 * d WHEN s > 0 THEN s ELSE 1 END AS value_robust_z')} FROM ev, m, d")
def normalize_controls_robust(spark, sf_dir):
    return normalization.normalize_to_controls_robust(views.measurements(spark, sf_dir), "value", group_column="event_type", control_value="click").select("event_id", "value_robust_z")


_AB = "ab AS (SELECT count(*) FILTER (quantity <= 5) AS na, count(*) FILTER (quantity >= 46) AS nb, avg(quantity) FILTER (quantity <= 5) AS ma, avg(quantity) FILTER (quantity >= 46) AS mb, var_samp(quantity) FILTER (quantity <= 5) AS va, var_samp(quantity) FILTER (quantity >= 46) AS vb FROM wells)"


@query(f"WITH {WELLS_SQL}, {_AB} SELECT {r('1 - 3 * (sqrt(va) + sqrt(vb)) / abs(mb - ma) AS z_prime')} FROM ab")
def z_prime(spark, sf_dir):
    return normalization.z_prime(views.wells(spark, sf_dir), "quantity", F.expr("quantity <= 5"), F.expr("quantity >= 46"))


@query(f"WITH {WELLS_SQL}, {_AB} SELECT {r('(mb - ma) / sqrt((va + vb) / 2) AS ssmd')} FROM ab")
def ssmd(spark, sf_dir):
    return normalization.ssmd(views.wells(spark, sf_dir), "quantity", F.expr("quantity <= 5"), F.expr("quantity >= 46"))


@query(f"WITH {WELLS_SQL}, {_AB} SELECT na AS n_a, nb AS n_b, {r('ma AS mean_a', 'mb AS mean_b', '(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS effect_size')} FROM ab")
def cohens_d(spark, sf_dir):
    return normalization.effect_size(views.wells(spark, sf_dir), "quantity", F.expr("quantity <= 5"), F.expr("quantity >= 46"))


@query(
    f"""WITH {WELLS_SQL}, {_AB}, z AS (SELECT 1 - 3 * (sqrt(va) + sqrt(vb)) / abs(mb - ma) AS z FROM ab) SELECT {r('z AS z_prime')}, CASE WHEN z >= 0.5 THEN 'PASS' WHEN z >= 0 THEN 'MARGINAL' ELSE 'FAIL' END AS status,
    printf('Z-prime %.4f: excellent >= %.2f, marginal >= %.2f', z, 0.5::DOUBLE, 0::DOUBLE) AS reason, 0.5::DOUBLE AS excellent_threshold, 0::DOUBLE AS marginal_threshold FROM z"""
)
def assay_decision(spark, sf_dir):
    return normalization.assay_qc_decision(z_prime(spark, sf_dir))


@query(f"WITH {WELLS_SQL}, m AS (SELECT well_row, median(quantity) AS m, count(*) AS n FROM wells GROUP BY 1), d AS (SELECT well_row, median(abs(quantity - m)) AS d FROM wells JOIN m USING (well_row) GROUP BY 1) SELECT well_row, n, {r('m AS median', 'd AS mad', '1.4826 * d / abs(m) AS robust_cv')} FROM m JOIN d USING (well_row)")
def plate_uniformity(spark, sf_dir):
    return normalization.plate_uniformity(views.wells(spark, sf_dir), "quantity", keys=["well_row"])


_MEANS = "w AS (SELECT well_row, well_col, avg(signal) AS value FROM wells GROUP BY 1, 2)"


@query(
    f"""WITH {WELLS_SQL}, {_MEANS}, x AS (SELECT well_row, well_col, value - median(value) OVER (PARTITION BY well_row) - median(value) OVER (PARTITION BY well_col) + median(value) OVER () AS x FROM w),
    s AS (SELECT 1.4826 * median(abs(x)) AS a, stddev_pop(x) AS b FROM x) SELECT well_row, well_col, {r('x / CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE 1 END AS value_b_score')} FROM x, s"""
)
def b_score(spark, sf_dir):
    means = views.wells(spark, sf_dir).groupBy("well_row", "well_col").agg(F.avg("signal").alias("value"))
    return normalization.b_score(means, "value", row="well_row", column="well_col").select("well_row", "well_col", "value_b_score")


@query(
    f"""WITH {WELLS_SQL}, e AS (SELECT quantity, well_row IN ('A', 'H') OR well_col IN (1, 12) AS edge FROM wells), a AS (SELECT count(*) FILTER (edge) AS edge_n, count(*) FILTER (NOT edge) AS interior_n, median(quantity) FILTER (edge) AS em, median(quantity) FILTER (NOT edge) AS im FROM e),
    d AS (SELECT median(abs(quantity - im)) AS d, stddev_samp(quantity) AS s FROM e, a WHERE NOT edge) SELECT edge_n, interior_n, {r('em AS edge_median', 'im AS interior_median', 'em - im AS difference', '(em - im) / CASE WHEN d > 0 THEN 1.4826 * d WHEN s > 0 THEN s ELSE 1 END AS robust_effect')} FROM a, d"""
)
def edge_effect_robust(spark, sf_dir):
    return normalization.plate_edge_effect_robust(views.wells(spark, sf_dir), "quantity")


@query(f"WITH {WELLS_SQL}, e AS (SELECT signal, substr(well, 1, 1) IN ('A', 'H') OR CAST(substr(well, 2) AS INT) IN (1, 12) AS edge FROM wells), a AS (SELECT median(signal) FILTER (edge) AS em, median(signal) FILTER (NOT edge) AS im FROM e) SELECT {r('em AS edge_median', 'im AS interior_median', 'em / im AS edge_interior_ratio')} FROM a")
def edge_effect_ratio(spark, sf_dir):
    return normalization.plate_edge_effect_ratio(views.wells(spark, sf_dir), "signal")


@query(
    f"""WITH {WELLS_SQL}, u AS (SELECT 'quantity' AS metric, condition, quantity AS value FROM wells UNION ALL SELECT 'signal', condition, signal FROM wells),
    m AS (SELECT metric, median(value) AS cm, stddev_samp(value) AS cs FROM u WHERE condition = 'A' GROUP BY 1), d AS (SELECT metric, any_value(cm) AS cm, CASE WHEN median(abs(value - cm)) > 0 THEN 1.4826 * median(abs(value - cm)) WHEN any_value(cs) > 0 THEN any_value(cs) ELSE 1 END AS sd FROM u JOIN m USING (metric) WHERE condition = 'A' GROUP BY 1)
    SELECT metric, count(value) AS n, {r('avg(value) AS mean', 'median(value) AS median', 'stddev_samp(value) AS std', 'any_value(sd) AS control_robust_sd', 'avg(CASE WHEN abs(value - cm) > 3 * sd THEN 1.0 ELSE 0.0 END) AS outlier_fraction', digits=4)} FROM u JOIN d USING (metric) GROUP BY 1""",
    digits=4,
)
def plate_qc_summary(spark, sf_dir):
    return normalization.plate_qc_summary(views.wells(spark, sf_dir), ["quantity", "signal"], control_column="condition", control_value="A")


# -- groups and replicates ---------------------------------------------------------------------------------------------

_NAMES = "n AS (SELECT c_custkey, 'Plate' || c_nationkey || '_' || chr(65 + CAST(c_custkey % 8 AS INT)) || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '_t' || c_custkey % 10 || '.png' AS filename FROM customer)"


@query(
    rf"""WITH {_NAMES} SELECT c_custkey, regexp_extract(filename, 'Plate([0-9]+)', 1) AS plate, regexp_extract(filename, '_([A-H][0-9][0-9])_', 1) AS well, regexp_extract(filename, '_([A-H])[0-9][0-9]_', 1) AS well_row,
    CAST(regexp_extract(filename, '_[A-H]([0-9][0-9])_', 1) AS INT) AS well_col, CAST(regexp_extract(filename, '_t([0-9]+)', 1) AS INT) AS timepoint FROM n"""
)
def parse_metadata(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    well = F.concat(F.expr("chr(65 + CAST(c_custkey % 8 AS INT))"), F.lpad((1 + F.col("c_custkey") % 12).cast("string"), 2, "0"))
    name = F.concat(F.lit("Plate"), F.col("c_nationkey").cast("string"), F.lit("_"), well, F.lit("_t"), (F.col("c_custkey") % 10).cast("string"), F.lit(".png"))
    return groups.parse_metadata(c.select("c_custkey", name.alias("filename"))).drop("filename")


def _stats(column: str, prefix: str) -> str:
    return f"count({column}) AS {prefix}count, " + r(f"avg({column}) AS {prefix}mean", f"median({column}) AS {prefix}median", f"stddev_samp({column}) AS {prefix}std", digits=4)


@query(f"WITH {WELLS_SQL} SELECT condition, well_row, {_stats('signal', 'signal_')}, {_stats('quantity', 'quantity_')} FROM wells GROUP BY 1, 2", digits=4)
def summarize_groups(spark, sf_dir):
    return groups.summarize_groups(views.wells(spark, sf_dir), ["condition", "well_row"], ["signal", "quantity"])


@query(f"""WITH {WELLS_SQL} SELECT condition AS "group", count(signal) AS n, {r('avg(signal) AS mean', 'median(signal) AS median', 'coalesce(stddev_samp(signal), 0) AS std', digits=4)} FROM wells GROUP BY 1""", digits=4)
def compare_groups(spark, sf_dir):
    return groups.compare_groups(views.wells(spark, sf_dir), "condition", "signal")


@query(f"WITH {WELLS_SQL} SELECT well_row, " + r(*[f"avg(quantity) FILTER (well_col = {c}) AS c{c}" for c in range(1, 13)]) + " FROM wells GROUP BY 1")
def plate_heatmap(spark, sf_dir):
    return groups.plate_heatmap(views.wells(spark, sf_dir), "quantity")


@query(f"WITH {WELLS_SQL} SELECT condition, replicate, {_stats('signal', 'signal_')} FROM wells GROUP BY 1, 2", digits=4)
def summarize_by_replicate(spark, sf_dir):
    return groups.summarize_by_replicate(views.wells(spark, sf_dir), "replicate", ["signal"], ["condition"])


@query(
    f"""WITH {WELLS_SQL}, q AS (SELECT condition, replicate, avg(signal) AS signal FROM wells GROUP BY 1, 2) SELECT condition, count(DISTINCT replicate) AS n_replicates,
    {r('avg(signal) AS signal_mean', 'median(signal) AS signal_median', 'coalesce(stddev_samp(signal), 0) AS signal_std', 'CASE WHEN count(signal) > 1 THEN stddev_samp(signal) / sqrt(count(signal)) END AS signal_sem', digits=4)} FROM q GROUP BY 1""",
    digits=4,
)
def group_summary(spark, sf_dir):
    means = views.wells(spark, sf_dir).groupBy("condition", "replicate").agg(F.avg("signal").alias("signal"))
    return groups.group_summary(means, "replicate", ["signal"], "condition")


@query(
    f"""WITH p AS (SELECT p_partkey, p_retailprice % 100 / 100 AS p FROM part WHERE p_partkey % 1 = 0), k AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS rank, count(*) OVER () AS n FROM p)
    SELECT p_partkey, {r('least(1.0, min(p * n / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q')} FROM k"""
)
def benjamini_hochberg(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 100 / 100).alias("p"))
    return groups.benjamini_hochberg(p).select("p_partkey", "q")


@query(f"WITH {EVENTS_SQL} SELECT event_type, count(value) AS n, {r('avg(value) AS mean', 'stddev_samp(value) AS std', 'stddev_samp(value) / avg(value) AS cv', 'max(value) - min(value) AS range')}, CASE WHEN stddev_samp(value) / avg(value) <= 0.05 THEN 'HIGH' WHEN stddev_samp(value) / avg(value) <= 0.15 THEN 'MODERATE' ELSE 'LOW' END AS stability FROM ev GROUP BY 1")
def sensitivity_summary(spark, sf_dir):
    return groups.summarize_sensitivity(views.measurements(spark, sf_dir), value="value", keys=["event_type"])


@query(f"WITH {EVENTS_SQL}, m AS (SELECT event_type, median(value) AS m FROM ev GROUP BY 1) SELECT event_id, {r('value AS value')} FROM ev JOIN m USING (event_type) WHERE abs(value - m) / greatest(abs(m), 1e-12) <= 0.1")
def stable_subset(spark, sf_dir):
    return groups.stable_parameter_subset(views.measurements(spark, sf_dir), value="value", keys=["event_type"]).select("event_id", "value")


_RULES = [groups.Rule("value", 50.0, ">=", 2.0, "bright"), groups.Rule("k", 50.0, "<=", 1.0, "small")]
_SCORED = f"{EVENTS_SQL}, s AS (SELECT event_id, event_type, CASE WHEN value >= 50 THEN 2.0 ELSE 0.0 END + CASE WHEN k <= 50 THEN 1.0 ELSE 0.0 END AS score, value >= 50 AS a, k <= 50 AS b FROM ev)"


@query(f"WITH {_SCORED} SELECT event_id, {r('CAST(score AS DOUBLE) AS phenotype_score', 'CAST(score AS DOUBLE) / 3 AS phenotype_score_fraction')}, CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS phenotype_label, concat_ws('; ', CASE WHEN a THEN 'bright' END, CASE WHEN b THEN 'small' END) AS phenotype_reasons FROM s")
def score_cells(spark, sf_dir):
    out = groups.score_cells(views.measurements(spark, sf_dir), _RULES)
    return out.select("event_id", "phenotype_score", "phenotype_score_fraction", "phenotype_label", "phenotype_reasons")


@query(f"WITH {EVENTS_SQL} SELECT event_id, CAST(20 AS DOUBLE) AS marker_threshold, value >= 20 AS marker_positive, CASE WHEN value >= 20 THEN 'positive' ELSE 'negative' END AS marker_label FROM ev")
def marker_positivity(spark, sf_dir):
    return groups.marker_positivity(views.measurements(spark, sf_dir), "value", 20).select("event_id", "marker_threshold", "marker_positive", "marker_label")


@query(f"WITH {_SCORED} SELECT event_type, count(*) AS cell_count, {r('avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS positive_fraction', 'avg(CAST(score AS DOUBLE)) AS mean_score', 'median(CAST(score AS DOUBLE)) AS median_score')} FROM s GROUP BY 1")
def phenotype_summary(spark, sf_dir):
    return groups.group_phenotype_summary(groups.score_cells(views.measurements(spark, sf_dir), _RULES), "event_type")


# -- gates, manifests, reports -----------------------------------------------------------------------------------------


def _reasons(given: dict[str, str], none: str) -> str:
    """SQL of the reasons whose conditions hold."""
    text = ", ".join(f"CASE WHEN {condition} THEN '{reason}' END" for reason, condition in given.items())
    return f"coalesce(nullif(concat_ws('; ', {text}), ''), '{none}')"


_A = gates.ACCEPTANCE_REASONS
_QUALITY = "CASE WHEN n_chars % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN n_chars % 53 = 0 THEN NULL ELSE CAST(n_chars % 101 AS DOUBLE) END"
_FAILED = {_A["quality"]: "NOT bad AND quality < 70", _A["border"]: "NOT bad AND border > 0.35", _A["tiny"]: "NOT bad AND tiny > 0.5", _A["merged"]: "NOT bad AND merged > 0.25", _A["agreement"]: "NOT bad AND agreement < 0.6", _A["invalid"]: "bad"}


@query(
    f"""WITH q AS (SELECT doc_id, {_QUALITY} AS quality, n_chars % 10 / 10.0::DOUBLE AS border, n_chars % 7 / 7.0::DOUBLE AS tiny, n_chars % 3 / 3.0::DOUBLE AS merged, n_chars % 9 / 9.0::DOUBLE AS agreement FROM documents),
    b AS (SELECT *, quality IS NULL OR isnan(quality) AS bad FROM q),
    f AS (SELECT *, CAST(quality < 70 AS INT) + CAST(border > 0.35 AS INT) + CAST(tiny > 0.5 AS INT) + CAST(merged > 0.25 AS INT) + CAST(agreement < 0.6 AS INT) AS failed FROM b)
    SELECT doc_id, CASE WHEN bad OR quality < 70 OR failed >= 3 THEN 'FAIL' WHEN failed > 0 THEN 'REVIEW' ELSE 'PASS' END AS acceptance_status,
      CASE WHEN bad THEN 0 ELSE {r('greatest(0.0, least(100.0, quality - 10 * failed)) AS s').removesuffix(' AS s')} END AS acceptance_score, {_reasons(_FAILED, _A['none'])} AS acceptance_reasons FROM f"""
)
def segmentation_acceptance(spark, sf_dir):
    n = F.col("n_chars")
    rows = views.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_QUALITY).alias("quality_score"), (n % 10 / 10).alias("border_fraction"), (n % 7 / 7).alias("tiny_object_fraction"), (n % 3 / 3).alias("merged_object_fraction"), (n % 9 / 9).alias("agreement_fraction")
    )
    return gates.segmentation_acceptance(rows, on_invalid="fail").select("doc_id", "acceptance_status", "acceptance_score", "acceptance_reasons")


_G = gates.GATE_REASONS
_STATES = {_G["invalid"]: "bad", _G["artifact FAIL"]: "sa = 'FAIL'", _G["artifact REVIEW"]: "sa = 'REVIEW'", _G["segmentation FAIL"]: "sb = 'FAIL'", _G["segmentation REVIEW"]: "sb = 'REVIEW'"}
_SCORES = "CASE WHEN n_chars % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN n_chars % 53 = 0 THEN NULL ELSE CAST(n_chars % 103 AS DOUBLE) END AS a, CAST(n_chars % 97 AS DOUBLE) AS b, CASE n_chars % 11 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'PASS' END AS sa, CASE n_chars % 13 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END AS sb"


@query(
    f"""WITH q AS (SELECT doc_id, {_SCORES} FROM documents), g AS (SELECT *, a IS NULL OR isnan(a) OR a > 100 AS bad, least(a, b) AS s FROM q)
    SELECT doc_id, CASE WHEN NOT bad THEN s END AS gate_score, CASE WHEN bad OR sa = 'FAIL' OR sb = 'FAIL' OR s < 70 THEN 'FAIL' WHEN sa = 'REVIEW' OR sb = 'REVIEW' OR s < 85 THEN 'REVIEW' ELSE 'PASS' END AS gate_status, {_reasons(_STATES, _G['none'])} AS gate_reasons FROM g"""
)
def quality_gate(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").selectExpr("doc_id", *_SCORES.replace(", CAST(", "|CAST(").replace(", CASE n", "|CASE n").split("|"))
    return gates.experiment_quality_gate(d, "a", "b", artifact_status="sa", segmentation_status="sb", on_invalid="fail").select("doc_id", "gate_score", "gate_status", "gate_reasons")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def input_hashes(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS key, a.h AS reference_value, b.h AS candidate_value, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h"""
)
def manifest_diff(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    other = d.where("doc_id % 5 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("h")))
    return gates.manifest_diff(d.where("doc_id % 3 <> 0"), other, "doc_id", "h")


@query(
    f"WITH u AS (SELECT 'l_quantity' AS \"column\", l_quantity AS value FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) SELECT \"column\", count(*) AS rows, count(value) AS count, {r('avg(value) AS mean', 'median(value) AS median', 'stddev_samp(value) AS std', 'min(value) AS min', 'max(value) AS max')}, 11 AS columns FROM u GROUP BY 1"
)
def dataframe_summary(spark, sf_dir):
    return reporting.dataframe_summary(views.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])


@query(f"SELECT s_suppkey, feature, {r('value AS value')} FROM (SELECT s_suppkey, 's_acctbal' AS feature, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey FROM supplier)")
def long_form(spark, sf_dir):
    return reporting.long_form(views.table(spark, sf_dir, "supplier").drop("s_name"), ["s_suppkey"])


# -- tracks ------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {TRACKS_SQL}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, frame - lag(frame) OVER w AS gap FROM tr WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    g AS (SELECT track_id, count(*) AS n_frames, min(frame) AS start_frame, max(frame) AS end_frame, coalesce(sum(step), 0) AS path, coalesce(avg(step), 0) AS mean_step, coalesce(max(step), 0) AS max_step, coalesce(max(gap) - 1, 0) AS max_gap,
      sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) AS net FROM s GROUP BY 1)
    SELECT track_id, n_frames, start_frame, end_frame, max_gap, {r('path AS path_length', 'net AS net_displacement', 'mean_step AS mean_step', 'max_step AS max_step', 'CASE WHEN path <> 0 THEN net / path ELSE 0 END AS straightness')} FROM g"""
)
def summarize_tracks(spark, sf_dir):
    out = tracks.summarize_tracks(views.tracks(spark, sf_dir))
    return out.select("track_id", "n_frames", "start_frame", "end_frame", "max_gap", "path_length", "net_displacement", "mean_step", "max_step", "straightness")


@query(f"WITH {TRACKS_SQL}, j AS (SELECT track_id, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS j FROM tr) SELECT count(DISTINCT track_id) AS track_count, count(j) AS transition_count, count(*) FILTER (j > 1) AS gap_count, CAST(sum(j - 1) AS BIGINT) AS missing_frames, {r('count(*) FILTER (j > 1) / count(j) AS gap_rate')} FROM j")
def track_gap_rate(spark, sf_dir):
    return tracks.track_gap_rate(views.tracks(spark, sf_dir))


@query(f"WITH {TRACKS_SQL}, o AS (SELECT label, count(DISTINCT track_id) AS n FROM tr GROUP BY 1) SELECT count(*) AS object_count, count(*) FILTER (n > 1) AS fragmented_objects, {r('count(*) FILTER (n > 1) / count(*) AS fragmentation_rate')} FROM o")
def track_fragmentation(spark, sf_dir):
    return tracks.track_fragmentation(views.tracks(spark, sf_dir), object_column="label")


@query(f"WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), b AS (SELECT quality, max(n) AS best, sum(n) AS n FROM c GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, {r('sum(best) / sum(n) AS purity')} FROM b")
def track_purity(spark, sf_dir):
    return tracks.track_purity(views.table(spark, sf_dir, "labels"), reference="toxic", predicted="quality")


@query(f"WITH {TRACKS_SQL}, o AS (SELECT track_id, count(*) AS n, max(frame) - min(frame) + 1 AS span FROM tr GROUP BY 1) SELECT count(*) AS track_count, CAST(sum(n) AS BIGINT) AS observation_count, count(*) FILTER (n < span) AS fragmented_tracks, {r('avg(n) AS mean_track_length', 'sum(n) / sum(span) AS completeness')} FROM o")
def lineage_quality(spark, sf_dir):
    return tracks.lineage_quality_summary(views.tracks(spark, sf_dir))


_KINDS = "CASE event_id % 4 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' WHEN 2 THEN 'appearance' ELSE 'disappearance' END"


def _kinds(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.expr(_KINDS).alias("event"), (F.col("event_id") % 3 + 1).cast("int").alias("degree"))


@query(f"WITH e AS (SELECT {_KINDS} AS event FROM events) SELECT count(*) AS event_count, " + ", ".join(f"count(*) FILTER (event = '{k}') AS {k}_count" for k in ("split", "merge", "appearance", "disappearance")) + f", {r('count(*) / 29 AS events_per_transition')} FROM e")
def event_summary(spark, sf_dir):
    return tracks.lineage_event_summary(_kinds(spark, sf_dir), n_frames=30)


@query(f"WITH e AS (SELECT {_KINDS} AS event, event_id % 3 + 1 AS degree FROM events) SELECT count(*) FILTER (event = 'split') AS split_count, count(*) FILTER (event = 'split' AND degree >= 2) AS consistent_count, {r(chr(39).join(['count(*) FILTER (event = ', 'split', ' AND degree >= 2) / count(*) FILTER (event = ', 'split', ') AS consistency_rate']))} FROM e")
def division_consistency(spark, sf_dir):
    return tracks.division_consistency(_kinds(spark, sf_dir))


_NODES = f"{TRACKS_SQL}, nodes AS (SELECT CAST(track_id AS BIGINT) AS track_id, frame, CAST(track_id AS INT) AS label FROM tr)"


@query(
    f"""WITH {_NODES}, s AS (SELECT frame, label AS parent_label, unnest([label + 1, label + 2]) AS label FROM (SELECT frame + 1 AS frame, label FROM nodes WHERE label % 5 = 0)), p AS (SELECT s.frame, s.label, n.track_id AS parent_track_id FROM s JOIN nodes n ON n.frame + 1 = s.frame AND n.label = s.parent_label)
    SELECT track_id, frame, label, parent_track_id, CASE WHEN parent_track_id IS NULL THEN 'observation' ELSE 'division_child' END AS relationship FROM nodes LEFT JOIN p USING (frame, label)"""
)
def lineage_table(spark, sf_dir):
    nodes = views.tracks(spark, sf_dir).select("track_id", "frame", F.col("track_id").cast("int").alias("label"))
    splits = nodes.where("label % 5 = 0").select((F.col("frame") + 1).alias("frame"), F.lit("split").alias("event"), F.col("label").alias("parent_label"), F.array(F.col("label") + 1, F.col("label") + 2).alias("child_labels"))
    return tracks.lineage_table(nodes, splits)


# -- pixels ------------------------------------------------------------------------------------------------------------


@query(f"WITH {PIXELS_SQL} SELECT image_id, {r('avg(v) AS brightness_mean', 'stddev_pop(v) AS brightness_std')} FROM px GROUP BY 1")
def brightness(spark, sf_dir):
    return pixels.brightness(views.pixels(spark, sf_dir), ["image_id"])


@query(f"WITH {PIXELS_SQL} SELECT image_id, {r('avg(CASE WHEN v <= 90 OR v >= 110 THEN 1.0 ELSE 0.0 END) AS saturation_fraction')} FROM px GROUP BY 1")
def saturation(spark, sf_dir):
    return pixels.saturation_fraction(views.pixels(spark, sf_dir), ["image_id"], 90, 110)


@query(
    f"""WITH {PIXELS_SQL}, l AS (SELECT image_id, v, coalesce(lag(v) OVER h, lead(v) OVER h) + coalesce(lead(v) OVER h, lag(v) OVER h) AS hs, coalesce(lag(v) OVER u, lead(v) OVER u) + coalesce(lead(v) OVER u, lag(v) OVER u) AS us FROM px
    WINDOW h AS (PARTITION BY image_id, y ORDER BY x), u AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, {r('var_pop(hs + us - 4 * v) AS focus_score')} FROM l GROUP BY 1"""
)
def focus_score(spark, sf_dir):
    return pixels.focus_score(views.pixels(spark, sf_dir), ["image_id"])


@query(f"WITH {PIXELS_SQL} SELECT image_id, {r('avg(v) AS mean', 'stddev_pop(v) AS std', 'min(v) AS min', 'max(v) AS max', 'quantile_cont(v, 0.01) AS p01', 'quantile_cont(v, 0.99) AS p99', 'avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END) AS low_saturation', 'avg(CASE WHEN v >= 120 THEN 1.0 ELSE 0.0 END) AS high_saturation', digits=5)} FROM px GROUP BY 1", digits=5)
def channel_summary(spark, sf_dir):
    return pixels.channel_summary(views.pixels(spark, sf_dir), ["image_id"], high=120.0)


_NEXT = "two AS (SELECT a.image_id, a.y, a.x, a.v AS a, b.v AS b FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x)"


def _two(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    other = px.select((F.col("image_id") - 1).alias("image_id"), "y", "x", F.col("v").alias("b"))
    return px.withColumnRenamed("v", "a").join(other, ["image_id", "y", "x"])


@query(f"WITH {PIXELS_SQL}, {_NEXT} SELECT image_id, {r('(avg(a * b) - avg(a) * avg(b)) / (stddev_pop(a) * stddev_pop(b)) AS colocalization', digits=5)} FROM two GROUP BY 1", digits=5)
def colocalization(spark, sf_dir):
    return pixels.colocalization(_two(spark, sf_dir), F.col("a"), F.col("b"), ["image_id"])


@query(f"WITH {PIXELS_SQL}, {_NEXT} SELECT image_id, {r('CASE WHEN count(*) FILTER (a > 105) > 0 THEN count(*) FILTER (a > 105 AND b > 105) / count(*) FILTER (a > 105) ELSE 0 END AS colocated_fraction')} FROM two GROUP BY 1")
def colocated_fraction(spark, sf_dir):
    return pixels.colocated_fraction(_two(spark, sf_dir), F.col("a") > 105, F.col("b") > 105, ["image_id"])


@query(
    f"""WITH {PIXELS_SQL}, g AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), n AS (SELECT image_id, v, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS n FROM px JOIN g USING (image_id)),
    a AS (SELECT image_id, {r('avg(CASE WHEN n <= 0.001 THEN 1.0 ELSE 0.0 END) AS low_clip_fraction', 'avg(CASE WHEN n >= 0.999 THEN 1.0 ELSE 0.0 END) AS high_clip_fraction', 'avg(CASE WHEN n >= 0.9995 THEN 1.0 ELSE 0.0 END) AS hot_pixel_fraction', 'stddev_pop(v) / avg(abs(v)) AS global_coefficient_of_variation', 'quantile_cont(v, 0.01) AS background_percentile_1', 'quantile_cont(v, 0.05) AS background_percentile_5', digits=5)} FROM n GROUP BY 1),
    hx AS (SELECT image_id, m, m - lag(m) OVER (PARTITION BY image_id ORDER BY x) AS d FROM (SELECT image_id, x, avg(v) AS m FROM px GROUP BY 1, 2)), hy AS (SELECT image_id, m, m - lag(m) OVER (PARTITION BY image_id ORDER BY y) AS d FROM (SELECT image_id, y, avg(v) AS m FROM px GROUP BY 1, 2)),
    h AS (SELECT image_id, {r('stddev_pop(d) / avg(abs(m)) AS horizontal_gradient_cv', digits=5)} FROM hx GROUP BY 1), v AS (SELECT image_id, {r('stddev_pop(d) / avg(abs(m)) AS vertical_gradient_cv', digits=5)} FROM hy GROUP BY 1)
    SELECT * FROM a JOIN h USING (image_id) JOIN v USING (image_id)""",
    digits=5,
)
def artifact_metrics(spark, sf_dir):
    return pixels.artifact_metrics(views.pixels(spark, sf_dir), ["image_id"])


@query(
    f"""WITH {PIXELS_SQL}, b AS (SELECT image_id, least(255, floor(v * 256 / 255)) AS b, count(*) AS k FROM px WHERE v BETWEEN 0 AND 255 GROUP BY 1, 2), d AS (SELECT image_id, k / sum(k) OVER (PARTITION BY image_id) / (255.0::DOUBLE / 256) AS d FROM b)
    SELECT image_id, {r('-sum(d * log2(d)) AS entropy')} FROM d GROUP BY 1"""
)
def texture_entropy(spark, sf_dir):
    return pixels.texture_features(views.pixels(spark, sf_dir), ["image_id"]).select("image_id", "entropy")


@query(f"WITH {PIXELS_SQL}, m AS (SELECT image_id, median(v) AS m FROM px GROUP BY 1), d AS (SELECT image_id, any_value(m) AS m, median(abs(v - m)) AS d FROM px JOIN m USING (image_id) GROUP BY 1) SELECT image_id, count(*) FILTER (d > 0 AND v > m + 3 * 1.4826 * d) AS hot_pixels FROM px JOIN d USING (image_id) GROUP BY 1")
def hot_pixels(spark, sf_dir):
    return pixels.detect_hot_pixels(views.pixels(spark, sf_dir), ["image_id"], 3.0).groupBy("image_id").agg(F.count_if("hot").alias("hot_pixels"))


_LABELLED = "lp AS (SELECT *, CAST(CASE WHEN v > 108 THEN 1 + y // 4 * 2 + x // 4 ELSE 0 END AS INT) AS label FROM px)"


def _labelled(spark, sf_dir):
    return views.pixels(spark, sf_dir).withColumn("label", F.when(F.col("v") > 108, F.expr("1 + y DIV 4 * 2 + x DIV 4")).otherwise(0).cast("int"))


@query(
    f"""WITH {PIXELS_SQL}, {_LABELLED} SELECT image_id, label, count(*) AS area, min(x) AS bbox_x, min(y) AS bbox_y, max(x) - min(x) + 1 AS bbox_width, max(y) - min(y) + 1 AS bbox_height,
    {r('avg(x) AS centroid_x', 'avg(y) AS centroid_y', 'avg(v) AS mean_intensity', 'stddev_pop(v) AS std_intensity', 'max(v) AS max_intensity', '(max(x) - min(x) + 1) / (max(y) - min(y) + 1) AS aspect_ratio', digits=5)} FROM lp WHERE label > 0 GROUP BY 1, 2""",
    digits=5,
)
def object_features(spark, sf_dir):
    return pixels.object_features(_labelled(spark, sf_dir), ["image_id"])


@query(f"WITH {PIXELS_SQL}, {_LABELLED} SELECT image_id, label, CAST(y % 2 AS INT) AS c, {r('avg(v) AS mean_intensity', 'median(v) AS median_intensity', 'stddev_pop(v) AS std_intensity', 'max(v) AS max_intensity', 'sum(v) AS sum_intensity', digits=5)} FROM lp WHERE label > 0 GROUP BY 1, 2, 3", digits=5)
def object_intensity(spark, sf_dir):
    return pixels.object_channel_intensity(_labelled(spark, sf_dir).withColumn("c", (F.col("y") % 2).cast("int")), ["image_id"])


_CENTRES = f"{PIXELS_SQL}, {_LABELLED}, o AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy FROM lp WHERE label > 0 GROUP BY 1, 2)"


@query(f"WITH {_CENTRES} SELECT a.image_id, a.label, {r('min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS nearest_neighbor_distance')} FROM o a LEFT JOIN o b ON a.image_id = b.image_id AND a.label <> b.label GROUP BY 1, 2")
def nn_2d(spark, sf_dir):
    objects = pixels.object_features(_labelled(spark, sf_dir), ["image_id"])
    return pixels.nearest_neighbors(objects, ["image_id"]).select("image_id", "label", "nearest_neighbor_distance")


_VOXELS = "vx AS (SELECT image_id, CAST(pos // 16 AS INT) AS z, CAST(pos % 16 // 4 AS INT) AS y, CAST(pos % 4 AS INT) AS x, CAST(CASE WHEN e > 0.05 THEN 1 WHEN e < -0.05 THEN 2 ELSE 0 END AS INT) AS label FROM (SELECT vec_id AS image_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"


def _voxels(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    label = F.when(F.col("e") > 0.05, 1).when(F.col("e") < -0.05, 2).otherwise(0)
    return e.select("image_id", F.expr("CAST(pos DIV 16 AS INT)").alias("z"), F.expr("CAST(pos % 16 DIV 4 AS INT)").alias("y"), (F.col("pos") % 4).alias("x"), label.cast("int").alias("label"))


_FACE = "(SELECT count(*) FROM vx n WHERE n.image_id = v.image_id AND n.label = v.label AND abs(n.z - v.z) + abs(n.y - v.y) + abs(n.x - v.x) = 1 AND n.{a} <> v.{a})"


@query(
    f"""WITH {_VOXELS}, f AS (SELECT v.*, 2 - {_FACE.format(a='z')} AS fz, 2 - {_FACE.format(a='y')} AS fy, 2 - {_FACE.format(a='x')} AS fx FROM vx v WHERE label > 0)
    SELECT image_id, label, count(*) AS voxel_count, {r('count(*) * 1.0::DOUBLE AS volume', 'avg(z) AS centroid_z', 'avg(y) AS centroid_y', 'avg(x) AS centroid_x', '(sum(fz) * 0.5 + sum(fy) * 1.0 + sum(fx) * 2.0)::DOUBLE AS surface_area')}, min(z) AS z_min, max(z) AS z_max FROM f GROUP BY 1, 2"""
)
def volume_features(spark, sf_dir):
    out = pixels.volume_features(_voxels(spark, sf_dir), ["image_id"], voxel=(2.0, 1.0, 0.5))
    return out.select("image_id", "label", "voxel_count", "volume", "centroid_z", "centroid_y", "centroid_x", "surface_area", "z_min", "z_max")


@query(f"WITH {PIXELS_SQL}, c AS (SELECT image_id, count(*) FILTER (v > 112 AND v > 110) AS tp, count(*) FILTER (v > 112) AS p, count(*) FILTER (v > 110) AS t FROM px GROUP BY 1) SELECT image_id, {r('CASE WHEN p + t - tp > 0 THEN tp / (p + t - tp) ELSE 1 END AS iou', 'CASE WHEN p + t > 0 THEN 2 * tp / (p + t) ELSE 1 END AS dice', 'CASE WHEN p > 0 THEN tp / p ELSE 1 END AS precision', 'CASE WHEN t > 0 THEN tp / t ELSE 1 END AS recall')} FROM c")
def pixel_metrics(spark, sf_dir):
    return pixels.pixel_metrics(views.pixels(spark, sf_dir), F.col("v") > 112, F.col("v") > 110, ["image_id"])


@query(f"SELECT doc_id, abs(quality - toxic) AS absolute_count_error, {r('CASE WHEN toxic <> 0 THEN abs(quality - toxic) / toxic WHEN quality = 0 THEN 0 ELSE 1e308::DOUBLE * 10 END AS relative_count_error')} FROM labels")
def count_error(spark, sf_dir):
    return pixels.count_error(views.table(spark, sf_dir, "labels"), "quality", "toxic").select("doc_id", "absolute_count_error", "relative_count_error")


_SERIES = f"{PIXELS_SQL}, {_LABELLED}, ser AS (SELECT image_id // 10 AS series, CAST(image_id % 10 AS INT) AS frame, y, x, label FROM lp WHERE label > 0)"


def _series(spark, sf_dir):
    return _labelled(spark, sf_dir).select(F.expr("image_id DIV 10").alias("series"), (F.col("image_id") % 10).cast("int").alias("frame"), "y", "x", "label")


@query(
    f"""WITH {_SERIES}, s AS (SELECT series, frame, label, count(*) AS n FROM ser GROUP BY ALL), p AS (SELECT b.series, b.frame, a.label AS previous, b.label AS current, count(*) AS k FROM ser a JOIN ser b ON a.series = b.series AND a.frame + 1 = b.frame AND a.y = b.y AND a.x = b.x GROUP BY ALL)
    SELECT p.series, p.frame, previous, current, {r('k / o.n AS forward', 'k / c.n AS backward')} FROM p JOIN s o ON o.series = p.series AND o.frame + 1 = p.frame AND o.label = previous JOIN s c ON c.series = p.series AND c.frame = p.frame AND c.label = current WHERE greatest(k / o.n, k / c.n) >= 0.2"""
)
def mask_overlap(spark, sf_dir):
    return tracks.overlap_map(_series(spark, sf_dir), keys=["series"])


_EVENTS = f"""{_SERIES}, s AS (SELECT series, frame, label, count(*) AS n FROM ser GROUP BY ALL),
  p AS (SELECT b.series, b.frame, a.label AS previous, b.label AS current, count(*) AS k FROM ser a JOIN ser b ON a.series = b.series AND a.frame + 1 = b.frame AND a.y = b.y AND a.x = b.x GROUP BY ALL),
  o AS (SELECT p.series, p.frame, previous, current, k / o.n AS forward, k / c.n AS backward FROM p JOIN s o ON o.series = p.series AND o.frame + 1 = p.frame AND o.label = previous JOIN s c ON c.series = p.series AND c.frame = p.frame AND c.label = current),
  kids AS (SELECT series, frame, previous AS parent_label, list_sort(list(current)) AS l FROM o WHERE forward >= 0.2 GROUP BY 1, 2, 3), pars AS (SELECT series, frame, current AS child_label, list_sort(list(previous)) AS l FROM o WHERE backward >= 0.2 GROUP BY 1, 2, 3),
  lim AS (SELECT series, min(frame) AS lo, max(frame) AS hi FROM ser GROUP BY 1)"""


@query(
    f"""WITH {_EVENTS} SELECT series, frame, 'split' AS event, len(l)::INT AS degree, parent_label, array_to_string(l, ',') AS child_labels, NULL AS parent_labels, NULL::INT AS child_label FROM kids WHERE len(l) >= 2
    UNION ALL SELECT series, frame, 'merge', len(l)::INT, NULL, NULL, array_to_string(l, ','), child_label FROM pars WHERE len(l) >= 2
    UNION ALL SELECT s.series, s.frame, 'appearance', 0, NULL, NULL, NULL, label FROM s JOIN lim USING (series) WHERE s.frame > lo AND NOT EXISTS (SELECT 1 FROM pars q WHERE q.series = s.series AND q.frame = s.frame AND q.child_label = s.label)
    UNION ALL SELECT s.series, s.frame + 1, 'disappearance', 0, label, NULL, NULL, NULL FROM s JOIN lim USING (series) WHERE s.frame < hi AND NOT EXISTS (SELECT 1 FROM kids q WHERE q.series = s.series AND q.frame = s.frame + 1 AND q.parent_label = s.label)"""
)
def mask_overlap_events(spark, sf_dir):
    out = tracks.detect_events(_series(spark, sf_dir), keys=["series"])
    return out.withColumn("child_labels", F.array_join(F.col("child_labels").cast("array<string>"), ",")).withColumn("parent_labels", F.array_join(F.col("parent_labels").cast("array<string>"), ","))


@query()
def link_frames(spark, sf_dir):
    return tracking.link_frames(tracking.centroids(_series(spark, sf_dir), ["series"]), "series", config=tracking.TrackingConfig(max_distance=3.0, max_gap=1))


@query()
def link_frames_3d(spark, sf_dir):
    vx = _voxels(spark, sf_dir).select(F.expr("image_id DIV 10").alias("series"), (F.col("image_id") % 10).cast("int").alias("frame"), "z", "y", "x", "label")
    points = tracking.centroids(vx, ["series"], axes=("z", "y", "x"), voxel=(2.0, 1.0, 0.5))
    return tracking.link_frames(points, "series", axes=("z", "y", "x"), config=tracking.TrackingConfig(max_distance=4.0))


@query(
    f"""WITH {PIXELS_SQL}, {_LABELLED}, t AS (SELECT image_id, label, avg(y) AS y, avg(x) AS x FROM lp WHERE label > 0 GROUP BY 1, 2), p AS (SELECT image_id, label, avg(y) AS y, avg(x) AS x FROM lp WHERE label > 0 AND v > 112 GROUP BY 1, 2),
    c AS (SELECT t.image_id, count(*) AS truth, count(p.label) AS predicted, count(*) FILTER (pow(p.y - t.y, 2) + pow(p.x - t.x, 2) <= 0.81) AS tp FROM t LEFT JOIN p USING (image_id, label) GROUP BY 1)
    SELECT image_id, tp, predicted - tp AS fp, truth - tp AS fn, {r('CASE WHEN predicted > 0 THEN tp / predicted ELSE 1 END AS instance_precision', 'tp / truth AS instance_recall', '2 * tp / (predicted + truth) AS instance_f1')}, abs(predicted - truth) AS absolute_count_error FROM c"""
)
def match_instances_close(spark, sf_dir):
    """Objects of different quarters are further apart than the gate, so each can match its own twin alone."""
    px = _labelled(spark, sf_dir).withColumn("frame", F.lit(0))
    truth, pred = (tracking.centroids(x, ["image_id"]) for x in (px, px.where("v > 112")))
    return tracking.match_instances(pred, truth, "image_id", max_distance=0.9)


@query()
def match_instances(spark, sf_dir):
    px = _labelled(spark, sf_dir).withColumn("frame", F.lit(0))
    truth = tracking.centroids(px, ["image_id"])
    pred = tracking.centroids(px.where("v > 112"), ["image_id"])
    return tracking.match_instances(pred, truth, "image_id", max_distance=2.0)


@query(
    f"""WITH {PIXELS_SQL}, h AS (SELECT image_id, CAST(least(255, floor(v / 255 * 256)) AS INT) AS b, count(*)::DOUBLE AS n FROM px WHERE v BETWEEN 0 AND 255 GROUP BY 1, 2), c AS (SELECT *, (b + 0.5::DOUBLE) / 256 AS c FROM h),
    w AS (SELECT *, sum(n) OVER o AS w, sum(n * c) OVER o AS m, sum(n) OVER (PARTITION BY image_id) AS ww, sum(n * c) OVER (PARTITION BY image_id) AS mm FROM c WINDOW o AS (PARTITION BY image_id ORDER BY b ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT image_id, b, c, round(CASE WHEN ww > w THEN w * (ww - w) * pow(m / w - (mm - m) / (ww - w), 2) ELSE 0 END, 9) AS s FROM w)
    SELECT image_id, {r('c AS otsu_threshold')} FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s DESC, b) = 1"""
)
def otsu_threshold(spark, sf_dir):
    return pixels.otsu_threshold(views.pixels(spark, sf_dir).withColumn("v", F.col("v") / 255), ["image_id"])


@query(f"WITH {_VOXELS}, p AS (SELECT image_id, y, x, max(label) AS v FROM vx GROUP BY ALL) SELECT image_id, y, x, {r('CAST(v AS DOUBLE) AS v')} FROM p")
def project_z(spark, sf_dir):
    return pixels.project_z(_voxels(spark, sf_dir).withColumn("v", F.col("label").cast("double")), ["image_id"])


@query(f"WITH {PIXELS_SQL}, f AS (SELECT y, x, avg(v) AS r FROM px GROUP BY ALL), m AS (SELECT avg(r) AS m FROM f) SELECT image_id, y, x, {r('v * m / greatest(r, 0.000001) AS v', digits=4)} FROM px JOIN f USING (y, x), m", digits=4)
def flat_field(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    return pixels.flat_field_correct(px, px.groupBy("y", "x").agg(F.avg("v").alias("r")), ["image_id"]).select("image_id", "y", "x", "v")


_NEAR = "n AS (SELECT a.image_id, a.label, min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS d FROM o a LEFT JOIN o b ON a.image_id = b.image_id AND a.label <> b.label GROUP BY 1, 2)"


@query(f"WITH {_CENTRES}, {_NEAR} SELECT image_id, count(*) AS object_count, {r('count(*) / (64.0::DOUBLE / 100000) AS density_per_100k_px', 'avg(d) AS mean_nn', 'median(d) AS median_nn', 'coalesce(CASE WHEN avg(d) <> 0 THEN stddev_samp(d) / avg(d) END, 0) AS nn_cv', digits=4)} FROM n GROUP BY 1", digits=4)
def spatial_summary(spark, sf_dir):
    objects = pixels.object_features(_labelled(spark, sf_dir), ["image_id"])
    return pixels.summarize_spatial_features(pixels.add_spatial_features(objects, ["image_id"], height=8, width=8), ["image_id"])


@query(f"WITH {_VOXELS}, l AS (SELECT image_id, label, count(*) AS volume FROM vx WHERE label > 0 GROUP BY 1, 2) SELECT image_id, count(*) AS object_count, {r('CAST(sum(volume) AS DOUBLE) AS total_volume', 'avg(volume) AS mean_volume', 'median(volume) AS median_volume', 'sum(volume) / 64 AS volume_fraction', 'count(*) / (64 / 1e9) AS density_per_mm3')} FROM l GROUP BY 1")
def volume_summary(spark, sf_dir):
    return pixels.summarize_volume(pixels.volume_features(_voxels(spark, sf_dir), ["image_id"]), 64, ["image_id"])


@query(f"WITH {_VOXELS}, c AS (SELECT image_id, label, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM vx WHERE label > 0 GROUP BY 1, 2) SELECT a.image_id, a.label, {r('min(sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2))) AS nearest_neighbor_distance')} FROM c a LEFT JOIN c b ON a.image_id = b.image_id AND a.label <> b.label GROUP BY 1, 2")
def nn_3d(spark, sf_dir):
    objects = pixels.volume_features(_voxels(spark, sf_dir), ["image_id"])
    axes = ("centroid_z_um", "centroid_y_um", "centroid_x_um")
    return pixels.nearest_neighbors(objects, ["image_id"], axes=axes).select("image_id", "label", "nearest_neighbor_distance")


@query(
    f"""WITH {PIXELS_SQL}, {_LABELLED} SELECT image_id, label, {r('stddev_pop(v) AS std', 'quantile_cont(v, 0.1) AS p10', 'quantile_cont(v, 0.9) AS p90', digits=4)} FROM lp WHERE label > 0 GROUP BY 1, 2""",
    digits=4,
)
def object_texture(spark, sf_dir):
    return pixels.object_texture_features(_labelled(spark, sf_dir), ["image_id"]).select("image_id", "label", "std", "p10", "p90")


@query(
    f"""WITH {PIXELS_SQL}, c AS (SELECT image_id, y, x, v, CAST(1 + x // 4 AS INT) AS cell, CAST(CASE WHEN y BETWEEN 2 AND 5 AND x % 4 IN (1, 2) THEN 1 + x // 4 ELSE 0 END AS INT) AS nucleus FROM px)
    SELECT image_id, cell, count(*) AS cell_area, count(*) FILTER (nucleus = 0) AS cytoplasm_area, count(*) FILTER (nucleus > 0) AS nucleus_area, 1::BIGINT AS nucleus_count,
    {r('avg(v) AS cell_mean', 'avg(v) FILTER (nucleus = 0) AS cytoplasm_mean', 'avg(v) FILTER (nucleus > 0) AS nucleus_mean', 'count(*) FILTER (nucleus > 0) / count(*) AS nucleus_cell_ratio', 'avg(v) FILTER (nucleus > 0) / avg(v) FILTER (nucleus = 0) AS nucleus_cytoplasm_ratio', digits=7)} FROM c GROUP BY 1, 2""",
    digits=7,
)
def compartment_features(spark, sf_dir):
    cell = F.expr("CAST(1 + x DIV 4 AS INT)")
    px = views.pixels(spark, sf_dir).withColumn("cell", cell).withColumn("nucleus", F.when(F.expr("y BETWEEN 2 AND 5 AND x % 4 IN (1, 2)"), cell).otherwise(0))
    cells, nuclei = (px.select("image_id", "y", "x", F.col(c).alias("label")) for c in ("cell", "nucleus"))
    return pixels.compartment_features(px, pixels.assign_nuclei_to_cells(cells, nuclei, ["image_id"]), ["image_id"])


@query(
    f"""WITH {PIXELS_SQL}, m AS (SELECT image_id, count(*) FILTER (v > 110 AND v > 114) AS b, count(*) FILTER (v > 110) AS p, count(*) FILTER (v > 114) AS q FROM px GROUP BY 1)
    SELECT image_id, {r('CASE WHEN p + q - b > 0 THEN b / (p + q - b) ELSE 1 END AS agreement_fraction')} FROM m"""
)
def ensemble_iou(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    members = [px.select("image_id", F.lit(f"t{t}").alias("member"), F.lit(i).alias("idx"), "y", "x", (F.col("v") > t).cast("int").alias("label")) for i, t in enumerate((110, 114))]
    return pixels.ensemble_agreement(members[0].unionByName(members[1]), ["image_id"]).select("image_id", "agreement_fraction")


_RUNS = "CROSS JOIN (VALUES (105), (110), (115)) AS t(threshold)"


@query(
    f"""WITH {PIXELS_SQL}, r AS (SELECT image_id, threshold, count(*) FILTER (v > threshold) AS object_count, count(*) FILTER (v > threshold) / 64 AS fg FROM px {_RUNS} GROUP BY 1, 2)
    SELECT image_id, threshold, object_count, {r('fg AS foreground_fraction')}, {r('coalesce(CASE WHEN avg(object_count) OVER w <> 0 THEN stddev_samp(object_count) OVER w / avg(object_count) OVER w END, 0) AS count_cv', 'max(fg) OVER w - min(fg) OVER w AS foreground_range')} FROM r WINDOW w AS (PARTITION BY image_id)"""
)
def threshold_sensitivity(spark, sf_dir):
    px = views.pixels(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, (105, 110, 115)))))
    hits = F.count_if(F.col("v") > F.col("threshold"))
    return pixels.threshold_sensitivity(px.groupBy("image_id", "threshold").agg(hits.alias("object_count"), (hits / 64).alias("foreground_fraction")), ["image_id"])


@query(f"WITH m AS (SELECT l_orderkey AS id, l_linenumber AS n, l_discount AS low, l_tax AS high FROM lineitem) SELECT count(*) AS n, {r('avg(greatest(0.0, least(100.0, 100 - least(25.0, low * 50) - least(25.0, high * 50)))) AS burden')} FROM m")
def artifact_burden(spark, sf_dir):
    m = views.table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("low_clip_fraction"), F.col("l_tax").alias("high_clip_fraction"))
    return gates.artifact_burden_score(m).agg(F.count("*").alias("n"), F.avg("artifact_burden_score").alias("burden"))


@query(
    f"""WITH b AS (SELECT event_type AS backend, value, CASE WHEN event_id % 9 = 0 THEN 'failed' END AS error FROM events) SELECT backend, count(*) AS runs, count(error) AS failed_runs, count(value) AS value_count,
    {r('avg(value) AS value_mean', 'median(value) AS value_median', 'stddev_samp(value) AS value_std')} FROM b GROUP BY 1"""
)
def backend_benchmarks(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), "value", F.when(F.col("event_id") % 9 == 0, "failed").alias("error"))
    return reporting.aggregate_backend_benchmarks(e, ["value"])


@query(f"WITH {_NODES} SELECT track_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames, max(frame) - min(frame) + 1 AS duration, false AS is_child FROM nodes GROUP BY 1")
def lineage_summary(spark, sf_dir):
    nodes = views.tracks(spark, sf_dir).select("track_id", "frame", F.col("track_id").cast("int").alias("label"))
    return tracks.summarize_lineages(tracks.lineage_table(nodes)).drop("parents")


# -- whole outputs, and operators that no query above calls ------------------------------------------------------------


_BINS = "b AS (SELECT {k}, least(255, floor(v * 256 / 255)) AS b, count(*) AS k FROM {t} GROUP BY ALL), d AS (SELECT {k}, k / sum(k) OVER (PARTITION BY {k}) / (255.0::DOUBLE / 256) AS d FROM b), e AS (SELECT {k}, -sum(d * log2(d)) AS entropy FROM d GROUP BY ALL)"


@query(
    f"""WITH {PIXELS_SQL}, {_BINS.format(k='image_id', t='px')}, g AS (SELECT image_id, abs(v - lag(v) OVER (PARTITION BY image_id, y ORDER BY x)) AS g FROM px UNION ALL SELECT image_id, abs(v - lag(v) OVER (PARTITION BY image_id, x ORDER BY y)) FROM px),
    q AS (SELECT image_id, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM px GROUP BY 1),
    a AS (SELECT image_id, avg(g) AS gm, stddev_pop(g) AS gs, avg(CASE WHEN g > greatest(1.0::DOUBLE, std) THEN 1.0 ELSE 0.0 END) AS ef FROM g JOIN q USING (image_id) WHERE g IS NOT NULL GROUP BY 1)
    SELECT image_id, {r('entropy AS entropy', 'std AS std', 'gm AS gradient_mean', 'gs AS gradient_std', 'ef AS edge_fraction', 'p10 AS p10', 'p50 AS p50', 'p90 AS p90', digits=8)} FROM e JOIN q USING (image_id) JOIN a USING (image_id)""",
    digits=8,
)
def texture_features(spark, sf_dir):
    return pixels.texture_features(views.pixels(spark, sf_dir), ["image_id"])


@query(
    f"""WITH {PIXELS_SQL}, {_LABELLED}, s AS (SELECT *, coalesce((lead(v) OVER h - lag(v) OVER h) / 2, lead(v) OVER h - v, v - lag(v) OVER h, 0) AS gx, coalesce((lead(v) OVER u - lag(v) OVER u) / 2, lead(v) OVER u - v, v - lag(v) OVER u, 0) AS gy FROM lp
      WINDOW h AS (PARTITION BY image_id, y ORDER BY x), u AS (PARTITION BY image_id, x ORDER BY y)), o AS (SELECT *, sqrt(gx * gx + gy * gy) AS g FROM s WHERE label > 0), {_BINS.format(k='image_id, label', t='o')}
    SELECT image_id, label, {r('any_value(entropy) AS entropy', 'stddev_pop(v) AS std', 'quantile_cont(v, 0.1) AS p10', 'quantile_cont(v, 0.9) AS p90', 'avg(g) AS gradient_mean', 'stddev_pop(g) AS gradient_std', digits=4)} FROM o JOIN e USING (image_id, label) GROUP BY 1, 2""",
    digits=4,
)
def object_texture_features(spark, sf_dir):
    return pixels.object_texture_features(_labelled(spark, sf_dir), ["image_id"])


@query(
    f"""WITH {PIXELS_SQL}, m AS (SELECT image_id, count(*) FILTER (v > 112 AND v > 118) AS b, count(*) FILTER (v > 112) AS p, count(*) FILTER (v > 118) AS q FROM px GROUP BY 1), n AS (SELECT *, CAST(p > 0 AS INT) AS n0, CAST(q > 0 AS INT) AS n1 FROM m)
    SELECT image_id, {r('(n0 + n1) / 2 AS median_count', 'abs(n0 - n1) / 2 AS mad_count', 'CASE WHEN p + q - b > 0 THEN b / (p + q - b) ELSE 1 END AS agreement_fraction')}, 't112' AS chosen, CASE WHEN p + q - b > 0 AND b / (p + q - b) < 0.6 THEN 'segmentation members disagree' END AS warning, n0::BIGINT AS low_count, n1::BIGINT AS high_count FROM n"""
)
def ensemble_agreement(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    members = [px.select("image_id", F.lit(f"t{t}").alias("member"), F.lit(i).alias("idx"), "y", "x", (F.col("v") > t).cast("int").alias("label")) for i, t in enumerate((112, 118))]
    out = pixels.ensemble_agreement(members[0].unionByName(members[1]), ["image_id"])
    return out.withColumn("low_count", F.col("member_counts")["t112"]).withColumn("high_count", F.col("member_counts")["t118"]).drop("member_counts")


@query(
    f"""WITH m AS (SELECT l_discount AS a, l_tax AS b, l_discount / 10 AS c, l_tax * 2 AS d, l_quantity / 1000 AS e FROM lineitem) SELECT count(*) AS n,
    {r('avg(greatest(0.0, least(100.0, 100 - least(25.0, a * 50) - least(25.0, b * 50) - least(15.0, c * 300) - least(15.0, d * 100) - least(15.0, e * 100)))) AS burden')} FROM m"""
)
def artifact_burden_all(spark, sf_dir):
    m = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_discount AS low_clip_fraction", "l_tax AS high_clip_fraction", "l_discount / 10 AS hot_pixel_fraction", "l_tax * 2 AS horizontal_gradient_cv", "l_quantity / 1000 AS vertical_gradient_cv"
    )
    return gates.artifact_burden_score(m).agg(F.count("*").alias("n"), F.avg("artifact_burden_score").alias("burden"))


@query(f"WITH {_VOXELS} SELECT image_id, y, x, {r('trunc(avg(label * 7)) AS v')} FROM vx GROUP BY ALL")
def project_z_mean(spark, sf_dir):
    return pixels.project_z(_voxels(spark, sf_dir).withColumn("v", F.col("label") * 7.0), ["image_id"], "mean", integer=True)


@query(f"WITH {_VOXELS} SELECT image_id, y, x, {r('median(label * 7) AS v')} FROM vx GROUP BY ALL")
def project_z_median(spark, sf_dir):
    return pixels.project_z(_voxels(spark, sf_dir).withColumn("v", F.col("label") * 7.0), ["image_id"], "median")


@query(f"WITH {_VOXELS} SELECT image_id, y, x, label FROM vx WHERE z = 2")
def select_plane(spark, sf_dir):
    return pixels.select_plane(_voxels(spark, sf_dir), "z", 2)


@query(f"WITH {PIXELS_SQL} SELECT image_id, CAST(y // 3 AS INT) AS chunk, count(*) AS n, {r('sum(v) AS total', digits=4)} FROM px GROUP BY 1, 2", digits=4)
def chunk_ids(spark, sf_dir):
    return pixels.chunk_ids(views.pixels(spark, sf_dir), "y", 3).groupBy("image_id", "chunk").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {_CENTRES}, {_NEAR} SELECT image_id, label, {r('d AS nearest_neighbor_distance', 'cx / 8 AS normalized_x', 'cy / 8 AS normalized_y', 'count(*) OVER (PARTITION BY image_id) / (64.0::DOUBLE / 100000) AS local_density_per_100k_px', digits=4)} FROM n JOIN o USING (image_id, label)", digits=4)
def spatial_features(spark, sf_dir):
    objects = pixels.object_features(_labelled(spark, sf_dir), ["image_id"])
    out = pixels.add_spatial_features(objects, ["image_id"], height=8, width=8)
    return out.select("image_id", "label", "nearest_neighbor_distance", "normalized_x", "normalized_y", "local_density_per_100k_px")


@query(
    f"""WITH {PIXELS_SQL}, {_LABELLED}, o AS (SELECT image_id, label, count(*) AS area, min(x) = 0 OR min(y) = 0 OR max(x) = 7 OR max(y) = 7 AS edge FROM lp WHERE label > 0 GROUP BY 1, 2),
    s AS (SELECT image_id, count(*) AS n, sum(area) AS fg, median(area) AS med, coalesce(stddev_samp(area) / avg(area), 0) AS cv, avg(edge::INT) AS border, avg((area < 6)::INT) AS tiny, avg((area > 8)::INT) AS merged FROM o GROUP BY 1)
    SELECT image_id, coalesce(n, 0) AS object_count, {r('coalesce(fg / 64, 0) AS foreground_fraction', 'coalesce(med, 0) AS median_area', 'coalesce(cv, 0) AS area_cv', 'coalesce(border, 0) AS border_fraction', 'coalesce(tiny, 1) AS tiny_object_fraction', 'coalesce(merged, 0) AS merged_object_fraction', 'coalesce(greatest(0, 100 - least(45, 30 * border) - least(30, 30 * tiny) - least(25, 25 * merged)), 0) AS quality_score')}
    FROM (SELECT DISTINCT image_id FROM px) LEFT JOIN s USING (image_id)"""
)
def segmentation_diagnostics(spark, sf_dir):
    px = _labelled(spark, sf_dir)
    images = px.select("image_id").distinct().withColumn("height", F.lit(8)).withColumn("width", F.lit(8))
    return pixels.segmentation_diagnostics(pixels.object_features(px, ["image_id"]), images, ["image_id"], min_area=3)


_BOX = "y < 2 + image_id % 6 AND x < 2 + image_id % 5"


@query(f"WITH {PIXELS_SQL}, b AS (SELECT image_id, 2 + image_id % 6 AS h, 2 + image_id % 5 AS w FROM px GROUP BY 1) SELECT image_id, 1 AS label, {r('2.0 * (h + w - 2) AS perimeter', 'least(1, 4 * pi() * h * w / pow(2 * (h + w - 2), 2)) AS circularity')} FROM b")
def object_shapes(spark, sf_dir):
    return pixels.object_shapes(views.pixels(spark, sf_dir).withColumn("label", F.expr(_BOX).cast("int")), ["image_id"])


_NOTCHED = """CASE WHEN y < 3 + image_id % 5 AND x < 3 + image_id % 4 AND NOT (y >= 2 + image_id % 5 - image_id % 2 AND x >= 2 + image_id % 4 - image_id % 2) THEN 1 WHEN x = 7 THEN 2 ELSE 0 END"""


@query(
    f"""WITH {PIXELS_SQL}, b AS (SELECT DISTINCT image_id, 3 + image_id % 5 AS h, 3 + image_id % 4 AS w, 1 + image_id % 2 AS cut FROM px),
    s AS (SELECT image_id, 1 AS label, h * w - cut * cut AS area, 2 * (h + w - 3) + sqrt(2) AS border FROM b UNION ALL SELECT image_id, 2, 8, 14.0 FROM b)
    SELECT image_id, label, {r('border AS perimeter', 'least(1, 4 * pi() * area / pow(border, 2)) AS circularity')} FROM s"""
)
def notched_shapes(spark, sf_dir):
    """Two objects an image: a rectangle without one corner, and a line."""
    return pixels.object_shapes(views.pixels(spark, sf_dir).withColumn("label", F.expr(_NOTCHED).cast("int")), ["image_id"])


@query(f"WITH {_VOXELS}, l AS (SELECT image_id, label, count(*) AS volume FROM vx WHERE label = 2 AND image_id % 3 > 0 GROUP BY 1, 2), i AS (SELECT DISTINCT image_id FROM vx) SELECT image_id, count(volume) AS object_count, {r('coalesce(sum(volume), 0) AS total_volume', 'avg(volume) AS mean_volume', 'median(volume) AS median_volume', 'coalesce(sum(volume), 0) / 64 AS volume_fraction', 'count(volume) / (64 / 1e9) AS density_per_mm3')} FROM i LEFT JOIN l USING (image_id) GROUP BY 1")
def volume_summary_with_empty(spark, sf_dir):
    vx = pixels.validate_labels(_voxels(spark, sf_dir))
    features = pixels.volume_features(vx.where("label = 2 AND image_id % 3 > 0"), ["image_id"])
    return pixels.summarize_volume(features, 64, ["image_id"], volumes=vx)


@query(
    f"""WITH {TRACKS_SQL}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(event_id % 7 - lag(event_id % 7) OVER w, 2)) AS step FROM tr WINDOW w AS (PARTITION BY track_id ORDER BY frame))
    SELECT track_id, count(*) AS n_frames, {r('coalesce(sum(step), 0) AS path_length', 'coalesce(max(step), 0) AS max_step', 'coalesce(avg(step), 0) / 2 AS mean_speed', '(max(frame) - min(frame)) * 2 AS duration')} FROM s GROUP BY 1"""
)
def summarize_tracks_3d(spark, sf_dir):
    rows = views.tracks(spark, sf_dir).withColumn("z", (F.col("event_id") % 7).cast("double"))
    out = tracks.summarize_tracks(rows, axes=("x", "y", "z"), frame_interval=2.0)
    return out.select("track_id", "n_frames", "path_length", "max_step", "mean_speed", F.col("duration").cast("double").alias("duration"))


@query(f"SELECT event_id, 'split' AS event, CAST(event_id % 3 + 1 AS INT) AS degree, event_id % 3 + 1 >= 2 AS is_division FROM events WHERE {_KINDS} = 'split'")
def classify_divisions(spark, sf_dir):
    return tracks.classify_divisions(_kinds(spark, sf_dir))


@query(
    f"""WITH {_NODES}, s AS (SELECT frame, label AS parent_label, unnest([label + 1, label + 2]) AS label FROM (SELECT frame + 1 AS frame, label FROM nodes WHERE label % 3 <> 0)), p AS (SELECT s.frame, s.label, arg_max(n.track_id, s.parent_label) AS parent_track_id FROM s JOIN nodes n ON n.frame + 1 = s.frame AND n.label = s.parent_label GROUP BY 1, 2)
    SELECT track_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames, max(frame) - min(frame) + 1 AS duration, count(parent_track_id) > 0 AS is_child,
      coalesce(array_to_string(list_sort(list(DISTINCT parent_track_id) FILTER (parent_track_id IS NOT NULL)), ','), '') AS parents FROM nodes LEFT JOIN p USING (frame, label) GROUP BY 1"""
)
def lineage_children(spark, sf_dir):
    nodes = views.tracks(spark, sf_dir).select("track_id", "frame", F.col("track_id").cast("int").alias("label"))
    splits = nodes.where("label % 3 <> 0").select((F.col("frame") + 1).alias("frame"), F.lit("split").alias("event"), F.col("label").alias("parent_label"), F.array(F.col("label") + 1, F.col("label") + 2).alias("child_labels"))
    return tracks.summarize_lineages(tracks.lineage_table(nodes, splits)).withColumn("parents", F.array_join(F.col("parents").cast("array<string>"), ","))


@query(rf"""WITH {_NAMES} SELECT c_custkey, regexp_extract(filename, '_([A-H][0-9][0-9])_', 1) AS well, CAST(regexp_extract(filename, '_t([0-9]+)', 1) AS INT) AS timepoint, 'b7' AS batch, 3 AS round FROM n""")
def annotate_results(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    well = F.concat(F.expr("chr(65 + CAST(c_custkey % 8 AS INT))"), F.lpad((1 + F.col("c_custkey") % 12).cast("string"), 2, "0"))
    name = F.concat(F.lit("Plate"), F.col("c_nationkey").cast("string"), F.lit("_"), well, F.lit("_t"), (F.col("c_custkey") % 10).cast("string"), F.lit(".png"))
    return groups.annotate_results(c.select("c_custkey", name.alias("filename")), metadata={"batch": "b7", "round": 3}).select("c_custkey", "well", "timepoint", "batch", "round")


_MEANS = f"WITH {WELLS_SQL}, q AS (SELECT condition, replicate, avg(signal) AS signal, avg(quantity) AS quantity FROM wells GROUP BY 1, 2)"


def _permuted(rows: str, rounds: int) -> str:
    """SQL of a permutation test over ``rows`` (a boolean, x, name): table ``tested`` of one row."""
    return f"""pv AS ({rows}), f AS (SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, avg(x) FILTER (a) AS mean_a, avg(x) FILTER (NOT a) AS mean_b,
      var_samp(x) FILTER (a) AS va, var_samp(x) FILTER (NOT a) AS vb, sum(x) AS total FROM pv),
    drawn AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY md5('0:' || k || ':' || name), name) AS rank FROM pv, range(0, {rounds}) AS t(k)),
    sums AS (SELECT k, sum(x) AS s FROM drawn, f WHERE rank <= n_a GROUP BY k),
    tested AS (SELECT n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS effect_size,
      (SELECT count(*) FROM sums WHERE round(abs(s / n_a - (total - s) / n_b), 9) >= round(abs(mean_a - mean_b), 9)) AS extreme FROM f)"""


def _bootstrapped(rows: str, rounds: int) -> str:
    """SQL of bootstrap intervals per g over ``rows`` (g, x, name): table ``spans``."""
    return f"""bv AS ({rows}), placed AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY md5(name), name) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM bv),
    chosen AS (SELECT g, k, CAST('0x' || substr(md5('0:' || k || ':' || place), 1, 15) AS BIGINT) % n AS place FROM placed, range(0, {rounds}) AS t(k)),
    means AS (SELECT c.g, k, avg(x) AS m FROM chosen c JOIN placed p ON p.g = c.g AND p.place = c.place GROUP BY 1, 2),
    spans AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY 1)"""


_TESTED = r("mean_a AS mean_a", "mean_b AS mean_b", "mean_a - mean_b AS difference", "effect_size AS effect_size", digits=4)
_ENDS = r("(extreme + 1) / 1001 AS p_value", "a.low AS ci_a_low", "a.high AS ci_a_high", "b.low AS ci_b_low", "b.high AS ci_b_high", digits=4)


@query(
    f"""{_MEANS}, {_permuted("SELECT condition = 'A' AS a, signal AS x, condition || '/' || replicate AS name FROM q WHERE condition IN ('A', 'R')", 1000)},
    {_bootstrapped("SELECT condition AS g, signal AS x, condition || '/' || replicate AS name FROM q WHERE condition IN ('A', 'R')", 1000)}
    SELECT n_a, n_b, {_TESTED}, {_ENDS} FROM tested, spans a, spans b WHERE a.g = 'A' AND b.g = 'R'""",
    digits=4,
)
def replicate_effect(spark, sf_dir):
    return groups.replicate_effect_summary(views.wells(spark, sf_dir), "signal", "condition", "A", "R", n_bootstrap=1000, n_permutations=1000)


@query(
    f"""{_MEANS}, {_permuted("SELECT condition = 'N' AS a, quantity AS x, condition || '/' || replicate AS name FROM q WHERE condition IN ('N', 'R')", 500)}
    SELECT n_a, n_b, {_TESTED}, {r('(extreme + 1) / 501 AS p_value', digits=4)} FROM tested""",
    digits=4,
)
def permutation_pvalue(spark, sf_dir):
    means = views.wells(spark, sf_dir).where("condition IN ('N', 'R')").groupBy("condition", "replicate").agg(F.avg("quantity").alias("x"))
    means = scratch.table(means.withColumn("name", F.concat_ws("/", "condition", F.col("replicate").cast("string"))), "replicate-means")
    tested = resampling.permutation_pvalues(means, "x", F.col("condition") == "N", "name", n_permutations=500)
    effect = normalization.effect_size(means, "x", F.col("condition") == "N", F.col("condition") == "R").select("effect_size")
    return tested.crossJoin(F.broadcast(effect)).select("n_a", "n_b", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("difference"), "effect_size", "p_value")


_COUNTED = """SELECT g = 'A' AS a, x, g || '/' || x || '/' || row_number() OVER (PARTITION BY g, x) AS name FROM (
  SELECT l_returnflag AS g, CAST(l_suppkey AS DOUBLE) AS x FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber > 6)"""


@query(f"WITH {_permuted(_COUNTED, 200)} SELECT n_a, n_b, {_TESTED}, {r('(extreme + 1) / 201 AS p_value', digits=4)} FROM tested", digits=4)
def compare_two_groups_ties(spark, sf_dir):
    """Many equal values: they are counted off, which names them apart."""
    rows = views.table(spark, sf_dir, "lineitem").where("l_linenumber > 6").select("l_returnflag", F.col("l_suppkey").cast("double").alias("x"))
    return groups.compare_two_groups(rows, "x", "l_returnflag", "A", "R", n_permutations=200)


@query(
    f"""{_MEANS}, {_bootstrapped("SELECT condition || '|signal' AS g, signal AS x, CAST(replicate AS VARCHAR) AS name FROM q UNION ALL SELECT condition || '|quantity', quantity, CAST(replicate AS VARCHAR) FROM q", 1000)},
    n AS (SELECT g, count(*) AS n, avg(x) AS m FROM bv GROUP BY 1)
    SELECT split_part(g, '|', 1) AS condition, split_part(g, '|', 2) AS value_column, n AS n_replicates, {r('m AS mean', 'low AS ci_low', 'high AS ci_high', digits=4)} FROM spans JOIN n USING (g)""",
    digits=4,
)
def experiment_summary(spark, sf_dir):
    return groups.summarize_experiment(views.wells(spark, sf_dir), replicate="replicate", group="condition", values=["signal", "quantity"], n_bootstrap=1000)


@query(f"SELECT event_type AS operation, count(*) AS calls, {r('sum(value) AS elapsed_seconds', digits=4)}, CAST(sum(event_id % 5) AS BIGINT) AS items, {r('sum(event_id % 5) / sum(value) AS items_per_second', digits=4)} FROM events GROUP BY 1", digits=4)
def runtime_log(spark, sf_dir):
    """A log of calls, each from one time to another."""
    e = views.table(spark, sf_dir, "events").select("event_type", F.lit(0.0).alias("began"), F.col("value").alias("ended"), (F.col("event_id") % 5).alias("items"))
    return reporting.runtime_table(e, "event_type", "began", "ended").drop("started", "finished")


@query(
    r"""WITH d AS (SELECT lang, 'in/' || doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents)
    SELECT lang, sha256('{' || string_agg('"' || path || '":"' || h || '"', ',' ORDER BY path, h) || '}') AS fingerprint, count(*) AS inputs FROM d GROUP BY 1"""
)
def input_fingerprints(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    d = d.select("lang", F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return gates.input_fingerprint(d, keys=["lang"])


_TWO = "q AS (SELECT condition, replicate, avg(signal) AS m FROM wells GROUP BY 1, 2), ab2 AS (SELECT count(*) FILTER (condition = 'A') AS na, count(*) FILTER (condition = 'R') AS nb, avg(m) FILTER (condition = 'A') AS ma, avg(m) FILTER (condition = 'R') AS mb, var_samp(m) FILTER (condition = 'A') AS va, var_samp(m) FILTER (condition = 'R') AS vb FROM q)"
_EFFECT = r("ma AS mean_a", "mb AS mean_b", "ma - mb AS difference", "(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS effect_size", digits=4)


@query(f"WITH {WELLS_SQL}, {_TWO} SELECT na AS n_a, nb AS n_b, {_EFFECT} FROM ab2", digits=4)
def replicate_effect_means(spark, sf_dir):
    out = groups.replicate_effect_summary(views.wells(spark, sf_dir), "signal", "condition", "A", "R", n_bootstrap=100, n_permutations=100)
    return out.select("n_a", "n_b", "mean_a", "mean_b", "difference", "effect_size")


@query(f"WITH {WELLS_SQL}, {_TWO} SELECT na AS n_a, nb AS n_b, {_EFFECT}, true AS p_in_range FROM ab2", digits=4)
def compare_two_groups(spark, sf_dir):
    means = views.wells(spark, sf_dir).groupBy("condition", "replicate").agg(F.avg("signal").alias("m"))
    out = groups.compare_two_groups(means, "m", "condition", "A", "R", n_permutations=10_000)
    return out.select("n_a", "n_b", "mean_a", "mean_b", "difference", "effect_size", F.col("p_value").between(1 / 10_001, 1).alias("p_in_range"))


@query(f"WITH {WELLS_SQL}, q AS (SELECT condition, replicate, avg(signal) AS signal, avg(quantity) AS quantity FROM wells GROUP BY 1, 2), u AS (SELECT condition, 'signal' AS value_column, signal AS m FROM q UNION ALL SELECT condition, 'quantity', quantity FROM q) SELECT condition, value_column, count(m) AS n_replicates, {r('avg(m) AS mean', digits=4)}, true AS ordered FROM u GROUP BY 1, 2", digits=4)
def experiment_means(spark, sf_dir):
    out = groups.summarize_experiment(views.wells(spark, sf_dir), replicate="replicate", group="condition", values=["signal", "quantity"], n_bootstrap=200)
    return out.select("condition", "value_column", "n_replicates", "mean", F.expr("ci_low <= mean AND mean <= ci_high").alias("ordered"))


@query(f"WITH p AS (SELECT ps_partkey % 3 AS g, ps_partkey, ps_suppkey, ps_p FROM (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, l_extendedprice % 1000 / 1000 AS ps_p, l_orderkey, l_linenumber FROM lineitem)), k AS (SELECT g, ps_p, count(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT g, ps_p, n, sum(n) OVER (PARTITION BY g ORDER BY ps_p) AS rank, sum(n) OVER (PARTITION BY g) AS total FROM k), q AS (SELECT g, ps_p, n, least(1.0, min(ps_p * total / rank) OVER (PARTITION BY g ORDER BY ps_p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM c) SELECT g, CAST(sum(n) AS BIGINT) AS n, {r('sum(q * n) AS total_q', 'min(q) AS min_q', 'max(q) AS max_q', digits=3)} FROM q GROUP BY 1", digits=3)
def benjamini_hochberg_keys(spark, sf_dir):
    p = views.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3).alias("g"), (F.col("l_extendedprice") % 1000 / 1000).alias("p"))
    return groups.benjamini_hochberg(p, keys=["g"]).groupBy("g").agg(F.count("q").alias("n"), F.sum("q").alias("total_q"), F.min("q").alias("min_q"), F.max("q").alias("max_q"))


@query(f"SELECT count(*) AS operations, {r('sum(value) AS elapsed_seconds', digits=4)}, CAST(sum(event_id % 5) AS BIGINT) AS items, count(*) FILTER (event_id % 9 = 0) AS failures, {r('sum(event_id % 5) / sum(value) AS items_per_second', digits=4)} FROM events", digits=4)
def profile_summary(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("value").alias("elapsed_seconds"), (F.col("event_id") % 5).alias("items"), F.when(F.col("event_id") % 9 == 0, "x").alias("error"))
    return reporting.summarize_profile(e)


_SCORED_PAIRS = ("iou", "dice", "precision", "recall")


@query(f"WITH {PIXELS_SQL}, c AS (SELECT image_id, count(*) FILTER (v > 112 AND v > 110) AS tp, count(*) FILTER (v > 112) AS p, count(*) FILTER (v > 110) AS t FROM px GROUP BY 1) SELECT count(*) AS pairs, {r('avg(CASE WHEN p + t - tp > 0 THEN tp / (p + t - tp) ELSE 1 END) AS iou_mean', 'avg(CASE WHEN p + t > 0 THEN 2 * tp / (p + t) ELSE 1 END) AS dice_mean', 'avg(CASE WHEN p > 0 THEN tp / p ELSE 1 END) AS precision_mean', 'avg(CASE WHEN t > 0 THEN tp / t ELSE 1 END) AS recall_mean')} FROM c")
def benchmark_segmentation(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    pred, truth = (px.select("image_id", "y", "x", (F.col("v") > t).cast("int").alias("label")) for t in (112, 110))
    paired = validation.paired_segmentation_metrics(pred, truth, "image_id", max_distance=3.0)
    return validation.benchmark_segmentation(paired).select("pairs", *[f"{m}_mean" for m in _SCORED_PAIRS])


@query(
    f"""WITH {PIXELS_SQL}, c AS (SELECT image_id, count(*) FILTER (v > 112) AS tp, count(*) FILTER (v > 112) AS p, count(*) FILTER (v > 110) AS t,
      avg(y) FILTER (v > 112) AS py, avg(x) FILTER (v > 112) AS px, avg(y) FILTER (v > 110) AS ty, avg(x) FILTER (v > 110) AS tx FROM px GROUP BY 1),
    m AS (SELECT *, CAST(p > 0 AS INT) AS np, CAST(t > 0 AS INT) AS nt, CAST(coalesce(sqrt(pow(py - ty, 2) + pow(px - tx, 2)) <= 1.5, false) AS INT) AS hit FROM c),
    s AS (SELECT CASE WHEN p + t - tp > 0 THEN tp / (p + t - tp) ELSE 1 END AS iou, CASE WHEN p + t > 0 THEN 2 * tp / (p + t) ELSE 1 END AS dice, CASE WHEN p > 0 THEN tp / p ELSE 1 END AS precision, CASE WHEN t > 0 THEN tp / t ELSE 1 END AS recall,
      CASE WHEN np > 0 THEN hit / np ELSE 1 END AS instance_precision, CASE WHEN nt > 0 THEN hit / nt ELSE 1 END AS instance_recall, CASE WHEN np + nt > 0 THEN 2 * hit / (np + nt) ELSE 1 END AS instance_f1, abs(np - nt) AS absolute_count_error FROM m)
    SELECT count(*) AS pairs, {r(*[f'avg({m}) AS {m}_mean' for m in validation.METRICS])} FROM s"""
)
def benchmark_all_metrics(spark, sf_dir):
    """Pixel and instance metrics of pairs of one object each at most."""
    px = views.pixels(spark, sf_dir)
    pred, truth = (px.select("image_id", "y", "x", (F.col("v") > t).cast("int").alias("label")) for t in (112, 110))
    return validation.benchmark_segmentation(validation.paired_segmentation_metrics(pred, truth, "image_id", max_distance=1.5))


def _packed(spark, sf_dir, kind: str) -> DataFrame:
    """8 x 8 images as packed rows: image_id, shape, dtype, data."""

    def pack(frames):
        for frame in frames:
            arrays = [(np.array(e, np.float64) * 100 + 100).clip(0, 255).astype(kind) for e in frame["embedding"]]
            yield pd.DataFrame({"image_id": frame["vec_id"], "shape": [[8, 8]] * len(arrays), "dtype": [str(np.dtype(kind))] * len(arrays), "data": [a.tobytes() for a in arrays]})

    return views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "image_id long, shape array<int>, dtype string, data binary")


_BYTES = "gp AS (SELECT vec_id AS image_id, trunc(greatest(0, least(255, CAST(e AS DOUBLE) * 100 + 100))) AS g FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings))"


@query(f"WITH {_BYTES} SELECT image_id, {r('CAST(t AS DOUBLE) AS threshold', 'avg(CASE WHEN g >= t THEN 1.0 ELSE 0.0 END) AS foreground_fraction')} FROM gp CROSS JOIN (VALUES (95), (105)) AS t(t) GROUP BY 1, t")
def threshold_runs(spark, sf_dir):
    return validation.threshold_runs(_packed(spark, sf_dir, "uint8"), "image_id", [95, 105, 95]).drop("object_count")


_SPOTS = f"""{_BYTES}, gi AS (SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, trunc(greatest(0, least(255, CAST(e AS DOUBLE) * 100 + 100))) AS g FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


@query(
    f"""WITH RECURSIVE {_SPOTS}, cells AS (SELECT image_id, CAST(t AS DOUBLE) AS threshold, y, x, g >= t AS on_ FROM gi CROSS JOIN (VALUES (95), (105)) AS t(t)),
    reach AS (SELECT image_id, threshold, y, x, y AS ry, x AS rx FROM cells WHERE on_ UNION
      SELECT r.image_id, r.threshold, r.y, r.x, n.y, n.x FROM reach r JOIN cells n ON n.image_id = r.image_id AND n.threshold = r.threshold AND n.on_ AND abs(n.y - r.ry) <= 1 AND abs(n.x - r.rx) <= 1),
    roots AS (SELECT image_id, threshold, y, x, min(8 * ry + rx) AS root FROM reach GROUP BY 1, 2, 3, 4),
    found AS (SELECT image_id, threshold, count(DISTINCT root) AS n FROM roots GROUP BY 1, 2)
    SELECT image_id, threshold, coalesce(n, 0) AS object_count, {r('f AS foreground_fraction')} FROM (SELECT image_id, threshold, avg(CAST(on_ AS INT)) AS f FROM cells GROUP BY 1, 2) LEFT JOIN found USING (image_id, threshold)"""
)
def threshold_runs_objects(spark, sf_dir):
    """Whole output of the runs at fixed thresholds, objects counted."""
    return validation.threshold_runs(_packed(spark, sf_dir, "uint8"), "image_id", [95, 105, 95])


_DISC = "(SELECT a AS dy, b AS dx FROM range(-2, 3) AS a(a), range(-2, 3) AS b(b) WHERE a * a + b * b <= 4)"


@query(
    f"""WITH {_SPOTS}, low AS (SELECT p.image_id, p.y, p.x, any_value(p.g) AS g, min(q.g) AS e FROM gi p CROSS JOIN {_DISC} JOIN gi q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3),
    back AS (SELECT p.image_id, p.y, p.x, any_value(p.g) AS g, max(q.e) AS o FROM low p CROSS JOIN {_DISC} JOIN low q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)
    SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(g - least(o, g) AS INT) AS v FROM back"""
)
def background_corrected(spark, sf_dir):
    """What is left of images after their opening with a disc is taken off."""
    out = segmentation.preprocess(_packed(spark, sf_dir, "uint8"), [{"name": "top_hat", "radius": 2}]).select("image_id", F.hex("data").alias("hex"))
    values = F.transform(F.sequence(F.lit(0), (F.length("hex") / 2 - 1).cast("int")), lambda i: F.conv(F.substr("hex", (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    return out.select("image_id", F.posexplode(values).alias("at", "v")).select("image_id", F.floor(F.col("at") / 8).cast("int").alias("y"), (F.col("at") % 8).alias("x"), "v")


def _files(spark, sf_dir) -> DataFrame:
    """The images as PNG files: path, content, length."""

    def encode(frames):
        for frame in frames:
            raw = [images.encode_png(np.frombuffer(d, np.uint8).reshape(8, 8)) for d in frame["data"]]
            yield pd.DataFrame({"path": [f"plate/{i}.png" for i in frame["image_id"]], "content": raw, "length": list(map(len, raw))})

    return _packed(spark, sf_dir, "uint8").mapInPandas(encode, "path string, content binary, length long")


@query(
    f"""WITH {_BYTES} SELECT 'plate/' || image_id || '.png' AS path, image_id || '.png' AS filename, 8 AS width, 8 AS height, 1 AS channels, 'uint8' AS dtype,
    {r('round(avg(g), 4) AS brightness_mean', 'round(stddev_pop(g), 4) AS brightness_std', 'round(stddev_pop(g), 4) AS contrast_std', 'avg(CASE WHEN g <= 1 OR g >= 254 THEN 1.0 ELSE 0.0 END) AS saturation_fraction', digits=3)}, 64 AS hash_length FROM gp GROUP BY image_id""",
    digits=3,
)
def folder_qc(spark, sf_dir):
    out = quality.analyze_files(_files(spark, sf_dir), adaptive_qc=False)
    return out.select("path", "filename", "width", "height", "channels", "dtype", "brightness_mean", "brightness_std", "contrast_std", "saturation_fraction", F.length("sha256").alias("hash_length"))


@query(f"WITH {_BYTES} SELECT 'plate/' || image_id || '.png' AS path, 8 AS height, 8 AS width, 'YX' AS axes, {r('sum(g) AS total')} FROM gp GROUP BY image_id")
def load_images(spark, sf_dir):
    loaded = images.load_images(_files(spark, sf_dir))
    total = F.aggregate(F.sequence(F.lit(1), F.length("data")), F.lit(0), lambda a, i: a + F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int"))
    return loaded.select("path", "height", "width", "axes", total.cast("double").alias("total"))


_JPEG_SCALES = np.array([8, *(3 + k % 5 for k in range(1, 64))])


def _jpeg_files(spark, sf_dir) -> DataFrame:
    """Eight vectors as the coefficients of the eight blocks of a grey JPEG image: path, content."""

    def encode(frames):
        for frame in frames:
            raw = []
            for parts in frame["parts"]:
                blocks = np.zeros((1, max(p["at"] for p in parts) + 1, 64), np.int64)
                for p in parts:
                    blocks[0, p["at"]] = np.floor(np.array(p["embedding"], np.float64) * 100 + 0.5)
                raw.append(jpeg.encode_jpeg([blocks], [_JPEG_SCALES], 8, 8 * blocks.shape[1]))
            yield pd.DataFrame({"path": [f"plate/{i}.jpg" for i in frame["image"]], "content": raw})

    e = views.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("image"), F.struct((F.col("vec_id") % 8).cast("int").alias("at"), "embedding").alias("part"))
    return e.groupBy("image").agg(F.collect_list("part").alias("parts")).mapInPandas(encode, "path string, content binary")


@query(
    """WITH z AS (SELECT v, u, row_number() OVER (ORDER BY u + v, CASE WHEN (u + v) % 2 = 1 THEN v ELSE u END) - 1 AS k FROM range(0, 8) AS a(v), range(0, 8) AS b(u)),
    c AS (SELECT vec_id // 8 AS image, vec_id % 8 AS block, v, u, floor(CAST(e AS DOUBLE) * 100 + 0.5) * CASE WHEN k = 0 THEN 8 ELSE 3 + k % 5 END * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END / 4 AS c
      FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) JOIN z USING (k))
    SELECT 'plate/' || image || '.jpg' AS path, CAST(y AS INT) AS y, CAST(8 * block + x AS INT) AS x,
      CAST(least(255, greatest(0, floor(128.5 + sum(c * cos((2 * x + 1) * u * pi() / 16) * cos((2 * y + 1) * v * pi() / 16))))) AS INT) AS v
    FROM c, range(0, 8) AS py(y), range(0, 8) AS px(x) GROUP BY image, block, y, x"""
)
def jpeg_pixels(spark, sf_dir):
    """Images stored as JPEG come back as the inverse transform of their coefficients."""
    loaded = images.load_images(_jpeg_files(spark, sf_dir)).select("path", "width", F.hex("data").alias("hex"))
    values = F.transform(F.sequence(F.lit(0), (F.length("hex") / 2 - 1).cast("int")), lambda i: F.conv(F.substr("hex", (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    return loaded.select("path", "width", F.posexplode(values).alias("at", "v")).select("path", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).alias("x"), "v")


@query(
    f"""WITH RECURSIVE {_BYTES}, gi AS (SELECT vec_id, trunc(greatest(0, least(255, CAST(e AS DOUBLE) * 100 + 100))) AS g, i FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
    cells AS (SELECT vec_id // 256 AS image, vec_id % 256 // 16 * 8 + i // 8 AS y, vec_id % 16 * 8 + i % 8 AS x FROM gi WHERE g > 111),
    reach AS (SELECT image, y, x, y AS ry, x AS rx FROM cells UNION
      SELECT r.image, r.y, r.x, n.y, n.x FROM reach r JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON true JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON true JOIN cells n ON n.image = r.image AND n.y = r.ry + dy AND n.x = r.rx + dx),
    roots AS (SELECT image, y, x, min(ry * 1000000 + rx) AS root FROM reach GROUP BY 1, 2, 3)
    SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY image ORDER BY root) AS INT) AS label FROM roots"""
)
def tiled_labels(spark, sf_dir):
    """Objects of images of 128 x 128, each of 256 vectors as tiles of 8 x 8."""
    packed = _packed(spark, sf_dir, "uint8").select(
        F.floor(F.col("image_id") / 256).alias("image"), F.array(F.floor(F.col("image_id") % 256 / 16).cast("int"), (F.col("image_id") % 16).cast("int")).alias("tile"), "shape", "data"
    )

    def threshold(frames):
        for frame in frames:
            yield frame.assign(data=[(np.frombuffer(d, np.uint8) > 111).astype(np.uint8).tobytes() for d in frame["data"]])

    masks = packed.mapInPandas(threshold, packed.schema)
    return tiles.tile_cells(tiles.label_tiles(masks, ["image"], (8, 8)), ["image"], (8, 8))


@query(f"WITH {_VOXELS} SELECT image_id, z, y, x, {r('CAST(label AS DOUBLE) AS v')} FROM vx")
def canonical_axes(spark, sf_dir):
    """Stacks declared as X, Y, Z come out in the order Z, Y, X."""
    vx = _voxels(spark, sf_dir)
    cells = F.array_sort(F.collect_list(F.struct(F.expr("x * 16 + y * 4 + z").alias("at"), F.col("label").cast("double").alias("v"))))
    stacks = vx.groupBy("image_id").agg(F.transform(cells, lambda c: c["v"]).alias("values")).withColumn("shape", F.array(F.lit(4), F.lit(4), F.lit(4)))
    return validation.canonical_axes(stacks, "image_id", "XYZ").select("image_id", "z", "y", "x", "v")


@query(f"WITH {_BYTES}, n AS (SELECT image_id, CAST(g AS INT) AS v, row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS i FROM gi) SELECT 'stack' || (image_id // 50) || '.tif' AS file, CAST(image_id % 50 AS INT) AS page, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, v FROM n WHERE image_id % 50 BETWEEN 7 AND 41".replace(_BYTES, _BYTES + ", gi AS (SELECT vec_id AS image_id, trunc(greatest(0, least(255, CAST(e AS DOUBLE) * 100 + 100))) AS g, i FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"))
def tiff_pages(spark, sf_dir):
    """Stacks of 50 pages each, written as files and read by pages; the filter on pages is the source's own."""

    def stack(frames):
        for frame in frames:
            raw = []
            for parts in frame["parts"]:
                parts = sorted(parts, key=lambda p: p["page"])
                raw.append(images.encode_tiff(np.stack([np.frombuffer(p["data"], np.uint8).reshape(8, 8) for p in parts])))
            yield pd.DataFrame({"name": [f"stack{k}.tif" for k in frame["stack"]], "content": raw})

    packed = _packed(spark, sf_dir, "uint8").select(F.floor(F.col("image_id") / 50).alias("stack"), F.struct((F.col("image_id") % 50).alias("page"), "data").alias("part"))
    files = packed.groupBy("stack").agg(F.collect_list("part").alias("parts")).mapInPandas(stack, "name string, content binary")
    folder = scratch.folder(spark, "stacks")
    images.write_files(files, folder).count()
    read = pages.register(spark).read.format("tiff_pages").option("partition_bytes", 4096).load(folder).where("page >= 7 AND page <= 41")
    read = read.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "page", "first_row", F.element_at("shape", 2).alias("width"), F.hex("data").alias("hex"))
    values = F.transform(F.sequence(F.lit(0), (F.length("hex") / 2 - 1).cast("int")), lambda i: F.conv(F.substr("hex", (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    read = read.select("file", "page", "first_row", "width", F.posexplode(values).alias("at", "v"))
    return read.select("file", "page", (F.col("first_row") + F.floor(F.col("at") / F.col("width"))).cast("int").alias("y"), (F.col("at") % F.col("width")).alias("x"), "v")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
