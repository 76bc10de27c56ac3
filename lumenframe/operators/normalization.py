"""Dataset-level normalisation: robust z-scores, controls, plate effects and assay quality.

Every operator takes ``keys``, so that one call handles many plates or datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import MAD_FACTOR, MAD_SCALE, number, ratio, require, with_scalars
from lumenframe.operators.selection import median_mad, medians, select_medians

SCRATCH = ["__median", "__mad", "__std_samp", "__std_pop", "__n"]
QC_METRICS = ("focus_score", "brightness_mean", "saturation_fraction", "contrast_std", "estimated_cells", "segmentation_quality")


def robust_zscore_column(df: DataFrame, column: str, *, output: str | None = None, keys: list[str] = []) -> DataFrame:
    """0.6745 (x - median) / MAD; where the MAD is 0 or missing, 0 for every row."""
    require(df, column, *keys)
    joined = with_scalars(df, keys, median_mad(df, number(column), keys).select(*keys, "__median", "__mad"))
    z = F.when(F.col("__mad") > 0, MAD_FACTOR * (number(column) - F.col("__median")) / F.col("__mad")).when(F.coalesce("__mad", F.lit(0.0)) == 0, 0.0)
    return joined.withColumn(output or f"{column}_robust_z", z).drop("__median", "__mad")


def adaptive_dataset_qc(df: DataFrame, *, z_limit: float = 3.5, metrics: tuple[str, ...] = QC_METRICS, flag_column: str = "flags", keys: list[str] = []) -> DataFrame:
    """Robust z of each metric that is there, the largest absolute one, and a flag from ``z_limit`` on."""
    present = [m for m in metrics if m in df.columns]
    out = df
    if present:
        values = [number(m).alias(f"__v_{m}") for m in present]
        base = df.select(*keys, *values)
        med = medians(base, {f"__m_{m}": F.col(f"__v_{m}") for m in present}, keys)
        mad = medians(with_scalars(base, keys, med), {f"__d_{m}": F.abs(F.col(f"__v_{m}") - F.col(f"__m_{m}")) for m in present}, keys)
        out = with_scalars(with_scalars(df, keys, med), keys, mad)
        for m in present:
            z = F.when(F.col(f"__d_{m}") > 0, MAD_FACTOR * (number(m) - F.col(f"__m_{m}")) / F.col(f"__d_{m}")).when(F.coalesce(f"__d_{m}", F.lit(0.0)) == 0, 0.0)
            out = out.withColumn(f"{m}_robust_z", z)
        out = out.drop(*[f"__{p}_{m}" for p in "md" for m in present])
    score = F.greatest(*[F.coalesce(F.abs(F.col(f"{m}_robust_z")), F.lit(0.0)) for m in present], F.lit(0.0), F.lit(0.0))
    out = out.withColumn("adaptive_score", score)
    old = F.btrim(F.coalesce(F.col(flag_column), F.lit(""))) if flag_column in df.columns else F.lit("")
    added = F.when(F.col("adaptive_score") >= z_limit, F.lit("ADAPTIVE_OUTLIER"))
    return out.withColumn(flag_column, F.concat_ws("; ", F.when(old != "", old), added))


def robust_zscore_reference(df: DataFrame, column: str, reference: Column, *, output: str | None = None, keys: list[str] = []) -> DataFrame:
    """(x - median) / (1.4826 MAD) of the reference rows; MAD 0: their sample deviation, else 1; no reference: null."""
    joined = with_scalars(df, keys, median_mad(df, number(column), keys, reference))
    scale = F.coalesce(F.when(F.col("__mad") > 0, MAD_SCALE * F.col("__mad")), F.when(F.col("__std_samp") > 0, F.col("__std_samp")), F.lit(1.0))
    return joined.withColumn(output or f"{column}_robust_z", (number(column) - F.col("__median")) / scale).drop(*SCRATCH)


def normalize_to_controls_robust(df: DataFrame, metric: str, *, group_column: str, control_value: object, output: str | None = None, keys: list[str] = []) -> DataFrame:
    """Robust z against the control group."""
    require(df, metric, group_column)
    return robust_zscore_reference(df, metric, F.col(group_column) == F.lit(control_value), output=output, keys=keys)


def robust_zscore_self(df: DataFrame, column: str, *, output: str | None = None, keys: list[str] = []) -> DataFrame:
    """Self-referenced; scale 1.4826 MAD, else the population deviation, else all 0."""
    joined = with_scalars(df, keys, median_mad(df, number(column), keys))
    scale = F.coalesce(F.when(F.col("__mad") > 0, MAD_SCALE * F.col("__mad")), F.when(F.col("__std_pop") > 0, F.col("__std_pop")))
    z = F.when(number(column).isNotNull(), F.coalesce((number(column) - F.col("__median")) / scale, F.lit(0.0)))
    return joined.withColumn(output or f"{column}_robust_z", z).drop(*SCRATCH)


def normalize_to_controls_ratio(
    df: DataFrame, value: str, control: str, control_value: object, *, method: str = "median", output: str | None = None, keys: list[str] = []
) -> DataFrame:
    """Value over the controls' median or mean; a baseline that is missing or 0 raises when the rows are computed."""
    require(df, value, control)
    if method not in ("median", "mean"):
        raise ValueError("method must be 'median' or 'mean'")
    controls = df.where(F.col(control) == F.lit(control_value))
    base = medians(controls, {"control_baseline": number(value)}, keys) if method == "median" else controls.groupBy(*keys).agg(F.avg(number(value)).alias("control_baseline"))
    joined = with_scalars(df, keys, base)
    usable = F.when(F.coalesce("control_baseline", F.lit(0.0)) != 0, F.col("control_baseline")).otherwise(
        F.raise_error(F.lit("control baseline is missing or zero")).cast("double")
    )
    return joined.withColumn(output or f"{value}_normalized", number(value) / usable)


def percent_control(df: DataFrame, value: str, control: str, control_value: object, *, output: str | None = None, keys: list[str] = []) -> DataFrame:
    """100 times the fraction of the controls' median."""
    name = output or f"{value}_percent_control"
    out = normalize_to_controls_ratio(df, value, control, control_value, output=name, keys=keys)
    return out.withColumn(name, 100 * F.col(name)).drop("control_baseline")


def _two_groups(df: DataFrame, value: str, first: Column, second: Column, keys: list[str]) -> DataFrame:
    v = number(value)
    return df.groupBy(*keys).agg(
        *[
            f(F.when(c, v)).alias(f"__{n}_{g}")
            for g, c in (("a", first), ("b", second))
            for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("var", F.var_samp))
        ]
    )


def z_prime(df: DataFrame, value: str, control: Column, positive: Column, *, keys: list[str] = []) -> DataFrame:
    """1 - 3 (sd+ + sd-) / |difference of means|; null with fewer than two values or equal means."""
    s = _two_groups(df, value, control, positive, keys)
    gap = F.abs(F.col("__mean_b") - F.col("__mean_a"))
    enough = (F.col("__n_a") >= 2) & (F.col("__n_b") >= 2)
    return s.select(*keys, F.when(enough, 1 - 3 * ratio(F.col("__std_a") + F.col("__std_b"), gap)).alias("z_prime"))


def ssmd(df: DataFrame, value: str, control: Column, treatment: Column, *, keys: list[str] = []) -> DataFrame:
    """Difference of means over the root of the mean variance."""
    s = _two_groups(df, value, control, treatment, keys)
    scale = F.sqrt((F.col("__var_a") + F.col("__var_b")) / 2)
    return s.select(*keys, ratio(F.col("__mean_b") - F.col("__mean_a"), scale).alias("ssmd"))


def effect_size(df: DataFrame, value: str, first: Column, second: Column, *, keys: list[str] = []) -> DataFrame:
    """Cohen's d with the pooled variance; fewer than two values: null; no variance: 0."""
    s = _two_groups(df, value, first, second, keys)
    na, nb = F.col("__n_a"), F.col("__n_b")
    pooled = ((na - 1) * F.col("__var_a") + (nb - 1) * F.col("__var_b")) / (na + nb - 2)
    d = F.when((na >= 2) & (nb >= 2), F.when(pooled > 0, (F.col("__mean_a") - F.col("__mean_b")) / F.sqrt(pooled)).otherwise(0.0))
    return s.select(*keys, na.alias("n_a"), nb.alias("n_b"), F.col("__mean_a").alias("mean_a"), F.col("__mean_b").alias("mean_b"), d.alias("effect_size"))


def plate_edge_effect_robust(
    df: DataFrame, metric: str, *, row: str = "well_row", col: str = "well_col", edge_rows: tuple[str, ...] = ("A", "H"), edge_cols: tuple[int, ...] = (1, 12), keys: list[str] = []
) -> DataFrame:
    """Edge and interior medians, their difference, and it in units of the interior's spread."""
    require(df, metric, row, col)
    base = df.select(*keys, number(metric).alias("__m"), (F.col(row).isin(*edge_rows) | F.col(col).isin(*edge_cols)).alias("__edge")).where("__m IS NOT NULL")
    inner = median_mad(base, F.col("__m"), keys, ~F.col("__edge"))
    scale = F.coalesce(F.when(F.col("__mad") > 0, MAD_SCALE * F.col("__mad")), F.when(F.col("__std_samp") > 0, F.col("__std_samp")), F.lit(1.0))
    inner = inner.select(*keys, scale.alias("__scale"))
    counts = base.groupBy(*keys).agg(F.count_if("__edge").alias("edge_n"), F.count_if(~F.col("__edge")).alias("interior_n"))
    middles = medians(base, {"edge_median": F.when(F.col("__edge"), F.col("__m")), "interior_median": F.when(~F.col("__edge"), F.col("__m"))}, keys)
    out = with_scalars(with_scalars(counts, keys, middles), keys, inner).withColumn("difference", F.col("edge_median") - F.col("interior_median"))
    return out.withColumn("robust_effect", F.col("difference") / F.col("__scale")).drop("__scale")


def plate_edge_effect_ratio(df: DataFrame, value: str, *, well: str = "well", keys: list[str] = []) -> DataFrame:
    """Edge and interior medians by the well's name, and their ratio."""
    require(df, value, well)
    row = F.upper(F.substring(F.col(well), 1, 1))
    col = F.expr(f"substring(`{well}`, 2)").try_cast("int")
    edge = row.isin("A", "H") | col.isin(1, 12)
    agg = medians(df, {"edge_median": F.when(edge, number(value)), "interior_median": F.when(~edge, number(value))}, keys)
    return agg.withColumn("edge_interior_ratio", ratio(F.col("edge_median"), F.col("interior_median")))


def plate_qc_summary(df: DataFrame, metrics: list[str], *, control_column: str | None = None, control_value: object = None) -> DataFrame:
    """Per metric: n, mean, median, std and, with controls, the share of values over 3 robust deviations from theirs.

    All metrics are aggregated side by side; medians of all metrics, and then all spreads, are selected together.
    """
    require(df, *metrics)
    names = list(dict.fromkeys(metrics))
    rows = df.select(*[number(m).alias(f"v{k}") for k, m in enumerate(names)], (F.col(control_column) == F.lit(control_value) if control_column else F.lit(False)).alias("control"))
    controls = lambda k: F.when(F.col("control"), F.col(f"v{k}"))
    whole = (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))
    first = [f(f"v{k}").alias(f"{n}{k}") for k in range(len(names)) for n, f in whole]
    middle = {f"median{k}": F.col(f"v{k}") for k in range(len(names))}
    if control_column:
        first += [F.stddev_samp(controls(k)).alias(f"cs{k}") for k in range(len(names))]
        middle |= {f"cm{k}": controls(k) for k in range(len(names))}
    stats = rows.agg(*first).crossJoin(F.broadcast(select_medians(rows, middle)))  # one row
    parts = ["n", "mean", "median", "std"]
    if control_column:
        off = [F.abs(F.col(f"v{k}") - F.col(f"cm{k}")) for k in range(len(names))]
        spread = select_medians(rows.crossJoin(F.broadcast(stats)), {f"cd{k}": F.when(F.col("control"), o) for k, o in enumerate(off)})
        stats = stats.crossJoin(F.broadcast(spread))
        for k in range(len(names)):
            mad, std = F.col(f"cd{k}"), F.col(f"cs{k}")
            stats = stats.withColumn(f"sd{k}", F.coalesce(F.when(mad > 0, MAD_SCALE * mad), F.when(std > 0, std), F.lit(1.0)))
        far = rows.crossJoin(F.broadcast(stats)).agg(*[F.avg((o > 3 * F.col(f"sd{k}")).cast("double")).alias(f"far{k}") for k, o in enumerate(off)])
        stats = stats.crossJoin(F.broadcast(far))
        parts += ["sd", "far"]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{p}{k}").cast("long" if p == "n" else "double").alias(p) for p in parts]) for k, m in enumerate(names)])
    out = stats.select(F.explode(each).alias("s")).select("s.*").withColumn("std", F.coalesce("std", F.lit(0.0)))
    return out.withColumnsRenamed({"sd": "control_robust_sd", "far": "outlier_fraction"})


def b_score(df: DataFrame, value: str, *, row: str = "row", column: str = "column", output: str | None = None, keys: list[str] = []) -> DataFrame:
    """x - row median - column median + grand median, over 1.4826 times the median of its absolute value."""
    require(df, value, row, column)
    v = number(value)
    by_row = df.groupBy(*keys, row).agg(F.median(v).alias("__r"))
    by_col = df.groupBy(*keys, column).agg(F.median(v).alias("__c"))
    grand = medians(df, {"__g": v}, keys)
    out = with_scalars(with_scalars(with_scalars(df, [*keys, row], by_row), [*keys, column], by_col), keys, grand)
    out = out.withColumn("__x", v - F.col("__r") - F.col("__c") + F.col("__g"))
    spread, scale = out.groupBy(*keys).agg(F.stddev_pop("__x").alias("__s2")), medians(out, {"__s1": F.abs(F.col("__x"))}, keys)
    out = with_scalars(with_scalars(out, keys, spread), keys, scale)
    used = F.coalesce(F.when(F.col("__s1") > 0, MAD_SCALE * F.col("__s1")), F.when(F.col("__s2") > 0, F.col("__s2")), F.lit(1.0))
    return out.withColumn(output or f"{value}_b_score", F.col("__x") / used).drop("__r", "__c", "__g", "__x", "__s1", "__s2")


def plate_uniformity(df: DataFrame, value: str, *, keys: list[str] = []) -> DataFrame:
    """n, median, MAD and the robust coefficient of variation (null where the median is 0)."""
    s = median_mad(df, number(value), keys)
    cv = ratio(MAD_SCALE * F.col("__mad"), F.abs(F.col("__median")))
    return s.select(*keys, F.col("__n").alias("n"), F.col("__median").alias("median"), F.col("__mad").alias("mad"), cv.alias("robust_cv"))


def classify_z_prime(z: Column, *, excellent: float = 0.5, marginal: float = 0.0) -> Column:
    """PASS, MARGINAL or FAIL; a value that isn't finite raises when it is computed."""
    if not marginal <= excellent:
        raise ValueError("marginal must not exceed excellent")
    bad = z.isNull() | F.isnan(z) | (F.abs(z) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("z_prime must be finite")).cast("string")).when(z >= excellent, "PASS").when(z >= marginal, "MARGINAL").otherwise("FAIL")


def assay_qc_decision(df: DataFrame, z: str = "z_prime", *, excellent: float = 0.5, marginal: float = 0.0) -> DataFrame:
    status = classify_z_prime(F.col(z), excellent=excellent, marginal=marginal)
    reason = F.format_string("Z-prime %.4f: excellent >= %.2f, marginal >= %.2f", F.col(z), F.lit(float(excellent)), F.lit(float(marginal)))
    return df.select("*", status.alias("status"), reason.alias("reason"), F.lit(excellent).alias("excellent_threshold"), F.lit(marginal).alias("marginal_threshold"))


