"""Rule labels for financial distress."""

from __future__ import annotations

import tomllib
from importlib import resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import period_index, ratio

# The coefficients, the value of the fourth term without liabilities, and the thresholds.
WORKING_CAPITAL, RETAINED, EARNINGS, EQUITY = 6.56, 3.26, 6.72, 1.05
NO_LIABILITIES = 99.0
DISTRESS, SAFE = 1.1, 2.6
WARNINGS = ("high_debt_to_asset", "low_current_ratio", "negative_equity", "two_quarter_net_loss", "weak_interest_coverage")


def previous_quarter(df: DataFrame) -> DataFrame:
    """Adds the quarter before's net income, null unless it is the quarter just before."""
    order = Window.partitionBy("ticker").orderBy("report_period")
    gap = period_index(F.col("report_period")) - period_index(F.lag("report_period").over(order))
    return df.withColumn("previous_net_income", F.when(gap == 1, F.lag("net_income").over(order)))


def z_score() -> Column:
    """Four-term score rounded half up to 4 places; null if an input is null or assets are not positive."""
    c = F.col
    assets = c("total_assets")
    fourth = F.when(c("total_liabilities") == 0, F.lit(NO_LIABILITIES)).otherwise(ratio(c("equity"), c("total_liabilities")))
    z = (
        WORKING_CAPITAL * ratio(c("current_assets") - c("current_liabilities"), assets)
        + RETAINED * ratio(c("retained_earnings"), assets)
        + EARNINGS * ratio(c("ebit"), assets)
        + EQUITY * F.when(c("equity").isNotNull(), fourth)
    )
    return F.round(z, 4)


def warning_flags() -> dict[str, Column]:
    """Each warning as a boolean; unknown is false."""
    c = F.col
    raw = {
        "high_debt_to_asset": ratio(c("total_liabilities"), c("total_assets")) > 0.8,
        "low_current_ratio": ratio(c("current_assets"), c("current_liabilities")) < 1,
        "negative_equity": c("equity") < 0,
        "two_quarter_net_loss": (c("net_income") < 0) & (c("previous_net_income") < 0),
        "weak_interest_coverage": ratio(c("ebit"), c("interest_expense")) < 1,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in raw.items()}


def excluded(path: str | None = None) -> dict[str, list[str]]:
    """Names and codes of the sectors that the score does not cover, read anew from the given or the package's TOML file."""
    file = resources.files("tidemark").joinpath("configs/sector_exclusion.toml").read_text("utf-8") if path is None else open(path, encoding="utf-8").read()
    return tomllib.loads(file)


def is_financial(*names: Column, sector_code: Column | None = None, code: Column | None = None, config: str | None = None) -> Column:
    """Whether one of the names (sector, industry) is an excluded one, trimmed and in any case, the sector code is an excluded
    one, or the first two digits of the full code are."""
    terms = excluded(config)
    out = F.lit(False)
    for name in names:
        out = out | F.coalesce(F.lower(F.trim(name)).isin(*[s.strip().lower() for s in terms["sectors"]]), F.lit(False))
    for c, digits in ((sector_code, None), (code, 2)):
        if c is not None:
            text = F.trim(c.cast("string"))
            out = out | F.coalesce((F.substring(text, 1, digits) if digits else text).isin(*terms["codes"]), F.lit(False))
    return out


def label(df: DataFrame, sector: str | None = "sector") -> DataFrame:
    """Adds z_score, warnings, distress_label, distress_reason, label_confidence, training_eligible."""
    financial = is_financial(F.col(sector)) if sector else F.lit(False)
    df = previous_quarter(df).withColumn("__fin", financial).withColumn("z_score", F.when(~F.col("__fin"), z_score()))
    flags = warning_flags()
    df = df.withColumn("__warnings", F.array_compact(F.array(*[F.when(flags[k], F.lit(k)) for k in WARNINGS])))
    z, many, fin = F.col("z_score"), F.size("__warnings") >= 2, F.col("__fin")
    value = F.when(fin, None).when(z.isNull() & many, 1).when(z.isNull(), None).when((z < DISTRESS) | many, 1).otherwise(0)
    confidence = F.when(fin, None).when(z.isNull() & many, "medium").when(z.isNull(), None).when(z < DISTRESS, "high").when(many, "medium").when(z > SAFE, "high").otherwise("low")
    eligible = F.coalesce(confidence.isin("high", "medium"), F.lit(False))
    extra = (
        F.when(z.isNull() & many, "z_score_null")
        .when(z.isNull(), "insufficient_data")
        .when(z < DISTRESS, "z_score_distress_zone")
        .when(many, None)
        .when(z > SAFE, "z_score_safe_zone")
        .otherwise("gray_zone_monitor")
    )
    capped = F.when((F.col("total_liabilities") == 0) & z.isNotNull(), "zero_liabilities_x4_capped")
    reasons = F.array_distinct(F.concat("__warnings", F.array_compact(F.array(extra, capped))))
    reason = F.when(fin, F.lit("financial_sector_excluded")).otherwise(F.array_join(reasons, ";"))
    return (
        df.withColumn("n_warnings", F.size("__warnings"))
        .withColumn("distress_label", value)
        .withColumn("distress_reason", reason)
        .withColumn("label_confidence", confidence)
        .withColumn("training_eligible", eligible)
        .drop("__fin", "__warnings")
    )
