"""From the weekly funnel to one explained move per pair of weeks.

The weekly funnel has one row per week, channel and device. Everything here
works on it or on less, and for any number of week pairs at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions.events import segment_label
from funnelspark.functions.numeric import money, money_sum, rate_or_zero, safe_divide
from funnelspark.operators.daily import COUNTS, conversion_series
from funnelspark.operators.decompose import decompose_change, dominant_effect, summarize_effects, top_drivers
from funnelspark.operators.series import detect_anomaly
from funnelspark.operators.significance import two_proportion_ztest
from funnelspark.session import materialize

PAIR = ("w0", "w1")

# Bounds of the drill-down.
MIN_SEGMENT_SESSIONS = 500
MIN_RATE_EFFECT = 0.003
DRILL_ALPHA = 0.05
RECONCILE_TOLERANCE = 0.005


def _weekly_conversion(weekly: DataFrame) -> DataFrame:
    """One row per week with the conversion of the week before it in the data."""
    series = conversion_series(weekly).select("week", F.coalesce("conversion", F.lit(0.0)).alias("conversion"))
    by_week = Window.orderBy("week")  # one row per week
    return (
        series.withColumn("previous_week", F.lag("week").over(by_week))
        .withColumn("delta", F.col("conversion") - F.lag("conversion").over(by_week))
    )


def adjacent_pairs(weekly: DataFrame) -> DataFrame:
    """All pairs of consecutive weeks; a missing week is skipped over."""
    moves = _weekly_conversion(weekly).filter(F.col("previous_week").isNotNull())
    return moves.select(F.col("previous_week").alias("w0"), F.col("week").alias("w1"), "delta")


def biggest_move(weekly: DataFrame) -> DataFrame:
    """The adjacent pair with the largest change of conversion, the earliest on a tie.

    A single week is paired with itself.
    """
    pair = F.when(F.col("previous_week").isNotNull(), F.struct(F.col("previous_week").alias("w0"), F.col("week").alias("w1")))
    best = _weekly_conversion(weekly).agg(
        F.min_by(pair, F.when(pair.isNotNull(), F.struct(-F.abs("delta"), F.col("week")))).alias("best"),
        F.struct(F.min("week").alias("w0"), F.max("week").alias("w1")).alias("only"),
    )
    return best.select(F.coalesce("best", "only").alias("pair")).select("pair.*")


def most_anomalous_move(weekly: DataFrame, k: int = 4, z_threshold: float = 2.5, min_history: int = 3) -> DataFrame:
    """The flagged week with the largest |z| and the week before it, else the biggest move."""
    conversion = _weekly_conversion(weekly).withColumn("series_id", F.lit("conversion"))
    scored = detect_anomaly(conversion, "series_id", "week", "conversion", k, z_threshold, min_history)
    # position > 0 is implied: unscored points have z = 0 and are never flagged
    previous = F.lag("week").over(Window.partitionBy("series_id").orderBy("week"))
    flagged = scored.withColumn("previous_week", previous).filter("is_anomaly")
    worst = flagged.agg(
        F.min(F.struct((-F.abs("z")).alias("rank"), F.col("week").alias("w1"), F.col("previous_week").alias("w0"))).alias("worst")
    ).select("worst.w0", "worst.w1", F.lit(1).alias("choice"))
    fallback = biggest_move(weekly).select("w0", "w1", F.lit(2).alias("choice"))
    candidates = worst.filter(F.col("w1").isNotNull()).unionByName(fallback)
    chosen = candidates.agg(F.min_by(F.struct("w0", "w1"), "choice").alias("pair"))
    return chosen.select("pair.*")


def select_move(weekly: DataFrame, selector: str = "anomaly") -> DataFrame:
    selectors = {"anomaly": most_anomalous_move, "delta": biggest_move}
    if selector not in selectors:
        raise ValueError(f"unknown selector {selector!r}")
    return selectors[selector](weekly)


def pair_sides(pairs: DataFrame, period: str, *keys: str) -> DataFrame:
    """Two rows per pair, one for each of its periods, so that facts join on equality.

    A period paired with itself only has a baseline.
    """
    sides = pairs.select(*PAIR, *keys, F.inline(F.array(
        F.struct(F.col("w0").alias(period), F.lit(0).alias("side")),
        F.struct(F.col("w1").alias(period), F.lit(1).alias("side")),
    )))
    return sides.filter((F.col("side") == 0) | (F.col("w0") != F.col("w1"))).distinct()


def _both_sides(columns: dict[str, str]) -> list[Column]:
    """Sums per side as ``<name>_t0`` and ``<name>_t1``; an absent side counts 0."""
    def total(side: int, c: str) -> Column:
        value = F.when(F.col("side") == side, money(c) if c == "revenue" else F.col(c))
        return F.coalesce(F.sum(value), F.lit(0)).cast("double")

    return [total(side, c).alias(f"{name}_t{side}") for side in (0, 1) for name, c in columns.items()]


def week_segments(
    weekly: DataFrame, pairs: DataFrame, dims: Sequence[str] = ("channel_group", "device_category"),
    num: str = "purchasing_sessions", den: str = "sessions", period: str = "week",
) -> DataFrame:
    """Segment counts of both periods side by side, from one conditional sum instead of a self-join."""
    keyed = weekly.join(pair_sides(pairs, period), period)
    return keyed.groupBy(*PAIR, segment_label(*dims).alias("segment")).agg(*_both_sides({"num": num, "den": den}))


def pair_totals(weekly: DataFrame, pairs: DataFrame) -> DataFrame:
    """Funnel counts and revenue of both weeks of each pair."""
    totals = weekly.groupBy("week").agg(*[F.sum(c).alias(c) for c in COUNTS], money_sum("revenue").alias("revenue"))
    columns = [*COUNTS, "revenue"]
    t0 = totals.select(F.col("week").alias("w0"), *[F.col(c).alias(f"{c}_t0") for c in columns])
    t1 = totals.select(F.col("week").alias("w1"), *[F.col(c).alias(f"{c}_t1") for c in columns])
    return pairs.select(*PAIR).distinct().join(t0, "w0", "left").join(t1, "w1", "left")


def funnel_struct(side: int):
    return F.struct(*[F.col(f"{c}_t{side}").alias(c) for c in COUNTS])


def diagnose(weekly: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: change, effects, significance, price, top drivers, both funnels.

    All counts of both weeks are summed per pair and cell once; effects, totals
    and drivers are aggregates of those few rows.
    """
    measures = {c: c for c in (*COUNTS, "revenue")}
    keyed = weekly.join(pair_sides(pairs, "week"), "week")
    cells = keyed.groupBy(*PAIR, segment_label("channel_group", "device_category").alias("segment")).agg(*_both_sides(measures))
    cells = materialize(cells, "pair-cells")
    carried = [f"{c}_t{side}" for c in measures for side in (0, 1)]
    for side in (0, 1):
        cells = cells.withColumn(f"num_t{side}", F.col(f"purchasing_sessions_t{side}")).withColumn(f"den_t{side}", F.col(f"sessions_t{side}"))
    effects = decompose_change(cells, PAIR, carry=carried)

    totals = [
        money_sum(c).alias(c) if c.startswith("revenue") else F.sum(c).cast("long").alias(c) for c in carried
    ]
    summary = two_proportion_ztest(
        summarize_effects(effects, PAIR, totals), "purchasing_sessions_t0", "sessions_t0", "purchasing_sessions_t1", "sessions_t1"
    )
    drivers = top_drivers(effects, PAIR).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct(  # one entry for each segment of the pair
            "driver_rank", "segment",
            (F.col("total") * 100).alias("total_pts"), (F.col("mix") * 100).alias("mix_pts"),
            (F.col("rate") * 100).alias("rate_pts"),
            (F.col("r_t0") * 100).alias("conv_t0_pct"), (F.col("r_t1") * 100).alias("conv_t1_pct"),
            F.bround(F.col("w_t1") * F.col("all_den_t1")).cast("long").alias("sessions_t1"),
        ))).alias("drivers")
    )
    priced = summary.join(drivers, list(PAIR), "left").withColumn("aov", rate_or_zero("revenue_t1", "purchasing_sessions_t1"))
    return priced.select(
        *PAIR, F.col("r_t0").alias("conv_t0"), F.col("r_t1").alias("conv_t1"), "delta",
        "mix", "rate", "interaction", "dominant", "p_value", "significant", "sessions_t1", "aov",
        (F.col("rate") * F.col("sessions_t1") * F.col("aov")).alias("revenue_at_risk"),
        "drivers", funnel_struct(0).alias("funnel_t0"), funnel_struct(1).alias("funnel_t1"), "error",
    )


def _reconciles(measures: Sequence[str], tolerance: float) -> Column:
    """Both sides' sums over a node's siblings agree with what its parent carried, each within the tolerance."""
    agree = [
        F.abs(F.col(f"all_{c}_t{side}") - F.col(f"parent_{c}_t{side}")) <= tolerance * F.abs(F.col(f"parent_{c}_t{side}"))
        for c in measures for side in (0, 1)
    ]
    return reduce(lambda a, b: a & b, agree)


def drill_tree(
    cells: DataFrame, pairs: DataFrame, dims: Sequence[str], period: str = "week",
    branching: int | None = None, min_sessions: int = MIN_SEGMENT_SESSIONS,
    min_rate_effect: float = MIN_RATE_EFFECT, alpha: float = DRILL_ALPHA,
    canonical: DataFrame | None = None, tolerance: float = RECONCILE_TOLERANCE, min_revenue: float = 0.0,
) -> DataFrame:
    """Best-first search for the slice whose own behaviour changed, one dimension per level.

    Every kept slice of one level is split by the next dimension in a single
    batched decomposition. A child is kept when its rate effect is large enough,
    its traffic in the compare period sufficient and its change significant; all
    of them go on, or the strongest ``branching`` of each parent. The search ends
    with the dimensions or when a level keeps nothing. ``cells`` holds
    ``sessions``, ``purchasing_sessions`` and ``revenue`` (none: 0) by period
    and dimensions.

    Counts and money are carried down: a node is priced at (conversion before -
    after) x sessions after x revenue per purchase, and reconciles when it and
    its siblings add up to the totals of their parent; those of the root come
    from ``canonical`` (the same columns by period), or from the cells. A leaf
    is a node without kept children. It is promoted to a finding when it
    reconciles, its rate effect outweighs mix and interaction, and its price is
    more than ``min_revenue``.
    """
    if "revenue" not in cells.columns:
        cells = cells.withColumn("revenue", F.lit(0.0))
    source = {"num": "purchasing_sessions", "den": "sessions", "revenue": "revenue"}
    carried = [f"{c}_t{side}" for side in (0, 1) for c in source]
    root = pairs.select(*PAIR, F.lit("").alias("parent"))
    whole = (cells if canonical is None else canonical).join(pair_sides(root, period, "parent"), period)
    parents = whole.groupBy(*PAIR, "parent").agg(*_both_sides(source))
    levels = []
    path = None
    for depth, dim in enumerate(dims, start=1):
        own = F.concat(F.lit(f"{dim}="), F.coalesce(F.col(dim).cast("string"), F.lit("None")))
        parent_path = F.lit("") if path is None else path
        rows = cells.withColumn("parent", parent_path).withColumn("node", own)
        path = own if path is None else F.concat(parent_path, F.lit(" > "), own)
        sides = pair_sides(parents, period, "parent")
        segments = rows.join(sides, [period, "parent"]).groupBy(*PAIR, "parent", F.col("node").alias("segment")).agg(*_both_sides(source))
        sums = segments.groupBy(*PAIR, "parent").agg(*(F.sum(c).alias(f"all_{c}") for c in carried))
        above = parents.select(*PAIR, "parent", *(F.col(c).alias(f"parent_{c}") for c in carried)).join(sums, [*PAIR, "parent"])
        checked = above.select(*PAIR, "parent", _reconciles(list(source), tolerance).alias("reconciles"))
        effects = decompose_change(segments, (*PAIR, "parent"), carry=[c for c in carried if c.startswith("revenue")])
        tested = two_proportion_ztest(effects, "num_t0", "den_t0", "num_t1", "den_t1", alpha).join(checked, [*PAIR, "parent"])
        kept = tested.filter(
            (F.abs("rate") >= min_rate_effect) & (F.col("den_t1") >= min_sessions) & F.col("significant")
        )
        order = Window.partitionBy(*PAIR, "parent").orderBy(F.abs("rate").desc(), "segment")
        strongest = kept.withColumn("node_rank", F.row_number().over(order))
        if branching is not None:
            strongest = strongest.filter(F.col("node_rank") <= branching)
        value = F.coalesce(safe_divide("revenue_t1", "num_t1"), safe_divide("revenue_t0", "num_t0"), F.lit(0.0))
        nodes = strongest.select(
            *PAIR, F.lit(depth).alias("depth"), "parent",
            F.concat_ws(" > ", F.when(F.col("parent") != "", F.col("parent")), F.col("segment")).alias("node"),
            "node_rank", *carried, "r_t0", "r_t1", "mix", "rate", "interaction", "p_value", "reconciles", value.alias("aov"),
            ((F.col("r_t0") - F.col("r_t1")) * F.col("den_t1") * value).alias("revenue_at_risk"),
        )
        nodes = materialize(nodes, "drill-level")  # few rows that the next level and the result both read
        if depth > 1 and nodes.isEmpty():
            break
        levels.append(nodes)
        parents = nodes.select(*PAIR, F.col("node").alias("parent"), *carried)
    tree = reduce(lambda a, b: a.unionByName(b), levels)
    parent_of = tree.select(*PAIR, F.col("parent").alias("node")).distinct().withColumn("split", F.lit(True))
    marked = tree.join(parent_of, [*PAIR, "node"], "left").withColumn("leaf", F.col("split").isNull()).drop("split")
    rate_story = dominant_effect() == "rate"
    return marked.withColumn("promoted", F.col("leaf") & F.col("reconciles") & rate_story & (F.abs("revenue_at_risk") > min_revenue))


def identity_check(totals: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Checks two identities per row of funnel totals.

    revenue per session = conversion x order value, within the reconcile
    tolerance, and conversion = reach of the first step x the step rates.
    """
    rps = rate_or_zero("revenue", "sessions")
    conversion = rate_or_zero("purchasing_sessions", "sessions")
    aov = rate_or_zero("gross_revenue", "orders")
    chain = (
        rate_or_zero("view_item_sessions", "sessions")
        * rate_or_zero("add_to_cart_sessions", "view_item_sessions")
        * rate_or_zero("begin_checkout_sessions", "add_to_cart_sessions")
        * rate_or_zero("purchasing_sessions", "begin_checkout_sessions")
    )
    checked = totals.select(
        "*", rps.alias("revenue_per_session"), conversion.alias("conversion"), aov.alias("aov"), chain.alias("step_product")
    )
    return checked.select(
        "*",
        (F.abs(F.col("revenue_per_session") - F.col("conversion") * F.col("aov")) <= tolerance * F.abs("revenue_per_session")).alias("revenue_identity"),
        (F.abs(F.col("conversion") - F.col("step_product")) <= 1e-9).alias("conversion_identity"),
    )
