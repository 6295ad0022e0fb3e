"""Comparison of catalogues, masks, RMS maps and label planes."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.functions.scalars import haversine
from fluxweave.operators.graph import connected_components
from fluxweave.runtime import cut, forget, partitions


def match_candidates(a: DataFrame, b: DataFrame, gate: float) -> DataFrame:
    """Pairs within a separation: catalogues(id, ra, dec, flux) in degrees; a_id, b_id, separation, fluxes.

    Declination bands and right-ascension cells as wide as the gate at the band's highest
    latitude make an equi-join; the exact separation decides. Near a pole the cells widen
    to the whole circle. Both sides grow, so they are merged: a side that looks small after
    compression would not fit the driver as a broadcast.
    """
    band = lambda c: F.floor((F.col(c) + 90) / gate)
    top = lambda k: F.least(F.greatest(F.abs(k * gate - 90), F.abs((k + 1) * gate - 90)) + gate, F.lit(90.0))

    def cells(k):
        """Number of right-ascension cells of a band, each at least the gate wide."""
        width = gate / F.greatest(F.cos(F.radians(top(k))), F.lit(1e-6))
        return F.greatest(F.lit(1), F.floor(360 / width)).cast("long")

    left = a.select(F.col("id").alias("a_id"), F.col("ra").alias("a_ra"), F.col("dec").alias("a_dec"), F.col("flux").alias("a_flux"))
    left = left.withColumn("band", F.explode(F.array(*[band("a_dec") + k for k in (-1, 0, 1)]))).withColumn("_n", cells(F.col("band")))
    at = F.floor(F.pmod("a_ra", F.lit(360.0)) / 360 * F.col("_n"))
    left = left.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.pmod(at + k, F.col("_n")) for k in (-1, 0, 1)]))))
    right = b.select(F.col("id").alias("b_id"), F.col("ra").alias("b_ra"), F.col("dec").alias("b_dec"), F.col("flux").alias("b_flux"))
    right = right.withColumn("band", band("b_dec")).withColumn("_n", cells(F.col("band")))
    right = right.withColumn("cell", F.least(F.floor(F.pmod("b_ra", F.lit(360.0)) / 360 * F.col("_n")), F.col("_n") - 1)).drop("_n")
    apart = haversine(F.col("a_ra"), F.col("a_dec"), F.col("b_ra"), F.col("b_dec"))
    return left.drop("_n").join(right.hint("merge"), ["band", "cell"]).withColumn("separation", apart).where(F.col("separation") <= gate).select("a_id", "b_id", "separation", "a_flux", "b_flux")


def mutual_pairs(candidates: DataFrame) -> DataFrame:
    """(a_id, b_id) that are each other's nearest (ties to the smaller id): one row for each id is joined, not each candidate."""
    best_a = candidates.groupBy("a_id").agg(F.min(F.struct("separation", "b_id")).alias("m")).select("a_id", F.col("m.b_id").alias("b_id"))
    best_b = candidates.groupBy("b_id").agg(F.min(F.struct("separation", "a_id")).alias("m")).select(F.col("m.a_id").alias("a_id"), "b_id")
    return best_a.join(best_b.hint("merge"), ["a_id", "b_id"])


def mutual_nearest(candidates: DataFrame) -> DataFrame:
    """The candidates of mutual pairs, with all their columns."""
    return candidates.join(mutual_pairs(candidates).hint("merge"), ["a_id", "b_id"], "left_semi")


def assign(cost: np.ndarray) -> np.ndarray:
    """Column for each row of a square cost matrix, least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        low, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[col] = True
            r = owner[col]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], back[1:][better] = reduced[better], col
            free = np.where(used[1:], np.inf, low[1:])
            new = int(np.argmin(free)) + 1
            delta = free[new - 1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            col = new
            if owner[col] == 0:
                break
        while col:
            owner[col], col = owner[back[col]], back[col]
    out = np.zeros(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def assign_edges(left: Sequence[int], right: Sequence[int], weight: Sequence[float]) -> list[int]:
    """Index of the edge chosen for each left node 0..n-1, or -1: the most nodes matched, then the least total weight.

    Shortest augmenting paths over the edges alone. Staying unmatched costs (1, 0) and an edge
    (0, weight), compared in this order, so no large number takes digits from the weights.
    """
    n = max(left, default=-1) + 1
    near: list[list[int]] = [[] for _ in range(n)]
    for k, i in enumerate(left):
        near[i].append(k)
    u, v = [(0, 0.0)] * n, {}
    owner: dict[int, int] = {}  # of right nodes; ~i stands for i being unmatched
    chosen, place = [-1] * n, [None] * n
    for root in range(n):
        dist, back, done, heap = {}, {}, {}, []
        at, (high, low) = root, (0, 0.0)
        while True:
            uh, ul = u[at]
            for j, one, w, k in [*((right[k], 0, weight[k], k) for k in near[at]), (~at, 1, 0.0, -1)]:
                if j not in done:
                    vh, vl = v.get(j, (0, 0.0))
                    d = (high + one - uh - vh, low + w - ul - vl)
                    if j not in dist or d < dist[j]:
                        dist[j], back[j] = d, (at, k)
                        heappush(heap, (d, j))
            d, j = heappop(heap)
            while j in done:
                d, j = heappop(heap)
            if j not in owner:
                break
            done[j] = d
            at, (high, low) = owner[j], d
        for r, (h, w) in done.items():
            (vh, vl), (uh, ul) = v.get(r, (0, 0.0)), u[owner[r]]
            v[r], u[owner[r]] = (vh + h - d[0], vl + w - d[1]), (uh + d[0] - h, ul + d[1] - w)
        u[root] = (u[root][0] + d[0], u[root][1] + d[1])
        while j is not None:
            i, chosen_edge = back[j]
            owner[j], chosen[i] = i, chosen_edge
            j, place[i] = place[i], j
    return chosen


def _solve_clusters(pdf: pd.DataFrame, left: str, right: str) -> pd.DataFrame:
    """Each cluster's own matches; a left node without one keeps its row, with nulls."""
    pdf = pdf.sort_values(["_c", left, "_w", right], ignore_index=True)
    keep, free = [], []
    code_l, code_r, w = pd.factorize(pdf[left])[0], pd.factorize(pdf[right])[0], pdf["_w"].tolist()
    first = np.flatnonzero(np.append(True, pdf["_c"].to_numpy()[1:] != pdf["_c"].to_numpy()[:-1])).tolist()
    for lo, hi in zip(first, [*first[1:], len(pdf)], strict=True):
        mine = (code_l[lo:hi] - code_l[lo]).tolist()
        for i, k in enumerate(assign_edges(mine, code_r[lo:hi].tolist(), w[lo:hi])):
            if k >= 0:
                keep.append(lo + k)
            else:
                free.append(lo + mine.index(i))
    out = pdf.iloc[keep + free].drop(columns="_k").astype(object)  # so that ids stay whole numbers beside nulls
    out.iloc[len(keep) :, [k for k, c in enumerate(out.columns) if c not in ("_c", left)]] = None
    return out


def _one_to_one(pairs: DataFrame, weight: Column) -> DataFrame:
    """One-to-one rows of pairs(a_id, b_id, ...): the most pairs, then the least total weight.

    Every id of the side with fewer takes its best partner. Those that want the same partner
    become one cluster, which is solved with all the partners its members know, whoever else
    wants them; clusters that clash are merged and solved again until none do. What each cluster takes is the
    best it could have, so the whole, once nobody clashes, is the best there is. A cluster grows only where ids
    compete, and is the unit of work: at worst it is a component of the pairs, held as edges
    in one task. Among m members only the m best partners of each can matter, as the others take m - 1 at most.

    The pairs are read once a round, restricted to the members at hand.
    """
    spark = pairs.sparkSession
    sizes = pairs.agg(F.approx_count_distinct("a_id").alias("a"), F.approx_count_distinct("b_id").alias("b")).first()
    left, right = ("b_id", "a_id") if sizes["b"] <= sizes["a"] else ("a_id", "b_id")  # either is right; fewer clash less
    rest = [c for c in pairs.columns if c not in (left, right)]
    edges = pairs.withColumn("_w", weight)
    best = edges.groupBy(left).agg(F.min(F.struct("_w", right, *rest)).alias("m"))
    state = cut(best.select(F.col(left).alias("_c"), left, "m.*"), "matches")
    types = ", ".join(f"`{n}` {t}" for n, t in state.dtypes)
    while True:
        wanted = state.where(F.col(right).isNotNull()).groupBy(right).agg(F.min("_c").alias("_low"), F.count("*").alias("_n")).where("_n > 1")
        clashes = cut(state.join(wanted.hint("merge"), right).select("_low", "_c"), "clashes")
        if clashes.isEmpty():
            return state.where(F.col(right).isNotNull()).select(pairs.columns)
        merged = cut(connected_components(clashes, "_low", "_c").select(F.col("node").alias("_c"), "component"), "merged")
        moved = state.join(merged.hint("merge"), "_c").select(left, F.col("component").alias("_c"))
        members = cut(moved.join(moved.groupBy("_c").agg(F.count("*").alias("_m")).hint("merge"), "_c"), "members")
        known = edges.join(members.select(left).hint("merge"), left, "left_semi").join(members.hint("merge"), left)
        rank = F.row_number().over(Window.partitionBy(left).orderBy("_w", right))
        known = known.withColumn("_rank", rank).where("_rank <= _m").select(*state.columns, F.pmod(F.xxhash64("_c"), F.lit(4 * partitions(spark))).alias("_k"))
        solved = known.groupBy("_k").applyInPandas(lambda pdf: _solve_clusters(pdf, left, right), types)  # noqa: B023 - run within the round
        after = cut(state.join(merged.hint("merge"), "_c", "left_anti").select(state.columns).unionByName(solved), "matches")
        for old in (state, clashes, merged, members):
            forget(old)
        state = after


def assign_matches(candidates: DataFrame) -> DataFrame:
    """One-to-one matches: the most pairs, then the least total separation, then the closest fluxes."""
    apart = F.abs(F.col("a_flux") - F.col("b_flux")) / F.greatest(F.abs("a_flux"), F.lit(1e-300))
    return _one_to_one(candidates, F.col("separation") + 1e-9 * F.coalesce(F.nanvl(apart / (1 + apart), F.lit(1.0)), F.lit(1.0)))


def assign_overlaps(overlaps: DataFrame) -> DataFrame:
    """One-to-one label matches: the most pairs, then the most shared pixels. overlaps(a_label, b_label, n_pixels)."""
    pairs = overlaps.select(F.col("a_label").alias("a_id"), F.col("b_label").alias("b_id"), F.col("n_pixels").cast("long").alias("n_pixels"))
    out = _one_to_one(cut(pairs, "overlaps"), -F.col("n_pixels").cast("double"))
    return out.select(F.col("a_id").alias("a_label"), F.col("b_id").alias("b_label"), "n_pixels")


def _share(part, whole, empty: float):
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def compare_masks(pixels: DataFrame) -> DataFrame:
    """Confusion counts and shares of pixels(reference, candidate, valid), with values for empty masks."""
    r, c, v = F.col("reference"), F.col("candidate"), F.col("valid")
    n = pixels.agg(
        F.count_if(v).alias("compared"), F.count_if(~v).alias("excluded"), F.count_if(v & r & c).alias("tp"), F.count_if(v & ~r & ~c).alias("tn"), F.count_if(v & ~r & c).alias("fp"), F.count_if(v & r & ~c).alias("fn")
    )
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return n.select(
        "*", _share(tp + tn, F.col("compared"), 1.0).alias("agreement"), F.when(tp + fp == 0, F.when(tp + fn == 0, 1.0).otherwise(0.0)).otherwise(tp / F.nullif(tp + fp, F.lit(0))).alias("precision"),
        _share(tp, tp + fn, 1.0).alias("recall"), _share(tp, tp + fp + fn, 1.0).alias("iou"),
    )


def compare_rms(pixels: DataFrame) -> DataFrame:
    """Differences of two RMS maps: pixels(reference, candidate), null where not finite."""
    both = F.col("reference").isNotNull() & F.col("candidate").isNotNull()
    d = F.when(both, F.abs(F.col("candidate") - F.col("reference")))
    rel = F.when(both & (F.col("reference") > 0), F.abs(F.col("candidate") - F.col("reference")) / F.nullif("reference", F.lit(0.0)))
    return pixels.agg(
        F.count_if(both).alias("compared"), F.count(rel).alias("relative"), F.count_if(~both).alias("excluded"), F.count_if(both & (F.col("reference") == 0)).alias("zero_reference"),
        F.median(d).alias("median_difference"), F.percentile(d, 0.95).alias("p95_difference"), F.median(rel).alias("median_fraction"), F.percentile(rel, 0.95).alias("p95_fraction"),
    )


def compare_catalogues(reference: DataFrame, candidate: DataFrame, matches: DataFrame) -> DataFrame:
    """Completeness, reliability and differences of matched rows: one row."""
    sizes = reference.agg(F.count("*").alias("n_reference")).crossJoin(candidate.agg(F.count("*").alias("n_candidate")))  # one row each
    rel = (F.col("b_flux") - F.col("a_flux")) / F.nullif("a_flux", F.lit(0.0))
    found = matches.agg(
        F.count("*").alias("n_matched"), F.median("separation").alias("median_separation"), F.percentile("separation", 0.95).alias("p95_separation"),
        F.median(F.abs(rel)).alias("median_flux_fraction"), F.percentile(F.abs(rel), 0.95).alias("p95_flux_fraction"), F.count_if(F.abs(rel) > 0.05).alias("n_outliers"),
    )
    return sizes.crossJoin(found).select("*", _share(F.col("n_matched"), F.col("n_reference"), 1.0).alias("completeness"), _share(F.col("n_matched"), F.col("n_candidate"), 1.0).alias("reliability"))


def compare_islands(overlaps: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts of islands, matches, splits (one reference over several) and merges (one candidate under several)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    split = overlaps.groupBy("a_label").agg(F.count("*").alias("n")).where("n > 1")
    merged = overlaps.groupBy("b_label").agg(F.count("*").alias("n")).where("n > 1")
    joined = matches.join(a_sizes.select(F.col("label").alias("a_label"), F.col("n_pixels").alias("_a")), "a_label").join(b_sizes.select(F.col("label").alias("b_label"), F.col("n_pixels").alias("_b")), "b_label")
    iou = joined.agg(F.avg(F.col("n_pixels") / (F.col("_a") + F.col("_b") - F.col("n_pixels"))).alias("mean_iou"))
    out = one(a_sizes, "n_reference")
    for df, name in ((b_sizes, "n_candidate"), (matches, "n_matched"), (split, "n_split"), (merged, "n_merged")):
        out = out.crossJoin(one(df, name))  # one row each
    return out.crossJoin(iou)


def negative_noise(pixels: DataFrame, box: int, least: int) -> DataFrame:
    """RMS of the negative pixels of each square box; null with fewer than `least` of them."""
    v = F.when(F.col("value") < 0, F.col("value"))
    boxes = pixels.groupBy(F.floor(F.col("y") / box).alias("box_y"), F.floor(F.col("x") / box).alias("box_x"))
    return boxes.agg(F.count(v).alias("n_negative"), F.when(F.count(v) >= least, F.sqrt(F.avg(v * v))).alias("noise"))


def compare_noise(pixels: DataFrame, tolerance: float) -> DataFrame:
    """Pixels(rms, noise) that are inflated or deflated, and the sum of log ratios; both must be positive."""
    ok = pixels.where("rms > 0 and noise > 0").withColumn("_r", F.col("rms") / F.col("noise"))
    return ok.agg(F.count("*").alias("pixels"), F.count_if(F.col("_r") > 1 + tolerance).alias("inflated"), F.count_if(F.col("_r") < 1 / (1 + tolerance)).alias("deflated"), F.sum(F.log("_r")).alias("log_ratio_sum"))


def emission_recall(pixels: DataFrame) -> DataFrame:
    """How much of the ideal emission a mask covers: pixels(mask, ideal, emission, noise)."""
    ok = pixels.where("emission is not null and noise > 0")
    m, i, e = F.col("mask"), F.col("ideal"), F.col("emission")
    return ok.agg(
        F.count_if(i).alias("ideal_pixels"), F.count_if(m & i).alias("covered_pixels"), F.sum(F.when(i, e).otherwise(0.0)).alias("ideal_flux"), F.sum(F.when(m & i, e).otherwise(0.0)).alias("covered_flux"),
        F.count_if(m).alias("mask_pixels"), F.count_if(m & (e < F.col("noise"))).alias("off_emission_pixels"),
    )


def recovery_by_level(outcomes: DataFrame) -> DataFrame:
    """Recovery of injected sources for each S/N level: outcomes(snr, kept, matched, flux_ratio)."""
    return outcomes.groupBy("snr").agg(F.count("*").alias("injected"), F.count_if("kept").alias("kept"), F.count_if("matched").alias("matched"), F.median(F.when(F.col("matched"), F.col("flux_ratio"))).alias("median_flux_ratio"))


def calibration(residuals: DataFrame, value: str = "pull") -> DataFrame:
    """Mean, deviation, coverage and intervals of normalised residuals (t intervals with the normal quantile for large n)."""
    n, z = F.count(value), 1.959963984540054
    return residuals.agg(
        n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("dispersion"), F.avg((F.abs(value) <= 1).cast("double")).alias("coverage_1"), F.avg((F.abs(value) <= 2).cast("double")).alias("coverage_2"),
        (F.avg(value) - z * F.stddev_samp(value) / F.sqrt(n)).alias("mean_low"), (F.avg(value) + z * F.stddev_samp(value) / F.sqrt(n)).alias("mean_high"),
    )


def calibration_by_stratum(residuals: DataFrame) -> DataFrame:
    """Median pull and excess, and coverage, for each stratum: residuals(stratum, excess, pull)."""
    return residuals.groupBy("stratum").agg(F.count("*").alias("n"), F.median("excess").alias("median_excess"), F.median("pull").alias("median_pull"), F.avg((F.abs("pull") <= 1).cast("double")).alias("coverage"))


def occupancy(stages: DataFrame, tasks: DataFrame, workers: int) -> DataFrame:
    """Busy time of tasks within each stage's interval over what the workers had: stages(stage, t0, t1), tasks(t0, t1).

    Stages of a run are few and do not overlap: intervals meet through equal time buckets.
    """
    width = 60.0
    spread = lambda df, p: df.withColumn("_k", F.explode(F.sequence(F.floor(F.col(f"{p}t0") / width), F.floor(F.col(f"{p}t1") / width))))
    s = spread(stages.select("stage", F.col("t0").alias("s_t0"), F.col("t1").alias("s_t1")), "s_")
    t = spread(tasks.select(F.col("t0").alias("t_t0"), F.col("t1").alias("t_t1")), "t_")
    lo = F.greatest("s_t0", "t_t0", F.col("_k") * width)
    hi = F.least("s_t1", "t_t1", (F.col("_k") + 1) * width)
    busy = s.join(t, "_k").where(lo < hi).groupBy("stage").agg(F.sum(hi - lo).alias("busy"))
    return stages.join(busy, "stage", "left").select("stage", F.coalesce("busy", F.lit(0.0)).alias("busy"), (F.coalesce("busy", F.lit(0.0)) / (workers * (F.col("t1") - F.col("t0")))).alias("occupancy"))


def strata(components: DataFrame) -> DataFrame:
    """Stratum of each component by its peak S/N and size in beams."""
    level = F.when(F.col("snr") < 5, "faint").when(F.col("snr") < 20, "medium").otherwise("bright")
    size = F.when(F.col("beams") < 1.5, "compact").otherwise("extended")
    return components.withColumn("stratum", F.concat_ws("-", level, size))


def compare_decisions(components: DataFrame, a_mask: DataFrame, b_mask: DataFrame) -> DataFrame:
    """Components (id, stratum, y, x) kept by either of two masks, by stratum: pixel look-ups."""
    look = lambda df, m, name: df.join(m.select("y", "x", F.lit(True).alias(name)), ["y", "x"], "left")
    both = look(look(components, a_mask, "_a"), b_mask, "_b").fillna(False, ["_a", "_b"])
    return both.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"))


def top_k(rows: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    """The k largest; a heap per task, not a sort."""
    return rows.orderBy(F.desc(value), F.asc(tie)).limit(k)


def point_in_polygon(x, y, corners: list[tuple[float, float]]):
    """Even-odd rule for a fixed polygon."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return inside


def filter_by_mask(sources: DataFrame, mask: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Sources whose truncated pixel is in the mask and whose position is in the polygon."""
    placed = sources.withColumn("y", F.col("py").cast("long")).withColumn("x", F.col("px").cast("long"))
    return placed.join(mask.select("y", "x"), ["y", "x"], "left_semi").where(point_in_polygon(F.col("px"), F.col("py"), corners)).drop("y", "x")
