"""Bootstrap and randomisation over pre-aggregated clusters, with hash-indexed draws.

Rows are reduced to one row per cluster first; replicates are keys. Draw i of replicate b takes
the cluster at position hash(seed, b, i) mod n, so any engine can repeat the draws. The hash is the first
32 bits of the md5 of "seed:b:i", with the stratum after the seed where there is one.

Replicates times clusters is the work, whatever the rows were. It is dealt as pieces of some draws of some
replicates, each a few million hashes, and drawn positions meet the clusters in ranges of positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import stats
from gaugeline.functions.digests import first_words
from gaugeline.operators import quantiles as Q
from gaugeline.operators import scan as S
from gaugeline.session import cut_lineage


DRAWS = 4096  # draws of a replicate in one piece of work
REPLICATES = 500  # replicates in one piece of work
RANGE = 8192  # positions that drawn positions meet at once
PIECES = 2000  # tasks at most, each with one or more pieces


def _spread(pieces: DataFrame) -> DataFrame:
    """Small rows that mean much work, over many tasks."""
    pieces = cut_lineage(pieces)
    return pieces.repartition(max(min(pieces.count(), PIECES), 1))


def _firsts(replicates: int):
    """The first replicate of each piece."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"), F.lit(REPLICATES).cast("bigint")))


def _drawn(sizes: DataFrame, name: str, n: str, replicates: int, seed: int, named: bool = True) -> DataFrame:
    """(name, _range, _first, _draws): drawn positions below ``n`` in a range of positions, for the replicates
    from ``_first``. A draw is replicate * RANGE + position, both counted from the first. ``name`` goes
    into the hash if ``named``."""
    step = F.lit(DRAWS).cast("bigint")
    pieces = sizes.where(F.col(n) > 0).select(F.col(name), F.col(n).alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1, step)).alias("_from"))
    pieces = pieces.select("*", _firsts(replicates).alias("_first"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, size, begin, first in frame.itertuples(index=False, name=None):
                begin, first, size = int(begin), int(first), int(size)
                head = f"{seed}:{key}:" if named else f"{seed}:"
                heads = [f"{head}{b}:" for b in range(first, min(first + REPLICATES, replicates))]
                at = first_words(heads, [str(i) for i in range(begin, min(begin + DRAWS, size))]).astype(np.int64)
                at %= size
                part = (at // RANGE).ravel()
                code = (at % RANGE + np.arange(len(heads))[:, None] * RANGE).ravel().astype("<u4")
                order = np.argsort(part, kind="stable")
                parts, starts = np.unique(part[order], return_index=True)
                told = [piece.tobytes() for piece in np.split(code[order], starts[1:])]
                yield pd.DataFrame({name: pd.Series([key] * len(parts), dtype="object"), "_range": parts, "_first": first, "_draws": told})

    return _spread(pieces).mapInPandas(draw, f"{name} string, _range bigint, _first bigint, _draws binary")


def _ranges(clusters: DataFrame, name: str, order: str, columns: list[str], replicates: int) -> DataFrame:
    """Clusters packed by ranges of positions, each range once for every piece of replicates."""
    row = F.struct((F.col(order) % RANGE).cast("int").alias("at"), *[F.col(c).cast("double").alias(c) for c in columns])
    packed = clusters.groupBy(F.col(name), F.floor(F.col(order) / RANGE).cast("bigint").alias("_range")).agg(F.collect_list(row).alias("_rows"))
    return packed.select(name, "_range", *[F.col(f"_rows.{c}").alias(c) for c in ["at", *columns]], _firsts(replicates).alias("_first"))


def _met(draws: DataFrame, ranges: DataFrame, name: str, told: Callable[[int, np.ndarray, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of ``told(first, times, range)`` for each range and piece of replicates, ``times`` being how often each
    replicate drew each cluster of the range."""
    keys, empty = [name, "_range", "_first"], pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    def meet(drawn: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if drawn.empty or held.empty:
            return empty
        row, code = held.iloc[0], np.frombuffer(b"".join(drawn["_draws"]), "<u4")
        counts = np.bincount(code, minlength=REPLICATES * RANGE).reshape(REPLICATES, RANGE)
        return told(int(row["_first"]), counts[:, np.asarray(row["at"], np.int64)], row)

    return draws.groupBy(*keys).cogroup(ranges.groupBy(*keys)).applyInPandas(meet, schema)


def block_diffs(trials: DataFrame, block: str, arm: str, value: str, a: str = "A", b: str = "B") -> DataFrame:
    """Mean of arm A minus mean of arm B per block; blocks without both arms are dropped."""
    mean = lambda which: F.avg(F.when(F.col(arm) == which, F.col(value)))
    return trials.groupBy(block).agg((mean(a) - mean(b)).alias("diff")).where("diff is not null")


def numbered(clusters: DataFrame, keys: list[str], order: str, width: int = 4096) -> DataFrame:
    """0-based ``pos`` per stratum along a whole-number column, cut into ranges of ``width``."""
    return S.row_index(clusters, keys, [order], S.tick_chunk(order, width), "pos")


def bootstrap_sums(clusters: DataFrame, stratum: str, order: str, sums: list[str], replicates: int, seed: int) -> DataFrame:
    """Per replicate the sums over as many drawn clusters per stratum as it holds. ``clusters`` has
    one row per cluster, numbered by ``order`` inside its stratum through ``pos``."""
    clusters = cut_lineage(clusters.where(F.col(stratum).isNotNull()).withColumn(stratum, F.col(stratum).cast("string")))
    sizes = clusters.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))

    def told(first: int, times: np.ndarray, row: pd.Series) -> pd.DataFrame:
        out = {"replicate": first + np.arange(len(times))}
        for name in sums:
            value = np.asarray(row[name], np.float64)
            odd = ~np.isfinite(value)
            out[name] = times @ np.where(odd, 0.0, value) + np.where(times[:, odd] > 0, value[odd], 0.0).sum(axis=1)
        return pd.DataFrame(out)[times.any(axis=1)]

    schema = "replicate bigint, " + ", ".join(f"{s} double" for s in sums)
    filled = clusters.withColumns({s: F.coalesce(s, F.lit(0)) for s in sums})  # a missing value adds nothing
    part = _met(_drawn(sizes, stratum, "_n", replicates, seed), _ranges(filled, stratum, order, sums, replicates), stratum, told, schema)
    whole = {f.name: isinstance(f.dataType, T.IntegralType) for f in clusters.schema}
    total = lambda s: F.sum(F.coalesce(s, F.lit(float("nan"))))
    return part.groupBy("replicate").agg(*[(total(s).cast("bigint") if whole[s] else total(s)).alias(s) for s in sums])


def sign_flips(diffs: DataFrame, value: str, index: str, method: str = "exact", draws: int = 20000, seed: int = 20260920) -> DataFrame:
    """Two-sided sign-flip test of the mean: over all 2^n sign patterns (``exact``) or over hashed draws
    (``sampled``). ``index`` numbers the diffs from 0. The choice is the caller's, as the two differ."""
    if method not in ("exact", "sampled"):
        raise ValueError(f"unknown method: {method}")
    exact = method == "exact"
    packed = diffs.agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("_d"))
    if exact:  # as many numbers as can be enumerated
        patterns = F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2.0), F.size("_d")).cast("bigint") - 1)
        signs = F.aggregate("_d", F.lit(0.0), lambda acc, x: acc + F.when(F.getbit(F.col("m"), x["i"].cast("int")) == 1, -x["v"]).otherwise(x["v"]))
        sums = packed.select("_d", F.explode(patterns).alias("m")).select("m", signs.alias("s"))
    else:
        row = F.struct(F.col(index).cast("string").alias("i"), F.col(value).cast("double").alias("v"))
        packed = diffs.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(index) / DRAWS).alias("_from")).agg(F.collect_list(row).alias("_rows"))
        pieces = packed.select(F.col("_rows.i").alias("i"), F.col("_rows.v").alias("v"), _firsts(draws).alias("_first"))

        def flip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for tails, values, first in frame.itertuples(index=False, name=None):
                    heads = [f"{seed}:{m}:" for m in range(int(first), min(int(first) + REPLICATES, draws))]
                    signs = 1.0 - 2.0 * (first_words(heads, list(tails)) % 2)
                    yield pd.DataFrame({"m": int(first) + np.arange(len(heads)), "s": signs @ np.asarray(values, np.float64)})

        sums = _spread(pieces).mapInPandas(flip, "m bigint, s double").groupBy("m").agg(F.sum(F.coalesce("s", F.lit(float("nan")))).alias("s"))
    seen = diffs.agg(F.abs(F.sum(value)).alias("_o"), F.count(value).alias("_n"))
    hit = (F.abs(F.col("s")) / F.col("_n") >= F.col("_o") / F.col("_n") - 1e-12).cast("double")
    return sums.join(F.broadcast(seen)).agg(F.avg(hit).alias("p_two_sided"), F.lit(exact).alias("exact"), F.count(F.lit(1)).alias("n_perm"))


def logistic_fits(points: DataFrame, keys: list[str], x: str, y: str, weight: str | None = None, rounds: int = 100) -> DataFrame:
    """Two-parameter logistic fits, one per key, all keys advancing one Newton step per round.

    A step needs five sums per key, so a round is one partial aggregation over the rows. Fits
    that separate, diverge, fall or would extrapolate end with ``why`` and no estimate."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    shape = rows.groupBy(*keys).agg(F.min("_y").alias("_y0"), F.max("_y").alias("_y1"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"))
    one_class = F.col("_y0") == F.col("_y1")
    state = cut_lineage(shape.select(
        *keys, "_x0", "_x1", F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.when(one_class, "one_class").alias("why"), (~one_class).alias("_live"),
    ))
    for _ in range(rounds):
        live = state.where("_live")
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("b0") + F.col("b1") * F.col("_x"), F.lit(35.0)), F.lit(-35.0))))
        step = rows.join(live.select(*keys, "b0", "b1"), keys).select(*keys, "_x", "_y", "_w", p.alias("_p"))
        step = step.withColumn("_v", F.col("_p") * (1 - F.col("_p")))
        g, h = F.col("_w") * (F.col("_y") - F.col("_p")), F.col("_w") * F.col("_v")
        sums = step.groupBy(*keys).agg(
            F.sum(h).alias("_a"), F.sum(h * F.col("_x")).alias("_b"), F.sum(h * F.col("_x") ** 2).alias("_c"), F.sum(g).alias("_g0"), F.sum(g * F.col("_x")).alias("_g1"), F.min("_v").alias("_vmin"),
        )
        det = F.col("_a") * F.col("_c") - F.col("_b") ** 2
        d0 = F.when(det != 0, (F.col("_c") * F.col("_g0") - F.col("_b") * F.col("_g1")) / det)
        d1 = F.when(det != 0, (F.col("_a") * F.col("_g1") - F.col("_b") * F.col("_g0")) / det)
        moved = state.join(sums, keys, "left").withColumns({"_n0": F.col("b0") + d0, "_n1": F.col("b1") + d1, "_d": F.greatest(F.abs(d0), F.abs(d1))})
        ed = -F.col("_n0") / F.col("_n1")
        settled = F.col("_d") < 1e-10
        why = (
            F.when(~F.col("_live"), F.col("why")).when(F.col("_vmin") < 1e-10, "separation").when(F.col("_d").isNull(), "singular")
            .when(F.greatest(F.abs("_n0"), F.abs("_n1")) > 1e3, "diverged").when(settled & (F.col("_n1") <= 0), "slope")
            .when(settled & ~ed.between(F.col("_x0") - 1, F.col("_x1") + 1), "extrapolated")
        )
        goes_on = F.col("_live") & why.isNull() & ~settled
        keep = ~F.col("_live")
        state = cut_lineage(moved.select(
            *keys, "_x0", "_x1", F.when(keep, F.col("b0")).otherwise(F.col("_n0")).alias("b0"), F.when(keep, F.col("b1")).otherwise(F.col("_n1")).alias("b1"), why.alias("why"), goes_on.alias("_live"),
        ))
        if state.where("_live").isEmpty():
            break
    why = F.when(F.col("_live"), "rounds").otherwise(F.col("why"))
    ok = why.isNull()
    return state.select(
        *keys, ok.alias("converged"), F.coalesce(why, F.lit("")).alias("why"), F.when(ok, F.col("b0")).alias("b0"), F.when(ok, F.col("b1")).alias("b1"),
        F.when(ok, F.pow(F.lit(10.0), -F.col("b0") / F.col("b1"))).alias("ed50"),
    )


def dose_bracket(points: DataFrame, keys: list[str], x: str, hit: str) -> DataFrame:
    """Largest miss below the smallest hit: geometric midpoint. Otherwise the number of pairs in
    the wrong order, from ranked counts."""
    h, m = F.when(F.col(hit), F.col(x)), F.when(~F.col(hit), F.col(x))
    per = points.groupBy(*keys).agg(F.count(h).alias("n_hits"), F.count(m).alias("n_misses"), F.max(m).alias("top_miss"), F.min(h).alias("low_hit"))
    wrong = Q.ranked_sums(points.withColumn("_miss", ~F.col(hit)), keys, x, "_miss").select(*keys, F.col("n_at_or_above").alias("n_inversions"))
    kind = (
        F.when(F.col("n_misses") == 0, "censored_all_hit").when(F.col("n_hits") == 0, "censored_all_miss")
        .when(F.col("top_miss") < F.col("low_hit"), "bracket").otherwise("overlap")
    )
    out = per.join(wrong, keys, "left").withColumn("kind", kind)
    middle = (stats.log_separation(F.col("top_miss")) + stats.log_separation(F.col("low_hit"))) / 2
    return out.select(*keys, "n_hits", "n_misses", "kind", F.when(F.col("kind") == "bracket", F.pow(F.lit(10.0), middle)).alias("ed50"), F.when(F.col("kind") == "overlap", F.col("n_inversions")).alias("n_inversions"))


def bootstrap_ed50(points: DataFrame, x: str, hit: str, pos: str, replicates: int = 2000, seed: int = 20260918, least: float = 0.5) -> DataFrame:
    """One row: median effective dose of ``points`` (one row per cluster, numbered from 0 by ``pos``) with
    95 % percentile bounds over ``replicates`` fits. Where the fit of the points themselves failed, or no
    more than ``least`` of the replicates converged, the dose is the bracket's and there are no bounds.
    Without points all columns are null."""
    rows = cut_lineage(points.select(F.col(pos).alias("pos"), F.col(x).alias("_dose"), stats.log_separation(F.col(x)).alias("_x"), F.col(hit).alias("_hit"), F.lit(0).alias("_all")))
    points = rows.select("pos", "_x", F.col("_hit").cast("int").alias("_y"), F.lit("").alias("_none"))
    sizes = rows.agg(F.count(F.lit(1)).alias("_n")).select("_n", F.lit("").alias("_none"))

    def told(first: int, times: np.ndarray, row: pd.Series) -> pd.DataFrame:
        replicate, place = np.nonzero(times)
        x, y = (np.asarray(row[c], np.float64)[place] for c in ("_x", "_y"))
        return pd.DataFrame({"replicate": first + replicate, "_x": x, "_y": y, "_times": times[replicate, place]})

    schema = "replicate bigint, _x double, _y double, _times bigint"
    drawn, ranges = _drawn(sizes, "_none", "_n", replicates, seed, named=False), _ranges(points, "_none", "pos", ["_x", "_y"], replicates)
    sample = cut_lineage(_met(drawn, ranges, "_none", told, schema).withColumn("_x", F.coalesce("_x", F.lit(float("nan")))))
    fits = logistic_fits(sample, ["replicate"], "_x", "_y", "_times").agg(
        F.count(F.lit(1)).alias("_b"), F.count_if("converged").alias("_c"), F.percentile("ed50", 0.025).alias("_low"), F.percentile("ed50", 0.975).alias("_high"))
    fit = logistic_fits(rows.withColumn("_y", F.col("_hit").cast("int")), ["_all"], "_x", "_y").agg(F.first("converged").alias("_ok"), F.first("ed50").alias("_fit"))
    bracket = dose_bracket(rows, ["_all"], "_dose", "_hit").agg(F.first("ed50").alias("_middle"))
    some = F.col("_b") > 0
    usable = some & F.col("_ok") & (F.col("_c") / F.col("_b") > least)
    return fits.join(F.broadcast(fit)).join(F.broadcast(bracket)).select(
        F.when(some, F.col("_b")).alias("n_boot"), F.when(some, F.col("_c")).alias("n_converged"),
        F.when(usable, "logistic").when(some, "interpolation_fallback").alias("method"), F.when(usable, F.col("_fit")).otherwise(F.col("_middle")).alias("ed50"),
        F.when(usable, F.col("_low")).alias("ed50_low"), F.when(usable, F.col("_high")).alias("ed50_high"))
