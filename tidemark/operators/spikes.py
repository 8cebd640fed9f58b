"""Implausible readings of many sources, each judged by its own normal behaviour.

Three checks on the distinct readings of a source and day:

* range: negative, a zero where none may be, sides of a quote crossed;
* spike: logarithms are split into weekday level, robust trend and residual; the outliers
  among a source's residuals are told by the generalised extreme studentised deviate
  sequence with robust deviations, and where asked must also be beyond the tail of all
  sources, as a source of few days says little of how far it may move;
* constant run: the same reading on several successive days present.

Sources are cut into blocks of days with a margin on either side, so a task holds a bounded
stretch of one source, and all sources of a batch are worked on at once in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

REACH = 3
MIN_DATES = 5


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    if x <= 0:
        return 0.0
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return out * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


@lru_cache(maxsize=None)
def _t_quantile(p: float, df: int) -> float:
    """Student's t quantile for ``p`` over a half, by bisection."""
    lo, hi = 0.0, 1.0
    tail = lambda t: _beta_share(df / 2, 0.5, df / (df + t * t)) / 2
    while tail(hi) > 1 - p and hi < 1e12:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return (lo + hi) / 2


@lru_cache(maxsize=None)
def esd_limit(n: int, i: int, alpha: float) -> float:
    """Critical value of the ``i``-th extreme studentised deviate of ``n`` values (infinite where too few are left)."""
    m = n - i + 1
    if m < 3:
        return math.inf
    t = _t_quantile(1 - alpha / (2 * m), m - 2)
    return (m - 1) * t / math.sqrt((m - 2 + t * t) * m)


def generalised_esd(group: np.ndarray, residual: np.ndarray, scale: np.ndarray, alpha: float, share: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """``(outlier, deviate)`` of residuals around zero, each group by its own generalised ESD sequence.

    The largest deviate of a group is taken out and the rest is studentised anew, up to
    ``share`` of its values; the outliers are all those up to the last deviate that is over
    its critical value. The deviation is robust: 1.4826 times the median size of the
    residuals left, or the group's ``scale`` where that is more. NaN is no value.
    """
    size, out, deviate = np.abs(residual), np.zeros(len(residual), bool), np.full(len(residual), np.nan)
    at = np.flatnonzero(~np.isnan(residual))
    if not len(at):
        return out, deviate
    at = at[np.lexsort((size[at], group[at]))]
    g, s = group[at], size[at]
    n = np.bincount(g, minlength=len(scale))
    start = np.concatenate(([0], n.cumsum()[:-1]))
    left = np.arange(len(at)) - start[g] + 1  # values left when this one, the largest of them, is judged
    middle = (s[start[g] + (left - 1) // 2] + s[start[g] + left // 2 - (left // 2 == left)]) / 2
    deviate[at] = s / np.maximum(1.4826 * middle, scale[g])
    rank = n[g] - left + 1
    asked = rank <= np.maximum((n * share).astype(np.int64), 1)[g]
    pairs, which = np.unique(np.stack([n[g][asked], rank[asked]]), axis=1, return_inverse=True)
    limit = np.array([esd_limit(int(a), int(b), alpha) if a >= MIN_DATES else math.inf for a, b in pairs.T])[which.reshape(-1)]
    over = asked.copy()
    over[asked] = deviate[at][asked] > limit
    last = np.zeros(len(scale), np.int64)
    np.maximum.at(last, g[over], rank[over])
    out[at] = rank <= last[g]
    return out, deviate


def _group_median(code: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Median of the non-NaN values of each group (NaN for none)."""
    ok = ~np.isnan(x)
    code, x = code[ok], x[ok]
    order = np.lexsort((x, code))
    code, x = code[order], x[order]
    size = np.bincount(code, minlength=n)
    start = np.concatenate(([0], size.cumsum()[:-1]))
    out = np.full(n, np.nan)
    has = size > 0
    lo, hi = start + np.maximum(size - 1, 0) // 2, start + size // 2
    out[has] = (x[lo[has]] + x[hi[has]]) / 2
    return out


def _row_median(m: np.ndarray) -> np.ndarray:
    """Median of the non-NaN values of each row of a narrow matrix (NaN for none)."""
    m = np.sort(m, 1)
    n = (~np.isnan(m)).sum(1)
    at = np.arange(len(m))
    return (m[at, np.maximum(n - 1, 0) // 2] + m[at, np.where(n > 0, n // 2, 0)]) / 2


def _around(values: np.ndarray, group: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """For each date the nearest dates with a value within its group, before and after it; NaN beyond it."""
    n = len(values)
    used = np.flatnonzero(~np.isnan(values))
    out = []
    for count, side in ((before, -1), (after, 1)):
        m = np.full((n, count), np.nan)
        if len(used):
            at = np.searchsorted(used, np.arange(n), "left" if side < 0 else "right")
            for k in range(count):
                j = at - 1 - k if side < 0 else at + k
                ok = (j >= 0) & (j < len(used))
                i = used[np.clip(j, 0, len(used) - 1)]
                ok &= group[i] == group
                m[ok, k] = values[i[ok]]
        out.append(m)
    return out[0], out[1]


def spikes_of(group: np.ndarray, day: np.ndarray, value: np.ndarray, alpha: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(spike, residual, deviate)`` of readings sorted by group and day; a day may hold several readings.

    Logarithms are split into weekday level, trend and residual. The trend follows the
    readings as far as the medians of the dates before and after bound them, so a lasting
    move is trend at once and leaves no residual, and what stands out against both sides is
    residual. The outliers of a group's residuals are those of its generalised ESD sequence.
    """
    x = np.where(value > 0, np.log(np.where(value > 0, value, 1)), np.nan)
    date = np.concatenate(([True], (group[1:] != group[:-1]) | (day[1:] != day[:-1]))).cumsum() - 1
    n_dates, n_groups = date[-1] + 1, group[-1] + 1
    first = np.flatnonzero(np.concatenate(([True], date[1:] != date[:-1])))
    date_group = group[first]
    week = date_group * 5 + (day[first] + 3) % 7 % 5
    found = np.zeros(len(x), bool)
    # Twice: first against the medians of the dates around, which other spikes can't move;
    # then what was found no longer counts as anybody's neighbour or usual move, and the
    # nearest dates tell best.
    for reach in (REACH, 1):
        good = np.where(found, np.nan, x)
        rep = _group_median(date, good, n_dates)
        several = np.bincount(date[~np.isnan(good)], minlength=n_dates) > 1
        if several.any():
            # Of several readings of a day the one nearest its neighbours stands for the day.
            near = _row_median(np.hstack(_around(rep, date_group, REACH, REACH)))
            far = np.where(np.isnan(near[date]), 0, np.abs(good - near[date]))
            order = np.lexsort((far, date))
            order = order[~np.isnan(good[order])]
            d0, at = np.unique(date[order], return_index=True)
            rep[d0] = good[order[at]]
        # Seasonal part: the median departure of a weekday, kept only where a weekday has enough dates.
        smooth = _row_median(np.hstack((*_around(rep, date_group, 2, 2), rep[:, None])))
        level = np.where(np.bincount(week, minlength=n_groups * 5) >= 8, np.nan_to_num(_group_median(week, rep - smooth, n_groups * 5)), 0)[week]
        rep = rep - level
        before, after = _around(rep, date_group, REACH, REACH)
        # Usual move: from one date to the next, as a robust deviation; a stuck reading tells of none.
        moves = np.abs(rep - before[:, 0])
        usual = 1.4826 * _group_median(date_group, np.where(moves > 0, moves, np.nan), n_groups)
        sides = np.stack([_row_median(m[:, :reach]) for m in (before, after)])[:, date]
        detrended = x - level[date]
        residual = detrended - np.clip(detrended, sides.min(0), sides.max(0))
        now, deviate = generalised_esd(group, residual, np.maximum(np.nan_to_num(usual), floor), alpha)
        found = now
    return found, residual, deviate


def constant_runs(group: np.ndarray, day: np.ndarray, readings: list[np.ndarray], length: int) -> np.ndarray:
    """Which readings repeat the one before in a run of ``length`` or more successive days present."""
    n = len(group)
    new_date = np.concatenate(([True], (group[1:] != group[:-1]) | (day[1:] != day[:-1])))
    date = new_date.cumsum() - 1
    ok = np.ones(n, bool)
    for r in readings:
        ok &= ~np.isnan(r)
    at = np.flatnonzero(ok)
    order = at[np.lexsort((date[at], *[r[at] for r in reversed(readings)], group[at]))]
    if not len(order):
        return np.zeros(n, bool)
    same = np.ones(len(order) - 1, bool)
    for r in (group, *readings):
        same &= r[order][1:] == r[order][:-1]
    same &= np.diff(date[order]) == 1
    run = np.concatenate(([0], (~same).cumsum()))
    size = np.bincount(run)[run]
    first = np.concatenate(([True], ~same))
    out = np.zeros(n, bool)
    out[order] = (size >= length) & ~first
    return out


#: Steps of the counted sizes and log deviates of residuals.
STEP = 0.005


def tail_limit(counts: dict[int, int], n: int, chance: float, enough: int = 100) -> float:
    """The size that a share ``chance`` of ``n`` readings is beyond if the upper tail goes on as it falls.

    ``counts`` holds how many residuals are in each step of size. The tail is exponential
    from the tenth largest share on, its scale taken between there and the thirtieth of a
    hundred largest of those, which a few spikes can't move. Fewer than ``enough`` residuals
    tell of no tail: the limit is minus infinity.
    """
    total = sum(counts.values())
    if total < enough:
        return -math.inf
    bins = np.array(sorted(counts, reverse=True))
    beyond = np.cumsum([counts[b] for b in bins])
    at = lambda share: (bins[np.searchsorted(beyond, share * total)] * STEP, beyond[np.searchsorted(beyond, share * total)])
    (u, n_u), (v, n_v) = at(0.1), at(0.03)
    return float(u + (v - u) / math.log(n_u / n_v) * math.log(n_u / n / chance)) if n_u > n_v else -math.inf


def implausible(df: DataFrame, *, source: str, day: str, row_id: str, readings: tuple[str, ...], zero_ok: tuple[bool, ...], crossed: bool = False, run: int = 5, alpha: float = 1e-4, floor: float = 0.003, chance: float | None = None, block_days: int = 2048, margin_days: int = 96) -> DataFrame:
    """``row_id, reason`` of rows whose reading is implausible for its source.

    ``readings`` are one value or the two sides of a quote, judged one by one (a run needs
    all of them the same). ``floor`` is the least usual move of a source, of the logarithm.
    With ``chance`` an outlier must also be larger, by its size or by how many usual moves
    it is, than all but that share of readings would be by the tail of all sources' residuals:
    of a source of few days its own moves say too little. Sources of fewer than five days
    with neighbours have no spikes. Null readings are never a case and neither are rows without
    source or day. Repeats of a reading on one day are reduced to one before any task sees
    them and all get its verdict. A row may come with several reasons. Empty input gives
    empty output.
    """
    values = [F.col(r).cast("double") for r in readings]
    base = df.select(F.col(source).cast("string").alias("_s"), F.unix_date(F.col(day).cast("date")).alias("_d"), *(F.when(~F.isnan(v), v + F.lit(0.0)).alias(f"_r{i}") for i, v in enumerate(values)), F.col(row_id).cast("bigint").alias("_id"))
    base = base.where("_s is not null and _d is not null")
    names = [f"_r{i}" for i in range(len(readings))]
    distinct = base.groupBy("_s", "_d", *names).agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    b = F.floor(F.col("_d") / block_days)
    cut = distinct.select("*", F.explode(F.array_distinct(F.array(b, F.floor((F.col("_d") - margin_days) / block_days), F.floor((F.col("_d") + margin_days) / block_days)))).alias("_b"))
    cut = cut.withColumn("_own", F.col("_b") == b).repartition("_s", "_b").sortWithinPartitions("_s", "_b", "_d", *names)
    k = len(readings)
    sizes, deviates = [f"_x{i}" for i in range(k)], [f"_y{i}" for i in range(k)]
    columns = ["_s", "_d", *names, "_id", "_n", *sizes, *deviates]

    def judge(t: pd.DataFrame) -> pd.DataFrame:
        key = (t["_s"].to_numpy()[1:] != t["_s"].to_numpy()[:-1]) | (t["_b"].to_numpy()[1:] != t["_b"].to_numpy()[:-1])
        group = np.concatenate(([0], key.cumsum()))
        d, own = t["_d"].to_numpy(), t["_own"].to_numpy()
        r = [t[n].to_numpy(np.float64, na_value=np.nan) for n in names]
        low = np.zeros(len(t), bool)
        spike, tails = low.copy(), []
        t = t.assign(**dict.fromkeys([*sizes, *deviates], np.nan))
        for i in range(k):
            low |= (r[i] < 0) | ((r[i] == 0) & (not zero_ok[i]))
            found, residual, deviate = spikes_of(group, d, r[i], alpha, floor)
            spike |= found
            size, deviate = np.abs(residual), np.log(np.maximum(deviate, 1e-9))
            t.loc[found, [sizes[i], deviates[i]]] = np.stack([size, deviate], 1)[found]
            if chance is not None:
                # How many residuals are how large goes out beside the outliers; -1 counts all readings.
                has = own & ~np.isnan(size)
                for name, x in (("size", size), ("deviate", deviate)):
                    steps, n = np.unique((x[has & (size > 0)] / STEP).astype(np.int64), return_counts=True)
                    tails.append(pd.DataFrame({"_s": str(i), "_d": steps, "_n": n, "reason": name}))
                tails.append(pd.DataFrame({"_s": [str(i)], "_d": [0], "_n": [int(has.sum())], "reason": ["all"]}))
        if crossed:
            low |= r[1] < r[0]
        stuck = constant_runs(group, d, r, run)
        out = [t.loc[x & own, columns].assign(reason=n) for n, x in (("range", low), ("spike", spike), ("constant", stuck))]
        return pd.concat([x for x in (*out, *tails) if len(x)] or out).reindex(columns=[*columns, "reason"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in it:
            t = batch.to_pandas()
            if not len(t):
                continue
            last = (t["_s"] == t["_s"].iloc[-1]) & (t["_b"] == t["_b"].iloc[-1])
            held.append(t[~last])
            whole = pd.concat(held) if len(held) > 1 else held[0]
            if last.all() and held and len(whole) and whole["_s"].iloc[-1] == t["_s"].iloc[-1] and whole["_b"].iloc[-1] == t["_b"].iloc[-1]:
                held.append(t)
                continue
            # Groups that ended go out; the one still open is held.
            open_ = (whole["_s"] == t["_s"].iloc[-1]) & (whole["_b"] == t["_b"].iloc[-1])
            done = whole[~open_]
            if len(done):
                yield from pa.Table.from_pandas(judge(done.reset_index(drop=True)), schema=schema, preserve_index=False).to_batches()
            held = [whole[open_], t[last]]
        if held and len(rest := pd.concat(held)):
            yield from pa.Table.from_pandas(judge(rest.reset_index(drop=True)), schema=schema, preserve_index=False).to_batches()

    doubles = lambda cs: [(c, pa.float64()) for c in cs]
    schema = pa.schema([("_s", pa.string()), ("_d", pa.int32()), *doubles(names), ("_id", pa.int64()), ("_n", pa.int64()), *doubles([*sizes, *deviates]), ("reason", pa.string())])
    kinds = {"_s": "string", "_d": "int", "_id": "bigint", "_n": "bigint", "reason": "string"}
    found = materialise(cut.mapInArrow(batches, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in schema.names)))
    cases = found.where(F.col("reason").isin("range", "spike", "constant"))
    if chance is not None:
        # A row for each step of size that occurs.
        steps = found.where(~F.col("reason").isin("range", "spike", "constant")).groupBy("_s", "reason", "_d").agg(F.sum("_n").alias("n")).collect()
        beyond = F.lit(False)
        for i in range(k):
            n = sum(r["n"] for r in steps if r["_s"] == str(i) and r["reason"] == "all")
            limit = {m: tail_limit({r["_d"]: r["n"] for r in steps if r["_s"] == str(i) and r["reason"] == m}, n, chance) for m in ("size", "deviate")}
            beyond |= F.coalesce((F.col(sizes[i]) > limit["size"]) | (F.col(deviates[i]) > limit["deviate"]), F.lit(False))
        cases = cases.where((F.col("reason") != "spike") | beyond)
    alone = cases.where("_n = 1").select(F.col("_id").alias("row_id"), "reason")
    again = cases.where("_n > 1").select("_s", "_d", *names, "reason")
    on = [base[c].eqNullSafe(again[c]) for c in ("_s", "_d", *names)]
    return alone.unionAll(base.join(again.hint("merge"), on).select(F.col("_id").alias("row_id"), "reason"))
