"""Fiducial points of pulses and heartbeats, as tables: samples (record, idx from 0, x) and beats (record, beat, at).

A beat's windows are ranges of samples.  Ranges meet samples by an equi join on cells, so the
work is linear in the samples of the windows, and a record of any length is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flags, r6, ratio
from .events import range_join


def _order(*by: str) -> Window:
    return Window.partitionBy("record").orderBy(*by)


def tops(samples: DataFrame, reach: int, above: float = 0.0) -> DataFrame:
    """Beats: samples that are the first of the highest within ``reach`` on both sides, and exceed ``above``: record, beat from 0, at, n.

    n is the number of samples of the record.
    """
    w = _order("idx")
    before = F.max("x").over(w.rowsBetween(-reach, -1))
    after = F.max("x").over(w.rowsBetween(1, reach))
    rows = samples.withColumns({"before": before, "after": after})
    found = rows.where((F.col("x") > F.col("before")) & (F.col("x") >= F.col("after")) & (F.col("x") > above))
    n = samples.groupBy("record").agg((F.max("idx") + 1).alias("n"))
    return found.select("record", (F.row_number().over(w) - 1).cast("long").alias("beat"), F.col("idx").alias("at")).join(n, "record")


def bounds(beats: DataFrame, left: int, right: int) -> DataFrame:
    """Adds prev and next: the neighbouring beats, at the ends ``left`` before and ``right`` after, within the record."""
    w = _order("at")
    prev = F.coalesce(F.lag("at").over(w), F.greatest(F.col("at") - left, F.lit(0)))
    return beats.withColumns({"prev": prev, "next": F.coalesce(F.lead("at").over(w), F.least(F.col("at") + right, F.col("n") - 1))})


def inside(samples: DataFrame, beats: DataFrame, start: Column, end: Column, width: int, *keep: str) -> DataFrame:
    """The samples of each beat's range [start, end): record, beat, idx, x and the columns ``keep`` of beats."""
    ranges = beats.where(end > start).select("record", "beat", *keep, start.alias("start"), end.alias("end"))
    rows = range_join(samples.select("record", F.col("idx").alias("t"), "x"), ranges, float(width))
    return rows.select("record", "beat", F.col("t").alias("idx"), "x", "start", *keep)


def extreme(samples: DataFrame, beats: DataFrame, start: Column, end: Column, width: int, name: str, largest: bool, turn: bool = False, size: bool = False) -> DataFrame:
    """Adds ``name`` to beats: the first place of the least (or largest) sample in [start, end), null in an empty range.

    ``turn``: the first local extreme strictly within the range instead, where there is one.
    ``size``: by the absolute value.
    """
    rows = inside(samples, beats, start, end, width)
    x = F.abs("x") if size else F.col("x")
    value = -x if largest else x
    rows = rows.select("record", "beat", "idx", value.alias("v"))
    where = F.min(F.struct("v", "idx"))["idx"]
    if turn:
        w = Window.partitionBy("record", "beat").orderBy("idx")
        rows = rows.withColumn("turns", (F.col("v") < F.lag("v").over(w)) & (F.col("v") < F.lead("v").over(w)))
        where = F.coalesce(F.min(F.when(F.col("turns"), F.col("idx"))), where)
    return beats.join(rows.groupBy("record", "beat").agg(where.alias(name)), ["record", "beat"], "left")


def pulse_fiducials(samples: DataFrame, beats: DataFrame, rate: float) -> DataFrame:
    """Onset, systolic peak, dicrotic notch and diastolic peak of each pulse (record, beat, at, n).

    The notch is where the slope first stops falling after the peak, else the lowest point; the
    diastolic peak is the first local maximum after it, else the highest point.  A record needs
    three pulses.
    """
    side = max(2, round(0.8 * rate))
    b = bounds(beats, side, side)
    b = b.withColumn("pulses", F.count("*").over(Window.partitionBy("record"))).where("pulses >= 3").drop("pulses")
    b = extreme(samples, b, F.col("prev"), F.col("at") + 1, side, "onset", largest=False)
    post = inside(samples, b, F.col("at"), F.col("next") + 1, side, "next")
    w = Window.partitionBy("record", "beat").orderBy("idx")
    ahead, behind = F.lead("x").over(w) - F.col("x"), F.col("x") - F.lag("x").over(w)
    slope = F.when(behind.isNull(), ahead).when(ahead.isNull(), behind).otherwise((ahead + behind) / 2)
    post = post.withColumn("slope", slope).withColumn("falls", F.lag("slope").over(w) < 0)
    turn = F.min(F.when(F.col("falls") & (F.col("slope") >= 0), F.col("idx")))
    notch = post.groupBy("record", "beat").agg(F.coalesce(turn, F.min(F.struct("x", "idx"))["idx"]).alias("notch"))
    b = b.join(notch, ["record", "beat"], "left")
    start, end = F.col("notch") + max(1, round(0.03 * rate)), F.least(F.col("next"), F.col("notch") + max(2, round(0.45 * rate)))
    b = extreme(samples, b, start, end, side, "diastolic", largest=True, turn=True)
    return b.select("record", "beat", "onset", F.col("at").alias("systolic"), "notch", "diastolic")


def pulse_morphology(samples: DataFrame, beats: DataFrame, rate: float) -> DataFrame:
    """Each pulse between its troughs: amplitude, rise and decay time, width at half height, area and upstroke slope."""
    side = max(2, round(1.2 * rate))
    b = bounds(beats, max(1, round(0.9 * rate)), side)
    b = extreme(samples, b, F.col("prev"), F.col("at") + 1, side, "left", largest=False)
    b = extreme(samples, b, F.col("at"), F.col("next") + 1, side, "right", largest=False)
    at = lambda name: samples.select("record", F.col("idx").alias(name), F.col("x").alias(f"x_{name}"))
    b = reduce(lambda d, name: d.join(at(name), ["record", name]), ("left", "right", "at"), b)
    base = F.least("x_left", "x_right")
    b = b.withColumns({"base": base, "amplitude": F.col("x_at") - base}).where("amplitude > 0").drop("n", "prev", "next", "x_left", "x_right", "x_at")
    rows = inside(samples, b, F.col("left"), F.col("right") + 1, side, "at", "left", "right", "base", "amplitude")
    low = F.col("x") <= F.col("base") + F.col("amplitude") / 2
    over = F.greatest(F.col("x") - F.col("base"), F.lit(0.0))
    ends = F.when((F.col("idx") == F.col("left")) | (F.col("idx") == F.col("right")), over / 2).otherwise(over)
    per = rows.groupBy("record", "beat", "at", "left", "right", "amplitude").agg(
        F.max(F.when(low & (F.col("idx") <= F.col("at")), F.col("idx"))).alias("up"),
        F.min(F.when(low & (F.col("idx") >= F.col("at")), F.col("idx"))).alias("down"),
        F.sum(ends).alias("area"),
    )
    rise = (F.col("at") - F.col("left")) / rate
    return per.select(
        "record", "beat", "amplitude", rise.alias("rise"), ((F.col("right") - F.col("at")) / rate).alias("decay"),
        ((F.coalesce("down", "right") - F.coalesce("up", "left")) / rate).alias("width"), (F.col("area") / rate).alias("area"), (F.col("amplitude") / F.greatest(rise, F.lit(1e-3))).alias("slope"),
    )


def morphology_summary(pulses: DataFrame) -> DataFrame:
    """Medians of the pulses of each record, and the variation of width, area and rise time, of three pulses or more."""
    varies = lambda c: ratio(F.stddev_pop(c), F.median(c))
    out = pulses.groupBy("record").agg(
        F.count("*").alias("pulses"), *[F.median(c).alias(c) for c in ("amplitude", "rise", "decay", "width", "area", "slope")],
        varies("width").alias("width_cv"), varies("area").alias("area_cv"), varies("rise").alias("rise_cv"),
    )
    return out.where("pulses >= 3").select("record", "pulses", *[r6(c).alias(c) for c in out.columns[2:]])


def pulse_proxies(summary: DataFrame) -> DataFrame:
    """Pressure and stiffness evidence of pulse shapes (rise, decay and width in seconds, slope, amplitude): points, flags and risks."""
    fast, narrow = F.col("rise") < 0.12, F.col("width") < 0.22
    steep = F.col("slope") > 2 * F.greatest(F.abs("amplitude"), F.lit(1e-8))
    long_decay = F.try_divide(F.col("decay"), F.col("rise")) > 4
    score = lambda *parts: r6(reduce(Column.__add__, [F.when(test, p).otherwise(0.0) for test, p in parts]))
    pressure, stiff = score((fast, 1.0), (narrow, 0.7), (steep, 0.5)), score((fast, 0.8), (narrow, 0.8), (long_decay, 0.5))
    return summary.select(
        "record", pressure.alias("pressure_score"), F.when(pressure >= 1.2, "higher").otherwise("no_evidence").alias("pressure_risk"),
        stiff.alias("stiffness_score"), F.when(stiff >= 1.2, "elevated").otherwise("not_elevated").alias("stiffness_risk"),
        F.array_join(flags((fast, "fast_rise"), (narrow, "narrow_pulse"), (steep, "steep_upstroke"), (long_decay, "long_decay")), ",").alias("flags"),
    )


def pressure_fiducials(samples: DataFrame, beats: DataFrame, rate: float) -> DataFrame:
    """Onset, peak, dicrotic notch, diastolic peak and end of diastole of each pressure pulse."""
    side = max(2, round(0.8 * rate))
    step = lambda s: max(1, round(s * rate))
    b = bounds(beats, side, side)
    b = extreme(samples, b, F.col("prev"), F.col("at") + 1, side, "onset", largest=False)
    start = F.col("at") + step(0.08)
    b = extreme(samples, b, start, F.greatest(start + 1, F.least(F.col("next"), F.col("at") + step(0.45))), side, "notch", largest=False, turn=True)
    start = F.col("notch") + step(0.03)
    b = extreme(samples, b, start, F.greatest(start + 1, F.least(F.col("next"), F.col("notch") + step(0.35))), side, "diastolic", largest=True, turn=True)
    b = extreme(samples, b, F.coalesce("diastolic", "notch", "at"), F.col("next") + 1, side, "end", largest=False)
    return b.select("record", "beat", "onset", F.col("at").alias("systolic"), "notch", "diastolic", "end")


def missing_shares(points: DataFrame) -> DataFrame:
    """The share of beats that lack each point, by record."""
    names = [c for c in points.columns if c not in ("record", "beat")]
    return points.groupBy("record").agg(F.count("*").alias("beats"), *[r6(F.avg(F.col(c).isNull().cast("double"))).alias(f"no_{c}") for c in names])


def seismo_fiducials(samples: DataFrame, beats: DataFrame, rate: float) -> DataFrame:
    """Valve events about each aortic opening: the largest deflections in windows before (mc, im) and after it (ac, mo)."""
    step = lambda s: round(s * rate)
    b = bounds(beats, step(0.8), step(0.8)).withColumn("gap", F.when(F.lag("at").over(_order("at")).isNotNull(), F.col("at") - F.lag("at").over(_order("at"))))
    cycle = b.groupBy("record").agg((F.median("gap") / rate).alias("cycle"))
    b = b.drop("gap").join(cycle, "record").where("cycle is not null")
    side, at = step(0.5), F.col("at")
    b = extreme(samples, b, at - step(0.16), at - step(0.07) + 1, side, "mc", largest=True, size=True)
    b = extreme(samples, b, at - step(0.08), at - max(1, step(0.005)) + 1, side, "im", largest=True, size=True)
    end = F.round(F.least(F.lit(0.45), F.greatest(F.lit(0.22), 0.7 * F.col("cycle"))) * rate).cast("long")
    b = extreme(samples, b, at + step(0.18), at + end + 1, side, "ac", largest=True, size=True)
    last = F.round(F.least(F.lit(0.3), F.greatest(F.lit(0.1), (F.col("next") - F.col("ac")) / rate - 0.03)) * rate).cast("long")
    b = extreme(samples, b, F.col("ac") + step(0.06), F.col("ac") + last + 1, side, "mo", largest=True, size=True)
    return b.select("record", "beat", "mc", "im", at.alias("ao"), "ac", "mo")


def contractility(points: DataFrame, samples: DataFrame, rate: float) -> DataFrame:
    """Opening to closure in ms, energy in between and size at the opening, medians by record, and a score from the energy."""
    b = points.where("ac is not null").select("record", "beat", F.col("ao").alias("at"), "ac")
    rows = inside(samples, b, F.col("at"), F.col("ac"), max(2, round(0.5 * rate)), "at", "ac")
    per = rows.groupBy("record", "beat", "at", "ac").agg(F.avg(F.col("x") * F.col("x")).alias("energy"), F.max(F.when(F.col("idx") == F.col("at"), F.abs("x"))).alias("size"))
    out = per.groupBy("record").agg(F.count("*").alias("beats"), F.median((F.col("ac") - F.col("at")) * 1000.0 / rate).alias("m"), F.median("energy").alias("e"), F.median("size").alias("s"))
    return out.select("record", "beats", r6("m").alias("ejection_ms"), r6("e").alias("energy"), r6("s").alias("size"), r6(F.least(F.lit(1.0), F.log1p("e") / 3)).alias("score"))


def extra_sounds(envelope: DataFrame, s1: DataFrame, s2: DataFrame, rate: float) -> DataFrame:
    """Third and fourth heart sounds: loud places early and late in diastole (S2 to the next S1), as shares of the cycles.

    envelope: samples; s1, s2: record, at.  Loud is the 72nd percentile; shares from 0.35 raise a flag.
    """
    step = lambda s: round(s * rate)
    line = s1.select("record", "at", F.lit(1).alias("kind")).unionByName(s2.select("record", "at", F.lit(2).alias("kind")))
    ahead = _order("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    next_of = lambda k: F.first(F.when(F.col("kind") == k, F.col("at")), True).over(ahead)
    cycles = line.withColumns({"close": next_of(2), "next": next_of(1)}).where("kind = 1 and next is not null")
    cycles = cycles.select("record", F.row_number().over(_order("at")).cast("long").alias("beat"), F.when(F.col("close") < F.col("next"), F.col("close")).alias("close"), "next")
    c, n = F.col("close"), F.col("next")
    both = extreme(envelope, cycles, c + step(0.08), F.least(n - step(0.06), c + step(0.28)), step(0.5), "early", largest=True)
    both = extreme(envelope, both, F.greatest(c + step(0.06), n - step(0.24)), n - step(0.05), step(0.5), "late", largest=True)
    loud = envelope.groupBy("record").agg(F.percentile("x", F.lit(0.72)).alias("loud"))
    for name in ("early", "late"):
        both = both.join(envelope.select("record", F.col("idx").alias(name), F.col("x").alias(f"x_{name}")), ["record", name], "left")
    out = both.join(loud, "record").groupBy("record").agg(F.count("*").alias("cycles"), *[F.count_if(F.col(f"x_{k}") >= F.col("loud")).alias(k) for k in ("early", "late")])
    s3, s4 = ratio(F.col("early"), F.col("cycles")), ratio(F.col("late"), F.col("cycles"))
    return out.select("record", "cycles", r6(s3).alias("s3_score"), r6(s4).alias("s4_score"), F.array_join(flags((s3 >= 0.35, "possible_s3"), (s4 >= 0.35, "possible_s4")), ",").alias("flags"))


def qrs_widths(samples: DataFrame, beats: DataFrame, rate: float) -> DataFrame:
    """Width at 35 % of the deflection, amplitude and steepness of each complex, medians by record.

    A complex is a beat with 0.16 s on both sides, against the median of its first and last 0.04 s.
    """
    half, edge = max(4, round(0.16 * rate)), max(1, round(0.04 * rate))
    b = beats.where((F.col("at") >= half) & (F.col("at") + half <= F.col("n")))
    rows = inside(samples, b, F.col("at") - half, F.col("at") + half, 2 * half, "at")
    outer = (F.col("idx") < F.col("start") + edge) | (F.col("idx") >= F.col("start") + 2 * half - edge)
    level = rows.groupBy("record", "beat").agg(F.median(F.when(outer, F.col("x"))).alias("level"), F.max("x").alias("top"), F.min("x").alias("low"))
    w = Window.partitionBy("record", "beat").orderBy("idx")
    rows = rows.join(level, ["record", "beat"]).withColumn("step", F.abs(F.col("x") - F.lag("x").over(w)))
    high = F.abs(F.col("x") - F.col("level")) >= 0.35 * F.greatest(F.abs(F.col("top") - F.col("level")), F.abs(F.col("low") - F.col("level")))
    per = rows.groupBy("record", "beat", "top", "low").agg(F.max(F.when(high, F.col("idx"))).alias("last"), F.min(F.when(high, F.col("idx"))).alias("first"), F.percentile("step", F.lit(0.95)).alias("steep"))
    per = per.where(F.col("top") - F.col("low") > 1e-8).withColumn("ms", (F.col("last") - F.col("first") + 1) * 1000.0 / rate)
    out = per.groupBy("record").agg(F.count("*").alias("beats"), F.median("ms").alias("q"), (F.percentile("ms", F.lit(0.75)) - F.percentile("ms", F.lit(0.25))).alias("i"), F.median("steep").alias("s"), F.median(F.col("top") - F.col("low")).alias("a"))
    return out.select("record", "beats", r6("q").alias("qrs_ms"), r6("i").alias("qrs_iqr_ms"), r6("s").alias("steepness"), r6("a").alias("amplitude"))


def conduction_screen(intervals: DataFrame) -> DataFrame:
    """Flags from PR and QRS durations (record, pr_ms, qrs_ms) and a risk."""
    pr, qrs = F.col("pr_ms"), F.col("qrs_ms")
    found = flags((pr > 300, "marked_pr_prolongation"), ((pr > 220) & (pr <= 300), "first_degree_block"), (qrs >= 120, "wide_qrs"), ((qrs >= 110) & (qrs < 120), "borderline_qrs"))
    return intervals.select("record", "pr_ms", "qrs_ms", F.array_join(found, ",").alias("flags"), F.when(F.size(found) > 0, "elevated").otherwise("low").alias("risk"))


def wave_intervals(waves: DataFrame, rr: DataFrame, beats: DataFrame) -> DataFrame:
    """PR, QRS and QT from wave times (record, beat, p_on, qrs_on, qrs_off, t_off in s), the QT corrected by the median interval of rr (record, dt).

    Only plausible durations count; few of them, long ones and a QT corrected beyond 470 ms raise flags.
    beats: record, n, the number of beats.
    """
    span = lambda a, b, low, high: F.when((F.col(b) - F.col(a)).between(low, high), 1000 * (F.col(b) - F.col(a)))
    per = waves.select("record", span("p_on", "qrs_on", 0.06, 0.32).alias("pr"), span("qrs_on", "qrs_off", 0.04, 0.18).alias("qrs"), span("qrs_on", "t_off", 0.18, 0.65).alias("qt"))
    mid = per.groupBy("record").agg(*[F.median(c).alias(c) for c in ("pr", "qrs", "qt")], *[F.count(c).alias(f"n_{c}") for c in ("pr", "qrs", "qt")])
    cycle = rr.where(F.col("dt").between(0.3, 2.5)).groupBy("record").agg(F.median("dt").alias("rr"))
    out = beats.join(mid, "record", "left").join(cycle, "record", "left").fillna(0, ["n_pr", "n_qrs", "n_qt"])
    qtc = F.col("qt") / F.sqrt("rr")
    few = flags((F.col("n_qrs") < F.greatest(F.lit(3), F.floor(0.25 * F.col("n"))), "few_qrs"), (F.col("n_qt") < F.greatest(F.lit(3), F.floor(0.2 * F.col("n"))), "few_qt"))
    found = flags((F.col("qrs") > 120, "wide_qrs"), (qtc > 470, "long_qtc"), (F.col("pr") > 220, "long_pr"))
    return out.select(
        "record", "n", *[r6(c).alias(f"{c}_ms") for c in ("pr", "qrs", "qt")], r6(qtc).alias("qtc_ms"), r6(F.col("qt") / F.cbrt("rr")).alias("qtc_cube_ms"),
        F.array_join(found, ",").alias("flags"), F.array_join(few, ",").alias("quality_flags"), F.when(F.size(found) > 0, "elevated").otherwise("low").alias("risk"),
    )
