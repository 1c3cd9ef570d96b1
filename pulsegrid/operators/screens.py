"""Screens that combine figures of a record into points, flags and a label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import between, flags, r6, ratio, share


def _points(*parts: tuple[Column, float]) -> Column:
    return r6(reduce(Column.__add__, [F.when(test, p).otherwise(0.0) for test, p in parts]))


def session_features(beats: DataFrame, breath: str) -> DataFrame:
    """What the screens read, by record of beats (record, idx, t, x, kind): rate_bpm, rmssd_ms, cv, breaths a minute
    (events of kind ``breath``), perfusion, low_share (of values below 0.35 of the median) and burst_share (of steps above six times the mean step)."""
    w = Window.partitionBy("record").orderBy("idx")
    rows = beats.withColumns({"dt": F.col("t") - F.lag("t").over(w), "step": F.abs(F.col("x") - F.lag("x").over(w))})
    rows = rows.withColumn("ddt", F.col("dt") - F.lag("dt").over(w))
    mid = beats.groupBy("record").agg(F.median("x").alias("level"), (F.percentile("x", F.lit(0.95)) - F.percentile("x", F.lit(0.05))).alias("span"))
    step = rows.groupBy("record").agg(F.avg("step").alias("mean_step"))
    rows = rows.join(mid, "record").join(step, "record")
    out = rows.groupBy("record", "level", "span").agg(
        F.count("*").alias("n"), (60 / F.median(F.when(F.col("dt") > 0, F.col("dt")))).alias("rate"), (1000 * F.sqrt(F.avg(F.col("ddt") * F.col("ddt")))).alias("rmssd"),
        ratio(F.stddev_pop("dt"), F.avg("dt")).alias("cv"), (60 * F.count_if(F.col("kind") == breath) / (F.max("t") - F.min("t"))).alias("breaths"),
        share(F.col("x") < 0.35 * F.col("level")).alias("low"), share(F.col("step") > 6 * F.col("mean_step")).alias("burst"),
    )
    return out.where("n >= 3").select(
        "record", "n", r6("rate").alias("rate_bpm"), r6("rmssd").alias("rmssd_ms"), r6("cv").alias("cv"), r6("breaths").alias("breaths"),
        r6(F.col("span") / (F.abs("level") + 1e-8)).alias("perfusion"), r6("low").alias("low_share"), r6("burst").alias("burst_share"),
    )


def rest_screen(features: DataFrame) -> DataFrame:
    """Rest or sleep from a pulse wave: a slow pulse, much variability, plausible breathing; two flags are compatible."""
    found = flags((F.col("rate_bpm") < 65, "slow_pulse"), (F.col("rmssd_ms") > 35, "high_variability"), (F.col("breaths").between(8, 20), "plausible_breathing"), (F.col("perfusion") > 3, "variable_perfusion"))
    return features.select("record", F.array_join(found, ",").alias("flags"), F.when(F.size(found) >= 2, "rest_compatible").otherwise("wake_or_unclear").alias("state"))


def shock_screen(features: DataFrame, low_perfusion: float = 0.5) -> DataFrame:
    """Low perfusion, many low pulses and a fast rate; elevated from 1.2 points."""
    low, weak, fast = F.col("perfusion") < low_perfusion, F.col("low_share") > 0.45, F.col("rate_bpm") > 110
    score = _points((low, 1.0), (weak, 0.6), (fast, 0.5))
    found = flags((low, "low_perfusion"), (weak, "many_low_pulses"), (fast, "fast_pulse"))
    return features.select("record", score.alias("score"), F.array_join(found, ",").alias("flags"), F.when(score >= 1.2, "elevated").otherwise("low").alias("risk"))


def bed_sleep_screen(features: DataFrame) -> DataFrame:
    """Sleep in bed from mechanical beats: quiet, a resting rate, plausible breathing, regular beats; compatible from 0.65."""
    score = _points((F.col("burst_share") <= 0.08, 0.35), (F.col("rate_bpm").between(40, 85), 0.25), (F.col("breaths").between(8, 24), 0.25), (F.col("cv") < 0.25, 0.15))
    return features.select("record", score.alias("score"), F.when(score >= 0.65, "quiet_rest").otherwise("wake_or_unclear").alias("state"))


def pressure_variation(features: DataFrame, systolic: float, diastolic: float) -> DataFrame:
    """A calibrated baseline with a relative variation index from the size of beats; no pressure is predicted."""
    x = 2 * (F.col("low_share") - 0.25)
    return features.select("record", F.lit(float(systolic)).alias("systolic"), F.lit(float(diastolic)).alias("diastolic"), r6(F.tanh(x)).alias("variation"))


def apnea_evidence(beats: DataFrame, low: float, high: float) -> DataFrame:
    """Evidence of breathing pauses in beat intervals: variation and range of the plausible ones, and how reliable they are."""
    w = Window.partitionBy("record").orderBy("idx")
    rows = beats.withColumn("dt", F.col("t") - F.lag("t").over(w)).where("dt is not null").withColumn("ok", F.col("dt").between(low, high))
    ok = F.when(F.col("ok"), F.col("dt"))
    out = rows.groupBy("record").agg(F.count("*").alias("n"), F.count_if("ok").alias("clean"), F.stddev_pop(ok).alias("sd"), F.avg(ok).alias("mean"), (F.max(ok) - F.min(ok)).alias("range"))
    cv, clean = F.try_divide(F.col("sd"), F.col("mean")), F.col("clean") / F.col("n")
    evidence = flags((cv > 0.1, "variable_intervals"), (F.col("range") > 0.45, "wide_range"))
    doubt = flags((clean < 0.85, "many_removed"), (F.col("clean") < 20, "few_intervals"))
    return out.select(
        "record", "n", r6(clean).alias("clean_ratio"), r6(cv).alias("cv"), r6("range").alias("range_s"), F.array_join(evidence, ",").alias("evidence"), F.array_join(doubt, ",").alias("reliability"),
        F.when(F.size(doubt) == 2, "unreliable").when(F.size(evidence) == 2, "elevated").when(F.size(evidence) == 1, "borderline").otherwise("low").alias("risk"),
    )


def cascade(*methods: tuple[str, DataFrame]) -> DataFrame:
    """The result (record, value) of the first method that has one for a record: record, method, value."""
    rows = [d.where("value is not null").select("record", F.lit(i).alias("nth"), F.lit(name).alias("method"), F.col("value").cast("double").alias("value")) for i, (name, d) in enumerate(methods)]
    best = reduce(DataFrame.unionByName, rows).groupBy("record").agg(F.min(F.struct("nth", "method", "value")).alias("b"))
    return best.select("record", "b.method", r6("b.value").alias("value"))


def quantiles(rows: DataFrame, x: str, shares: tuple[float, ...]) -> DataFrame:
    """Quantiles of x of each record (record, q: an array in order of shares), read at their places in a sort, which spills."""
    order = Window.partitionBy("record").orderBy(x)
    ranked = rows.where(F.col(x).isNotNull()).select("record", F.col(x).alias("x"), (F.row_number().over(order) - 1).alias("k"), (F.count("*").over(Window.partitionBy("record")) - 1).alias("last"))
    at = [F.col("last") * F.lit(p) for p in shares]
    ends = [F.max(F.when(F.col("k") == f(c), F.col("x"))).alias(f"{n}{i}") for i, c in enumerate(at) for n, f in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy("record", "last").agg(*ends)
    parts = F.array(*[F.struct(F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), (c - F.floor(c)).alias("part")) for i, c in enumerate(at)])
    return found.select("record", F.transform(parts, lambda s: between(s["low"], s["high"], s["part"])).alias("q"))


def saturation_features(spo2: DataFrame, rate: float = 1.0, drop: float = 3.0, seconds: float = 10.0) -> DataFrame:
    """A feature vector of saturation readings (record, idx, spo2): moments, percentiles, shares below levels, steps, and
    events of ``seconds`` or more at least ``drop`` below the 90th percentile, also an hour."""
    w = Window.partitionBy("record").orderBy("idx")
    q = (1, 5, 10, 25, 50, 75, 90, 95, 99)
    levels = (95, 93, 90, 88, 85)
    base = quantiles(spo2, "spo2", (0.9, *[p / 100 for p in q])).select("record", F.col("q")[0].alias("base"), F.slice("q", 2, len(q)).alias("q"))
    steps = spo2.withColumn("step", F.coalesce(F.col("spo2") - F.lag("spo2").over(w), F.lit(0.0)) * rate)
    p95 = quantiles(steps.withColumn("step", F.abs("step")), "step", (0.95,)).select("record", F.col("q")[0].alias("step_p95"))
    rows = steps.join(base.select("record", "base"), "record")
    rows = rows.withColumn("low", F.col("spo2") <= F.col("base") - drop).withColumn("nth", F.row_number().over(w))
    runs = rows.where("low").withColumn("island", F.col("nth") - F.row_number().over(w)).groupBy("record", "island").agg(F.count("*").alias("size"))
    events = runs.where(F.col("size") >= max(1, int(seconds * rate))).groupBy("record").agg(F.count("*").alias("events"))
    out = rows.groupBy("record", "base").agg(
        F.count("*").alias("n"), F.avg("spo2").alias("mean"), F.stddev_pop("spo2").alias("sd"), F.min("spo2").alias("least"), F.max("spo2").alias("most"),
        *[share(F.col("spo2") < k).alias(f"below_{k}") for k in levels], share(F.col("low")).alias("low_share"), F.avg("step").alias("step_mean"), F.stddev_pop("step").alias("step_sd"),
        share(F.abs("step") > 1).alias("big_steps"),
    ).join(base.select("record", "q"), "record").join(p95, "record").join(events, "record", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    named = ("base", "mean", "sd", "least", "most", *[f"below_{k}" for k in levels], "low_share", "step_mean", "step_sd", "step_p95", "big_steps")
    return out.select(
        "record", "n", *[r6(c).alias(c) for c in named], r6(F.col("most") - F.col("least")).alias("range"), *[r6(F.col("q")[i]).alias(f"p{p:02d}") for i, p in enumerate(q)],
        "events", r6(F.col("events") / (F.col("n") / rate / 3600)).alias("events_per_hour"),
    )


def clipped(samples: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Samples with missing ones at the median and the others clipped to two percentiles of the record."""
    edges = samples.groupBy("record").agg(F.median("x").alias("mid"), F.percentile("x", F.lit(low)).alias("lo"), F.percentile("x", F.lit(high)).alias("hi"))
    x = F.coalesce("x", "mid")
    return samples.join(edges, "record").select("record", "idx", F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(x, F.col("lo")), F.col("hi"))).otherwise(x).alias("x"))


def gravity(axes: DataFrame) -> DataFrame:
    """The unit of acceleration (record, i, axis, x) by the median magnitude: 9.80665, 1, or the median itself; and the angle
    in degrees between the mean directions of the first and the second half."""
    mag = axes.groupBy("record", "i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("m"))
    base = mag.groupBy("record").agg(F.median("m").alias("median"), ((F.max("i") + 1) / 2).alias("half"))
    scale = F.when(F.col("median").between(5, 15), 9.80665).when(F.col("median").between(0.5, 1.5), 1.0).otherwise(F.greatest("median", F.lit(1e-6)))
    first = F.col("i") < F.col("half")
    mean = axes.join(base, "record").groupBy("record", "axis").agg(F.avg(F.when(first, F.col("x"))).alias("a"), F.avg(F.when(~first, F.col("x"))).alias("b"))
    dot = mean.groupBy("record").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / (F.col("na") * F.col("nb"))))
    angle = F.when((F.col("na") > 1e-12) & (F.col("nb") > 1e-12), F.degrees(F.acos(cos)))
    return base.join(dot, "record").select("record", r6("median").alias("magnitude"), r6(scale).alias("scale"), r6(angle).alias("turn_degrees"))


def channel_features(samples: DataFrame) -> DataFrame:
    """Activation features of each channel (record, channel, idx, x), centred at its median: size, length, steps, duty,
    crossings and slope changes beyond 2 % of the deviation, percentiles of the size, skewness and kurtosis."""
    own = ["record", "channel"]
    mid = samples.groupBy(*own).agg(F.median("x").alias("mid"), F.stddev_pop("x").alias("sd"))
    w = Window.partitionBy(*own).orderBy("idx")
    rows = samples.join(mid, own).withColumns({"x": F.col("x") - F.col("mid"), "thr": F.greatest(0.02 * F.col("sd"), F.lit(1e-7))})
    rows = rows.withColumns({"before": F.lag("x").over(w), "d": F.col("x") - F.lag("x").over(w)}).withColumn("e", F.lag("d").over(w))
    cross = (F.col("x") * F.col("before") < 0) & (F.abs(F.col("x") - F.col("before")) > F.col("thr"))
    turn = (F.col("d") * F.col("e") < 0) & (F.abs(F.col("d") - F.col("e")) > F.col("thr"))
    mean = F.avg("x")
    out = rows.groupBy(*own).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg(F.abs("x")).alias("mav"), F.sum(F.abs("d")).alias("length"), F.var_pop("x").alias("variance"), F.avg(F.abs("d")).alias("step"),
        share(F.abs("x") > F.col("thr")).alias("duty"), (F.count_if(cross) / F.count("*")).alias("crossings"), (F.count_if(turn) / F.greatest(F.count("e"), F.lit(1))).alias("turns"),
        *[F.percentile(F.abs("x"), F.lit(p / 100)).alias(f"abs_p{p}") for p in (50, 75, 90, 95)], mean.alias("m"), F.avg(F.col("x") ** 2).alias("m2"), F.avg(F.col("x") ** 3).alias("m3"), F.avg(F.col("x") ** 4).alias("m4"),
    )
    m, m2, m3, m4 = (F.col(c) for c in ("m", "m2", "m3", "m4"))
    var = m2 - m * m
    skew = F.try_divide(m3 - 3 * m * m2 + 2 * m**3, F.pow(var, 1.5))
    kurt = F.try_divide(m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m**4, var * var) - 3
    names = [c for c in out.columns if c not in (*own, "m", "m2", "m3", "m4")]
    return out.select(*own, *[r6(c).alias(c) for c in names], r6(skew).alias("skewness"), r6(kurt).alias("kurtosis"))


def channel_balance(samples: DataFrame) -> DataFrame:
    """How the channels of a record share its activity: largest to smallest RMS, their variation, and the strongest channel."""
    rms = samples.groupBy("record", "channel").agg((F.sqrt(F.avg(F.col("x") * F.col("x"))) + 1e-12).alias("rms"))
    out = rms.groupBy("record").agg((F.max("rms") / F.min("rms")).alias("r"), (F.stddev_pop("rms") / F.avg("rms")).alias("v"), F.min(F.struct(-F.col("rms"), "channel"))["channel"].alias("strongest"))
    return out.select("record", r6("r").alias("ratio"), r6("v").alias("variation"), "strongest")


def normalized_channels(features: DataFrame, names: list[str]) -> DataFrame:
    """Each feature of a channel relative to its mean size over the channels of the record, and on a logarithmic scale: record, channel, feature, relative, log."""
    long = features.select("record", "channel", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])).alias("f")).select("record", "channel", "f.*")
    mean = F.avg(F.abs("value")).over(Window.partitionBy("record", "feature")) + 1e-6
    return long.select("record", "channel", "feature", r6(F.col("value") / mean).alias("relative"), r6(F.log1p(F.abs("value"))).alias("log"))


def column_features(samples: DataFrame) -> DataFrame:
    """Plain statistics of each channel (record, channel, idx, x): moments, extremes, quartiles, RMS and mean step."""
    w = Window.partitionBy("record", "channel").orderBy("idx")
    rows = samples.withColumn("d", F.abs(F.col("x") - F.lag("x").over(w)))
    out = rows.groupBy("record", "channel").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"), *[F.percentile("x", F.lit(p / 100)).alias(f"p{p}") for p in (25, 50, 75)],
        F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12).alias("rms"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("step"),
    )
    return out.select("record", "channel", *[r6(c).alias(c) for c in out.columns[2:]])
