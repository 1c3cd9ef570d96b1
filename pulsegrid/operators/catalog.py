"""Catalog, routing, clustering and sequence helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flags, r6, ratio
from ..sources.scratch import dealt, written

#: Pairs of a path's ends that a task holds at once.
TASK_PATHS = 1_000_000


def inverted_index(entries: DataFrame) -> DataFrame:
    """For each tool the sources that name it, sorted, each once (source, tools array)."""
    return entries.select("source", F.explode("tools").alias("tool")).groupBy("tool").agg(F.array_sort(F.collect_set("source")).alias("sources")).select("tool", F.size("sources").alias("n"), F.array_join("sources", ",").alias("sources"))


def universe(tools: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts of tools (tool, modality, kind) and of those with a source (tool), overall, by each dimension and by both."""
    rows = tools.join(sources.select("tool").distinct().withColumn("known", F.lit(1)), "tool", "left")
    m, k = F.grouping("modality") == 1, F.grouping("kind") == 1
    level = F.when(m & k, "overall").when(~m & ~k, "both").when(~m, "modality").otherwise("kind")
    return rows.groupingSets([[], ["modality"], ["kind"], ["modality", "kind"]], "modality", "kind").agg(level.alias("level"), F.count("*").alias("tools"), F.count("known").alias("with_source"))


def closure(edges: DataFrame) -> DataFrame:
    """All (tool, needs) pairs reachable over dependency edges (tool, needs); circles are fine.

    A round has the pairs of all paths shorter than 2 ** k steps and those of exactly 2 ** k: the first are lengthened by
    the second, and the second then join themselves.  So a path is made once, not once for each place where it
    can be cut; there are as many rounds as the logarithm of the longest path, and tasks grow in number with the pairs.
    """
    kept = lambda rows, n: written(dealt(rows, n, TASK_PATHS, "tool", "needs").distinct(), "paths")
    exact = kept(edges.select("tool", "needs"), edges.count())
    paths, made, size = exact.limit(0), 0, exact.count()
    while size:
        paths = kept(paths.unionByName(exact).unionByName(_lengthened(paths, made, exact)), 2 * made + size)
        before, made = made, paths.count()
        if made == before:  # on circles paths go on, but all their pairs are there
            break
        exact = kept(_lengthened(exact, size, exact), made)
        size = exact.count()
    return paths


def _lengthened(paths: DataFrame, rows: int, by: DataFrame) -> DataFrame:
    """The pairs of paths (so many rows) that go on over one of ``by``.  All paths may end at one tool that needs nothing, so those are left out before the join."""
    on = by.select(F.col("tool").alias("needs")).distinct()
    a = dealt(paths, rows, TASK_PATHS, "needs").join(on, "needs", "left_semi").alias("a")
    return a.join(by.alias("b"), F.col("a.needs") == F.col("b.tool")).select("a.tool", "b.needs")


def infer_modality(questions: DataFrame, hints: dict[str, list[str]]) -> DataFrame:
    """The modality whose hint words occur most in a question (q, text): the first in the order given of equals, unknown without hits."""
    hits = [F.struct(sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-k).alias("order"), F.lit(name).alias("modality")) for k, (name, words) in enumerate(hints.items())]
    best = F.greatest(*hits)
    return questions.select("q", best["hits"].alias("hits"), F.when(best["hits"] > 0, best["modality"]).otherwise("unknown").alias("modality"))


def failure_reasons(cases: DataFrame) -> DataFrame:
    """The first reason that holds for a case (id, missing, unexpected, executed, retrieved)."""
    reason = (
        F.when(~F.col("retrieved"), "retrieval_missed")
        .when(F.col("missing") > 0, "plan_missing_tools")
        .when(F.col("unexpected") > 0, "plan_has_unexpected_tools")
        .when(~F.col("executed"), "execution_failed")
        .otherwise("ok")
    )
    return cases.select("id", reason.alias("reason"))


def gap_clusters(points: DataFrame, gap: float) -> DataFrame:
    """Clusters of positions (record, x) that lie within ``gap`` of the one before, with their centre and size.

    Equal positions are in one cluster: both windows read the same sort, so of equals the one that opens a cluster comes first.
    """
    order = Window.partitionBy("record").orderBy("x")
    rows = points.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(order) > gap).cast("int"), F.lit(1))).withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("record", "cluster").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("centre"), r6(F.max("x") - F.min("x")).alias("span"))


def median_spacing(clusters: DataFrame, least: float) -> DataFrame:
    """The median distance of neighbouring centres that lie more than ``least`` apart."""
    step = F.col("centre") - F.lag("centre").over(Window.partitionBy("record").orderBy("centre"))
    return clusters.withColumn("d", step).where(F.col("d") > least).groupBy("record").agg(F.count("*").alias("gaps"), r6(F.median("d")).alias("spacing"))


def tick_duration(text: Column) -> Column:
    """Last minus first of at least four different numbers in a text, else null."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0), lambda s: s.cast("double")))
    return F.when(F.size(numbers) >= 4, F.array_max(numbers) - F.array_min(numbers))


def extremes(samples: DataFrame) -> DataFrame:
    """Local lows (record, idx, x) with the high before and after each, and the depth below the lower of them."""
    order = Window.partitionBy("record").orderBy("idx")
    before, after = F.lag("x").over(order), F.lead("x").over(order)
    rows = samples.withColumns({"high": (F.col("x") > before) & (F.col("x") >= after), "low": (F.col("x") < before) & (F.col("x") <= after)})
    top = F.when(F.col("high"), F.col("x"))
    rows = rows.withColumns({"last": F.last(top, True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "next": F.first(top, True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    lows = rows.where("low and last is not null and next is not null")
    return lows.select("record", "idx", r6("x").alias("low"), r6("last").alias("high_before"), r6("next").alias("high_after"), r6(F.least("last", "next") - F.col("x")).alias("depth"))


def rate_consensus(candidates: DataFrame, width: float = 1.875) -> DataFrame:
    """The bin of rates (record, source, rate, power) that most sources agree on: by sources, then power, then the lower rate."""
    each = candidates.groupBy("record", (F.bround(F.col("rate") / width) * width).alias("bin")).agg(F.count_distinct("source").alias("sources"), r6(F.sum("power")).alias("power"))
    rank = F.row_number().over(Window.partitionBy("record").orderBy(F.desc("sources"), F.desc("power"), "bin"))
    return each.withColumn("k", rank).where("k = 1").select("record", r6("bin").alias("rate"), "sources", "power")


def ranked_candidates(rows: DataFrame, decay: float = 0.85) -> DataFrame:
    """Rank-decayed support of each candidate value (record, value, power): power times decay to its rank."""
    rank = F.rank().over(Window.partitionBy("record").orderBy(F.desc("power"))) - 1
    return rows.withColumn("rank", rank).select("record", "value", F.col("rank").cast("long").alias("rank"), r6(F.col("power") * F.pow(F.lit(decay), F.col("rank"))).alias("support"))


def folds(groups: DataFrame, k: int) -> DataFrame:
    """A fold for each group, so that groups are never split: the first hexadecimal digits of its md5 modulo k."""
    return groups.withColumn("fold", F.conv(F.substring(F.md5(F.col("group").cast("string")), 1, 8), 16, 10).cast("long") % k)


def context_stack(epochs: DataFrame, reach: int) -> DataFrame:
    """Each value with those ``reach`` places before and after, the ends repeated (record, idx, x)."""
    order = Window.partitionBy("record").orderBy("idx")
    whole = Window.partitionBy("record").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = epochs.withColumns({"_a": F.first("x").over(whole), "_b": F.last("x").over(whole)})
    near = [F.coalesce(F.lag("x", k).over(order), F.col("_a")) if k > 0 else F.coalesce(F.lead("x", -k).over(order), F.col("_b")) if k < 0 else F.col("x") for k in range(reach, -reach - 1, -1)]
    return rows.select("record", "idx", F.array(*near).alias("context"))


def padded_sequences(rows: DataFrame, length: int) -> DataFrame:
    """The first ``length`` values (record, idx, x) about their median, scaled, padded with zeros, and how many are real."""
    whole = Window.partitionBy("record")
    mid = F.median("x").over(whole)
    rows = rows.withColumn("m", mid).withColumn("z", ratio(F.col("x") - F.col("m"), 1.4826 * F.median(F.abs(F.col("x") - F.col("m"))).over(whole))).withColumn("k", F.row_number().over(whole.orderBy("idx"))).where(F.col("k") <= length)
    out = rows.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda s: r6(F.least(F.greatest(s["z"], F.lit(-6.0)), F.lit(6.0)))).alias("z"))
    return out.select("record", F.size("z").cast("long").alias("n"), F.concat("z", F.array_repeat(F.lit(0.0), length - F.size("z"))).alias("sequence"))


def tool_profile(tools: DataFrame) -> DataFrame:
    """Kind, evidence, failure modes and limitation of tools (tool, modality, name, text) by words in their name and description."""
    text = F.lower(F.concat_ws(" ", "name", "text"))
    has = lambda c, *words: F.coalesce(F.greatest(*[F.contains(c, F.lit(w)) for w in words], F.lit(False)), F.lit(False))
    kind = F.when(has(text, "_dl", "_cnn", "_ml", "deep", "model", "classif"), "learned").when(has(text, "proxy", "screen_", "estimate_", "risk"), "rule").otherwise("signal_processing")
    evidence = F.when(has(text, "proxy"), "proxy").when(has(text, "trained", "benchmark", "auroc", "f1", "mae"), "benchmarked").when(has(text, "quality", "detect", "compute", "summarize", "estimate"), "algorithmic").otherwise("experimental")
    name, image = F.lower("name"), F.lower("modality") == "image"
    modes = flags(
        (F.lit(True), "artifact_or_motion"), (has(name, "peak", "hrv"), "false_peaks"), (F.lit(True), "low_signal_quality"), (has(name, "digitize") | image, "missing_axis_scale"),
        (has(name, "peak", "hrv"), "missed_peaks"), (F.lit(True), "out_of_distribution"), (has(name, "proxy", "screen"), "proxy_not_diagnostic"), (has(name, "digitize") | image, "unclear_trace"),
    )
    limit = F.when(evidence == "proxy", "screening_only").when(image, "depends_on_visible_trace").when(evidence == "benchmarked", "validated_on_listed_data").otherwise("check_signal_quality")
    return tools.select("tool", kind.alias("kind"), evidence.alias("evidence"), F.array_join(modes, ",").alias("failure_modes"), limit.alias("limitation"))


#: What an ablation switches off: words in the names of tools.
ABLATIONS = {"modality_router": ("classify_modality",), "scale": ("scale", "ocr"), "digitization": ("digitize",), "quality_gate": ("assess_quality",), "learned": ("_dl", "_cnn", "_ml", "classify")}


def ablate(plans: DataFrame, off: str) -> DataFrame:
    """Plans (id, tools array) without the tools that the ablation ``off`` removes, each tool once, in order."""
    kept = F.filter(F.array_distinct("tools"), lambda t: ~F.greatest(*[F.contains(F.lower(t), F.lit(w)) for w in ABLATIONS[off]], F.lit(False)))
    return plans.select("id", F.size(F.array_distinct("tools")).alias("before"), F.size(kept).alias("after"), F.array_join(kept, ",").alias("tools"))


def missing_categories(cases: DataFrame, stage: str) -> DataFrame:
    """Why tools are missing from a case (id, missing array, task, input, modality): the first category that fits."""
    names = F.lower(F.array_join("missing", " "))
    has = lambda *words: F.greatest(*[F.contains(names, F.lit(w)) for w in words], F.lit(False))
    category = (
        F.when(has("classify_modality"), "modality_router")
        .when(has("scale", "ocr", "axis"), "scale_ocr")
        .when(has("digitize") | (F.col("task") == "image_to_signal_digitization") | (F.col("input") == "image"), "image_digitization")
        .when(has("quality"), "quality_gate")
        .when(has("proxy", "screen"), "screening_or_proxy_tool")
        .when(F.contains("modality", F.lit("+")) | (F.col("input") == "session"), "multimodal_tool")
        .otherwise("expected_tool")
    )
    return cases.where(F.size("missing") > 0).select("id", F.concat(F.lit(f"{stage}_"), category, F.lit("_missing")).alias("category"))


def metric_snippets(entries: DataFrame, words: tuple[str, ...] = ("f1", "auroc", "accuracy", "mae", "recall", "specificity")) -> DataFrame:
    """The notes of entries (id, notes array) that name a measure, in order."""
    found = F.filter("notes", lambda n: F.greatest(*[F.contains(F.lower(n), F.lit(w)) for w in words], F.lit(False)))
    return entries.select("id", F.size(found).alias("n"), F.array_join(found, " | ").alias("snippets"))


def plan_cases(cases: DataFrame, backends: list[str]) -> DataFrame:
    """The plan of each case (id, expected, retrieved, replayed and ruled arrays) by each backend: id, backend, tools, plan, note.

    ``none`` plans nothing, ``oracle`` what is expected, ``retrieval`` what was retrieved, ``replay`` a known plan
    and where there is none that of the rules, with a note; every other backend plans by the rules.
    """
    missed = (F.col("backend") == "replay") & (F.size("replayed") == 0)
    chosen = (
        F.when(F.col("backend") == "none", F.array().cast("array<string>"))
        .when(F.col("backend") == "oracle", F.col("expected"))
        .when(F.col("backend") == "retrieval", F.col("retrieved"))
        .when((F.col("backend") == "replay") & ~missed, F.col("replayed"))
        .otherwise(F.col("ruled"))
    )
    rows = cases.withColumn("backend", F.explode(F.array(*[F.lit(b) for b in backends]))).withColumn("plan", F.array_distinct(chosen))
    return rows.select("id", "backend", F.size("plan").alias("tools"), F.array_join("plan", ",").alias("plan"), F.when(missed, "replay_missed").otherwise("").alias("note"))


def session_samples(runs: DataFrame) -> DataFrame:
    """Training samples of sessions from their runs (session, label, modality, tools, result, report): three tasks a session, with
    the request and the answer as JSON.  A session without runs has none; runs stand in order of their label."""
    ordered = F.array_sort(F.collect_list(F.struct("label", "modality", "tools", "result", "report")))
    whole = runs.groupBy("session").agg(ordered.alias("runs"))
    pick = lambda *names: F.transform("runs", lambda r: F.struct(*[r[n].alias(n) for n in names]))
    said = F.array_join(F.filter(F.transform("runs", lambda r: r["report"]), lambda t: F.length(t) > 0), "\n\n")
    tasks = {
        "session_planning": (F.struct("session"), F.struct(pick("label", "modality", "tools").alias("signal_plans"))),
        "session_execution": (F.struct("session", pick("label", "modality", "tools").alias("signal_plans")), F.struct(pick("label", "modality", "result").alias("signal_results"))),
        "session_report": (F.struct("session", pick("label", "modality", "result").alias("signal_results")), F.struct(said.alias("summary"))),
    }
    sample = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.to_json(a).alias("request"), F.to_json(b).alias("answer")) for t, (a, b) in tasks.items()]))
    return whole.select("session", F.size("runs").alias("runs"), sample.alias("s")).select("session", "runs", "s.*")


def tool_levels(tools: DataFrame, primitive: tuple[str, ...], screening: tuple[str, ...]) -> DataFrame:
    """The layer of tools (tool, name): 1 works on raw signals (names of ``primitive``), 3 screens or reports (``screening``), 2 is in between."""
    name = F.lower("name")
    has = lambda words: F.greatest(*[F.contains(name, F.lit(w)) for w in words], F.lit(False))
    level = F.when(has(primitive), 1).when(has(screening), 3).otherwise(2)
    return tools.select("tool", level.cast("long").alias("level"), F.when(level == 1, "signal").when(level == 3, "task").otherwise("representation").alias("layer"))
