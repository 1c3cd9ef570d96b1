"""Planner evaluation: retrieval, rules, set scores, splits, confusion and constraint reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6, ratio
from ..sources.scratch import dealt

#: Letters, digits and underscores make a token; hyphens count as underscores.
TOKEN = "[a-z0-9_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("-"), F.lit("_"))), F.lit(TOKEN), 0)


#: Rows of a table of asked tokens that may be sent to every task.
SMALL = 200_000


def _small(asked: DataFrame) -> DataFrame:
    """asked with a broadcast hint where it is checked to have no more than SMALL rows; else Catalyst joins it as it sees fit."""
    return F.broadcast(asked) if asked.limit(SMALL + 1).count() <= SMALL else asked


#: Pairs of a query and an entry that a task scores.
TASK_PAIRS = 500_000


def _dealt(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog dealt by id, so that counts and scores of an entry stay in its task; a task has TASK_PAIRS pairs of an entry and a query at most, or nearly so."""
    return dealt(catalog, catalog.count() * queries.count(), TASK_PAIRS, "id")


def tfidf_top(queries: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """The k best entries of a catalog (id, text) for each query (q, text).

    A token of the query that an entry holds tf times adds (1 + ln tf) (ln((1 + N) / (1 + df)) + 1),
    as often as the query has it; ties go to the smaller id.

    Entries are dealt by id once, to tasks that grow in number with the pairs; the best k of each task go on.
    """
    asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("token")).groupBy("q", "token").agg(F.count("*").alias("m"))
    words = _dealt(queries, catalog.select("id", "text")).select("id", F.explode(tokens(F.col("text"))).alias("token"))
    held = words.join(_small(asked.select("token").distinct()), "token", "left_semi").groupBy("id", "token").agg(F.count("*").alias("tf"))
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    total = catalog.agg(F.count("*").alias("total"))
    idf = df.crossJoin(total).select("token", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = _small(asked.join(idf, "token").select("q", "token", (F.col("m") * F.col("idf")).alias("weight")))
    score = held.join(weights, "token").groupBy("q", "id").agg(r6(F.sum(F.col("weight") * (1 + F.log("tf")))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return score.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, catalog: DataFrame, k: int, boost: float = 0.5) -> DataFrame:
    """The k entries of a catalog (id, name, modality, text) for queries (q, text, modality), with fallback by modality.

    Candidates are the entries of the query's modality and those of modality any; of a query
    without modality, all.  Scores are those of ``tfidf_top`` plus ``boost`` where a token of the
    query is a word of the name (between underscores and spaces); ties go by name.  With a
    modality the best entries come first and others of it follow by name until there are k.

    Words of names are counted beside those of the text, so an entry is dealt and scored once.
    """
    asked = queries.select("q", "modality", F.explode(tokens(F.col("text"))).alias("token")).groupBy("q", "modality", "token").agg(F.count("*").alias("m"))
    said = lambda words, named: F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.struct(w.alias("token"), F.lit(named).alias("named")))
    words = F.concat(said(tokens(F.col("text")), False), said(F.array_distinct(F.split(F.lower("name"), "[ _-]+")), True))
    words = _dealt(queries, catalog.select("id", "name", "modality", "text")).select("id", "name", F.lower("modality").alias("of"), F.explode(words).alias("w")).select("id", "name", "of", "w.*")
    held = words.join(_small(asked.select("token").distinct()), "token", "left_semi").groupBy("id", "name", "of", "token", "named").agg(F.count("*").alias("tf"))
    idf = held.where("NOT named").groupBy("token").agg(F.count("*").alias("df")).crossJoin(catalog.agg(F.count("*").alias("total")))
    idf = idf.select("token", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    # a word of names that no text holds has no weight, but still names entries
    weights = _small(asked.join(idf, "token", "left").select("q", "modality", "token", (F.col("m") * F.col("idf")).alias("weight")))
    fits = F.col("modality").isNull() | F.col("of").isin("any") | (F.col("of") == F.lower("modality"))
    part = F.when(F.col("named"), 0.0).otherwise(F.col("weight") * (1 + F.log("tf")))
    score = held.join(weights, "token").where(fits).groupBy("q", "id", "name").agg(r6(F.sum(part) + F.when(F.bool_or("named"), boost).otherwise(0.0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "name", "id"))
    best = score.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    first = Window.partitionBy("of").orderBy("name", "id")
    fill = catalog.select("id", "name", F.lower("modality").alias("of")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= 2 * k)
    fill = fill.withColumn("on", F.col("of")).join(queries.where("modality is not null").select("q", F.explode(F.array_distinct(F.array(F.lower("modality"), F.lit("any")))).alias("on")), "on")
    # an entry that follows by name and is among the best keeps its score; one that is not would come after them with it, too
    both = best.unionByName(fill.select("q", "id", "name", F.lit(0.0).alias("score"))).groupBy("q", "id", "name").agg(F.max("score").alias("score"))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("q", "id", "score", "rank")


def replay(queries: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """The known question (id, text) each query (q, text) replays: of equal text, else of most shared tokens, at least ``least``; the smaller id of equals.

    Known questions are dealt by id once, as in ``tfidf_top``; each task counts the tokens its own share with the queries.
    """
    same = queries.join(known, "text").groupBy("q").agg(F.min("id").alias("same"))
    words = lambda d, key: d.select(key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    shared = words(_dealt(queries, known.select("id", "text")), "id").join(_small(words(queries, "q")), "token").groupBy("q", "id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "id"))
    best = shared.withColumn("rank", rank).where("rank = 1").select("q", F.col("id").alias("near"), "n")
    out = queries.select("q").join(same, "q", "left").join(best, "q", "left")
    how = F.when(F.col("same").isNotNull(), "exact").when(F.col("near").isNotNull(), "overlap").otherwise("none")
    return out.select("q", F.coalesce("same", "near").alias("id"), F.when(F.col("same").isNull(), F.col("n")).alias("shared"), how.alias("how"))


def plan_by_keywords(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """Tools for questions (q, text) from rules (keyword, tool, priority): by priority, each once, joined by commas.

    Words of the text meet keywords in an equi join; a keyword must be a word of the text.
    """
    words = questions.select("q", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))).alias("keyword"))
    first = words.join(F.broadcast(rules), "keyword").groupBy("q", "tool").agg(F.min("priority").alias("p"))
    plan = first.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "tool"))), lambda s: s["tool"]), ",").alias("plan"), F.count("*").alias("tools"))
    return questions.select("q").join(plan, "q", "left").select("q", F.coalesce("plan", F.lit("")).alias("plan"), F.coalesce("tools", F.lit(0)).alias("tools"))


def set_scores(cases: DataFrame) -> DataFrame:
    """Precision, recall and F1 of planned against expected sets (id, expected, planned); both empty is perfect."""
    e, p = F.array_distinct("expected"), F.array_distinct("planned")
    hit = F.size(F.array_intersect(e, p))
    rows = cases.select("id", F.size(e).alias("e"), F.size(p).alias("p"), hit.alias("hit"))
    empty = (F.col("e") == 0) & (F.col("p") == 0)
    precision, recall = F.when(empty, 1.0).otherwise(ratio(F.col("hit"), F.col("p"))), F.when(empty, 1.0).otherwise(ratio(F.col("hit"), F.col("e")))
    rows = rows.withColumns({"precision": precision, "recall": recall})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select("id", r6("precision").alias("precision"), r6("recall").alias("recall"), r6(f1).alias("f1"))


def recall_at(ranked: DataFrame, cuts: list[int]) -> DataFrame:
    """Recall at each cut and mean reciprocal rank of the relevant that were found (q, rank, relevant)."""
    whole = Window.partitionBy("q")
    rows = ranked.withColumn("all", F.count_if("relevant").over(whole)).where("all > 0")
    each = rows.groupBy("q").agg(*[(F.count_if(F.col("relevant") & (F.col("rank") <= k)) / F.first("all")).alias(f"r{k}") for k in cuts], F.avg(F.when(F.col("relevant"), 1 / F.col("rank"))).alias("mrr"))
    return each.agg(F.count("*").alias("queries"), *[r6(F.avg(f"r{k}")).alias(f"recall_at_{k}") for k in cuts], r6(F.avg("mrr")).alias("mrr"))


def hash_split(cases: DataFrame, seed: str) -> DataFrame:
    """held_out, dev or train for cases (id, task, modality): first by hash within a stratum (task, modality).

    max(1, round(0.2 n)) are held out where n >= 5, then max(1, round(0.1 n)) are dev where n >= 8; round goes half to even.
    A stratum of any size is ordered in buckets by the first digits of the hash, placed by counts of the buckets before.
    """
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), "task", "modality"), 256)
    rows = cases.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    stratum, bucket = ["task", "modality"], ["task", "modality", "bucket"]
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("size"))
    ahead = F.sum("size").over(Window.partitionBy(*stratum).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"ahead": F.coalesce(ahead, F.lit(0)), "n": F.sum("size").over(Window.partitionBy(*stratum))}).drop("size")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in bucket]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*bucket).orderBy("h"))).alias("r").join(sizes.alias("s"), same)
    rows = rows.select("id", "r.task", "r.modality", "n", (F.col("ahead") + F.col("nth")).alias("k"))
    held = F.when(F.col("n") >= 5, F.greatest(F.lit(1.0), F.bround(0.2 * F.col("n")))).otherwise(0.0)
    dev = F.when(F.col("n") >= 8, F.greatest(F.lit(1.0), F.bround(0.1 * F.col("n")))).otherwise(0.0)
    return rows.select("id", "task", "modality", F.when(F.col("k") <= held, "held_out").when(F.col("k") <= held + dev, "dev").otherwise("train").alias("split"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts and scores of boolean truth and prediction; scores without a denominator are 0."""
    t, p = F.col("truth"), F.col("pred")
    a = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return a.select(
        "tp", "fp", "fn", "tn", r6(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), r6(ratio(tp, tp + fp)).alias("precision"), r6(ratio(tp, tp + fn)).alias("recall"),
        r6(ratio(tn, tn + fp)).alias("specificity"), r6(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Scores of each label (truth, pred) that occurs as a truth, and their mean F1 in every row."""
    side = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    both = pairs.withColumn("hit", (F.col("truth") == F.col("pred")).cast("int")).select("hit", side.alias("s"))
    each = both.groupBy("s.label").agg(F.sum(F.col("s.t")).alias("support"), F.sum("s.p").alias("predicted"), F.sum(F.col("hit") * F.col("s.t")).alias("tp")).where("support > 0")
    f1 = ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    rows = each.withColumn("f", f1).withColumn("m", F.avg("f").over(Window.partitionBy()))
    return rows.select("label", "support", r6(ratio(F.col("tp"), F.col("predicted"))).alias("precision"), r6(ratio(F.col("tp"), F.col("support"))).alias("recall"), r6("f").alias("f1"), r6("m").alias("macro_f1"))


def violations(**checks: DataFrame) -> DataFrame:
    """One table of (check, key) from the rows each check found."""
    out = None
    for name, rows in checks.items():
        part = rows.select(F.lit(name).alias("check"), F.col(rows.columns[0]).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def having_all(rows: DataFrame, values: list[str]) -> DataFrame:
    """Records that hold all the values (record, kind)."""
    return rows.where(F.col("kind").isin(values)).groupBy("record").agg(F.count_distinct("kind").alias("kinds")).where(F.col("kinds") == len(values))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def grounding(reports: DataFrame) -> DataFrame:
    """Numbers in a report (id, text) that one of the known values (array) supports: within max(0.15, 1.5 %)."""
    said = F.transform(F.regexp_extract_all("text", F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), 0), lambda s: s.cast("double"))
    ok = lambda v: F.exists("known", lambda k: F.abs(v - k) <= F.greatest(F.lit(0.15), 0.015 * F.abs(k)))
    rows = reports.withColumn("said", said).withColumn("n", F.size("said")).withColumn("supported", F.size(F.filter("said", ok)))
    return rows.select("id", "n", "supported", r6(F.when(F.col("n") == 0, 1.0).otherwise(F.col("supported") / F.col("n"))).alias("grounded"))
