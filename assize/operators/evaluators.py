"""Judge metrics over paired rows (answer, parse_failed, and the truth's columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.functions.scoring import matches
from assize.functions.stats import kendall_tau_b, pearson, safe_ratio
from assize.functions.text import id_cell, id_domain

#: What each benchmark compares and which parses it counts as failed.
MODES = {
    "BBH": {"how": "exact", "integer": False},
    "FeedbackBench": {"how": "int", "integer": True},
    "MMLU-STEM": {"how": "casefold", "integer": False},
    "reward-bench": {"how": "exact", "integer": False},
    "RM-Bench": {"how": "casefold", "integer": False},
    "XSUM_faithfulness": {"how": "casefold", "integer": False},
    "XSUM_coherence": {"how": "int", "integer": True},
    "XSUM_relevance": {"how": "int", "integer": True},
}

#: Subset sizes and sections of the pairwise benchmark.
SUBSET_SIZES = {
    "alpacaeval-easy": 100, "alpacaeval-length": 95, "alpacaeval-hard": 95, "mt-bench-easy": 28, "mt-bench-med": 40, "mt-bench-hard": 37,
    "math-prm": 984, "refusals-dangerous": 100, "refusals-offensive": 100, "llmbar-natural": 100, "llmbar-adver-neighbor": 134,
    "llmbar-adver-GPTInst": 92, "llmbar-adver-GPTOut": 47, "llmbar-adver-manual": 46, "xstest-should-refuse": 154, "xstest-should-respond": 250,
    "donotanswer": 136, "hep-cpp": 164, "hep-go": 164, "hep-java": 164, "hep-js": 164, "hep-python": 164, "hep-rust": 164,
}
SECTIONS = {
    "Chat": ["alpacaeval-easy", "alpacaeval-length", "alpacaeval-hard", "mt-bench-easy", "mt-bench-med"],
    "Chat Hard": ["mt-bench-hard", "llmbar-natural", "llmbar-adver-neighbor", "llmbar-adver-GPTInst", "llmbar-adver-GPTOut", "llmbar-adver-manual"],
    "Safety": ["refusals-dangerous", "refusals-offensive", "xstest-should-refuse", "xstest-should-respond", "donotanswer"],
    "Reasoning": ["math-prm", "hep-cpp", "hep-go", "hep-java", "hep-js", "hep-python", "hep-rust"],
}


def choose_datasets(names: list[str], known: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Known names (all for "all") and unknown ones, which are to be reported; no known name is an error."""
    known = list(MODES) if known is None else known
    if "all" in names:
        return list(known), []
    good = [n for n in names if n in known]
    if not good:
        raise ValueError(f"none of {names} is among {known}")
    return good, [n for n in names if n not in known]


def _right(how: str, truth: str) -> Column:
    return matches(F.col("answer"), F.col(truth), how) & ~F.col("parse_failed")


def accuracy(paired: DataFrame, groups: list[str], how: str = "exact", truth: str = "score") -> DataFrame:
    """Per group: n, failed, correct, valid_accuracy (of the parsed rows, null answers among them) and raw_accuracy (of all)."""
    g = paired.withColumn("_right", _right(how, truth)).groupBy(*groups)
    g = g.agg(F.count(F.lit(1)).alias("n"), F.count_if("parse_failed").alias("failed"), F.count_if("_right").alias("correct"))
    return g.withColumn("valid_accuracy", safe_ratio(F.col("correct"), F.col("n") - F.col("failed"))).withColumn("raw_accuracy", safe_ratio(F.col("correct"), F.col("n")))


def agreement(paired: DataFrame, groups: list[str], truth: str = "score") -> DataFrame:
    """``accuracy`` on ints, with Pearson's r and Kendall's tau-b over the parsed rows, rounded to 4; null where undefined."""
    from assize.plans.lineage import settle

    a, g = F.col("answer").try_cast("int").alias("a"), F.col(truth).try_cast("int").alias("g")
    cells = paired.select(*groups, "parse_failed", a, g, _right("int", truth).alias("right")).groupBy(*groups, "parse_failed", "a", "g", "right").agg(F.count(F.lit(1)).alias("c"))
    cells = settle(cells, "cells")  # one row for each pair of values: all three parts read it
    good = ~F.col("parse_failed") & F.col("a").isNotNull() & F.col("g").isNotNull()
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0).cast("bigint"))
    base = cells.groupBy(*groups).agg(F.coalesce(F.sum("c"), F.lit(0).cast("bigint")).alias("n"), of(F.col("parse_failed")).alias("failed"), of(F.col("right")).alias("correct"), F.round(pearson(F.when(good, F.col("a")), F.when(good, F.col("g")), F.col("c")), 4).alias("pearson_r"))
    base = base.withColumn("valid_accuracy", safe_ratio(F.col("correct"), F.col("n") - F.col("failed"))).withColumn("raw_accuracy", safe_ratio(F.col("correct"), F.col("n")))
    tau = kendall_tau_b(cells.where(good), "a", "g", groups, "c").withColumn("kendall_tau", F.round("tau", 4)).drop("tau")
    if groups:
        tau = tau.select(*[F.col(k).alias(f"_{k}") for k in groups], "kendall_tau")
        out = base.join(tau, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in groups], "left")
    else:
        out = base.join(F.broadcast(tau), how="left")  # one row each
    return out.select(*groups, "n", "failed", "correct", "valid_accuracy", "raw_accuracy", "pearson_r", "kendall_tau")


def accuracy_by_subject(paired: DataFrame, subject: str, how: str = "casefold", truth: str = "score") -> DataFrame:
    """Per subject, in its order: total, correct, failed, accuracy of all rows."""
    g = paired.withColumn("_right", _right(how, truth)).groupBy(subject)
    g = g.agg(F.count(F.lit(1)).alias("total"), F.count_if("_right").alias("correct"), F.count_if("parse_failed").alias("failed"))
    return g.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total"))).orderBy(subject)


def micro_average(by_subject: DataFrame) -> DataFrame:
    """Overall total, correct, failed and accuracy from the subjects' sums."""
    g = by_subject.agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.sum("failed").alias("failed"))
    return g.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total")))


def subset_accuracy(paired: DataFrame, subset: str = "subset", how: str = "exact", truth: str = "score") -> DataFrame:
    """Per subset: n and accuracy of all rows."""
    return paired.withColumn("_right", _right(how, truth)).groupBy(F.col(subset).alias("subset")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_right").cast("int")).alias("accuracy"))


def section_scores(subsets: DataFrame, sections: DataFrame) -> DataFrame:
    """Weighted score of each section over its subsets that are present; 0 for a section without any.

    ``subsets`` has subset, accuracy; ``sections`` has section, subset, weight.
    """
    j = sections.join(subsets.select("subset", "accuracy"), "subset", "left")
    weight = F.sum(F.when(F.col("accuracy").isNotNull(), F.col("weight")))
    return j.groupBy("section").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("accuracy") * F.col("weight")), weight), F.lit(0.0)), 6).alias("score"))


def section_average(scores: DataFrame) -> DataFrame:
    """Unweighted mean of all sections, zeros included."""
    return scores.agg(F.round(F.avg("score"), 6).alias("average"))


def benchmark_sections(spark) -> DataFrame:
    """The fixed sections as a table (section, subset, weight)."""
    return spark.createDataFrame([(k, s, float(SUBSET_SIZES[s])) for k, v in SECTIONS.items() for s in v], "section string, subset string, weight double")


def style_matrix(paired: DataFrame, id: str = "id", truth: str = "score") -> DataFrame:
    """Per domain and cell (i, j): hits over a ninth of the domain's rows, so that missing cells weigh down."""
    i, j = id_cell(F.col(id))
    hit = matches(F.col("answer"), F.col(truth), "casefold").cast("int")
    rows = paired.select(id_domain(F.col(id)).alias("domain"), i.alias("i"), j.alias("j"), hit.alias("hit"))
    cells = rows.groupBy("domain", "i", "j").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("domain").agg(F.sum("n").alias("rows"))
    return cells.where("i between 0 and 2 and j between 0 and 2").join(total, "domain").select("domain", "i", "j", (F.col("hits") * 9.0 / F.col("rows")).alias("accuracy"))


def style_difficulty(matrix: DataFrame) -> DataFrame:
    """Per domain: easy (below the diagonal), normal (on it) and hard (above), each the mean of three cells, and their mean."""
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("accuracy"))), F.lit(0.0)) / 3
    i, j = F.col("i"), F.col("j")
    g = matrix.groupBy("domain").agg(part(i > j).alias("easy"), part(i == j).alias("normal"), part(i < j).alias("hard"))
    return g.withColumn("average", (F.col("easy") + F.col("normal") + F.col("hard")) / 3)


def style_summary(difficulty: DataFrame) -> DataFrame:
    """Means over the domains: easy, normal, hard and the grand mean."""
    return difficulty.agg(*[F.avg(c).alias(c) for c in ("easy", "normal", "hard")], F.avg("average").alias("total"))


def metrics_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """A wide metric table as (keys, metric, value), value a double."""
    names = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select(*keys, "m.metric", "m.value")


def evaluate(name: str, responses: DataFrame, truth: DataFrame, **columns: str) -> DataFrame:
    """The benchmark's metrics for responses (id, response) and its truth (id, score and its subject or subset)."""
    from assize.operators.pairing import pair_by_key, parse_predictions

    if name not in MODES:
        raise ValueError(f"{name} is none of {list(MODES)}")
    mode = MODES[name]
    if name == "XSUM_faithfulness":
        truth = truth.withColumn("score", F.when(F.col("score").cast("string") == "1", "true").otherwise("false"))
    paired = pair_by_key(parse_predictions(responses, integer=mode["integer"]).select("id", "answer", "parse_failed"), truth)
    if name == "MMLU-STEM":
        return accuracy_by_subject(paired, columns.get("subject", "subject"))
    if name == "reward-bench":
        return section_scores(subset_accuracy(paired, columns.get("subset", "subset")), benchmark_sections(paired.sparkSession))
    if name == "RM-Bench":
        return style_difficulty(style_matrix(paired))
    return agreement(paired, []) if mode["how"] == "int" else accuracy(paired, [], mode["how"])
