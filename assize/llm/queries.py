"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.llm.codepoints import deviations, normalised
from assize.llm.inputs import answer_values, judged_pairs
from assize.llm.leakage import leak_report, leaked_passages
from assize.llm.neardup import expand_pairs, group_of, near_duplicates
from assize.llm.packing import fill_report, pack, token_sizes
from assize.llm.pairs import broken_pairs
from assize.llm.sql import ORACLES as SQL
from assize.llm.subset import coverage_report, varied_subsets
from assize.llm.tokens import estimate_tokens, token_budget, token_models
from assize.llm.truncation import truncated_values, truncation_rates
from assize.plans.lineage import settle
from assize.sources.tables import canonical, table


def _prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prompts").select("id", canonical(F.col("source")).alias("source"), F.col("prompt").alias("text"))


def p1_subset(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "run_limits").where("limit_name like 'subset_rows_%'").dropDuplicates(["limit_name"]).collect()  # a stated table
    return varied_subsets(_prompt_texts(spark, d), sorted((x.limit_name, x.amount) for x in limits))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage_report(_prompt_texts(spark, d), p1_subset(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_values(answer_values(spark, d)).select("field_name", "record_id")


def p2_truncation_rates(spark: SparkSession, d: str) -> DataFrame:
    v = answer_values(spark, d, source=True)
    return truncation_rates(v, truncated_values(v))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prompts").select("id", F.coalesce("input", "prompt").alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return expand_pairs(*near_duplicates(_compared(spark, d))).select("id_a", "id_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_of(*near_duplicates(_compared(spark, d)))


def _sft(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "traces").select("id", canonical(F.col("lang")).alias("lang"), F.col("r1_raw_sft").alias("text"))


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    r = _sft(spark, d)
    slices = table(spark, d, "traces").where("id is not null").groupBy("id").agg(F.max(canonical(F.col("source"))).alias("source"), F.max(canonical(F.col("lang"))).alias("lang"))
    domains = table(spark, d, "sources").select(canonical(F.col("source")).alias("source"), "domain").dropDuplicates(["source"])
    return estimate_tokens(r, token_models(r)).join(slices, "id").join(domains, "source", "left").select("id", "source", "lang", "domain", "tokens")


def p4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget(p4_tokens(spark, d))


def p4_model_quality(spark: SparkSession, d: str) -> DataFrame:
    m = token_models(_sft(spark, d))
    rows = [(k, x["n_holdout"], x["bias"], x["mape"], x["total_error"]) for k, x in m.items()]
    return spark.createDataFrame(rows, "lang string, n_holdout int, bias double, mean_relative_error double, total_error double")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(judged_pairs(spark, d))


def p5_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("field_name", "defect").agg(F.count(F.lit(1)).alias("n"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = settle(token_sizes(table(spark, d, "documents")), "sizes")
    limits = table(spark, d, "run_limits").where("limit_name like 'pack_tokens_%'").dropDuplicates(["limit_name"]).collect()  # a stated table
    out = [pack(sizes, r.amount).withColumns({"limit_name": F.lit(r.limit_name), "capacity": F.lit(r.amount)}) for r in sorted(limits)]
    return reduce(DataFrame.unionByName, out)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p6_containers(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per limit the documents that are packed, those with a piece twice or without all their tokens, and containers above the capacity."""
    sizes = token_sizes(table(spark, d, "documents"))
    p = settle(p6_containers(spark, d), "packed")
    docs = p.groupBy("limit_name", "doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("pieces")).join(sizes, "doc_id", "left")
    docs = docs.groupBy("limit_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") != F.col("pieces")) | ~F.col("placed").eqNullSafe(F.col("tokens"))).alias("wrong"))
    full = p.groupBy("limit_name", "container_id", "capacity").agg(F.sum("tokens").alias("held")).groupBy("limit_name").agg(F.count_if((F.col("held") > F.col("capacity")) & (F.col("container_id") > 0)).alias("overfull"))
    return docs.join(full, "limit_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leak_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(p7_found(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return deviations(table(spark, d, "documents"))


def p8_normalised(spark: SparkSession, d: str) -> DataFrame:
    return normalised(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_subset": p1_subset,
    "p1_coverage": p1_coverage,
    "p2_found": p2_found,
    "p2_truncation_rates": p2_truncation_rates,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_tokens": p4_tokens,
    "p4_token_budget": p4_token_budget,
    "p4_model_quality": p4_model_quality,
    "p5_found": p5_found,
    "p5_defect_counts": p5_defect_counts,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_leak_report": p7_leak_report,
    "p8_found": p8_found,
    "p8_normalised": p8_normalised,
}

ORACLES: dict[str, str] = dict(SQL)
