"""Rubrics: an array of {description, scoring}, the scoring's keys telling the mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.functions.vectors import cosine

#: Queries that are held beside each item at once.
MOST_QUERIES = 4096
SCHEMA = "description string, scoring map<string,string>"
#: The keys of each mode's scoring.
KEYS = {"pointwise": ["1", "2", "3", "4", "5"], "pairwise": ["response_1", "response_2"], "binary": ["true", "false"]}


def check_mode(mode: str) -> str:
    if mode not in KEYS:
        raise ValueError(f"evaluation mode {mode!r} is none of {list(KEYS)}")
    return mode


def normalise_keys(scoring: Column) -> Column:
    """score_1 .. score_5 become 1 .. 5; keys are lower case."""
    return F.transform_keys(scoring, lambda k, _: F.regexp_replace(F.lower(k), r"^score_(?=\d$)", ""))


def rubric_mode(scoring: Column) -> Column:
    """The mode whose keys a normalised scoring has, none more and none less; else null."""
    keys = F.array_sort(F.map_keys(scoring))
    out = F.lit(None).cast("string")
    for mode, want in KEYS.items():
        out = F.when(keys == F.array(*map(F.lit, sorted(want))), mode).otherwise(out)
    return out


def load_rubrics(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rubric files as (file, n, description, scoring, mode): each a JSON array, n counting from 0 in each file, keys normalised.

    ``path`` is a file, a folder or a pattern. With ``strict`` a rubric with missing or further keys raises, as does a file
    that is no array; else the mode is null, and the file gives no row.
    """
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    array = F.from_json("value", f"array<struct<{SCHEMA.replace('description string', 'description:string').replace('scoring map', 'scoring:map')}>>".replace(", ", ","))
    if strict:
        array = F.coalesce(array, F.raise_error(F.concat(F.lit("no array of rubrics: "), F.input_file_name())))
    df = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(array).alias("n", "r"))
    df = df.select("file", "n", "r.description", normalise_keys(F.col("r.scoring")).alias("scoring")).withColumn("mode", rubric_mode(F.col("scoring")))
    if strict:
        df = df.withColumn("mode", F.coalesce("mode", F.raise_error(F.concat(F.lit("scoring keys fit no mode: "), F.coalesce(F.array_join(F.map_keys("scoring"), ","), F.lit("none"))))))
    return df.select("file", "n", "description", "scoring", "mode")


def expand_template(tasks: DataFrame, templates: DataFrame, task: str = "task") -> DataFrame:
    """Each task with each of the few template scorings (n, scoring): (task, n, description, scoring), the task describing it.

    ``templates`` is a fixed table of at most a few rows.
    """
    arr = templates.agg(F.array_sort(F.collect_list(F.struct("n", F.map_entries("scoring").alias("e")))).alias("templates"))
    x = tasks.select(F.col(task).alias("task")).join(F.broadcast(arr)).select("task", F.explode("templates").alias("t"))
    return x.select("task", F.col("t.n").alias("n"), F.col("task").alias("description"), F.map_from_entries("t.e").alias("scoring"))


def retrieve_top_k(queries: DataFrame, items: DataFrame, k: int = 5, id: str = "id", vector: str = "embedding") -> DataFrame:
    """For each of the stated queries, the k most similar items by cosine: (query_id, item_id, similarity, rank).

    The queries are held in one array beside each item, and each task keeps its best k for each; more than ``MOST_QUERIES``
    are searched in hashed blocks, of about half as many each. Ties go to the lower id. k = 0 gives no rows.
    """
    spark = items.sparkSession
    schema = "query_id bigint, item_id bigint, similarity double, rank int"
    n = queries.count()
    if k == 0 or n == 0:
        return spark.createDataFrame([], schema)
    if n > MOST_QUERIES:
        blocks = -(-2 * n // MOST_QUERIES)
        own = F.pmod(F.xxhash64(F.col(id), F.lit(17)), F.lit(blocks))
        return reduce(DataFrame.unionByName, [_search(queries.where(own == i), items, k, id, vector) for i in range(blocks)])
    return _search(queries, items, k, id, vector)


def _search(queries: DataFrame, items: DataFrame, k: int, id: str, vector: str) -> DataFrame:
    from pyspark.sql import Window

    q = queries.agg(F.collect_list(F.struct(F.col(id).cast("bigint").alias("q"), F.col(vector).alias("v"))).alias("qs"))
    scored = items.select(F.col(id).cast("bigint").alias("item_id"), F.col(vector).alias("v")).join(F.broadcast(q))
    scored = scored.select("item_id", F.explode(F.transform("qs", lambda x: F.struct(x["q"].alias("query_id"), cosine(x["v"], F.col("v")).alias("similarity")))).alias("s"))
    scored = scored.select("s.query_id", "item_id", "s.similarity")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("item_id"), F.lit(64))).orderBy(F.desc("similarity"), "item_id")
    best = scored.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", "similarity", "rank")
