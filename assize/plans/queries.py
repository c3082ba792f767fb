"""The registered queries of the core and DuckDB's SQL for them."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.functions.hashing import pick
from assize.functions.scoring import extract_score, int_score
from assize.functions.text import camel, embedding_text, fewshot_block, instruct, join_options, label_options, option_text, parse_options, task_and_input
from assize.functions.vectors import l2_normalise
from assize.operators import completion, curation, evaluators, generation, negatives, pairing, reshape, rubrics, sampling
from assize.operators import prompts as P
from assize.plans import fixtures as fx
from assize.plans.lineage import settle, shared_dir
from assize.sources import files
from assize.sources.tables import canonical, table
from assize.streaming.answers import parse_rates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# parts of the SQL; fixed values: the grammar of scores, as in functions/scoring.py
_PAT = r"""(?:\\?"score\\?"|score)\s*:\s*("(?:Response 1|Response 2|true|false|True|False|\d+(?:\.\d+)?)"|(?:Response 1|Response 2|true|false|True|False|\d+(?:\.\d+)?))"""


def _score(c: str) -> str:
    return rf"""nullif(regexp_replace(replace(regexp_extract({c}, '{_PAT}', 1), '"', ''), '^0*(\d+)(?:\.\d+)?$', '\1'), '')"""


def _pick(key: str, seed: int, n: int | str) -> str:
    return f"(cast('0x' || substr(md5(cast({key} as varchar) || '-{seed}'), 1, 8) as bigint) % ({n}))"


_PRED = "pred AS (SELECT DISTINCT ON (resp_id) resp_id, id, model_id, rubric_id, response, reasoning_content, attempt FROM judge_responses ORDER BY resp_id)"
_TRUTH = "truth AS (SELECT DISTINCT ON (id) id, actual_score AS score, nullif(lower(trim(source)), '') AS source, rubric_id AS truth_rubric FROM traces ORDER BY id)"
_PROMPTS = "pr AS (SELECT DISTINCT ON (id) * FROM prompts ORDER BY id)"
_TRACES = "tr AS (SELECT DISTINCT ON (id) * FROM traces ORDER BY id)"


def _judged(mode: str | None, integer: bool = False) -> str:
    where = f"WHERE p.rubric_id IN (SELECT rubric_id FROM rubrics WHERE eval_mode = '{mode}')" if mode else ""
    answer = _score("p.response")
    if integer:
        answer = f"try_cast({answer} AS integer)"
    failed = f"({answer} IS NULL)" if integer else "(p.response IS NULL)"
    return f"{_PRED}, {_TRUTH}, judged AS (SELECT p.resp_id, p.id, p.model_id, {answer} AS answer, {failed} AS parse_failed, t.score, t.source FROM pred p JOIN truth t ON p.id = t.id {where})"


def _accuracy(groups: str, right: str) -> str:
    return f"SELECT {groups}, count(*) AS n, count(*) FILTER (parse_failed) AS failed, count(*) FILTER ({right}) AS correct, round(count(*) FILTER ({right}) / nullif(count(*) - count(*) FILTER (parse_failed), 0)::double, 4) AS valid_accuracy, round(count(*) FILTER ({right})::double / count(*), 4) AS raw_accuracy FROM judged GROUP BY ALL"


@_query(f"WITH {_judged('binary')} " + _accuracy("model_id", "coalesce(answer = score, false)"))
def binary_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.accuracy(fx.judged(spark, d, "binary"), ["model_id"])


@_query(f"WITH {_judged('binary')} " + _accuracy("model_id", "coalesce(lower(answer) = lower(score), false)"))
def binary_accuracy_casefold(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.accuracy(fx.judged(spark, d, "binary"), ["model_id"], "casefold")


@_query(
    f"WITH {_judged('pointwise', True)}, g AS (SELECT model_id, answer::double AS a, try_cast(score AS integer)::double AS g FROM judged WHERE NOT parse_failed AND try_cast(score AS integer) IS NOT NULL), "
    "r AS (SELECT model_id, CASE WHEN count(*) > 1 AND count(*)*sum(a*a) - sum(a)*sum(a) > 0 AND count(*)*sum(g*g) - sum(g)*sum(g) > 0 THEN round((count(*)*sum(a*g) - sum(a)*sum(g)) / sqrt((count(*)*sum(a*a) - sum(a)*sum(a)) * (count(*)*sum(g*g) - sum(g)*sum(g))), 4) END AS pearson_r FROM g GROUP BY 1), "
    "k AS (SELECT x.model_id, sum(CASE WHEN x.a < y.a THEN sign(y.g - x.g) ELSE 0 END)::double AS pq FROM g x JOIN g y ON x.model_id = y.model_id GROUP BY 1), "
    "n AS (SELECT model_id, count(*)::double AS n FROM g GROUP BY 1), tx AS (SELECT model_id, sum(c*(c-1)/2.0) AS tx FROM (SELECT model_id, a, count(*)::double AS c FROM g GROUP BY 1, 2) GROUP BY 1), ty AS (SELECT model_id, sum(c*(c-1)/2.0) AS ty FROM (SELECT model_id, g, count(*)::double AS c FROM g GROUP BY 1, 2) GROUP BY 1), "
    "tau AS (SELECT model_id, CASE WHEN n > 1 AND (n*(n-1)/2 - tx) * (n*(n-1)/2 - ty) > 0 THEN round(pq / sqrt((n*(n-1)/2 - tx) * (n*(n-1)/2 - ty)), 4) END AS kendall_tau FROM n JOIN tx USING (model_id) JOIN ty USING (model_id) JOIN k USING (model_id)), "
    "base AS (" + _accuracy("model_id", "coalesce(answer = try_cast(score AS integer), false)") + ") SELECT base.*, pearson_r, kendall_tau FROM base LEFT JOIN r USING (model_id) LEFT JOIN tau USING (model_id)"
)
def pointwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.agreement(fx.judged(spark, d, "pointwise", integer=True), ["model_id"])


_SUBJECT = "SELECT source, count(*) AS total, count(*) FILTER (coalesce(lower(answer) = lower(score), false)) AS correct, count(*) FILTER (parse_failed) AS failed, round(count(*) FILTER (coalesce(lower(answer) = lower(score), false))::double / count(*), 4) AS accuracy FROM judged GROUP BY 1"


@_query(f"WITH {_judged(None)} {_SUBJECT}")
def accuracy_by_group(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.accuracy_by_subject(fx.judged(spark, d), "source")


@_query(f"WITH {_judged(None)}, s AS ({_SUBJECT}) SELECT sum(total)::bigint AS total, sum(correct)::bigint AS correct, sum(failed)::bigint AS failed, round(sum(correct)::double / sum(total), 4) AS accuracy FROM s")
def accuracy_micro_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.micro_average(accuracy_by_group(spark, d))


_SECTIONS = (
    f"WITH {_judged('pairwise')}, sub AS (SELECT source AS subset, avg(CASE WHEN coalesce(answer = score, false) THEN 1 ELSE 0 END) AS accuracy FROM judged GROUP BY 1), "
    f"sec AS (SELECT domain AS section, source AS subset, ({_pick('source', 7, 100)} + 1)::double AS weight FROM sources UNION ALL SELECT 'void', 'no such source', 1.0), "
    "scores AS (SELECT section, round(coalesce(sum(accuracy * weight) / nullif(sum(CASE WHEN accuracy IS NOT NULL THEN weight END), 0), 0), 6) AS score FROM sec LEFT JOIN sub USING (subset) GROUP BY 1) "
)


@_query(_SECTIONS + "SELECT * FROM scores")
def section_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.section_scores(evaluators.subset_accuracy(fx.judged(spark, d, "pairwise"), "source"), fx.sections(spark, d))


@_query(_SECTIONS + "SELECT round(avg(score), 6) AS average FROM scores")
def section_average(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.section_average(section_scores(spark, d))


_CELL = "cast(doc_id AS varchar) || '-' || i || '-' || j"
_STYLE = (
    f"WITH cells AS (SELECT coalesce(nullif(lower(trim(lang)), ''), 'und') AS domain, i, j, CASE WHEN {_pick(_CELL, 9, 10)} < i - j + 5 THEN 1 ELSE 0 END AS hit FROM documents, (SELECT unnest([0, 1, 2])::int AS i) a, (SELECT unnest([0, 1, 2])::int AS j) b), "
    "m AS (SELECT domain, i, j, sum(hit) * 9.0::double / (SELECT count(*) FROM cells c WHERE c.domain = cells.domain) AS accuracy FROM cells GROUP BY 1, 2, 3), "
    "diff AS (SELECT domain, sum(accuracy) FILTER (i > j) / 3 AS easy, sum(accuracy) FILTER (i = j) / 3 AS normal, sum(accuracy) FILTER (i < j) / 3 AS hard FROM m GROUP BY 1) "
)


@_query(_STYLE + "SELECT domain, i, j, round(accuracy, 6) AS accuracy FROM m")
def style_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.style_matrix(fx.style_cells(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@_query(_STYLE + "SELECT domain, round(easy, 6) AS easy, round(normal, 6) AS normal, round(hard, 6) AS hard, round((easy + normal + hard) / 3, 6) AS average FROM diff")
def style_domain(spark: SparkSession, d: str) -> DataFrame:
    x = evaluators.style_difficulty(evaluators.style_matrix(fx.style_cells(spark, d)))
    return x.select("domain", *[F.round(c, 6).alias(c) for c in ("easy", "normal", "hard", "average")])


@_query(_STYLE + "SELECT round(avg(easy), 6) AS easy, round(avg(normal), 6) AS normal, round(avg(hard), 6) AS hard, round(avg((easy + normal + hard) / 3), 6) AS total FROM diff")
def style_difficulty(spark: SparkSession, d: str) -> DataFrame:
    x = evaluators.style_summary(evaluators.style_difficulty(evaluators.style_matrix(fx.style_cells(spark, d))))
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


@_query(f"WITH {_TRUTH}, {_PROMPTS}, a AS (SELECT id, score, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM truth), b AS (SELECT id AS id_right, rubric_id AS rubric_id_right, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM pr) SELECT ordinal, id, score, id_right, rubric_id_right FROM a FULL JOIN b USING (ordinal)")
def positional_pairing(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_by_position(fx.truth(spark, d).select("id", "score"), fx.prompts(spark, d).select("id", "rubric_id"))


@_query(f"WITH {_TRUTH}, {_TRACES} SELECT tr.id, coalesce(truth.score, 'none') AS score, CASE WHEN pr2.id IS NULL THEN 'unknown' ELSE pr2.lang END AS lang FROM tr JOIN truth USING (id) LEFT JOIN (SELECT DISTINCT ON (id) id, lang FROM prompts WHERE lang IS NOT NULL ORDER BY id) pr2 USING (id)")
def lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    t = fx.truth(spark, d).select("id", F.coalesce("score", F.lit("none")).alias("score"))
    langs = fx.prompts(spark, d).where("lang is not null").select("id", "lang")
    return pairing.lookup(t, langs, "id", "lang", F.lit("unknown"), "lang")


@_query(f"WITH {_PRED} SELECT model_id, {_score('response')} AS answer, try_cast({_score('response')} AS integer) AS int_answer, count(*) AS n FROM pred GROUP BY ALL")
def score_parse_profile(spark: SparkSession, d: str) -> DataFrame:
    p = fx.predictions(spark, d)
    return p.groupBy("model_id", extract_score(F.col("response")).alias("answer"), int_score(F.col("response")).alias("int_answer")).agg(F.count(F.lit(1)).alias("n"))


_LINE = "CASE l_returnflag WHEN 'A' THEN '{\"explanation\": \"line\", \"score\": ' || l_linenumber || '.5}' WHEN 'N' THEN 'text \"score\": \"' || l_linenumber || '\" end' ELSE 'score: ' || l_linestatus END"


@_query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, count({_score(_LINE)}) AS n_scored, sum(try_cast({_score(_LINE)} AS integer))::bigint AS total FROM lineitem GROUP BY 1, 2")
def score_parse_scale(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit('{"explanation": "line", "score": '), n, F.lit(".5}")))
    text = text.when(F.col("l_returnflag") == "N", F.concat(F.lit('text "score": "'), n, F.lit('" end'))).otherwise(F.concat(F.lit("score: "), "l_linestatus"))
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", extract_score(text).alias("s"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("n_scored"), F.sum(F.col("s").try_cast("int")).alias("total"))


# prompts


def _rubric_rows(spark: SparkSession, d: str, mode: str) -> DataFrame:
    r = table(spark, d, "rubrics").where(F.col("eval_mode") == mode).select("rubric_id", "variants")
    p = fx.prompts(spark, d).select("id", F.coalesce("input", "prompt").alias("input"))
    return fx.predictions(spark, d).join(r, "rubric_id").join(settle(p, "asked"), "id")  # as in fixtures.judged


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(mode: str) -> str:
    opening = P.OPENING_TWO if mode == "pairwise" else P.OPENING
    lines = " || '\n' || ".join(f"'{P.LINE_NAMES.get(k, k)}: ' || coalesce(v.scoring['{k}'], '')" for k in rubrics.KEYS[mode])
    a, b = "coalesce(CASE WHEN swap THEN reasoning_content ELSE response END, '')", "coalesce(CASE WHEN swap THEN response ELSE reasoning_content END, '')"
    body = f"'### RESPONSE 1\n' || {a} || '\n\n### RESPONSE 2\n' || {b}" if mode == "pairwise" else "'### RESPONSE\n' || coalesce(response, '')"
    swap = "(o % 2 = 1 AND reasoning_content IS NOT NULL) AS swap"
    return (
        f"WITH {_PRED}, {_PROMPTS}, x AS (SELECT p.resp_id, p.response, p.reasoning_content, coalesce(pr.input, pr.prompt) AS input, r.variants[{_pick('p.resp_id', 0, 'len(r.variants)')} + 1] AS v, row_number() OVER (ORDER BY p.resp_id) - 1 AS o "
        f"FROM pred p JOIN rubrics r ON p.rubric_id = r.rubric_id AND r.eval_mode = '{mode}' JOIN pr ON p.id = pr.id), y AS (SELECT *, {swap} FROM x) "
        f"SELECT resp_id, md5({_sql_text(opening)} || '\n\n### TASK\n' || v.description || '\n\n### INPUT\n' || coalesce(input, '') || '\n\n' || {body} || '\n\n### EVALUATION RUBRIC\n' || {lines} || '\n\n### OUTPUT FORMAT\n' || {_sql_text(P.OUTPUT + chr(10) * 2 + P.answer_schema(mode))} || '\n\n### EVALUATION') AS prompt_md5 FROM y"
    )


def _render_sql(mode: str, task: str, input: str, response: str, scoring: str, second: str = "''") -> str:
    lines = " || '\n' || ".join(f"'{P.LINE_NAMES.get(k, k)}: ' || coalesce({scoring}['{k}'], '')" for k in rubrics.KEYS[mode])
    opening = P.OPENING_TWO if mode == "pairwise" else P.OPENING
    body = f"'### RESPONSE 1\n' || coalesce({response}, '') || '\n\n### RESPONSE 2\n' || coalesce({second}, '')" if mode == "pairwise" else f"'### RESPONSE\n' || coalesce({response}, '')"
    return f"md5({_sql_text(opening)} || '\n\n### TASK\n' || coalesce({task}, '') || '\n\n### INPUT\n' || coalesce({input}, '') || '\n\n' || {body} || '\n\n### EVALUATION RUBRIC\n' || {lines} || '\n\n### OUTPUT FORMAT\n' || {_sql_text(P.OUTPUT + chr(10) * 2 + P.answer_schema(mode))} || '\n\n### EVALUATION')"


def _first_rubric(mode: str) -> str:
    return f"rub_{mode} AS (SELECT variants FROM rubrics WHERE eval_mode = '{mode}' ORDER BY rubric_id LIMIT 1)"


def _picked(mode: str, source: str, key: str, columns: str, out: str, input: str, response: str, second: str = "''", order: str = "") -> str:
    """Rows of ``source`` with a prompt by the hashed variant of the mode's first rubric."""
    swap = f", (row_number() OVER (ORDER BY {order}) - 1) % 2 = 1 AND {second} IS NOT NULL AS swap" if order else ""
    a, b = (f"CASE WHEN swap THEN {second} ELSE {response} END", f"CASE WHEN swap THEN {response} ELSE {second} END") if order else (response, second)
    return f"SELECT {out}, {_render_sql(mode, 'v.description', input, a, 'v.scoring', b)} AS prompt_md5 FROM (SELECT s.*, variants[{_pick(key, 0, 'len(variants)')} + 1] AS v{swap} FROM {source} s, rub_{mode})"


@_query(_prompt_sql("pointwise"))
def prompt_pointwise(spark: SparkSession, d: str) -> DataFrame:
    x = P.prompt_rows(_rubric_rows(spark, d, "pointwise"), F.col("variants"), "pointwise", "input", "response", key="resp_id")
    return x.select("resp_id", F.md5("prompt").alias("prompt_md5"))


@_query(_prompt_sql("binary"))
def prompt_binary(spark: SparkSession, d: str) -> DataFrame:
    x = P.prompt_rows(_rubric_rows(spark, d, "binary"), F.col("variants"), "binary", "input", "response", key="resp_id")
    return x.select("resp_id", F.md5("prompt").alias("prompt_md5"))


@_query(_prompt_sql("pairwise"))
def prompt_pairwise_swap(spark: SparkSession, d: str) -> DataFrame:
    x = _rubric_rows(spark, d, "pairwise").select("resp_id", "variants", "input", "response", "reasoning_content")
    o = pairing.with_ordinal(x.select("resp_id"), "resp_id", "o")
    x = P.prompt_rows(x.join(o, "resp_id"), F.col("variants"), "pairwise", "input", "response", "reasoning_content", key="resp_id", ordinal="o")
    return x.select("resp_id", F.md5("prompt").alias("prompt_md5"))


@_query("SELECT aspect AS task, n, aspect AS description, k, v FROM (SELECT DISTINCT aspect FROM rubrics), (SELECT * FROM (VALUES (0, 'true', 'holds'), (0, 'false', 'fails'), (1, 'true', 'fits'), (1, 'false', 'misses')) t(n, k, v))")
def rubric_template_expand(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(0, {"true": "holds", "false": "fails"}), (1, {"true": "fits", "false": "misses"})], "n int, scoring map<string,string>")
    x = rubrics.expand_template(table(spark, d, "rubrics").select("aspect").distinct(), t, "aspect")
    return x.select("task", "n", "description", F.explode("scoring").alias("k", "v"))


@_query("SELECT eval_mode, aspect, count(*) AS n FROM (SELECT eval_mode, aspect, unnest(variants) AS v FROM rubrics) GROUP BY 1, 2")
def rubric_modes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "rubrics").select("aspect", F.explode("variants").alias("v"))
    return x.groupBy(rubrics.rubric_mode(rubrics.normalise_keys(F.col("v.scoring"))).alias("eval_mode"), "aspect").agg(F.count(F.lit(1)).alias("n"))


@_query("WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, item_id) AS rank FROM s) SELECT query_id, item_id, round(similarity, 6) AS similarity, rank::int AS rank FROM r WHERE rank <= 5")
def rubric_retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    e = fx.labelled(spark, d)
    return rubrics.retrieve_top_k(e.where("id % 100 = 0"), e, 5).withColumn("similarity", F.round("similarity", 6))


@_query(f"WITH {_TRACES} SELECT id, md5(coalesce(prompt, '')) AS input, md5(coalesce(r1_response, '')) AS chosen, nullif(lower(trim(source)), '') AS source FROM tr")
def message_role_extract(spark: SparkSession, d: str) -> DataFrame:
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(F.col(c), F.lit("")).alias("content"))
    flipped = pick(F.col("id"), 6, 2) == 1
    pair = F.when(flipped, F.array(m("assistant", "r1_response"), m("user", "prompt"))).otherwise(F.array(m("user", "prompt"), m("assistant", "r1_response")))
    x = fx.traces(spark, d).select("id", pair.alias("chosen"), pair.alias("rejected"), canonical(F.col("source")).alias("source"))
    return reshape.preference_rows(x).select("id", F.md5("input").alias("input"), F.md5("chosen").alias("chosen"), "source")


@_query(f"WITH {_PROMPTS} SELECT id, md5(nullif(regexp_extract(prompt, '(?s)### TASK\\s+(.*?)\\s+### RESPONSE', 1), '')) AS section_md5, md5('Instruct: Find similar tasks.\nQuery: ' || nullif(regexp_extract(prompt, '(?s)### TASK\\s+(.*?)\\s+### RESPONSE', 1), '')) AS embed_md5 FROM pr")
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    return fx.prompts(spark, d).select("id", F.md5(task_and_input(F.col("prompt"))).alias("section_md5"), F.md5(embedding_text(F.col("prompt"), "Find similar tasks.")).alias("embed_md5"))


@_query(
    "SELECT limit_name AS id, array_to_string(list_transform(string_split(limit_name, '_'), lambda x: upper(x[1]) || lower(x[2:])), '') AS camel, 'Instruction: ' || limit_name || '\nQuery: ' || amount AS instructed, "
    "'Below are some examples:\nQuestion: ' || limit_name || ' Answer: ' || amount || '\n' AS fewshot, 'user' AS role, limit_name AS content, amount = 2048 AS is_right FROM run_limits"
)
def text_formats(spark: SparkSession, d: str) -> DataFrame:
    name, amount = F.col("limit_name"), F.col("amount").cast("string")
    chat = F.get(P.as_chat(name), F.lit(0))
    one = F.array(F.struct(name.alias("input"), amount.alias("target")))
    return table(spark, d, "run_limits").select(name.alias("id"), camel(name).alias("camel"), instruct(name, amount).alias("instructed"), fewshot_block(one).alias("fewshot"), chat["role"].alias("role"), chat["content"].alias("content"), (F.col("amount") == 2048).alias("is_right"))


@_query("SELECT kind, item_id::varchar AS id, md5(text) AS response_md5 FROM eval_items, (SELECT unnest(['.json', '.jsonl', '.csv', 'appended', 'version']) AS kind)")
def file_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """Answers written and read again in every form, appended ones twice."""
    x = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("response"), F.lit(None).cast("string").alias("reasoning_content"))
    base, out = f"{shared_dir(spark)}/assize-{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex[:12]}", []
    for kind in (".json", ".jsonl", ".csv"):
        path = f"{base}/answers{kind}"
        if kind == ".csv":
            x.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
        else:
            files.write_lines(x, path)
        out.append(files.read_records(spark, path).withColumn("kind", F.lit(kind)))
    for _ in range(2):
        files.append_answers(x, f"{base}/appended")
    out.append(files.read_answers(spark, f"{base}/appended").withColumn("kind", F.lit("appended")))
    out.append(spark.read.parquet(files.write_version(x, f"{base}/table")).withColumn("kind", F.lit("version")))
    return functools.reduce(DataFrame.unionByName, out).select("kind", "id", F.md5("response").alias("response_md5"))


# options and fan-out

_CHOICES = "[" + ", ".join(f"{c} || ' ' || {_pick('p_partkey', 20 + i, 50)}" for i, c in enumerate(("p_brand", "p_type", "p_name", "p_brand"))) + "]"
_MC = f"mc AS (SELECT p_partkey AS id, p_name AS question, {_CHOICES} AS choices, {_pick('p_partkey', 5, 4)} AS answer, p_brand AS subject FROM part), lab AS (SELECT *, '(A) ' || choices[1] || '\n(B) ' || choices[2] || '\n(C) ' || choices[3] || '\n(D) ' || choices[4] AS labelled FROM mc)"


@_query(f"WITH {_MC} SELECT id, labelled FROM lab")
def mc_options_label(spark: SparkSession, d: str) -> DataFrame:
    return fx.choice_questions(spark, d).select("id", label_options(F.col("choices")).alias("labelled"))


@_query(f"WITH {_MC} SELECT id, list_aggregate(choices, 'string_agg', '|') AS parsed, choices[answer + 1] AS correct, labelled AS rejoined FROM lab")
def mc_option_parse(spark: SparkSession, d: str) -> DataFrame:
    x = fx.choice_questions(spark, d).withColumn("o", parse_options(label_options(F.col("choices"))))
    return x.select("id", F.array_join("o", "|").alias("parsed"), option_text(F.col("o"), F.char(F.col("answer") + 65)).alias("correct"), join_options(F.col("o")).alias("rejoined"))


@_query(f"WITH {_MC} SELECT id, chr((65 + list_filter([0, 1, 2, 3], lambda x: x <> answer)[{_pick('id', 11, 3)} + 1])::int) AS random_negative, chr((65 + (answer - ({_pick('id', 12, 3)} + 1) + 4) % 4)::int) AS shuffled_target FROM lab")
def mc_wrong_choice(spark: SparkSession, d: str) -> DataFrame:
    x = fx.choice_questions(spark, d).select("id", F.concat(F.lit("Q\nOptions:\n"), label_options(F.col("choices"))).alias("input"), F.concat(F.lit("("), F.char(F.col("answer") + 65), F.lit(")")).alias("target"))
    return negatives.choice_negatives(x).select("id", "random_negative", "shuffled_target")


@_query(f"WITH {_MC}, s AS (SELECT *, {_pick('id', 12, 3)} + 1 AS k FROM lab) SELECT id, '(A) ' || choices[(k % 4) + 1] || '\n(B) ' || choices[((k + 1) % 4) + 1] || '\n(C) ' || choices[((k + 2) % 4) + 1] || '\n(D) ' || choices[((k + 3) % 4) + 1] AS shuffled FROM s")
def mc_shuffle(spark: SparkSession, d: str) -> DataFrame:
    q = fx.choice_questions(spark, d)
    moved, _ = negatives.rotate_options(F.col("choices"), F.char(F.col("answer") + 65), F.col("id"), 12)
    return q.select("id", join_options(moved).alias("shuffled"))


@_query(f"WITH {_MC} SELECT id || '-true' AS id, md5(question || '\nOptions:\n' || labelled) AS input, ['(A)', '(B)', '(C)', '(D)'][answer + 1] AS response, 'true' AS score, subject FROM lab UNION ALL SELECT id || '-false', md5(question || '\nOptions:\n' || labelled), list_filter(['(A)', '(B)', '(C)', '(D)'], lambda x: x <> ['(A)', '(B)', '(C)', '(D)'][answer + 1])[{_pick('id', 0, 3)} + 1], 'false', subject FROM lab")
def fanout_true_false(spark: SparkSession, d: str) -> DataFrame:
    x = reshape.choice_rows(fx.choice_questions(spark, d))
    return x.select("id", F.md5("input").alias("input"), "response", "score", "subject")


@_query("SELECT p_partkey || '-' || i || '-' || j AS id, p_name AS input, [p_name, p_brand, p_type][i + 1] AS chosen, [p_type, p_name, p_brand][j + 1] AS rejected FROM part, (SELECT unnest([0, 1, 2]) AS i) a, (SELECT unnest([0, 1, 2]) AS j) b")
def fanout_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"), F.array("p_name", "p_brand", "p_type").alias("chosen"), F.array("p_type", "p_name", "p_brand").alias("rejected"))
    return reshape.style_pairs(x)


@_query("SELECT l_orderkey || '-' || l_linenumber AS id, l_returnflag AS input, l_linestatus AS response, metric, score FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, discount, tax INTO NAME metric VALUE score)")
def metric_unpivot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("hyp"), *[F.col(f"l_{m}").alias(f"expert_{m}") for m in ("quantity", "discount", "tax")])
    return reshape.unpivot_metrics(x, ["quantity", "discount", "tax"])


@_query(f"WITH {_TRUTH} SELECT id, score AS target, CASE score WHEN 'true' THEN 'false' ELSE 'true' END AS random_negative FROM truth WHERE score IN ('true', 'false')")
def binary_flip(spark: SparkSession, d: str) -> DataFrame:
    t = fx.truth(spark, d).where("score in ('true', 'false')").select("id", F.col("score").alias("target"))
    return negatives.flip_binary(t)


def _perturb_sql(spread: str, seed: int) -> str:
    u = " + ".join(f"({_pick('p_partkey', seed * 10 + i, 2001)} - 1000)" for i in range(4))
    o = f"({u}) / 1000.0::double * {spread} / sqrt(4.0::double / 3)"
    whole = f"(sign({o}) * floor(round(abs({o}), 6)))"
    return f"(p_size + CASE WHEN {whole} = 0 THEN CASE WHEN {_pick('p_partkey', seed * 10 + 5, 2)} = 0 THEN 1 ELSE -1 END ELSE {whole} END)::bigint"


@_query(f"SELECT p_partkey AS id, p_size::bigint AS target, {_perturb_sql('sd', 1)} AS random_negative, {_perturb_sql('sd', 2)} AS easy_negative, {_perturb_sql('1.0::double', 3)} AS hard_negative FROM part, (SELECT stddev_pop(p_size) AS sd FROM part)")
def numeric_perturb(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("target"))
    return negatives.number_negatives(x)


def _swap_sql(seed: int) -> str:
    """Two different words of w change places; null where all are the same."""
    i, others = _pick("k", seed, "len(w)"), f"list_filter(range(0, len(w)), lambda j: w[j + 1] <> w[{_pick('k', seed, 'len(w)')} + 1])"
    j = f"({others})[{_pick('k', seed + 1, f'len({others})')} + 1]"
    return f"CASE WHEN len(list_distinct(w)) > 1 THEN list_transform(range(0, len(w)), lambda q: CASE WHEN q = {i} THEN w[{j} + 1] WHEN q = {j} THEN w[{i} + 1] ELSE w[q + 1] END) END"


@_query(
    "WITH t AS (SELECT 'part-' || p_partkey AS k, string_split_regex(p_name, '\\s+') AS w FROM part UNION ALL SELECT 'item-' || item_id, string_split_regex(text, '\\s+') FROM eval_items), "
    "h AS (SELECT k, w, list_transform(list_sort(list_transform(range(0, len(w)), lambda i: md5(k || '-33-' || i) || '|' || i)), lambda s: split_part(s, '|', 2)::bigint)[1 : least(greatest(1, floor(len(w) * 0.3::double)::bigint) + 1, len(w))] AS places FROM t), "
    "m AS (SELECT k, w, list_transform(range(0, len(w)), lambda q: CASE WHEN list_position(places, q) > 0 THEN w[places[list_position(places, q) % len(places) + 1] + 1] ELSE w[q + 1] END) AS moved FROM h) "
    f"SELECT k AS id, array_to_string(coalesce({_swap_sql(31)}, w), ' ') AS swapped, array_to_string(CASE WHEN len(w) < 2 THEN w WHEN moved = w THEN coalesce({_swap_sql(33)}, w) ELSE moved END, ' ') AS shared FROM m"
)
def word_swap(spark: SparkSession, d: str) -> DataFrame:
    """Names of two words, and passages of very many."""
    t = table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("id"), F.col("p_name").alias("t"))
    t = t.unionByName(table(spark, d, "eval_items").select(F.concat(F.lit("item-"), "item_id").alias("id"), F.col("text").alias("t")))
    return t.select("id", negatives.swap_words(F.col("t"), F.col("id"), 31).alias("swapped"), negatives.swap_share(F.col("t"), F.col("id"), 33).alias("shared"))


_SIGNS = "[')', '>', ']', '}']"


@_query(
    f"WITH t AS (SELECT p_partkey AS k, list_transform(range(0, {_pick('p_partkey', 41, 5)} + 1), lambda i: ({_SIGNS})[{_pick('p_partkey::varchar || i', 42, 4)} + 1]) AS w FROM part), "
    f"c AS (SELECT k, w, {_pick('k', 43, 9)} AS roll, list_transform(list_filter(range(0, len(w)), lambda i: i <> {_pick('k', 44, 'len(w)')}), lambda i: w[i + 1]) AS gone, {_swap_sql(47)} AS swapped, {_pick('k', 45, 'len(w) + 1')} AS p, ({_SIGNS})[{_pick('k', 46, 4)} + 1] AS sign FROM t) "
    "SELECT k AS id, array_to_string(w, ' ') AS target, '( [ { <' AS input, array_to_string(CASE WHEN roll < 3 AND len(w) > 1 THEN gone WHEN roll < 7 AND swapped IS NOT NULL THEN swapped ELSE list_concat(list_concat(w[1 : p], [sign]), w[p + 1 :]) END, ' ') AS random_negative FROM c"
)
def bracket_corrupt(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    signs = F.array(*map(F.lit, [")", ">", "]", "}"]))
    target = F.array_join(F.transform(F.sequence(F.lit(0), pick(k, 41, 5)), lambda i: F.get(signs, pick(F.concat(k.cast("string"), i.cast("string")), 42, 4))), " ")
    x = table(spark, d, "part").select(k.alias("id"), target.alias("target"), F.lit("( [ { <").alias("input"))
    return x.withColumn("random_negative", negatives.corrupt_brackets(F.col("target"), F.col("input"), F.col("id"), 43))


_VOTES = f"{_PRED}, {_TRUTH}, v AS (SELECT p.id, p.model_id, {_score('p.response')} AS a, coalesce({_score('p.response')} = t.score, false) AS j FROM pred p JOIN truth t ON p.id = t.id), w AS (SELECT id, list(a ORDER BY list_position({fx.MODELS}, model_id)) FILTER (a IS NOT NULL AND NOT j) AS wrong FROM (SELECT id, model_id, min(a) AS a, bool_or(j) AS j FROM v GROUP BY 1, 2) GROUP BY 1)"


@_query(f"WITH {_VOTES} SELECT id, len(wrong)::int AS n_wrong, md5({_sql_text(P.WRONG_ANSWER)} || '\n\n### Task\nQuestion: ' || id || '\nCorrect Answer: x\n' || CASE WHEN len(wrong) > 0 THEN 'Wrong Answers:\n' || list_aggregate(list_transform(wrong, lambda x: '- ' || x), 'string_agg', '\n') || '\n\n' ELSE '' END || 'Response:') AS prompt_md5 FROM w")
def judge_wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    x = negatives.wrong_answers(fx.votes(spark, d), fx.MODELS)
    prompt = P.wrong_answer_prompt(F.col("id").cast("string"), F.lit("x"), F.col("wrong_answers"))
    return x.select("id", F.when(F.col("wrong_answers").isNotNull(), F.size("wrong_answers")).alias("n_wrong"), F.md5(prompt).alias("prompt_md5"))


# curation


@_query(f"WITH {_TRACES} SELECT id, actual_score FROM tr WHERE {_score('r1_response')} IS NOT DISTINCT FROM actual_score")
def trace_filter_stage1(spark: SparkSession, d: str) -> DataFrame:
    return curation.agreeing_traces(fx.traces(spark, d)).select("id", "actual_score")


@_query(f"WITH {_PRED}, {_TRUTH}, c AS (SELECT p.id, count(*) FILTER ({_score('p.response')} IS NOT DISTINCT FROM t.score) AS n FROM pred p LEFT JOIN truth t ON p.id = t.id GROUP BY 1) SELECT id FROM truth WHERE id IN (SELECT id FROM c WHERE n >= 2)")
def trace_filter_stage2(spark: SparkSession, d: str) -> DataFrame:
    t = fx.truth(spark, d)
    counts = curation.seed_counts(fx.predictions(spark, d).withColumn("seed", F.col("model_id")), t)
    return curation.keep_by_count(t, counts, lambda n: n >= 2).select("id")


@_query(f"WITH {_TRACES} SELECT id, md5('<think>' || coalesce(r1_reasoning_trace_summarized, r1_reasoning_trace, '') || '</think>' || coalesce(r1_response, '')) AS sft_md5 FROM tr")
def trace_summary_merge(spark: SparkSession, d: str) -> DataFrame:
    t = fx.traces(spark, d)
    s = t.where("r1_reasoning_trace_summarized is not null").select("id", F.col("r1_reasoning_trace_summarized").alias("response"))
    return curation.merge_summaries(t, s).select("id", F.md5("r1_raw_sft_summarized").alias("sft_md5"))


@_query(f"WITH {_TRACES}, w AS (SELECT id, trim(regexp_replace(r1_raw_sft, '\\s+', ' ', 'g')) AS t FROM tr) SELECT id, len(string_split(t, ' '))::int AS n_words FROM w WHERE t <> '' AND len(string_split(t, ' ')) > 300")
def trace_long(spark: SparkSession, d: str) -> DataFrame:
    return curation.long_traces(fx.traces(spark, d), 300).select("id", curation.word_count(F.col("r1_raw_sft")).alias("n_words"))


@_query("SELECT time_bucket(INTERVAL 1 DAY, completed_at::timestamp) AS window_start, model_id, count(*) AS n, count(" + _score("response") + ") AS n_scored FROM (SELECT DISTINCT ON (resp_id) * FROM judge_responses ORDER BY resp_id) GROUP BY 1, 2")
def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    x = parse_rates(table(spark, d, "judge_responses").dropDuplicates(["resp_id"]))
    return x.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# vectors

_E = "e AS (SELECT vec_id AS id, embedding::double[] AS v, label FROM embeddings), u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e)"
_CENTRE = "c AS (SELECT label AS cluster, list(a ORDER BY i) AS centre FROM (SELECT label, i, avg(v[i]) AS a FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)"


@_query(f"WITH {_E} SELECT id, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1, round(v[1], 6) AS first FROM u")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = fx.labelled(spark, d).select("id", l2_normalise(F.col("embedding")).alias("v"))
    return x.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, y: s + F.abs(y)), 6).alias("l1"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


_NEAREST = f"{_E}, {_CENTRE}, near AS (SELECT id, cluster, d AS distance FROM (SELECT e.id, c.cluster, list_distance(e.v, c.centre) ** 2 AS d, row_number() OVER (PARTITION BY e.id ORDER BY round(list_distance(e.v, c.centre) ** 2, 9), c.cluster) AS r FROM e, c) WHERE r = 1)"


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    e = fx.labelled(spark, d)
    return sampling.assign_nearest(e.drop("label"), sampling.centroids(e, "label", "embedding", 64))


@_query(f"WITH {_NEAREST} SELECT id, cluster::int AS cluster, round(distance, 6) AS distance FROM near")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("id", "cluster", F.round("distance", 6).alias("distance"))


@_query(f"WITH {_E}, s AS (SELECT label, list(a ORDER BY i) AS s, any_value(n) AS n FROM (SELECT label, i, sum(v[i]) AS a, count(*) AS n FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1), p AS (SELECT u.id, u.label, s.label AS other, CASE WHEN u.label = s.label THEN (s.n - list_inner_product(u.v, s.s)) / nullif(s.n - 1, 0) ELSE 1 - list_inner_product(u.v, s.s) / s.n END AS d FROM u, s), q AS (SELECT id, max(CASE WHEN label = other THEN d END) AS a, min(CASE WHEN label <> other THEN d END) AS b FROM p GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q")
def cluster_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(sampling.silhouette(fx.labelled(spark, d)), 6),)], "silhouette double")


_TAKES = "z AS (SELECT label::int AS cluster, count(*) AS n FROM embeddings GROUP BY 1), a AS (SELECT cluster, n, greatest(1, floor(n::double / sum(n) OVER () * (100 - count(*) OVER ())))::int AS b, row_number() OVER (ORDER BY cluster) AS r, count(*) OVER () AS k FROM z), takes AS (SELECT cluster, n, (b + CASE WHEN r = k THEN greatest(0, 100 - sum(b) OVER ()) ELSE 0 END)::int AS take FROM a)"


def _takes(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocate(fx.labelled(spark, d).groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n")), 100)


@_query(f"WITH {_TAKES} SELECT cluster, n, take FROM takes")
def sample_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _takes(spark, d)


@_query(f"WITH {_NEAREST} SELECT cluster::int AS cluster, id, r::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 9), id) AS r FROM near) WHERE r <= 5")
def sample_closest(spark: SparkSession, d: str) -> DataFrame:
    x = _nearest(spark, d).withColumn("distance", F.round("distance", 9))
    return sampling.nearest_rows(x, 5).select("cluster", "id", "rank")


@_query(f"WITH {_NEAREST}, t AS (SELECT cluster, '- ' || string_agg('item ' || id, '\n- ' ORDER BY r) AS b FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 9), id) AS r FROM near) WHERE r <= 3 GROUP BY 1) SELECT string_agg('Cluster ' || cluster || ' examples:\n' || b, '\n\n' ORDER BY cluster) || '\n\nName them.' AS prompt FROM t")
def cluster_examples(spark: SparkSession, d: str) -> DataFrame:
    x = _nearest(spark, d).withColumn("distance", F.round("distance", 9))
    near = sampling.nearest_rows(x, 3).select("cluster", "rank", F.concat(F.lit("item "), F.col("id").cast("string")).alias("text"))
    return P.cluster_naming_prompt(near, "Name them.")


@_query("WITH o AS (SELECT vec_id // 5 AS id, vec_id % 5 AS option, embedding::double[] AS v FROM embeddings), s AS (SELECT a.id, b.option, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM o a JOIN o b ON a.id = b.id AND a.option = 0 AND b.option > 0) SELECT id, first(option ORDER BY c, option)::int AS easy, first(option ORDER BY c DESC, option)::int AS hard FROM s GROUP BY 1")
def option_hard_easy_negative(spark: SparkSession, d: str) -> DataFrame:
    e = fx.labelled(spark, d).select(F.floor(F.col("id") / 5).cast("bigint").alias("k"), F.pmod("id", F.lit(5)).cast("int").alias("option"), "embedding", (F.pmod("id", F.lit(5)) == 0).alias("is_right"))
    return negatives.by_similarity(e, "k").select(F.col("k").alias("id"), "easy", "hard")


@_query()
def kmeans_select(spark: SparkSession, d: str) -> DataFrame:
    _, _, scores = sampling.choose_k(fx.labelled(spark, d))
    return spark.createDataFrame([(int(k), float(s)) for k, s in scores.items()], "k int, silhouette double")


@_query()
def mmr_sample(spark: SparkSession, d: str) -> DataFrame:
    x = _nearest(spark, d).select("id", "embedding", "cluster", "distance")
    return sampling.diverse_sample(x, _takes(spark, d), candidates=20_000)


@_query()
def agglomerative_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = fx.labelled(spark, d).withColumn("block", F.concat_ws("-", F.col("label").cast("string"), pick(F.col("id"), 51, 4).cast("string")))
    return sampling.agglomerate(x.select("block", "id", "embedding"), (0.6, 0.8, 1.0))


_STUB = "'{\"explanation\": \"stub\", \"score\": ' || (1 + cast('0x' || substr(md5(coalesce(prompt, '')), 1, 8) as bigint) % 5) || '}'"


@_query(f"WITH {_PROMPTS} SELECT id::varchar AS id, {_STUB} AS response, NULL::varchar AS reasoning_content FROM pr")
def completion_stub(spark: SparkSession, d: str) -> DataFrame:
    p = fx.prompts(spark, d).select("id", "prompt")
    return completion.complete(p, completion.stub_client)


@_query(f"WITH {_TRUTH}, {_TRACES}, a AS (SELECT id, seed, prompt || seed AS prompt FROM tr, (SELECT unnest(range(5)) AS seed)), r AS (SELECT id, seed, {_score(_STUB)} AS answer FROM a) SELECT r.id, count(*) FILTER (answer IS NOT DISTINCT FROM score) AS n_correct FROM r LEFT JOIN truth ON r.id = truth.id GROUP BY 1")
def seed_filter_stub(spark: SparkSession, d: str) -> DataFrame:
    """Both stages with the stub model: answers of five seeds, counted against the truth."""
    p = completion.seeded(fx.traces(spark, d).select("id", "prompt"))
    asked = p.select(F.concat_ws("|", F.col("id").cast("string"), F.col("seed").cast("string")).alias("id"), F.concat("prompt", F.col("seed").cast("string")).alias("prompt"))
    r = completion.complete(asked, completion.stub_client).select(F.split_part("id", F.lit("|"), F.lit(1)).cast("bigint").alias("id"), F.split_part("id", F.lit("|"), F.lit(2)).cast("int").alias("seed"), "response")
    return curation.seed_counts(r, fx.truth(spark, d))


# benchmark prompt tables


def _one_rubric(spark: SparkSession, d: str, mode: str):
    """The variants of the first rubric of a mode, as a literal."""
    r = table(spark, d, "rubrics").where(F.col("eval_mode") == mode).orderBy("rubric_id").select("variants").first()  # three variants
    return F.array(*[F.struct(F.lit(v.description).alias("description"), F.create_map(*[F.lit(x) for kv in v.scoring.items() for x in kv]).alias("scoring")) for v in r.variants])


@_query(
    f"WITH {_first_rubric('pairwise')}, s AS (SELECT p_partkey || '-' || i || '-' || j AS id, p_name AS input, [p_name, p_brand, p_type][i + 1] AS chosen, [p_type, p_name, p_brand][j + 1] AS rejected FROM part, (SELECT unnest([0, 1, 2]) AS i) a, (SELECT unnest([0, 1, 2]) AS j) b) "
    + _picked("pairwise", "s", "id", "", "id, CASE WHEN swap THEN 'Response 2' ELSE 'Response 1' END AS score", "input", "chosen", "rejected", "id")
)
def reshape_style_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = reshape.pairwise_prompts(fanout_pairs(spark, d), _one_rubric(spark, d, "pairwise"))
    return x.select("id", "score", F.md5("prompt").alias("prompt_md5"))


@_query(
    f"WITH {_MC}, {_first_rubric('binary')}, r AS (SELECT id || '-true' AS id, question || '\nOptions:\n' || labelled AS input, ['(A)', '(B)', '(C)', '(D)'][answer + 1] AS response, 'true' AS score FROM lab UNION ALL SELECT id || '-false', question || '\nOptions:\n' || labelled, list_filter(['(A)', '(B)', '(C)', '(D)'], lambda x: x <> ['(A)', '(B)', '(C)', '(D)'][answer + 1])[{_pick('id', 0, 3)} + 1], 'false' FROM lab) "
    f"SELECT id, response, score, {_render_sql('binary', 'variants[1].description', 'input', 'response', 'variants[1].scoring')} AS prompt_md5 FROM r, rub_binary"
)
def reshape_choices(spark: SparkSession, d: str) -> DataFrame:
    x = reshape.choice_prompts(fx.choice_questions(spark, d), _one_rubric(spark, d, "binary"))
    return x.select("id", "response", "score", F.md5("prompt").alias("prompt_md5"))


@_query(
    f"WITH {_TRACES}, {_first_rubric('pairwise')}, s AS (SELECT id, coalesce(prompt, '') AS input, coalesce(r1_response, '') AS chosen, coalesce(r1_reasoning_trace, '') AS rejected, nullif(lower(trim(source)), '') AS source FROM tr) "
    + _picked("pairwise", "s", "id", "", "id, CASE WHEN swap THEN 'Response 2' ELSE 'Response 1' END AS score, source", "input", "chosen", "rejected", "id")
)
def reshape_preferences(spark: SparkSession, d: str) -> DataFrame:
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(F.col(c), F.lit("")).alias("content"))
    x = fx.traces(spark, d).select("id", F.array(m("user", "prompt"), m("assistant", "r1_response")).alias("chosen"), F.array(m("assistant", "r1_reasoning_trace"), m("user", "prompt")).alias("rejected"), canonical(F.col("source")).alias("source"))
    return reshape.pairwise_prompts(reshape.preference_rows(x), _one_rubric(spark, d, "pairwise")).select("id", "score", "source", F.md5("prompt").alias("prompt_md5"))


@_query(
    f"WITH {_MC}, {_first_rubric('binary')}, s AS (SELECT id || '-true' AS ID, question AS input, choices[answer + 1] AS response, 'true' AS score FROM mc UNION ALL SELECT id || '-false', question, choices[(answer + 1) % 4 + 1], 'false' FROM mc) "
    + _picked("binary", "s", "ID", "", "ID, score", "input", "response")
)
def reshape_golden(spark: SparkSession, d: str) -> DataFrame:
    q = fx.choice_questions(spark, d).select(F.col("id").cast("string").alias("ID"), "question", F.get("choices", F.col("answer")).alias("golden_answer"), F.get("choices", F.pmod(F.col("answer") + 1, F.lit(4))).alias("negative_answer"))
    return reshape.golden_prompts([q], _one_rubric(spark, d, "binary")).select("ID", "score", F.md5("prompt").alias("prompt_md5"))


@_query(
    f"WITH {_first_rubric('pointwise')}, s AS (SELECT doc_id AS id, text, kind, metric, score::double AS score FROM (UNPIVOT (SELECT doc_id, text, kind, {', '.join(f'{_pick("doc_id", 60 + i, 5)} + 1 AS {m}' for i, m in enumerate(reshape.SUMMARY_METRICS))} FROM documents) ON {', '.join(reshape.SUMMARY_METRICS)} INTO NAME metric VALUE score)) "
    + _picked("pointwise", "s", "id", "", "id, metric, score", "text", "kind")
)
def reshape_summaries(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.col("kind").alias("hyp"), *[(pick(F.col("doc_id"), 60 + i, 5) + 1).alias(f"expert_{m}") for i, m in enumerate(reshape.SUMMARY_METRICS)])
    r = _one_rubric(spark, d, "pointwise")
    parts = [t.withColumn("metric", F.lit(m)) for m, t in reshape.summary_prompts(x, {m: r for m in reshape.SUMMARY_METRICS}).items()]
    out = parts[0]
    for t in parts[1:]:
        out = out.unionByName(t)
    return out.select("id", "metric", "score", F.md5("prompt").alias("prompt_md5"))


@_query(
    f"WITH {_first_rubric('binary')}, {_first_rubric('pointwise')}, b AS (SELECT text AS article, kind AS summary, {_pick('doc_id', 70, 2)} AS f, {_pick('doc_id', 71, 5)} + 1 AS c FROM documents), "
    "o AS (SELECT *, row_number() OVER (ORDER BY coalesce(article, '') || chr(1) || coalesce(summary, ''), article NULLS FIRST, summary NULLS FIRST, f, c) - 1 AS id FROM b) "
    + _picked("binary", "o", "id", "", "'faithfulness' AS split, id, f::varchar AS score", "article", "summary")
    + " UNION ALL "
    + _picked("pointwise", "o", "id", "", "'coherence' AS split, id, c::varchar AS score", "article", "summary")
)
def reshape_articles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("text").alias("article"), F.col("kind").alias("summary"), pick(F.col("doc_id"), 70, 2).alias("faithfulness"), (pick(F.col("doc_id"), 71, 5) + 1).alias("coherence"))
    return reshape.article_prompts(x, {"faithfulness": _one_rubric(spark, d, "binary"), "coherence": _one_rubric(spark, d, "pointwise")}).select("split", "id", "score", F.md5("prompt").alias("prompt_md5"))


@_query(f"WITH {_TRACES} SELECT id, actual_score AS score, md5({_sql_text(P.OPENING)} || '\n\n### TASK\n' || coalesce(source, '') || '\n\n### INPUT\n' || coalesce(prompt, '') || '\n\n### RESPONSE\n' || coalesce(r1_response, '') || '\n\n### EVALUATION RUBRIC\n1: a\n2: b\n3: c\n4: d\n5: e\n\n### OUTPUT FORMAT\n' || {_sql_text(P.OUTPUT + chr(10) * 2 + P.answer_schema('pointwise'))} || '\n\n### EVALUATION') AS prompt_md5 FROM tr")
def reshape_own_rubric(spark: SparkSession, d: str) -> DataFrame:
    x = fx.traces(spark, d).select(F.col("id").alias("__index_level_0__"), F.col("actual_score").alias("orig_score"), F.col("source").alias("orig_criteria"), F.col("prompt").alias("orig_instruction"), F.col("r1_response").alias("orig_response"), *[F.lit(c).alias(f"orig_score{i + 1}_description") for i, c in enumerate("abcde")])
    return reshape.feedback_prompts(x).select("id", "score", F.md5("prompt").alias("prompt_md5"))


@_query(
    f"WITH {_first_rubric('binary')}, n AS ({ORACLES['numeric_perturb']}), s AS (SELECT id || '-' || name AS id, 'How large is part ' || id AS input, response::varchar AS response, CASE name WHEN 'target' THEN 'true' ELSE 'false' END AS score FROM (UNPIVOT n ON target, random_negative, easy_negative, hard_negative INTO NAME name VALUE response)) "
    + _picked("binary", "s", "id", "", "id, response, score", "input", "response")
)
def reshape_tasks(spark: SparkSession, d: str) -> DataFrame:
    q = numeric_perturb(spark, d).withColumn("input", F.concat(F.lit("How large is part "), F.col("id").cast("string")))
    return reshape.task_prompts(q, _one_rubric(spark, d, "binary"), {"target": "true", "random_negative": "false", "easy_negative": "false", "hard_negative": "false"}).select("id", "response", "score", F.md5("prompt").alias("prompt_md5"))


# around model calls


@_query(
    f"WITH {_PRED}, k AS (SELECT r.eval_mode, CASE WHEN json_valid(p.response) THEN p.response END AS j FROM pred p JOIN rubrics r USING (rubric_id)), "
    "v AS (SELECT eval_mode, CASE WHEN json_type(j) = 'OBJECT' AND list_sort(json_keys(j)) = ['explanation', 'score'] AND (j ->> '$.explanation') IS NOT NULL AND regexp_matches(j ->> '$.score', CASE eval_mode WHEN 'pointwise' THEN '^[1-5]$' WHEN 'pairwise' THEN '^Response [12]$' ELSE '(?i)^(true|false)$' END) THEN j ->> '$.score' END AS score FROM k) "
    "SELECT eval_mode, count(*) AS n, count(score) AS n_closed FROM v GROUP BY 1"
)
def answer_schema(spark: SparkSession, d: str) -> DataFrame:
    p = fx.predictions(spark, d).join(table(spark, d, "rubrics").select("rubric_id", "eval_mode"), "rubric_id")
    score = F.coalesce(*[F.when(F.col("eval_mode") == m, generation.closed_answer(F.col("response"), m)["score"]) for m in rubrics.KEYS])
    return p.groupBy("eval_mode").agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("n_closed"))


@_query(f"WITH {_NEAREST} SELECT id, CASE WHEN cluster < 8 THEN 'topic ' || cluster END AS category FROM near")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    names = F.lit(", ".join(f"topic {i}" for i in range(8)))
    return generation.label_clusters(_nearest(spark, d), names).select("id", "category")


@_query()
def rubric_requests(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rubrics").select("rubric_id", "aspect", F.posexplode("variants").alias("n", "v"))
    known = sampling.stub_vectors(r.select(F.crc32(F.concat_ws("-", "rubric_id", F.col("n").cast("string"))).alias("id"), F.col("v.description").alias("description"), F.to_json("v.scoring").alias("s")), "description").withColumn("scoring", F.from_json("s", "map<string,string>"))
    aspects = r.select("aspect").distinct().select(F.crc32("aspect").alias("id"), F.concat(F.lit("Judge the "), "aspect").alias("task"))
    tasks = sampling.stub_vectors(aspects, "task").withColumn("examples", F.array(F.struct(F.lit("a text").alias("input"), F.lit("4").alias("target"))))
    return generation.rubric_prompts(tasks, known)


def _stub_sql(prompt: str) -> str:
    return _STUB.replace("coalesce(prompt, '')", prompt)


_ASK = "'\n\n### Task\nQuestion: What is the score of ' || id || '?\nCorrect Answer: x'"


@_query(
    f"WITH {_VOTES}, a AS (SELECT id, {_sql_text(P.WRONG_ANSWER)} || {_ASK} || '\n' || CASE WHEN len(wrong) > 0 THEN 'Wrong Answers:\n' || list_aggregate(list_transform(wrong, lambda x: '- ' || x), 'string_agg', '\n') || '\n\n' ELSE '' END || 'Response:' AS p FROM w), "
    f"b AS (SELECT id, {_sql_text(P.FIX_ANSWER)} || {_ASK} || '\nNegative Answer: ' || {_stub_sql('p')} || '\nResponse:' AS p FROM a) SELECT id AS \"ID\", {_stub_sql('p')} AS negative_answer FROM b"
)
def negative_answers_stub(spark: SparkSession, d: str) -> DataFrame:
    x = negatives.wrong_answers(fx.votes(spark, d), fx.MODELS)
    x = x.select(F.col("id").alias("ID"), F.concat(F.lit("What is the score of "), F.col("id").cast("string"), F.lit("?")).alias("question"), F.lit("x").alias("golden_answer"), "wrong_answers")
    return generation.negative_answers(x, completion.stub_client, settle).select("ID", "negative_answer")
