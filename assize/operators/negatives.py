"""Wrong answers made from right ones. Every choice is a hash of the row's key: no choice is repeated until it fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.functions.binding import bind
from assize.functions.hashing import pick, pick_from
from assize.functions.text import join_options, letter, letter_index, options_part, parse_options
from assize.functions.vectors import cosine

#: Kinds of the reasoning tasks.
TASK_KINDS = {
    "multiple_choice": ["date_understanding", "disambiguation_qa", "geometric_shapes", "hyperbaton", "logical_deduction_five_objects", "logical_deduction_seven_objects", "logical_deduction_three_objects", "movie_recommendation", "penguins_in_a_table", "reasoning_about_colored_objects", "ruin_names", "salient_translation_error_detection", "snarks", "temporal_sequences", "tracking_shuffled_objects_five_objects", "tracking_shuffled_objects_seven_objects", "tracking_shuffled_objects_three_objects"],
    "binary": ["boolean_expressions", "causal_judgement", "formal_fallacies", "navigate", "sports_understanding", "web_of_lies"],
    "numerical": ["multistep_arithmetic_two", "object_counting"],
    "brackets": ["dyck_languages"],
    "words": ["word_sorting"],
}
#: Closing sign of each opening one.
CLOSING = {"(": ")", "<": ">", "[": "]", "{": "}"}


def task_kind(task: Column) -> Column:
    """The kind of a task; null for an unknown one."""
    out = F.lit(None).cast("string")
    for kind, names in TASK_KINDS.items():
        out = F.when(task.isin(names), kind).otherwise(out)
    return out


def rotate_options(options: Column, target: Column, key: Column, seed: int) -> tuple[Column, Column]:
    """Options in a new order and the right one's new letter, which always differs; a single option stays."""
    n = F.size(options)
    shift = F.coalesce(pick(key, seed, n - 1) + 1, F.lit(0))
    moved = F.when(n > 1, F.concat(F.slice(options, shift + 1, n - shift), F.slice(options, F.lit(1), shift))).otherwise(options)
    return moved, F.when(n > 1, letter(F.pmod(letter_index(target) - shift, n).cast("int"))).otherwise(F.translate(target, "()", ""))


def wrong_letter(n_options: Column, target: Column, key: Column, seed: int) -> Column:
    """A letter of another option; null where there is none."""
    letters = F.when(n_options > 0, F.transform(F.sequence(F.lit(0), n_options - 1), letter))
    return pick_from(F.array_remove(letters, F.translate(target, "()", "")), key, seed)


def by_similarity(options: DataFrame, id: str = "id", option: str = "option", vector: str = "embedding", right: str = "is_right") -> DataFrame:
    """Per id the least (easy) and the most (hard) similar wrong option to the right one: (id, easy, hard); ties to the lower option."""
    r = options.where(right).select(id, F.col(vector).alias("_v")).dropDuplicates([id])
    s = options.where(~F.col(right)).join(r, id).withColumn("_s", cosine(F.col(vector), F.col("_v")))
    s = s.where("_s is not null")
    return s.groupBy(id).agg(F.min_by(option, F.struct("_s", option)).alias("easy"), F.min_by(option, F.struct((-F.col("_s")).alias("_s"), option)).alias("hard"))


def flip_binary(df: DataFrame, target: str = "target", name: str = "random_negative") -> DataFrame:
    """Adds the other one of the two labels that occur; null where more or fewer occur."""
    some = df.select(target).where(F.col(target).isNotNull()).distinct().limit(3)  # a third one is enough to refuse
    labels = some.agg(F.array_sort(F.collect_list(target)).alias("_labels"))
    other = F.get(F.array_remove("_labels", F.col(target)), F.lit(0))
    return df.join(F.broadcast(labels)).withColumn(name, F.when(F.size("_labels") == 2, other)).drop("_labels")


def perturb_number(target: Column, spread: Column, key: Column, seed: int) -> Column:
    """The target plus a whole offset that is never 0: a sum of four hash picks, near normal with ``spread``, and 1 or -1 where that is 0."""
    u = sum((pick(key, seed * 10 + i, 2001).cast("double") - 1000 for i in range(4)), F.lit(0.0)) / 1000  # variance 4/3
    offset = F.when(spread > 0, (u * spread / F.sqrt(F.lit(4 / 3)))).otherwise(F.lit(0.0))
    whole = F.signum(offset) * F.floor(F.round(F.abs(offset), 6))  # rounded, so that engines agree
    sign = F.when(pick(key, seed * 10 + 5, 2) == 0, 1).otherwise(-1)
    return (target + F.when(whole == 0, sign).otherwise(whole)).cast("bigint")


def number_negatives(df: DataFrame, target: str = "target", key: str = "id") -> DataFrame:
    """Adds random_negative and easy_negative, spread as the targets are, and hard_negative, spread by 1."""
    t = F.col(target).try_cast("bigint")
    sd = df.agg(F.coalesce(F.stddev_pop(t), F.lit(0.0)).alias("_sd"))  # one row
    out = df.join(F.broadcast(sd))
    return out.withColumns({n: perturb_number(t, s, F.col(key), seed) for n, s, seed in (("random_negative", F.col("_sd"), 1), ("easy_negative", F.col("_sd"), 2), ("hard_negative", F.lit(1.0), 3))}).drop("_sd")


def swap_words(target: Column, key: Column, seed: int) -> Column:
    """Two different words change places; a text without two different words stays as it is."""

    def swap(w: Column) -> Column:
        def at(i: Column) -> Column:
            others = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda j: F.get(w, j) != F.get(w, i))
            moved = lambda j: F.array_join(F.transform(w, lambda x, k: F.when(k == i, F.get(w, j)).when(k == j, F.get(w, i)).otherwise(x)), " ")
            return bind(pick_from(others, key, seed + 1), lambda j: F.when(j.isNull(), target).otherwise(moved(j)))

        return bind(pick(key, seed, F.size(w)), at)

    return bind(F.split(target, r"\s+"), swap)


def swap_share(target: Column, key: Column, seed: int, share: float = 0.3) -> Column:
    """Swaps for ``share`` of the words, one at least, that don't undo each other: a rotation of hashed places."""

    def rotate(w: Column) -> Column:
        n = F.size(w)
        k = F.greatest(F.lit(1), F.floor(n * share).cast("int")) + 1
        tagged = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}-"), i.cast("string"))).alias("h"), i.alias("i")))
        ranked = F.transform(F.array_sort(tagged), lambda s: s["i"])

        def move(places: Column) -> Column:
            return F.array_join(F.transform(w, lambda x, i: bind(F.array_position(places, i).cast("int"), lambda p: F.when(p > 0, F.get(w, F.get(places, F.pmod(p, F.size(places))))).otherwise(x))), " ")

        return bind(F.slice(ranked, F.lit(1), F.least(k, n)), lambda p: bind(move(p), lambda out: F.when(n < 2, target).when(out == target, swap_words(target, key, seed)).otherwise(out)))

    return bind(F.split(target, r"\s+"), rotate)


def corrupt_brackets(target: Column, input: Column, key: Column, seed: int) -> Column:
    """Deletes, swaps or inserts a sign, each for about a third of the rows; null where the input gives no sign to insert."""
    w = F.split(F.trim(target), r"\s+")
    n = F.size(w)
    roll = pick(key, seed, 9)
    gone = F.array_join(F.filter(w, lambda x, i: i != pick(key, seed + 1, n)), " ")
    signs = F.filter(F.array(*[F.when(F.contains(input, F.lit(a)), F.lit(b)) for a, b in CLOSING.items()]), lambda x: x.isNotNull())
    put = F.array_join(F.array_insert(w, pick(key, seed + 2, n + 1) + 1, pick_from(signs, key, seed + 3)), " ")
    put = F.when(F.size(signs) > 0, put)
    several = F.size(F.array_distinct(w)) > 1
    return F.when((roll < 3) & (n > 1), gone).when((roll < 7) & several, swap_words(F.trim(target), key, seed + 4)).otherwise(put)


def wrong_answers(df: DataFrame, models: list[str]) -> DataFrame:
    """Adds ``wrong_answers``: the answers whose judge isn't true (null counts as false), null where there are none.

    ``df`` has answer_m and judge_m for each model m.
    """
    all_ = F.array(*[F.struct(F.col(f"answer_{m}").alias("a"), F.coalesce(F.col(f"judge_{m}").cast("boolean"), F.lit(False)).alias("j")) for m in models])
    wrong = F.transform(F.filter(all_, lambda x: ~x["j"] & x["a"].isNotNull()), lambda x: x["a"])
    return df.withColumn("wrong_answers", F.when(F.size(wrong) > 0, wrong))


def choice_negatives(df: DataFrame, text: str = "input", target: str = "target", key: str = "id") -> DataFrame:
    """Adds options, random_negative (a wrong letter) and the shuffled form (shuffled_options, shuffled_target) of a question."""
    t, k = F.col(target), F.col(key)

    def made(o: Column) -> Column:
        moved, new = rotate_options(o, t, k, 12)
        return F.struct(o.alias("options"), wrong_letter(F.size(o), t, k, 11).alias("random_negative"), join_options(moved).alias("shuffled_options"), new.alias("shuffled_target"))

    parsed = parse_options(F.coalesce(options_part(F.col(text)), F.col(text)))
    return df.withColumn("_made", F.explode(F.transform(F.array(parsed), made))).select(*df.columns, "_made.*")
