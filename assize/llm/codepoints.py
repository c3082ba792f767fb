"""One consistent form for text that looks the same but differs in its characters.

Words that hold, or may hold, a deviation are taken out of each text with their number, exploded to positioned code points,
joined with broadcast mappings (decompositions, full-width forms, characters without width, blanks, look-alikes), their
combining marks ordered by class, recomposed and put back. All other characters never leave their row. The mappings are
fixed tables of a few thousand rows, whatever the corpus.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assize.llm import charmaps as M

VARIANTS = ("fullwidth", "combining", "zero_width", "nbsp", "lookalike")

_W = rf"\p{{L}}\p{{N}}\p{{M}}{M.ZERO_WIDTH}"
_WORDLIKE = M.FULLWIDTH.replace("　！-｠￠-￦", "０-９Ａ-Ｚａ-ｚ")
_LAT, _CYR, _GRE = (M.SCRIPT_RANGES[s] for s in (M.LATIN, M.CYRILLIC, M.GREEK))
_ALIKE = "".join(M.CYRILLIC_LOOKALIKES) + "".join(M.GREEK_LOOKALIKES)
#: A word with a deviating character, of several scripts, or wholly of look-alikes; else one blank or sign of another width.
_HARD = f"{M.COMBINING}{M.ZERO_WIDTH}{_WORDLIKE}"
_RUN = (
    f"(?<![{_W}])(?![A-Za-z0-9]+(?![{_W}]))(?:(?=[{_W}]*[{_HARD}])|(?=[{_W}]*[{_LAT}])(?=[{_W}]*[{_CYR}{_GRE}])|(?=[{_W}]*[{_CYR}])(?=[{_W}]*[{_GRE}])"
    f"|(?=[{_ALIKE}\\p{{N}}]{{2,}}(?![{_W}]))(?=\\p{{N}}*[{_ALIKE}]))[{_W}]+"
    f"|[{M.NBSP}]|[{M.FULLWIDTH}&&[^{_WORDLIKE}]]"
)
_BETWEEN = rf"[\p{{N}}\p{{M}}{M.ZERO_WIDTH}]*"
#: A cheap test, without looking ahead, that every text with a deviation passes: a deviating character, neighbouring letters of
#: two scripts, or a word wholly of look-alikes.
_MAYBE = (
    f"[{_HARD}{M.NBSP}{M.FULLWIDTH}]|[{_LAT}]{_BETWEEN}[{_CYR}{_GRE}]|[{_CYR}{_GRE}]{_BETWEEN}[{_LAT}]|[{_CYR}]{_BETWEEN}[{_GRE}]|[{_GRE}]{_BETWEEN}[{_CYR}]"
    f"|(?<![{_W}])\\p{{N}}*[{_ALIKE}][{_ALIKE}\\p{{N}}]+(?![{_W}])|(?<![{_W}])\\p{{N}}+[{_ALIKE}]\\p{{N}}*(?![{_W}])"
)


#: What no text without other than Latin letters, their accents in one character, and usual signs passes; a few ranges, quickly read.
_UNUSUAL = "[^\\x00-\\x9F\u00A1-\u00AC\u00AE-\u02FF\u2010-\u2027\u2030-\u205E\u20A0-\u20CF\u2100-\u2BFF]"


def _suspect(text: Column) -> Column:
    return text.rlike(_UNUSUAL) & text.rlike(_MAYBE)


def character_table(spark: SparkSession) -> DataFrame:
    """ch -> kind of deviation, script, and its parts (part, class, script, to): ``to`` maps a script's number to the look-alike."""
    scripts, alike = M.scripts(), M.lookalikes()
    kinds = {c: k for k, r in (("fullwidth", M.FULLWIDTH), ("combining", M.COMBINING), ("zero_width", M.ZERO_WIDTH), ("nbsp", M.NBSP)) for c in M.members(r)}
    parts: dict[int, list[tuple[str, int]]] = {}
    for cp, _, part, cls in M.decompositions():
        parts.setdefault(cp, []).append((chr(part), cls))
    for cp, n in M.wide().items():
        parts[cp] = [(chr(n), 0)]
    for cp, k in kinds.items():
        if k == "zero_width":
            parts[cp] = []
        elif k == "nbsp":
            parts[cp] = [(" ", 0)]
        elif k == "combining":
            parts.setdefault(cp, [(chr(cp), unicodedata.combining(chr(cp)))])
    rows = []
    for cp in sorted({*parts, *kinds, *(ord(c) for c in scripts), *(ord(c) for c, _ in alike)}):
        own = parts.get(cp, [(chr(cp), unicodedata.combining(chr(cp)))])
        rows.append((chr(cp), kinds.get(cp), [(p, c, scripts.get(p, 0), *(alike.get((p, t)) for t in (1, 2, 3))) for p, c in own]))
    return spark.createDataFrame(rows, "ch string, kind string, parts array<struct<part:string,class:int,script:int,to1:string,to2:string,to3:string>>")


def _spread(text: Column) -> Column:
    """Scripts that unmistakable words of the text are in."""
    has = [F.when(text.rlike(f"(?<![{_W}])(?=[{_W}]*[{M.only(s)}])[{M.SCRIPT_RANGES[s]}\\p{{N}}\\p{{M}}{M.ZERO_WIDTH}]{{2,}}(?![{_W}])"), F.lit(s)) for s in M.SCRIPT_RANGES]
    return F.when(text.rlike(f"[{_CYR}{_GRE}]"), F.array_compact(F.array(*has))).otherwise(F.array(F.lit(M.LATIN)))  # without such letters no word turns


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x))


def mend_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, n, run, spread): per word its consistent form and its kinds of deviation (keys, n, fixed, kinds)."""
    id = [*keys, "n"]
    table = F.broadcast(character_table(words.sparkSession))
    points = words.select(*id, "spread", F.posexplode(F.regexp_extract_all("run", F.lit("(?s)."), 0)).alias("pos", "ch"))
    plain = F.array(F.struct(F.col("ch").alias("part"), F.lit(0).alias("class"), F.lit(0).alias("script"), *(F.lit(None).cast("string").alias(f"to{t}") for t in (1, 2, 3))))
    points = points.join(table, "ch", "left").withColumn("parts", F.coalesce("parts", plain))
    points = points.select(*id, "spread", "pos", "kind", F.posexplode_outer("parts").alias("sub", "x")).select(*id, "spread", "pos", "sub", "kind", "x.*")
    at = Window.partitionBy(*id).orderBy("pos", "sub")
    points = points.withColumn("starter", F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(at))
    row = F.struct("starter", F.coalesce("class", F.lit(0)).alias("class"), "pos", "sub", "part", "script", "to1", "to2", "to3")
    fits = [F.bool_and((F.coalesce("script", F.lit(0)).isin(0, t)) | F.col(f"to{t}").isNotNull()).alias(f"fits{t}") for t in (1, 2, 3)]
    many = [F.count_if(F.col("script") == t).alias(f"n{t}") for t in (1, 2, 3)]
    g = points.groupBy(*id).agg(F.array_sort(F.collect_list(row)).alias("xs"), F.collect_set("kind").alias("kinds"), F.first("spread").alias("spread"), *fits, *many)
    several = sum((F.col(f"n{t}") > 0).cast("int") for t in (1, 2, 3)) > 1
    letters = F.col("n1") + F.col("n2") + F.col("n3")
    own = F.when(F.col("n1") > 0, 1).when(F.col("n2") > 0, 2).otherwise(3)
    turn = several | ((letters > 1) & ~F.array_contains("spread", own) & (F.col("n1") == 0))
    options = [
        F.when(F.col(f"fits{t}") & F.when(several, F.col(f"n{t}") > 0).otherwise((own != t) & F.array_contains("spread", F.lit(t))), F.struct((-F.col(f"n{t}")).alias("a"), (~F.array_contains("spread", F.lit(t))).alias("b"), F.lit(t).alias("t")))
        for t in (1, 2, 3)
    ]
    g = g.withColumn("target", F.when(turn, F.least(*options)["t"]))
    to = lambda x: F.when(F.col("target") == 1, x["to1"]).when(F.col("target") == 2, x["to2"]).when(F.col("target") == 3, x["to3"])
    foreign = lambda x: F.col("target").isNotNull() & ~x["script"].isin(0) & (x["script"] != F.col("target"))
    xs = F.filter("xs", lambda x: x["part"].isNotNull())
    g = g.withColumn("alike", F.coalesce(F.exists(xs, foreign), F.lit(False)))
    text = F.array_join(F.transform(xs, lambda x: F.when(foreign(x), to(x)).otherwise(x["part"])), "")
    kinds = F.when(F.col("alike"), F.array_append("kinds", F.lit("lookalike"))).otherwise(F.col("kinds"))
    return g.select(*id, _compose(text).alias("fixed"), kinds.alias("kinds"))


def _words(documents: DataFrame, id: str, text: str) -> DataFrame:
    d = documents.select(F.col(id), F.col(text).alias("_text")).where(_suspect(F.col("_text")))
    # no filter on the runs: it would extract them a second time
    d = d.select(id, _spread(F.col("_text")).alias("spread"), F.regexp_extract_all("_text", F.lit(_RUN), 0).alias("runs")).dropDuplicates([id])
    return d.select(id, "spread", F.posexplode("runs").alias("n", "run"))


def deviations(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (id, variant) of each kind of deviation in each text.

    Accents in one character, superscripts, fractions, dashes, quotes and lone Greek letters are none. Null and empty texts
    and empty tables give no rows; of repeated ids one row counts; further columns are ignored.
    """
    w = mend_words(_words(documents, id, text), [id])
    return w.select(id, F.explode("kinds").alias("variant")).distinct()


def normalised(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id and text in one consistent form (id, text, changed); null and empty texts stay as they are.

    Only texts with a possible deviation are joined with their mended words; all others pass through without a shuffle.
    Of repeated ids among the former one row is kept.
    """
    d = documents.select(F.col(id), F.col(text).alias("_text"))
    hit = F.coalesce(_suspect(F.col("_text")), F.lit(False))
    keep = d.where(~hit).select(id, F.col("_text").alias(text), F.lit(False).alias("changed"))
    fixed = mend_words(_words(documents, id, text), [id]).groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "fixed"))), lambda x: x["fixed"]).alias("fixed"))
    rest = d.where(hit).dropDuplicates([id]).join(fixed, id, "left")
    mended = F.array_join(F.flatten(F.zip_with(F.split("_text", _RUN, -1), "fixed", lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    mended = F.coalesce(mended, F.col("_text"))
    rest = rest.select(id, mended.alias(text), (~mended.eqNullSafe(F.col("_text"))).alias("changed"))
    return keep.unionByName(rest)
