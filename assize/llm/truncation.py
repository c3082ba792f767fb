"""Text values that stop before their text is complete.

Each value is read once for its form (open fence, object, quotation, list entry, sentence or word). Which full stops
end nothing ("see no.") no form can tell: which words have such stops is counted over all values. For these, and as evidence
for every open value, the last sentence is looked up among all sentences by hashed fixed-length prefixes; it is cut where a
longer copy goes on after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.llm.answers import read_answer
from assize.plans.lineage import settle

#: Share of a word's full stops that stand within a sentence (before a small letter or a digit) from which on its stop is
#: questioned at the end of a value.
INSIDE_SHARE = 0.2
#: Prefixes asked for are held beside all sentences up to so many (16 bytes each), and met by exchange beyond.
BROADCAST_ROWS = 1_000_000
#: First and further fixed prefix lengths.
FIRST, STEP = 8, 16
#: Characters looked at after a tail.
AFTER = 6


_STOPPED = re.compile(r"([^\W\d_](?:[^\W\d_]|\.)*)\.$")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [read_answer(x) for x in b["value"]]
        tails, lasts = [], []
        for a in got:
            t = a.tail if a.shell != "empty" else ""
            last = t.rsplit(None, 1)[-1] if t else ""
            tails.append(t if len(t) >= FIRST else None)
            lasts.append(m.group(1).lower() if (m := _STOPPED.search(last)) else None)
        yield pd.DataFrame({"field_name": b["field_name"], "record_id": b["record_id"], "cut": [a.cut for a in got], "tail": tails, "last": lasts})


def inside_stops(values: DataFrame) -> DataFrame:
    """(last): words in lower case whose full stop often stands within a sentence, counted over all of ``values`` (value)."""
    found = values.select(F.explode(F.regexp_extract_all("value", F.lit(r"\p{L}[\p{L}.]*\.(?:\s+[\p{Ll}\p{N}])?"), 0)).alias("w"))
    inside = F.col("w").rlike(r"\s")
    words = found.groupBy(F.lower(F.regexp_replace("w", r"\.(?:\s+.)?$", "")).alias("last")).agg(F.count_if(inside).alias("inside"), F.count(F.lit(1)).alias("n"))
    return words.where(F.col("inside") >= INSIDE_SHARE * F.col("n")).select("last")


def sentences(value: Column) -> Column:
    """Array of a raw value's sentences; a full stop before a digit or a small letter ends none."""
    bare = F.regexp_replace(value, r'"\w+"\s*:\s*|\\n|```\w*|(?m)^\s*(?:[-*+•>]|\d{1,3}[.)])\s+', "\n")
    parts = F.split(bare, r"(?<=[.!?…])[\"”»’)\]]*\s+(?=[^\p{Ll}\p{N}])|[\n\"{}]+")
    return F.transform(F.filter(parts, lambda x: F.length(x) > FIRST), F.trim)


def _ladder(n: Column) -> Column:
    """The fixed prefix lengths below n."""
    long = F.when(n > STEP, F.sequence(F.lit(STEP), n - 1, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(FIRST)), long)


def longer_copies(tails: DataFrame, values: DataFrame) -> DataFrame:
    """Of ``tails`` (tail), the distinct ones that are strict prefixes of a longer sentence in ``values`` (value).

    Sentences give, for each fixed length, the prefix's hash and the letters after it; these are made distinct before the
    shuffle, so that a prefix common to a third of all sentences costs one row for each way in which it goes on.
    """
    t = tails.where(F.col("tail").isNotNull()).select("tail").distinct()
    n = F.length("tail")
    k = F.when(n < STEP, F.lit(FIRST)).otherwise((n / STEP).cast("int") * STEP)
    asked = t.select("tail", k.alias("k")).select("tail", F.xxhash64(F.substring("tail", F.lit(1), F.col("k")), "k").alias("h"), F.expr("substring(tail, k + 1)").alias("rest"))
    s = values.select(F.explode(F.array_distinct(sentences(F.col("value")))).alias("s"))
    s = s.select("s", F.explode(_ladder(F.length("s"))).alias("k"))
    keys = asked.select("h").distinct()
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # only prefixes that are asked for go to the exchange
        s = s.join(F.broadcast(keys), F.xxhash64(F.substring("s", F.lit(1), F.col("k")), "k") == F.col("h"), "left_semi")
    known = s.select(F.xxhash64(F.substring("s", F.lit(1), F.col("k")), "k").alias("h"), F.expr(f"substring(s, k + 1, {STEP + AFTER})").alias("more")).distinct()
    goes_on = F.startswith("more", "rest") & (F.regexp_replace(F.expr("substring(more, length(rest) + 1)"), r"[^\p{L}\p{N}]", "") != "")
    return asked.join(known, "h").where(goes_on).select("tail").distinct()


def truncated_values(values: DataFrame) -> DataFrame:
    """Cut values of ``values`` (field_name, record_id, value; further columns are ignored).

    Returns distinct rows (field_name, record_id, longer_copy): longer_copy tells whether the cut end goes on elsewhere.
    Null, blank and placeholder values, bare verdicts, closing remarks and lists without full stops are no cases; rows
    delivered again count once; an empty table gives no rows. Texts of any length are read whole.
    """
    v = values.select("field_name", F.col("record_id").cast("bigint").alias("record_id"), "value").where(F.col("value").isNotNull())
    read = v.mapInPandas(_read, "field_name string, record_id bigint, cut boolean, tail string, last string")
    stops = inside_stops(v).select(F.col("last").alias("_last"))
    read = read.join(stops, F.col("last") == F.col("_last"), "left").where(F.col("cut") | (F.col("_last").isNotNull() & F.col("tail").isNotNull()))
    read = settle(read.select("field_name", "record_id", "cut", "tail"), "endings")
    found = longer_copies(read, v)
    marked = read.join(found.withColumn("longer_copy", F.lit(True)), "tail", "left").withColumn("longer_copy", F.coalesce("longer_copy", F.lit(False)))
    return marked.where(F.col("cut") | F.col("longer_copy")).groupBy("field_name", "record_id").agg(F.max("longer_copy").alias("longer_copy"))


def truncation_rates(values: DataFrame, cut: DataFrame) -> DataFrame:
    """Per source and field the values, the cut ones and their share (source, field_name, n_values, n_cut, cut_share).

    ``values`` has field_name, record_id, value, source; null values don't count, a null source is its own group.
    """
    v = values.where(F.col("value").isNotNull()).select("field_name", "record_id", "source").dropDuplicates(["field_name", "record_id"])
    j = v.join(cut.select("field_name", "record_id", F.lit(1).alias("is_cut")), ["field_name", "record_id"], "left")
    g = j.groupBy("source", "field_name").agg(F.count(F.lit(1)).alias("n_values"), F.count("is_cut").alias("n_cut"))
    return g.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))
