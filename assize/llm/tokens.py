"""Token counts under an existing tokenizer: estimated everywhere from cheap counts, corrected on tokenised holdouts."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.plans.lineage import settle

#: Place of the public vocabularies; a parameter, never copied into the repository.
TOKENIZERS = os.environ.get("ASSIZE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Tokenised records of each language at most, in expectation; a hash of the id picks them from the whole table.
SAMPLE_PER_LANGUAGE = 500
#: Rows of the sample, in expectation, on which the model over all languages is fitted; it is also what a language's own model
#: starts from: in a fit it weighs as PRIOR records would, in the bias as BIAS_PRIOR holdouts.
SHARED_SAMPLE, PRIOR, BIAS_PRIOR = 4_000, 0.35, 3.0

FEATURES = ["bytes", "lower", "upper", "digits", "spaces", "breaks", "punctuation", "latin1_signs", "latin1_letters", "latin_more", "greek", "cyrillic", "other_2", "other_3", "other_4", "continuation", "words", "capital_words", "numbers", "punctuation_runs", "fifth_letters", "eighth_letters", "one"]


@functools.lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A tiktoken encoder of one of the public rank files; special tokens are ordinary text."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_at", os.path.join(folder, "__init__.py"))
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> np.ndarray:
    e = encoder(folder, vocabulary)
    return np.array([len(e.encode_ordinary(t)) if t else 0 for t in texts], np.int64)


def _classes() -> np.ndarray:
    """Byte -> class, in the order of FEATURES from lower on."""
    c = np.full(256, 6, np.uint8)
    c[ord("a") : ord("z") + 1] = 1
    c[ord("A") : ord("Z") + 1] = 2
    c[ord("0") : ord("9") + 1] = 3
    c[32] = 4
    c[[9, 10, 11, 12, 13]] = 5
    c[0x80:0xC0] = 15
    c[0xC0:0xC3], c[0xC3], c[0xC4:0xCE], c[0xCE:0xD0], c[0xD0:0xD2], c[0xD2:0xE0], c[0xE0:0xF0], c[0xF0:] = 7, 8, 9, 10, 11, 12, 13, 14
    return c


_CLASS = _classes()
_LETTER = np.isin(_CLASS, [1, 2, 8, 9, 10, 11, 12, 13, 15])


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each text; all zero for null and empty ones."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = np.array([len(x) for x in raw], np.int64)
    out = np.zeros((len(raw), len(FEATURES)))
    full = np.nonzero(n)[0]
    if not len(full):
        return out
    b = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    add = lambda mask: np.add.reduceat(mask, begin, dtype=np.int64)
    cls = _CLASS[b]
    first = np.zeros(len(b), bool)
    first[begin] = True
    columns = [n[full], *(add(cls == k) for k in range(1, 16))]
    letter, digit, punct = _LETTER[b], cls == 3, cls == 6
    starts = lambda m: m & (first | ~np.concatenate([[False], m[:-1]]))
    word = starts(letter)
    index = np.arange(len(b))
    depth = index - np.maximum.accumulate(np.where(word, index, 0))
    columns += [add(word), add(word & (cls == 2)), add(starts(digit)), add(starts(punct)), add(letter & (depth >= 4)), add(letter & (depth >= 7)), np.ones(len(full))]
    out[full] = np.column_stack(columns)
    return out


def _solve(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """Ridge regression with relative errors (long and short texts weigh alike), drawn towards ``prior`` the more the fewer rows there are."""
    w = 1 / np.maximum(y, 1.0)
    xs = x * w[:, None]
    scale = np.sqrt((xs**2).sum(0)) + 1e-12
    a = xs / scale
    ridge = 1e-3 if prior is None else max(1e-3, PRIOR / max(1, len(y)))
    start = np.zeros(x.shape[1]) if prior is None else prior
    return start + np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ (y * w - xs @ start)) / scale


def fit_model(g: pd.DataFrame, prior: dict | None = None, holdout: float = 0.3) -> dict:
    """Coefficients, the holdouts' bias factor and mean absolute relative error of a sample (features, tokens, u).

    u, a number in [0, 1), splits the holdouts off. ``prior`` is the model over all languages; a sample of any size, even of
    none to fit on, gives a model between it and its own.
    """
    x, y, held = np.array(g["features"].tolist(), float).reshape(len(g), -1), g["tokens"].to_numpy(float), g["u"].to_numpy() < holdout
    base = np.eye(1, len(FEATURES))[0] / 4 if prior is None else np.array(prior["coef"]) * prior["bias"]
    coef = _solve(x[~held], y[~held], base if prior is not None else None) if (~held).sum() >= (2 if prior is None else 1) else base
    guess = np.maximum(x[held] @ coef, 0)
    draw = BIAS_PRIOR * (y.mean() if len(y) else 0.0) if prior is not None else 0.0
    bias = float((y[held].sum() + draw) / (guess.sum() + draw)) if guess.sum() + draw > 0 else 1.0
    error = np.abs(guess * bias - y[held]) / np.maximum(y[held], 1)
    # what the corrected model would miss in total is seen on the odd holdouts with the factor of the even ones
    even = np.arange(len(guess)) % 2 == 0
    part = guess[~even].sum() * y[held][even].sum() / max(guess[even].sum(), 1e-9)
    total = float(part / y[held][~even].sum() - 1) if (~even).any() and y[held][~even].sum() else None
    return {"coef": coef.tolist(), "bias": bias, "mape": float(error.mean()) if len(error) else None, "n_holdout": int(held.sum()), "total_error": total}


def token_models(records: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[str | None, dict]:
    """Models for ``records`` (id, lang, text), fitted on about SAMPLE_PER_LANGUAGE tokenised records of each language.

    Every language of the table has a model of its own, null has that over all. Records are tokenised and models fitted by
    tasks, a language in each; the driver gets a row for each language.
    """
    r = records.where(F.length("text") > 0)
    sizes = r.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = r.where("id is not null").join(sizes, F.col("lang").eqNullSafe(F.col("_lang"))).where(part(91) < F.lit(SAMPLE_PER_LANGUAGE) / F.col("n"))
    picked = picked.select("id", "lang", "text", part(17).alias("u"), part(53).alias("s")).dropDuplicates(["id"])

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "u": b["u"], "s": b["s"], "tokens": count_tokens(texts, folder, vocabulary), "features": list(text_features(texts))})

    sample = settle(picked.mapInPandas(tokenise, "id bigint, lang string, u double, s double, tokens bigint, features array<double>"), "sample")
    n = sample.count()
    if not n:
        return {}
    shared = sample.where(F.col("s") < SHARED_SAMPLE / n).toPandas().sort_values("id")
    shared = fit_model(shared if len(shared) else sample.orderBy("id").limit(SHARED_SAMPLE).toPandas())

    def own(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"lang": key[0], **fit_model(g.sort_values("id"), shared)}])

    fits = sample.where("lang is not null").groupBy("lang").applyInPandas(own, "lang string, coef array<double>, bias double, mape double, n_holdout int, total_error double")
    return {None: shared} | {m.lang: {k: m[k] for k in ("coef", "bias", "mape", "n_holdout", "total_error")} for m in sorted(fits.collect(), key=lambda m: m.lang)}


def estimate_tokens(records: DataFrame, models: dict[str | None, dict]) -> DataFrame:
    """(id, tokens) of each distinct id of ``records`` (id, lang, text): 0 for null and empty texts, whole texts otherwise."""
    held = records.sparkSession.sparkContext.broadcast({k: np.array(m["coef"]) * m["bias"] for k, m in models.items()})

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = held.value
        base = table.get(None, np.eye(1, len(FEATURES))[0] / 4)
        for b in batches:
            x = text_features(b["text"].tolist())
            coef = np.array([table.get(k if isinstance(k, str) else None, base) for k in b["lang"]]).reshape(len(b), -1)
            t = np.rint((x * coef).sum(1))
            yield pd.DataFrame({"id": b["id"], "tokens": np.where(x[:, 0] > 0, np.maximum(t, 1), 0).astype(np.int64)})

    r = records.select("id", "lang", "text").where(F.col("id").isNotNull())
    return r.mapInPandas(guess, "id bigint, tokens bigint").groupBy("id").agg(F.max("tokens").alias("tokens"))


def token_budget(counts: DataFrame) -> DataFrame:
    """Totals of ``counts`` (source, lang, domain, tokens) by source, language and domain: n_records, tokens."""
    return counts.groupBy("source", "lang", "domain").agg(F.count(F.lit(1)).alias("n_records"), F.sum("tokens").alias("tokens"))
