"""Broken prompt and response pairs: a multi-label linear classifier on hashed n-grams and features of the pair.

It is trained here, on synthetic defects made from a bounded sample of the table's own pairs (cut, copied, swapped between
languages, refused and emptied answers, and sound ones with reported refusals and quotations), with one threshold for each
label, calibrated on synthetic holdouts. Synthetic pairs, their features and the fits are made by tasks; no rule decides
what a synthetic pair is called or which pairs of the sample may be used: pairs that a model of the other half of the sample
suspects are left out of the last fit. Which word pairs are usual is counted over all answers of the table, by language.
Every pair of the table is then classified, over its whole texts.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assize.llm.answers import Answer, read_answer, words
from assize.llm.phrases import REFUSALS, REPORTS
from assize.plans.lineage import settle

LABELS = ("empty", "refusal", "copy", "other_language", "truncated")
#: Pairs, in expectation, from which synthetic ones are made; a hash of the id picks them from the whole table. Of each
#: language at least so many are among them (all, if it has fewer).
SAMPLE_PAIRS, SAMPLE_PER_LANGUAGE = 3_000, 40
#: Labelled texts of the sample that make a language known.
LANGUAGE_TEXTS = 10
#: Answers and inputs of each language from which swapped answers and other questions are taken.
POOL = 40
#: Buckets of word n-grams, of words with the language of the prompt, and of endings.
BUCKETS, CROSSED, ENDINGS, LANG_BUCKETS = 1 << 15, 1 << 15, 1 << 12, 1 << 14
GRAMS = BUCKETS + CROSSED + ENDINGS
#: Logits below a threshold from which on a sampled pair is suspected of being broken itself; more would take sound pairs of rare wordings as well.
SUSPECT = 0.0
#: Least own words of answers that make known what answers usually say; declining ones are shorter.
COMMON_WORDS = 24
#: Share of a language's answers from which on a word pair is a usual one, and the least number of them.
COMMON_SHARE, COMMON_LEAST = 0.004, 3
#: Prompts kept in a task, so that answers to a hot one don't read it again each.
SOURCES = 64
ROUNDS = 80
_RUN = 4
_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"\n]*\"|「[^」]*」")
_NO_SCORE = re.compile(r'"score"\s*:\s*(?:null|""|"null"|"n/a")')
DENSE = ["one", "empty_shell", "bare_verdict", "open_form", "copied", "mostly_copied", "copied_with_verdict", "foreign", "foreign_margin", "short", "fresh", "fresh_short", "rest_short", "rest_fresh_short", "no_score", "has_verdict", "quoted"]


def sections(prompt: Column) -> tuple[Column, Column]:
    """Task and input of a rendered prompt; a text without sections is all input."""
    part = lambda name: F.regexp_extract(prompt, rf"(?s)### {name}\s*\n(.*?)(?:\n### |\z)", 1)
    found = prompt.rlike(r"(?m)^### INPUT\s*$")
    return F.when(found, part("TASK")).otherwise(F.lit("")), F.when(found, part("INPUT")).otherwise(F.coalesce(prompt, F.lit("")))


class _Numbers(dict):
    """Word -> 32-bit number; frequent words are kept."""

    def __missing__(self, w: str) -> int:
        i = zlib.crc32(("0" if w.isdigit() else w).encode("utf-8", "surrogatepass"))
        if len(self) < 1 << 19:
            self[w] = i
        return i


class Languages:
    """Linear scores of words for each language, from texts with labels; words that are alike in all say nothing."""

    def __init__(self, texts: list, labels: list[str]):
        self.names = sorted(set(labels))
        counts = np.ones((len(self.names), LANG_BUCKETS)) * 0.2
        at = {k: i for i, k in enumerate(self.names)}
        for t, k in zip(texts, labels):
            if k in at and len(t):
                np.add.at(counts[at[k]], np.unique(np.array(t) % LANG_BUCKETS), 1.0)
        p = counts / counts.sum(1, keepdims=True)
        self.weights = (np.log(p) - (np.log(p).mean(0) if len(p) else 0.0)).T.astype(np.float32)

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        if not len(numbers) or not len(self.names):
            return np.zeros(max(1, len(self.names)))
        return self.weights[numbers % LANG_BUCKETS].mean(0)


def _mix(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h ^= p.view(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _grams(n: np.ndarray, k: int) -> np.ndarray:
    return _mix([n[i : len(n) - k + 1 + i] for i in range(k)]) if len(n) >= k else np.empty(0, np.uint64)


class Source:
    """What a prompt gives to compare answers with: runs of its task and input, and its input's language."""

    def __init__(self, task: str, input: str, languages: Languages, numbers: _Numbers):
        t, i = words(task), words(input)
        ti, ii = np.array([numbers[w] for w in t], np.int64), np.array([numbers[w] for w in i], np.int64)
        self.runs = np.sort(_grams(np.concatenate([ti, ii]), _RUN))
        self.scores = languages.scores(ii if len(ii) > 3 else np.concatenate([ti, ii]))


def covered(n: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of an answer's words stand in runs of the source."""
    if len(n) < _RUN or not len(runs):
        return np.zeros(len(n), bool)
    g = _grams(n, _RUN)
    at = np.searchsorted(runs, g)
    hit = np.nonzero(runs[np.minimum(at, len(runs) - 1)] == g)[0]
    mark = np.zeros(len(n) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + _RUN, -1)
    return np.cumsum(mark)[:-1] > 0


class Reader:
    """Features of one pair; the same for training and for the table."""

    def __init__(self, languages: Languages, common: np.ndarray):
        self.languages, self.common, self.numbers = languages, common, _Numbers()

    def source(self, task: str, input: str) -> Source:
        return Source(task or "", input or "", self.languages, self.numbers)

    def own_words(self, a: Answer) -> tuple[np.ndarray, np.ndarray]:
        number = lambda t: np.array([self.numbers[w] for w in words(t)], np.int64)
        all_ = number(a.prose)
        bare = _QUOTED.sub(" ", a.prose)
        return all_, all_ if bare == a.prose else number(bare)

    def features(self, response: str | None, source: Source) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the pair in the order of DENSE, and the hashed n-grams with their values."""
        a = read_answer(response)
        all_, own = self.own_words(a)
        taken = covered(all_, source.runs)
        share = float(taken.mean()) if len(all_) else 0.0
        # what the answerer says beside quotations and what the prompt says
        rest = own[~covered(own, source.runs)] if len(own) < len(all_) else all_[~taken]
        base = own if len(own) >= 4 else all_
        rest = rest if 4 <= len(rest) < len(base) else base
        pairs = _grams(base, 2)
        rest_pairs = pairs if rest is base else _grams(rest, 2)
        mine = self.languages.scores(base)
        top, home = int(np.argmax(mine)), int(np.argmax(source.scores))
        new = lambda x: 1 - np.count_nonzero(self.common[top, (x % np.uint64(BUCKETS)).astype(np.int64)]) / len(x) if len(x) else 0.0
        fresh = new(pairs)
        rest_fresh = fresh if rest is base else new(rest_pairs)
        enough = len(base) >= 3
        margin = float(min(3.0, mine[top] - mine[home])) if enough else 0.0
        foreign = float(enough and top != home and margin > 0.15)
        short, rest_short = max(0.0, 1 - len(base) / 100), max(0.0, 1 - len(rest) / 100)
        no_score = float(bool(_NO_SCORE.search((response or "").lower())))
        dense = [1.0, float(a.shell == "empty"), float(a.shell == "verdict"), float(a.cut), share, float(share >= 0.8), float(share >= 0.8 and a.verdict), foreign, margin * foreign, short, fresh, fresh * short, rest_short, rest_fresh * rest_short, no_score, float(a.verdict), float(len(own) < len(all_))]
        one = _mix([rest]) if len(rest) else np.empty(0, np.uint64)
        said = np.unique(np.concatenate([one, rest_pairs, _grams(rest, 3)]) % np.uint64(BUCKETS)).astype(np.int32)
        asked = np.uint64(zlib.crc32(self.languages.names[home].encode()) << 20 if self.languages.names else 0)
        crossed = BUCKETS + np.unique(((one ^ asked) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)) % np.uint64(CROSSED)).astype(np.int32)
        ends = BUCKETS + CROSSED + np.unique(np.array([zlib.crc32(e.encode("utf-8", "surrogatepass")) % ENDINGS for e in endings(response, a)], np.int32))
        parts = [said, crossed, ends]
        return np.array(dense, np.float32), np.concatenate(parts), np.concatenate([np.full(len(x), 1 / np.sqrt(len(x) + 1.0), np.float32) for x in parts])


def _form(s: str) -> str:
    return "".join("a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in s)


_ENDED = re.compile(r"[.!?…。！？؟।][\"'”’»›)\]}*_`>“]*$")
_ENTRY = re.compile(r"^\s*(?:[-*+•–◦‣]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")


def unstopped(prose: str) -> str:
    """How earlier lines of a text end: "u" for a list none of whose earlier entries ends with a stop, "l" for other lists, else blank."""
    lines = [x for x in prose.split("\n") if x.strip()]
    entries = [x for x in lines if _ENTRY.match(x)]
    if len(entries) < 2 or not _ENTRY.match(lines[-1]):
        return ""
    return "l" if any(_ENDED.search(x.rstrip()) for x in entries[:-1]) else "u"


def endings(response: str | None, a: Answer) -> list[str]:
    """N-grams of characters and words where an answer and its own prose begin and end, and short answers as a whole."""
    s, prose = (response or "").strip(), a.prose.rstrip()
    style = unstopped(prose)
    out = []
    for k, t in (("r" + style, s), ("p" + style, prose)):
        form = _form(t[-4:])
        line = t[t.rfind("\n") + 1 :].lstrip()
        out += [f"{k}{n}{form[-n:]}" for n in (1, 2, 3, 4)]
        out += [f"{k}w{t[-30:].rsplit(None, 1)[-1].lower()}" if t else f"{k}w", f"{k}l{_form(line[:1])}{form[-1:]}", f"{k}f{t[:1]}{form[-1:]}"]
    out += [f"n{min(20, len(s) // 10)}", f"k{a.shell}{s[:1]}{s[-1:]}", f"v{a.verdict}{_form(prose[-1:])}{style}"]
    if len(s) <= 40:
        out += [f"s{s.lower()}", *(f"t{w}" for w in s.lower().split())]
    return out


class Classifier:
    def __init__(self, reader: Reader, weights: np.ndarray, dense: np.ndarray, thresholds: np.ndarray):
        self.reader, self.weights, self.dense, self.thresholds = reader, weights, dense, thresholds

    def logits(self, dense: np.ndarray, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
        return dense @ self.dense + values @ self.weights[grams]

    def defect(self, response: str | None, source: Source) -> str | None:
        """The label that is furthest beyond its threshold; none where no label is."""
        over = self.logits(*self.reader.features(response, source)) - self.thresholds
        k = int(np.argmax(over))
        return LABELS[k] if over[k] > 0 else None


class Rows:
    """Training rows in arrays: features, n-grams of all rows after one another, labels, and the pair each was made from."""

    def __init__(self, dense: np.ndarray, grams: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, base: np.ndarray, plain: np.ndarray):
        self.dense, self.label, self.base, self.plain = dense.astype(np.float32), label, base, plain
        self.size = np.array([len(g) for g in grams], np.int64)
        self.grams = np.concatenate(grams) if len(grams) else np.empty(0, np.int32)
        self.values = np.concatenate(values) if len(values) else np.empty(0, np.float32)

    def take(self, mask: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        inside = np.repeat(mask, self.size)
        out.dense, out.label, out.base, out.plain, out.size = self.dense[mask], self.label[mask], self.base[mask], self.plain[mask], self.size[mask]
        out.grams, out.values = self.grams[inside], self.values[inside]
        return out

    def logits(self, w: np.ndarray, d: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(self.size)), self.size)
        return self.dense @ d + np.bincount(row, w[self.grams] * self.values, len(self.size))


def held_out(base: np.ndarray, share: int = 4) -> np.ndarray:
    """Every fourth pair of the sample, by a hash, and all that was made from it."""
    return base.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33) & np.uint64(0xFFFF) < 65536 // share


def fit_label(rows: Rows, k: int, rounds: int = ROUNDS, rate: float = 0.08, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression for one label by Adam on all rows that aren't held out: weights of n-grams and of features, threshold.

    Features count in units of their own spread; the label weighs as much as all other rows.
    """
    held = held_out(rows.base)
    t, h = rows.take(~held), rows.take(held)
    mean, spread = t.dense.mean(0), t.dense.std(0)
    mean[0], spread[0] = 0.0, 1.0
    x = (t.dense - mean) / np.maximum(spread, 1e-3)
    y = (t.label == k).astype(np.float32)
    n = len(y)
    full = np.nonzero(t.size)[0]
    begin = (np.cumsum(t.size) - t.size)[full]
    row = np.repeat(np.arange(n), t.size)
    order = np.argsort(t.grams, kind="stable")
    column, first = np.unique(t.grams[order], return_index=True)
    local = np.searchsorted(column, t.grams)
    row_of, value_of = row[order], t.values[order]
    w, d = np.zeros(len(column), np.float32), np.zeros(x.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(d), np.zeros_like(d)]
    weight = np.where(y > 0, 0.5 / max(float(y.mean()), 1e-3), 0.5 / max(1 - float(y.mean()), 1e-3)).astype(np.float32)
    for i in range(1, rounds + 1):
        z = x @ d
        if len(full):
            z[full] += np.add.reduceat(w[local] * t.values, begin)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw = (np.add.reduceat(g[row_of] * value_of, first) if len(column) else np.zeros(0, np.float32)) + decay * w
        gd = x.T @ g + 1e-3 * decay * d
        for v, gv, m in ((w, gw, 0), (d, gd, 2)):
            moments[m] = 0.9 * moments[m] + 0.1 * gv
            moments[m + 1] = 0.999 * moments[m + 1] + 0.001 * gv * gv
            v -= rate * (moments[m] / (1 - 0.9**i)) / (np.sqrt(moments[m + 1] / (1 - 0.999**i)) + 1e-9)
    weights = np.zeros(GRAMS, np.float32)
    weights[column] = w
    dense = d / np.maximum(spread, 1e-3)
    dense[0] = d[0] - float((mean[1:] * dense[1:]).sum())
    return weights, dense.astype(np.float32), _threshold(h.logits(weights, dense), h.label == k)


def _shell(rng: random.Random, prose: str, score: object) -> str:
    """An answer's shell around prose, with or without a verdict."""
    verdict = rng.choice(["Response 1", "Response 2", "true", "false", "3", "5"]) if score is None else score
    kind = rng.randrange(6)
    if kind < 2:
        return _object(rng, prose, verdict)
    if kind == 2:
        return f"{prose}\n\nscore: {verdict}" if score is None else prose
    if kind == 3:
        return f"```\n{prose}\n```"
    return prose


def _object(rng: random.Random, prose: str, verdict: object) -> str:
    """A closed JSON object, fenced or not, the verdict before or after the prose."""
    pairs = [("explanation", prose), ("score", verdict)]
    text = json.dumps(dict(pairs if rng.random() < 0.7 else pairs[::-1]), ensure_ascii=False, indent=rng.choice([None, None, 2]))
    return text if rng.random() < 0.5 else f"```json\n{text}\n```"


def _refusal(rng: random.Random, lang: str, held: bool | None = None) -> str:
    """A declining answer. Every fourth wording is for holdouts only, so that thresholds are set on wordings that no fit has seen."""
    opening, core, reason, closing = (rng.choice([x for i, x in enumerate(xs) if held is None or k != 1 or (i % 4 == 0) == held]) for k, xs in enumerate(REFUSALS.get(lang, REFUSALS["en"])))
    s = " ".join(x for x in (opening, core) if x)
    s = s[0].upper() + s[1:] + (("," if lang in ("de", "ru") else "") + " " + reason if reason else "") + "."
    return s + (" " + closing if closing else "")


def _sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if x]


_INSIDE = re.compile(r"(?<=\w)\.(?= [a-zà-ÿа-яё0-9])|(?<=\s\w\w)\.(?= \w)|(?<=\s\w\w\w)\.(?= \w)")
_EMPTY = [None, "", "  \n", "N/A", "{}", "[]", "null", "---", "Error", "(no output)", "<answer></answer>", '{"explanation": "", "score": null}', '{"score": ""}', "```json\n```", "None", "..."]


def cut_text(rng: random.Random, text: str) -> str | None:
    """A text's beginning that ends within a word or a sentence; None where there is no such place."""
    t = text.rstrip()
    if len(t) < 24 or unstopped(t) == "u":  # entries without full stops aren't sentences
        return None
    inside = [m.end() for m in _INSIDE.finditer(t, 12)]  # a full stop that ends no sentence
    if inside and rng.random() < 0.3:
        return t[: rng.choice(inside)]
    for _ in range(8):
        got = t[: rng.randrange(12, len(t))].rstrip()
        if not _ENDED.search(got) and t[len(got) :].strip(" .!?…\n\"'”»)*_`"):
            return got
    return None


def _cut(rng: random.Random, r: str, a: Answer) -> str | None:
    """An answer cut at any place of its text, or a closed object whose explanation is."""
    if rng.random() < 0.4 and (prose := cut_text(rng, a.prose)):
        return _object(rng, prose, rng.choice(["true", "false", "Response 1", "Response 2", "2", "4"]))
    t = r.rstrip()
    if t[:1] in "{[`" and len(t) > 24:  # within an object or a fence any place is unfinished
        stops = [m.end() for m in re.finditer(r"[.!?]", t[:-2]) if m.end() > 12]
        return t[: rng.choice(stops) if stops and rng.random() < 0.2 else rng.randrange(12, len(t) - 1)]
    return cut_text(rng, r)


def _edited(rng: random.Random, text: str) -> str:
    """A text with a few small changes: words lost, said twice, added or misspelt, commas and capitals left out."""
    share, filler = rng.uniform(0, 0.08), rng.choice(["in fact", "also", "ja", "pues", "donc", "itu", "же"])
    out = []
    for w in text.split(" "):
        if rng.random() >= share:
            out.append(w)
            continue
        i = rng.randrange(max(1, len(w) - 1))
        out += rng.choice([[], [w, w], [w, filler], [w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]]])
    t = " ".join(out)
    return rng.choice([t, t, t.replace(",", ""), t.lower(), "Q: " + t])


def made_from(rng: random.Random, task: str, inp: str, r: str | None, lang: str | None, pool: dict[str, list[str]], asked: dict[str, list[str]], held: bool | None = None, all_kinds: bool = False) -> list[tuple[str | None, str | None]]:
    """(response, label or None) made from one pair: itself, and about half of the kinds of sound and broken ones (or all).

    ``pool`` and ``asked`` have a few answers and inputs of each language.
    """
    out: list[tuple[str | None, str | None]] = [(r, None)]
    a = read_answer(r)
    s, q = _sentences(a.prose), _sentences(inp)
    known = lang if lang in REFUSALS else "en"
    close = lambda xs: [*xs[:-1], xs[-1] if _ENDED.search(xs[-1]) else xs[-1].rstrip(" .,;:") + "."]
    use = lambda share: all_kinds or rng.random() < share
    if s:
        if use(0.4):  # short answers are sound as well
            out.append((_shell(rng, close([rng.choice(s)])[0], rng.choice([None, None, ""])), None))
        for _ in range(2):  # what cut ones look like when they stop after a sentence
            if use(0.5):
                out.append((_shell(rng, " ".join(close(s[: rng.randrange(1, min(len(s), 4) + 1)])), rng.choice([None, None, ""])), None))
        if len(s) > 1 and use(0.3):  # lists, with and without full stops
            mark, stop = rng.choice(["- ", "* ", "• ", "%d. ", "%d) "]), rng.choice(["", "", "."])
            out.append(("\n".join((mark % (i + 1) if "%" in mark else mark) + x.lstrip("-*•0123456789.) ").rstrip(" .,;:!?…") + stop for i, x in enumerate(rng.sample(s, min(len(s), 5)))), None))
        if use(0.4):
            more = close(s)
            more.insert(rng.randrange(len(more) + 1), rng.choice(REPORTS.get(lang or "en", REPORTS["en"])))
            out.append((_shell(rng, " ".join(more), None), None))
        if q and use(0.3):
            out.append((_shell(rng, " ".join([*close(s), f"“{rng.choice(q)}”."]), None), None))
        for _ in range(2):
            if use(0.6) and (cut := _cut(rng, r or "", a)):
                out.append((cut, "truncated"))
        others = [k for k in pool if k != lang and pool[k]]
        if others and lang and use(0.6):
            swapped = rng.choice(pool[rng.choice(others)])
            if len(words(read_answer(swapped).prose)) > 5:
                out.append((swapped, "other_language"))
    whole = [x for x in (task, inp) if len(x) > 20]
    if whole and use(0.8):
        text = rng.choice([*whole, inp if inp in whole else whole[0]])
        parts = _sentences(text)
        text = " ".join(parts[: max(1, int(len(parts) * rng.uniform(0.5, 1.01)))]) if rng.random() < 0.5 else text
        text = rng.choice([text, text, text.upper(), "> " + text.replace("\n", "\n> "), _edited(rng, text), _edited(rng, text)])
        if len(words(text)) >= 5:
            out.append((_shell(rng, text, None), "copy"))
    if use(0.6):
        out.append((_shell(rng, _refusal(rng, known, held), rng.choice([None, "", None])), "refusal"))
    if use(0.4):
        out.append((_shell(rng, _refusal(rng, known, held), ""), "refusal"))
    if q and use(0.8):  # a question, this prompt's or another's, said again before declining
        said = rng.choice([q, _sentences(rng.choice(asked[lang])) or q]) if asked.get(lang) else q
        at = rng.randrange(len(said))
        out.append((_shell(rng, " ".join(said[at : at + rng.choice([1, 1, 2, 3])]) + " " + _refusal(rng, known, held), rng.choice([None, ""])), "refusal"))
    if use(0.4):
        out.append((rng.choice(_EMPTY), "empty"))
    return out


def count_pairs(responses: Iterable[str | None], languages: Languages, numbers: _Numbers) -> np.ndarray:
    """By language, the answers in which each bucket of word pairs occurs, and last the number of answers counted."""
    out = np.zeros((max(1, len(languages.names)), BUCKETS + 1), np.int32)
    for r in responses:
        n = np.array([numbers[w] for w in words(_QUOTED.sub(" ", read_answer(r).prose))], np.int64)
        if len(n) >= COMMON_WORDS:
            at = np.unique(_grams(n, 2) % np.uint64(BUCKETS)).astype(np.int64)
            out[int(np.argmax(languages.scores(n))), np.append(at, BUCKETS)] += 1
    return out


def count_all(answers: DataFrame, languages: Languages) -> np.ndarray:
    """``count_pairs`` over a whole table (response): each task sends its sums, one table of fixed size reaches the driver."""
    held = answers.sparkSession.sparkContext.broadcast(languages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, total = _Numbers(), 0
        for b in batches:
            total = total + count_pairs((r if isinstance(r, str) else None for r in b["response"]), held.value, numbers)
        if not isinstance(total, int):
            k, at = np.nonzero(total)
            yield pd.DataFrame({"k": k.astype(np.int32), "at": at.astype(np.int32), "n": total[k, at]})

    sums = answers.select("response").mapInPandas(count, "k int, at int, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n"))
    got = sums.toArrow().to_pandas()  # at most (known languages) * (BUCKETS + 1) rows
    out = np.zeros((max(1, len(languages.names)), BUCKETS + 1), np.int64)
    out[got["k"].to_numpy(), got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def read_languages(sample: DataFrame) -> Languages:
    """Languages of a labelled sample (input, response, lang): tasks read the texts, their distinct words reach the driver."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for b in batches:
            rows = [(k, np.unique([numbers[w] for w in words(t or "") if not w.isdigit()]).astype(np.int64)) for i, r, k in zip(b["input"], b["response"], b["lang"]) for t in (i, read_answer(r).prose)]
            yield pd.DataFrame({"lang": [k for k, _ in rows], "words": [w for _, w in rows]})

    got = sample.where("lang is not null").select("input", "response", "lang").mapInPandas(read, "lang string, words array<bigint>").toArrow().to_pandas()
    many = Counter(got["lang"])
    got = got[got["lang"].map(many) >= LANGUAGE_TEXTS]
    got = got.assign(order=got["words"].map(lambda w: (len(w), tuple(w)))).sort_values(["lang", "order"])
    return Languages(got["words"].tolist(), got["lang"].tolist())


def training_rows(sample: DataFrame, reader: Reader, pool: dict[str, list[str]], asked: dict[str, list[str]], seed: int = 5) -> Rows:
    """Rows made from a settled sample (base, task, input, response, lang), a part of it in each task."""
    held = sample.sparkSession.sparkContext.broadcast((reader, pool, asked))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, pool, asked = held.value
        for b in batches:
            out = []
            for i, task, inp, r, lang in zip(b["base"], b["task"], b["input"], b["response"], b["lang"]):
                task, inp, r = task or "", inp or "", r if isinstance(r, str) else None
                source = reader.source(task, inp)
                if not isinstance(lang, str):
                    lang = reader.languages.names[int(np.argmax(source.scores))] if reader.languages.names else None
                for k, (x, label) in enumerate(made_from(random.Random(f"{seed}-{i}"), task, inp, r, lang, pool, asked, bool(held_out(np.array([i]))[0]))):
                    out.append((i, k == 0, -1 if label is None else LABELS.index(label), *reader.features(x, source)))
            yield pd.DataFrame(out, columns=["base", "plain", "label", "dense", "grams", "values"])

    got = sample.mapInPandas(make, "base bigint, plain boolean, label int, dense array<float>, grams array<int>, values array<float>").toArrow()
    base, plain, label = (got[c].to_numpy() for c in ("base", "plain", "label"))
    order = np.lexsort((np.arange(len(base)), base))
    lists = lambda c: [x for part in got[c].chunks for x in np.split(part.flatten().to_numpy(), part.offsets.to_numpy()[1:-1] - part.offsets.to_numpy()[0])] if len(base) else []
    pick = lambda xs: [xs[i] for i in order]
    dense = pick(lists("dense"))
    return Rows(np.array(dense, np.float32).reshape(-1, len(DENSE)), pick(lists("grams")), pick(lists("values")), label[order], base[order], plain[order])


def train(spark: SparkSession, reader: Reader, rows: Rows) -> Classifier:
    """One fit for each label, in tasks of their own: first on each half of the sample's pairs, then without those suspected.

    A pair is suspected by the model of the half it isn't in; all that was made from it would teach that its defect is sound.
    """
    if not len(rows.base):
        return Classifier(reader, np.zeros((GRAMS, len(LABELS)), np.float32), np.zeros((len(DENSE), len(LABELS)), np.float32), np.full(len(LABELS), 1.0))
    half = (rows.base.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(60) & np.uint64(1)).astype(np.int64)
    held = spark.sparkContext.broadcast((rows, half))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, half = held.value
        for b in batches:
            for i in b["id"]:
                h, k = divmod(int(i), len(LABELS))
                if (half == h).any():
                    w, d, threshold = fit_label(rows.take(half == h), k)
                    other = rows.take((half != h) & rows.plain)
                    yield pd.DataFrame({"base": other.base[other.logits(w, d) > threshold - SUSPECT]})

    suspect = np.array([r.base for r in spark.range(0, 2 * len(LABELS), 1, 2 * len(LABELS)).mapInPandas(first, "base bigint").distinct().collect()], np.int64)  # ids of the sample
    use = ~np.isin(rows.base, suspect)
    held_use = spark.sparkContext.broadcast(use if use.any() else np.ones(len(use), bool))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                w, d, threshold = fit_label(held.value[0].take(held_use.value), int(k))
                yield pd.DataFrame({"k": [int(k)], "w": [w.tobytes()], "d": [d.tobytes()], "threshold": [threshold]})

    got = sorted(spark.range(0, len(LABELS), 1, len(LABELS)).mapInPandas(last, "k int, w binary, d binary, threshold double").collect())
    return Classifier(reader, np.column_stack([np.frombuffer(r.w, np.float32) for r in got]), np.column_stack([np.frombuffer(r.d, np.float32) for r in got]), np.array([r.threshold for r in got]))


def fit(pairs: DataFrame, sample_pairs: int = SAMPLE_PAIRS) -> Classifier:
    """A classifier for settled pairs (field_name, record_id, task, input, lang, response), each record once."""
    spark = pairs.sparkSession
    n = pairs.count()
    sizes = pairs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    u = F.pmod(F.xxhash64("field_name", "record_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.greatest(F.lit(sample_pairs / max(n, 1)), F.when(F.col("lang").isNotNull(), F.lit(SAMPLE_PER_LANGUAGE) / F.col("n")).otherwise(0.0))
    r = pairs.join(sizes.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).where(u < rate)
    sample = r.select(F.xxhash64("field_name", "record_id").bitwiseAND(F.lit((1 << 62) - 1)).alias("base"), "task", "input", "response", "lang")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    sample = settle(sample.repartition(tasks, "base"), "sample")
    languages = read_languages(sample)
    count = count_all(pairs, languages)
    reader = Reader(languages, count[:, :-1] >= np.maximum(COMMON_LEAST, COMMON_SHARE * count[:, -1:]))
    few = Window.partitionBy("lang").orderBy("base")
    pool: dict[str, list[str]] = {}
    asked: dict[str, list[str]] = {}
    some = sample.where("lang is not null and length(response) > 40").withColumn("r", F.row_number().over(few)).where(F.col("r") <= POOL)
    for x in some.select("lang", "response", "input").orderBy("lang", "base").collect():  # POOL answers and inputs a language
        pool.setdefault(x.lang, []).append(x.response)
        if x.input:
            asked.setdefault(x.lang, []).append(x.input)
    return train(spark, reader, training_rows(sample, reader, pool, asked))


def _threshold(z: np.ndarray, y: np.ndarray, near: float = 0.004) -> float:
    """The middle of the logits whose F1 on the holdouts is the best or next to it, so that single odd rows don't move it."""
    if not len(z):
        return 0.0
    order = np.argsort(-z, kind="stable")
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(z) + 1) + max(1, y.sum()))
    good = np.nonzero(f1 >= f1.max() * (1 - near))[0]
    s = np.append(z[order], z.min() - 1)
    return float((s[good[0]] + s[good[-1] + 1]) / 2)


def spread(pairs: DataFrame) -> DataFrame:
    """Each record once, in a table spread by record: no hot prompt's answers are one task's, and the joins behind it run once."""
    row = F.struct("key", "task", "input", "lang", "response")
    p = pairs.select("field_name", F.col("record_id").cast("bigint").alias("record_id"), row.alias("x")).where(F.col("record_id").isNotNull())
    return settle(p.groupBy("field_name", "record_id").agg(F.min("x").alias("x")).select("field_name", "record_id", "x.*"), "pairs")


def broken_pairs(pairs: DataFrame, sample_pairs: int = SAMPLE_PAIRS) -> DataFrame:
    """Distinct (field_name, record_id, defect) of the defective ones among ``pairs``.

    ``pairs`` has field_name, record_id, key (of the prompt), task, input, lang, response; rows of one prompt need not be
    together, but are read faster if they are. A null or blank response is ``empty``; null task, input and lang count as
    empty texts and an unknown language. Rows delivered again count once; an empty table gives no rows.
    """
    p = spread(pairs)
    spark = p.sparkSession
    schema = "field_name string, record_id bigint, defect string"
    if p.isEmpty():
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(fit(p, sample_pairs))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        sources: OrderedDict[tuple, Source] = OrderedDict()
        for b in batches:
            out = []
            for f, i, task, inp, r in zip(b["field_name"], b["record_id"], b["task"], b["input"], b["response"]):
                k = (task or "", inp or "")
                source = sources.pop(k, None) or c.reader.source(*k)
                sources[k] = source
                if len(sources) > SOURCES:
                    sources.popitem(last=False)
                defect = c.defect(r if isinstance(r, str) else None, source)
                if defect:
                    out.append((f, i, defect))
            yield pd.DataFrame(out, columns=["field_name", "record_id", "defect"])

    return p.select("field_name", "record_id", "task", "input", "response").mapInPandas(classify, schema)
