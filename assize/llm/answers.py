"""Reading one judge answer: shell (fence, JSON, list, prose), its own prose, its verdict, and whether it is finished.

Pure Python on one string, shared by the truncation and the broken-pair operators, which run it over Arrow batches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from typing import NamedTuple

#: Abbreviations after which a full stop ends no sentence, by language.
ABBREVIATIONS = frozenset(
    "approx cf e.g i.e viz vs incl excl dr mr mrs ms prof eqs figs nos"  # en
    " ca bzw vgl z.b d.h inkl zzgl bsp ggf evtl"  # de
    " env p.ex c.-à-d aprox núm págs p.ej sra"  # fr, es
    " прибл ср т.е рис стр напр".split()  # ru
)

#: What stands in place of an answer when there is none.
PLACEHOLDERS = frozenset(
    ["n/a", "na", "none", "null", "nil", "nan", "undefined", "empty", "error", "err", "failed", "failure", "timeout", "timed out", "no output", "no answer", "no response", "no content", "no data", "not available", "unavailable", "missing", "blank", "tbd", "tba", "todo", "placeholder", "internal error", "internal server error", "server error", "request failed", "generation failed", "api error", "rate limit exceeded", "keine antwort", "sin respuesta", "aucune réponse", "sans réponse", "tidak ada", "kosong", "нет ответа", "нет данных", "ошибка", "fehler"]
)

_FENCE = re.compile(r"^(`{3,}|~{3,})[^\n`]*(?:\n|$)")
_TAGS = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
_VALUE = r"(?:response[ _]?[12]|true|false|yes|no|\d{1,3}(?:[.,]\d+)?(?:\s*/\s*\d{1,3})?)"
_LABEL = r"[^\W\d_]+(?:[ _][^\W\d_]+){0,2}"
_BARE = re.compile(rf"^[\s\W_]*{_VALUE}[\s\W_]*$", re.I)
_LABELLED = re.compile(rf"^[\s\W_]*{_LABEL}[\s*_`\"]*[:=][\s*_`\"\[(]*{_VALUE}[\s\W_]*$", re.I)
_INLINE = re.compile(rf"(?<=[.!?…»”\")])\s+[*_`]*{_LABEL}[*_`]*\s*[:=]\s*[*_`\"\[(]*{_VALUE}[\s\W_]*$", re.I)
_ARROW = re.compile(rf"(?<=[.!?…»”\")])\s*(?:[=\-–—]*[>→⇒]+|[–—|/]+)\s*[*_`\"\[(]*{_VALUE}[\s\W_]*$", re.I)
_ASIDE = re.compile(r"(?<=[.!?…»”\")])\s*[(\[<][^()\[\]<>]{1,40}[)\]>]\s*$")
_OPEN_VERDICT = re.compile(r"^[\s*_`#\"]*(?:final |overall )?(?:score|verdict|rating)[\s*_`\"]*[:=]?[\s*_`\"\[(]*(?:resp(?:onse?)?)?\s*$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*+•–◦‣]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_BARE_ITEM = re.compile(r"^\s*(?:[-*+•◦‣]|\(?\d{1,3}[.)])\s*$")
_ENCLOSED = re.compile(r"^\s*(?:\(.*\)|\[.*\]|<.*>|[—–\-=*_~#]{3,})\s*$")
_RULED = re.compile(r"^\s*([—–\-=*_~#]{1,5})(?![—–\-=*_~#])(.*\S.*?)(?<![—–\-=*_~#])([—–\-=*_~#]{1,5})\s*$")
_ELLIPSIS = re.compile(r"\s*(?:[\[(]\s*(?:…|\.{3,})\s*[\])]|…|\.{3,})$")
_MARKUP = re.compile(r"^\s*[*_`#~>-]{1,2}\s*$")
_CLOSERS = "\"'”’»›)]}*_`>“"
_STOPS = ".!?…。！？؟।"
_PAIRS = (("“", "”"), ("«", "»"), ("„", "“"), ("(", ")"), ("[", "]"))
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)
_SENTENCES = re.compile(r"(?<=[.!?…])[\"”»’)\]]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+")


class Answer(NamedTuple):
    shell: str  # empty, verdict, json, prose or list
    prose: str  # the answer's own text without shell, keys and verdict
    verdict: bool
    cut: bool  # unfinished by its own form
    tail: str  # the last sentence of the prose, for the search among longer copies


def ends_open(prose: str) -> bool:
    """Whether running text stops within a word or sentence: no closing mark, or only an abbreviation's full stop."""
    t = prose.rstrip()
    if t.endswith("\ufffd"):  # the rest of a character is missing
        return True
    if m := _ELLIPSIS.search(t):  # marks what was left out, unless a sentence was complete before
        before = t[: m.start()].rstrip(_CLOSERS + " \n\t")
        return not before or before[-1] not in _STOPS
    core = t.rstrip(_CLOSERS + " \n\t")
    if not core:
        return False
    if core[-1] not in _STOPS:
        return True
    if core[-1] == ".":
        last = core.rsplit(None, 1)[-1].lstrip("(\"“«'").rstrip(".").lower()
        if last in ABBREVIATIONS and len(t) - len(core) == 0:
            return True
    last_line = t.rsplit("\n", 1)[-1]
    for a, b in _PAIRS:
        if a != "„" and last_line.count(a) > last_line.count(b) and last_line.rfind(a) > last_line.rfind(b):
            return not (a == "“" and "„" in last_line)
    return False


def last_sentence(prose: str) -> str:
    t = prose.strip()
    parts = [p for p in _SENTENCES.split(t) if p]
    while len(parts) > 1 and parts[-2].rsplit(None, 1)[-1].rstrip(".").lower() in ABBREVIATIONS:
        at = t.rfind(parts[-2])
        parts = [*parts[:-2], t[at:]]
    return re.sub(r"^\s*(?:[-*+•>]|\d{1,3}[.)])\s+", "", parts[-1]).strip() if parts else ""


def _strings(x: object, key: str = "") -> list[tuple[str, str]]:
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in _strings(v, str(k))]
    if isinstance(x, list):
        return [y for v in x for y in _strings(v, key)]
    return [(key, "" if x is None else x if isinstance(x, str) else json.dumps(x))]


def is_placeholder(text: str) -> bool:
    core = re.sub(r"^[\s\W_]+|[\s\W_]+$", "", text).lower()
    return not core or core in PLACEHOLDERS or (len(core) < 60 and core.split(":")[0].strip() in ("error", "exception", "traceback", "fehler", "ошибка"))


def is_remark(line: str) -> bool:
    """A line wholly within brackets or between the same rules on both sides."""
    m = _RULED.match(line)
    return bool(_ENCLOSED.match(line)) or (m is not None and m.group(1) == m.group(3))


def is_verdict(text: str) -> bool:
    return bool(_BARE.match(text) or _LABELLED.match(text))


def _plain(body: str) -> Answer:
    lines = [x for x in body.split("\n") if x.strip()]
    verdict = False
    if len(lines) > 1 and _BARE_ITEM.match(lines[-1]) and any(_ITEM.match(x) for x in lines[:-1]):
        return Answer("list", "\n".join(lines[:-1]), False, True, lines[-1].strip())
    while lines and is_verdict(lines[-1]):
        verdict = True
        lines.pop()
    if not lines:
        return Answer("verdict", "", True, False, "")
    lines[-1] = lines[-1].rstrip()
    signed = len(lines[-1])
    while lines[-1] and lines[-1][-1] != "\ufffd" and unicodedata.category(lines[-1][-1]) in ("So", "Sm", "Sk", "Cn", "Mn"):
        lines[-1] = lines[-1][:-1].rstrip()
    signed = len(lines[-1]) < signed
    if not lines[-1]:
        lines.pop()
        if not lines:
            return Answer("verdict", "", False, False, "")
    if not verdict and (m := _INLINE.search(lines[-1]) or _ARROW.search(lines[-1])):
        lines[-1], verdict = lines[-1][: m.start()], True
    if not verdict and (_OPEN_VERDICT.match(lines[-1]) or (len(lines) > 1 and _MARKUP.match(lines[-1]))):
        return Answer("prose", "\n".join(lines), False, True, lines[-1].strip())
    closed = verdict or signed
    if not closed and (m := _ASIDE.search(lines[-1])) and lines[-1][: m.start()].strip():
        lines[-1], closed = lines[-1][: m.start()], True
    while len(lines) > 1 and is_remark(lines[-1]):
        closed = True
        lines.pop()
    prose = "\n".join(lines)
    if closed:
        return Answer("prose", prose, verdict, False, "")
    items = [x for x in lines if _ITEM.match(x)]
    if items and _ITEM.match(lines[-1]):
        stops = [not ends_open(x) for x in items[:-1]]
        # entries that all go without a full stop are finished as they are
        return Answer("list", prose, False, ends_open(lines[-1]) and any(stops), last_sentence(lines[-1]))
    return Answer("prose", prose, False, ends_open(prose), last_sentence(prose))


def _json(body: str) -> Answer | None:
    decoder = json.JSONDecoder(strict=False)
    try:
        x, end = decoder.raw_decode(body)
    except ValueError:
        found = [m for m in _STRING.finditer(body)]
        texts = [m.group(1) for m in found if len(m.group(1)) > 24 or not m.group(2)]
        prose = " ".join(texts).replace("\\n", "\n").replace('\\"', '"')
        return Answer("json", prose, False, True, last_sentence(prose))
    if not isinstance(x, (dict, list)):
        return None
    leaves = _strings(x)
    filled = [v for _, v in leaves if not is_placeholder(v)]
    rest = body[end:].strip()
    if not filled and not rest:
        return Answer("empty", "", False, False, "")
    texts = [v for v in filled if not is_verdict(v)]
    prose = "\n".join(texts)
    if rest and not is_verdict(rest):
        after = _plain(rest)
        return Answer("json", (prose + "\n" + after.prose).strip(), after.verdict, after.cut, after.tail)
    if not texts:
        return Answer("verdict", "", True, False, "")
    return Answer("json", prose, len(texts) < len(filled), any(_plain(v).cut for v in texts), last_sentence(prose))


def read_answer(text: str | None) -> Answer:
    """Null, blank, an empty shell or a placeholder gives shell ``empty``; texts of any length are read whole."""
    s = (text or "").strip()
    bare = _TAGS.sub(" ", s)
    if is_placeholder(bare):
        return Answer("empty", "", False, False, "")
    fence = _FENCE.match(s)
    if fence:
        body = s[fence.end() :].strip()
        closed = body.endswith(fence.group(1))
        body = body[: -len(fence.group(1))].strip() if closed else body
        if is_placeholder(body):
            return Answer("empty", "", False, False, "") if closed else Answer("prose", "", False, True, "")
        inner = read_answer(body) if not _FENCE.match(body) else _plain(body)
        return inner if closed else inner._replace(cut=True)
    if s[0] in "{[" and not _BARE.match(s):
        got = _json(s)
        if got is not None and not (s[0] == "[" and got.cut and not s.startswith('["') and not s.startswith("[{")):
            return got
    return _plain(s)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())
