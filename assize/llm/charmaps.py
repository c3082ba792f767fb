"""Which characters deviate from their usual form, and what they stand for."""

from __future__ import annotations

import functools
import re
import unicodedata

#: Letters of other scripts that look like a Latin letter, in natural order; each pair is letter and look-alike.
CYRILLIC_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "Ѕ": "S", "І": "I", "Ј": "J", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ү": "y",
}
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϳ": "j", "ϲ": "c", "Ϲ": "C",
}

#: Ranges of code points by kind of deviation.
FULLWIDTH = "　！-｠￠-￦"
COMBINING = "̀-͎͐-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
ZERO_WIDTH = "­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿"
NBSP = "   "

#: Scripts by their number; a letter of none of them is 0.
LATIN, CYRILLIC, GREEK = 1, 2, 3
SCRIPT_RANGES = {LATIN: "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿＡ-Ｚａ-ｚ", CYRILLIC: "Ѐ-ԯᲀ-᲏ⷠ-ⷿꙀ-ꚟ", GREEK: "Ͱ-Ͽἀ-῿"}


def members(ranges: str) -> list[int]:
    """The code points of a regular expression's range text."""
    out, i = [], 0
    while i < len(ranges):
        if ranges[i + 1 : i + 2] == "-":
            out += range(ord(ranges[i]), ord(ranges[i + 2]) + 1)
            i += 3
        else:
            out.append(ord(ranges[i]))
            i += 1
    return out


@functools.cache
def lookalikes() -> dict[tuple[str, int], str]:
    """(letter, target script) -> the letter of that script that it looks like; both ways between all three scripts."""
    out: dict[tuple[str, int], str] = {}
    for script, pairs in ((CYRILLIC, CYRILLIC_LOOKALIKES), (GREEK, GREEK_LOOKALIKES)):
        for x, latin in pairs.items():
            out.setdefault((x, LATIN), latin)
            out.setdefault((latin, script), x)
    for c, latin in CYRILLIC_LOOKALIKES.items():
        if (latin, GREEK) in out:
            out.setdefault((c, GREEK), out[latin, GREEK])
            out.setdefault((out[latin, GREEK], CYRILLIC), c)
    return out


@functools.cache
def scripts() -> dict[str, int]:
    """Letter -> number of its script."""
    return {chr(cp): k for k, r in SCRIPT_RANGES.items() for cp in members(r) if chr(cp).isalpha()}


@functools.cache
def decompositions() -> list[tuple[int, int, int, int]]:
    """(code point, position, part, combining class) of all canonical decompositions, from Python's character database."""
    out = []
    for cp in range(0xC0, 0x30000):
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000:
            continue
        d = unicodedata.normalize("NFD", chr(cp))
        if d != chr(cp):
            out += [(cp, i, ord(x), unicodedata.combining(x)) for i, x in enumerate(d)]
    return out


@functools.cache
def wide() -> dict[int, int]:
    """Full-width form -> usual form."""
    return {cp: ord(n) for cp in members(FULLWIDTH) if len(n := unicodedata.normalize("NFKC", chr(cp))) == 1 and ord(n) != cp}


@functools.cache
def _plain() -> dict[str, str]:
    """What goes without looking at the word: full-width forms, characters without width, non-breaking spaces."""
    return {**{chr(a): chr(b) for a, b in wide().items()}, **{chr(c): "" for c in members(ZERO_WIDTH)}, **{chr(c): " " for c in members(NBSP)}}


_PLAIN = re.compile(f"[{FULLWIDTH}{ZERO_WIDTH}{NBSP}]")
_MARKS = f"{COMBINING}"
_LATIN = re.compile(f"[{SCRIPT_RANGES[LATIN]}]")
_CYRILLIC = re.compile(f"[{SCRIPT_RANGES[CYRILLIC]}]")
_GREEK = re.compile(f"[{SCRIPT_RANGES[GREEK]}]")
_RUN = re.compile(f"[^\\W_](?:[^\\W_]|[{_MARKS}])*")
_ALL_ALIKE = re.compile(f"[{''.join(CYRILLIC_LOOKALIKES)}{''.join(GREEK_LOOKALIKES)}{_MARKS}0-9]+")


def resolve(word: str, spread: tuple[int, ...]) -> str:
    """One decomposed word in the script of its other letters. ``spread``: scripts of the text's unmistakable words.

    The target script is one into which all other letters of the word can turn; of several, that of most letters, then one
    of the unmistakable words, then the lowest. A word wholly of look-alikes turns only if the text has no unmistakable
    word of its own script.
    """
    known, table = scripts(), lookalikes()
    of = [known.get(c, 0) for c in word]
    own = {s for s in of if s}
    can = [t for t in (LATIN, CYRILLIC, GREEK) if all(not s or s == t or (c, t) in table for c, s in zip(word, of))]
    if len(own) == 1:
        s = next(iter(own))
        if sum(map(bool, of)) < 2 or s in spread:
            return word
        can = [t for t in can if t != s and t in spread]
    else:
        can = [t for t in can if t in own]
    if not can:
        return word
    t = min(can, key=lambda t: (-of.count(t), t not in spread, t))
    return "".join(c if not s or s == t else table[c, t] for c, s in zip(word, of))


def only(script: int) -> str:
    """The letters, as a regular expression's ranges, that decide a word's script: they look like no other's."""
    alike = {c for c, _ in lookalikes()}
    cps = sorted(cp for c, s in scripts().items() if s == script and (cp := ord(c)) < 0x530 and unicodedata.normalize("NFD", c)[0] not in alike and cp not in wide())
    spans: list[list[int]] = []
    for cp in cps:
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans)


@functools.cache
def _unmistakable() -> dict[int, re.Pattern]:
    inside = f"(?:[^\\W_]|[{_MARKS}])"
    return {s: re.compile(f"(?<![^\\W_])(?<![{_MARKS}])(?={inside}*[{only(s)}])[{SCRIPT_RANGES[s]}{_MARKS}0-9]{{2,}}(?!{inside})") for s in SCRIPT_RANGES}


def unmistakable(text: str) -> tuple[int, ...]:
    """Scripts that a word of two or more letters is wholly in, with a letter that looks like no other script's."""
    return tuple(s for s, r in _unmistakable().items() if r.search(text))


def undo(text: str) -> str:
    """The consistent form of one text: what the operator on code points gives, for use inside other operators."""
    if text.isascii():
        return text
    t = _PLAIN.sub(lambda m: _plain().get(m.group(), m.group()), text)
    if _CYRILLIC.search(t) or _GREEK.search(t):
        spread: list[tuple[int, ...]] = []

        def turn(m: re.Match) -> str:
            w = m.group()
            if w.isascii() or ((bool(_LATIN.search(w)) + bool(_CYRILLIC.search(w)) + bool(_GREEK.search(w))) < 2 and not _ALL_ALIKE.fullmatch(w)):
                return w
            if not spread:
                spread.append(unmistakable(t))
            d = unicodedata.normalize("NFD", w)
            return x if (x := resolve(d, spread[0])) != d else w

        t = _RUN.sub(turn, t)
    return t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
