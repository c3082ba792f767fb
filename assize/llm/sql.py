"""DuckDB's SQL for the queries of the subpackage that SQL can express, written apart from the operators."""

from __future__ import annotations

from assize.llm import charmaps as M

_P3 = r"""t AS (SELECT DISTINCT ON (id) id, coalesce(input, prompt) AS text FROM prompts ORDER BY id),
w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM t),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
f AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * c >= x.n + y.n - c)"""
P3_FOUND = f"WITH {_P3} SELECT id_a, id_b FROM f"
P3_GROUPS = (
    f"WITH RECURSIVE {_P3}, s AS (SELECT id, md5(string_agg(g, '|' ORDER BY g)) AS s FROM g GROUP BY 1), e AS (SELECT id_a AS u, id_b AS v FROM f UNION ALL SELECT id_b, id_a FROM f), "
    "l AS (SELECT s1.s, count(DISTINCT s2.s) AS n_links FROM e JOIN s s1 ON s1.id = u JOIN s s2 ON s2.id = v WHERE s1.s <> s2.s GROUP BY 1), "
    "reach AS (SELECT id, id AS other FROM s UNION SELECT reach.id, e.v FROM reach JOIN e ON e.u = reach.other) "
    "SELECT reach.id, min(other) AS group_id, coalesce(any_value(l.n_links), 0) AS n_links FROM reach JOIN s ON s.id = reach.id LEFT JOIN l ON l.s = s.s GROUP BY 1"
)

_WIDE = M.wide()
_FROM = "".join(map(chr, _WIDE)) + "".join(M.CYRILLIC_LOOKALIKES) + "".join(M.GREEK_LOOKALIKES)
_TO = "".join(chr(v).replace("'", "''") for v in _WIDE.values()) + "".join(M.CYRILLIC_LOOKALIKES.values()) + "".join(M.GREEK_LOOKALIKES.values())


def _words(table: str, id: str) -> str:
    # all look-alikes become Latin on both sides: what is compared is the skeleton of the words
    plain = f"lower(translate(nfc_normalize(regexp_replace(text, '[{M.ZERO_WIDTH}]', '', 'g')), '{_FROM}', '{_TO}'))"
    return f"SELECT {id} AS id, regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL"


def _runs(name: str) -> str:
    return f"SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS g FROM {name}, unnest(range(1, len(w) - 10)) AS r(i)"


P7_FOUND = f"WITH d AS ({_words('documents', 'doc_id')}), e AS ({_words('eval_items', 'item_id')}), x AS ({_runs('d')}), y AS ({_runs('e')}) SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM x JOIN y ON x.g = y.g"
P7_LEAK_REPORT = f"WITH p AS ({P7_FOUND}) SELECT e.item_id, benchmark, count(p.doc_id) AS n_docs FROM eval_items e LEFT JOIN p ON e.item_id = p.item_id GROUP BY 1, 2"


def _only(inside: str, outside: str) -> str:
    return f"(regexp_replace(w, '[{inside}0-9]', '', 'g') = '' AND regexp_matches(w, '[{outside}]'))"


_L, _C, _G = (M.SCRIPT_RANGES[s] for s in (M.LATIN, M.CYRILLIC, M.GREEK))
_CL, _GL = "".join(M.CYRILLIC_LOOKALIKES) + "ёЁїЇ", "".join(M.GREEK_LOOKALIKES)
_LC, _LG = "".join(M.CYRILLIC_LOOKALIKES.values()), "".join(M.GREEK_LOOKALIKES.values())
_ALIKE = " OR ".join([
    f"({_only(_L + _CL + _GL, _CL + _GL)} AND regexp_matches(w, '[{_L}]'))",
    f"({_only(_C + _LC, _LC)} AND regexp_matches(w, '[{_C}]'))",
    f"({_only(_G + _LG, _LG)} AND regexp_matches(w, '[{_G}]'))",
])
P8_FOUND = (
    " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS variant FROM documents WHERE regexp_matches(text, '[{r}]')" for k, r in (("fullwidth", M.FULLWIDTH), ("combining", M.COMBINING), ("zero_width", M.ZERO_WIDTH), ("nbsp", M.NBSP)))
    + f" UNION ALL SELECT DISTINCT doc_id, 'lookalike' FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(nfc_normalize(regexp_replace(text, '[{M.ZERO_WIDTH}]', '', 'g')), '[{M.COMBINING}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents) WHERE {_ALIKE}"
)

P6_INVARIANTS = "SELECT limit_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::bigint AS wrong, 0::bigint AS overfull FROM run_limits WHERE limit_name LIKE 'pack_tokens_%'"

ORACLES = {"p6_invariants": P6_INVARIANTS, "p3_found": P3_FOUND, "p3_groups": P3_GROUPS, "p7_found": P7_FOUND, "p7_leak_report": P7_LEAK_REPORT, "p8_found": P8_FOUND}
