"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

import re

from vigilark.llm.licenses import PHRASES, TEMPLATES, Automaton, fold

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _template_regex(markup: str) -> str:
    """A template over words that are each followed by one space."""
    out = ""
    for m in Automaton.token.finditer(markup):
        if m["words"]:
            out += "".join(w + " " for w in fold(m["words"]).decode().split())
        elif m[0] == "<<beginOptional>>":
            out += "(?:"
        elif m[0] == "<<endOptional>>":
            out += ")?"
        else:
            like = re.search('match="([^"]*)"', m["attrs"])
            low, high = re.search('words="([0-9]+)-([0-9]+)"', m["attrs"]).groups()
            out += f"(?:{like[1] if like else '[^ ]+'} ){{{low},{high}}}"
    return " " + out


_PHRASE_ROWS = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
_TEMPLATE_LABELS = ", ".join(f"CASE WHEN regexp_matches(line, '{_template_regex(m)}') THEN '{label}' END" for label, m in TEMPLATES.items())

LICENSES = f"""WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k FROM docs),
runs AS (SELECT doc_id, k, w || ' ' || lead(w, 1) OVER o AS two, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS three
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
found AS (SELECT doc_id, k, label FROM runs JOIN (VALUES {_PHRASE_ROWS}) p(phrase, label) ON phrase = two OR phrase = three),
base AS (SELECT doc_id, count(*) AS n, min(k) AS lo, max(k) AS hi, list_sort(list(DISTINCT label)) AS labels FROM found GROUP BY 1),
lines AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM docs),
more AS (SELECT doc_id, n_words, list_filter([{_TEMPLATE_LABELS}], lambda x: x IS NOT NULL) AS extra FROM lines)
SELECT doc_id, n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), extra))), ','), '') AS labels,
    CASE WHEN len(extra) > 0 THEN 1e0 WHEN n > 0 THEN 0.5e0 ELSE 0e0 END AS score
FROM more LEFT JOIN base USING (doc_id)"""

SUBSTRINGS = """WITH words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM
    (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
wins AS (SELECT doc_id, k, md5(string_agg(w, ' ') OVER o) AS h, count(*) OVER o AS n
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT h, min(doc_id) AS f FROM wins WHERE n = 50 GROUP BY h HAVING min(doc_id) < max(doc_id)),
dups AS (SELECT doc_id, k FROM wins JOIN firsts USING (h) WHERE n = 50 AND f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM dups),
marked AS (SELECT words.doc_id, words.k, w, gone.k IS NOT NULL AS cut FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE cut) AS n_removed,
    sha256(coalesce(string_agg(w, ' ' ORDER BY k) FILTER (WHERE NOT cut), '')) AS kept FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256
FROM documents LEFT JOIN sums USING (doc_id)"""

EMBEDDINGS = """WITH RECURSIVE usable AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.95e0),
reach AS (SELECT a AS id, a AS low FROM links UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.id WHERE reach.low < links.b),
lows AS (SELECT id, min(low) AS low FROM reach GROUP BY 1),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.id = vec_id LEFT JOIN lows ON lows.id = vec_id"""



def _vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Codebooks by rounds of nearest entries and floored means."""
    assigned = """near{k} AS (SELECT c.id, c.p, min(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {entries} + b.e) AS best
    FROM cells c JOIN book{k} b USING (p) GROUP BY 1, 2),"""
    moved = """sums{k} AS (SELECT p, e, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c.p, best % {entries} AS e, unnest(c.v) AS x, generate_subscripts(c.v, 1) AS d
    FROM cells c JOIN near{k} USING (id, p)) GROUP BY 1, 2, 3),
means{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v FROM sums{k} GROUP BY 1, 2),
book{j} AS (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (p, e)),"""
    steps = "\n".join(assigned.format(k=k, entries=entries) + "\n" + moved.format(k=k, j=k + 1, entries=entries) for k in range(rounds))
    return f"""WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) r(p)),
firsts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM kept QUALIFY e < {entries}),
book0 AS (SELECT p, e, v FROM firsts JOIN cells USING (id)),
{steps}
{assigned.format(k=rounds, entries=entries)}
coded AS (SELECT id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY 1),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) AS codebooks_sha256
    FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM book{rounds}))
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), digest"""


VECTOR_CODES = _vector_codes()

ORACLES: dict[str, str] = {"op4_licenses": LICENSES, "op5_embedding_dedup": EMBEDDINGS, "op6_substring_dedup": SUBSTRINGS, "op11_vector_codes": VECTOR_CODES}
