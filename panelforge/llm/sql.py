"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from panelforge.llm import quality as q
from panelforge.llm import url_filter
from panelforge.llm.code_compression import Codebooks
from panelforge.llm.topk_search import Voronoi

#: White space in a character class of DuckDB's patterns.
BLANK = r"\x20\x09-\x0D"


def quality_rules() -> str:
    lefts, last = [], "t"
    for name, pattern in q.CLASSES.items():
        lefts.append(f"regexp_replace({last}, '{pattern}+', '', 'g') AS left_{name}")
        last = f"left_{name}"
    steps = ", ".join(lefts)
    names = ["t", *(f"left_{n}" for n in q.CLASSES)]
    classes = ", ".join([*(f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)), f"length({names[-1]})"])
    words = ", ".join([*(f"len(list_filter(ws, lambda x: x = '{w}'))" for w in q.COMMON_WORDS), f"len(list_filter(ws, lambda x: x NOT IN ({', '.join(repr(w) for w in q.COMMON_WORDS)})))"])
    sums = ", ".join(f"sum(c[{i + 1}])" for i in range(q.N_CLASSES))
    word_sums = ", ".join(f"sum(w[{i + 1}])" for i in range(len(q.COMMON_WORDS) + 1))

    def distance(counts: str, reference: str, n: int) -> str:
        p, s = f"({counts}[i] / list_sum({counts}))", f"({reference}[i] / list_sum({reference}))"
        term = " + ".join(f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {s}) / 2)) ELSE 0 END" for x in (p, s))
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: {term})) / 2))"

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
base AS (SELECT *, regexp_extract_all(t, '[^{BLANK}]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS ls, {steps} FROM d),
spots AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
  unnest(list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))) AS three FROM base WHERE len(ws) >= 3),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM spots),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM marked WHERE n > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
f AS (SELECT base.doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '[{BLANK}]+', '', 'g')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, [{classes}] AS c, [{words}] AS w
  FROM base LEFT JOIN repeated USING (doc_id)),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
r AS (SELECT lang, [{sums}] AS rc, [{word_sums}] AS rw FROM b WHERE NOT base_failed AND lang IS NOT NULL
  GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {q.MAX_LANGUAGES}),
near AS (SELECT b.doc_id, bool_or((list_sum(c) < {q.MIN_CLASS_CHARS} OR {distance("c", "rc", q.N_CLASSES)} <= {q.MAX_CLASS_DISTANCE})
  AND (n_words < {q.MIN_COMMON_WORDS} OR {distance("w", "rw", len(q.COMMON_WORDS) + 1)} <= {q.MAX_WORD_DISTANCE})) AS ok
  FROM b CROSS JOIN r GROUP BY b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN near USING (doc_id)
"""


def url_rules() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.host, p.path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (host, path)
"""


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def vector_codes() -> str:
    p = Codebooks()
    distance = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    steps = []
    for turn in range(p.rounds + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (SELECT id, vec_id, part, v, min({p.entries} * {distance} + entry) AS best
  FROM pieces JOIN book{turn} USING (part) GROUP BY id, vec_id, part, v)""")
        if turn < p.rounds:
            steps.append(f"""mean{turn + 1} AS (SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY i) AS c FROM (
  SELECT part, best % {p.entries} AS entry, i, sum(v[i]) AS total, count(*)::DOUBLE AS n FROM a{turn}, (SELECT unnest(range(1, 4097)) AS i) WHERE i <= len(v) GROUP BY ALL) GROUP BY part, entry),
book{turn + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{turn} b LEFT JOIN mean{turn + 1} m USING (part, entry))""")
    last = p.rounds
    return f"""
WITH x AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
  list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE {FINITE}),
pieces AS MATERIALIZED (SELECT id, vec_id, part, e[part * len(e) // {p.parts} + 1:(part + 1) * len(e) // {p.parts}] AS v
  FROM x, (SELECT unnest(range(0, {p.parts})) AS part)),
book0 AS (SELECT part, id - 1 AS entry, v AS c FROM pieces WHERE id <= {p.entries}),
{", ".join(steps)},
coded AS (SELECT id, string_agg(printf('%02x', (best % {p.entries})::INT), '' ORDER BY part) AS code, sum(best // {p.entries})::BIGINT AS error FROM a{last} GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN x USING (id), digest
"""


def top_products() -> str:
    p = Voronoi()
    return f"""
WITH x AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id,
  list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)) AS e FROM embeddings WHERE {FINITE}),
pairs AS (SELECT q.id, q.vec_id AS query_id, c.id AS other, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM x q JOIN x c ON q.id <> c.id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id, other)::INT AS rank FROM pairs) WHERE rank <= {p.k}
"""
