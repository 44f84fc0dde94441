"""Likeness of short texts in SQL: ratios by recursive matching, and the collapse of similar postings row by row.

The longest common block of two intervals is found over runs along the diagonals (longest, then first in
the left, then first in the right text); the intervals before and after it follow, until nothing is common.
"""

from __future__ import annotations

from postlode.plans import oracle as o

#: Postings made of whole documents: the first words as title, the source as company (each fifth unknown).
TITLED = """titled AS (
    SELECT doc_id AS seq, array_to_string((regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))[1:3 + doc_id % 3], ' ') AS job_title,
           CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE source END AS company_name, '' AS location, '' AS job_url,
           CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) || ' EUR' ELSE '' END AS salary, coalesce(text, '') AS job_description
    FROM documents
)"""


def held(rows: str, filled: tuple[str, ...] = ("salary",)) -> str:
    """CTE ``held``: what of prepared postings decides on likeness, and the fields that merging fills."""
    return f"""held AS MATERIALIZED (
    SELECT *, regexp_replace(core, '[^a-z0-9]', '', 'g')[1:6] AS block FROM (
        SELECT seq, job_title, company_name, {', '.join(filled)}, length(job_description) AS size, {o.core('normalized_title')} AS core,
               CASE WHEN company_name NOT IN ('', 'Unknown') THEN normalized_company END AS company
        FROM {rows})
)"""


#: Titled postings have no address: of equal signatures the first stays.
TITLED_ROWS = f"""{TITLED}, {o.prepared('titled')},
firsts AS (SELECT * FROM keyed_rows QUALIFY row_number() OVER (PARTITION BY mark ORDER BY seq) = 1), {held('firsts')}"""

_WORDS = "list_sort(list_distinct(string_split({0}, ' ')))"


def ratios(asked: str) -> str:
    """CTEs ending in ``ratio(x, y, left_ratio, right_ratio, both_ratio)`` for the pairs of ``asked(x, y)``."""
    return f"""sides AS MATERIALIZED (
    SELECT x, y, array_to_string({_WORDS.format('x')}, ' ') AS l, array_to_string({_WORDS.format('y')}, ' ') AS r,
           array_to_string(list_sort(list_intersect({_WORDS.format('x')}, {_WORDS.format('y')})), ' ') AS s
    FROM (SELECT DISTINCT x, y FROM {asked}) WHERE x <> '' AND y <> ''
), q AS MATERIALIZED (
    SELECT row_number() OVER () AS q, a, b FROM (SELECT s AS a, l AS b FROM sides UNION SELECT s, r FROM sides UNION SELECT l, r FROM sides)
), runs AS MATERIALIZED (
    WITH l AS (SELECT q, i, a[i] AS c FROM q, unnest(range(1, length(a) + 1)) AS t(i)), r AS (SELECT q, j, b[j] AS c FROM q, unnest(range(1, length(b) + 1)) AS t(j)),
    same AS (SELECT q, i, j, i - row_number() OVER (PARTITION BY q, i - j ORDER BY i) AS island FROM l JOIN r USING (q, c))
    SELECT q, i - 1 AS i, j - 1 AS j, count(*) OVER (PARTITION BY q, i - j, island ORDER BY i DESC) AS k FROM same
), part(q, alo, ahi, blo, bhi) AS (
    SELECT q, 0, length(a), 0, length(b) FROM q
    UNION ALL
    SELECT q, CASE WHEN e = 0 THEN alo ELSE i + k END, CASE WHEN e = 0 THEN i ELSE ahi END, CASE WHEN e = 0 THEN blo ELSE j + k END, CASE WHEN e = 0 THEN j ELSE bhi END
    FROM (
        SELECT q, alo, ahi, blo, bhi, m // 1000000 AS k, 999 - m // 1000 % 1000 AS i, 999 - m % 1000 AS j FROM (
            SELECT p.q, alo, ahi, blo, bhi, max(1000000 * least(k, ahi - i, bhi - j) + 1000 * (999 - i) + 999 - j) AS m
            FROM part p JOIN runs s ON s.q = p.q AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY ALL)
    ), (VALUES (0), (1)) AS ends(e)
    WHERE CASE WHEN e = 0 THEN i > alo AND j > blo ELSE i + k < ahi AND j + k < bhi END
), matched AS (
    SELECT q, sum(k) AS m FROM (
        SELECT p.q, alo, blo, max(least(k, ahi - i, bhi - j)) AS k FROM part p JOIN runs s ON s.q = p.q AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY p.q, alo, ahi, blo, bhi)
    GROUP BY q
), rated AS MATERIALIZED (SELECT a, b, 2.0::DOUBLE * coalesce(m, 0) / (length(a) + length(b)) AS ratio FROM q LEFT JOIN matched USING (q)),
ratio AS MATERIALIZED (
    SELECT x, y, u.ratio AS left_ratio, v.ratio AS right_ratio, w.ratio AS both_ratio FROM sides
    JOIN rated u ON u.a = s AND u.b = l JOIN rated v ON v.a = s AND v.b = r JOIN rated w ON w.a = l AND w.b = r
)"""


SIMILAR = f"""WITH RECURSIVE {TITLED_ROWS}, cores AS MATERIALIZED (SELECT block, core, min(seq) AS id FROM held GROUP BY block, core),
asked AS (SELECT p.id AS a, s.id AS b, p.core AS x, s.core AS y FROM cores p JOIN cores s ON p.block = s.block AND p.id < s.id),
{ratios('asked')}
SELECT a, b, left_ratio, right_ratio, both_ratio FROM asked JOIN ratio USING (x, y) WHERE greatest(left_ratio, right_ratio, both_ratio) >= 0.86"""


def merging(filled: tuple[str, ...] = ("salary",)) -> str:
    """CTEs ending in ``whole(r)``: the pass in order over ``held``, one step a row of every block, whose representatives are a list of
    structs: rep (the first row), best (the row that stands), and the fields that merging fills."""
    fill = lambda one, other: ", ".join(f"'{c}': CASE WHEN {one}.{c} <> '' THEN {one}.{c} ELSE {other}.{c} END" for c in filled)
    return f"""nodes AS MATERIALIZED (SELECT DISTINCT block, core, company FROM held),
asked AS MATERIALIZED (
    SELECT DISTINCT p.core AS x, s.core AS y FROM nodes p JOIN nodes s ON p.block = s.block
    UNION SELECT DISTINCT p.company, s.company FROM nodes p JOIN nodes s ON p.block = s.block WHERE p.company IS NOT NULL AND s.company IS NOT NULL
),
{ratios('asked')},
best AS MATERIALIZED (SELECT x, y, greatest(left_ratio, right_ratio, both_ratio) AS r FROM ratio),
likes AS MATERIALIZED (
    SELECT p.block, p.core, p.company, list(s.core || '|' || coalesce(s.company, '?')) AS others
    FROM nodes p JOIN nodes s ON p.block = s.block JOIN best t ON t.x = p.core AND t.y = s.core AND t.r >= 0.86
    LEFT JOIN best f ON f.x = p.company AND f.y = s.company
    WHERE p.company IS NULL OR s.company IS NULL OR f.r >= 0.84 GROUP BY ALL
), queued AS MATERIALIZED (
    SELECT h.block, row_number() OVER (PARTITION BY h.block ORDER BY seq) AS n, coalesce(others, []) AS others,
           {{'rep': seq, 'id': h.core || '|' || coalesce(h.company, '?'), 'rich': (CASE WHEN h.company IS NULL THEN 0 ELSE 1000000000 END) + size,
             'best': seq, {', '.join(f"'{c}': {c}" for c in filled)}}} AS me
    FROM held h LEFT JOIN likes l ON l.block = h.block AND l.core = h.core AND l.company IS NOT DISTINCT FROM h.company
), pass(block, n, reps) AS (
    SELECT block, n, [me] FROM queued WHERE n = 1
    UNION ALL
    SELECT block, n, CASE WHEN m IS NULL THEN list_append(reps, me) ELSE list_transform(reps, lambda r, k: CASE WHEN k <> m THEN r
        WHEN me.rich > r.rich THEN {{'rep': r.rep, 'id': me.id, 'rich': me.rich, 'best': me.best, {fill('me', 'r')}}}
        ELSE {{'rep': r.rep, 'id': r.id, 'rich': r.rich, 'best': r.best, {fill('r', 'me')}}} END) END
    FROM (
        SELECT p.block, p.n, p.me, s.reps, list_position(list_transform(s.reps, lambda r: list_contains(p.others, r.id)), true) AS m
        FROM pass s JOIN queued p ON p.block = s.block AND p.n = s.n + 1)
), whole AS (SELECT unnest(reps) AS r FROM pass QUALIFY n = max(n) OVER (PARTITION BY block))"""


def collapsed(rows: str) -> str:
    """The merged postings of ``held``, which the CTEs ``rows`` end in."""
    return f"""WITH RECURSIVE {rows}, {merging()}
SELECT r.rep AS seq, job_title, company_name, r.salary AS salary FROM whole JOIN held ON seq = r.best"""


_FILLED = ("salary", "required_skills")
#: The whole run: enriched, deduplicated both ways, scored anew and filtered.
FULL_RUN = f"""WITH RECURSIVE {o.ENRICHED}, {o.prepared('enriched')}, {o.GREEDY}, {held('unique_rows', _FILLED)}, {merging(_FILLED)},
merged AS (SELECT e.* REPLACE (r.rep AS seq, r.salary AS salary, r.required_skills AS required_skills) FROM whole JOIN enriched e ON e.seq = r.best)
{o.SCORED[len(o.ENRICHED):].replace('FROM enriched', 'FROM merged', 1)}
SELECT seq, relevance_score, priority_level, company_name FROM scored WHERE NOT {o.too_large('company_size')} AND {o.low_cost('salary', 'location', o.BLOB)} = ''"""
