"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from lexmill.llm.chat import CONTROLS, END, TEXT, TURN, ChatParams
from lexmill.llm.quality import CLASS_NAMES, COMMON_WORDS, PLAIN, QualityParams

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def op2() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s),
t AS (SELECT class_id, n, unnest(s) AS t FROM c WHERE doc_id = class_id AND n > 0),
l AS (SELECT a.class_id AS a, b.class_id AS b FROM t a JOIN t b ON a.t = b.t AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT DISTINCT a AS id, a AS low FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE coalesce(low, class_id) END AS component_id, CASE WHEN n = 0 THEN doc_id ELSE class_id END AS class_id FROM c LEFT JOIN m ON m.id = c.class_id"""


def op7(params: QualityParams = QualityParams()) -> str:
    marks = " ".join(f"WHEN lang = '{lang}' THEN [{_quoted(ws)}]" for lang, ws in sorted(COMMON_WORDS.items()))
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    forms = sorted({f for w in every for f in (w, w[:1].upper() + w[1:])})
    part = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (p + q)) ELSE 0 END"
    cell = f"({part.format(x='p')} + {part.format(x='q')}) / 2"
    jsd = cell.replace("p + q", "z[1] + z[2]").replace("p > 0", "z[1] > 0").replace("THEN p *", "THEN z[1] *").replace("2 * p", "2 * z[1]").replace("q > 0", "z[2] > 0").replace("THEN q *", "THEN z[2] *").replace("2 * q", "2 * z[2]")
    dist = lambda a, b: f"sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda z: {jsd})), 0))"
    others = [f"sum(chars[{i}])" for i in range(1, len(CLASS_NAMES) + 1)]
    own = " UNION ALL ".join(f"SELECT '{lang}' AS ref, [{_quoted(ws)}] AS ws" for lang, ws in sorted(COMMON_WORDS.items()))
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
e AS (SELECT doc_id, i, hash3 FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS hash3 FROM w WHERE len(w) >= 3)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash3) AS k FROM e) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM d) GROUP BY 1),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (SELECT w.doc_id, lang, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) AS len, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper_, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digit, length(regexp_replace(text, '{PLAIN}', '', 'g')) AS plain, strlen(text) - length(text) AS wide,
CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN ln USING (doc_id) LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < {params.least_words} OR 100 * n_repeat_words > {params.most_repeat_percent} * n_words AS base_failed, [CAST(len - word_chars AS DOUBLE), n_symbols, upper_, digit, plain - n_symbols - upper_ - digit, wide, word_chars - plain] AS chars, list_transform(list_filter(w, lambda x: x IN ({_quoted(forms)})), lambda x: lower(x)) AS common FROM b),
refs AS ({own}), h AS (SELECT f.*, ref, list_transform(ws, lambda c: CAST(len(list_filter(common, lambda x: x = c)) AS DOUBLE)) AS cw FROM f JOIN refs ON lang IS NULL OR lang = ref),
sums AS (SELECT ref, i, sum(cw[i]) AS c FROM (SELECT ref, cw, unnest(range(1, len(cw) + 1)) AS i FROM h WHERE lang = ref AND n_words >= {params.least_words}) GROUP BY 1, 2), tot AS (SELECT ref, sum(n_words)::DOUBLE AS n, [{", ".join(others)}] AS cs FROM h WHERE lang = ref AND n_words >= {params.least_words} GROUP BY 1),
q AS (SELECT tot.ref, list_transform(any_value(cs), lambda x: x / list_sum(any_value(cs))) AS qc, list(c / n ORDER BY i) AS qw FROM tot JOIN sums USING (ref) GROUP BY tot.ref),
p AS (SELECT doc_id, list_transform(chars, lambda x: x / greatest(len + wide, 1)) AS pc, qc, list_transform(cw, lambda x: x / greatest(n_words, 1)) AS pw, qw FROM h JOIN q USING (ref)),
j AS (SELECT doc_id, min({dist("pc", "qc")}) AS cj, min({dist("[list_sum(pw), 1 - list_sum(pw)]", "[list_sum(qw), 1 - list_sum(qw)]")}) AS sj, min({dist("list_append(pw, 1 - list_sum(pw))", "list_append(qw, 1 - list_sum(qw))")}) AS wj FROM p GROUP BY 1)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cj, 6) AS char_jsd, round(sj, 6) AS share_jsd, round(wj, 6) AS word_jsd, base_failed,
NOT base_failed AND NOT coalesce((n_words >= {params.min_words} AND (cj > {params.char_limit} OR sj > {params.share_limit})) OR (n_words >= {params.min_common_words} AND wj > {params.word_limit}), false) AS kept FROM f LEFT JOIN j ON j.doc_id = f.doc_id"""


def op10(params: ChatParams = ChatParams()) -> str:
    def escaped(x: str) -> str:
        out = rf"replace({x}, '\', '\\')"
        for c in CONTROLS:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    history = " ".join(f"UNION ALL SELECT h.conv_id, p.size FROM h JOIN p ON p.conv_id IS NOT DISTINCT FROM h.conv_id AND p.rn = h.first - {j} WHERE NOT p.lead_in AND h.total - (p.ends - p.step) <= p.room" for j in range(1, params.history + 1))
    return rf"""WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, length('{TURN}') + length({escaped("role")}) + length('{TEXT}') + length({escaped("text")}) + length('{END}') AS size, CAST(ceil(strlen(text) / {params.bytes_per_token}.0) AS BIGINT) + {params.turn_tokens} AS cost FROM r),
b AS (SELECT *, rn = 1 AND role = 'system' AS lead_in, CASE WHEN rn = 1 AND role = 'system' THEN 0 ELSE cost END AS step FROM a), s AS (SELECT conv_id, cost AS system_cost, size AS system_size FROM b WHERE lead_in),
p AS (SELECT b.*, system_size, greatest({params.budget} - coalesce(system_cost, 0), {params.budget // 2}) AS room, CAST(sum(step) OVER (PARTITION BY b.conv_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends FROM b LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id),
g AS (SELECT conv_id, 0 AS k, CAST(1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS base FROM p WHERE rn = 1
UNION ALL SELECT g.conv_id, g.k + 1, min(p.rn), min_by(p.ends - p.step, p.rn) FROM g JOIN p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.rn > g.first AND p.ends - p.step <> g.base AND p.ends - g.base > CASE WHEN g.k = 0 THEN p.room ELSE greatest(p.room - {params.reserve}, 1) END GROUP BY g.conv_id, g.k),
e AS (SELECT conv_id, k, first, coalesce(lead(first) OVER (PARTITION BY conv_id ORDER BY k) - 1, 1000000000000) AS last FROM g), h AS (SELECT e.conv_id, k, first, max(ends) AS total FROM e JOIN p ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.rn BETWEEN first AND last WHERE k > 0 GROUP BY ALL),
u AS (SELECT conv_id, size FROM p {history} UNION ALL SELECT h.conv_id, s.system_size FROM h JOIN s ON s.conv_id IS NOT DISTINCT FROM h.conv_id), z AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS formatted_chars FROM u GROUP BY 1),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn) AS said, coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '') AS lost FROM b GROUP BY 1)
SELECT t.conv_id, n_turns, sha256(said) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM t JOIN z ON z.conv_id IS NOT DISTINCT FROM t.conv_id"""
