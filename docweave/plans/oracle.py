"""SQL of the core queries, for DuckDB over the same tables; written apart from the column expressions."""

from __future__ import annotations

from ..functions import text as tx
from ..functions import web as wb

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), s AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM l)"
_BUL = tx.BULLETS
_PAGE = tx.PAGE_NUMBER.replace("'", "''")
_LINK = ", ".join(f"'{w}'" for w in tx.LINKING_WORDS)
_MATHW = ", ".join(f"'{w}'" for w in tx.MATH_WORDS)
_LAY = (
    "d AS (SELECT DISTINCT * FROM layout_in), ln AS (SELECT doc_id, page_num, block_no, line_no, coalesce(string_agg(coalesce(text, ''), '' ORDER BY span_no), '') AS text, "
    "coalesce(sum(size * length(coalesce(text, ''))) / nullif(sum(length(coalesce(text, ''))), 0), 11.0) AS size, bool_or(coalesce(bold, false)) AS bold, bool_or(coalesce(mono, false)) AS mono, "
    "min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(width) AS width, max(height) AS height, count(link) AS links FROM d GROUP BY 1, 2, 3, 4)"
)
_KEY = "CASE WHEN length(regexp_replace(lower({c}), '[^\\p{{L}}]+', '', 'g')) >= 15 THEN regexp_replace(lower({c}), '[^\\p{{L}}]+', '', 'g') ELSE regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END"
_MARGIN = "(NOT (y0 = 0 AND y1 = 0) AND (y1 < coalesce(nullif(height, 0), 842.0) * 0.12 OR y0 > coalesce(nullif(height, 0), 842.0) * 0.88))"
_REP = (
    f"k AS (SELECT *, {_KEY.format(c='text')} AS key, {_MARGIN} AS margin FROM ln), tot AS (SELECT doc_id, count(DISTINCT page_num) AS total FROM ln GROUP BY 1), "
    "rep AS (SELECT doc_id, key, count(DISTINCT page_num) AS pages FROM k WHERE margin AND length(key) >= 6 GROUP BY 1, 2), "
    "reps AS (SELECT rep.doc_id, rep.key, rep.pages FROM rep JOIN tot USING (doc_id) WHERE total >= 2 AND pages >= greatest(2, floor(0.3 * total)))"
)
_BODY = "b0 AS (SELECT doc_id, round(size, 1) AS size, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS n FROM d WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1, 2), body AS (SELECT doc_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS rn FROM b0) WHERE rn = 1)"
_LEVEL = (
    "CASE WHEN length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) < 2 THEN 0 WHEN {size} >= 1.15 * {body} AND length({t}) < 160 THEN CASE WHEN {size} >= 1.55 * {body} THEN 1 WHEN {size} >= 1.25 * {body} THEN 2 ELSE 3 END "
    "WHEN NOT regexp_matches({t}, '\\p{{Ll}}') AND regexp_matches({t}, '\\p{{Lu}}') AND length({t}) BETWEEN 4 AND 99 AND NOT regexp_matches(substring({t}, 1, 2), '[0-9]') THEN CASE WHEN {bold} THEN 2 ELSE 3 END ELSE 0 END"
)
_CUT = "(len(regexp_extract_all(lower({c}), '\\p{{L}}+')) = 0 OR list_last(regexp_extract_all(lower({c}), '\\p{{L}}+')) IN (" + _LINK + ") OR regexp_matches(regexp_replace({c}, '\\s+$', ''), '[,-]$'))"
_HEAD = (
    f"h0 AS (SELECT ln.*, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, body FROM ln JOIN body USING (doc_id)), h1 AS (SELECT *, {_LEVEL.format(t='t', size='size', body='body', bold='bold')} AS level, {_KEY.format(c='text')} AS key FROM h0), "
    f"h AS (SELECT * FROM h1 WHERE level > 0 AND NOT {_CUT.format(c='text')}), ht AS (SELECT doc_id, count(DISTINCT page_num) AS total FROM ln GROUP BY 1), "
    "often AS (SELECT h.doc_id, h.key FROM h JOIN ht USING (doc_id) WHERE length(key) >= 4 AND total >= 3 GROUP BY h.doc_id, h.key, total HAVING count(DISTINCT page_num) >= greatest(3, floor(0.3 * total))), "
    "heads AS (SELECT h.* FROM h ANTI JOIN often ON h.doc_id = often.doc_id AND h.key = often.key)"
)
_WEB = "w AS (SELECT * FROM (SELECT page_id, url, url_final, html, status, content_type, sha256, lote, row_number() OVER (PARTITION BY page_id ORDER BY arrived_at) AS rn FROM web_in) WHERE rn = 1)"
_STOP = {x: ", ".join(f"'{w}'" for w in ws) for x, ws in tx.STOP_WORDS.items()}
_DOMAIN = "regexp_replace(lower(regexp_extract({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


_FACTS = (
    "m AS (SELECT doc_id, min(title) AS title, min(author) AS author, min(page_count) AS page_count, min(filename) AS filename, min(url_origen) AS url_origen, min(fecha_archivo) AS fecha_archivo, min(sha256_pdf) AS sha, min(idioma) AS idioma, min(capa_texto) AS capa_texto, min(ocr_motor) AS ocr_motor, min(lineas_suprimidas) AS supp, max(coalesce(chars_extraidos, 0)) AS chars FROM pdf_meta GROUP BY 1), "
    "k AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT * FROM layout_in) WHERE link IS NOT NULL GROUP BY 1), facts AS (SELECT m.*, coalesce(k.n, 0) AS links, round_even(chars / greatest(coalesce(page_count, 1), 1), 0)::INT AS cpp FROM m LEFT JOIN k USING (doc_id))"
)
_BOXES = "r AS (SELECT DISTINCT doc_id, page_num, x0 - 2 AS a, y0 - 1 AS b, x1 + 2 AS c, y1 + 1 AS d, link AS target FROM s WHERE link IS NOT NULL)"
_SHARE = "CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN greatest(least(x1, c) - greatest(x0, a), 0) * greatest(least(y1, d) - greatest(y0, b), 0) / ((x1 - x0) * (y1 - y0)) ELSE 0 END"


def _has(c: str, signs: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{s}')" for s in signs) + ")"


def _slug(c: str) -> str:
    s = f"regexp_replace(strip_accents({c}), '[''‘’ʼ\"“”`]', '', 'g')"
    s = f"regexp_replace(lower(trim(regexp_replace({s}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ', '-', 'g')"
    s = f"regexp_replace(substring({s}, 1, 80), '-+$', '')"
    return f"CASE WHEN {c} IS NULL OR {s} = '' THEN 'document' ELSE {s} END"


def _yaml(c: str) -> str:
    return f"'\"' || replace(replace(regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\', '\\\\'), '\"', '\\\"') || '\"'"


def oracle_sql() -> dict[str, str]:
    votes = ", ".join(f"len(list_filter(ws, lambda x: x IN ({v}))) AS v_{x}" for x, v in _STOP.items())
    langs = list(_STOP)
    best = f"greatest({', '.join('v_' + x for x in langs)})"
    pick = " ".join(f"WHEN v_{x} = best THEN '{x}'" for x in langs)
    plain = "regexp_replace(text, '([\\p{L}\\p{N}_])­(\\s|$)', '\\1-\\2', 'g')"
    plain = f"translate({plain}, '{tx.WIDE_SPACES}‑​­', '{' ' * len(tx.WIDE_SPACES)}-')"
    for a, b in tx.LIGATURES.items():
        plain = f"replace({plain}, '{a}', '{b}')"
    return {
        "line_flags": f"WITH {_LINES} SELECT doc_id, sum((t <> '' AND length(t) <= 24 AND regexp_matches(t, '(?i){_PAGE}'))::INT)::BIGINT AS page_numbers, sum(regexp_matches(t, '^[{_BUL}\\-*]|^\\d+[.)]|^[a-zA-Z][.)]\\s+|^\\([a-zA-Z0-9]+\\)')::INT)::BIGINT AS list_items, sum(regexp_matches(t, '^[>»] ')::INT)::BIGINT AS quotes, sum((length(t) - length(replace(t, '|', '')) >= 2 OR len(regexp_extract_all(t, '\\S {{2,}}\\S')) >= 2)::INT)::BIGINT AS tabular FROM s GROUP BY doc_id",
        "caps_headings": f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, t AS heading, level, {_CUT.format(c='line')} AS cut FROM (SELECT *, {_LEVEL.format(t='t', size='11.0', body='11.0', bold='false')} AS level FROM s) WHERE level > 0",
        "doc_language": f"WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS al FROM documents), b AS (SELECT doc_id, len(al) AS n, al[1:4000] AS ws FROM a), c AS (SELECT doc_id, n, len(ws) AS m, {votes} FROM b), e AS (SELECT *, {best} AS best, list_sort([{', '.join('v_' + x for x in langs)}])[-2] AS second FROM c) SELECT doc_id, CASE WHEN n IS NULL OR n < 40 OR best < 0.02 * m OR (second > 0 AND best < 1.25 * second) THEN '' ELSE CASE {pick} END END AS lang_found FROM e",
        "content_summary": "SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words, len(regexp_extract_all(text, '(?m)^#{1,6} ')) AS headings, len(regexp_extract_all(text, '\\]\\(')) + len(regexp_extract_all(text, '\\[\\[')) AS links, ((length(lower(text)) - length(replace(lower(text), 'archivo', ''))) / 7)::INT AS hits FROM documents",
        "exact_copies": "WITH a AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL) SELECT doc_id, digest, first_id, copies FROM (SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS first_id, count(*) OVER (PARTITION BY digest) AS copies FROM a) WHERE copies > 1",
        "size_candidates": "SELECT doc_id, n_chars, same FROM (SELECT doc_id, n_chars, count(*) OVER (PARTITION BY n_chars) AS same FROM documents WHERE n_chars IS NOT NULL) WHERE same > 1",
        "formula_lines": f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, t AS formula FROM s WHERE t <> '' AND len(list_filter(regexp_extract_all(lower(t), '[a-záéíóúüñ]{{3,}}'), lambda x: x NOT IN ({_MATHW}))) = 0 AND (regexp_matches(t, '[{tx.MATH_SYMBOLS}]') OR contains(t, '='))",
        "pipe_tables": f"WITH {_LINES}, p AS (SELECT doc_id, len(string_split(regexp_replace(t, '^\\||\\|$', '', 'g'), '|')) AS n FROM s WHERE contains(line, '|') AND NOT regexp_matches(regexp_replace(t, '^\\||\\|$', '', 'g'), '^[\\s:|-]*$')) SELECT doc_id, count(*) AS table_rows, max(n) AS columns, sum(n)::BIGINT AS cells FROM p WHERE n >= 2 GROUP BY 1",
        "repetition_keys": f"WITH {_LINES} SELECT key, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {_KEY.format(c='line')} AS key FROM s) WHERE length(key) >= 6 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3",
        "normal_spans": f"SELECT DISTINCT doc_id, page_num, block_no, line_no, span_no, plain FROM (SELECT *, {plain} AS plain FROM layout_in) WHERE plain <> text",
        "body_sizes": f"WITH {_LAY}, {_BODY} SELECT doc_id, body FROM body",
        "line_styles": f"WITH {_LAY} SELECT doc_id, page_num, block_no, line_no, md5(text) AS text_md5, round(size, 3) AS size, bold, mono, links FROM ln",
        "running_lines": f"WITH {_LAY}, {_REP} SELECT doc_id, key, pages FROM reps",
        "body_lines": f"WITH {_LAY}, {_REP} SELECT k.doc_id, count(*) AS lines, sum(length(k.text))::BIGINT AS chars FROM k LEFT JOIN reps ON k.doc_id = reps.doc_id AND k.key = reps.key WHERE NOT (margin AND (reps.key IS NOT NULL OR (length(trim(k.text)) <= 24 AND regexp_matches(regexp_replace(k.text, '^\\s+|\\s+$', '', 'g'), '(?i){_PAGE}')))) GROUP BY 1",
        "layout_headings": f"WITH {_LAY}, {_BODY}, {_HEAD} SELECT doc_id, page_num, block_no, line_no, text, level FROM heads",
        "prominent_titles": f"WITH {_LAY}, {_BODY}, {_HEAD} SELECT doc_id, t AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level, size DESC, page_num, block_no, line_no) AS rn FROM heads WHERE page_num <= 3) WHERE rn = 1",
        "layer_histogram": "SELECT coalesce(capa_texto, 'unknown') AS layer, count(*) AS documents FROM (SELECT DISTINCT doc_id, capa_texto FROM pdf_meta) GROUP BY 1",
        "document_names": f"WITH m AS (SELECT doc_id, min(title) AS title, min(filename) AS filename FROM pdf_meta GROUP BY 1), b AS (SELECT *, {_slug('title')} AS base FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY doc_id) AS k FROM b) SELECT doc_id, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.md' AS name, coalesce(length(trim(title)) >= 4 AND NOT regexp_matches(lower(trim(title)), '^(microsoft word|untitled|document\\d+$|title$)|\\.(docx?|pdf)$') AND lower(trim(title)) <> lower(regexp_replace(coalesce(filename, ''), '\\.[A-Za-z0-9]+$', '')), false) AS useful FROM n",
        "page_records": f"WITH {_WEB}, a AS (SELECT *, coalesce(url_final, url) AS address, regexp_extract(lower(regexp_replace(coalesce(url_final, url), '[?#].*$', '')), '\\.([a-z0-9]+)$', 1) AS suffix, lower(coalesce(content_type, '')) AS kind FROM w) SELECT page_id, {_DOMAIN.format(c='address')} AS domain, sha256(html) AS digest, CASE WHEN suffix IN ({', '.join(repr(x) for x in wb.BINARY_SUFFIXES)}) THEN 'binary' WHEN suffix = 'pdf' OR contains(kind, 'pdf') OR starts_with(coalesce(html, ''), '%PDF') THEN 'pdf' WHEN kind = '' OR regexp_matches(kind, 'html|xml|plain') THEN 'page' ELSE 'other' END AS route, regexp_matches(lower(url), '^https?://') AS is_url FROM a",
        "thin_reasons": f"WITH {_WEB}, a AS (SELECT page_id, html, lower(substring(html, 1, 65536)) AS head, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS vis FROM w WHERE html IS NOT NULL), b AS (SELECT page_id, CASE WHEN {_has('head', wb.BOT_SIGNS)} THEN 'anti-bot' WHEN {_has('head', wb.COOKIE_SIGNS)} OR {_has('vis', wb.COOKIE_SIGNS)} THEN 'cookies' WHEN {_has('head', wb.LOGIN_SIGNS)} OR {_has('vis', wb.LOGIN_SIGNS)} THEN 'login' WHEN {_has('head', wb.SCRIPT_SIGNS)} OR (len(regexp_extract_all(html, '(?i)<script[ >]')) >= 5 AND regexp_matches(html, '(?i)<noscript[ >]')) THEN 'script' ELSE '' END AS reason FROM a) SELECT * FROM b WHERE reason <> ''",
        "new_captures": f"WITH {_WEB}, done AS (SELECT lower(sha256) AS k FROM w WHERE lote = 0 AND sha256 IS NOT NULL UNION SELECT url_final FROM w WHERE lote = 0 AND url_final IS NOT NULL) SELECT page_id, lote FROM w WHERE lote > 0 AND NOT EXISTS (SELECT 1 FROM done WHERE k = lower(sha256)) AND NOT EXISTS (SELECT 1 FROM done WHERE k = url_final)",
        "plan_collection": "WITH x AS (SELECT doc_id, min(url_origen) AS path, min(sitio) AS folder, min(filename) AS name, min(coalesce(chars_extraidos, 0)) AS length, min(lower(sha256_pdf)) AS digest, min(lote) AS lote FROM pdf_meta GROUP BY 1), e AS (SELECT concat_ws('__', folder, name) AS target, min(digest) AS there FROM x WHERE lote = 0 AND digest IS NOT NULL GROUP BY 1), v AS (SELECT *, coalesce(length > 0 AND regexp_matches(lower(name), '\\.pdf$') AND digest IS NOT NULL, false) AS valid FROM x), f AS (SELECT digest, min(path) AS first_path FROM v WHERE valid GROUP BY 1), s AS (SELECT path, first_path, CASE WHEN length = 0 THEN 'empty' WHEN NOT valid THEN 'not_pdf' WHEN path <> first_path THEN 'duplicate' WHEN there = v.digest THEN 'present' ELSE 'pending' END AS state FROM v LEFT JOIN f ON v.digest = f.digest LEFT JOIN e ON e.target = concat_ws('__', folder, name)) SELECT path, state, CASE WHEN state = 'duplicate' THEN 'same as ' || first_path ELSE '' END AS note FROM s",
        "file_dates": "SELECT doc_id, fecha_archivo, CASE WHEN fecha_archivo IS NULL THEN '' WHEN length(fecha_archivo) = 10 THEN fecha_archivo WHEN contains(fecha_archivo, '+') THEN regexp_replace(fecha_archivo, ' ', 'T') ELSE fecha_archivo END AS iso FROM (SELECT DISTINCT doc_id, fecha_archivo FROM pdf_meta)",
        "line_kinds": f"WITH {_LINES}, r AS (SELECT doc_id, line_no, line, trim(line, ' ') = '---' AS bar, starts_with(ltrim(line, ' '), '```') AS fence FROM l), c AS (SELECT *, sum(bar::INT) OVER w AS bars, sum(fence::INT) OVER w AS fences, first_value(bar) OVER w AS head, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS lv FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), k AS (SELECT doc_id, CASE WHEN head AND (bars < 2 OR (bar AND bars = 2)) THEN 'front' WHEN fence OR fences % 2 = 1 THEN 'code' WHEN lv > 0 THEN 'heading' || least(lv, 4) WHEN regexp_matches(line, '^\\s*(---+|\\*\\*\\*+|___+)\\s*$') THEN 'rule' WHEN regexp_matches(line, '^\\s*>\\s*\\[!\\w+\\]') THEN 'callout' WHEN regexp_matches(line, '^\\s*>') THEN 'quote' WHEN regexp_matches(line, '^\\s*\\|') THEN 'table' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s') THEN 'list' WHEN regexp_matches(line, '\\]\\(|\\[\\[|<https?://') THEN 'link' ELSE 'text' END AS kind FROM c) SELECT doc_id, kind, count(*) AS lines FROM k GROUP BY 1, 2",
        "forced_recognition": "WITH p AS (SELECT doc_id, page_num, max(coalesce(char_count, 0)) AS n FROM page_text GROUP BY 1, 2) SELECT doc_id, count_if(n >= 250) < 0.25 * count(*) AS forced FROM p GROUP BY 1",
        "code_documents": "WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS ls FROM documents), c AS (SELECT doc_id, len(ls) AS n, len(list_filter(ls, lambda x: regexp_matches(x, '[{};]\\s*$|^\\s*(def|class|import|function|var|let|const|elif|#include|#define)\\s+\\w|==|!=|=>|->|::|\\+=|\\$\\(|</?[a-z]+[ >]|\\w\\(.*\\)\\s*[:{;]?\\s*$'))) AS k FROM t) SELECT doc_id, true AS code FROM c WHERE k >= 2 AND k >= 0.3 * n",
        "cover_ends": f"WITH {_LAY}, {_BODY}, {_HEAD}, bl AS (SELECT doc_id, page_num, coalesce(block_no, 0) AS block_no, string_agg(text, chr(10) ORDER BY coalesce(line_no, 0)) AS t FROM ln GROUP BY 1, 2, 3), p AS (SELECT doc_id, page_num, regexp_replace(string_agg(t, ' ' ORDER BY block_no), '^\\s+|\\s+$', '', 'g') AS t FROM bl GROUP BY 1, 2), "
        "c AS (SELECT doc_id, page_num, length(t) AS chars, len(list_filter(['isbn', 'deposito legal', 'depósito legal', 'd.l.', '©', 'copyright', 'todos los derechos reservados', 'reservados todos los derechos', 'primera edicion', 'primera edición', 'edita:', 'editorial', 'impreso en', 'printed in', 'all rights reserved', 'maquetacion', 'maquetación'], lambda w: contains(lower(t), w))) > 0 AS credits, "
        "row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM p), a AS (SELECT doc_id, max(nth) AS last_one FROM c WHERE credits AND nth <= least(8, n - 1) GROUP BY 1), hp AS (SELECT DISTINCT doc_id, page_num FROM heads) "
        "SELECT c.doc_id, min(c.page_num) AS page_num FROM c JOIN a USING (doc_id) LEFT JOIN hp ON hp.doc_id = c.doc_id AND hp.page_num = c.page_num WHERE nth > last_one AND NOT credits AND (chars >= 400 OR (chars >= 200 AND hp.doc_id IS NOT NULL)) GROUP BY 1",
        "text_layers": "WITH p AS (SELECT doc_id, page_num, max(coalesce(char_count, 0)) AS n, bool_or(coalesce(has_images, false)) AS img, bool_or(coalesce(ocr_aplicado, false)) AS ocr FROM page_text GROUP BY 1, 2), d AS (SELECT doc_id, count(*) AS pages, sum(n)::BIGINT AS chars, coalesce(list_sort(list(n) FILTER (n >= 50)), []) AS ns, bool_or(ocr) AS ocr, count_if(img AND n < 160) AS stamped FROM p GROUP BY 1), "
        "e AS (SELECT *, round_even(chars / pages, 0)::INT AS chars_per_page, len(ns)::INT AS full_pages, coalesce(ns[(len(ns) // 2) + 1], 0) AS median_chars FROM d), f AS (SELECT *, full_pages >= 4 AND median_chars >= 200 AND chars >= 1500 AS solid, NOT ocr AND pages >= 5 AND median_chars < 160 AND stamped >= floor(pages * 0.75) AS stamp FROM e) "
        "SELECT doc_id, pages, chars, chars_per_page, median_chars, full_pages, CASE WHEN stamp OR (NOT solid AND (chars_per_page < 100 OR (pages - full_pages) * 2 > pages OR median_chars < 100)) THEN 'absent' WHEN ocr THEN 'ocr' WHEN chars_per_page < 800 OR median_chars < 800 THEN 'scarce' ELSE 'native' END AS layer FROM f",
        "reading_order": f"WITH {_LAY}, b AS (SELECT doc_id, page_num, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(width) AS width FROM ln GROUP BY 1, 2, 3), w AS (SELECT *, coalesce(nullif(width, 0), max(x1) OVER p, 600.0) AS w, count(*) OVER p AS n FROM b WINDOW p AS (PARTITION BY doc_id, page_num)), "
        "k AS (SELECT *, CASE WHEN x1 - x0 >= w * 0.60 THEN 'wide' WHEN x1 <= w * 0.5 + w * 0.05 THEN 'left' WHEN x0 >= w * 0.5 - w * 0.05 THEN 'right' END AS kind, (x1 - x0 >= w * 0.60 OR (x0 < w * 0.375 AND x1 > w * 0.625))::INT AS cut FROM w), "
        "two AS (SELECT DISTINCT l.doc_id, l.page_num FROM k l JOIN k r ON l.doc_id = r.doc_id AND l.page_num = r.page_num WHERE l.kind = 'left' AND r.kind = 'right' AND l.n >= 3 AND l.w > 0 AND greatest(l.y0, r.y0) < least(l.y1, r.y1) - 4), "
        "o AS (SELECT k.*, t.doc_id IS NOT NULL AS col FROM k LEFT JOIN two t ON t.doc_id = k.doc_id AND t.page_num = k.page_num), z AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, block_no) * 2 - cut AS band FROM o) "
        "SELECT doc_id, page_num, block_no, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY CASE WHEN col THEN band END NULLS FIRST, CASE WHEN col AND cut = 0 THEN (x0 >= w * 0.5)::INT ELSE 0 END, CASE WHEN col THEN y0 END NULLS FIRST, CASE WHEN col THEN x0 END NULLS FIRST, block_no)::INT AS turn FROM z",
        "ocr_decisions": "SELECT doc_id, page_num, max(coalesce(char_count, 0)) < 340 AND bool_or(coalesce(has_images, false)) AS needed FROM page_text GROUP BY 1, 2",
        "mostly_scanned": "WITH p AS (SELECT doc_id, page_num, max(coalesce(char_count, 0)) < 340 AND bool_or(coalesce(has_images, false)) AS needed FROM page_text GROUP BY 1, 2) SELECT doc_id, count(*) >= 3 AND count_if(needed) * 2 > count(*) AS whole FROM p GROUP BY 1",
        "output_guard": "WITH x AS (SELECT doc_id, min(filename) AS f, min(lote) AS lote, max(coalesce(chars_extraidos, 0)) AS n FROM pdf_meta GROUP BY 1), o AS (SELECT f, max(n) AS old FROM x WHERE lote = 0 GROUP BY 1) SELECT doc_id, coalesce(n < 500 AND old > n, false) AS keep_old FROM x LEFT JOIN o ON x.f = o.f WHERE lote > 0 AND x.f IS NOT NULL",
        "section_index": "SELECT coalesce(source, 'General') AS source, count(*) AS items, count_if(n_chars >= 500) AS complete, count_if(n_chars > 0 AND n_chars < 500) AS scarce, count_if(coalesce(n_chars, 0) = 0) AS absent, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
        "queue_states": "SELECT coalesce(source, 'waiting') AS state, count(*) AS items, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY 1",
        "linked_spans": f"WITH s AS (SELECT DISTINCT * FROM layout_in), {_BOXES}, m AS (SELECT s.doc_id, s.page_num, block_no, line_no, span_no, target, {_SHARE} AS share FROM s JOIN r USING (doc_id, page_num) WHERE NOT regexp_matches(target, '^(#|file:)') AND target <> '') "
        "SELECT DISTINCT doc_id, page_num, block_no, line_no, span_no, target FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, block_no, line_no, span_no ORDER BY share DESC, target DESC) AS rn FROM m WHERE share > 0.05) WHERE rn = 1",
        "loose_links": f"WITH s AS (SELECT DISTINCT * FROM layout_in), {_BOXES}, m AS (SELECT s.doc_id, s.page_num, block_no, line_no, span_no, target, {_SHARE} AS share FROM s JOIN r USING (doc_id, page_num) WHERE length(s.text) <= 12 AND NOT regexp_matches(target, '^(#|file:)') AND target <> ''), "
        "u AS (SELECT DISTINCT doc_id, page_num, target FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, block_no, line_no, span_no ORDER BY share DESC, target DESC) AS rn FROM m WHERE share > 0.05) WHERE rn = 1) SELECT DISTINCT doc_id, page_num, target FROM r EXCEPT SELECT doc_id, page_num, target FROM u",
        "link_counts": f"WITH {_LAY} SELECT doc_id, sum(links)::BIGINT AS links, count_if(links > 0) AS linked_lines FROM ln GROUP BY 1",
        "note_body_sizes": "WITH d AS (SELECT DISTINCT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM layout_in), v AS (SELECT * FROM d WHERE t <> ''), a AS (SELECT doc_id, round(size, 1) AS size, sum(length(t)) AS n FROM v WHERE y0 < 0.82 * CASE WHEN coalesce(height, 0) > 0 THEN height ELSE 842.0 END GROUP BY 1, 2), b AS (SELECT doc_id, round(size, 1) AS size, sum(length(t)) AS n FROM v GROUP BY 1, 2), "
        "x AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS rn FROM a), y AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS rn FROM b) SELECT y.doc_id, coalesce(x.size, y.size) AS body FROM y LEFT JOIN x ON x.doc_id = y.doc_id AND x.rn = 1 WHERE y.rn = 1",
        "outline_lines": f"WITH {_LAY}, {_BODY}, {_HEAD}, o AS (SELECT doc_id, page_num, regexp_replace(lower(upper(text)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k, min(least(greatest(level + floor(page_num / 3), 1), 4)) AS lv FROM heads GROUP BY 1, 2, 3), x AS (SELECT doc_id, page_num, block_no, line_no, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM ln), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, k ORDER BY block_no, line_no) AS rn FROM x) SELECT y.doc_id, y.page_num, block_no, line_no, lv::INT AS outline_level FROM y JOIN o ON o.doc_id = y.doc_id AND o.page_num = y.page_num AND o.k = y.k WHERE rn = 1 AND y.k <> ''",
        "lines_outside_tables": f"WITH {_LAY}, s AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM ln), bx AS (SELECT doc_id, page_num, block_no, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM s WHERE length(t) - length(replace(t, '|', '')) >= 2 OR len(regexp_extract_all(t, '\\S {{2,}}\\S')) >= 2 GROUP BY 1, 2, 3) "
        "SELECT doc_id, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM ln WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = ln.doc_id AND bx.page_num = ln.page_num AND ln.x0 >= a - 5 AND ln.y0 >= b - 5 AND ln.x1 <= c + 5 AND ln.y1 <= d + 5) GROUP BY 1",
        "spaced_rows": f"WITH {_LINES}, c AS (SELECT doc_id, len(string_split_regex(t, '\\t+| {{2,}}')) AS k FROM s) SELECT doc_id, count(*) AS rows, max(k)::INT AS columns, sum(k)::BIGINT AS cells FROM c WHERE k > 1 GROUP BY 1",
        "plain_bullets": f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, p AS plain FROM (SELECT *, regexp_replace(line, '^(\\s*)[•▪▫◦‣·∙●○–—\\-*]\\s*', '\\1- ') AS p FROM l) WHERE p <> line",
        "escaped_headings": f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, p AS escaped FROM (SELECT *, regexp_replace(line, '^(#{{1,6}})(\\s)', '\\\\\\1\\2') AS p FROM l) WHERE p <> line",
        "quoted_titles": f"WITH x AS (SELECT DISTINCT doc_id, title || ' \"a\\b\" ' || coalesce(author, '') AS t FROM pdf_meta WHERE title IS NOT NULL) SELECT doc_id, {_yaml('t')} AS quoted, regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS plain, '[' || {_yaml('t')} || ', \"b\"]' AS listed FROM x",
        "markdown_addresses": f"WITH {_WEB} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<' || concat_ws(' ', url, '(a%3Eb)') || '>' WHEN regexp_matches(url, '[() <>]') THEN '<' || replace(url, '>', '%3E') || '>' ELSE url END AS target FROM w",
        "cited_addresses": f"WITH {_LINES}, a AS (SELECT DISTINCT doc_id, line_no::INT AS line_no, regexp_replace(unnest(regexp_extract_all(line, 'https?://[^\\s><\"'';|]+')), '[.,;:]+$', '') AS u FROM l), b AS (SELECT *, length(regexp_extract(u, '([).,;:]*)$', 1)) AS tail, length(u) - length(replace(u, ')', '')) - length(u) + length(replace(u, '(', '')) AS spare FROM a) "
        "SELECT DISTINCT doc_id, line_no, CASE WHEN spare <= 0 OR tail = 0 THEN u ELSE regexp_replace(u, '([.,;:]*\\)){1,' || spare || '}$', '') END AS address FROM b",
        "collection_summary": "WITH x AS (SELECT doc_id, min(url_origen) AS path, min(sitio) AS folder, min(filename) AS name, min(coalesce(chars_extraidos, 0)) AS length, min(lower(sha256_pdf)) AS digest, min(lote) AS lote FROM pdf_meta GROUP BY 1), e AS (SELECT concat_ws('__', folder, name) AS target, min(digest) AS there FROM x WHERE lote = 0 AND digest IS NOT NULL GROUP BY 1), v AS (SELECT *, coalesce(length > 0 AND regexp_matches(lower(name), '\\.pdf$') AND digest IS NOT NULL, false) AS valid FROM x), f AS (SELECT digest, min(path) AS first_path FROM v WHERE valid GROUP BY 1), s AS (SELECT CASE WHEN length = 0 THEN 'empty' WHEN NOT valid THEN 'not_pdf' WHEN path <> first_path THEN 'duplicate' WHEN there = v.digest THEN 'present' ELSE 'pending' END AS state FROM v LEFT JOIN f ON v.digest = f.digest LEFT JOIN e ON e.target = concat_ws('__', folder, name)) SELECT count_if(state IN ('pending', 'present', 'duplicate')) AS found, count_if(state = 'duplicate') AS duplicates, count_if(state = 'present') AS present, count_if(state = 'pending') AS pending, count_if(state IN ('empty', 'not_pdf')) AS incidents FROM s",
        # the lines are made in known forms, so the items are written out form by form
        "work_items": "WITH m AS (SELECT page_id AS p, min(seccion) AS s, min(url_solicitada) AS u, min(lote) AS list_id FROM web_meta GROUP BY 1 HAVING min(url_solicitada) IS NOT NULL), "
        "i AS (SELECT list_id, p * 2 + 1 AS line_no, 'url' AS kind, u AS origin, '' AS declared_url, '' AS out_name FROM m WHERE p % 9 = 0 UNION ALL SELECT list_id, p * 2 + 1, 'local', '/listas/p' || p || '.html', u, '' FROM m WHERE p % 9 = 1 UNION ALL SELECT list_id, p * 2 + 1, 'url', u, '', 'id_' || p FROM m WHERE p % 9 = 2 "
        "UNION ALL SELECT list_id, p * 2 + 1, 'url', unnest([u, 'https://otra.test/' || p]), '', '' FROM m WHERE p % 9 = 3 UNION ALL SELECT list_id, p * 2 + 1, 'local', '/listas/c/' || p || '.htm', '`c/' || p || '.htm`', '' FROM m WHERE p % 9 = 4 UNION ALL SELECT list_id, p * 2 + 1, 'url', u, '', 'id-' || p FROM m WHERE p % 9 = 5 "
        "UNION ALL SELECT list_id, p * 2 + 1, 'local', '/listas/x/' || p || '.HTML', '', '' FROM m WHERE p % 9 = 6 UNION ALL SELECT list_id, p * 2 + 1, 'local', '/listas/p.htm', u, p::VARCHAR FROM m WHERE p % 9 = 7), f AS (SELECT list_id, min(line_no) AS first_item FROM i GROUP BY 1), "
        "h AS (SELECT list_id, p * 2 AS line_no, CASE WHEN p % 7 = 0 THEN nullif(trim(coalesce(s, 'Varios')), '') WHEN p % 11 = 0 THEN NULL WHEN p * 2 > first_item THEN 'Portada' END AS section FROM m LEFT JOIN f USING (list_id)), "
        "x AS (SELECT i.*, (SELECT arg_max(section, h.line_no) FROM h WHERE h.list_id = i.list_id AND h.line_no < i.line_no AND section IS NOT NULL) AS section FROM i) SELECT list_id, line_no, coalesce(section, '') AS section, kind, origin, declared_url, out_name FROM x",
        "front_matter": f"WITH {_FACTS} SELECT doc_id, array_to_string(list_filter(['---', 'title: ' || {_yaml("CASE WHEN coalesce(title, '') = '' THEN regexp_replace(coalesce(filename, ''), '\\.[^.]*$', '') ELSE title END")}, CASE WHEN author <> '' THEN 'author: ' || {_yaml('author')} END, CASE WHEN page_count > 0 THEN 'pages: ' || page_count END, 'source_file: ' || {_yaml("coalesce(filename, '')")}, CASE WHEN url_origen <> '' THEN 'url_origen: ' || {_yaml('url_origen')} END, "
        f"CASE WHEN fecha_archivo <> '' THEN 'fecha_archivo: ' || {_yaml('fecha_archivo')} END, CASE WHEN sha <> '' THEN 'sha256_pdf: ' || {_yaml('sha')} END, CASE WHEN coalesce(url_origen, '') = '' THEN 'url_origen: null' END, CASE WHEN idioma <> '' THEN 'idioma: ' || {_yaml('idioma')} END, 'chars_extraidos: ' || chars, 'chars_por_pagina: ' || cpp, 'capa_texto: ' || {_yaml("coalesce(nullif(capa_texto, ''), 'nativa')")}, "
        f"CASE WHEN ocr_motor <> '' THEN 'ocr_motor: ' || {_yaml('ocr_motor')} ELSE 'ocr_motor: null' END, 'enlaces: ' || links, CASE WHEN len(supp) > 0 THEN 'lineas_suprimidas: [' || array_to_string(list_transform(supp, lambda x: {_yaml('x')}), ', ') || ']' END, '---'], lambda x: x IS NOT NULL), chr(10)) AS front_matter FROM facts",
        "document_manifest": f"WITH {_FACTS} SELECT filename AS archivo, url_origen AS entrada, coalesce(page_count, 0) AS paginas, chars, cpp AS chars_pag, coalesce(capa_texto, '') AS capa_texto, links AS enlaces, '' AS avisos, CASE WHEN capa_texto = 'escasa' THEN 'escaso' WHEN capa_texto IN ('ausente', 'error', 'fallo') THEN 'fallo' ELSE 'ok' END AS estado, doc_id FROM facts",
        "capture_stamps": "SELECT DISTINCT page_id, strftime(arrived_at, '%Y-%m-%d %H:%M:%S') AS stamp FROM web_in",
    }
