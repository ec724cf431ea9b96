"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

from stallkeeper.llm import disclosure, line_dedup, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


LEVELS = 6  # of the driver's urls two at most have segments; SQL needs a fixed number


def op1(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    differs = lambda gg, nn: f"(l > 0 AND {nn} > l AND {gg} > 0 AND {gg} < {nn} AND abs(g / l - ({gg} - g) / ({nn} - l)) / sqrt(({gg} / {nn}) * (1 - {gg} / {nn}) * (1 / l + 1 / ({nn} - l))) >= {url_filter.Z})"
    steps = ""
    for k in range(1, LEVELS + 1):
        steps += f"""
        ch{k} AS MATERIALIZED (SELECT node, rest[1] AS seg, sum(pages) AS c, sum(good) AS g, sum(labelled) AS l FROM lev{k - 1} WHERE len(rest) > 0 GROUP BY ALL),
        ki{k} AS (SELECT ch.*, p.pages, CASE WHEN p.pages >= {url_filter.SUPPORT} AND c >= {url_filter.SUPPORT} AND NOT starts_with(seg, '*') AND {differs("gg", "nn")} THEN CASE WHEN g / l < (gg - g) / (nn - l) THEN '*-' ELSE '*+' END END AS side
            FROM ch{k} ch JOIN (SELECT node, sum(c) AS pages, sum(g) AS gg, sum(l) AS nn FROM ch{k} GROUP BY node) p USING (node)),
        bi{k} AS (SELECT node, side, floor(g * 100 / l) AS bin, count(*) AS m, sum(g) AS g, sum(l) AS l FROM ki{k} WHERE side IS NOT NULL GROUP BY ALL),
        br{k} AS (SELECT node, side, bin, m, coalesce({differs("gg", "nn")}, false)::INT AS breaks FROM (SELECT *, g + lag(g) OVER w AS gg, l + lag(l) OVER w AS nn FROM bi{k} WINDOW w AS (PARTITION BY node, side ORDER BY bin))),
        cl{k} AS (SELECT *, sum(m) OVER (PARTITION BY node, side, cluster) AS size FROM (SELECT *, sum(breaks) OVER (PARTITION BY node, side ORDER BY bin) + 1 AS cluster FROM br{k})),
        la{k} AS (SELECT ki.node, seg, CASE WHEN pages < {url_filter.SUPPORT} THEN '**' WHEN ki.side IS NULL THEN '*' WHEN size = 1 THEN seg ELSE ki.side || cluster::BIGINT END AS label
            FROM ki{k} ki LEFT JOIN cl{k} s ON s.node = ki.node AND s.side = ki.side AND s.bin = floor(ki.g * 100 / ki.l)),
        lev{k} AS MATERIALIZED (SELECT host, shape, v.node || coalesce('/' || label, '') AS node, CASE WHEN label = '**' THEN [] ELSE rest[2:] END AS rest, pages, good, labelled FROM lev{k - 1} v LEFT JOIN la{k} a ON a.node = v.node AND len(rest) > 0 AND a.seg = rest[1]),"""
    return rf"""
    WITH votes AS (
        SELECT p.page_id, sum((l.quality = 1 AND l.toxic = 0)::INT) AS good, count(*) AS labelled
        FROM pages p JOIN labels l ON l.doc_id = try_cast(regexp_extract(p.url, '/([0-9]+)[^/]*/?$', 1) AS BIGINT)
        WHERE (l.quality = 1 AND l.toxic = 0) IS NOT NULL GROUP BY 1),
    cut AS (
        SELECT *, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') AS shape FROM (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)),
    lev0 AS MATERIALIZED (
        SELECT host, shape, host AS node, list_filter(string_split(shape, '/'), lambda x: x <> '') AS rest, count(*) AS pages, sum(coalesce(v.good, 0)) AS good, sum(coalesce(v.labelled, 0)) AS labelled
        FROM cut LEFT JOIN votes v USING (page_id) GROUP BY host, shape),
    {steps}
    rate AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good) / sum(labelled) ELSE 1.0 END AS base FROM lev{LEVELS}),
    pure AS (SELECT node, CASE WHEN (sum(good) + {url_filter.PRIOR} * any_value(base)) / (sum(labelled) + {url_filter.PRIOR}) < {url_filter.PURITY} THEN 'block' ELSE 'allow' END AS learned FROM lev{LEVELS}, rate GROUP BY node),
    rules(h, p, v) AS (VALUES {values}),
    ruled AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS said FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT n.page_id, n.host, n.path, r.rule, coalesce(r.said, q.learned) AS verdict, t.node AS template FROM cut n JOIN lev{LEVELS} t USING (host, shape) JOIN pure q USING (node) LEFT JOIN ruled r USING (page_id)"""


OP2 = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    both_ways AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_ways JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, min(r.other) = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
    WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2),
    size AS (SELECT doc_id, len(w) AS len, avg(len(w)) OVER () AS mean, count(*) OVER () AS n FROM w),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    hit AS (
        SELECT q.doc_id AS query_id, t.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)))), 6) AS score
        FROM tf q JOIN tf t ON t.term = q.term JOIN df ON df.term = q.term JOIN size s ON s.doc_id = t.doc_id
        WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
    SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit) WHERE rank <= 10"""


def op4(probe: str) -> str:
    return rf"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}')),
    e AS (
        SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS n_text, length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) AS n_role,
            role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS starts FROM t)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(n_text + CASE WHEN starts THEN 24 + n_role ELSE 8 END)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""


def op7() -> str:
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0))
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def op8() -> str:
    lead, docs, constant, like = line_dedup.LEADING, line_dedup.MIN_DOCS, line_dedup.CONSTANT, line_dedup.SIMILAR
    mask = lambda x: f"regexp_replace({x}, '[0-9]+', '<*>', 'g')"
    return rf"""
    WITH raw AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(text, chr(10)))) AS raw FROM documents WHERE text IS NOT NULL),
    lines AS (
        SELECT doc_id, text, line_no, {mask("raw")} AS line, len(string_split(raw, ' ')) AS tokens,
            len(string_split(raw, ' ')) || ' ' || {mask(f"array_to_string(string_split(raw, ' ')[1:{lead}], ' ')")} AS leaf FROM raw WHERE raw <> ''),
    hot AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT text) >= {docs}),
    kinds AS (SELECT leaf, line, count(*) AS n, any_value(tokens) AS tokens FROM lines SEMI JOIN hot USING (leaf) GROUP BY leaf, line),
    mixed AS (SELECT leaf, sum(n) AS total FROM kinds GROUP BY leaf HAVING count(*) > 1),
    parsed AS (SELECT leaf, line, n, total, tokens - {lead} AS size, generate_subscripts(string_split(line, ' ')[{lead + 1}:], 1) AS pos, unnest(string_split(line, ' ')[{lead + 1}:]) AS token FROM kinds JOIN mixed USING (leaf) WHERE tokens > {lead}),
    shape AS (SELECT leaf, pos, arg_max(token, (n, token)) AS token, max(n) > any_value(total) * {constant} AS fixed FROM (SELECT leaf, pos, token, sum(n) AS n, any_value(total) AS total FROM parsed GROUP BY ALL) GROUP BY leaf, pos),
    follows AS (SELECT p.leaf, p.line FROM parsed p JOIN shape s USING (leaf, pos) GROUP BY p.leaf, p.line, p.size HAVING sum((fixed AND p.token = s.token)::INT) >= p.size * {like}),
    named AS (SELECT l.doc_id, l.text, l.line_no, CASE WHEN f.line IS NULL THEN l.leaf || ' = ' || l.line ELSE l.leaf || ' follows' END AS template FROM lines l SEMI JOIN hot h ON h.leaf = l.leaf LEFT JOIN follows f ON f.leaf = l.leaf AND f.line = l.line),
    recurring AS (SELECT template, min((doc_id, line_no)) AS first FROM named GROUP BY template HAVING count(DISTINCT text) >= {docs}),
    gone AS (SELECT n.doc_id, list(n.line_no) AS gone FROM named n JOIN recurring r USING (template) WHERE (n.doc_id, n.line_no) <> r.first GROUP BY n.doc_id),
    kept AS (SELECT doc_id, n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped, text, list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)) AS left_over FROM (SELECT *, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines FROM documents) LEFT JOIN gone USING (doc_id))
    SELECT doc_id, n_lines, n_dropped, CASE WHEN text IS NOT NULL THEN array_to_string(left_over, chr(10)) END AS text FROM kept"""


def passages() -> str:
    """A character for private use marks the cuts; the tables' texts don't have it."""
    words, docs, many, mark = line_dedup.PASSAGE, line_dedup.PASSAGE_DOCS, line_dedup.MIN_DOCS, line_dedup._CUT
    window = lambda order, frame: f"""SELECT doc_id, text, size, min(pos) OVER w AS pos, max(pos) OVER w AS upto_pos, sum(words) OVER w AS words, list(leaf) OVER w AS leaves
            FROM runs WINDOW w AS (PARTITION BY doc_id, run ORDER BY {order} RANGE BETWEEN {frame})"""  # noqa: E731
    return rf"""
    WITH cuts AS MATERIALIZED (SELECT doc_id, text, string_split(regexp_replace(text, '({line_dedup.ENDS})', '\1{mark}', 'g'), '{mark}') AS parts FROM documents WHERE text IS NOT NULL),
    everything AS MATERIALIZED (
        SELECT doc_id, text, size, pos, length(raw) - length(replace(raw, ' ', '')) + 1 AS words, regexp_replace(raw, '[0-9]+', '<*>', 'g') AS leaf
        FROM (SELECT doc_id, text, length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 AS size, generate_subscripts(parts, 1) - 1 AS pos, trim(replace(unnest(parts), chr(10), '')) AS raw FROM cuts) WHERE raw <> ''),
    anchors AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), 0) > {line_dedup.APART + 1} AS far FROM everything WHERE words >= {line_dedup.ANCHOR}
        AND leaf IN (SELECT leaf FROM everything WHERE words >= {line_dedup.ANCHOR} GROUP BY leaf HAVING count(DISTINCT text) > 1)),
    sharing AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, words, sum(far::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM anchors) GROUP BY doc_id, run HAVING sum(words) >= {line_dedup.ANCHORED}),
    clauses AS MATERIALIZED (SELECT * FROM everything SEMI JOIN sharing USING (doc_id)),
    met AS (SELECT leaf FROM clauses GROUP BY leaf HAVING count(DISTINCT text) >= {docs}),
    numbered AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM clauses SEMI JOIN met USING (leaf)),
    runs AS MATERIALIZED (SELECT *, upto - words AS before FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, run ORDER BY pos) AS upto, sum(words) OVER (PARTITION BY doc_id, run) AS whole FROM numbered) WHERE whole > {words}),
    units AS MATERIALIZED (SELECT DISTINCT doc_id, text, size, pos, upto_pos, leaves FROM ({window("before", f"CURRENT ROW AND {words} FOLLOWING")} UNION ALL {window("upto", f"{words} PRECEDING AND CURRENT ROW")}) WHERE words > {words}),
    repeated AS (SELECT leaves, count(DISTINCT text) AS n_docs, arg_min({{'doc_id': doc_id, 'text': text, 'upto_pos': upto_pos, 'size': size}}, (doc_id, pos, upto_pos)) AS f FROM units GROUP BY leaves HAVING count(DISTINCT text) >= {docs}),
    spans AS MATERIALIZED (SELECT u.doc_id, u.text, u.size, n_docs, f.text AS other, f.size AS other_size, unnest(range(u.pos, u.upto_pos + 1)) AS cell FROM units u JOIN repeated r USING (leaves) WHERE NOT (u.doc_id = f.doc_id AND u.pos <= f.upto_pos)),
    copies AS (SELECT text, other FROM (SELECT DISTINCT text, other, size, other_size, cell FROM spans WHERE n_docs < {many} AND text <> other) JOIN (SELECT DISTINCT text, pos AS cell, words FROM runs) USING (text, cell) GROUP BY text, other HAVING sum(words) * 2 >= max(greatest(size, other_size))),
    loses AS (SELECT doc_id, list_distinct(list(cell)) AS drops FROM spans WHERE n_docs >= {many} OR (text, other) NOT IN (SELECT (text, other) FROM copies) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN drops IS NULL THEN d.text ELSE array_to_string(list_transform(parts, lambda x, i: CASE WHEN NOT list_contains(drops, i - 1) THEN x WHEN ends_with(x, chr(10)) AND i > 1 AND NOT ends_with(parts[i - 1], chr(10)) THEN chr(10) ELSE '' END), '') END AS text
    FROM documents d LEFT JOIN cuts c ON c.doc_id = d.doc_id LEFT JOIN loses o ON o.doc_id = d.doc_id"""


OP10 = rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
    wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
    seen AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, item_id, i, n FROM seen JOIN wanted USING (n, x)),
    words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
    met AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN met USING (doc_id)"""


OP13 = rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    words AS MATERIALIZED (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
    kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
    found AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS MATERIALIZED (
        SELECT lang, source, coalesce((SELECT sum(c) FROM found f WHERE f.lang = g.lang AND f.source = g.source), 0)::HUGEINT AS n,
            (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v
        FROM (SELECT DISTINCT lang, source FROM docs) g),
    shares AS MATERIALIZED (
        SELECT lang, source, term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (n + v) AS p
        FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
    whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 1)::HUGEINT // ((SELECT sum(n) FROM groups g WHERE g.lang = s.lang)::HUGEINT + (SELECT count(*) FROM kept k WHERE k.lang = s.lang)::HUGEINT) AS q FROM shares s GROUP BY lang, term),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        GROUP BY a.lang, a.source, b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12() -> str:
    space, term, reach = r"\x20\x09-\x0D", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", disclosure.REACH
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    matches = " UNION ALL ".join(f"SELECT print, {k} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM texts" for k, p in enumerate(patterns))
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse({digits}), j, 1)::INT ELSE (substr(reverse({digits}), j, 1)::INT * 2) // 10 + (substr(reverse({digits}), j, 1)::INT * 2) % 10 END)) % 10 = 0"
    general = lambda t: f"CASE WHEN length({t}) > {disclosure.LEADING} THEN left({t}, {disclosure.LEADING}) || '*' END"
    names = ", ".join(f"'{k}'" for k in disclosure.KINDS)
    listed = lambda x: f"coalesce(string_agg([{names}][kind + 1] || ':' || start || ':' || past, ',' ORDER BY kind, start, past){x}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(disclosure.KINDS[: disclosure.GENERAL]))
    return rf"""
    WITH texts AS MATERIALIZED (SELECT DISTINCT md5(coalesce(text, '')) AS print, coalesce(text, '') AS text FROM documents),
    marks AS (SELECT print, kind, unnest(m) AS m, unnest(g[:len(m)]) AS g, unnest(g[2:]) AS h, unnest(range(len(m))) AS i FROM ({matches})),
    placed AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY print, kind ORDER BY i))::BIGINT AS past FROM marks),
    spans AS MATERIALIZED (
        SELECT print, kind, past - length(m) AS start, past, CASE kind WHEN 0 THEN {low.format("m")} WHEN 1 THEN m ELSE {digits} END AS entity,
            CASE WHEN length(g) <= {reach} THEN g ELSE regexp_replace(right(g, {reach}), '^[^{space}]+', '') END AS ahead,
            CASE WHEN length(h) <= {reach} THEN h ELSE regexp_replace(left(h, {reach}), '[^{space}]+\z', '') END AS behind
        FROM placed WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0
            WHEN 2 THEN length({digits}) BETWEEN 13 AND 19 AND {luhn} ELSE length({digits}) BETWEEN 9 AND 15 END),
    sides AS (SELECT row_number() OVER () AS side, print, kind, entity, place, regexp_extract_all(text, '[^{space}]*@[^{space}]*|{term}') AS t, string_split_regex(text, '[^{space}]*@[^{space}]*|{term}') AS g FROM (
        SELECT print, kind, entity, start - length(ahead) AS place, ahead AS text FROM spans UNION ALL SELECT print, kind, entity, past, behind FROM spans)),
    tokens AS (SELECT side, print, kind, entity, place, unnest(t) AS token, unnest(g[:len(t)]) AS g, unnest(range(len(t))) AS i FROM sides),
    near AS MATERIALIZED (
        SELECT print, kind, entity, {low.format("token")} AS term, past - length(token) AS start, past FROM (
            SELECT *, place + (sum(length(g) + length(token)) OVER (PARTITION BY side ORDER BY i))::BIGINT AS past FROM tokens) WHERE NOT contains(token, '@')),
    pairs AS MATERIALIZED (
        SELECT kind, entity, term, count(DISTINCT print) AS n_near FROM (
            SELECT print, kind, entity, term FROM near UNION ALL SELECT print, kind, entity, {general("term")} FROM near) WHERE term IS NOT NULL GROUP BY ALL HAVING n_near >= {disclosure.SUPPORT}),
    words AS (SELECT DISTINCT print, unnest(list_distinct(regexp_extract_all({low.format("text")}, '{term}'))) AS term FROM texts),
    known AS (SELECT term, count(DISTINCT print) AS n_term FROM (SELECT print, term FROM words UNION ALL SELECT print, {general("term")} FROM words) GROUP BY term),
    risky AS MATERIALIZED (
        SELECT kind, entity, term FROM (SELECT kind, entity, term, n_near / n_term AS told, n_entity FROM pairs JOIN known USING (term)
            JOIN (SELECT kind, entity, count(DISTINCT print) AS n_entity FROM spans GROUP BY ALL) USING (kind, entity)) WHERE told * told * told * told * (SELECT count(*) FROM texts) >= n_entity),
    actions AS (SELECT r.kind, r.entity, r.term, CASE WHEN g.term IS NOT NULL OR length(r.term) <= {disclosure.LEADING} THEN {disclosure.REMOVED} ELSE {disclosure.GENERAL} END AS act
        FROM risky r LEFT JOIN risky g ON g.kind = r.kind AND g.entity = r.entity AND g.term = {general("r.term")} WHERE r.term NOT LIKE '%*'),
    added AS (SELECT print, max(act) AS kind, start, past FROM near JOIN actions USING (kind, entity, term) GROUP BY print, start, past),
    listed AS (SELECT print, {counts}, sha256({listed(f" FILTER (kind < {disclosure.GENERAL})")}) AS base_sha256, {listed("")} AS spans
        FROM (SELECT print, kind, start, past FROM spans UNION ALL SELECT print, kind, start, past FROM added) GROUP BY print)
    SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in disclosure.KINDS[: disclosure.GENERAL])}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN listed ON print = md5(coalesce(text, ''))
    """
