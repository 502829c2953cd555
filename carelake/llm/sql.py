"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from carelake.llm import warc

SUBSTRINGS = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM documents
), win AS (
    SELECT doc_id, t.i AS pos, array_to_string(list_slice(words, t.i, t.i + 19), ' ') AS g
    FROM w, unnest(generate_series(1, len(words) - 19)) t(i)
), later AS (
    SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS nth FROM win) WHERE nth > 1
), gone AS (
    SELECT DISTINCT doc_id, pos + r.k AS i FROM later, range(20) r(k)
), tok AS (
    SELECT doc_id, t.i, words[t.i] AS word FROM w, unnest(generate_series(1, len(words))) t(i)
), kept AS (
    SELECT tok.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY tok.i) FILTER (gone.i IS NULL) AS text
    FROM tok LEFT JOIN gone ON tok.doc_id = gone.doc_id AND tok.i = gone.i GROUP BY tok.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

TOP_K = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), pairs AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lines(value: str) -> str:
    """A literal with its line ends and control characters spelt out."""
    names = {"\r": 13, "\n": 10, "\x00": 0, "\x1f": 31}
    parts, held = [], ""
    for c in value:
        if c in names:
            parts += [_text(held)] * bool(held) + [f"chr({names[c]})"]
            held = ""
        else:
            held += c
    return "(" + " || ".join(parts + [_text(held)] * (bool(held) or not parts)) + ")"


def _identifier(*parts: str) -> str:
    joined = f" || {_lines(chr(31))} || ".join(f"coalesce(CAST({p} AS VARCHAR), {_lines(chr(0))})" for p in parts)
    return f"'<urn:uuid:' || regexp_replace(md5({joined}), '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}})$', '\\1-\\2-5\\3-a\\4-\\5') || '>'"


def _unescaped(text: str) -> str:
    names = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in warc.NAMES.items()) + "}"
    ref = f"regexp_extract(x, {_text(warc.REFERENCE)}, 1)"
    number = f"CASE WHEN r[2] IN ('x', 'X') THEN TRY_CAST('0x' || r[3:] AS INTEGER) ELSE TRY_CAST(r[2:] AS INTEGER) END"
    char = f"(SELECT CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n = 160 THEN ' ' ELSE chr(n) END FROM (SELECT {number} AS n))"
    value = f"CASE WHEN r[1] = '#' THEN {char} WHEN r <> '' THEN {names}[r] END"
    piece = f"(SELECT coalesce({value} || x[len(r) + 2:], '&' || x) FROM (SELECT {ref} AS r))"
    return f"(string_split({text}, '&')[1] || coalesce((SELECT string_agg({piece}, '' ORDER BY i) FROM (SELECT unnest(string_split({text}, '&')[2:]) AS x, generate_subscripts(string_split({text}, '&')[2:], 1) AS i)), ''))"


def _plain(html: str) -> str:
    swap = lambda text, pattern, new: f"regexp_replace({text}, {_text(pattern)}, {new}, 'g')"
    shown = swap(swap(swap(html, warc.HIDDEN, "' '"), warc.BREAKS, "chr(10)"), warc.TAGS, "''")
    tidy = swap(swap(_unescaped(shown), r"[ \t\r\f]+", "' '"), r" ?\n[ \n]*", "chr(10)")
    return swap(tidy, r"^[ \n]+|[ \n]+$", "''")


def derivatives(date: str) -> str:
    end = _lines("\r\n")
    raw_title = _unescaped(f"regexp_extract(html, {_text(warc.TITLE)}, 1)")
    title = f"trim(regexp_replace({raw_title}, {_text(r'[ \t\r\n\f]+')}, ' ', 'g'), ' ')"
    link = rf"'outlink: ' || regexp_replace(x, '[\r\n]+', ' ', 'g') || {end}"
    links = f"array_to_string(list_transform(regexp_extract_all(html, {_text(warc.LINK)}, 1), lambda x: {link}), '')"
    return f"""
WITH page AS (
    SELECT page_id, url, coalesce(html, '') AS html, {_identifier("'response'", "page_id", "url")} AS refers_to FROM pages
), source AS (
    SELECT *, 'sha256:' || sha256(html) AS source_digest FROM page
), record AS (
    SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
           'source-content-type: text/html; charset=utf-8' || {end} || 'title: ' || {title} || {end} || coalesce({links}, '') AS block FROM source
    UNION ALL
    SELECT *, 'conversion', 'text/plain; charset=utf-8', {_plain('html')} FROM source
)
SELECT page_id, record_type, {_identifier("record_type", "refers_to")} AS record_id, refers_to, url AS target_uri, {_text(date)} AS date,
       content_type, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest,
       'Content-Type: application/http; msgtype=response' || chr(10) || 'WARC-Date: ' || {_text(date)} || chr(10)
       || 'WARC-Payload-Digest: ' || source_digest || chr(10) || 'WARC-Record-ID: ' || refers_to || chr(10)
       || coalesce('WARC-Target-URI: ' || url || chr(10), '') || 'WARC-Type: response' AS source_headers, block
FROM record
"""


def url_filter(rules, tree) -> str:
    """The template tree, a recursion step per level."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    name = verdict = "NULL"
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = f"(host = {_text(r.host)} OR ends_with(host, {_text('.' + r.host)})) AND starts_with(path, {_text(r.path)})"
        name = f"CASE WHEN {fits} THEN {_text(r.name)} ELSE {name} END"
        verdict = f"CASE WHEN {fits} THEN {_text(r.verdict)} ELSE {verdict} END"
    sums = "CAST(sum(labelled) AS BIGINT) AS l, CAST(sum(blocked) AS BIGINT) AS b"
    smooth = lambda parent: f"(b + CAST({tree.smoothing} AS DOUBLE) * {parent}) / (l + CAST({tree.smoothing} AS DOUBLE))"
    over = lambda what, group: f"CAST(sum({what}) OVER (PARTITION BY {group}) AS BIGINT)"
    return f"""WITH RECURSIVE read AS (
    SELECT page_id, translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
), marked AS (
    SELECT *, {name} AS rule, {verdict} AS ruled,
           list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS parts FROM read
), shapes AS (
    SELECT host, parts, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked
    FROM (SELECT DISTINCT host, path, ruled, parts FROM marked) GROUP BY host, parts
), total AS (
    SELECT {smooth(f"CAST({tree.prior} AS DOUBLE)")} AS p FROM (SELECT {sums} FROM shapes)
), hosts AS (
    SELECT host, {smooth("(SELECT p FROM total)")} AS p, l > 0 AND shapes > 1 AS open FROM (SELECT host, {sums}, count(*) AS shapes FROM shapes GROUP BY host)
), tree AS (
    SELECT shapes.*, p, open, '' AS template, 0 AS level FROM shapes JOIN hosts USING (host)
    UNION ALL
    SELECT host, parts, n, labelled, blocked, {smooth("q")}, l > 0 AND shapes > 1 AND name <> '',
           CASE WHEN name = '' THEN template ELSE template || '/' || name END, level + 1
    FROM (
        SELECT *, {over("labelled", "host, template, name")} AS l, {over("blocked", "host, template, name")} AS b,
               count(*) OVER (PARTITION BY host, template, name) AS shapes
        FROM (
            SELECT host, parts, n, labelled, blocked, q, template, level,
                   CASE WHEN segment = '' OR (l >= {tree.least_labels} AND abs(b - l * q) > CAST({tree.z} AS DOUBLE) * sqrt(l * q * (1 - q))) THEN segment
                        WHEN varies THEN '*' ELSE '~' END AS name
            FROM (
                SELECT *, {over("n", "host, template")} * {over("n", "host, template")} >= {tree.most_children} * {over("n * alike", "host, template")} AS varies
                FROM (
                    SELECT *, {over("n", "host, template, segment")} AS alike, {over("labelled", "host, template, segment")} AS l,
                           {over("blocked", "host, template, segment")} AS b
                    FROM (SELECT host, parts, n, labelled, blocked, p AS q, template, level, coalesce(parts[level + 1], '') AS segment FROM tree WHERE open)))))
)
SELECT page_id, m.host, path, rule, coalesce(ruled, CASE WHEN p >= {tree.threshold} THEN 'block' ELSE 'allow' END) AS verdict,
       template || CASE WHEN len(t.parts) > level THEN '/**' ELSE '' END AS template, p AS purity
FROM marked m LEFT JOIN tree t ON NOT t.open AND t.host = m.host AND t.parts = m.parts"""


DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), totals AS (
    SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang
), grp AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), sized AS (
    SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM grp LEFT JOIN c USING (lang, source) GROUP BY lang, source
), dense AS (
    SELECT lang, source, term, coalesce(c.n, 0) AS n,
           1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (s.n + 2 * totals.v) AS p,
           1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 2)) // (totals.n + 2 * totals.v) AS q
    FROM sized s JOIN totals USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT g.lang, g.source, o.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM grp g JOIN grp o ON g.lang = o.lang AND g.source <> o.source
    LEFT JOIN pair p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
), parts AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM dense WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: crc32 of UTF-8 text, byte by byte over the table of the reversed polynomial.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])))"""

RESAMPLING = r"""
WITH RECURSIVE bits AS (
    SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS MATERIALIZED (
    SELECT list(v ORDER BY i) AS steps FROM bits WHERE k = 8
), d AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
    SELECT row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM (SELECT row, text FROM d UNION ALL SELECT -1, coalesce(text, '') FROM benchmark)
), hashed AS MATERIALIZED (
    SELECT word, """ + _CRC + r""" % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc
), f AS MATERIALIZED (
    SELECT row, bucket FROM w JOIN hashed USING (word)
), counts AS (
    SELECT bucket, count(*) FILTER (row >= 0) AS s, count(*) FILTER (row < 0) AS t FROM f GROUP BY bucket
), totals AS (
    SELECT sum(s) AS s, sum(t) AS t FROM counts
), gain AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * CAST(totals.s + 10000 AS DOUBLE)
           / (CAST(c.s + 1 AS DOUBLE) * CAST(totals.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts c, totals
), weighed AS (
    SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN gain USING (bucket) WHERE row >= 0 GROUP BY row
), scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM d LEFT JOIN weighed USING (row)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS nth, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= 10 * n // 100 THEN nth END AS rank FROM ranked
"""
