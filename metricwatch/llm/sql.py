"""DuckDB twins of the operators that SQL can express, written from their contracts."""

# Words and lines of a text, as lists.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_MIX = """
WITH sized AS (
    SELECT coalesce(source, '') AS src, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY 1
), share AS (
    SELECT src, CASE WHEN chars > 0 THEN sqrt(chars) / sum(sqrt(chars)) FILTER (chars > 0) OVER () * sum(chars) OVER () / chars ELSE 1 END AS rate
    FROM sized
), drawn AS (
    SELECT src, greatest(ceil(rate / 16.0), 1)::INT AS draws, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM share
), levels AS (
    SELECT src, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS level
    FROM drawn, range(0, 90) t(k) WHERE mean > 0
), numbers AS (
    SELECT d.doc_id, coalesce(d.source, '') AS src,
        ('0x' || md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || j || ':17')[1:13])::BIGINT / 4503599627370496.0 AS u
    FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN drawn ON drawn.src = coalesce(d.source, ''), range(0, draws) t(j)
), counts AS (
    SELECT doc_id, n.src, count(*) AS copies FROM numbers n JOIN levels l ON l.src = n.src AND l.level <= n.u GROUP BY ALL
)
SELECT d.*, c.copy::INT AS copy,
    ('0x' || md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.copy || ':order-17')[1:15])::BIGINT AS shuffle_key
FROM documents d JOIN (SELECT doc_id, src, unnest(range(1, copies + 1)) AS copy FROM counts) c
    ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND coalesce(d.source, '') = c.src
"""

_CHAT = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        count(*) OVER (PARTITION BY conv_id) AS n,
        '<|im_start|>' || replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') || chr(10)
        || regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_start\||\|im_end\||/?s>|/?INST\]|/?<?/?SYS>|\|endoftext\||\|startoftext\|)', '\1\\\2', 'g')
        || '<|im_end|>' || chr(10) AS piece
    FROM given
), counted AS (
    SELECT *, len(regexp_extract_all(piece, '\p{L}+|\p{N}|[^\x00-\x20\p{L}\p{N}]')) AS tokens, length(piece) AS chars FROM placed
), summed AS (
    SELECT *, sum(tokens) OVER w AS upto, sum(chars) OVER w AS chars_upto FROM counted WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), heads AS (
    SELECT conv_id, n, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS led,
        CASE WHEN role = 'system' THEN tokens ELSE 0 END AS sys_tokens, CASE WHEN role = 'system' THEN chars ELSE 0 END AS sys_chars
    FROM summed WHERE i = 1
), walk AS (
    -- One row per turn: the first turn (s) of the window that it is new in, and of that window's history (h).
    SELECT conv_id, 1::BIGINT AS i, 1::BIGINT AS s, 1::BIGINT AS h FROM heads
    UNION ALL
    SELECT w.conv_id, t.i, CASE WHEN fits THEN w.s ELSE t.i END, CASE WHEN fits THEN w.h ELSE coalesce((
        SELECT min(b.i) FROM summed b
        WHERE b.conv_id = t.conv_id AND b.i > d.led AND b.i <= t.i AND t.upto - t.tokens - b.upto + b.tokens <= 256
            AND d.sys_tokens + t.upto - b.upto + b.tokens <= 1024), t.i) END
    FROM walk w JOIN heads d USING (conv_id) JOIN summed t ON t.conv_id = w.conv_id AND t.i = w.i + 1
    JOIN summed a ON a.conv_id = w.conv_id AND a.i = w.h,
    LATERAL (SELECT t.upto - a.upto + a.tokens + CASE WHEN d.led = 1 AND w.s = 1 THEN 0 ELSE d.sys_tokens END <= 1024 AS fits)
), sized AS (
    SELECT w.conv_id, w.s, sum(t.chars) + any_value(p.repeated) + CASE WHEN w.s > 1 THEN any_value(d.sys_chars) ELSE 0 END AS chars
    FROM walk w JOIN summed t USING (conv_id, i) JOIN heads d USING (conv_id),
    LATERAL (SELECT coalesce(sum(b.chars), 0) AS repeated FROM summed b WHERE b.conv_id = w.conv_id AND b.i >= w.h AND b.i < w.s) p
    GROUP BY w.conv_id, w.s
)
SELECT conv_id, any_value(n)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    any_value(all_chars)::BIGINT AS formatted_chars
FROM summed JOIN (SELECT conv_id, sum(chars) AS all_chars FROM sized GROUP BY conv_id) z USING (conv_id) GROUP BY conv_id
"""

_QUALITY = r"""
WITH given AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {words} AS words FROM documents
), runs AS (
    SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, words FROM given WHERE len(words) >= 3
), repeated AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2]) AS n FROM runs
), covered AS (
    SELECT doc_id, count(DISTINCT pos + k) AS n FROM repeated, range(0, 3) t(k) WHERE n >= 2 GROUP BY doc_id
), lines AS (
    SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM given
), filled AS (
    SELECT doc_id, host, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inside FROM lines
), named AS (
    SELECT doc_id, host, line, regexp_replace(regexp_replace(lower(inside), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS plain
    FROM filled WHERE inside <> ''
), doubled AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM named GROUP BY doc_id
), spread AS (
    SELECT host, plain, keeper
    FROM (SELECT host, plain, min(doc_id) AS keeper, count(DISTINCT doc_id) AS n FROM named GROUP BY ALL)
    JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM given GROUP BY host) USING (host)
    WHERE n > 10 AND 100 * n > 1 * docs
), thin AS (
    SELECT doc_id, sum(length(line)) FILTER (keeper IS NULL OR keeper = doc_id) AS kept_chars, sum(length(line)) AS all_chars
    FROM named LEFT JOIN spread USING (host, plain) GROUP BY doc_id
), counts AS (
    SELECT g.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        coalesce(coalesce(kept_chars, 0) < 0.3 * all_chars, FALSE) AS depleted
    FROM given g LEFT JOIN doubled d USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN thin USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept
FROM counts
""".replace("{words}", _WORDS)

_REPEATS = """
WITH given AS (
    -- Two hex digits a byte, so byte positions are exact.
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), windows AS (
    SELECT doc_id, unnest(range(0, n - 99)) AS start, bytes FROM given WHERE n >= 100
), named AS (
    SELECT doc_id, start, md5_number(substr(bytes, 2 * start + 1, 200)) AS name FROM windows
), later AS (
    SELECT doc_id, start FROM (
        SELECT doc_id, start, row_number() OVER (PARTITION BY name ORDER BY doc_id, start) AS k FROM named
    ) WHERE k > 1
), opened AS (
    SELECT doc_id, start, coalesce(start > lag(start) OVER w + 100, TRUE) AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY start)
), numbered AS (
    SELECT doc_id, start, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM opened
), spans AS (
    SELECT doc_id, run, min(start) AS lo, max(start) + 100 AS hi FROM numbered GROUP BY ALL
), gaps AS (
    SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS past FROM spans
), pieces AS (
    SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n_spans, max(hi) AS past,
        string_agg(substr(bytes, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) AS head
    FROM gaps JOIN given USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(bytes, 2 * coalesce(past, 0) + 1))) AS kept_sha256
FROM given LEFT JOIN pieces USING (doc_id)
"""

_LINES = r"""
WITH split AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), numbered AS (
    SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        row_number() OVER (ORDER BY doc_id NULLS FIRST, i) AS pos
    FROM split
), firsts AS (
    SELECT words, min(pos) AS pos FROM numbered WHERE len(words) > 0 GROUP BY words
), shorter AS (
    SELECT pos, words, len(words) AS n, k, list_concat(words[:k - 1], words[k + 1:]) AS rest
    FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM firsts WHERE len(words) >= 5)
), near AS (
    -- One word replaced: equal without the word at the same place.
    SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, k, rest) AS earliest FROM shorter) WHERE earliest < pos
    -- One word added or dropped.
    UNION SELECT greatest(s.pos, f.pos) FROM shorter s JOIN firsts f ON f.words = s.rest WHERE len(f.words) >= 5
), judged AS (
    SELECT doc_id, i, line, n.pos IN (SELECT pos FROM near) OR coalesce(n.pos > f.pos, FALSE) AS gone
    FROM numbered n LEFT JOIN firsts f ON f.words = n.words
), rebuilt AS (
    SELECT doc_id, bool_or(gone) AS cut, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN r.cut THEN r.text ELSE d.text END AS text, d.lang, d.source,
    CASE WHEN r.cut THEN length(r.text) ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN rebuilt r ON r.doc_id IS NOT DISTINCT FROM d.doc_id
"""

_DIVERGENCE = r"""
WITH given AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), tokens AS (
    SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM given
), vocabulary AS (
    SELECT lang, term, count(*) AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT row) >= 30
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS n FROM vocabulary GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS c FROM tokens JOIN vocabulary USING (lang, term) GROUP BY ALL
), sized AS (
    SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM given) g
    LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
    SELECT s.lang, s.source, term, coalesce(c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (s.n + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (w.total + 5)) // (l.n + 5 * l.v) AS q
    FROM sized s JOIN langs l USING (lang) JOIN vocabulary w USING (lang) LEFT JOIN counts USING (lang, source, term)
), apart AS (
    SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS f FROM shares a JOIN shares b USING (lang, term) GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM sized a JOIN sized b USING (lang)
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source WHERE a.source <> b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE c > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
QUALIFY part = 'pair' OR rank <= 50
"""

_PERIODS = r"""
WITH given AS (
    SELECT row_number() OVER () AS row, doc_id, {words} AS words,
        -- CRC-32 of the decimal digits: eight shifts a byte, the reversed polynomial where a one falls out.
        xor(4294967295, list_reduce(
            list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ord(c)::BIGINT)),
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
        )) AS h
    FROM documents
), sized AS (
    SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM given
), placed AS (
    SELECT row, n, i, words[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM sized)
), again AS (
    SELECT x.row, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
    SELECT row, q AS period, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM again) GROUP BY row, q, island
    HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
    SELECT * FROM stretches s WHERE NOT EXISTS (
        SELECT 1 FROM stretches t WHERE t.row = s.row AND t.period < s.period AND t.start <= s.start AND t.start + t.length >= s.start + s.length
    )
), listed AS (
    SELECT row, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS list,
        arg_min({'s': start, 'l': length, 'p': period}, {'r': -length / period, 's': start, 'p': period}) AS best
    FROM runs GROUP BY row
), kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM placed p
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row = p.row AND p.i >= r.start + r.period AND p.i < r.start + r.length) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
    (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM sized LEFT JOIN listed USING (row) LEFT JOIN kept USING (row)
""".replace("{words}", _WORDS)

# The pages of the given tables have one article each, so SQL can cut it out.
_PAGES = r"""
WITH cut AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS inside FROM pages
), plain AS (
    SELECT page_id, url, regexp_replace(regexp_replace(inside, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS text FROM cut
), decoded AS (
    SELECT page_id, url, regexp_replace(replace(text, '&quot;', '"'), '&amp;?', '&', 'g') AS text FROM plain
), done AS (
    SELECT page_id, url, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM decoded
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM done
"""

TWINS = {
    "op13_html_extraction": _PAGES,
    "op12_periodic_runs": _PERIODS,
    "op11_source_divergence": _DIVERGENCE,
    "op1_line_dedup": _LINES,
    "op10_suffix_radix_dedup": _REPEATS,
    "op3_poisson_mix": _MIX,
    "op4_chat_windows": _CHAT,
    "op6_line_frequency_quality": _QUALITY,
}
