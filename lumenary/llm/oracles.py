"""DuckDB SQL for the queries of this subpackage, where SQL can express them.

The others are out of its reach: XXH64 (1), PPM (5), nested decoding (6), learned models (7), rank
files and look-ahead (9), zstandard (10), HTML (4). Tests hold those against brute force.
"""

import re

from lumenary.llm.license_scan import BASE, PHRASE_SCORE, RARE, SLACK, TEMPLATES

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

def _crc32(text: str) -> str:
    """CRC-32 of ASCII ``text``, bit by bit."""
    step = "lambda c, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS key
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, key)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Texts as hex digits, two a byte; a string of 50 bytes is 100 digits.
_REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS key FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM t WHERE length(x) >= 100)),
f AS (SELECT key, min(doc_id) AS first FROM p GROUP BY 1),
hit AS (SELECT doc_id, i FROM p JOIN f USING (key) WHERE first < doc_id),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM run UNION ALL SELECT doc_id, max(b), NULL FROM run GROUP BY 1),
kept AS (SELECT doc_id, string_agg(CASE WHEN e IS NULL THEN substr(x, 2 * s + 1) ELSE substr(x, 2 * s + 1, 2 * (e - s)) END, '' ORDER BY s) AS k FROM gap JOIN t USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY 1)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_CONTROL = "^(<\\\\*(/?s>|<|\\|)|\\[\\\\*/?INST\\])"
_CHAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) IN ('<', '[') AND regexp_matches(substr(text, i), '{_CONTROL}')))
  + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 9 + CASE WHEN regexp_full_match(role, '[A-Za-z0-9_.-]{{1,64}}') THEN length(role) ELSE 1 + length(hex(encode(role))) END END AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1
"""

#: Runs by pairs of equal windows of five words, joined to islands by distance; of the periods of one stretch the smallest counts.
_RUNS = f"""
WITH d AS (SELECT doc_id, h, h // 10 AS g, w, CAST(len(w) AS BIGINT) AS n FROM (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents)),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM d),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM e),
v AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 5], ' ')) AS key FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM t WHERE n > 5)),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.key = y.key AND x.i < y.i),
s AS (SELECT doc_id, p, min(i) AS start, max(i) - min(i) + 5 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM q) GROUP BY doc_id, p, island),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s WHERE length >= 4 * p AND length >= 6 GROUP BY 1, 2, 3),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS kept FROM (SELECT doc_id, w, unnest(range(0, n)) AS i FROM t WHERE doc_id IN (SELECT doc_id FROM r)) ANTI JOIN x USING (doc_id, i) GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

def _licences() -> str:
    """Word by word: each indexed place of a template votes for the place of the file where the template would begin."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    tokens = lambda text: re.findall("[a-z0-9]+", text.lower())
    rows = []
    for k, (label, notice, phrases) in enumerate(TEMPLATES):
        words = tokens(notice)
        starts = [next(i for i in range(len(words)) if words[i : i + len(tokens(p))] == tokens(p)) for p in phrases]
        rows.append(f"({k}, '{label}', {listed(words)}, [{', '.join(f'{{w: {listed(tokens(p))}, s: {s}}}' for p, s in zip(phrases, starts, strict=True))}])")
    base = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in BASE)
    return f"""
WITH d AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
u AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM d)),
base AS (SELECT doc_id, i, label FROM u JOIN (VALUES {base}) b(phrase, label) ON u.word = b.phrase[1] JOIN d USING (doc_id) WHERE w[i + 1:i + len(phrase)] = phrase),
t(template, label, notice, phrases) AS (VALUES {", ".join(rows)}),
p AS (SELECT template, pos, notice[pos + 1] AS word FROM (SELECT *, unnest(range(0, len(notice))) AS pos FROM t)),
f AS (SELECT word, count(DISTINCT doc_id) AS files FROM u WHERE word IN (SELECT word FROM p) GROUP BY 1),
x AS (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(files, 0), word) AS k FROM (SELECT DISTINCT template, word FROM p) LEFT JOIN f USING (word)),
ix AS (SELECT template, word, pos FROM x JOIN p USING (template, word) WHERE k <= {RARE}),
h AS (SELECT * FROM u WHERE word IN (SELECT word FROM ix)),
v AS (SELECT doc_id, template, i - pos AS place, count(*) AS votes FROM h JOIN ix USING (word) WHERE doc_id IN (SELECT doc_id FROM h GROUP BY 1 HAVING count(DISTINCT word) > 1) GROUP BY 1, 2, 3),
c AS (SELECT doc_id, template, place, label, notice, phrases, w FROM v JOIN (SELECT template, count(*) AS indexed FROM ix GROUP BY 1) USING (template) JOIN t USING (template) JOIN d USING (doc_id) WHERE votes >= greatest(2, ceil(indexed / 2))),
g AS (SELECT doc_id, label, len(list_filter(range(0, len(notice)), lambda i: place + i >= 0 AND w[greatest(place + i, 0) + 1] = notice[i + 1])) / len(notice) AS share FROM c
  WHERE len(list_filter(phrases, lambda q: len(list_filter(range(-{SLACK}, {SLACK} + 1), lambda s: place + q.s + s >= 0 AND w[greatest(place + q.s + s, 0) + 1:greatest(place + q.s + s, 0) + len(q.w)] = q.w)) > 0)) = len(phrases)),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM g) GROUP BY 1),
s AS (SELECT doc_id, max(share) AS share FROM g GROUP BY 1)
SELECT doc_id, n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def _repair() -> str:
    """From the last row to the first, for each of the four states the least (cost, edits, repaired text) to the end."""
    follows, role = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    cost = lambda v, c, letter, text: f"{{c: {v}.c + {c}, a: '{letter}' || {v}.a, t: {text} || {v}.t}}"
    line = lambda who, text: f"chr(10) || {who} || ':' || {text}"
    keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def raw(s: int) -> str:
        kept = "".join(f" WHEN initial = '{i}' THEN {cost(f'v[{to[s] + 1}]', 'cut', 'K', line('role', 'text'))}" for i, to in keeps.items() if s in to)
        reroled = cost(f"v[{follows[s] + 1}]", "2 + cut", "R", line(f"'{role[s]}'", "text"))
        removed = cost(f"v[{s + 1}]", 3, "D", "''")
        return f"list_min(list_filter([{removed}, CASE WHEN NOT forced THEN {reroled} END{f', CASE WHEN forced THEN NULL{kept} END' if kept else ''}], lambda x: x IS NOT NULL))"

    def closed(s: int) -> str:
        t = follows[s]
        one, two = (line(f"'{role[x]}'", "''") for x in (s, t))
        return f"list_min([w[{s + 1}], {cost(f'w[{t + 1}]', 2, 'I', one)}, {cost(f'w[{follows[t] + 1}]', 4, 'II', f'{one} || {two}')}])"

    user, assistant = line("'user'", "''"), line("'assistant'", "''")
    end = f"[{{c: 0::BIGINT, a: '', t: ''}}, {{c: 4::BIGINT, a: 'II', t: {user} || {assistant}}}, {{c: 2::BIGINT, a: 'I', t: {assistant}}}, {{c: 0::BIGINT, a: '', t: ''}}]"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(key)} % 20 AS k FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 100), md5(text)) AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM e),
o AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS open FROM n),
f AS (SELECT *, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND open AS truncated, blank OR seen AS forced, CASE WHEN NOT blank AND NOT seen AND open THEN 1 ELSE 0 END AS cut FROM o),
z AS (SELECT conv_id, max(size) AS n, {end} AS v FROM f GROUP BY 1
  UNION ALL SELECT conv_id, n, [{", ".join(map(closed, range(4)))}] FROM (SELECT z.conv_id, z.n - 1 AS n, [{", ".join(map(raw, range(4)))}] AS w FROM z JOIN f ON f.conv_id = z.conv_id AND f.n = z.n)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1].c, 0) AS cost, coalesce(v[1].a, '') AS audit, sha256(substr(coalesce(v[1].t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id) LEFT JOIN (SELECT * FROM z WHERE n = 0) USING (conv_id)
"""


ORACLES: dict[str, str] = {"op2_decontaminate": _DECONTAMINATE, "op3_suffix_dedup": _REPEATS, "op8_chat_format": _CHAT, "op11_periodic_runs": _RUNS, "op12_license_scan": _licences(), "op13_conversation_repair": _repair()}
