"""SQL for the corpus queries that it can express over whole tables."""

from __future__ import annotations

from tonewright.llm import chat, secret_scan

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
raw AS (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM d),
lines AS (SELECT rid, doc_id, no, raw, trim(raw, {BLANKS}) AS line FROM raw),
firsts AS (SELECT line, length(line) AS n, min((doc_id, no)) AS p FROM lines WHERE line <> '' GROUP BY line),
cuts AS (SELECT line, n, p, unnest(range(1, n + 1)) AS i FROM firsts),
variants AS (SELECT p, n, i, hash(left(line, (i - 1)::INT) || substr(line, (i + 1)::INT)) AS v FROM cuts),
same AS (SELECT p, min(p) OVER (PARTITION BY n, i, v) AS w FROM variants),
inserted AS (SELECT f.p AS a, v.p AS b FROM firsts f JOIN variants v ON v.n = f.n + 1 AND v.v = hash(f.line)),
near AS (SELECT p FROM same WHERE w < p UNION SELECT greatest(a, b) FROM inserted),
marked AS (SELECT l.*, l.line <> '' AND (l.doc_id, l.no) <> f.p AS again, l.line <> '' AND (l.doc_id, l.no) = f.p AND x.p IS NOT NULL AS close
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near x ON x.p = (l.doc_id, l.no))
SELECT any_value(m.doc_id) AS doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (again) AS n_exact, count(*) FILTER (close) AS n_near,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT coalesce(again, false) AND NOT coalesce(close, false)), '')) AS text_sha256 FROM marked m GROUP BY rid"""

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
LEAKS = f"""WITH i AS (SELECT row_number() OVER () AS irow, item_id, {TOKENS} AS ws FROM benchmark),
ishingles AS (SELECT DISTINCT irow, item_id, array_to_string(list_slice(ws, k, k + 4), ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS k FROM i WHERE len(ws) >= 5)),
items AS (SELECT irow, count(*) AS n FROM ishingles GROUP BY irow),
d AS (SELECT row_number() OVER () AS drow, doc_id, {TOKENS} AS ws FROM documents),
dshingles AS (SELECT DISTINCT drow, doc_id, array_to_string(list_slice(ws, k, k + 4), ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS k FROM d WHERE len(ws) >= 5)),
hits AS (SELECT drow, doc_id, irow, item_id, count(*) AS shared FROM dshingles JOIN ishingles USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS item_shingles, shared, shared / n AS containment FROM hits JOIN items USING (irow) WHERE shared >= ceil(round(0.8 * n, 9))
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM d JOIN i ON d.ws = i.ws WHERE len(i.ws) BETWEEN 1 AND 4"""


def _spans(k: int, rule: secret_scan.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {k} AS kind_no, m, g, pieces, unnest(range(1, len(m) + 1)) AS i, {rule.least} AS least
  FROM (SELECT rid, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {rule.group}) AS g, string_split_regex(text, '{p}') AS pieces FROM d WHERE regexp_matches(text, '{p}'))"""


def secrets() -> str:
    rules = secret_scan.BASE + secret_scan.MORE
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    base = len(secret_scan.BASE)
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(rules))}),
placed AS (SELECT rid, kind_no, {kinds}[kind_no + 1] AS kind, length(m[i]) AS size, length(g[i]) AS own, least,
  (list_sum(list_transform(list_slice(pieces, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))::BIGINT AS s FROM found),
spans AS (SELECT rid, kind_no, kind, s, s + size AS e FROM placed WHERE own >= least)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind_no = {k}) AS n_{r.kind}" for k, r in enumerate(secret_scan.BASE))},
  sha256(coalesce({told} FILTER (kind_no < {base}), '')) AS base_sha256, coalesce({told}, '') AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY rid"""


CHAT = f"""WITH t AS (SELECT conv_id, coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS own, turn, CASE WHEN trim(coalesce(role, ''), {BLANKS}) = '' THEN 'unknown' ELSE trim(role, {BLANKS}) END AS role,
  replace(replace(coalesce(text, ''), '{chat.START}', '< |im_start|>'), '{chat.END}', '< |im_end|>') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY turn NULLS FIRST, role, text) AS no FROM t),
p AS (SELECT o.conv_id, s.own AS talk, s.speaker, o.no, o.role = s.speaker AS own, '{chat.START}' || CASE WHEN o.role = 'system' THEN 'system' WHEN o.role = s.speaker THEN 'assistant' ELSE 'user name=' || regexp_replace(o.role, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') END || chr(10) AS head,
  o.text || '{chat.END}' AS body FROM (SELECT DISTINCT own, role AS speaker FROM o WHERE role <> 'system') s JOIN o USING (own)),
q AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY talk, speaker ORDER BY no) - length(body) - 1 AS start FROM p)
SELECT any_value(conv_id) AS conv_id, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_learnt, string_agg(head || body || chr(10), '' ORDER BY no) AS text,
  coalesce(string_agg(start::BIGINT || ':' || (start + length(body))::BIGINT, ',' ORDER BY no) FILTER (own), '') AS mask FROM q GROUP BY talk, speaker"""

MIX = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, [1, 2, 3][((rank - 1) % 3 + 1)::INT] AS w FROM r),
o AS (SELECT *, coalesce(sum(3 * ss) OVER (ORDER BY ss::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
  (sum(w) OVER () - sum(w) OVER (ORDER BY ss::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + w)::BIGINT AS rest, (sum(ss) OVER ())::BIGINT AS budget FROM w),
l AS (SELECT min_by((budget - filled)::DOUBLE / rest, filled) AS level FROM o WHERE 3 * ss * rest >= w * (budget - filled)),
g AS (SELECT source, ss, rank, budget, least((3 * ss)::DOUBLE, level * w) AS target FROM o, l),
c AS (SELECT d.*, ss, rank, budget, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN target = 0 THEN 0 ELSE (copy * ss + upto)::DOUBLE / target END AS finish FROM c, (SELECT unnest([0, 1, 2]) AS copy)),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, copy, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= budget AS taken FROM e)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(ss) AS source_size, any_value(target) AS target, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken FROM m GROUP BY rid"""

ARCHIVE = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) END AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM f"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM benchmark),
c AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS words FROM d WHERE len(ts) > 0),
tf AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
it AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT item, item_id, doc, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM it JOIN w USING (term) JOIN tf USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

SQL = {
    "op1_line_dedup": LINES,
    "op3_decontamination": LEAKS,
    "op6_secrets": secrets(),
    "op7_chat": CHAT,
    "op8_mixing": MIX,
    "op10_warc": ARCHIVE,
    "op11_lexical": RANKED,
}
