"""DuckDB SQL of the corpus queries that SQL can express."""

from .license_scan import BASE_PHRASES, LICENSE_WORD, NOTICES
from .quality import CHAR_CLASSES, COMMON_WORDS, SYMBOL


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    templates = BASE_PHRASES + NOTICES
    words = [text.split() for _, text, _ in templates]
    places = ", ".join(f"({_quoted(f'{a} {b}')}, {i}, {j})" for i, w in enumerate(words) for j, (a, b) in enumerate(zip(w, w[1:])))
    known = ", ".join(f"({i}, {_quoted(label)}, {share}::DOUBLE, {len(words[i]) - 1})" for i, (label, _, share) in enumerate(templates))
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LICENSE_WORD}') AS words
  FROM documents),
placed AS (SELECT rid, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM cut),
grams AS (SELECT rid, pos, w || ' ' || lead(w) OVER (PARTITION BY rid ORDER BY pos) AS gram FROM placed),
places(gram, template, place) AS (VALUES {places}),
known(template, label, share, n_places) AS (VALUES {known}),
hits AS (
  SELECT g.rid, p.template, g.pos - p.place AS diagonal, min(g.pos) AS first_at, max(g.pos) AS last_at, list(DISTINCT p.place) AS shown
  FROM grams g JOIN places p USING (gram) GROUP BY ALL),
diagonals AS (SELECT h.* FROM hits h JOIN known k USING (template) WHERE k.share < 1 OR len(h.shown) = k.n_places),
marked AS (
  SELECT d.*, k.label, k.share, k.n_places, len(d.shown) = k.n_places AS apart,
         lag(diagonal) OVER line AS diagonal_before, lag(last_at) OVER line AS last_before, lag(len(d.shown) = k.n_places) OVER line AS apart_before
  FROM diagonals d JOIN known k USING (template) WINDOW line AS (PARTITION BY rid, template ORDER BY first_at, diagonal)),
opened AS (
  SELECT *, sum(CASE WHEN diagonal_before IS NULL OR apart OR apart_before OR abs(diagonal - diagonal_before) > 2 OR first_at > last_before + 4 THEN 1 ELSE 0 END)
            OVER (PARTITION BY rid, template ORDER BY first_at, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span
  FROM marked),
spans AS (
  SELECT rid, template, label, share, min(first_at) - 1 AS first_word, len(list_distinct(flatten(list(shown)))) / n_places::DOUBLE AS coverage
  FROM opened GROUP BY rid, template, label, share, n_places, span),
verified AS (SELECT *, template < {len(BASE_PHRASES)} AS base FROM spans WHERE coverage >= share)
SELECT c.doc_id, len(c.words)::BIGINT AS n_words, count(*) FILTER (v.base)::BIGINT AS n_base,
       min(v.first_word) FILTER (v.base)::BIGINT AS first_word, max(v.first_word) FILTER (v.base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT v.label, ',' ORDER BY v.label) FILTER (v.base), '') AS base_labels,
       coalesce(string_agg(DISTINCT v.label, ',' ORDER BY v.label), '') AS labels, coalesce(max(v.coverage), 0.0)::DOUBLE AS score
FROM cut c LEFT JOIN verified v USING (rid) GROUP BY c.rid, c.doc_id, c.words
"""


def _quality_sql() -> str:
    classes = ", ".join(f"(length(text) - length(regexp_replace(text, {_quoted(c)}, '', 'g')))::DOUBLE" for c in CHAR_CLASSES)
    words = ", ".join(f"coalesce(h[{_quoted(w)}], 0)::DOUBLE" for w in COMMON_WORDS)
    common = ", ".join(map(_quoted, COMMON_WORDS))
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + f"] AS ref_{name}"
    both = f"{sums('chars', len(CHAR_CLASSES) + 1)}, {sums('common', len(COMMON_WORDS) + 1)}"
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((s[1] + s[2]) / 2)) ELSE 0 END"
    distance = lambda p, q: (
        f"CASE WHEN list_sum({p}) <> 0 AND list_sum({q}) <> 0 THEN sqrt(greatest(list_sum(list_transform(list_zip(list_transform({p}, lambda v: v / list_sum({p})), "
        f"list_transform({q}, lambda v: v / list_sum({q}))), lambda s: ({half('s[1]')} + {half('s[2]')}) / 2)), 0)) END")  # fmt: skip
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
placed AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS pos FROM cut),
windows AS (SELECT rid, pos, w || ' ' || lead(w) OVER line || ' ' || lead(w, 2) OVER line AS g FROM placed WINDOW line AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM windows WHERE g IS NOT NULL) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT pos) AS n FROM twice GROUP BY rid),
frequent AS (SELECT rid, map(list(w), list(n)) AS h FROM (SELECT rid, lower(w) AS w, count(*) AS n FROM placed WHERE lower(w) IN ({common}) GROUP BY ALL) GROUP BY rid),
counted AS (
  SELECT c.doc_id, c.lang, len(c.words)::BIGINT AS n_words, length(array_to_string(c.words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(c.text, '{SYMBOL}'))::BIGINT AS n_symbols, (len(c.lines) - len(list_distinct(c.lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(c.text)::DOUBLE AS n_chars, [{classes}] AS chars, [{words}] AS common
  FROM cut c LEFT JOIN repeated r USING (rid) LEFT JOIN frequent f USING (rid)),
made AS (SELECT * REPLACE (list_append(chars, n_chars - list_sum(chars)) AS chars, list_append(common, n_words - list_sum(common)) AS common) FROM counted),
judgable AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM made),
refs AS (SELECT lang, {both} FROM judgable WHERE NOT base_failed GROUP BY lang),
pooled AS (SELECT {both.replace("sum(", "coalesce(sum(").replace("])", "]), 0)")} FROM judgable WHERE NOT base_failed),
chosen AS (
  SELECT m.*, p.ref_chars AS all_chars, p.ref_common AS all_common, r.ref_chars, r.ref_common,
         r.ref_common IS NULL OR list_sum(r.ref_common) - CASE WHEN base_failed THEN 0 ELSE list_sum(common) END < 5000 AS alone
  FROM judgable m CROSS JOIN pooled p LEFT JOIN refs r ON m.lang = r.lang),
compared AS (
  SELECT *, list_transform(CASE WHEN alone THEN all_chars ELSE ref_chars END, lambda v, i: v - CASE WHEN base_failed THEN 0 ELSE chars[i] END) AS q_chars,
         list_transform(CASE WHEN alone THEN all_common ELSE ref_common END, lambda v, i: v - CASE WHEN base_failed THEN 0 ELSE common[i] END) AS q_common
  FROM chosen),
judged AS (SELECT *, {distance("chars", "q_chars")} AS char_distance, {distance("common", "q_common")} AS word_distance FROM compared),
bounded AS (
  SELECT *, coalesce(char_distance, 0) / (0.15::DOUBLE + 0.6::DOUBLE / sqrt(greatest(n_words, 1))) AS over_chars,
         coalesce(word_distance, 0) / (0.22::DOUBLE + 0.9::DOUBLE / sqrt(greatest(n_words, 1))) AS over_common
  FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND over_chars <= 1 AND over_common <= 1 AND over_chars + over_common <= 1.65 AS kept, round(char_distance, 9) AS char_distance, round(word_distance, 9) AS word_distance
FROM bounded
"""


OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents),
own AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY (source IS NULL), source COLLATE "binary") - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, [-0.5, 0.0, 0.5][(rank % 3 + 1)::INT]::DOUBLE AS slope,
         2.0::DOUBLE * source_size AS cap
  FROM own),
levels AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM weighed),
goal AS (
  SELECT source, source_size, slope,
         least(cap, coalesce((SELECT first(l.free ORDER BY l.ratio, l.rank) FROM levels l WHERE l.free <= l.ratio) * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, g.slope,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
shares AS (
  SELECT *, least(greatest(round(target)::BIGINT - start, 0), size) AS one,
         least(greatest(round(target)::BIGINT - start - source_size, 0), size) AS two
  FROM placed),
timed AS (
  SELECT *, CASE WHEN one > 0 THEN start / target END AS x, CASE WHEN two > 0 THEN (start + source_size) / target END AS y FROM shares)
SELECT doc_id, source, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN slope = 0 THEN x ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) END + 0.0 AS position,
       CASE WHEN slope = 0 THEN y ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END + 0.0 AS next_position
FROM timed
"""

def _node(url: str) -> str:
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    host, path = f"regexp_extract({rest}, '^[^/?#]*')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    low = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"CASE WHEN contains({url}, '://') AND {host} <> '' THEN {low} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || regexp_extract({url}, '^[^?#]*(\?[^#]*)', 1) END"


def _attribute(tag: str, name: str) -> str:
    found = rf"""regexp_extract({tag}, '(?is)\b{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return rf"""regexp_replace({found}, '^["'']|["'']$', '', 'g')"""


def _absolute(base: str, link: str) -> str:
    root, folder = f"regexp_extract({base}, '^([^?#]*?://[^/?#]*)', 1)", f"regexp_extract({base}, '^[^?#]*?://[^/?#]*([^?#]*/)', 1)"
    return (
        f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract({base}, '^([^?#]*?:)//', 1) || {link} "
        f"WHEN starts_with({link}, '/') THEN {root} || {link} ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {link} END")  # fmt: skip


def _folded(url: str) -> str:
    steps = f"list_prepend('', string_split(regexp_extract({url}, '^[^?#]*?://[^/?#]*/([^?#]*)', 1), '/'))"
    fold = f"list_reduce({steps}, lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END)"
    return f"regexp_extract({url}, '^([^?#]*?://[^/?#]*)', 1) || {fold} || regexp_extract({url}, '^[^?#]*([?#].*)$', 1)"


OP9 = rf"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, html,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_node("url")} AS node
  FROM cut),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT n.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.rid ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, r.rule_host || r.rule_path DESC, r.verdict DESC) AS place
  FROM named n LEFT JOIN rules r ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)),
tags AS (
  SELECT url, regexp_extract_all(html, '(?is)<link\b[^>]*>') AS links, regexp_extract_all(html, '(?is)<meta\b[^>]*>') AS metas,
         regexp_extract(html, '(?is)<base\b[^>]*>') AS base
  FROM cut WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
pointed AS (
  SELECT url, {_attribute("base", "href")} AS base, unnest(list_concat(
    list_transform(list_filter(links, lambda t: lower({_attribute("t", "rel")}) = 'canonical'), lambda t: {_attribute("t", "href")}),
    list_transform(list_filter(metas, lambda t: lower({_attribute("t", "http-equiv")}) = 'refresh'), lambda t: regexp_extract({_attribute("t", "content")}, '(?is)url\s*=\s*[''"]?([^''"]+)', 1)))) AS link
  FROM tags),
seen_from AS (SELECT url, CASE WHEN base = '' THEN url ELSE {_folded("(" + _absolute("url", "base") + ")")} END AS base, trim(replace(link, '&amp;', '&')) AS link FROM pointed),
targets AS (SELECT url, {_absolute("base", "link")} AS target FROM seen_from),
edges AS (SELECT {_node("url")} AS a, {_node("target")} AS b FROM (SELECT url, {_folded("target")} AS target FROM targets)),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
ends AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/]*') AS host, regexp_extract(a, '^[^/]*(/[^?]*)', 1) AS path FROM both_ways),
judged_ends AS (
  SELECT e.node, r.verdict, row_number() OVER (PARTITION BY e.node ORDER BY length(r.rule_host || r.rule_path) DESC, r.rule_host || r.rule_path DESC, r.verdict DESC) AS place
  FROM ends e JOIN rules r ON (e.host = r.rule_host OR ends_with(e.host, '.' || r.rule_host)) AND starts_with(e.path, r.rule_path)),
reached(node) AS (SELECT node FROM judged_ends WHERE place = 1 AND verdict = 'block' UNION SELECT b FROM reached JOIN both_ways ON node = a)
SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.verdict, CASE WHEN r.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, r.node IS NOT NULL AS alias_of_blocked
FROM best b LEFT JOIN reached r USING (node) WHERE place = 1
"""

OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(n))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(digits), 2), lambda i: ('0x' || digits[i:i + 1])::BIGINT)),
                                 lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM counted, crc),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
lacking AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, w.n, l.word, l.n FROM words w JOIN lacking l ON l.rest = w.word
  UNION SELECT l.word, l.n, w.word, w.n FROM words w JOIN lacking l ON l.rest = w.word),
best AS (SELECT a AS word, a_n AS n, count(*) AS n_near, arg_min({'b': b, 'b_n': b_n}, {'r': -b_n, 'b': b}) AS top FROM pairs GROUP BY a, a_n),
judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top.b_n >= 2 * w.n THEN b.top.b END AS form, CASE WHEN b.top.b_n >= 2 * w.n THEN b.top.b_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
led AS (
  SELECT word, word AS at FROM judged
  UNION ALL SELECT l.word, j.form FROM led l JOIN judged j ON j.word = l.at WHERE j.form IS NOT NULL)
SELECT j.word, j.form, l.at AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN led l USING (word) JOIN judged e ON e.word = l.at AND e.form IS NULL
"""

#: The CRC-32 of a decimal is taken over its characters, by a table of 256 that a rule makes.
OP12 = r"""
WITH crc AS (
  SELECT list(c ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(n))),
ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered), crc),
placed AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h),
whole AS (
  SELECT c.conv_id, coalesce(list({'role': p.role, 'text': p.text} ORDER BY p.part, p.pos) FILTER (p.pos IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN placed p USING (conv_id) GROUP BY c.conv_id),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM whole),
keyed AS (
  SELECT conv_id, depth, len(turns) = depth AS ended, turns[1:depth] AS node, CASE WHEN depth > 0 THEN turns[1:depth - 1] END AS above,
         CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars
  FROM steps),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n, max(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM keyed GROUP BY node, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.above = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.above),
beneath AS (
  SELECT k.node, k.depth, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n - 1) * u.chars) AS saved_tokens
  FROM linked u JOIN keyed k ON k.conv_id = u.conv_id AND k.depth <= u.depth GROUP BY k.node, k.depth)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n::BIGINT AS n_convs, l.n_children::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN beneath b USING (node, depth)
"""

ORACLES = {"op1_license_scan": _license_sql(), "op2_quality_rules": _quality_sql(), "op4_mix_sources": OP4, "op9_url_filter": OP9, "op11_spelling_variants": OP11, "op12_prefix_trie": OP12}
