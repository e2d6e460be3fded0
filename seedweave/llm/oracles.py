"""DuckDB SQL that must give the rows of the queries it can express."""

from __future__ import annotations

from seedweave.llm import quality, urls

_W = r"[^\x20\x09-\x0D]"


def _quality() -> str:
    level = ", ".join("list_sum([" + ", ".join(f"({rule} > {float(c)})::INT" for c in cuts) + f"])::INT AS l{k}"
                      for k, (rule, cuts) in enumerate(quality.GRID.items(), 1))
    size = [len(cuts) for cuts in quality.GRID.values()]
    cutoff = ", ".join(f"[{', '.join(map(str, map(float, cuts)))}][i{k} + 1] AS c{k}"
                       for k, cuts in enumerate(quality.GRID.values(), 1))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_W}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls
  FROM documents),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT d.doc_id, d.stratum, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)),
f AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         100.0::DOUBLE * n_symbols / greatest(word_chars, 1) AS symbols,
         100.0::DOUBLE * n_dup_lines / greatest(n_lines, 1) AS lines,
         100.0::DOUBLE * n_repeat_words / greatest(n_words, 1) AS repeats FROM m),
told AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cal AS (SELECT f.*, good FROM f JOIN told USING (doc_id) WHERE NOT base_failed),
levels AS (SELECT stratum, good, {level} FROM cal),
cells AS (SELECT stratum, l1, l2, l3, sum((good = 1)::INT) AS g, sum((good = 0)::INT) AS b FROM levels GROUP BY ALL),
triples AS (SELECT * FROM range({size[0] + 1}) a(i1), range({size[1] + 1}) b(i2), range({size[2] + 1}) c(i3)),
tries AS (SELECT (SELECT count(DISTINCT stratum) FROM cal) * (SELECT count(*) FROM triples) AS tests),
tried AS (
  SELECT stratum, i1, i2, i3, sum(g) AS n, coalesce(sum(g) FILTER (l1 > i1 OR l2 > i2 OR l3 > i3), 0) AS g,
         coalesce(sum(b) FILTER (l1 > i1 OR l2 > i2 OR l3 > i3), 0) AS b
  FROM cells, triples GROUP BY ALL),
tail AS (
  SELECT stratum, i1, i2, i3, g, b, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
         + j * ln({quality.ALPHA}) + (n - j) * ln(1 - {quality.ALPHA}))) AS p
  FROM (SELECT *, unnest(range(0, CAST(g AS BIGINT) + 1)) AS j FROM tried WHERE n > 0 AND b > g) GROUP BY ALL),
cut AS (
  SELECT DISTINCT ON (stratum) stratum, {cutoff} FROM tail, tries WHERE p <= {quality.DELTA} / tests
  ORDER BY stratum, b - g DESC, i1 + i2 + i3 DESC, i1 DESC, i2 DESC, i3 DESC),
judged AS (
  SELECT f.*, coalesce(symbols > c1, false) AS x1, coalesce(lines > c2, false) AS x2, coalesce(repeats > c3, false) AS x3
  FROM f LEFT JOIN cut USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT x1 AND NOT x2 AND NOT x3 AS kept,
       array_to_string(list_filter([CASE WHEN x1 THEN 'symbols' END, CASE WHEN x2 THEN 'lines' END,
                                    CASE WHEN x3 THEN 'repeats' END], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM judged"""


def _urls() -> str:
    o, tau, a = urls.ORDER, urls.TAU, len(urls.ALPHABET)
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest) + " END"
    levels, below = "", None
    for k in range(1, o + 1):
        b = {c: f"s.p_{c}" if below else f"(1.0::DOUBLE / {a})" for c in ("acc", "rej")}
        join = f"JOIN p{k - 1} s ON s.tail = substr(n.tail, 2, {k - 1})" if below else ""
        levels += f"""
n{k} AS (SELECT substr(gram, {o - k + 1}, {k}) AS tail, sum(acc) AS acc, sum(rej) AS rej FROM counts GROUP BY 1),
o{k} AS (SELECT substr(tail, 1, {k - 1}) AS ctx, sum(acc) AS acc, sum(rej) AS rej FROM n{k} GROUP BY 1),
p{k} AS (SELECT n.tail, (n.acc + {tau} * {b['acc']}) / (o.acc + {tau}) AS p_acc,
         (n.rej + {tau} * {b['rej']}) / (o.rej + {tau}) AS p_rej
         FROM n{k} n JOIN o{k} o ON o.ctx = substr(n.tail, 1, {k - 1}) {join}),"""
        below = True
    return rf"""
WITH u AS (SELECT page_id, regexp_matches(coalesce(url, ''), '://') AS has, coalesce(url, '') AS url FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
base AS (
  SELECT *, {rule} AS rule, {ruled} AS ruled,
         '{'^' * (o - 1)}' || regexp_replace(regexp_replace(translate(host || path, '{urls.UPPER}', '{urls.LOWER}'),
           '[0-9]', '0', 'g'), '[^a-z0/.-]', '_', 'g') || '$' AS signs,
         substr(md5(host), 1, 1) IN ('0', '1', '2') AS held FROM hp),
ul AS (SELECT host, path, any_value(signs) AS signs, any_value(ruled) AS ruled, any_value(held) AS held, count(*) AS n
       FROM base GROUP BY host, path),
g AS (SELECT *, substr(signs, CAST(i AS BIGINT), {o}) AS gram
      FROM (SELECT *, unnest(range(1, length(signs) - {o} + 2)) AS i FROM ul)),
counts AS (SELECT gram, sum(CASE WHEN ruled = 'allow' AND NOT held THEN n ELSE 0 END)::DOUBLE AS acc,
           sum(CASE WHEN ruled = 'block' AND NOT held THEN n ELSE 0 END)::DOUBLE AS rej FROM g GROUP BY gram),{levels}
r AS (SELECT tail AS gram, round({urls.SCALE} * (ln(p_acc) - ln(p_rej)))::BIGINT AS ratio FROM p{o}),
s AS (SELECT host, path, ruled, n, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM g JOIN r USING (gram)
      WHERE ruled IS NULL OR held GROUP BY ALL),
h AS (SELECT least(greatest(floor(score::DOUBLE / {urls.STEP}), -{urls.BINS}), {urls.BINS})::BIGINT AS step,
      sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS acc, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS rej
      FROM s WHERE ruled IS NOT NULL GROUP BY 1),
rates AS (SELECT least(greatest(0, (coalesce(lag(step) OVER (ORDER BY step), -{urls.BINS}) + 1) * {urls.STEP}), step * {urls.STEP})
          AS cutoff, coalesce(sum(rej) OVER b, 0)::DOUBLE / nullif(sum(rej) OVER (), 0)
          - coalesce(sum(acc) OVER b, 0)::DOUBLE / nullif(sum(acc) OVER (), 0) AS gain FROM h
          WINDOW b AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT cutoff FROM rates WHERE gain IS NOT NULL ORDER BY round(gain, 9) DESC, abs(cutoff), cutoff LIMIT 1), 0)
        AS cutoff)
SELECT page_id, base.host, base.path, rule,
       coalesce(base.ruled, CASE WHEN s.score >= cutoff THEN 'allow' ELSE 'block' END) AS verdict
FROM base CROSS JOIN cut LEFT JOIN s ON s.host = base.host AND s.path = base.path AND base.ruled IS NULL"""


QUALITY = _quality()
URLS = _urls()


# A row's leaf, as found and as tampered with; CRC-32 by its table, made from the polynomial.
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

MERKLE = f"""
WITH RECURSIVE crc_steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8),
digits AS (
  SELECT doc_id, d, 4294967295::BIGINT AS c, 0 AS k FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS d FROM documents)
  UNION ALL
  SELECT doc_id, d, xor(c >> 8, tab[(xor(c, ord(d[k + 1])) & 255) + 1]), k + 1 FROM digits, crc WHERE k < length(d)
), chosen AS (SELECT doc_id FROM digits WHERE k = length(d) AND xor(c, 4294967295) % 7 = 0),
rows_ AS (
  SELECT d.doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format("n_chars")} AS leaf,
         CASE WHEN c.doc_id IS NULL THEN {_LEAF.format("n_chars")} ELSE {_LEAF.format("(n_chars + 1)")} END AS found
  FROM (SELECT * FROM documents) d LEFT JOIN chosen c USING (doc_id)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM rows_
), nodes AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 2, n
), subroots AS (
  SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees
  FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, place AS pos, trees AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lvl, pos // 2, n
), top AS (SELECT h AS root, lvl AS height FROM crown WHERE n = 1),
way AS (
  SELECT l.tree, l.pos AS leaf_pos, k AS step, l.pos >> k AS pos, s.h AS sibling
  FROM leaves l JOIN subroots USING (tree) CROSS JOIN range(40) t(k)
  LEFT JOIN nodes s ON s.tree = l.tree AND s.lvl = k AND s.pos = xor(l.pos >> k, 1) WHERE k < height
  UNION ALL
  SELECT l.tree, l.pos, r.height + k, place >> k, s.h
  FROM leaves l JOIN subroots r USING (tree) CROSS JOIN top CROSS JOIN range(40) t(k)
  LEFT JOIN crown s ON s.lvl = k AND s.pos = xor(place >> k, 1) WHERE k < top.height
), folded AS (
  SELECT tree, pos AS leaf_pos, 0 AS step, found AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.leaf_pos, f.step + 1,
         sha256(CASE WHEN w.sibling IS NULL THEN f.h WHEN w.pos % 2 = 1 THEN w.sibling || f.h ELSE f.h || w.sibling END)
  FROM folded f JOIN way w ON w.tree = f.tree AND w.leaf_pos = f.leaf_pos AND w.step = f.step
), ends AS (SELECT tree, leaf_pos, arg_max(h, step) AS folded_root FROM folded GROUP BY ALL),
proofs AS (SELECT tree, leaf_pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM way GROUP BY ALL)
SELECT l.doc_id, l.leaf, r.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots r USING (tree) JOIN ends e ON e.tree = l.tree AND e.leaf_pos = l.pos
LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_pos = l.pos CROSS JOIN top
"""
