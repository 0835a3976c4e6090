"""The same results in DuckDB SQL, written from the rules."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
sources AS (
  SELECT *, 3 * words AS cap, 3 * words / weight AS full_at FROM (
    SELECT no_source, src, CAST(sum(size) AS BIGINT) AS words,
           (row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY no_source, src)),
levels AS (
  SELECT *, (sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, no_source, src
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY full_at, no_source, src
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
chosen AS (
  SELECT level FROM levels WHERE full_at >= level ORDER BY full_at, no_source, src LIMIT 1),
targets AS (
  SELECT no_source, src, words,
         CASE WHEN full_at <= c.level THEN CAST(cap AS DOUBLE) ELSE c.level * weight END AS target
  FROM sources CROSS JOIN chosen c),
queue AS (
  SELECT s.*, t.words, t.target,
         CAST(sum(size) OVER (PARTITION BY s.no_source, s.src ORDER BY place, size
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.no_source = t.no_source AND s.src = t.src),
served AS (
  SELECT no_source, src, place, size, copy, (copy * words + upto) / target AS v
  FROM queue, (VALUES (0), (1), (2)) e(copy) WHERE size > 0),
line AS (
  SELECT *, sum(size) OVER (ORDER BY v, no_source, src, copy, place, size ROWS UNBOUNDED PRECEDING)
         AS total FROM served),
taken AS (
  SELECT no_source, src, place, size, count(*) AS copies FROM line
  WHERE total <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.words AS source_size, q.target,
       CAST(coalesce(t.copies, 0) * q.size AS BIGINT) AS taken
FROM queue q LEFT JOIN taken t USING (no_source, src, place, size)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT rid, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
texts AS (SELECT w, row_number() OVER () AS txt FROM (SELECT DISTINCT w FROM b WHERE len(w) > 0)),
windows AS (
  SELECT txt, s, list_slice(w, s + 1, s + 10) AS ws FROM (
    SELECT txt, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM texts)),
parts AS (
  SELECT txt, s, len(ws) AS n, unnest(ws) AS term, s + generate_subscripts(ws, 1) - 1 AS off
  FROM windows),
freq AS (
  SELECT term, count(*) AS f FROM t WHERE term IN (SELECT term FROM parts) GROUP BY term),
rare AS (
  SELECT * FROM (
    SELECT txt, s, n, term, off, row_number() OVER (PARTITION BY txt, s ORDER BY f, off) AS turn,
           bool_or(f IS NULL) OVER (PARTITION BY txt, s) AS lost
    FROM parts LEFT JOIN freq USING (term))
  WHERE NOT lost AND turn <= 2),
starts AS (
  SELECT DISTINCT rid, txt, s, n, turn, pos - off AS st FROM t JOIN rare USING (term)),
exact AS (
  SELECT x.rid, x.txt, x.n, x.st + x.s AS pos
  FROM starts x JOIN d USING (rid) JOIN windows v ON v.txt = x.txt AND v.s = x.s
  WHERE turn = 1 AND x.st + x.s >= 0 AND list_slice(d.w, x.st + x.s + 1, x.st + x.s + x.n) = v.ws),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM exact) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item) AS n_items,
         string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM exact JOIN texts USING (txt) JOIN b USING (w) GROUP BY rid),
near AS (
  SELECT rid, count(DISTINCT txt) AS n_near FROM (
    SELECT a.rid, a.txt FROM starts a JOIN starts z ON a.rid = z.rid AND a.txt = z.txt AND a.s = z.s
    WHERE a.turn = 1 AND z.turn = 2 AND abs(a.st - z.st) <= 3
    UNION SELECT rid, txt FROM starts WHERE n = 1) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)
"""


def url_filter(rules: list[tuple[str, str]], order: int, alphabet: int, scale: int, bin_: int) -> str:
    """The URL filter's rows: rules, Witten-Bell models of both kinds, threshold, verdicts."""
    def fits(rule):
        host, slash, path = rule.partition("/")
        return (f"(host = '{host}' OR ends_with(host, '.{host}')) "
                f"AND starts_with(path, '{slash}{path}')")
    by_length = sorted((r for _, r in rules), key=len, reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in by_length) + " END"
    given = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in rules) + " END"
    models = [f"p0 AS (SELECT DISTINCT gram, 1.0::DOUBLE / {alphabet} AS pa, "
              f"1.0::DOUBLE / {alphabet} AS pb FROM judged)"]
    for k in range(order + 1):
        smooth = ", ".join(
            f"CASE WHEN n{x} > 0 THEN (coalesce({x}, 0) + t{x} * p{x}) / (n{x} + t{x}) ELSE p{x} END "
            f"AS p{x}" for x in "ab")
        models.append(f"""
s{k} AS (SELECT right(gram, {k + 1}) AS t, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b
  FROM counts GROUP BY 1),
c{k} AS (SELECT left(t, {k}) AS context, sum(a) AS na, sum(b) AS nb,
    CAST(count(*) FILTER (WHERE a > 0) AS DOUBLE) AS ta,
    CAST(count(*) FILTER (WHERE b > 0) AS DOUBLE) AS tb FROM s{k} GROUP BY 1),
p{k + 1} AS (SELECT gram, {smooth} FROM p{k} LEFT JOIN s{k} ON t = right(gram, {k + 1})
  LEFT JOIN c{k} ON context = substr(gram, {order + 1 - k}, {k}))""")
    return f"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
           '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, {given} AS given FROM (SELECT *, {rule} AS rule, host || path AS chars FROM urls)),
texts AS (
  SELECT chars, given, count(*) AS n, substr(md5(chars), 1, 1) IN ('0', '1', '2') AS aside
  FROM ruled GROUP BY 1, 2),
grams AS (
  SELECT chars, given, n, aside, substr(repeat(chr(2), {order}) || chars || chr(3), i, {order + 1})
         AS gram FROM (SELECT *, unnest(range(1, length(chars) + 2)) AS i FROM texts)),
judged AS (SELECT * FROM grams WHERE given IS NULL OR aside),
counts AS (
  SELECT gram, sum(CASE given WHEN 'allow' THEN n ELSE 0 END) AS a,
         sum(CASE given WHEN 'block' THEN n ELSE 0 END) AS b
  FROM grams WHERE given IS NOT NULL AND NOT aside GROUP BY 1),
{",".join(models)},
ratios AS (SELECT gram, CAST(round((ln(pa) - ln(pb)) * {scale}) AS BIGINT) AS ratio
  FROM p{order + 1}),
scored AS (
  SELECT chars, given, n, CAST(sum(ratio) AS DOUBLE) / count(*) AS score
  FROM judged JOIN ratios USING (gram) GROUP BY 1, 2, 3),
bins AS (
  SELECT floor(score / {bin_}) AS bin, sum(CASE given WHEN 'allow' THEN n ELSE 0 END) AS a,
         sum(CASE given WHEN 'block' THEN n ELSE 0 END) AS b
  FROM scored WHERE given IS NOT NULL GROUP BY 1),
gains AS (
  SELECT bin, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b,
    coalesce(sum(a) OVER w, 0) AS below_a, coalesce(sum(b) OVER w, 0) AS below_b FROM bins
  WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (
  SELECT bin * {bin_} AS edge FROM gains WHERE all_a > 0 AND all_b > 0
  ORDER BY (all_a - below_a) / CAST(all_a AS DOUBLE) - (all_b - below_b) / CAST(all_b AS DOUBLE)
    DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(r.given,
         CASE WHEN s.score >= coalesce((SELECT edge FROM best), 0) THEN 'allow' ELSE 'block' END)
         AS verdict, s.score
FROM ruled r LEFT JOIN scored s ON r.given IS NULL AND s.given IS NULL AND r.chars = s.chars
"""
