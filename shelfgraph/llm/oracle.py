"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from shelfgraph.llm import quality_rules as rules


def quality_rules_sql(kept_only: bool = False) -> str:
    k = len(rules.RULES)
    rule = lambda bad, good: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    share = lambda a, b: f"({a} / greatest({b}, 1))"
    votes = ", ".join((
        rule(f"{share('n_symbols', 'n_words')} > 0.2", f"{share('n_symbols', 'n_words')} <= 0.05"),
        rule(f"{share('n_repeat_words', 'n_words')} > 0.3", f"{share('n_repeat_words', 'n_words')} <= 0.1"),
        rule(f"{share('n_dup_lines', 'n_lines')} > 0.3", f"{share('n_dup_lines', 'n_lines')} <= 0.1"),
        rule(f"{share('word_chars', 'n_words')} NOT BETWEEN 2 AND 14", f"{share('word_chars', 'n_words')} BETWEEN 3 AND 10"),
        rule(f"{share('n_capitals', 'n_letters')} > 0.4", f"{share('n_capitals', 'n_letters')} <= 0.15"),
        rule(f"n_words BETWEEN 20 AND 2000 AND {share('n_distinct', 'n_words')} < 0.2", f"{share('n_distinct', 'n_words')} >= 0.4"),
        rule(f"n_words >= 60 AND {share('n_letters', 'word_chars')} < 0.88", f"{share('n_letters', 'word_chars')} >= 0.93"),
    ))
    accuracy = lambda sign, cls: f"sum(CASE WHEN p.v[r] {sign} THEN p.n * {cls} ELSE 0 END)"
    posterior = f"""1.0 / (1.0 + exp(-(ln(e.pi) - ln(1.0 - e.pi) + list_sum(list_transform(range(1, {k + 1}), lambda r:
        CASE p.v[r] WHEN 1 THEN ln(e.a[r]) - ln(1.0 - e.b[r]) WHEN -1 THEN ln(1.0 - e.a[r]) - ln(e.b[r]) ELSE 0.0 END)))))"""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS uid,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (SELECT uid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT uid, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
hits AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS c FROM windows) WHERE c > 1),
cover AS (SELECT uid, sum(n)::BIGINT AS n FROM (SELECT uid, least(8, i - coalesce(lag(i) OVER (PARTITION BY uid ORDER BY i), -8)) AS n FROM hits) GROUP BY uid),
stats AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS n_letters, len(list_distinct(w)) AS n_distinct
  FROM words LEFT JOIN cover USING (uid)),
voted AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [{votes}] AS v FROM stats),
pats AS (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v),
em AS (
  SELECT 0 AS i, 0.8::DOUBLE AS pi, list_transform(range({k}), lambda r: 0.95::DOUBLE) AS a, list_transform(range({k}), lambda r: 0.3::DOUBLE) AS b
  UNION ALL
  SELECT i + 1, s.pi, s.a, s.b FROM (
    SELECT max(i) AS i, least(0.99, greatest(0.5, sum(n * g) / sum(n))) AS pi,
      list(v ORDER BY v) AS pv, list(n ORDER BY v) AS pn, list(g ORDER BY v) AS pg,
      list_transform(range(1, {k + 1}), lambda r: least(0.999, greatest(0.5,
        (list_sum(list_transform(range(1, len(pv) + 1), lambda q: CASE WHEN pv[q][r] = 1 THEN pn[q] * pg[q] ELSE 0 END)) + 0.95)
        / (list_sum(list_transform(range(1, len(pv) + 1), lambda q: CASE WHEN pv[q][r] <> 0 THEN pn[q] * pg[q] ELSE 0 END)) + 1.0)))) AS a,
      list_transform(range(1, {k + 1}), lambda r: least(0.999, greatest(0.05,
        (list_sum(list_transform(range(1, len(pv) + 1), lambda q: CASE WHEN pv[q][r] = -1 THEN pn[q] * (1 - pg[q]) ELSE 0 END)) + 0.3)
        / (list_sum(list_transform(range(1, len(pv) + 1), lambda q: CASE WHEN pv[q][r] <> 0 THEN pn[q] * (1 - pg[q]) ELSE 0 END)) + 1.0)))) AS b
    FROM (SELECT e.i, p.v, p.n, {posterior} AS g FROM em e, pats p WHERE e.i < {rules.ITERATIONS}) HAVING max(i) IS NOT NULL) s),
verdict AS (SELECT p.v, {posterior} AS posterior FROM em e, pats p WHERE e.i = {rules.ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND posterior >= 0.5) AS kept
FROM voted JOIN verdict USING (v)"""
