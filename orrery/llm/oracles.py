"""SQL for the queries that SQL can express, as brute force for small tables."""

BLANK = r"'[\x20\x09-\x0D]+'"
WORDS = f"w AS (SELECT doc_id, source, text, list_filter(string_split_regex(coalesce(text, ''), {BLANK}), lambda x: x <> '') AS ws FROM documents)"

SUBSTRINGS = f"""WITH {WORDS}, win AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
 firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s), hit AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE f < doc_id),
 gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM hit, (SELECT unnest(range(50)) AS k) GROUP BY doc_id),
 kept AS (SELECT doc_id, ws, CASE WHEN g IS NULL THEN ws ELSE [ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(g, i)] END AS k FROM w LEFT JOIN gone USING (doc_id))
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""

QUALITY = f"""WITH {WORDS}, five AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
 again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM five) WHERE n > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM again, (SELECT unnest(range(5)) AS k) GROUP BY 1),
 ln AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
 lw AS (SELECT doc_id, coalesce(source, '') AS host, line, list_filter(string_split_regex(line, {BLANK}), lambda x: x <> '') AS ws FROM ln),
 ok AS (SELECT doc_id, host, line, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(ws) AS n FROM lw WHERE len(ws) > 0),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM ok GROUP BY 1),
 content AS (SELECT doc_id, coalesce(source, '') AS host, array_to_string(ws, ' ') AS body FROM w WHERE len(ws) > 0),
 per AS (SELECT host, norm, count(DISTINCT body) AS n_docs FROM ok JOIN content USING (doc_id, host) GROUP BY 1, 2), tot AS (SELECT host, count(DISTINCT body) AS n_host FROM content GROUP BY 1),
 often AS (SELECT host, norm FROM per JOIN tot USING (host) WHERE n_docs > 20 AND n_docs > 0.01 * n_host),
 lost AS (SELECT doc_id, sum(n) AS lost FROM ok JOIN often USING (host, norm) GROUP BY 1),
 m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(coalesce(array_to_string(ws, ''), '')) AS BIGINT) AS word_chars, CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(lost, 0) AS BIGINT) AS n_left
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
 j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left >= 0.3 * n_words AS kept, n_left FROM j"""

LINES = f"""WITH ln AS (SELECT doc_id, coalesce(source, '') AS host, k, line, trim(regexp_replace(line, {BLANK}, ' ', 'g')) AS norm FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)),
 n AS (SELECT host, norm, count(DISTINCT doc_id) AS n_pages FROM ln WHERE norm <> '' GROUP BY 1, 2), t AS (SELECT coalesce(source, '') AS host, count(*) AS n_host FROM documents GROUP BY 1),
 often AS (SELECT host, norm FROM n JOIN t USING (host) WHERE n_pages >= 20 AND n_pages > 0.03 * n_host),
 left_over AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS body FROM ln ANTI JOIN often USING (host, norm) GROUP BY 1)
 SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(string_split(text, chr(10))) - coalesce(n, 0) AS BIGINT) END AS n_dropped, CAST(length(coalesce(body, '')) AS BIGINT) AS kept_chars, sha256(coalesce(body, '')) AS kept_sha256 FROM documents LEFT JOIN left_over USING (doc_id)"""

NEAR = f"""WITH RECURSIVE {WORDS}, lo AS (SELECT doc_id, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN ws] AS ws FROM w),
 sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM lo WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
 ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach(node, root) AS (SELECT a, a FROM ends UNION SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.node),
 comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON node = d.doc_id"""


def _clusters(rounds: int = 3) -> str:
    """k-means written out round by round, every vector against every centroid."""
    ctes = [
        "kept AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 16))",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(kept.v, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
        ctes.append(f"n{k} AS (SELECT rn, min([{distance}, q.c]) AS best FROM kept, c{k} q GROUP BY rn), a{k} AS (SELECT rn, vec_id, v, CAST(best[2] AS INTEGER) AS c, CAST(best[1] AS BIGINT) AS d FROM kept JOIN n{k} USING (rn))")
        if k < rounds:
            ctes.append(
                f"s{k} AS (SELECT c, p, sum(v[p]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 65)) AS p) GROUP BY c, p), m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{k} GROUP BY c),"
                f" c{k + 1} AS (SELECT q.c, coalesce(m{k}.v, q.v) AS v FROM c{k} q LEFT JOIN m{k} ON m{k}.c = q.c)"
            )
    return (
        "WITH " + ", ".join(ctes) + f" SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(q.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} q ON q.c = a.c"
    )


CLUSTERS = _clusters()

MIDDLES = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
 d AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
 c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, substring(t, 1, a) AS head, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS tail FROM c)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
