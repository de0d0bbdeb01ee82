"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    # Messages without tool calls, which are all that the table holds: SQL can't parse and validate calls.
    "op9_chat": """
        SELECT conv_id, turn, role, turn AS order_turn, 0::INTEGER AS order_step, 0::INTEGER AS n_calls, TRUE AS valid, '' AS problems,
               '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(role, ''))::VARCHAR || '}' AS line
        FROM conversations""",
    # A run of answers two turns apart is one chain, from its last call back to the result of its first.
    "chat_calls": """
        WITH a AS (SELECT conv_id, turn AS t, coalesce(text, '') AS text, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM conversations WHERE role = 'assistant'),
        b AS (SELECT *, max(t) OVER (PARTITION BY conv_id, t % 2, run) AS last FROM a)
        SELECT conv_id, 2 * t + 1 AS turn, 'assistant' AS role, 2 * last + 1 AS order_turn, (last - t)::INTEGER AS order_step, 1::INTEGER AS n_calls, t % 3 > 0 AS valid,
               CASE WHEN t % 3 > 0 THEN '' ELSE 'call 0: $.limit: out of bounds' END AS problems,
               '{"content":' || to_json(text)::VARCHAR || ',"role":"assistant","tool_calls":[{"arguments":{"after":{"$result":"c' || (t + 2) || '"},"limit":' || t % 3 || ',"query":' || to_json(text)::VARCHAR
               || '},"id":"c' || t || '","name":"search"}]}' AS line FROM b
        UNION ALL SELECT conv_id, 2 * t, 'tool', 2 * last + 1, last - t + 1, 0, TRUE, '', '{"content":' || to_json(text)::VARCHAR || ',"role":"tool","tool_call_id":"c' || t || '"}' FROM b
        UNION ALL SELECT conv_id, 2 * turn, role, 2 * turn, 0, 0, TRUE, '', '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' FROM conversations WHERE role <> 'assistant'""",
    "op11_collocations": r"""
        WITH pieces AS (
          SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
          FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        f AS (SELECT lang, phrase, count(*) AS f FROM (
                SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) g(k) WHERE len(w) >= k)
              GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
        sub AS (SELECT lang, a AS longer, array_to_string(w[i : j], ' ') AS phrase FROM c, range(1, 6) g(i), range(1, 6) h(j) WHERE j > i AND j <= len(w) AND j - i + 1 < len(w)),
        kept AS (SELECT c.* FROM c ANTI JOIN sub ON c.lang = sub.lang AND c.phrase = sub.phrase AND 100 * sub.longer >= 100 * c.a),
        cut AS (SELECT kept.lang, kept.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
                FROM kept, range(1, 5) g(k), f x, f y, n WHERE k < len(w) AND x.lang = kept.lang AND y.lang = kept.lang AND n.lang = kept.lang
                  AND x.phrase = array_to_string(w[1 : k], ' ') AND y.phrase = array_to_string(w[k + 1 : len(w)], ' ')),
        best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000""",
    # CRC-32 by its table of 256 remainders, which is made here from the polynomial
    "op13_resample": r"""
        WITH crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) g(b))),
        texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
        w AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM texts),
        runs AS (SELECT row, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 4) g(k) WHERE len(w) >= k),
        held AS (SELECT row, phrase, count(*) AS c FROM runs GROUP BY ALL),
        hashed AS (SELECT phrase, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
                 FROM (SELECT DISTINCT phrase, hex(phrase) AS h FROM held), crc),
        f AS (SELECT side, row, doc_id, bucket, c FROM held JOIN hashed USING (phrase) JOIN w USING (row)),
        cnt AS (SELECT side, bucket, sum(c)::DOUBLE AS c FROM f GROUP BY ALL), tot AS (SELECT (SELECT coalesce(sum(c), 0) FROM cnt WHERE side = 0) AS s, (SELECT coalesce(sum(c), 0) FROM cnt WHERE side = 1) AS t),
        gain AS (SELECT a.bucket, floor(1000 * ln((coalesce(b.c, 0) + 1) * (s + 10000) / ((a.c + 1) * (t + 10000))))::BIGINT AS g FROM (SELECT * FROM cnt WHERE side = 0) a LEFT JOIN (SELECT * FROM cnt WHERE side = 1) b USING (bucket), tot),
        weight AS (SELECT row, sum(c)::BIGINT AS n_features, sum(c * g)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY row),
        scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN weight USING (row) WHERE side = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 5 * n // 100 THEN k END AS rank FROM ranked""",
}
