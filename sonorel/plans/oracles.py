"""DuckDB SQL of the registered queries. Common table expressions are shared as text."""

from __future__ import annotations

TRACKS = """tracks AS (
  SELECT user_id // 15 * 10 + user_id % 10 AS track, row_number() OVER (PARTITION BY user_id // 15 * 10 + user_id % 10 ORDER BY ts, event_id) - 1 AS t,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS a, value
  FROM events)"""
HASHES = (
    TRACKS
    + """, hashes AS (
  SELECT track AS ref_id, t,
         ((a * 8 + lead(a, 1) OVER w) * 8 + lead(a, 2) OVER w) * 64 + floor(value)::BIGINT % 64 AS hash
  FROM tracks WINDOW w AS (PARTITION BY track ORDER BY t)),
r AS (SELECT * FROM hashes WHERE hash IS NOT NULL),
q AS (SELECT ref_id AS query_id, t - 20 AS qi, t - 20 AS t, hash FROM r WHERE t BETWEEN 20 AND 59)"""
)
STOP = """, few AS (SELECT hash FROM r GROUP BY hash HAVING count(*) <= 100), kept AS (SELECT r.* FROM r SEMI JOIN few USING (hash))"""
WANG_INDEX = (
    HASHES
    + STOP
    + """, v AS (SELECT query_id, ref_id, qi, k.t - q.t AS d FROM q JOIN kept k USING (hash)),
b AS (SELECT query_id, ref_id, d, count(*) AS c FROM v GROUP BY ALL),
cons AS (SELECT *, sum(c) OVER (PARTITION BY query_id, ref_id ORDER BY d RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM b),
peak AS (SELECT query_id, ref_id, max(s) AS votes, sum(s) AS total, max(d) - min(d) + 1 AS span FROM cons GROUP BY ALL),
plateau AS (SELECT query_id, ref_id, votes, total, span, list(d ORDER BY d) AS ds FROM cons JOIN peak USING (query_id, ref_id) WHERE s = votes GROUP BY ALL),
best AS (SELECT query_id, ref_id, votes, ds[len(ds) // 2 + 1] AS best,
           votes / ((total - votes)::DOUBLE / greatest(span - 1, 1) + 1) AS prominence FROM plateau),
hit AS (SELECT v.query_id, v.ref_id, count(DISTINCT qi) AS hits FROM v JOIN best USING (query_id, ref_id) WHERE abs(d - best) <= 1 GROUP BY ALL),
ql AS (SELECT query_id, count(*) AS n FROM q GROUP BY ALL),
m AS (SELECT query_id, ref_id, TRUE AS is_match, least(1, hits::DOUBLE / n) AS score, votes::BIGINT AS votes, prominence, best::BIGINT AS offset_frames,
        round(best * 1000 / 62.5::DOUBLE)::BIGINT AS offset_ms, 1::DOUBLE AS time_scale
      FROM best JOIN hit USING (query_id, ref_id) JOIN ql USING (query_id) WHERE votes >= 5 AND prominence >= 5 AND hits::DOUBLE / n >= 0.15)"""
)
_OUT = "query_id, ref_id, is_match, round(score, 6) AS score, votes, round(prominence, 6) AS prominence, offset_frames, offset_ms, round(time_scale, 6) AS time_scale"

SAMPLES = TRACKS + """, x AS (SELECT track, t, value AS v FROM tracks), n AS (SELECT track, count(*) AS n FROM x GROUP BY 1)"""
# n_fft 16, hop 8, Hann, not centred
DFT = (
    SAMPLES
    + """, win AS (SELECT k, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / 16) AS w FROM range(16) g(k)),
fr AS (SELECT n.track, i AS t FROM n, range(0, greatest(1 + (n.n - 16) // 8, 0)) g(i)),
dft AS (SELECT fr.track, fr.t, f, sum(v * w * cos(2 * pi() * f * k / 16)) AS re, sum(v * w * sin(2 * pi() * f * k / 16)) AS im
        FROM fr JOIN win ON TRUE JOIN x ON x.track = fr.track AND x.t = fr.t * 8 + k JOIN range(9) g(f) ON TRUE GROUP BY ALL),
p AS (SELECT track::VARCHAR AS recording_id, t, f, re * re + im * im AS v FROM dft)"""
)
DB = DFT + """, db AS (SELECT recording_id, t, f, round(10 * log10(greatest(v, 1e-12::DOUBLE)), 3) AS v FROM p)"""
MAX2D = (
    DB
    + """, mf AS (SELECT *, max(v) OVER (PARTITION BY recording_id, t ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM db),
mx AS (SELECT recording_id, t, f, v, max(m) OVER (PARTITION BY recording_id, f ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM mf)"""
)
PEAKS = MAX2D + """, pk AS (SELECT recording_id, t, f, v AS mag FROM mx WHERE v > 20 AND v >= m)"""
CAPPED = PEAKS + """, cp AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY recording_id, floor(t / 10::DOUBLE) ORDER BY mag DESC, t, f) <= 4)"""
PAIRS = (
    CAPPED
    + """, pr AS (SELECT a.recording_id, a.t AS ta, a.f AS fa, a.mag AS ma, b.t AS tb, b.f AS fb, b.mag AS mb
  FROM cp a JOIN cp b ON a.recording_id = b.recording_id AND b.t - a.t BETWEEN 1 AND 20 AND abs(b.f - a.f) <= 6
  QUALIFY row_number() OVER (PARTITION BY a.recording_id, a.t, a.f ORDER BY b.mag DESC, b.t, b.f) <= 3)"""
)
WHASH = "(((greatest(fa - 1, 0) & 511) << 23) | ((greatest(fb - 1, 0) & 511) << 14) | greatest(1, least(tb - ta, 16383)))::BIGINT"
TRIPLES = (
    CAPPED
    + """, tg AS (SELECT a.recording_id, a.t AS ta, a.f AS fa, a.mag AS ma, b.t AS tb, b.f AS fb, b.mag AS mb
  FROM cp a JOIN cp b ON a.recording_id = b.recording_id AND b.t - a.t BETWEEN 1 AND 20 AND abs(b.f - a.f) < 7),
tr AS (SELECT x.*, y.tb AS tc, y.fb AS fc, y.mb AS mc FROM tg x JOIN tg y ON x.recording_id = y.recording_id AND x.ta = y.ta AND x.fa = y.fa AND (y.tb, y.fb) > (x.tb, x.fb)
  QUALIFY row_number() OVER (PARTITION BY x.recording_id, x.ta, x.fa ORDER BY (x.mb::FLOAT + y.mb::FLOAT)::FLOAT DESC, x.tb, x.fb, y.tb, y.fb) <= 3)"""
)
_BYTE = "((greatest(-127, least(127, {})) % 256) + 256) % 256"
PHASH = (
    "((((CASE WHEN fb >= fa THEN 1 ELSE 0 END) + (CASE WHEN fc >= fb THEN 2 ELSE 0 END))::BIGINT << 30)"
    " | ((CASE WHEN ma >= mb AND ma >= mc THEN 0 WHEN mb >= mc THEN 1 ELSE 2 END)::BIGINT << 28)"
    " | (greatest(0, least(31, floor((tc - tb)::DOUBLE / greatest(tc - ta, 1) * 31 + 0.5::DOUBLE)))::BIGINT << 23)"
    f" | (({_BYTE.format('fb - fa')})::BIGINT << 15) | (({_BYTE.format('fc - fb')})::BIGINT << 7))::BIGINT"
)

CODES = """codes AS (SELECT vec_id // 500 * 10 + label AS ref_id, row_number() OVER (PARTITION BY vec_id // 500 * 10 + label ORDER BY vec_id) - 1 AS pos,
  list_sum([CASE WHEN embedding[2 * b + 1] - embedding[2 * b + 2] > 0 THEN 1::BIGINT << (31 - b) ELSE 0 END FOR b IN range(32)])::BIGINT AS frame FROM embeddings),
cq AS (SELECT ref_id AS query_id, pos - 5 AS pos, xor(frame, CASE WHEN (pos - 5) % 3 = 0 THEN 128 ELSE 0 END)::BIGINT AS frame FROM codes WHERE pos BETWEEN 5 AND 36),
ql AS (SELECT query_id, count(*) AS q_len FROM cq GROUP BY 1), rl AS (SELECT ref_id, count(*) AS r_len FROM codes GROUP BY 1)"""
_OVER = "greatest(0, CASE WHEN d >= 0 THEN least(q_len, r_len - d) ELSE least(q_len + d, r_len) END)"
CAND = (
    CODES
    + f""", met AS (SELECT query_id, ref_id, r.pos - q.pos AS d, count(*) AS hits FROM cq q JOIN codes r USING (frame) GROUP BY ALL),
cand AS (SELECT query_id, ref_id, d, hits, q_len, r_len, {_OVER} AS ov FROM met JOIN ql USING (query_id) JOIN rl USING (ref_id)),
ok AS (SELECT * FROM cand WHERE ov >= 16)"""
)
_BER = """SELECT {k}.query_id, {k}.ref_id, d, ov, sum(bit_count(xor(q.frame, r.frame))::BIGINT)::BIGINT AS wrong
  FROM {k} JOIN cq q ON q.query_id = {k}.query_id JOIN codes r ON r.ref_id = {k}.ref_id AND r.pos = q.pos + d GROUP BY ALL"""
HINDEX = (
    CAND
    + ", top AS (SELECT *, row_number() OVER (PARTITION BY query_id, ref_id ORDER BY hits DESC, abs(d), d) AS r FROM ok QUALIFY r <= 8), rated AS ("
    + _BER.format(k="top").replace("d, ov,", "d, ov, top.r AS r,", 1)
    + """), best AS (SELECT *, wrong / (ov * 32)::DOUBLE AS ber FROM rated QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY wrong / (ov * 32)::DOUBLE, r) = 1),
m AS (SELECT query_id, ref_id, ber <= 0.35 AS is_match, greatest(0, least(1, 1 - ber)) AS score, ov::BIGINT AS votes, CASE WHEN ber > 1e-6 THEN 0.5 / ber ELSE 100 END AS prominence,
        d::BIGINT AS offset_frames, round(d * 1000 / 78.125::DOUBLE)::BIGINT AS offset_ms, 1::DOUBLE AS time_scale FROM best WHERE ber <= 0.35)"""
)
HMATCH = (
    CODES
    + f""", al AS (SELECT query_id, ref_id, q_len, r_len, d, {_OVER} AS ov FROM ql, rl, LATERAL (SELECT unnest(range(1 - q_len, r_len)) AS d) z),
rates AS ({_BER.format(k="al")}),
best AS (SELECT *, wrong / (ov * 32)::DOUBLE AS ber FROM rates WHERE ov >= 16 QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY wrong / (ov * 32)::DOUBLE, d) = 1),
oth AS (SELECT b.query_id, b.ref_id, list(r.wrong / (r.ov * 32)::DOUBLE ORDER BY r.wrong / (r.ov * 32)::DOUBLE) AS bs
  FROM best b JOIN ql ON ql.query_id = b.query_id JOIN rl ON rl.ref_id = b.ref_id JOIN rates r ON r.query_id = b.query_id AND r.ref_id = b.ref_id
  WHERE r.d <> b.d AND r.ov >= 32 AND (r.d - (1 - q_len)) % greatest((q_len + r_len) // 40, 1) = 0 GROUP BY ALL),
m AS (SELECT query_id, ref_id, ber <= 0.35 AND ov >= 16 AS is_match, greatest(0, least(1, 1 - ber)) AS score, ov::BIGINT AS votes,
        coalesce(bs[len(bs) // 2 + 1] / (ber + 1e-6::DOUBLE), 0) AS prominence, d::BIGINT AS offset_frames, round(d * 1000 / 78.125::DOUBLE)::BIGINT AS offset_ms, 1::DOUBLE AS time_scale
      FROM best LEFT JOIN oth USING (query_id, ref_id))"""
)

_LO, _HI = "CAST(CAST(0.8 AS FLOAT) AS DOUBLE)", "CAST(CAST(1.25 AS FLOAT) AS DOUBLE)"
PVOTES = (
    HASHES
    + STOP
    + f""", g AS (SELECT {_LO} AS lo, {_HI} AS hi, ({_HI} - {_LO}) / 24 AS w),
pv AS (SELECT query_id, ref_id, qi, q.t AS tq, k.t AS tr, (2 + k.hash % 4)::DOUBLE / greatest(2 + q.hash % 4, 1) AS s FROM q JOIN kept k USING (hash)),
v AS (SELECT query_id, ref_id, tq, tr, floor(least(greatest((s - lo) / w, 0), 23))::BIGINT AS s_bin, round(tr - s * tq)::BIGINT AS off
      FROM pv, g WHERE s BETWEEN lo - w * 0.5::DOUBLE AND hi + w * 0.5::DOUBLE)"""
)
PINDEX = (
    PVOTES
    + """, b AS (SELECT query_id, ref_id, s_bin, off, count(*) AS c FROM v GROUP BY ALL),
cons AS (SELECT a.query_id, a.ref_id, a.s_bin, a.off, sum(n.c) AS s FROM b a JOIN b n ON a.query_id = n.query_id AND a.ref_id = n.ref_id AND abs(a.s_bin - n.s_bin) <= 1 AND abs(a.off - n.off) <= 1 GROUP BY ALL),
tot AS (SELECT query_id, ref_id, sum(s) AS total, count(*) AS n FROM cons GROUP BY ALL),
best AS (SELECT * FROM cons QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY s DESC, s_bin, off) = 1),
ql AS (SELECT query_id, count(*) AS q_len FROM q GROUP BY 1),
m AS (SELECT query_id, ref_id, TRUE AS is_match, least(1, s::DOUBLE / q_len) AS score, s::BIGINT AS votes, s / ((total - s)::DOUBLE / greatest(n - 1, 1) + 1) AS prominence, off AS offset_frames,
        round(off * 1000 / 62.5::DOUBLE)::BIGINT AS offset_ms, greatest(0.5, least(2, 1 / (lo + (s_bin + 0.5::DOUBLE) * w))) AS time_scale
      FROM best JOIN tot USING (query_id, ref_id) JOIN ql USING (query_id), g WHERE s >= 5 AND s / ((total - s)::DOUBLE / greatest(n - 1, 1) + 1) >= 5 AND s::DOUBLE / q_len >= 0.15)"""
)
# lines through two votes, their inliers, and the refined result of pairs with a coarse peak
PMATCH = (
    PVOTES.replace(STOP, """, few AS (SELECT ref_id, hash FROM r GROUP BY ALL HAVING count(*) <= 100), kept AS (SELECT r.* FROM r SEMI JOIN few USING (ref_id, hash))""")
    + PINDEX[len(PVOTES) : PINDEX.index("m AS (")]
    + """pk AS (SELECT query_id, ref_id, s, s_bin, off, q_len, s / ((total - s)::DOUBLE / greatest(n - 1, 1) + 1) AS prominence FROM best JOIN tot USING (query_id, ref_id) JOIN ql USING (query_id)
  WHERE s >= 5 AND s / ((total - s)::DOUBLE / greatest(n - 1, 1) + 1) >= 5),
nv AS (SELECT query_id, ref_id, tq, tr, row_number() OVER (PARTITION BY query_id, ref_id ORDER BY qi, tr, tq) - 1 AS k, count(*) OVER (PARTITION BY query_id, ref_id) AS n
       FROM (SELECT query_id, ref_id, qi, tq, tr FROM pv, g WHERE s BETWEEN lo - w * 0.5::DOUBLE AND hi + w * 0.5::DOUBLE) SEMI JOIN pk USING (query_id, ref_id)),
ln AS (SELECT *, a_tr - scale * a_tq AS shift FROM (
         SELECT a.query_id, a.ref_id, a.k AS i, b.k AS j, a.tq AS a_tq, a.tr AS a_tr, (b.tr - a.tr)::DOUBLE / nullif(b.tq - a.tq, 0) AS scale
         FROM nv a JOIN nv b ON a.query_id = b.query_id AND a.ref_id = b.ref_id AND b.k > a.k AND (a.n * (a.n - 1) / 2 <= 512 OR bit_count(b.k - a.k) = 1)), g WHERE scale BETWEEN lo AND hi),
rt AS (SELECT query_id, ref_id, i, j, scale, shift, count(*) AS inliers, round(avg(abs(tr - (scale * tq + shift))), 9) AS mean FROM ln JOIN nv USING (query_id, ref_id) WHERE abs(tr - (scale * tq + shift)) <= 2 GROUP BY ALL),
fit AS (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY inliers DESC, mean, i, j) = 1),
re AS (SELECT query_id, ref_id, q_len, prominence, coalesce(inliers, s) AS votes, coalesce(scale, lo + (s_bin + 0.5::DOUBLE) * w) AS scale, round(coalesce(shift, off))::BIGINT AS off FROM pk LEFT JOIN fit USING (query_id, ref_id), g),
m AS (SELECT query_id, ref_id, TRUE AS is_match, least(1, votes::DOUBLE / q_len) AS score, votes::BIGINT AS votes, prominence, off AS offset_frames, round(off * 1000 / 62.5::DOUBLE)::BIGINT AS offset_ms,
        CASE WHEN abs(scale) > 1e-6 THEN greatest(0.5, least(2, 1 / scale)) ELSE 1 END AS time_scale FROM re WHERE votes >= 5 AND votes::DOUBLE / q_len >= 0.15)"""
)
DENSE = (
    HASHES
    + """, few AS (SELECT ref_id, hash FROM r GROUP BY ALL HAVING count(*) <= 100), kept AS (SELECT r.* FROM r SEMI JOIN few USING (ref_id, hash)),
v AS (SELECT query_id, ref_id, qi, k.t - q.t AS d FROM q JOIN kept k USING (hash)),
lq AS (SELECT query_id, -max(t) AS lo, count(*) AS n FROM q GROUP BY 1), lr AS (SELECT ref_id, max(t) AS hi FROM r GROUP BY 1),
cnt AS (SELECT query_id, ref_id, d, count(*) AS c FROM v GROUP BY ALL),
sp AS (SELECT query_id, ref_id, lo, hi, n, d + e AS d, sum(c) AS cons FROM cnt JOIN lq USING (query_id) JOIN lr USING (ref_id), range(-1, 2) g(e) WHERE d + e BETWEEN lo AND hi GROUP BY ALL),
pk AS (SELECT query_id, ref_id, max(cons) AS votes, sum(cons) AS total FROM sp GROUP BY ALL),
ends AS (SELECT query_id, ref_id, lo, hi, n, votes, total, min(d - lo) FILTER (cons = votes) AS a, max(d - lo) FILTER (cons = votes) AS z FROM sp JOIN pk USING (query_id, ref_id) GROUP BY ALL),
mid AS (SELECT *, (a + z) // 2 + lo AS best FROM ends),
bv AS (SELECT mid.*, coalesce(sp.cons, 0) AS x FROM mid LEFT JOIN sp ON sp.query_id = mid.query_id AND sp.ref_id = mid.ref_id AND sp.d = mid.best),
best AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE x / ((total - x)::DOUBLE / greatest(hi - lo, 1) + 1) END AS prominence FROM bv),
hit AS (SELECT v.query_id, v.ref_id, count(DISTINCT qi) AS hits FROM v JOIN best USING (query_id, ref_id) WHERE abs(d - best) <= 1 GROUP BY ALL),
m AS (SELECT query_id, ref_id, TRUE AS is_match, least(1, hits::DOUBLE / n) AS score, votes::BIGINT AS votes, prominence, best::BIGINT AS offset_frames,
        round(best * 1000 / 62.5::DOUBLE)::BIGINT AS offset_ms, 1::DOUBLE AS time_scale FROM best JOIN hit USING (query_id, ref_id) WHERE votes >= 5 AND prominence >= 5 AND hits::DOUBLE / n >= 0.15)"""
)
SEQ = """s AS (SELECT vec_id // 500 * 10 + label AS ref_id, row_number() OVER (PARTITION BY vec_id // 500 * 10 + label ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS vector FROM embeddings),
eq AS (SELECT ref_id AS query_id, idx - 3 AS idx, vector FROM s WHERE idx BETWEEN 3 AND 10)"""
GLOBAL = (
    SEQ
    + """, comp AS (SELECT 'r' AS side, ref_id AS id, k, avg(vector[k + 1]) AS x, count(*) AS n FROM s, range(64) g(k) GROUP BY ALL
  UNION ALL SELECT 'q', query_id, k, avg(vector[k + 1]), count(*) FROM eq, range(64) g(k) GROUP BY ALL),
nm AS (SELECT side, id, sqrt(sum(x * x)) AS norm, max(n) AS n FROM comp GROUP BY ALL),
cos AS (SELECT a.id AS query_id, b.id AS ref_id, sum(a.x * b.x) AS dot FROM comp a JOIN comp b USING (k) WHERE a.side = 'q' AND b.side = 'r' GROUP BY ALL),
m AS (SELECT query_id, ref_id, dot / (q.norm * r.norm) >= 0.8 AS is_match, greatest(0, least(1, dot / (q.norm * r.norm))) AS score, least(q.n, r.n)::BIGINT AS votes, 1::DOUBLE AS prominence, 0::BIGINT AS offset_frames, 0::BIGINT AS offset_ms, 1::DOUBLE AS time_scale
      FROM cos JOIN nm q ON q.side = 'q' AND q.id = query_id JOIN nm r ON r.side = 'r' AND r.id = ref_id)"""
)
SLIDING = (
    SEQ
    + """, rl AS (SELECT ref_id, count(*) AS n FROM s GROUP BY 1),
lag AS (SELECT e.query_id, s.ref_id, s.idx - e.idx AS lag, sum(list_dot_product(e.vector, s.vector)) / 8 AS mean FROM eq e, s JOIN rl USING (ref_id) WHERE s.idx - e.idx BETWEEN 0 AND n - 8 GROUP BY ALL),
b AS (SELECT query_id, ref_id, max(mean) AS c, sum(mean) AS total, count(*) AS n, arg_min(lag, (-mean, lag)) AS lag FROM lag GROUP BY ALL),
m AS (SELECT query_id, ref_id, c >= 0.8 AS is_match, greatest(0, least(1, c)) AS score, 8::BIGINT AS votes, CASE WHEN n > 1 THEN (c + 1) / ((total - c) / (n - 1) + 1) ELSE 1 END AS prominence, lag::BIGINT AS offset_frames, (lag * 1000)::BIGINT AS offset_ms, 1::DOUBLE AS time_scale FROM b)"""
)
# cells of the diagonal 'turn' and the one before it; a cell goes on to its three neighbours, and itself for one more turn
DTW = (
    SEQ.replace("s AS (", "RECURSIVE s AS (", 1)
    + """, len AS (SELECT query_id, ref_id, m, n FROM (SELECT query_id, count(*) AS m FROM eq GROUP BY 1), (SELECT ref_id, count(*) AS n FROM s GROUP BY 1)),
cell AS (SELECT e.query_id, s.ref_id, e.idx + 1 AS i, s.idx + 1 AS j, 1 - list_dot_product(e.vector, s.vector) AS c FROM eq e, s),
dp AS (
  SELECT query_id, ref_id, 2::BIGINT AS turn, i, j, c AS v FROM cell WHERE i = 1 AND j = 1
  UNION ALL
  SELECT query_id, ref_id, turn, i, j, min(v) + max(c) AS v FROM (
    SELECT dp.query_id, dp.ref_id, turn + 1 AS turn, cell.i, cell.j, v, CASE WHEN cell.i = dp.i AND cell.j = dp.j THEN 0 ELSE c END AS c
    FROM dp, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) step(a, b), cell
    WHERE cell.query_id = dp.query_id AND cell.ref_id = dp.ref_id AND cell.i = dp.i + a AND cell.j = dp.j + b
      AND CASE WHEN a + b = 0 THEN dp.i + dp.j = turn ELSE dp.i + dp.j + a + b = turn + 1 END)
  GROUP BY ALL),
m AS (SELECT query_id, ref_id, 1 - v / greatest(m, n) >= 0.8 AS is_match, greatest(0, least(1, 1 - v / greatest(m, n))) AS score, least(m, n)::BIGINT AS votes, 1::DOUBLE AS prominence, 0::BIGINT AS offset_frames, 0::BIGINT AS offset_ms, m::DOUBLE / n AS time_scale
      FROM dp JOIN len USING (query_id, ref_id) WHERE turn = m + n AND i = m AND j = n)"""
)
BANDS = """e AS (SELECT 200 * power(3900 / 200::DOUBLE, b / 4::DOUBLE) AS lo, 200 * power(3900 / 200::DOUBLE, (b + 1) / 4::DOUBLE) AS hi, b AS band FROM range(4) g(b)),
bands AS (SELECT f, band FROM range(9) g(f) JOIN e ON f * 500 >= lo AND f * 500 < hi)"""


def _window(kind: str) -> str:
    x = "2 * pi() * k / n"
    v = {"hann": f"0.5::DOUBLE - 0.5::DOUBLE * cos({x})", "hamming": f"0.54::DOUBLE - 0.46::DOUBLE * cos({x})", "blackman": f"0.42::DOUBLE - 0.5::DOUBLE * cos({x}) + 0.08::DOUBLE * cos(4 * pi() * k / n)"}[kind]
    return f"SELECT s_suppkey, k, round({v}, 9) + 0::DOUBLE AS w FROM (SELECT s_suppkey, s_suppkey % 61 + 4 AS n, unnest(range(s_suppkey % 61 + 4)) AS k FROM supplier)"  # no negative zero


def _mel_rates(scale: str, rates: str) -> str:
    """edge and w: edges and weights of 6 filters over 16 points for the rates (key, rate) of a query."""
    to = {"slaney": "CASE WHEN {0} < 1000 THEN {0} * 3 / 200 ELSE 15 + ln({0} / 1000) / 0.06875197::DOUBLE END", "htk": "2595 * log10(1 + {0} / 700)"}[scale]
    back = {"slaney": "CASE WHEN {0} < 15 THEN {0} * 200 / 3 ELSE 1000 * exp(0.06875197::DOUBLE * ({0} - 15)) END", "htk": "700 * (power(10, {0} / 2595) - 1)"}[scale]
    top = to.format("(rate / 2::DOUBLE)")
    return (
        f"edge AS (SELECT key, rate / 16::DOUBLE AS step, k, {back.format(f'(({top}) * k / 7::DOUBLE)')} AS hz FROM ({rates}), range(8) g(k)), "
        "w AS (SELECT key, mel, f, CASE WHEN hz <= b THEN (hz - a) / (b - a) ELSE (c - hz) / (c - b) END * 2 / (c - a) AS weight "
        "FROM (SELECT a.key, a.k AS mel, f, f * a.step AS hz, a.hz AS a, b.hz AS b, c.hz AS c FROM edge a JOIN edge b ON b.key = a.key AND b.k = a.k + 1 JOIN edge c ON c.key = a.key AND c.k = a.k + 2, range(9) g(f)) WHERE hz > a AND hz < c)"
    )


def _mel_table(scale: str) -> str:
    return _mel_rates(scale, "SELECT 0 AS key, 8000 AS rate")


def _mel_query(scale: str) -> str:
    rates = _mel_rates(scale, "SELECT s_suppkey AS key, 8000 + 500 * (s_suppkey % 17) AS rate FROM supplier")
    return f"WITH {rates} SELECT key, mel, f, round(weight, 9) AS weight FROM w"


# Bessel's function by its series; Kaiser-windowed sinc of each fractional step that occurs, its sum at step 0 being 1
_I0 = "list_sum([power({0} * {0} / 4, m) / (gamma(m + 1) * gamma(m + 1)) FOR m IN range(40)])"
RESAMPLE = (
    SAMPLES
    + f""", o AS (SELECT n.track, n, i AS k, i * (8000 / 5000::DOUBLE) AS pos FROM n, range(0, (n * 5000 + 7999) // 8000) g(i)),
p AS (SELECT *, floor(pos)::BIGINT AS i, least(floor((pos - floor(pos)) * 256), 255)::BIGINT AS step FROM o),
taps AS (SELECT step, j, j - step / 256::DOUBLE AS place FROM (SELECT DISTINCT step FROM p UNION SELECT 0), range(-32, 33) g(j)),
raw AS (SELECT step, j, CASE WHEN place = 0 THEN 1 ELSE sin(pi() * 0.625::DOUBLE * place) / (pi() * 0.625::DOUBLE * place) END * CASE WHEN abs(place) <= 32 THEN {_I0.format("(8.6::DOUBLE * sqrt(greatest(0, 1 - (place / 32) * (place / 32))))")} ELSE 0 END AS h FROM taps),
kern AS (SELECT step, j, h / (SELECT sum(h) FROM raw WHERE step = 0) AS h FROM raw)
SELECT p.track::VARCHAR AS recording_id, k, round(sum(v::FLOAT::DOUBLE * h)::FLOAT::DOUBLE, 4) + 0::DOUBLE AS v FROM p JOIN kern USING (step) JOIN x ON x.track = p.track AND x.t = p.i + j GROUP BY ALL"""
)


ORACLES: dict[str, str] = {
    "window_hann": _window("hann"),
    "window_hamming": _window("hamming"),
    "window_blackman": _window("blackman"),
    "stft_power": f"WITH {DFT} SELECT recording_id, t, f, round(v, 3) AS v FROM p",
    "stft_magnitude": f"WITH {DFT} SELECT recording_id, t, f, round(sqrt(v), 3) AS v FROM p",
    "stft_db": f"WITH {DB} SELECT recording_id, t, f, v FROM db",
    "resample_linear": f"WITH {SAMPLES}, o AS (SELECT n.track, i AS k, i * (8000 / 5000::DOUBLE) AS pos, n.n FROM n, LATERAL (SELECT unnest(range(0, (n.n * 5000 + 7999) // 8000)) AS i) z) "
    "SELECT o.track::VARCHAR AS recording_id, k, round(a.v * (1 - (pos - floor(pos))) + b.v * (pos - floor(pos)), 6) AS v FROM o JOIN x a ON a.track = o.track AND a.t = least(floor(pos), n - 1) JOIN x b ON b.track = o.track AND b.t = least(floor(pos) + 1, n - 1)",
    "mel_filterbank": _mel_query("slaney"),
    "mel_filterbank_htk": _mel_query("htk"),
    "resample_sinc": f"WITH {RESAMPLE}",
    "log_mel": f"WITH {DFT}, {_mel_table('slaney')} SELECT recording_id, t, mel, round(log10(sum(v * weight) + 1e-10::DOUBLE), 6) AS v FROM p JOIN w USING (f) GROUP BY ALL",
    "rolling_max_2d": f"WITH {MAX2D} SELECT * FROM mx",
    "peak_pick": f"WITH {PEAKS} SELECT * FROM pk",
    "peak_cap_per_second": f"WITH {CAPPED} SELECT * FROM cp",
    "wang_pairs": f"WITH {PAIRS} SELECT * FROM pr",
    "wang_hash": f"WITH {PAIRS} SELECT recording_id, {WHASH} AS hash, ta AS t_anchor FROM pr",
    "panako_triplets": f"WITH {TRIPLES} SELECT recording_id, ta, fa, ma, tb, fb, mb, tc, fc, mc FROM tr",
    "panako_hash": f"WITH {TRIPLES} SELECT recording_id, {PHASH} AS hash, ta AS t_anchor, tb AS t_b, tc AS t_c FROM tr",
    "haitsma_bands": f"WITH {DFT}, {BANDS} SELECT recording_id, t, band, round(sum(v), 3) AS e FROM p JOIN bands USING (f) GROUP BY ALL",
    "haitsma_frames": f"WITH {DFT}, {BANDS}, be AS (SELECT recording_id, t, b AS band, sum(CASE WHEN bands.band = b THEN v ELSE 0 END) AS e FROM p JOIN range(4) g(b) ON TRUE LEFT JOIN bands USING (f) GROUP BY ALL), "
    "df AS (SELECT a.recording_id, a.t, a.band AS b, a.e - c.e AS d FROM be a JOIN be c ON a.recording_id = c.recording_id AND a.t = c.t AND c.band = a.band + 1), "
    "pv AS (SELECT *, lag(d) OVER (PARTITION BY recording_id, b ORDER BY t) AS p FROM df) "
    "SELECT recording_id, t - 1 AS pos, sum(CASE WHEN d - p > 0 THEN 1::BIGINT << (2 - b) ELSE 0 END)::BIGINT AS frame FROM pv WHERE p IS NOT NULL GROUP BY ALL",
    "stop_hash": f"WITH {HASHES}{STOP} SELECT ref_id, t, hash FROM kept",
    "wang_votes": f"WITH {HASHES}{STOP} SELECT query_id, ref_id, k.t - q.t AS delta, count(*) AS c FROM q JOIN kept k USING (hash) GROUP BY ALL",
    "wang_match_dense": f"WITH {DENSE} SELECT {_OUT} FROM m",
    "wang_index_query": f"WITH {WANG_INDEX} SELECT {_OUT} FROM m",
    "stored_index_query": f"WITH {WANG_INDEX} SELECT {_OUT} FROM m",
    "match_ranked": f"WITH {DENSE}, pairs AS (SELECT * FROM (SELECT DISTINCT query_id FROM q WHERE query_id % 5 = 0), (SELECT DISTINCT ref_id FROM r)), every AS ("
    "SELECT query_id, ref_id, coalesce(is_match, false) AS is_match, coalesce(score, 0::DOUBLE) AS score, coalesce(votes, 0::BIGINT) AS votes, coalesce(prominence, 0::DOUBLE) AS prominence, "
    "coalesce(offset_frames, 0::BIGINT) AS offset_frames, coalesce(offset_ms, 0::BIGINT) AS offset_ms, coalesce(time_scale, 1::DOUBLE) AS time_scale FROM pairs LEFT JOIN m USING (query_id, ref_id)) "
    f"SELECT {_OUT}, row_number() OVER (PARTITION BY query_id ORDER BY every.score DESC, every.prominence DESC, ref_id) AS rank FROM every",
    "match_best": f"WITH {WANG_INDEX} SELECT {_OUT} FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m.score DESC, m.prominence DESC, ref_id) = 1",
    "haitsma_candidates": f"WITH {CAND} SELECT query_id, ref_id, d AS delta, hits, ov::BIGINT AS overlap FROM ok",
    "haitsma_ber": f"WITH {CAND}, rated AS ({_BER.format(k='ok')}) SELECT query_id, ref_id, d AS delta, ov::BIGINT AS overlap, wrong FROM rated",
    "haitsma_probe_flips": f"WITH {CODES}, mask AS (SELECT 0::BIGINT AS m UNION ALL SELECT 1::BIGINT << i FROM range(32) g(i)), "
    "met AS (SELECT query_id, ref_id, r.pos - q.pos AS d, count(*) AS hits FROM cq q, mask JOIN codes r ON r.frame = xor(q.frame, m) GROUP BY ALL) "
    f"SELECT query_id, ref_id, d AS delta, hits FROM met JOIN ql USING (query_id) JOIN rl USING (ref_id) WHERE {_OVER} >= 16",
    "haitsma_index_query": f"WITH {HINDEX} SELECT {_OUT} FROM m",
    "haitsma_match": f"WITH {HMATCH} SELECT {_OUT} FROM m",
    "panako_votes": f"WITH {PVOTES} SELECT query_id, ref_id, s_bin, off, count(*) AS c FROM v GROUP BY ALL",
    "panako_index_query": f"WITH {PINDEX} SELECT {_OUT} FROM m",
    "panako_match": f"WITH {PMATCH} SELECT {_OUT} FROM m",
    "neural_dtw": f"WITH {DTW} SELECT {_OUT} FROM m",
    "neural_dtw_matches": f"WITH {DTW.replace('>= 0.8 AS', '>= 0.15 AS')} SELECT {_OUT} FROM m WHERE is_match",
    "neural_global": f"WITH {GLOBAL} SELECT {_OUT} FROM m",
    "neural_sliding": f"WITH {SLIDING} SELECT {_OUT} FROM m",
    "l2_normalize": "SELECT vec_id, k, round(embedding[k + 1]::DOUBLE / sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 9) AS x FROM embeddings, range(64) g(k)",
    "centroid": f"WITH {SEQ}, c AS (SELECT ref_id, k, avg(vector[k + 1]) AS x FROM s, range(64) g(k) GROUP BY ALL), n AS (SELECT ref_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1) SELECT ref_id, k, round(x / n, 6) AS x FROM c JOIN n USING (ref_id)",
    "jaccard": f"WITH {HASHES}, u AS (SELECT DISTINCT ref_id, hash FROM r), n AS (SELECT ref_id, count(*) AS n FROM u GROUP BY 1), i AS (SELECT a.ref_id AS a, b.ref_id AS b, count(*) AS i FROM u a JOIN u b USING (hash) GROUP BY ALL) "
    "SELECT x.ref_id AS a, y.ref_id AS b, round(coalesce(i, 0)::DOUBLE / (x.n + y.n - coalesce(i, 0)), 9) AS jaccard FROM n x JOIN n y ON x.ref_id < y.ref_id LEFT JOIN i ON i.a = x.ref_id AND i.b = y.ref_id",
    "bit_similarity": f"WITH {CODES}, n AS (SELECT a.ref_id AS a, b.ref_id AS b, least(a.r_len, b.r_len) AS n FROM rl a JOIN rl b ON a.ref_id < b.ref_id) "
    "SELECT a, b, round(1 - sum(bit_count(xor(x.frame, y.frame))::BIGINT)::DOUBLE / (32 * n), 9) AS similarity FROM n JOIN codes x ON x.ref_id = a JOIN codes y ON y.ref_id = b AND y.pos = x.pos GROUP BY a, b, n",
    "fps_compat": "SELECT a.s_suppkey AS a, b.s_suppkey AS b, (62.5::DOUBLE + a.s_suppkey * 0.01::DOUBLE) > 0 AND abs(a.s_suppkey - b.s_suppkey) * 0.01::DOUBLE / greatest(62.5::DOUBLE + a.s_suppkey * 0.01::DOUBLE, 62.5::DOUBLE + b.s_suppkey * 0.01::DOUBLE) <= 1e-3 AS ok FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + a.s_nationkey",
    "sanitize_pcm": f"WITH {TRACKS} SELECT track::VARCHAR AS recording_id, t, CASE WHEN t % 7 IN (0, 3) THEN 0 ELSE value END AS v FROM tracks",
    "downmix": f"WITH {TRACKS} SELECT track::VARCHAR AS recording_id, t // 2 AS t, round(avg(value), 9) AS v FROM tracks JOIN (SELECT track AS k, count(*) AS n FROM tracks GROUP BY 1) ON k = track WHERE t // 2 < n // 2 GROUP BY ALL",
    "envelope": f"WITH {HASHES} SELECT ref_id, 'wang-v1' AS algorithm, 8000::INTEGER AS sample_rate, 62.5::DOUBLE AS frames_per_sec, count(*) AS hash_count FROM r GROUP BY ref_id",
    "overlap": f"WITH {CODES}, al AS (SELECT query_id, ref_id, q_len, r_len, unnest(range(1 - q_len, r_len)) AS d FROM ql, rl) SELECT query_id, ref_id, d AS delta, ({_OVER})::BIGINT AS overlap FROM al",
    "time_offset": f"WITH {HASHES} SELECT ref_id, t, round((t - 500) * 1000 / 78.125::DOUBLE)::BIGINT AS ms FROM r",
}
