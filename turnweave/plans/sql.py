"""DuckDB SQL of the projections and of the queries over them."""

from __future__ import annotations

from ..functions.text import BACKCHANNELS
from ..operators.reports import COMMON
from ..sources.media import MEDIA
from ..sources.projections import MEETING_VECTORS

_IN = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"

CENTS = """cents AS (
  SELECT conv_id AS recording, turn AS turn_idx, role AS speaker, text, CAST(length(text) * 6 AS BIGINT) AS len,
         CAST(sum(length(text) * 6) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e
  FROM conversations
), conv AS (SELECT *, e - len AS s FROM cents)"""
#: The same with every third turn in the words of the turn before it.
ECHOES = CENTS.replace("SELECT *, e - len", "SELECT * REPLACE (CASE WHEN turn_idx % 3 = 1 THEN coalesce(lag(text) OVER (PARTITION BY recording ORDER BY turn_idx), text) ELSE text END AS text), e - len")
TURNS_A = CENTS + """, turns_a AS (
  SELECT recording, turn_idx, speaker, CAST(s AS DOUBLE) / CAST(100 AS DOUBLE) AS start, CAST(e AS DOUBLE) / CAST(100 AS DOUBLE) AS "end", text,
         CAST((recording * 31 + turn_idx * 17) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence FROM conv
)"""
TURNS_B = TURNS_A + """, b0 AS (
  SELECT *, lead(turn_idx, 2) OVER w AS nt, lead(speaker, 2) OVER w AS ns, lead(e, 2) OVER w AS ne, lead(text, 2) OVER w AS nx, recording + turn_idx AS place
  FROM conv WINDOW w AS (PARTITION BY recording ORDER BY turn_idx)
), b1 AS (SELECT *, coalesce(place % 4 = 0 AND nt = turn_idx + 2 AND ns = speaker, false) AS spans FROM b0),
b2 AS (SELECT recording, turn_idx, speaker, place, s, CASE WHEN spans THEN ne ELSE e END AS e, CASE WHEN spans THEN text || ' ' || nx ELSE text END AS text FROM b1),
b3 AS (SELECT recording, turn_idx, speaker, s, CASE WHEN place % 9 = 0 THEN e + 3 * (e - s) ELSE e END AS e, text FROM b2 WHERE place % 7 <> 0),
b4 AS (
  SELECT recording, turn_idx, speaker, CAST(s AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(-0.9 AS DOUBLE) AS start, CAST(e AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(-0.9 AS DOUBLE) AS "end", text,
         CAST((recording * 13 + turn_idx * 29) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence FROM b3
), turns_b AS (SELECT recording, turn_idx, speaker, greatest(start, CAST(0 AS DOUBLE)) AS start, "end", text, confidence FROM b4 WHERE "end" > 0)"""
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"
MERGE = TURNS_B + """, edges AS (
  SELECT a.recording, a.speaker, a.turn_idx AS a_idx, b.turn_idx AS b_idx, a.confidence AS a_conf, b.confidence AS b_conf,
         least(a."end", b."end") - greatest(a.start, b.start) AS overlap
  FROM turns_a a JOIN turns_b b ON a.recording = b.recording AND a.speaker = b.speaker
  WHERE least(a."end", b."end") - greatest(a.start, b.start) > 0
), lists AS (
  SELECT recording, speaker, a_idx, list(b_idx ORDER BY b_conf DESC, b_idx) AS cands, row_number() OVER (PARTITION BY recording, speaker ORDER BY a_idx) AS rn
  FROM edges WHERE b_conf > a_conf GROUP BY recording, speaker, a_idx
), steps AS (
  SELECT DISTINCT recording, speaker, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a_idx, CAST(NULL AS BIGINT) AS b_idx FROM lists
  UNION ALL
  SELECT recording, speaker, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, a_idx, pick
  FROM (SELECT l.recording, l.speaker, l.rn, s.used, l.a_idx, list_filter(l.cands, lambda b: NOT list_contains(s.used, b))[1] AS pick
        FROM steps s JOIN lists l ON l.recording = s.recording AND l.speaker = s.speaker AND l.rn = s.rn + 1)
), picks AS (SELECT recording, a_idx, b_idx FROM steps WHERE b_idx IS NOT NULL),
fires AS (
  SELECT p.recording, s.turn_idx, abs(s.turn_idx - p.a_idx) AS step, s.speaker = i.speaker AS same, length(""" + NORM.format("s.text") + """) AS n
  FROM picks p JOIN turns_a i ON i.recording = p.recording AND i.turn_idx = p.a_idx
  JOIN turns_b b ON b.recording = p.recording AND b.turn_idx = p.b_idx
  JOIN turns_a s ON s.recording = p.recording AND s.turn_idx <> p.a_idx AND abs(s.turn_idx - p.a_idx) <= 4
  WHERE NOT EXISTS (SELECT 1 FROM picks q WHERE q.recording = s.recording AND q.a_idx = s.turn_idx)
    AND least(s."end", b."end") - greatest(s.start, b.start) > 0
    AND greatest(s.start - i."end", i.start - s."end", 0) <= 15
    AND contains(""" + NORM.format("b.text") + ", " + NORM.format("s.text") + """)
), consumed AS (SELECT DISTINCT recording, turn_idx FROM fires WHERE same AND step <= 2 AND n >= 20),
coverage AS (SELECT recording, b_idx, sum(overlap ORDER BY a_idx) AS total FROM edges GROUP BY recording, b_idx),
fill AS (
  SELECT b.* FROM turns_b b LEFT JOIN coverage c ON c.recording = b.recording AND c.b_idx = b.turn_idx
  WHERE CASE WHEN b."end" - b.start > 0 THEN coalesce(c.total, 0) / (b."end" - b.start) WHEN coalesce(c.total, 0) > 0 THEN 1 ELSE 0 END < 0.5
), emitted AS (
  SELECT a.recording, a.speaker, coalesce(b.start, a.start) AS start, coalesce(b."end", a."end") AS "end", coalesce(b.text, a.text) AS text,
         coalesce(b.confidence, a.confidence) AS confidence, CASE WHEN p.b_idx IS NULL THEN 'a_kept' ELSE 'a_replaced' END AS origin, 0 AS side, a.turn_idx AS at_idx
  FROM turns_a a LEFT JOIN picks p ON p.recording = a.recording AND p.a_idx = a.turn_idx
  LEFT JOIN turns_b b ON b.recording = p.recording AND b.turn_idx = p.b_idx
  WHERE NOT EXISTS (SELECT 1 FROM consumed c WHERE c.recording = a.recording AND c.turn_idx = a.turn_idx)
  UNION ALL
  SELECT recording, speaker, start, "end", text, confidence, 'b_gapfill', 1, turn_idx FROM fill
), merged AS (
  SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY start, side, at_idx) - 1 AS turn_idx, speaker, start, "end", text, confidence, origin FROM emitted
)"""
STAMP = """CASE WHEN greatest(trunc({0}), 0) >= 3600
  THEN printf('%02d:%02d:%02d', CAST(greatest(trunc({0}), 0) AS BIGINT) // 3600, CAST(greatest(trunc({0}), 0) AS BIGINT) // 60 % 60, CAST(greatest(trunc({0}), 0) AS BIGINT) % 60)
  ELSE printf('%02d:%02d', CAST(greatest(trunc({0}), 0) AS BIGINT) // 60, CAST(greatest(trunc({0}), 0) AS BIGINT) % 60) END"""
LABELLED = TURNS_A + """, firsts AS (SELECT *, min(turn_idx) OVER (PARTITION BY recording, speaker) AS f FROM turns_a),
labelled AS (SELECT recording, turn_idx, 'Person ' || dense_rank() OVER (PARTITION BY recording ORDER BY f) AS speaker, start, "end", text, confidence FROM firsts)"""
WORDS = TURNS_A + """, w0 AS (SELECT recording, turn_idx, s, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conv),
w1 AS (SELECT recording, turn_idx, s, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM w0),
w2 AS (SELECT recording, word, s + 6 * (sum(length(word) + 1) OVER (PARTITION BY recording, turn_idx ORDER BY pos) - length(word) - 1) AS s,
              row_number() OVER (PARTITION BY recording ORDER BY turn_idx, pos) - 1 AS word_idx FROM w1),
words AS (SELECT recording, word_idx, word, CAST(s AS DOUBLE) / CAST(100 AS DOUBLE) AS start,
                 CAST(CASE WHEN word_idx % 13 = 0 THEN s ELSE s + 6 * length(word) END AS DOUBLE) / CAST(100 AS DOUBLE) AS "end" FROM w2)"""
ALIGN = WORDS + """, dturns AS (
  SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY s, turn_idx) - 1 AS dturn_idx, CAST(s + 33 AS DOUBLE) / CAST(100 AS DOUBLE) AS start,
         CAST(e + 33 AS DOUBLE) / CAST(100 AS DOUBLE) AS "end", speaker FROM conv WHERE turn_idx % 5 <> 4
), pairs AS (
  SELECT w.recording, w.word_idx, t.dturn_idx, t.speaker, greatest(0, least(w."end", t."end") - greatest(w.start, t.start)) AS overlap,
         least(abs(w.start - t."end"), abs(t.start - w."end")) AS distance
  FROM words w JOIN dturns t ON w.recording = t.recording
), best AS (
  SELECT *, row_number() OVER (PARTITION BY recording, word_idx ORDER BY overlap DESC, dturn_idx) AS by_overlap,
         row_number() OVER (PARTITION BY recording, word_idx ORDER BY distance, dturn_idx) AS by_distance,
         max(overlap) OVER (PARTITION BY recording, word_idx) AS most FROM pairs
)"""
EVENTS = """ew AS (
  SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS turn_idx, event_type AS speaker, event_id, value / CAST(500 AS DOUBLE) AS probability FROM events
), et AS (
  SELECT recording, turn_idx, speaker, CAST(turn_idx AS DOUBLE) AS start, CAST(turn_idx AS DOUBLE) + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS "end", speaker AS text, probability AS confidence FROM ew
)"""
RUNS = EVENTS + """, r0 AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY recording ORDER BY turn_idx) THEN 0 ELSE 1 END AS fresh FROM et),
r1 AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY turn_idx) AS run FROM r0),
runs AS (SELECT recording, run, min(speaker) AS token, count(*) AS n, min(start) AS start, max(start) AS "end", min(turn_idx) AS first_turn FROM r1 GROUP BY recording, run)"""
ACKNOWLEDGED = """et2 AS (SELECT * REPLACE (CASE WHEN turn_idx % 5 = 2 THEN 'Yeah.' ELSE text END AS text) FROM et),
around AS (SELECT *, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after, lag(text) OVER w AS said_before, lead(text) OVER w AS said_after FROM et2 WINDOW w AS (PARTITION BY recording ORDER BY turn_idx)),
sandwiched AS (SELECT *, "end" <> start AS lasts, text = 'Yeah.' AS listed FROM around WHERE before = after AND before <> speaker)"""
SMOOTH = EVENTS + """, m0 AS (
  SELECT *, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after FROM et WINDOW w AS (PARTITION BY recording ORDER BY turn_idx)
), m1 AS (
  SELECT *, coalesce(before = after AND before <> speaker AND "end" - start = 0 AND text NOT IN """ + _IN(BACKCHANNELS) + """, false) AS eligible FROM m0
), m2 AS (SELECT *, CASE WHEN eligible = lag(eligible) OVER (PARTITION BY recording ORDER BY turn_idx) THEN 0 ELSE 1 END AS fresh FROM m1),
m3 AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY turn_idx) AS run FROM m2),
m4 AS (SELECT *, eligible AND row_number() OVER (PARTITION BY recording, run ORDER BY turn_idx) % 2 = 1 AS absorbed FROM m3),
m5 AS (SELECT *, CASE WHEN absorbed OR coalesce(lag(absorbed) OVER (PARTITION BY recording ORDER BY turn_idx), false) THEN 0 ELSE 1 END AS opens FROM m4),
m6 AS (SELECT *, sum(opens) OVER (PARTITION BY recording ORDER BY turn_idx) - 1 AS block FROM m5)"""
SQUASH = "regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g')"
#: Near-duplicate pairs of blocks (recording, turn_idx, speaker, start, norm): runs of equal 41-character windows on one diagonal.
DUPLICATES = """pair AS (
  SELECT x.recording, x.turn_idx AS i, y.turn_idx AS j, x.speaker AS si, y.speaker AS sj, x.start AS start, length(x.norm) AS la, length(y.norm) AS lb
  FROM blocks x JOIN blocks y ON x.recording = y.recording AND y.turn_idx - x.turn_idx BETWEEN 1 AND 5 WHERE length(x.norm) >= 41 AND length(y.norm) >= 41
), grams AS (SELECT recording, turn_idx, p, hash(substr(norm, p, 41)) AS g FROM (SELECT recording, turn_idx, norm, unnest(range(1, length(norm) - 39)) AS p FROM blocks WHERE length(norm) >= 41)),
met AS (
  SELECT q.recording, q.i, q.j, x.p AS pa, x.p - y.p AS d FROM pair q JOIN grams x ON x.recording = q.recording AND x.turn_idx = q.i
  JOIN grams y ON y.recording = q.recording AND y.turn_idx = q.j AND y.g = x.g
), isl AS (SELECT *, pa - row_number() OVER (PARTITION BY recording, i, j, d ORDER BY pa) AS island FROM met),
longest AS (SELECT recording, i, j, max(n) + 40 AS shared_chars FROM (SELECT recording, i, j, d, island, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
dups AS (
  SELECT recording, i, j, j - i AS distance, si AS first_speaker, sj AS second_speaker, si = sj AS same_speaker, start, CAST(shared_chars AS BIGINT) AS shared_chars
  FROM longest JOIN pair USING (recording, i, j) WHERE shared_chars > 0.5 * least(la, lb)
)"""
BLOCKS = f"""b0 AS (SELECT doc_id, source AS speaker, text, {SQUASH.format('text')} AS norm FROM documents),
blocks AS (
  SELECT *, CAST(turn_idx AS DOUBLE) AS start FROM (
    SELECT substr(norm, 1, 2) AS recording, row_number() OVER (PARTITION BY substr(norm, 1, 2) ORDER BY substr(norm, 1, 80), doc_id) - 1 AS turn_idx, speaker, text, norm FROM b0
  )
), {DUPLICATES}"""
#: Cross-speaker pairs without blocks that start inside a run of ten equal tokens or more.
CROSS = BLOCKS + """, toks AS (
  SELECT recording, turn_idx, start, pos, trim(lower(w), '.,?!"''') AS token FROM (
    SELECT recording, turn_idx, start, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM (
      SELECT recording, turn_idx, start, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM blocks))
), t1 AS (SELECT *, CASE WHEN token = lag(token) OVER (PARTITION BY recording ORDER BY turn_idx, pos) THEN 0 ELSE 1 END AS fresh FROM toks),
t2 AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY turn_idx, pos) AS run FROM t1),
loops AS (SELECT recording, min(start) AS s, max(start) AS e FROM t2 WHERE token <> '' GROUP BY recording, run HAVING count(*) >= 10),
looped AS (SELECT DISTINCT b.recording, b.turn_idx FROM blocks b JOIN loops l ON l.recording = b.recording AND b.start BETWEEN l.s AND l.e),
crossed AS (
  SELECT * FROM dups d WHERE NOT same_speaker AND NOT EXISTS (SELECT 1 FROM looped l WHERE l.recording = d.recording AND l.turn_idx IN (d.i, d.j))
)"""
ENVELOPE = """samples AS (
  SELECT 'a' AS side, event_id AS k, value FROM events
  UNION ALL SELECT 'b', event_id + 2000, value * CAST(0.3 AS DOUBLE) + CAST(0.5 AS DOUBLE) FROM events
  UNION ALL SELECT 'b', r, CAST(0.5 AS DOUBLE) FROM (SELECT unnest(range(0, 2000)) AS r)
), env AS (SELECT side, k // 10 AS win_idx, sqrt(avg(value * value)) AS rms FROM samples GROUP BY side, k // 10 HAVING count(*) = 10)"""
CORRELATION = ENVELOPE + """, centred AS (SELECT side, win_idx, rms - avg(rms) OVER (PARTITION BY side) AS x, count(*) OVER (PARTITION BY side) AS n FROM env),
corr AS (
  SELECT a.win_idx - b.win_idx AS lag, sum(a.x * b.x) AS corr, count(*) AS overlap, least(any_value(a.n), any_value(b.n)) AS n_min
  FROM centred a JOIN centred b ON a.side = 'a' AND b.side = 'b' GROUP BY a.win_idx - b.win_idx
)"""


def _noise(k: str, salt: int) -> str:
    x = f"(({k} * 2654435769 + {salt}) % 4294967296)"
    for shift in (15, 13):
        x = f"((xor({x}, {x} >> {shift}) * 1103515245 + 12345) % 4294967296)"
    return f"((CAST(xor({x}, {x} >> 16) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


CONTROLS = ENVELOPE + f""", e AS (SELECT side, win_idx AS k, rms, count(*) OVER (PARTITION BY side) AS n, stddev_pop(rms) OVER (PARTITION BY side) AS dev FROM env),
cases AS (
  SELECT 'pair' AS pair_id, side, k, rms FROM e
  UNION ALL SELECT 'pair/first half, second half', side, CASE side WHEN 'a' THEN k ELSE k - n // 2 END, rms FROM e WHERE CASE side WHEN 'a' THEN k < n // 2 ELSE k >= n // 2 END
  UNION ALL SELECT 'pair/second half, first half', side, CASE side WHEN 'b' THEN k ELSE k - n // 2 END, rms FROM e WHERE CASE side WHEN 'b' THEN k < n // 2 ELSE k >= n // 2 END
  UNION ALL SELECT 'pair/' || c, 'a', k, rms FROM e, (SELECT unnest(['shuffled', 'reversed', 'noise']) AS c) WHERE side = 'a'
  UNION ALL SELECT 'pair/shuffled', 'b', row_number() OVER (ORDER BY {_noise('k', 7)}, k) - 1, rms FROM e WHERE side = 'b'
  UNION ALL SELECT 'pair/reversed', 'b', n - 1 - k, rms FROM e WHERE side = 'b'
  UNION ALL SELECT 'pair/noise', 'b', k, abs(sqrt(-2 * ln({_noise('k', 8)})) * cos(2 * pi() * {_noise('k', 9)}) * dev) FROM e WHERE side = 'b'
), products AS (
  SELECT a.pair_id, a.k - b.k AS lag, sum(a.rms * b.rms) AS corr FROM cases a JOIN cases b ON a.pair_id = b.pair_id AND a.side = 'a' AND b.side = 'b' GROUP BY a.pair_id, a.k - b.k
), peaks AS (
  SELECT pair_id, arg_max(lag, struct_pack(c := corr, l := -lag)) AS lag0, max(corr) AS most, min(corr) AS least, quantile_cont(corr, 0.5) AS median, stddev_pop(corr) AS deviation FROM products GROUP BY pair_id
), rivals AS (SELECT pair_id, max(corr) AS rival FROM products JOIN peaks USING (pair_id) WHERE abs(lag - lag0) > 50 GROUP BY pair_id),
metrics AS (SELECT pair_id, lag0 * CAST(0.1 AS DOUBLE) AS offset_s, most / rival AS peak_over_rival, most / median AS peak_over_median, least, most, median, deviation FROM peaks LEFT JOIN rivals USING (pair_id))"""
VOICES = f"""parts AS (
  SELECT vec_id // {MEETING_VECTORS} AS meeting, CAST(label AS BIGINT) AS label, vec_id % 2 AS side, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k
  FROM embeddings WHERE label IS NOT NULL
), means AS (SELECT meeting, side, label, k, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY meeting, side, label, k),
both_sides AS (SELECT meeting, label FROM means GROUP BY meeting, label HAVING count(DISTINCT side) = 2),
heard AS (SELECT means.* FROM means JOIN both_sides USING (meeting, label)),
norms AS (SELECT meeting, side, label, sqrt(sum(x * x)) AS n FROM heard GROUP BY meeting, side, label),
sim AS (
  SELECT a.meeting, a.label AS i, b.label AS j, sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)) AS similarity
  FROM heard a JOIN heard b ON a.meeting = b.meeting AND a.k = b.k AND a.side = 0 AND b.side = 1
  JOIN norms na ON na.side = 0 AND na.meeting = a.meeting AND na.label = a.label JOIN norms nb ON nb.side = 1 AND nb.meeting = b.meeting AND nb.label = b.label
  GROUP BY a.meeting, a.label, b.label
)"""
_TURN_ROWS = 'recording, turn_idx, speaker, round(start, 6) AS start, round("end", 6) AS "end", text, round(confidence, 6) AS confidence'
_BAG = "unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> ''))"
_TOKENS = """raw AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations),
spoken AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM raw),
tokens AS (SELECT conv_id, turn, pos, trim(lower(w), '.,?!"''') AS token FROM spoken),
counted AS (SELECT token, count(*) AS n, min(struct_pack(a := conv_id, b := turn, c := pos)) AS f FROM tokens GROUP BY token),
top AS (SELECT token, n, n / (SELECT count(*) FROM tokens) AS share FROM counted ORDER BY n DESC, f LIMIT 40)"""

ORACLE: dict[str, str] = {
    "media_filter": f"""SELECT page_id, path FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/a.MP3' WHEN 1 THEN '/b.mov' WHEN 2 THEN '/c.txt' ELSE '' END AS path FROM pages)
      WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN {_IN(MEDIA)}""",
    "word_flatten": f'WITH {WORDS} SELECT recording, word_idx, word, start, "end" FROM words',
    "group_consecutive": f"""WITH {RUNS} SELECT recording, CAST(run - 1 AS BIGINT) AS turn_idx, min(speaker) AS speaker, min(start) AS start, max(start) + 1 AS "end",
      string_agg(speaker, ' ' ORDER BY turn_idx) AS text, round(avg(confidence), 6) AS confidence FROM r1 GROUP BY recording, run""",
    "relabel_speakers": f"WITH {LABELLED} SELECT recording, turn_idx, speaker FROM labelled",
    "format_timestamp": f"WITH {TURNS_A} SELECT recording, turn_idx, {STAMP.format('start')} AS stamp, {STAMP.format('start * 60')} AS long_stamp FROM turns_a",
    "render_markdown": f"""WITH {LABELLED} SELECT recording, regexp_replace(string_agg('## ' || speaker || ' — ' || {STAMP.format('start')} || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn_idx), '\\s+$', '') || chr(10) AS markdown
      FROM labelled GROUP BY recording""",
    "parse_blocks": f"WITH {LABELLED} SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY turn_idx) - 1 AS block_idx, speaker, {STAMP.format('start')} AS stamp, CAST(greatest(trunc(start), 0) AS BIGINT) AS seconds, text FROM labelled",
    "align_overlap": f"WITH {ALIGN} SELECT recording, word_idx, speaker FROM best WHERE most > 0 AND by_overlap = 1",
    "align_nearest": f"WITH {ALIGN} SELECT recording, word_idx, speaker FROM best WHERE most <= 0 AND by_distance = 1",
    "align_words": f"WITH {ALIGN} SELECT recording, word_idx, speaker FROM best WHERE (most > 0 AND by_overlap = 1) OR (most <= 0 AND by_distance = 1)",
    "repetition_loops": f'WITH {RUNS} SELECT recording, token, n AS "count", start, "end" FROM runs WHERE n >= 4',
    "in_loop_blocks": f'WITH {RUNS} SELECT recording, turn_idx FROM et t WHERE EXISTS (SELECT 1 FROM runs r WHERE r.n >= 4 AND r.recording = t.recording AND t.start BETWEEN r.start AND r."end")',
    "backchannel_split": f"""WITH t AS (SELECT lang, text FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 2)
      SELECT lang AS recording, count(*) AS short, count(*) FILTER (WHERE regexp_replace(lower(text), '[^a-z-]', '', 'g') IN {_IN(BACKCHANNELS)}) AS squashed,
        count(*) FILTER (WHERE len(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z-]', '', 'g')), lambda x: x <> '')) > 0
          AND len(list_filter(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z-]', '', 'g')), lambda x: x <> ''), lambda x: x NOT IN {_IN(BACKCHANNELS)})) = 0) AS by_word
      FROM t GROUP BY lang""",
    "smooth_micro_turns": f"""WITH {SMOOTH} SELECT recording, CAST(block AS BIGINT) AS turn_idx, arg_min(speaker, turn_idx) AS speaker, min(start) AS start, arg_max("end", turn_idx) AS "end",
      string_agg(text, ' ' ORDER BY turn_idx) AS text, round(min(confidence), 6) AS confidence, count(*) AS n_merged FROM m6 GROUP BY recording, block""",
    "smoothing_exclusions": f"""WITH {EVENTS}, {ACKNOWLEDGED}, counted AS (
        SELECT recording, text, lasts, listed, count(*) AS n FROM sandwiched GROUP BY ALL)
      SELECT recording, CAST(sum(n) AS BIGINT) AS short, CAST(coalesce(sum(n) FILTER (WHERE lasts), 0) AS BIGINT) AS by_duration,
        CAST(coalesce(sum(n) FILTER (WHERE NOT lasts AND listed), 0) AS BIGINT) AS by_word_list,
        coalesce(string_agg(text || ' ' || n, ', ' ORDER BY text) FILTER (WHERE NOT lasts AND listed), '') AS words_listed FROM counted GROUP BY recording""",
    "smoothing_candidates": f"""WITH {EVENTS}, {ACKNOWLEDGED}, toks AS (
        SELECT *, CASE WHEN token = lag(token) OVER (PARTITION BY recording ORDER BY turn_idx) THEN 0 ELSE 1 END AS nw
        FROM (SELECT *, CASE WHEN text = 'Yeah.' THEN 'yeah' ELSE text END AS token FROM et2)
      ), grp AS (SELECT *, sum(nw) OVER (PARTITION BY recording ORDER BY turn_idx) AS g FROM toks),
      spans AS (SELECT recording, min(start) AS s, max(start) AS e FROM grp GROUP BY recording, g HAVING count(*) >= 4)
      SELECT recording, turn_idx, speaker, start, text, before AS "into", right(said_before, 3) AS before, left(said_after, 3) AS after FROM sandwiched x
      WHERE NOT lasts AND NOT listed AND NOT EXISTS (SELECT 1 FROM spans WHERE spans.recording = x.recording AND x.start BETWEEN spans.s AND spans.e)""",
    "smoothing_report": f"""WITH {SMOOTH}, g0 AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY recording ORDER BY turn_idx) THEN 0 ELSE 1 END AS nw FROM m4),
      g1 AS (SELECT *, sum(nw) OVER (PARTITION BY recording ORDER BY turn_idx) AS g FROM g0), g2 AS (SELECT recording, min(start) AS s, max(start) AS e FROM g1 GROUP BY recording, g HAVING count(*) >= 4)
      SELECT recording, count(*) AS turns, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE absorbed) AS absorbed,
        count(*) FILTER (WHERE eligible AND EXISTS (SELECT 1 FROM g2 WHERE g2.recording = g1.recording AND g1.start BETWEEN g2.s AND g2.e)) AS eligible_in_loops FROM g1 GROUP BY recording""",
    "cross_speaker_duplicates": f"WITH {CROSS} SELECT recording, i, j, distance, first_speaker, second_speaker, start, shared_chars FROM crossed",
    "redundancy_by_distance": f"WITH {BLOCKS} SELECT distance, same_speaker, count(*) AS n FROM dups GROUP BY ALL",
    "top_duplicates": f"WITH {CROSS} SELECT recording, i, j, distance, start, shared_chars, greatest(0, (SELECT count(*) FROM crossed) - 10) AS n_more FROM crossed ORDER BY start, recording, distance, i LIMIT 10",
    "fragmentation": f"""WITH {TURNS_A}, t AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after FROM turns_a WINDOW w AS (PARTITION BY recording ORDER BY turn_idx))
      SELECT recording, count(*) AS blocks, count(*) FILTER (WHERE n <= 1) AS le_1, count(*) FILTER (WHERE n <= 2) AS le_2, count(*) FILTER (WHERE n <= 3) AS le_3, count(*) FILTER (WHERE n <= 5) AS le_5,
        CAST(sum(n) AS BIGINT) AS words, CAST(sum(CASE WHEN n <= 2 THEN n ELSE 0 END) AS BIGINT) AS words_in_le_2, count(*) FILTER (WHERE n <= 2 AND before = after) AS sandwiched, count(*) FILTER (WHERE before = speaker) AS same_as_before FROM t GROUP BY recording""",
    "degeneration_within": f"""WITH d AS (SELECT lang AS recording, doc_id AS turn_idx, regexp_split_to_array(text, '\\s+') AS ws FROM documents),
      w AS (SELECT recording, turn_idx, trim(lower(unnest(ws)), '.,?!') AS t, unnest(range(0, len(ws))) AS pos FROM d),
      l AS (SELECT *, lag(t, 1) OVER o AS a, lag(t, 2) OVER o AS b, lag(t, 3) OVER o AS c FROM w WINDOW o AS (PARTITION BY recording, turn_idx ORDER BY pos))
      SELECT DISTINCT recording, turn_idx FROM l WHERE t = a AND t = b AND t = c AND t <> ''""",
    "degeneration_docwide": f'WITH {RUNS} SELECT recording, token, n AS "count", start, "end" FROM runs WHERE n >= 4 ORDER BY n DESC, recording, first_turn, token LIMIT 6',
    "dominant_tokens": f"WITH {_TOKENS} SELECT token, n, round(share, 9) AS share FROM top",
    "suspicious_tokens": f"WITH {_TOKENS} SELECT token, n FROM top WHERE n > 50 AND token NOT IN {_IN(COMMON)}",
    "top_short_texts": f"""WITH {WORDS}, k AS (SELECT recording, word_idx, regexp_replace(lower(word), '[^a-z-]', '', 'g') AS token FROM words),
      g AS (SELECT token IN {_IN(BACKCHANNELS)} AS backchannel, token, count(*) AS n, min(struct_pack(a := recording, b := word_idx)) AS f FROM k GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY backchannel ORDER BY n DESC, f) AS place FROM g)
      SELECT backchannel, CAST(place AS INTEGER) AS place, token, n FROM r WHERE place <= 8""",
    "rms_envelope": f"WITH {ENVELOPE} SELECT side, win_idx, round(rms, 6) AS rms FROM env",
    "cross_correlation": f"WITH {CORRELATION} SELECT lag, round(corr, 2) AS corr, overlap FROM corr",
    "offset_confidence": f"""WITH {CORRELATION}, usable AS (SELECT * FROM corr WHERE overlap >= 0.5 * n_min), peak AS (SELECT lag AS p, corr AS c FROM usable ORDER BY corr DESC, lag LIMIT 1),
      rival AS (SELECT max(corr) AS r FROM usable, peak WHERE abs(lag - p) > 50)
      SELECT round(p * CAST(0.1 AS DOUBLE), 6) AS offset_s, round(CASE WHEN r > 0 THEN c / r ELSE 0 END, 6) AS confidence, CASE WHEN r > 0 THEN c / r ELSE 0 END < 1.2 AS weak FROM peak, rival""",
    "cosine_matrix": f"WITH {VOICES} SELECT meeting, 'S' || i AS speaker_a, 'S' || j AS speaker_b, round(similarity, 6) AS similarity FROM sim",
    "offset_controls": f"WITH {CONTROLS} SELECT pair_id, round(offset_s, 6) AS offset_s, round(peak_over_rival, 4) AS peak_over_rival, round(peak_over_median, 4) AS peak_over_median, round(least, 0) AS least, round(most, 0) AS most, round(median, 0) AS median, round(deviation, 0) AS deviation FROM metrics",
    "offset_separation": f"""WITH {CONTROLS}, g AS (SELECT 'pair' AS pair_id, max(peak_over_rival) FILTER (WHERE pair_id = 'pair') AS t, min(peak_over_rival) FILTER (WHERE pair_id <> 'pair') AS lo,
        quantile_cont(peak_over_rival, 0.5) FILTER (WHERE pair_id <> 'pair') AS mid, max(peak_over_rival) FILTER (WHERE pair_id <> 'pair') AS hi FROM metrics)
      SELECT pair_id, round(t, 4) AS "true", round(lo, 4) AS null_min, round(mid, 4) AS null_median, round(hi, 4) AS null_max, round(t / hi, 4) AS separation, round((t + hi) / 2, 4) AS midpoint FROM g""",
    "shift_and_remap": f"WITH {TURNS_B} SELECT {_TURN_ROWS} FROM turns_b",
    "merge_replacement": f"WITH RECURSIVE {MERGE} SELECT recording, a_idx, b_idx FROM picks",
    "containment_consumed": f"WITH RECURSIVE {MERGE} SELECT recording, turn_idx FROM consumed",
    "gapfill_coverage": f"WITH RECURSIVE {MERGE} SELECT {_TURN_ROWS} FROM fill",
    "merge_turns": f"WITH RECURSIVE {MERGE} SELECT {_TURN_ROWS}, origin FROM merged",
    "merge_origin_mix": f"WITH RECURSIVE {MERGE} SELECT origin, count(*) AS n FROM merged GROUP BY origin",
    "cross_speaker_origins": f"""WITH RECURSIVE {MERGE.replace(CENTS, ECHOES)}, blocks AS (SELECT *, {SQUASH.format('text')} AS norm FROM merged), {DUPLICATES}
      SELECT least(x.origin, y.origin) || ' + ' || greatest(x.origin, y.origin) AS origins, count(*) AS n FROM dups d JOIN merged x ON x.recording = d.recording AND x.turn_idx = d.i
      JOIN merged y ON y.recording = d.recording AND y.turn_idx = d.j WHERE NOT same_speaker GROUP BY ALL""",
    "cross_speaker_timing": f"""WITH RECURSIVE {MERGE.replace(CENTS, ECHOES)}, blocks AS (SELECT *, {SQUASH.format('text')} AS norm FROM merged), {DUPLICATES},
      gaps AS (SELECT greatest(0, greatest(x.start, y.start) - least(x."end", y."end")) AS gap FROM dups d JOIN merged x ON x.recording = d.recording AND x.turn_idx = d.i
        JOIN merged y ON y.recording = d.recording AND y.turn_idx = d.j WHERE NOT same_speaker)
      SELECT count(*) FILTER (WHERE gap = 0) AS same_time, count(*) FILTER (WHERE gap > 0) AS different_time FROM gaps""",
    "guard_sweep": f"""WITH RECURSIVE {MERGE} SELECT r AS radius, f AS min_chars, count(n) FILTER (WHERE same) AS same_fires, count(n) FILTER (WHERE NOT same) AS cross_fires, CAST(coalesce(sum(n) FILTER (WHERE same), 0) AS BIGINT) AS chars
      FROM (SELECT unnest([1, 2, 3, 4]) AS r) CROSS JOIN (SELECT unnest([0, 8, 20, 40]) AS f) LEFT JOIN fires ON step <= r AND n >= f AND n > 0 GROUP BY r, f""",
    "lossless_diff": f"""WITH RECURSIVE {MERGE}, gone AS (SELECT text FROM turns_a JOIN consumed USING (recording, turn_idx)), ga AS (SELECT word, count(*) AS n FROM (SELECT {_BAG} AS word FROM gone) GROUP BY word),
      left_over AS (SELECT DISTINCT word FROM (SELECT {_BAG} AS word FROM merged)) SELECT word, n AS removed, CAST(0 AS BIGINT) AS added, word NOT IN (SELECT word FROM left_over) AS lost FROM ga""",
    "smoothing_lossless": f"""WITH {SMOOTH}, after AS (SELECT string_agg(text, ' ' ORDER BY turn_idx) AS text FROM m6 GROUP BY recording, block),
      x AS (SELECT word, count(*) AS n FROM (SELECT {_BAG} AS word FROM m6) GROUP BY word), y AS (SELECT word, count(*) AS n FROM (SELECT {_BAG} AS word FROM after) GROUP BY word)
      SELECT count(*) AS words_that_differ FROM x FULL JOIN y USING (word) WHERE x.n IS DISTINCT FROM y.n""",
}
