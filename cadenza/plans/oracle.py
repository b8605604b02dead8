"""The queries once more in SQL, for a second engine to hold the results against."""

from __future__ import annotations

from cadenza.functions import keys, signal, tempo, values
from cadenza.operators.evaluation import THRESHOLDS


def item(i: str) -> str:
    return f"""'/lib/' || printf('%06d', {i}) AS path,
        CASE WHEN {i} % 97 = 0 THEN 0::DOUBLE ELSE 60 + (({i} * 7919) % 1400)::DOUBLE / 10::DOUBLE END AS bpm,
        CASE WHEN {i} % 19 = 0 THEN '?' ELSE (({i} * 5) % 12 + 1)::VARCHAR || CASE WHEN {i} % 2 = 0 THEN 'A' ELSE 'B' END END AS key,
        (60 + ({i} * 31) % 400)::DOUBLE AS duration, (({i} * 104729) % 10007)::DOUBLE / 10007::DOUBLE AS energy_raw,
        CASE WHEN {i} % 31 <> 0 THEN 'artist_' || ({i} % 40)::VARCHAR END AS artist, 'title ' || {i}::VARCHAR AS title,
        CASE WHEN {i} % 23 <> 0 THEN ({i} % 4)::VARCHAR || '/3' END AS agreement"""


LIBRARY = f"library AS (SELECT vec_id, {item('vec_id')}, label AS genre, embedding FROM embeddings)"
BIG = f"big AS (SELECT p_partkey, {item('p_partkey')} FROM part)"
CRATES = """crates AS (SELECT l_orderkey AS crate_id, l_linenumber AS position, l_partkey AS part, l_partkey * 10 + l_linenumber AS item_id, b.*,
        l_linestatus = 'F' AS file_ok, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS bpm_rank,
        CASE WHEN l_partkey % 11 <> 0 THEN 'Genre ' || (l_partkey % 3)::VARCHAR END AS genre,
        CASE WHEN l_partkey % 13 = 0 THEN 'analysing' WHEN l_partkey % 17 = 0 THEN 'failed' ELSE 'analysed' END AS state
        FROM lineitem JOIN big b ON p_partkey = l_partkey)"""
MARKS = """marks AS (SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS mark_id, b.path, b.duration,
        CASE l_returnflag WHEN 'A' THEN 'cue' WHEN 'N' THEN 'memory' ELSE 'loop' END AS kind,
        CASE WHEN l_returnflag = 'A' THEN (floor(l_quantity) % 9)::INT END AS num, floor(l_extendedprice * 10)::BIGINT AS start_ms,
        CASE WHEN l_returnflag NOT IN ('A', 'N') THEN floor(l_extendedprice * 10)::BIGINT + floor(l_quantity)::BIGINT * 100 - 300 END AS end_ms
        FROM lineitem JOIN big b ON p_partkey = l_partkey)"""


def six(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def valid(x: str) -> str:
    return f"coalesce({x} > 0 AND {x} < 'Infinity'::DOUBLE, false)"


def gaps(a: str, b: str) -> list[str]:
    return [f"abs({a} - {b} * {f}::DOUBLE) / greatest({a}, {b} * {f}::DOUBLE)" for f, _ in tempo.READINGS]


def distance(a: str, b: str) -> str:
    return f"CASE WHEN {valid(a)} AND {valid(b)} THEN least({', '.join(gaps(a, b))}) ELSE 1::DOUBLE END"


def score(a: str, b: str) -> str:
    return f"CASE WHEN {distance(a, b)} < 0.08::DOUBLE THEN 1 - ({distance(a, b)}) / 0.08::DOUBLE ELSE 0::DOUBLE END"


def delta(a: str, b: str) -> str:
    g = gaps(a, b)
    factor = f"CASE WHEN {g[0]} <= least({g[1]}, {g[2]}) THEN 1 WHEN {g[1]} <= {g[2]} THEN 2 ELSE 0.5 END"
    return f"100 * ({distance(a, b)}) * CASE WHEN {b} * ({factor})::DOUBLE < {a} THEN -1 ELSE 1 END"


def reading(a: str, b: str) -> str:
    g = gaps(a, b)
    return f"CASE WHEN {g[0]} <= least({g[1]}, {g[2]}) THEN 'same' WHEN {g[1]} <= {g[2]} THEN 'double' ELSE 'half' END"


def number(k: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({k}, '{keys.PATTERN}', 1), '') AS INT)"


def relation(a: str, b: str) -> str:
    m, n = number(a), number(b)
    turn = f"(({m} - {n} + 12) % 12)"
    level = f"(right({a}, 1) = right({b}, 1))"
    return f"""CASE WHEN {m} IS NULL OR {n} IS NULL THEN 'unknown' WHEN {level} AND {turn} = 0 THEN 'same' WHEN {level} AND {turn} IN (1, 11) THEN 'neighbour'
        WHEN NOT {level} AND {turn} = 0 THEN 'relative' WHEN {level} AND {turn} IN (2, 10) THEN 'two' ELSE 'far' END"""


def compat(a: str, b: str) -> str:
    return f"(CASE {relation(a, b)} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in keys.COMPAT.items()) + " END)::DOUBLE"


def mix(a: str, k: str, b: str, n: str) -> str:
    return f"({score(a, b)}) * pow({compat(k, n)}, 0.6::DOUBLE)"


PAIRS = f"""pairs AS (SELECT a.path AS from_path, b.path AS to_path, a.bpm AS a, b.bpm AS b, a.key AS k, b.key AS n, {mix("a.bpm", "a.key", "b.bpm", "b.key")} AS mix
        FROM {{t}} a JOIN {{t}} b ON a.path <> b.path WHERE {distance("a.bpm", "b.bpm")} < 0.08::DOUBLE)"""
CONTEXT = """each AS (SELECT path, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM library),
    dims AS (SELECT place, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS spread FROM each GROUP BY place),
    z AS (SELECT path, place, (x - mean) / spread AS z FROM each JOIN dims USING (place)),
    norms AS (SELECT path, sqrt(sum(z * z)) AS norm FROM z GROUP BY path),
    unit AS (SELECT path, list(z / CASE WHEN norm > 0 THEN norm ELSE 1 END ORDER BY place) AS v FROM z JOIN norms USING (path) GROUP BY path)"""
_EST = "bpm * (CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1.5 WHEN 4 THEN 1.25 ELSE 1.07 END)::DOUBLE"
_RATIOS = ", ".join(f"({i}, {r!r}::DOUBLE, '{n}')" for i, (r, n) in enumerate(tempo.RATIOS))
COMPARED = f"""measured AS (SELECT lower(substr(path, 6)) AS file, {_EST} AS est, agreement, (p_partkey * 37) % 100 / 100::DOUBLE AS confidence,
        CASE WHEN p_partkey % 5 = 0 THEN ((p_partkey * 7) % 12 + 1)::VARCHAR || 'A' ELSE key END AS key_est FROM big),
    truth AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'same.mp3' ELSE lower(substr(path, 6, 6)) END AS file, bpm AS ref, CASE WHEN p_partkey % 9 <> 0 THEN key END AS key_ref FROM big),
    na AS (SELECT file, count(*) AS na FROM measured GROUP BY file), nb AS (SELECT file, count(*) AS nb FROM truth GROUP BY file),
    states AS (SELECT file, CASE WHEN coalesce(na, 0) > 1 OR coalesce(nb, 0) > 1 THEN 'ambiguous' WHEN nb IS NULL THEN 'only-measured' WHEN na IS NULL THEN 'only-truth' ELSE 'matched' END AS state
        FROM na FULL JOIN nb USING (file)),
    ratios(i, ratio, name) AS (VALUES {_RATIOS}),
    met AS (SELECT * FROM measured JOIN truth USING (file) JOIN states USING (file) WHERE state = 'matched'),
    near AS (SELECT file, min_by(name, (abs(est - ref * ratio), i)) AS name, min_by(i, (abs(est - ref * ratio), i)) AS i FROM met, ratios WHERE abs(est - ref * ratio) <= greatest(1::DOUBLE, ref * (ratio * 0.02::DOUBLE)) GROUP BY file),
    compared AS (SELECT m.*, CASE WHEN ref > 0 THEN round_even(abs(est - ref)::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE END AS bpm_error,
        CASE WHEN ref > 0 THEN round_even(least(abs(est - ref), abs(est - ref * 2), abs(est - ref * 0.5::DOUBLE))::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE END AS bpm_error_tolerant,
        CASE WHEN NOT {valid("ref")} THEN 'no-reference' WHEN abs(est - ref) <= 1 THEN 'exact' WHEN name IS NULL OR i = 0 THEN 'genuine' ELSE name END AS bpm_class,
        CASE WHEN {number("key_ref")} IS NOT NULL THEN key_est = key_ref END AS key_exact,
        CASE WHEN {number("key_ref")} IS NOT NULL THEN {compat("key_est", "key_ref")} >= 0.8::DOUBLE END AS key_compatible,
        CASE WHEN agreement IS NOT NULL THEN split_part(agreement, '/', 1) = split_part(agreement, '/', 2) AND split_part(agreement, '/', 2)::INT > 0 END AS unanimous
        FROM met m LEFT JOIN near USING (file)),
    metrics AS (SELECT coalesce(quantile_cont(bpm_error_tolerant, 0.95), 0) AS bpm_error_p95,
        100::DOUBLE * count(*) FILTER (unanimous AND key_exact) / nullif(count(*) FILTER (unanimous AND key_exact IS NOT NULL), 0) AS key_exact,
        100::DOUBLE * count(*) FILTER (unanimous AND key_compatible) / nullif(count(*) FILTER (unanimous AND key_exact IS NOT NULL), 0) AS key_compatible,
        count(*) FILTER (unanimous AND key_exact IS NOT NULL) AS n_unanimous, count(key_exact) AS n_with_key, count(*) AS n FROM compared)"""
_LIMITS = ", ".join(f"('{m}', '{o}', {b!r}::DOUBLE)" for m, o, b in THRESHOLDS)
_CLASSES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(tempo.CLASSES))
_TOKENS = """list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\\(\\[\\{{].*?[\\)\\]\\}}]', ' ', 'g'), '[^0-9a-záéíóúüñ\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')),
        lambda w: len(w) > 1 AND w NOT IN ('official', 'video', 'oficial', 'audio', 'lyric', 'lyrics', 'letra', 'hd', 'hq', '4k', 'mv', 'm', 'v', 'remaster', 'remastered', 'explicit', 'clip', 'visualizer', 'feat', 'ft', 'featuring', 'con', 'the', 'a', 'el', 'la', 'los', 'las', 'de', 'del', 'y', 'and', 'x', 'vs', 'full', 'free', 'download', 'out', 'now', 'premiere')))"""
RESULTS = f"""raw AS (SELECT l_orderkey AS query_id, l_linenumber AS line, l_suppkey AS supplier, l_partkey AS item_id, p_name || ' ' || p_brand AS named,
        (['store', 'stream', 'video'])[l_suppkey % 3 + 1] AS source FROM lineitem JOIN part ON l_partkey = p_partkey),
    asked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line, supplier, item_id, source) AS rank, min(named) OVER (PARTITION BY query_id) AS asked FROM raw),
    cut AS (SELECT *, {_TOKENS.format(x="named")} AS t, {_TOKENS.format(x="asked")} AS q FROM asked),
    scored AS (SELECT *, CASE WHEN len(q) = 0 THEN 1 WHEN len(t) = 0 OR (len(q) >= 2 AND len(list_intersect(t, q)) < 2) THEN 0 ELSE len(list_intersect(t, q))::DOUBLE / least(len(t), len(q)) END::DOUBLE AS score FROM cut)"""
OBSERVED = """seen AS (SELECT '/watch/' || (user_id % 50)::VARCHAR || '/' || event_type || '.wav' AS path, floor(value / 40)::BIGINT AS size,
        (floor(floor(epoch(ts)) / 864000) * 864000)::BIGINT AS mtime, ts FROM events),
    lagged AS (SELECT *, lag(size) OVER o AS s, lag(mtime) OVER o AS m, lead(ts) OVER o IS NULL AS last FROM seen WINDOW o AS (PARTITION BY path ORDER BY ts, mtime, size)),
    stable AS (SELECT path, size, mtime FROM lagged WHERE last AND size > 0 AND size = s AND mtime = m)"""
ITEMS = "items AS (SELECT DISTINCT ON (crate_id, item_id) * FROM crates ORDER BY crate_id, item_id, file_ok, bpm_rank)"
_EIGHT = "'8A'"
REASONS = ("other-genre", "no-file", "no-genre", "analysing", "failed", "not-analysed", "not-a-track", "duplicate")


def _classic() -> str:
    names = [f"WHEN '{i + 1}A' THEN '{n}'" for i, n in enumerate(keys.MINOR)] + [f"WHEN '{i + 1}B' THEN '{n}'" for i, n in enumerate(keys.MAJOR)]
    return f"CASE a {' '.join(names)} ELSE '' END"


def _tones(profile: tuple[float, ...]) -> str:
    return f"[{', '.join(f'{x!r}::DOUBLE' for x in profile)}]"


SQL: dict[str, str] = {
    "nearest_with_reasons": f"""WITH {LIBRARY}, {CONTEXT},
    e AS (SELECT path, (rank() OVER (ORDER BY energy_raw) - 1)::DOUBLE / count(*) OVER () AS energy FROM library),
    dots AS (SELECT a.path AS seed, b.path, list_dot_product(a.v, b.v) AS s FROM unit a JOIN unit b ON a.path <> b.path JOIN library f ON f.path = b.path WHERE f.duration >= 90),
    near AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY s DESC, path) AS rank FROM dots)
    SELECT seed, rank::INT AS rank, near.path, {six("s")} AS similarity, {six("energy")} AS energy, {six(mix("a.bpm", "a.key", "b.bpm", "b.key"))} AS mix, {relation("a.key", "b.key")} AS relation
    FROM near JOIN library a ON a.path = seed JOIN library b ON b.path = near.path JOIN e ON e.path = near.path WHERE rank <= 10""",
    "mixable_pairs": f"""WITH {LIBRARY}, {PAIRS.format(t="library")}
    SELECT from_path, to_path, {six("mix")} AS mix, {six(delta("a", "b"))} AS delta_percent, {reading("a", "b")} AS reading, {relation("k", "n")} AS relation, {compat("k", "n")} AS compat FROM pairs WHERE mix > 0""",
    "mixable_degree": f"WITH {BIG}, {PAIRS.format(t='big')} SELECT from_path, count(*) AS partners, {six('max(mix)')} AS best, {six('avg(mix)')} AS mean FROM pairs WHERE mix > 0 GROUP BY from_path",
    "library_percentile": f"""WITH {BIG} SELECT path, {six("(rank() OVER (ORDER BY energy_raw) - 1)::DOUBLE / count(*) OVER ()")} AS energy, duration >= 90 AS track, CASE WHEN bpm > 0 THEN round_even(bpm, 1) END AS shown_bpm,
    CASE WHEN artist IS NULL THEN title ELSE artist || ' — ' || title END AS label, floor(duration / 60)::INT::VARCHAR || ':' || lpad((duration::INT % 60)::VARCHAR, 2, '0') AS clock,
    NOT coalesce(agreement = '3/3', false) AS doubtful, substr(sha1(lower(path)), 1, 16) AS id FROM big""",
    "key_relations": f"""WITH {BIG}, k AS (SELECT DISTINCT key FROM big), p AS (SELECT x.key AS a, y.key AS b FROM k x, k y)
    SELECT a, b, {relation("a", "b")} AS relation, {compat("a", "b")} AS compat, {six(f"pow({compat('a', 'b')}, 0.6::DOUBLE)")} AS factor,
    CASE WHEN {relation("a", "b")} = 'same' THEN 0 WHEN {relation("a", "b")} IN ('neighbour', 'relative') THEN 1 ELSE 2 END AS steps, {_classic()} AS classic FROM p""",
    "energy_curves": f"""WITH s AS (SELECT count(*)::INT AS length FROM lineitem GROUP BY l_orderkey), l AS (SELECT length, count(*) AS sets FROM s GROUP BY length), p AS (SELECT *, unnest(range(length))::INT AS position FROM l),
    n AS (SELECT *, position / greatest(length - 1, 1)::DOUBLE AS t FROM p)
    SELECT length, position, sets, {six("CASE WHEN t <= 0.75 THEN 0.35::DOUBLE + 0.6::DOUBLE * t / 0.75::DOUBLE ELSE 0.95::DOUBLE - 0.35::DOUBLE * (t - 0.75::DOUBLE) / 0.25::DOUBLE END")} AS peak, {six("0.3::DOUBLE + 0.5::DOUBLE * t")} AS warmup, 0.5::DOUBLE AS flat FROM n""",
    "evaluation_rows": f"WITH {BIG}, {COMPARED} SELECT file, bpm_error, bpm_error_tolerant, bpm_class, key_exact, key_compatible, unanimous FROM compared",
    "evaluation_rest": f"WITH {BIG}, {COMPARED} SELECT file, state FROM states WHERE state <> 'matched'",
    "evaluation_metrics": f"WITH {BIG}, {COMPARED} SELECT {six('bpm_error_p95')} AS bpm_error_p95, {six('key_exact')} AS key_exact, {six('key_compatible')} AS key_compatible, n_unanimous, n_with_key, n FROM metrics",
    "accuracy_by_agreement": f"""WITH {BIG}, {COMPARED} SELECT coalesce(agreement, 'none') AS agreement, count(*) AS n, {six("100 * avg(key_exact::INT)")} AS exact, {six("100 * avg(key_compatible::INT)")} AS compatible
    FROM compared WHERE key_exact IS NOT NULL GROUP BY ALL""",
    "error_classes": f"""WITH {BIG}, {COMPARED}, classes(place, class) AS (VALUES {_CLASSES}), n AS (SELECT bpm_class AS class, count(*) AS n FROM compared GROUP BY ALL)
    SELECT class, coalesce(n, 0) AS n FROM classes LEFT JOIN n USING (class) WHERE n > 0 OR class IN ('exact', 'genuine')""",
    "confidence_calibration": f"""WITH {BIG}, {COMPARED}, r AS (SELECT round(corr(confidence, key_exact::INT), 6) + 0.0::DOUBLE AS pearson FROM compared WHERE key_exact IS NOT NULL),
    b AS (SELECT CASE WHEN confidence < 0.34::DOUBLE THEN 0 WHEN confidence < 0.67::DOUBLE THEN 1 WHEN confidence < 0.99::DOUBLE THEN 2 ELSE 3 END AS bucket, key_exact FROM compared WHERE key_exact IS NOT NULL),
    g AS (SELECT bucket, count(*) AS n, {six("100 * avg(key_exact::INT)")} AS accuracy FROM b GROUP BY bucket) SELECT * FROM g, r""",
    "threshold_verdicts": f"""WITH {BIG}, {COMPARED}, limits(metric, op, bound) AS (VALUES {_LIMITS}),
    found AS (SELECT 'bpm_error_p95' AS metric, bpm_error_p95::DOUBLE AS value FROM metrics UNION ALL SELECT 'key_exact', key_exact FROM metrics UNION ALL SELECT 'key_compatible', key_compatible FROM metrics)
    SELECT metric, op, bound, {six("value")} AS value, CASE op WHEN '<=' THEN value <= bound WHEN '>=' THEN value >= bound ELSE value < bound END AS ok FROM limits LEFT JOIN found USING (metric)""",
    "overall_verdict": f"WITH {BIG}, {COMPARED} SELECT CASE WHEN bpm_error_p95 > 1 OR coalesce(key_exact < 85, false) OR coalesce(key_compatible < 95, false) THEN 1 ELSE 2 END AS verdict FROM metrics",
    "quality_confusion": """WITH r AS (SELECT n_chars < 600 AS f, quality = 0 AS t FROM documents LEFT JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND NOT t) AS tn, count(*) FILTER (NOT f AND t) AS fn, count(*) FILTER (t IS NULL) AS unlabelled FROM r)
    SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 6) AS accuracy FROM c""",
    "quality_grades": """WITH r AS (SELECT *, floor(l_quantity * 8)::INT AS rate, l_extendedprice % 12000::DOUBLE / 1000::DOUBLE + 10 AS khz, l_discount * 400::DOUBLE AS wall, l_returnflag = 'A' AS lossless FROM lineitem),
    e AS (SELECT *, (CASE WHEN rate >= 320 THEN 20 WHEN rate >= 256 THEN 19.5 WHEN rate >= 192 THEN 18.5 WHEN rate >= 160 THEN 16.5 WHEN rate >= 128 THEN 16 WHEN rate >= 96 THEN 15 ELSE 13 END)::DOUBLE AS expected FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, expected, CASE WHEN khz >= 19.75::DOUBLE THEN 320 WHEN khz >= 19.25::DOUBLE THEN 256 WHEN khz >= 18.25::DOUBLE THEN 192 WHEN khz >= 16.25::DOUBLE THEN 160 WHEN khz >= 15.75::DOUBLE THEN 128 WHEN khz >= 14.75::DOUBLE THEN 96 ELSE 0 END AS supported,
    CASE WHEN lossless THEN CASE WHEN wall >= 25 AND khz < 19 THEN 'suspicious' ELSE 'ok' END WHEN khz - expected >= -1 THEN 'ok' WHEN wall >= 25 THEN 'suspicious' ELSE 'low' END AS flag,
    CASE WHEN lossless AND l_linenumber = 1 THEN 'A' WHEN NOT lossless THEN CASE WHEN rate >= 300 THEN 'A' WHEN rate >= 256 THEN 'A-' WHEN rate >= 200 THEN 'B' WHEN rate >= 150 THEN 'C' WHEN rate >= 96 THEN 'D' ELSE 'F' END
    WHEN khz * 1000 >= 20000 THEN CASE WHEN wall >= 25 THEN 'A-' ELSE 'A' END WHEN khz * 1000 >= 19500 THEN 'B' WHEN khz * 1000 >= 18000 THEN 'C' WHEN khz * 1000 >= 15500 THEN 'D' ELSE 'F' END AS grade FROM e""",
    "crate_metrics": f"""WITH {BIG}, {CRATES}, i AS (SELECT *, {number("key")} AS number FROM crates), g AS (SELECT crate_id, number, count(*) AS n FROM i WHERE number IS NOT NULL GROUP BY ALL),
    p AS (SELECT crate_id, arg_max(number, n * 100 - number) AS peak_key FROM g GROUP BY crate_id), s AS (SELECT crate_id, count(*) AS items, count(*) FILTER (file_ok) AS with_file, sum(duration) AS seconds FROM i GROUP BY crate_id),
    c AS (SELECT crate_id, sum(n)::BIGINT AS n FROM g JOIN p USING (crate_id) WHERE (number - peak_key + 12) % 12 IN (0, 1, 11) GROUP BY crate_id)
    SELECT crate_id, items, with_file, seconds, peak_key, coalesce(n, 0) AS compatible FROM s LEFT JOIN p USING (crate_id) LEFT JOIN c USING (crate_id)""",
    "crate_tempo": f"""WITH {BIG}, {CRATES}, k AS (SELECT *, min(bpm_rank) OVER (PARTITION BY crate_id) AS best FROM crates WHERE bpm > 0)
    SELECT crate_id, (['engine', 'collection', 'other'])[best + 1] AS source, ((2 * sum(round(bpm * 10)::BIGINT) FILTER (bpm_rank = best) + count(*) FILTER (bpm_rank = best)) // (2 * count(*) FILTER (bpm_rank = best)))::DOUBLE / 10 AS mean, round(min(bpm) FILTER (bpm_rank = best), 1) AS low,
    round(max(bpm) FILTER (bpm_rank = best), 1) AS high, count(*) FILTER (bpm_rank = best) AS n, count(*) FILTER (bpm_rank <> best) AS left_out FROM k GROUP BY crate_id, best""",
    "crate_shelves": f"""WITH {BIG}, {CRATES} SELECT lower(genre) AS genre, count(*) AS items, CASE WHEN genre IS NOT NULL THEN 'other' END AS family FROM crates GROUP BY ALL""",
    "genre_spearman": f"""WITH {LIBRARY}, t AS (SELECT * FROM library WHERE bpm > 0), r AS (SELECT genre,
    rank() OVER (PARTITION BY genre ORDER BY bpm) + (count(*) OVER (PARTITION BY genre, bpm) - 1) / 2::DOUBLE AS a, rank() OVER (PARTITION BY genre ORDER BY energy_raw) + (count(*) OVER (PARTITION BY genre, energy_raw) - 1) / 2::DOUBLE AS b FROM t)
    SELECT genre, CASE WHEN count(*) >= 2 AND min(a) < max(a) AND min(b) < max(b) THEN {six("corr(a, b)")} END AS spearman FROM r GROUP BY genre""",
    "tempo_histogram": f"""WITH {BIG}, n AS (SELECT least(floor((bpm - 60) / (140::DOUBLE / 12)), 11)::INT AS bin, count(*) AS n FROM big WHERE bpm >= 60 AND bpm <= 200 GROUP BY ALL)
    SELECT range::INT AS bin, coalesce(n, 0) AS n FROM range(12) LEFT JOIN n ON bin = range""",
    "mark_summary": f"""WITH {BIG}, {MARKS} SELECT path, count(*) AS marks, coalesce(array_to_string(list_sort(list(DISTINCT num) FILTER (num IS NOT NULL)), ','), '') AS pads,
    count(*) FILTER (kind = 'cue') AS cues, count(*) FILTER (kind = 'memory') AS memories, count(*) FILTER (kind = 'loop') AS loops FROM marks GROUP BY path""",
    "mark_violations": f"""WITH {BIG}, {MARKS}, m AS (SELECT *, count(*) OVER (PARTITION BY path, num) AS c, duration * 1000 AS ms FROM marks),
    v AS (SELECT unnest(list_filter([CASE WHEN num NOT BETWEEN 0 AND 7 THEN 'pad-range' END, CASE WHEN num IS NOT NULL AND c > 1 THEN 'pad-shared' END, CASE WHEN start_ms < 0 OR start_ms >= ms THEN 'start' END,
    CASE WHEN kind = 'loop' AND (end_ms <= start_ms OR end_ms > ms) THEN 'end' END], lambda x: x IS NOT NULL)) AS rule FROM m) SELECT rule, count(*) AS marks FROM v GROUP BY rule""",
    "mark_statistics": f"""WITH {BIG}, {MARKS}, m AS (SELECT num, mark_id, start_ms / 1000::DOUBLE / duration AS at_ FROM marks WHERE duration > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY at_, mark_id) - 1 AS i, count(*) OVER (PARTITION BY num) AS n FROM m)
    SELECT num, count(*) AS n, {six("min(at_)")} AS low, {six("max(CASE WHEN i = n // 2 THEN at_ END)")} AS middle, {six("max(at_)")} AS high, count(*) FILTER (at_ < 0.15::DOUBLE) AS opening, count(*) FILTER (at_ > 0.85::DOUBLE) AS closing FROM r GROUP BY num""",
    "mark_orphans": f"WITH {BIG}, {LIBRARY}, {MARKS} SELECT path, count(*) AS marks FROM marks ANTI JOIN library USING (path) GROUP BY path",
    "duplicate_pairs": f"""WITH {LIBRARY}, p AS (SELECT a.path AS a, b.path AS b, corr_ AS similarity FROM library a JOIN library b ON a.path < b.path AND abs(a.duration - b.duration) <= greatest(2::DOUBLE, least(a.duration, b.duration) * 0.02::DOUBLE),
    LATERAL (SELECT corr(x, y) AS corr_ FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y)))
    SELECT a, b, {six("similarity")} AS similarity FROM p WHERE similarity >= 0.3::DOUBLE""",
    "duplicate_survivors": f"""WITH RECURSIVE {LIBRARY}, p AS (SELECT a.path AS a, b.path AS b, corr_ AS similarity FROM library a JOIN library b ON a.path < b.path AND abs(a.duration - b.duration) <= greatest(2::DOUBLE, least(a.duration, b.duration) * 0.02::DOUBLE),
    LATERAL (SELECT corr(x, y) AS corr_ FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y))), found AS (SELECT * FROM p WHERE similarity >= 0.3::DOUBLE),
    e AS (SELECT a AS x, b AS y FROM found UNION ALL SELECT b, a FROM found), reach AS (SELECT x AS path, x AS root FROM e UNION SELECT y, root FROM reach JOIN e ON path = x),
    g AS (SELECT path, min(root) AS "group" FROM reach GROUP BY path), w AS (SELECT "group", min(similarity) AS least_similarity, count(*) AS pairs FROM found JOIN g ON path = a GROUP BY "group"),
    m AS (SELECT "group", count(*) AS members FROM g GROUP BY "group")
    SELECT path, "group", members, {six("least_similarity")} AS least_similarity, 2 * pairs = members * (members - 1) AS all_agree,
    row_number() OVER (PARTITION BY "group" ORDER BY vec_id % 80 DESC, vec_id % 3 = 0, vec_id % 5 = 0 DESC, vec_id % 7 = 0 DESC, path) = 1 AS keep FROM g JOIN m USING ("group") JOIN w USING ("group") JOIN library USING (path)""",
    "mark_merge": f"""WITH {BIG}, {MARKS}, m AS (SELECT *, (mark_id // 100) % 2 = 1 AS odd FROM marks), known AS (SELECT DISTINCT path, kind, num, start_ms, end_ms FROM m WHERE NOT odd),
    a AS (SELECT *, CASE WHEN start_ms >= duration * 1000 OR end_ms > duration * 1000 THEN 'outside' END AS o FROM m WHERE odd),
    b AS (SELECT a.*, CASE WHEN o IS NULL AND (k.path IS NOT NULL OR row_number() OVER (PARTITION BY a.path, a.kind, a.num, a.start_ms, a.end_ms, o IS NULL ORDER BY mark_id) > 1) THEN 'present' ELSE o END AS p
        FROM a LEFT JOIN known k ON a.path = k.path AND a.kind = k.kind AND a.num IS NOT DISTINCT FROM k.num AND a.start_ms = k.start_ms AND a.end_ms IS NOT DISTINCT FROM k.end_ms),
    t AS (SELECT DISTINCT path, num FROM known WHERE num IS NOT NULL),
    c AS (SELECT b.*, CASE WHEN p IS NULL AND b.num IS NOT NULL THEN CASE WHEN t.path IS NOT NULL OR row_number() OVER (PARTITION BY b.path, b.num, p IS NULL ORDER BY mark_id) > 1 THEN 'kept' ELSE 'added' END ELSE p END AS q
        FROM b LEFT JOIN t ON b.path = t.path AND b.num = t.num),
    h AS (SELECT path, kind, count(*) AS have FROM m WHERE NOT odd AND num IS NULL GROUP BY ALL),
    d AS (SELECT c.kind, CASE WHEN q IS NULL THEN CASE WHEN coalesce(have, 0) + row_number() OVER (PARTITION BY c.path, c.kind, q IS NULL ORDER BY mark_id) > 32 THEN 'full' ELSE 'added' END ELSE q END AS outcome FROM c LEFT JOIN h ON c.path = h.path AND c.kind = h.kind)
    SELECT kind, outcome, count(*) AS marks FROM d GROUP BY ALL""",
    "pending_batches": f"""WITH {OBSERVED}, p AS (SELECT path, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM stable WHERE size % 2 = 1 OR length(path) % 3 = 0),
    r AS (SELECT path, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS r FROM p)
    SELECT path, r::VARCHAR || '-' || ((row_number() OVER (PARTITION BY r ORDER BY path) - 1) // 8)::VARCHAR AS batch FROM r""",
    "bridges": f"""WITH {LIBRARY}, tracks AS (SELECT * FROM library WHERE duration >= 90), {PAIRS.format(t="tracks")}, e AS (SELECT from_path AS x, to_path AS y, -ln(mix) AS c FROM pairs WHERE mix > 0),
    n AS (SELECT '/lib/' || printf('%06d', n_nationkey * 3 + 1) AS s, '/lib/' || printf('%06d', n_nationkey * 7 + 120) AS g FROM nation),
    q AS (SELECT s, g, a.duration AS sd, b.duration AS gd, a.bpm AS sb, b.bpm AS gb, {mix("a.bpm", "a.key", "b.bpm", "b.key")} AS m FROM n JOIN library a ON a.path = s JOIN library b ON b.path = g),
    z AS (SELECT *, CASE WHEN sd < 90 OR gd < 90 THEN 'fragment' WHEN s = g THEN 'same' WHEN NOT (sb > 0 AND gb > 0) THEN 'no-tempo' END AS no FROM q),
    f AS (SELECT s, g, a.c + b.c AS cost, s || ' ' || a.y || ' ' || g AS found, 3 AS size FROM z JOIN e a ON a.x = s JOIN e b ON b.x = a.y AND b.y = g WHERE no IS NULL AND a.y <> g
        UNION ALL SELECT s, g, a.c + b.c + d.c, s || ' ' || a.y || ' ' || b.y || ' ' || g, 4 FROM z JOIN e a ON a.x = s JOIN e b ON b.x = a.y JOIN e d ON d.x = b.y AND d.y = g WHERE no IS NULL AND a.y <> g AND b.y <> s AND b.y <> g),
    o AS (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY cost, size, found) AS i FROM f)
    SELECT s AS start, g AS goal, found, {six("cost")} AS cost, {six("CASE WHEN m > 0 THEN -ln(m) END")} AS direct, coalesce(no, CASE WHEN found IS NULL THEN 'no-bridge' ELSE 'found' END) AS stop FROM z LEFT JOIN (SELECT * FROM o WHERE i = 1) USING (s, g)""",
    "search_relevance": f"WITH {RESULTS}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM scored) SELECT query_id, rank::INT AS rank, item_id, {six('score')} AS score FROM b WHERE best < 0.6 OR score >= 0.6",
    "search_interleaved": f"""WITH {RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth, list_position(['video', 'store', 'stream'], source) AS pl FROM scored),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth, pl) AS place FROM n WHERE nth <= 4) SELECT query_id, place::INT AS place, source, item_id FROM p WHERE place <= 6""",
    "search_diverse": f"""WITH {RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM scored),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth > 1, rank) AS place FROM n) SELECT query_id, place::INT AS place, source, item_id FROM p WHERE place <= 4""",
    "similar_order": f"""WITH {BIG}, p AS (SELECT l.path, l.p_partkey, l.bpm AS a, l.key AS k, b.bpm AS b, b.key AS n FROM big l JOIN big b ON l.p_partkey = b.p_partkey + 1)
    SELECT path, {six(f"(CASE WHEN {relation('k', 'n')} = 'same' THEN 0 WHEN {relation('k', 'n')} IN ('neighbour', 'relative') THEN 1 ELSE 2 END) * 1000 + least(CASE WHEN a > 0 AND b > 0 THEN least(abs(a - b), abs(a - b * 2), abs(a - b * 0.5::DOUBLE)) ELSE 999 END, 40::DOUBLE) * 10 - CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END")} AS score FROM p""",
    "popularity": f"""SELECT o_orderkey, {six("least(40 * (o_custkey % 100) / 100::DOUBLE + 30 * least(floor(o_totalprice / 20) / 10000::DOUBLE, 1::DOUBLE) + 20 * least((o_orderkey % 1500) / 1000::DOUBLE, 1::DOUBLE) + CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END, 100::DOUBLE)")} AS score FROM orders""",
    "set_playlists": f"""WITH {BIG}, {CRATES}, l AS (SELECT crate_id, position, path, '#EXTINF:' || duration::INT || ',' || CASE WHEN artist IS NULL THEN title ELSE artist || ' — ' || title END || chr(13) || chr(10) ||
    '#MIX:bpm=' || printf('%.1f', bpm) || ' key=' || key || ' energy=0.50' || chr(13) || chr(10) || path || chr(13) || chr(10) AS line FROM crates),
    t AS (SELECT crate_id, '#EXTM3U' || chr(13) || chr(10) || string_agg(line, '' ORDER BY position, path) AS t FROM l GROUP BY crate_id) SELECT crate_id, length(t) AS chars, sha256(t) AS sha FROM t""",
    "xml_tracks": f"""WITH {BIG} SELECT path, '<TRACK Name="' || title || '"' || CASE WHEN artist IS NULL THEN '' ELSE ' Artist="' || artist || '"' END || CASE WHEN bpm > 0 THEN ' AverageBpm="' || printf('%.1f', bpm) || '"' ELSE '' END ||
    CASE WHEN key = '?' THEN '' ELSE ' Tonality="' || {_classic().replace("CASE a", "CASE key")} || '"' END || ' TotalTime="' || duration::INT || '" Location="' || path || '"/>' AS xml FROM big""",
    "reconciled_files": f"""WITH {BIG}, f AS (SELECT path, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS d FROM big WHERE p_partkey % 7 <> 0), t AS (SELECT path, 1 AS k FROM big WHERE p_partkey % 5 <> 0)
    SELECT path, CASE WHEN k IS NULL THEN 'new' WHEN d = k THEN 'unchanged' WHEN d IS NOT NULL THEN 'updated' ELSE 'deleted' END AS state FROM f FULL JOIN t USING (path)""",
    "stable_files": f"WITH {OBSERVED} SELECT path, size, mtime FROM stable",
    "hourly_events": f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS events, {six('sum(value)')} AS total FROM events GROUP BY ALL",
    "page_fields": r"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading FROM pages""",
    "step_reasons": f"""WITH {BIG}, p AS (SELECT l.path, l.bpm AS a, l.key AS k, b.bpm AS b, b.key AS n FROM big l JOIN big b ON l.p_partkey = b.p_partkey - 1 WHERE l.bpm > 0 AND b.bpm > 0)
    SELECT path, CASE {reading("a", "b")} WHEN 'same' THEN '' ELSE ' (' || {reading("a", "b")} || ')' END || ' | ' || k || ' → ' || n || ' (' || {relation("k", "n")} || ')' AS reason,
    {six("least(1 - least(a, b) / greatest(a, b), 1 - least(a, b * 2) / greatest(a, b * 2), 1 - least(a, b * 0.5::DOUBLE) / greatest(a, b * 0.5::DOUBLE))")} AS pitch, {six(distance("a", "b"))} AS distance FROM p""",
    "resolved_paths": """WITH f AS (SELECT '/new/' || p_type || '/' || p_brand || '/t' || CASE WHEN p_partkey % 10 = 0 THEN 'same' ELSE printf('%05d', p_partkey) END || '.mp3' AS path FROM part),
    w AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'C:\\old\\' || p_type || '\\' || p_brand || '\\t' || printf('%05d', p_partkey) || '.mp3' WHEN 1 THEN '/x/t' || printf('%05d', p_partkey) || '.mp3' ELSE '/y/' || p_brand || '/tsame.mp3' END AS location FROM part),
    fp AS (SELECT DISTINCT path, list_filter(string_split(lower(path), '/'), lambda p: p <> '') AS parts FROM f), wp AS (SELECT location, list_filter(string_split(lower(replace(location, '\\', '/')), '/'), lambda p: p <> '') AS parts FROM w),
    ft AS (SELECT path, k AS size, array_to_string(parts[len(parts) - k + 1:], '/') AS tail FROM fp, range(1, 10) r(k) WHERE k <= len(parts)), wt AS (SELECT location, k AS size, array_to_string(parts[len(parts) - k + 1:], '/') AS tail FROM wp, range(1, 10) r(k) WHERE k <= len(parts)),
    h AS (SELECT location, path, size, max(size) OVER (PARTITION BY location) AS best FROM wt JOIN ft USING (size, tail)), g AS (SELECT location, min(path) AS lo, max(path) AS hi, max(best) AS best FROM h WHERE size = best GROUP BY location)
    SELECT location, CASE WHEN lo IS NULL THEN 'not-found' WHEN lo = hi THEN 'ok' ELSE 'ambiguous' END AS state, CASE WHEN lo = hi THEN lo END AS path, CASE WHEN best > 1 THEN 'tail' WHEN best = 1 THEN 'name' END AS step FROM w LEFT JOIN g USING (location)""",
    "crate_eligibility": f"""WITH {BIG}, {CRATES}, {ITEMS}, o AS (SELECT *, lower(genre) AS g, CASE WHEN NOT file_ok THEN 'no-file' WHEN genre IS NULL THEN 'no-genre' WHEN state = 'analysing' THEN 'analysing' WHEN state = 'failed' THEN 'failed'
    WHEN part % 29 = 0 THEN 'not-analysed' WHEN duration < 90 THEN 'not-a-track' END AS base FROM items), gs AS (SELECT DISTINCT crate_id, g AS genre_key FROM o WHERE g IS NOT NULL),
    e AS (SELECT o.*, genre_key, CASE WHEN g <> genre_key THEN 'other-genre' ELSE base END AS f FROM o JOIN gs USING (crate_id)),
    d AS (SELECT *, CASE WHEN f IS NOT NULL THEN f WHEN row_number() OVER (PARTITION BY crate_id, genre_key, f IS NULL, part ORDER BY position, item_id) > 1 THEN 'duplicate' END AS reason FROM e),
    s AS (SELECT crate_id, genre_key, count(*) AS total, count(*) FILTER (reason IS NULL) AS enter, {", ".join(f"count(*) FILTER (reason = '{r}') AS {r.replace('-', '_')}" for r in REASONS)} FROM d GROUP BY ALL)
    SELECT *, max(enter) OVER (PARTITION BY crate_id) >= 2 AS ok FROM s""",
    "set_ratings": """WITH n AS (SELECT l_orderkey AS set_id, count(*) - 1 AS transitions FROM lineitem GROUP BY ALL),
    r AS (SELECT l_orderkey AS set_id, min(CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'fair' ELSE 'bad' END) AS rating FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL),
    c AS (SELECT set_id, transitions, (rating IS NOT DISTINCT FROM 'ok')::BIGINT AS ok, (rating IS NOT DISTINCT FROM 'fair')::BIGINT AS fair, (rating IS NOT DISTINCT FROM 'bad')::BIGINT AS bad FROM n LEFT JOIN r USING (set_id))
    SELECT *, transitions - ok - fair - bad AS unrated FROM c""",
    "set_listing": f"""WITH {BIG}, {CRATES}, o AS (SELECT crate_id, path, duration, row_number() OVER (PARTITION BY crate_id ORDER BY position, part, file_ok) AS i FROM crates)
    SELECT crate_id AS set_id, count(*) AS steps, min_by(path, i) AS seed, count(*) FILTER (duration < 90) AS missing FROM o GROUP BY crate_id""",
    "crate_copies": f"""WITH {BIG}, {CRATES}, {ITEMS}, w AS (SELECT crate_id % 500 AS new_crate, crate_id, item_id, crate_id % 50 = 0 AND item_id % 7 = 0 AS wrong FROM items WHERE item_id % 3 = 0),
    g AS (SELECT new_crate FROM w GROUP BY new_crate HAVING NOT bool_or(wrong)) SELECT new_crate AS crate_id, item_id, row_number() OVER (PARTITION BY new_crate ORDER BY item_id) AS position FROM w JOIN g USING (new_crate)""",
    "crate_additions": f"""WITH {BIG}, {CRATES}, {ITEMS}, s AS (SELECT crate_id, item_id, position, part, CASE WHEN file_ok THEN path END AS path, title || '|' || coalesce(artist, '') AS name FROM items),
    n AS (SELECT crate_id, item_id AS seq, part + item_id % 2 AS n FROM s), p AS (SELECT crate_id, seq, n, {item("n")} FROM n),
    i AS (SELECT crate_id, seq, CASE WHEN n % 4 <> 0 THEN path END AS file, title || '|' || coalesce(artist, '') AS name FROM p),
    f AS (SELECT DISTINCT crate_id, path AS file FROM s WHERE path IS NOT NULL), m AS (SELECT DISTINCT ON (crate_id, name) crate_id, name, item_id, path IS NOT NULL AS filed FROM s ORDER BY crate_id, name, position, item_id),
    o AS (SELECT i.*, m.item_id, CASE WHEN f.file IS NOT NULL THEN 'known' WHEN m.item_id IS NOT NULL AND NOT (i.file IS NOT NULL AND filed) THEN CASE WHEN i.file IS NULL THEN 'known' ELSE 'completed' END END AS done
        FROM i LEFT JOIN f ON f.crate_id = i.crate_id AND f.file = i.file LEFT JOIN m ON m.crate_id = i.crate_id AND m.name = i.name),
    d AS (SELECT *, done IS NULL AND row_number() OVER (PARTITION BY crate_id, done IS NULL, coalesce(file, '|' || name) ORDER BY seq) = 1 AS new FROM o),
    c AS (SELECT crate_id, item_id, upper(arg_min(file, seq)) AS got FROM d WHERE done = 'completed' GROUP BY ALL), l AS (SELECT crate_id, max(position) AS last FROM s GROUP BY crate_id)
    SELECT s.crate_id, s.item_id, s.position::BIGINT AS position, coalesce(path, got) AS path FROM s LEFT JOIN c ON c.crate_id = s.crate_id AND c.item_id = s.item_id
    UNION ALL SELECT crate_id, seq + 1000000000, last + row_number() OVER (PARTITION BY crate_id ORDER BY seq), upper(file) FROM d JOIN l USING (crate_id) WHERE new""",
    "crate_edits": f"""WITH {BIG}, {CRATES}, {ITEMS}, s AS (SELECT *, NOT file_ok AND part % 3 = 0 AS got, genre IS NULL AND crate_id % 2 = 0 AS filled FROM items)
    SELECT crate_id, item_id, CASE WHEN item_id % 5 = 0 THEN 0 ELSE position END AS position, CASE WHEN got THEN '/got/' || part || '.mp3' WHEN file_ok THEN path END AS path, CASE WHEN got THEN 'mp3' END AS format, CASE WHEN got THEN 'A' END AS grade,
    CASE WHEN part % 10 <> 0 THEN duration WHEN got THEN round_even(part % 200 + 0.5, 0)::DOUBLE END AS duration, CASE WHEN filled THEN 'Deep House' ELSE genre END AS genre, filled AS genre_edited FROM s""",
    "tag_audit": """WITH n(name, n) AS (SELECT unnest(['no artist', 'no title', 'no genre', 'no bpm', 'no key', 'junk in tags', 'junk in name', 'artist in title', 'key own', 'key mixed', 'key serato', 'key external', 'key unknown', 'key none']),
    unnest([count(*) FILTER (p_partkey % 4 = 0), count(*) FILTER (p_partkey % 5 = 0), count(*) FILTER (p_partkey % 2 = 0), count(*) FILTER (p_partkey % 3 <> 0), count(*) FILTER (p_partkey % 7 = 0), count(*) FILTER (p_partkey % 5 = 1), count(*) FILTER (p_partkey % 6 = 0),
    count(*) FILTER (p_partkey % 5 IN (0, 2)), count(*) FILTER (p_partkey % 7 = 6), count(*) FILTER (p_partkey % 7 = 3), count(*) FILTER (p_partkey % 7 = 2), count(*) FILTER (p_partkey % 7 = 4), count(*) FILTER (p_partkey % 7 IN (1, 5)), count(*) FILTER (p_partkey % 7 = 0)]) FROM part)
    SELECT name, n, round(100::DOUBLE * n / (SELECT count(*) FROM part), 6) AS percent FROM n""",
    "review_counts": f"""WITH {BIG}, r AS (SELECT list_filter([CASE WHEN p_partkey % 8 = 0 THEN 'suspicious' END, CASE WHEN p_partkey % 9 = 0 AND p_partkey > 0 THEN 'duplicate' END, CASE WHEN artist IS NULL OR p_partkey % 14 = 0 THEN 'nameless' END,
    CASE WHEN duration < 90 THEN 'not-a-track' END], lambda x: x IS NOT NULL) AS reasons FROM big), e AS (SELECT unnest(reasons) AS name FROM r)
    SELECT 'state' AS kind, CASE WHEN len(reasons) = 0 THEN 'approved' ELSE 'pending' END AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'reason', name, count(*) FROM e GROUP BY ALL""",
    "doubt_notes": f"""WITH {BIG}, n AS (SELECT *, CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN agreement IS NULL OR agreement = '0/3' THEN 'key ?' WHEN agreement <> '3/3' THEN 'key ' || agreement END AS note, CASE WHEN p_partkey % 8 = 7 THEN '1A' ELSE key END AS vote FROM big)
    SELECT path, CASE WHEN note IS NULL THEN '' WHEN p_partkey % 3 = 0 THEN 'mine | ' || note ELSE note END AS comment,
    CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN agreement <> '3/3' THEN 'differ' WHEN vote = key THEN 'same' ELSE 'other' END AS votes FROM n""",
    "applied_decisions": """SELECT CASE WHEN p_partkey % 10 = 0 THEN 'discarded' WHEN p_partkey % 10 = 1 THEN 'pending' WHEN p_partkey % 13 = 0 THEN 'missing' ELSE 'copied' END AS what, count(*) AS n FROM part GROUP BY ALL""",
    "export_plan": f"""WITH {BIG}, {CRATES}, {MARKS}, {ITEMS}, c AS (SELECT path, count(*) AS marks FROM marks GROUP BY path),
    s AS (SELECT crate_id, path, coalesce(marks, 0) AS marks, file_ok AND state = 'analysed' AND part % 5 <> 0 AND part % 6 <> 0 AS ready FROM items LEFT JOIN c USING (path)),
    f AS (SELECT crate_id, path, max(marks) AS marks, count(*) FILTER (ready) AS n FROM s WHERE ready GROUP BY ALL)
    SELECT crate_id, CASE WHEN count(f.path) > 0 THEN count(f.path)::INT END AS entries, coalesce(sum(f.n), 0)::BIGINT AS ready, any_value(a.n)::BIGINT - coalesce(sum(f.n), 0)::BIGINT AS left_out, coalesce(sum(f.marks), 0)::BIGINT AS marks
    FROM (SELECT crate_id, count(*) AS n FROM s GROUP BY crate_id) a LEFT JOIN f USING (crate_id) GROUP BY crate_id""",
    "similar_lists": f"""WITH {BIG}, {CRATES}, {ITEMS}, r AS (SELECT c_nationkey::BIGINT AS seed_id, c_custkey AS artist_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS artist_place FROM customer),
    a AS (SELECT o_custkey AS artist_id, o_orderkey AS album_id, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS album_place FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-06-01'),
    m AS (SELECT seed_id, artist_place, album_place, position, item_id, part, bpm, key FROM r JOIN a USING (artist_id) JOIN items ON crate_id = album_id WHERE album_place <= 2 AND position <= 3 AND item_id <> seed_id * 10 AND part % 9 <> 0),
    u AS (SELECT DISTINCT ON (seed_id, part % 40, part % 300) * FROM m ORDER BY seed_id, part % 40, part % 300, artist_place, album_place, position, item_id),
    k AS (SELECT *, part % 4 <> 1 AS fits, count(*) FILTER (part % 4 <> 1) OVER (PARTITION BY seed_id) AS n FROM u),
    q AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY artist_place, album_place, position, item_id) AS rank FROM k WHERE fits OR n < 6),
    z AS (SELECT *, {six(f"(CASE WHEN {relation(_EIGHT, 'key')} = 'same' THEN 0 WHEN {relation(_EIGHT, 'key')} IN ('neighbour', 'relative') THEN 1 ELSE 2 END) * 1000 + least(CASE WHEN bpm > 0 THEN least(abs(100 + seed_id - bpm), abs(100 + seed_id - bpm * 2), abs(100 + seed_id - bpm * 0.5::DOUBLE)) ELSE 999 END, 40::DOUBLE) * 10 - CASE WHEN album_place = 1 THEN 5 ELSE 0 END")} AS score FROM q WHERE rank <= 30),
    y AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score, rank) AS place FROM z) SELECT seed_id, place, item_id AS track_id, score FROM y WHERE place <= 25""",
    "migrated_library": f"""WITH {BIG}, o AS (SELECT path, CASE WHEN p_partkey % 7 >= 1 THEN (p_partkey % 7 - 1)::DOUBLE END AS rms, p_partkey % 11 AS analysed_at FROM big UNION ALL SELECT upper(path), 5, p_partkey % 13 FROM big WHERE p_partkey % 3 = 0)
    SELECT DISTINCT ON (lower(path)) lower(path) AS path_key, path, rms, analysed_at, NULL::VARCHAR AS agreement FROM o ORDER BY lower(path), analysed_at DESC, path DESC""",
    "rebuilt_marks": f"""WITH {BIG}, {MARKS} SELECT CASE WHEN num NOT BETWEEN 0 AND 7 THEN 'pad-range' WHEN kind = 'loop' AND end_ms <= start_ms THEN 'end-before-start' ELSE 'kept' END AS rule, count(*) AS marks FROM marks GROUP BY ALL""",
    "cache_kept": f"""WITH {BIG}, e AS (SELECT path, p_partkey * 37 % 500 AS mtime, row_number() OVER (ORDER BY p_partkey * 37 % 500 DESC, path) AS place, count(*) OVER () AS n FROM big) SELECT path, mtime FROM e WHERE n <= 1000 OR place <= 900""",
    "signal_features": f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings), p(mode, profile, first) AS (VALUES ('B', {_tones(signal.MAJOR_PROFILE)}, 8), ('A', {_tones(signal.MINOR_PROFILE)}, 5)),
    e AS (SELECT vec_id, ((first + 7 * t - 1) % 12 + 1)::VARCHAR || mode AS key, corr(abs(y[(t + j) % 12 + 1]), profile[j + 1]) AS score FROM c, p, range(12) a(t), range(12) b(j) GROUP BY ALL),
    k AS (SELECT vec_id, arg_max(key, (score, key)) AS key, round_even(greatest(max(score), 0), 3) AS confidence FROM e GROUP BY vec_id)
    SELECT vec_id, key, confidence, round(sqrt(list_sum(list_transform(y, lambda x: x * x)) / len(y)), 6) AS rms, round(list_max(y[17:24]), 6) AS peak,
    round(list_sum(list_transform(y[2:], lambda x, i: greatest(x - y[i], 0::DOUBLE))), 6) AS rise FROM c JOIN k USING (vec_id)""",
    "shown_values": f"""WITH {BIG} SELECT path, round_even(bpm / 8::DOUBLE * 1000, 0)::BIGINT AS ms, CASE WHEN p_partkey > 0 THEN round(p_partkey * 250 / 1000::DOUBLE, 1) END AS seconds, round_even(p_partkey % 200 / 200::DOUBLE * 100, 0)::INT AS percent,
    CASE p_partkey % 3 WHEN 1 THEN '{values.LOOP_COLOUR}' WHEN 2 THEN ({list(values.PAD_COLOURS)})[p_partkey % 8 + 1] END AS colour,
    lpad((p_partkey % 100)::VARCHAR, 3, ' ') || '  ' || lpad(printf('%.1f', bpm), 6, ' ') || '  ' || rpad(key, 3, ' ') || '  ' || lpad(round_even(p_partkey % 200 / 200::DOUBLE * 100, 0)::INT::VARCHAR, 3, ' ') || '%  ' || title AS line,
    CASE WHEN artist IS NULL THEN 'x - ' || title ELSE title END AS alone, 'C:/a b+c/' || p_partkey || '.mp3' AS local, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a/' || title ELSE 'b/' || title END AS relative FROM big""",
}
