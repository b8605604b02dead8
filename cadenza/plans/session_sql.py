"""The queries of ``sessions`` once more in SQL."""

from __future__ import annotations

from cadenza.plans.oracle import BIG, COMPARED, CONTEXT, CRATES, LIBRARY, MARKS, _classic, number, six

_CLASSIC = _classic()
_JOBS = """items AS (SELECT *, part % 4 AS mtime FROM crates),
    states AS (SELECT path, p_partkey % 4 + CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END AS mtime, CASE WHEN p_partkey % 3 = 1 THEN 'analysed' ELSE 'failed' END AS state FROM big WHERE p_partkey % 3 <> 0)"""
_STAGES = f"""staged AS (SELECT *, CASE WHEN key_exact IS NULL THEN 'no-reference' WHEN unanimous IS NULL THEN 'no-agreement' WHEN NOT unanimous THEN 'not-unanimous'
    WHEN key_exact THEN 'same-key' WHEN {number("key_est")} IS NULL THEN 'no-key' ELSE 'candidate' END AS stage FROM compared)"""


def _name(c: str) -> str:
    return f"({_CLASSIC.replace('CASE a', f'CASE {c}')})"


def _mode(a: str, b: str) -> str:
    x, y = _name(a), _name(b)
    return f"coalesce(regexp_replace({x}, 'm$', '') = regexp_replace({y}, 'm$', '') AND ends_with({x}, 'm') <> ends_with({y}, 'm'), false)"


_MARK = """'<POSITION_MARK Type="' || CASE WHEN kind = 'loop' THEN '4' ELSE '0' END || '" Num="' || coalesce(num::VARCHAR, '-1') || '" Start="' || printf('%.3f', start_ms / 1000::DOUBLE) ||
    CASE WHEN end_ms IS NOT NULL THEN '" End="' || printf('%.3f', end_ms / 1000::DOUBLE) ELSE '' END || '"/>'"""
_TRACK = f"""' Name="' || title || '"' || CASE WHEN artist IS NULL THEN '' ELSE ' Artist="' || artist || '"' END || CASE WHEN bpm > 0 THEN ' AverageBpm="' || printf('%.1f', bpm) || '"' ELSE '' END ||
    CASE WHEN key = '?' THEN '' ELSE ' Tonality="' || {_CLASSIC.replace("CASE a", "CASE key")} || '"' END || ' TotalTime="' || duration::INT || '" Location="' || path || '"'"""

SQL: dict[str, str] = {
    "playlist_routes": """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS parent, 'N' || p_partkey AS name FROM part),
    r AS (SELECT node, name AS route FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, r.route || ' / ' || n.name FROM n JOIN r ON n.parent = r.node) SELECT node, route FROM r""",
    "playlist_summaries": f"""WITH {BIG}, t AS (SELECT p_partkey AS id, path FROM big WHERE p_partkey % 5 <> 0),
    l AS (SELECT l_partkey AS node, l_orderkey % 3 AS kind, l_orderkey % 2000 AS n FROM lineitem),
    m AS (SELECT node, kind, n, id FROM l LEFT JOIN t ON kind < 2 AND id = n),
    x AS (SELECT node, kind < 2 AND (id IS NOT NULL OR kind = 0) AS known, CASE WHEN id IS NULL THEN 'missing' WHEN id % 7 = 0 THEN 'ambiguous' ELSE 'ok' END AS state FROM m)
    SELECT node, count(*) FILTER (known) AS total, count(*) FILTER (known AND state = 'ok') AS found, count(*) FILTER (known AND state = 'ambiguous') AS ambiguous, count(*) FILTER (known AND state = 'missing') AS missing,
    count(*) FILTER (NOT known) AS unknown FROM x GROUP BY node""",
    "merged_agreement": f"""WITH {BIG} SELECT path, key, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 9 <> 0 THEN agreement END AS agreement,
    CASE WHEN p_partkey % 10 = 0 THEN 'unpaired' WHEN p_partkey % 9 = 0 THEN 'repeated' ELSE 'merged' END AS outcome FROM big""",
    "selection_funnel": f"""WITH {BIG}, {COMPARED}, {_STAGES} SELECT stage, count(*) AS n FROM staged GROUP BY stage
    UNION ALL SELECT CASE state WHEN 'ambiguous' THEN 'ambiguous' ELSE 'without-truth' END, count(*) FROM states WHERE state IN ('ambiguous', 'only-measured') GROUP BY ALL""",
    "doubt_study": f"""WITH {BIG}, {COMPARED} SELECT coalesce(m.agreement, 'none') AS agreement, NOT coalesce(any_value(split_part(m.agreement, '/', 1) = split_part(m.agreement, '/', 2)), false) AS doubtful, count(*) AS n, count(key_exact) AS n_ref,
    round(100 * avg(key_exact::INT), 6) AS exact, round(100 * avg(CASE WHEN key_exact IS NOT NULL THEN key_compatible::INT END), 6) AS compatible FROM measured m LEFT JOIN compared USING (file) GROUP BY ALL""",
    "stored_standards": f"""WITH {LIBRARY}, {CONTEXT} SELECT path, {six("v[1]")} AS v0, {six("v[32]")} AS v31, {six("v[64]")} AS v63 FROM unit""",
    "long_editions": """WITH s AS (SELECT p_partkey AS part, 'Song ' || p_partkey AS song, p_partkey % 3 AS w, p_partkey // 3 % 4 AS c FROM part)
    SELECT part, song || ['', ' (Radio Edit)', ' (Omnya Remix)'][w + 1] AS w_title, song || [' (Extended Mix)', ' (Omnya Remix Extended)', ' (Original Mix)', ''][c + 1] AS c_title,
        part % 7 <> 0 AND CASE w WHEN 2 THEN c = 1 ELSE c IN (0, 2) END AS extended FROM s""",
    "genre_matches": f"""WITH {BIG}, {CRATES}, a AS (SELECT *, ['genre 1', 'GENRE', 'title 1', 'jazz'][crate_id % 4 + 1] AS asked FROM crates),
    l AS (SELECT asked, CASE WHEN genre IS NULL OR contains(lower(genre), lower(asked)) OR contains(lower(asked), lower(genre)) THEN 1::DOUBLE WHEN contains(title, lower(asked)) THEN 0.7::DOUBLE END AS likeness FROM a)
    SELECT asked, likeness, count(*) AS n FROM l WHERE likeness IS NOT NULL GROUP BY ALL""",
    "listening_sample": f"""WITH {BIG}, {COMPARED}, {_STAGES}, c AS (SELECT '/lib/' || file AS measured_path, key_est, key_ref FROM staged WHERE stage = 'candidate')
    SELECT measured_path, key_est, key_ref, {_mode("key_est", "key_ref")} AS mode_error FROM c ORDER BY md5('7:' || measured_path), measured_path LIMIT 40""",
    "mode_errors": f"WITH {BIG}, k AS (SELECT DISTINCT key FROM big) SELECT a.key, b.key AS other, {_name('a.key')} AS name FROM k a JOIN k b ON a.key <> b.key WHERE {_mode('a.key', 'b.key')}",
    "pending_sessions": f"""WITH {BIG}, s AS (SELECT path, p_partkey FROM big ORDER BY md5('11:' || path), path LIMIT 500), w AS (SELECT path, p_partkey, unnest(['with-votes', 'without-votes']) AS label FROM s)
    SELECT label, path FROM w WHERE (p_partkey + length(label)) % 3 <> 0""",
    "vote_shares": """WITH v AS (SELECT l_orderkey, (l_suppkey % 3 + 1)::VARCHAR || 'A' AS vote, count(*) AS n FROM lineitem GROUP BY ALL),
    a AS (SELECT l_orderkey, max(n) AS won, sum(n) AS total, string_agg(repeat(vote || '|', n::INT), '' ORDER BY vote) AS votes FROM v GROUP BY l_orderkey)
    SELECT l_orderkey, round(won / total::DOUBLE, 6) AS share, won::VARCHAR || '/' || total::BIGINT::VARCHAR AS agreement, rtrim(votes, '|') AS votes FROM a""",
    "worst_offenders": f"""WITH {BIG}, {COMPARED} SELECT '/lib/' || file AS measured_path, bpm_error_tolerant AS error FROM compared WHERE bpm_error_tolerant IS NOT NULL ORDER BY bpm_error_tolerant DESC, measured_path LIMIT 20""",
    "station_tracks": """WITH r AS (SELECT l_orderkey AS station, l_linenumber * 1000000 + l_partkey AS place, l_partkey AS i FROM lineitem WHERE l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 AND l_partkey <> l_orderkey % 200),
    f AS (SELECT station, i, min(place) AS place FROM r GROUP BY ALL)
    SELECT station, row_number() OVER (PARTITION BY station ORDER BY place)::INT AS place, i::VARCHAR AS track_id, 'title ' || i AS title, round(i / 10::DOUBLE, 1) AS duration,
    i % 5 <> 0 AND i % 4 <> 0 AS playable, (i % 6 = 0 AND i % 5 <> 0) OR i % 7 = 0 AS preview FROM f""",
    "candidate_pools": """SELECT p_partkey AS track_id, CASE WHEN p_partkey % 5 = 0 THEN 'near' WHEN p_partkey % 3 = 0 THEN 'genre' ELSE 'tempo' END AS source FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0 OR p_partkey % 2 = 0""",
    "reference_paths": f"""WITH {BIG} SELECT lower(path) AS path, CASE WHEN p_partkey % 6 = 0 THEN 'A and B' WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS sources FROM big WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "artist_repeats": f"""WITH {BIG}, {CRATES} SELECT crate_id, position * 1000000 + part AS place, coalesce(list_contains(list(artist) OVER (PARTITION BY crate_id ORDER BY position, part ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), artist), false) AS repeated FROM crates""",
    "set_redundancy": f"""WITH {LIBRARY}, u AS (SELECT vec_id, vec_id // 10 AS set_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM library),
    n AS (SELECT vec_id, set_id, v, sqrt(list_dot_product(v, v)) AS norm FROM u),
    p AS (SELECT a.set_id, a.vec_id, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS s FROM n a JOIN n b ON a.set_id = b.set_id AND b.vec_id < a.vec_id AND b.vec_id > (SELECT min(c.vec_id) FROM n c WHERE c.set_id = a.set_id))
    SELECT n.set_id, n.vec_id, {six("greatest(coalesce(max(s), 0), 0)")} AS redundancy FROM n LEFT JOIN p USING (set_id, vec_id) GROUP BY n.set_id, n.vec_id""",
    "signal_windows": f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
    s AS (SELECT vec_id, x, list_transform(range(len(x)), lambda i: list_max(x[i + 1:i + 4])) AS after,
    list_transform(list_filter(list_transform(range(0, floor((len(x) / 10::DOUBLE - 0.2::DOUBLE) / 0.5::DOUBLE)::INT + 1), lambda j: round_even((0.2::DOUBLE + 0.5::DOUBLE * j - 0.1::DOUBLE) * 10, 0)::INT), lambda i: i >= 0 AND i + 4 <= len(x)), lambda i: list_max(x[i + 1:i + 4])) AS line FROM x)
    SELECT vec_id, {six("list_sum(after)")} AS after, len(line)::INT AS lines, {six("list_sum(line)")} AS line_sum FROM s""",
    "largest_lines": """WITH e AS (SELECT l_suppkey, quantile_cont(l_quantity::DOUBLE, 0.8) AS edge FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity::DOUBLE AS weight FROM lineitem JOIN e USING (l_suppkey) WHERE l_quantity >= edge""",
    "job_queue": f"WITH {BIG}, {CRATES}, {_JOBS} SELECT DISTINCT path, mtime FROM items ANTI JOIN states USING (path, mtime) WHERE file_ok",
    "job_progress": f"""WITH {BIG}, {CRATES}, {_JOBS} SELECT crate_id, count(*) AS total, count(*) FILTER (file_ok AND s.state = 'analysed') AS done, count(*) FILTER (file_ok AND s.state = 'failed') AS failed,
    count(*) FILTER (file_ok AND s.state IS NULL) AS waiting, count(*) FILTER (NOT file_ok) AS no_file FROM items i LEFT JOIN states s ON s.path = i.path AND s.mtime = i.mtime GROUP BY crate_id""",
    "last_failures": f"WITH {BIG}, {CRATES}, {_JOBS} SELECT path, mtime FROM states WHERE state = 'failed' ORDER BY mtime DESC, path LIMIT 5",
    "crate_receipts": f"""WITH {BIG}, {CRATES} SELECT crate_id, count(*) FILTER (file_ok) AS included, count(*) FILTER (NOT file_ok) AS excluded,
    coalesce(string_agg(title, '|' ORDER BY position, title) FILTER (file_ok AND part % 5 >= 3), '') AS low, coalesce(sum(duration) FILTER (file_ok), 0)::BIGINT AS seconds FROM crates GROUP BY crate_id""",
    "collection_files": f"""WITH {BIG}, {CRATES}, {MARKS}, m AS (SELECT path, string_agg({_MARK}, '' ORDER BY start_ms, num NULLS FIRST, kind, end_ms NULLS FIRST) AS marks FROM marks GROUP BY path),
    d AS (SELECT DISTINCT crate_id, path, title, artist, bpm, key, duration FROM crates), n AS (SELECT *, row_number() OVER (PARTITION BY crate_id ORDER BY path) AS number FROM d),
    t AS (SELECT crate_id, count(*) AS n, string_agg('<TRACK TrackID="' || number || '"' || {_TRACK} || CASE WHEN marks IS NULL THEN '/>' ELSE '>' || marks || '</TRACK>' END, '' ORDER BY number) AS tracks FROM n LEFT JOIN m USING (path) GROUP BY crate_id),
    l AS (SELECT crate_id, count(*) AS n, string_agg('<TRACK Key="' || number || '"/>', '' ORDER BY position, number) AS keys FROM crates JOIN n USING (crate_id, path) GROUP BY crate_id),
    x AS (SELECT crate_id, '<?xml version="1.0" encoding="UTF-8"?><DJ_PLAYLISTS Version="1.0.0"><PRODUCT Name="Cadenza"/><COLLECTION Entries="' || t.n || '">' || tracks || '</COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT" Count="1"><NODE Name="' || crate_id ||
    '" Type="1" KeyType="0" Entries="' || l.n || '">' || keys || '</NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>' AS xml FROM t JOIN l USING (crate_id)) SELECT crate_id, length(xml)::INT AS chars, sha256(xml) AS sha FROM x""",
    "row_faults": """WITH f AS (SELECT 'agreement' AS rule, CASE WHEN p_partkey % 12 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN 'half-absent' WHEN p_partkey % 6 = 2 THEN 'form' WHEN p_partkey % 6 = 1 THEN 'more-than-all' WHEN p_partkey % 6 = 5 THEN 'votes-differ' END AS fault FROM part
    UNION ALL SELECT 'rating', CASE WHEN p_partkey % 4 = 3 THEN 'rating' WHEN p_partkey % 8 = 2 THEN 'no-reason' END FROM part) SELECT rule, fault, count(*) AS n FROM f GROUP BY ALL""",
    "row_texts": """WITH r AS (SELECT p_partkey AS i, 10000 + p_partkey % 12000 AS hz, CASE WHEN p_partkey % 5 = 0 THEN '/' ELSE '' END AS e FROM part)
    SELECT i AS p_partkey, CASE WHEN i % 2 = 0 THEN CASE WHEN hz >= 20000 THEN 'lossy-320' WHEN hz >= 19500 THEN 'lossy-256' WHEN hz >= 18000 THEN 'lossy-192' WHEN hz >= 15500 THEN 'lossy-128' ELSE 'lossy-96' END
    WHEN hz >= 20000 THEN 'full' WHEN hz >= 16000 THEN 'soft' ELSE 'poor' END AS verdict, i % 3 <> 2 AS confined, CASE i % 3 WHEN 0 THEN 'd:/music/' WHEN 1 THEN '/lib/a/' ELSE '/library/../lib/' END || i AS restored,
    CASE WHEN i % 9 = 0 THEN 'no-path' ELSE (['not-found', 'ok', 'ambiguous', 'ambiguous'])[i % 4 + 1] END AS state, CASE WHEN i % 8 <> 0 THEN 'a b ' || i END AS name,
    printf('%.2f', (i % 100) / 64::DOUBLE) || CASE WHEN i % 20 < 12 THEN ' (orientative)' ELSE '' END AS curve FROM r""",
}
