"""The named queries in SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from .config import CORRECTION_REGEX, ClusterConfig

G = "/g/CLAUDE.md"

_EV = """
ev0 AS (SELECT CAST(user_id AS VARCHAR) AS session_id, user_id, event_id, event_type AS type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
ev AS (SELECT *, CASE WHEN user_id % 7 <> 0 AND turn > 1 THEN '/home/p' || (user_id % 12) END AS cwd FROM ev0),
tu AS (SELECT session_id, turn, ts, CAST(event_id AS VARCHAR) AS tuid, CASE WHEN k % 3 = 0 THEN 'Read' ELSE 'op' || (k % 10) END AS tool, CASE WHEN k % 4 = 1 THEN '1' END AS rd_offset, '{"k":' || (k % 10) || '}' AS input_str FROM ev),
tr AS (SELECT session_id, turn, ts, CAST(event_id AS VARCHAR) AS tuid, type = 'error' AS is_error, CAST(floor(value * 10) AS BIGINT) AS total_lines FROM ev),
rt AS (SELECT session_id, turn, type, 'k' || k || ' of ' || session_id AS excerpt FROM ev),
sm AS (SELECT session_id, min(cwd) AS cwd, bool_or(k = 99) AS is_subagent FROM ev GROUP BY session_id),
am AS (SELECT session_id, cwd AS project, COALESCE(cwd || '/CLAUDE.md', '/g/CLAUDE.md') AS implicated_artifact, '/g/CLAUDE.md,' || COALESCE(cwd || '/CLAUDE.md', '/g/CLAUDE.md') AS candidates FROM sm),
te AS (SELECT md5(tr.session_id || ':' || tr.turn || ':tool_error') AS incident_id, tr.session_id, tr.ts, 'tool_error' AS signal_type, 'medium' AS confidence, tr.turn FROM tr JOIN tu USING (session_id, tuid) WHERE tr.is_error),
ie AS (SELECT md5(tu.session_id || ':' || tu.turn || ':inefficiency') AS incident_id, tu.session_id, tu.ts, 'inefficiency' AS signal_type,
  CASE WHEN total_lines >= 2000 THEN 'high' WHEN total_lines >= 1500 THEN 'medium' ELSE 'low' END AS confidence, tu.turn FROM tu JOIN tr USING (session_id, tuid) WHERE tool = 'Read' AND rd_offset IS NULL AND total_lines >= 1000),
re AS (SELECT DISTINCT md5(b.session_id || ':' || b.turn || ':retry') AS incident_id, b.session_id, b.ts, 'retry' AS signal_type, 'low' AS confidence, b.turn
  FROM tu a JOIN tr ra ON ra.session_id = a.session_id AND ra.tuid = a.tuid AND ra.is_error JOIN tu b ON b.session_id = a.session_id AND b.tool = a.tool AND b.input_str = a.input_str AND b.turn > a.turn AND b.turn - a.turn <= 5),
uc AS (SELECT md5(session_id || ':' || turn || ':user_correction') AS incident_id, session_id, ts, 'user_correction' AS signal_type, 'medium' AS confidence, turn FROM ev WHERE k % 11 = 5 AND turn > 1),
allof AS (SELECT * FROM te UNION ALL SELECT * FROM ie UNION ALL SELECT * FROM re UNION ALL SELECT * FROM uc),
inc AS (SELECT incident_id, session_id, project, ts, signal_type, implicated_artifact, candidates, confidence, turn FROM allof JOIN am USING (session_id)),
win AS (SELECT i.incident_id, string_agg(rt.turn || ':' || rt.type || ':' || rt.excerpt, '|' ORDER BY rt.turn) AS "window", string_agg(CASE WHEN rt.turn > least(i.turn + 4, mx.m) - 4 THEN rt.turn || ':' || rt.type || ':' || rt.excerpt END, '|' ORDER BY rt.turn) AS tail
  FROM inc i JOIN rt ON rt.session_id = i.session_id AND rt.turn BETWEEN i.turn - 3 AND i.turn + 4 JOIN (SELECT session_id, max(turn) AS m FROM ev GROUP BY session_id) mx ON mx.session_id = i.session_id GROUP BY i.incident_id),
ex AS (SELECT DISTINCT incident_id, session_id, ts, confidence, signal_type, unnest(string_split(candidates, ',')) AS artifact FROM inc),
ga AS (SELECT artifact, signal_type, count(DISTINCT session_id) AS distinct_sessions, count(DISTINCT incident_id) AS total_incidents FROM ex GROUP BY artifact, signal_type HAVING count(DISTINCT session_id) >= 3),
rk AS (SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS strength FROM ex JOIN ga USING (artifact, signal_type)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY artifact, signal_type, session_id ORDER BY strength DESC, ts, incident_id) AS rn_in_session FROM rk),
sa AS (SELECT *, row_number() OVER (PARTITION BY artifact, signal_type ORDER BY rn_in_session, strength DESC, ts, incident_id) AS pick FROM r1),
cl AS (SELECT signal_type || '::' || artifact AS cluster_id, signal_type, artifact, distinct_sessions, total_incidents, string_agg(incident_id, ',' ORDER BY pick) AS incidents, count(*) AS sampled_incidents
  FROM sa WHERE pick <= 20 GROUP BY signal_type, artifact, distinct_sessions, total_incidents)
"""

_BYTES = ClusterConfig().max_content_bytes
_CONTENT = f"""ct0 AS (SELECT '/home/p' || (doc_id * 2) || '/CLAUDE.md' AS artifact, text FROM documents),
ct AS (SELECT *, (SELECT max(i) FROM range(1, {_BYTES + 1}) r(i) WHERE octet_length(encode(substr(text, 1, i))) <= {_BYTES}) AS fit FROM ct0 WHERE artifact IN (SELECT artifact FROM cl)),
cut AS (SELECT artifact, CASE WHEN octet_length(encode(text)) <= {_BYTES} THEN text ELSE substr(text, 1, fit) || CASE WHEN octet_length(encode(substr(text, 1, fit))) < {_BYTES} THEN chr(65533) ELSE '' END || '{ClusterConfig().truncation_mark}' END AS content FROM ct)"""

_LINES = """
c AS (SELECT *, CAST(conv_id AS VARCHAR) AS session_id, 'c' || conv_id || '-' || turn AS uuid, lpad(CAST(turn AS VARCHAR), 6, '0') AS ts, (conv_id * 7 + turn) % 40 * 100 AS total_lines, '"/f/' || ((conv_id + turn) % 5) || '"' AS file FROM conversations),
n AS (SELECT * EXCLUDE (turn), turn AS said_at, row_number() OVER (PARTITION BY session_id ORDER BY ts, uuid) AS turn, CASE WHEN conv_id % 7 <> 0 AND turn > 0 THEN '/home/p' || (conv_id % 12) END AS cwd, CASE WHEN role <> 'assistant' AND turn = 0 THEN 'string' ELSE 'array' END AS content_kind,
  '{"file_path":' || file || CASE WHEN turn % 4 = 3 THEN ',"offset":1' ELSE '' END || '}' AS input_str, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Bash' ELSE 'Read' END AS tool FROM c),
tu AS (SELECT session_id, turn, ts, uuid AS tuid, tool, trim(file, '"') AS file_path, CASE WHEN said_at % 4 = 3 THEN '1' END AS rd_offset, CAST(NULL AS VARCHAR) AS rd_limit, input_str FROM n WHERE role = 'assistant'),
tr AS (SELECT session_id, turn, ts, 'c' || conv_id || '-' || (said_at - 1) AS tuid, CASE WHEN conv_id % 5 <> 0 THEN (conv_id + said_at) % 4 = 0 END AS is_error, total_lines FROM n WHERE role = 'user' AND said_at > 0),
ut AS (SELECT session_id, turn, ts, content_kind, CASE WHEN content_kind = 'string' THEN text ELSE replace(text, chr(10), ' ') END AS text FROM n WHERE role = 'user'),
sm AS (SELECT session_id, arg_min(cwd, turn) FILTER (WHERE cwd IS NOT NULL) AS cwd, bool_or(conv_id % 9 = 4) AS is_subagent FROM n GROUP BY session_id),
am AS (SELECT *, COALESCE(cwd || '/CLAUDE.md', '/g/CLAUDE.md') AS implicated_artifact FROM sm),
ev AS (SELECT r.session_id, r.ts, 'tool_error' AS signal_type, 'medium' AS confidence, r.turn FROM tr r JOIN tu USING (session_id, tuid) WHERE is_error
  UNION SELECT u.session_id, u.ts, 'inefficiency', CASE WHEN total_lines >= 2000 THEN 'high' WHEN total_lines >= 1500 THEN 'medium' ELSE 'low' END, u.turn FROM tu u JOIN tr USING (session_id, tuid) WHERE tool = 'Read' AND rd_offset IS NULL AND total_lines >= 1000
  UNION SELECT b.session_id, b.ts, 'retry', 'low', b.turn FROM tu a JOIN tr ra ON ra.session_id = a.session_id AND ra.tuid = a.tuid AND ra.is_error JOIN tu b ON b.session_id = a.session_id AND b.tool = a.tool AND b.input_str = a.input_str AND b.turn > a.turn AND b.turn - a.turn <= 5
  UNION SELECT u.session_id, u.ts, 'user_correction', 'medium', u.turn FROM ut u WHERE (regexp_matches(lower(u.text), '{words}') OR lower(u.text) LIKE '%request interrupted%') AND EXISTS (SELECT 1 FROM tu a WHERE a.session_id = u.session_id AND a.turn < u.turn AND u.turn - a.turn <= 2))
""".replace("{words}", CORRECTION_REGEX.replace("'", "''"))


def _clean(x: str) -> str:
    """A path, cleaned: a fold over its parts."""
    last = "d[1 : len(d) - 1]"
    folded = f"list_reduce(list_transform(string_split({x}, '/'), lambda p: [p]), lambda d, p: CASE WHEN p[1] IN ('', '.') THEN d WHEN p[1] <> '..' THEN list_concat(d, p) WHEN len(d) > 0 AND d[len(d)] <> '..' THEN {last} WHEN starts_with({x}, '/') THEN d ELSE list_concat(d, p) END, CAST([] AS VARCHAR[]))"
    return f"COALESCE(NULLIF(CASE WHEN starts_with({x}, '/') THEN '/' ELSE '' END || array_to_string({folded}, '/'), ''), '.')"


_LEDGER = f"""
le AS (SELECT '/l/' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '.md' AS path, 'fix-' || (s_suppkey % 97) AS id,
  CASE WHEN s_suppkey % 4 = 0 THEN '/home/./x/../p' || (s_suppkey % 12) || '//CLAUDE.md' WHEN s_suppkey % 2 = 0 THEN '/home/p' || (s_suppkey % 12) || '/CLAUDE.md'
    ELSE '/repo/r' || (s_suppkey % 7) || CASE WHEN s_suppkey % 3 = 0 THEN '/src/..' ELSE '' END || '/docs/f' || ((s_suppkey + 1) % 31) || '.md#Section ' || (s_suppkey % 4) END AS artifact,
  list_value('tool_error', 'retry', 'inefficiency')[s_suppkey % 3 + 1] AS signal_type, list_value('open', 'closed', 'rejected', 'merged', '')[s_suppkey % 5 + 1] AS outcome_raw,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://github.com/own' || (s_suppkey % 4) || '/rep' || (s_suppkey % 2) || '/pull/' || s_suppkey END AS pr_url FROM supplier),
lc AS (SELECT *, {_clean("split_part(artifact, '#', 1)")} AS clean FROM le),
dk AS (SELECT DISTINCT clean AS artifact, signal_type FROM lc WHERE outcome_raw IN ('closed', 'rejected'))
"""

_PROPOSALS = """
pf AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '.json' AS path, 'fix-' || (o_orderkey % 997) AS id,
  CASE WHEN o_custkey % 41 = 0 THEN '' ELSE '/repo/r' || (o_custkey % 7) || '/docs/f' || (o_custkey % 31) || '.md' || CASE WHEN o_custkey % 3 = 0 THEN '#Section ' || (o_custkey % 4) ELSE '' END END AS implicated_artifact, o_orderstatus AS signal_type,
  list_value('add', 'strengthen', 'fix-stale', 'remove', 'escalate-out-of-instructions', 'skip', 'bogus', 'strengthen')[o_orderkey % 8 + 1] AS fix_type, o_orderkey % 13 <> 0 AS evidence,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'd' || o_orderkey END AS diagnosis, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'c' || o_orderkey END AS proposed_change, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'r' || o_orderkey END AS reason_log,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'unknown' END AS confidence FROM orders),
pe AS (SELECT *, CASE WHEN implicated_artifact = '' THEN 'missing implicated_artifact' WHEN fix_type = 'bogus' THEN 'invalid fix_type' WHEN confidence = 'unknown' THEN 'invalid confidence' WHEN NOT evidence THEN 'missing evidence' WHEN diagnosis = '' THEN 'missing diagnosis'
  WHEN proposed_change = '' AND fix_type <> 'skip' THEN 'missing proposed_change' WHEN reason_log = '' THEN 'missing reason_log' END AS error FROM pf),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS rn FROM pe WHERE error IS NULL) WHERE rn = 1),
fa AS (SELECT DISTINCT '/repo/r' || (c_custkey % 7) || '/docs/f' || (c_custkey % 31) || '.md' AS path, c_custkey % 31 % 5 <> 0 AS there, CASE WHEN c_custkey % 7 = 6 THEN '' ELSE '/repo/r' || (c_custkey % 7) END AS repo_root, 'git@github.com:own' || (c_custkey % 7) || '/x.git' AS url, 'main' AS base FROM customer
  UNION ALL SELECT '/settings', TRUE, '/settings', '', 'trunk'),
p1 AS (SELECT pr.*, fa.path AS real, there, repo_root AS root, url, base AS known_base, split_part(implicated_artifact, '#', 2) AS sec FROM pr LEFT JOIN fa ON fa.path = CASE WHEN fix_type = 'escalate-out-of-instructions' THEN '/settings' ELSE split_part(implicated_artifact, '#', 1) END),
p2 AS (SELECT *, CASE WHEN confidence = 'low' THEN 'skip-low-confidence' WHEN fix_type = 'skip' THEN 'skip-declined' WHEN fix_type = 'escalate-out-of-instructions' THEN 'ready' WHEN COALESCE(root, '') = '' THEN 'skip-unresolved'
  WHEN NOT there AND fix_type <> 'add' THEN 'skip-missing-file' ELSE 'ready' END AS status FROM p1),
p3 AS (SELECT id AS proposal_id, fix_type, status, '' AS reason, diagnosis, signal_type, status IN ('ready', 'skip-missing-file') AS placed, root, real, sec, url, known_base,
  trim(regexp_replace(lower(split_part(root, '/', -1) || '-' || CASE WHEN real LIKE root || '/%' THEN substr(real, length(root) + 2) ELSE split_part(real, '/', -1) END), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha1(root), 1, 8) AS gid FROM p2),
p4 AS (SELECT proposal_id, fix_type, status, reason, diagnosis, signal_type, CASE WHEN placed THEN root ELSE '' END AS repo_root, CASE WHEN placed THEN real ELSE '' END AS file_path, CASE WHEN placed THEN sec ELSE '' END AS section,
  CASE WHEN NOT placed THEN '' WHEN url LIKE '%own1%' THEN 'team-one' WHEN url LIKE '%own2%' THEN 'team-two' ELSE 'personal' END AS owner, CASE WHEN placed THEN known_base ELSE '' END AS base, CASE WHEN status = 'ready' THEN gid ELSE '' END AS group_id FROM p3),
pl AS (SELECT *, CASE WHEN status = 'ready' THEN CASE WHEN bool_or(fix_type = 'escalate-out-of-instructions') OVER (PARTITION BY repo_root, file_path, status = 'ready') THEN 'chore' ELSE 'docs' END || '/tallyrook-' || group_id ELSE '' END AS branch_name FROM p4)
"""

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_FLAT = "incident_id, session_id, project, ts, signal_type, implicated_artifact, candidates, confidence"
_PLAIN_WORD = CORRECTION_REGEX.replace("'", "''")


def _ev(body: str, *more: str) -> str:
    return "WITH " + ",".join([_EV, *more]) + body


_INCIDENTS = f"""WITH {_LINES} SELECT md5(e.session_id || ':' || e.turn || ':' || signal_type) AS incident_id, e.session_id, am.cwd AS project, e.ts, signal_type, implicated_artifact, '{G},' || implicated_artifact AS candidates, confidence, string_agg(n.turn || ':' || n.role, '|' ORDER BY n.turn) AS turns
  FROM ev e JOIN am USING (session_id) JOIN n ON n.session_id = e.session_id AND n.turn BETWEEN e.turn - 3 AND e.turn + 4 GROUP BY ALL"""

_TARGETS = f"""li AS (SELECT DISTINCT unnest(list_filter([{{'path': '/w/l' || (c_custkey % 5), 'real': CASE WHEN c_custkey % 5 < 4 THEN '/real/r' || (c_custkey % 5) END}}, {{'path': '/w', 'real': '/w'}},
    CASE WHEN c_custkey % 5 < 4 THEN {{'path': '/w/l' || (c_custkey % 5) || '/d' || (c_custkey % 2), 'real': '/real/r' || (c_custkey % 5) || '/d' || (c_custkey % 2)}} END,
    CASE WHEN c_custkey % 5 < 4 AND c_custkey % 2 = 0 AND c_custkey % 11 < 6 THEN {{'path': '/w/l' || (c_custkey % 5) || '/d0/n' || (c_custkey % 11) || '.md', 'real': '/real/r' || (c_custkey % 5) || '/d0/n' || (c_custkey % 11) || '.md'}} END], lambda x: x IS NOT NULL), recursive := true) FROM customer),
tg AS (SELECT DISTINCT list_value('/w/', '/w/./', '/w/x/../', '/v/')[o_custkey % 4 + 1] || 'l' || (o_custkey % 5) || '/d' || (o_custkey % 3) || '/n' || (o_custkey % 11) || '.md' AS path FROM orders),
tc AS (SELECT path, list_filter(string_split({_clean("path")}, '/'), lambda x: x <> '') AS p FROM tg),
an AS (SELECT path, k, len(p) - k AS below, '/' || array_to_string(p[1 : k], '/') AS at, array_to_string(p[k + 1 :], '/') AS rest FROM tc, unnest(range(0, len(p) + 1)) AS r(k)),
rs AS (SELECT an.path, arg_max({{'real': real, 'rest': rest, 'below': below}}, k) AS b FROM an JOIN li ON li.path = an.at WHERE below = 0 OR real IS NOT NULL GROUP BY an.path),
re AS (SELECT path, CASE WHEN b.rest = '' THEN b.real ELSE b.real || '/' || b.rest END AS real_path, COALESCE(b.below = 0, false) AS there FROM tg LEFT JOIN rs USING (path))"""

ORACLES: dict[str, str] = {
    "extract_files": _INCIDENTS,
    "incremental_incidents": _INCIDENTS,
    "path_clean": f"""SELECT *, {_clean("path")} AS clean FROM (SELECT p_partkey, list_value('/' || a || '/' || b || '/../c.md', './' || a, a || '/..', '/..', '//' || a || '///' || b || '/', '/' || a || '/./' || b || '/../../..//c', '../' || a || '/../../' || b, a || '/' || b || '/../..', '', '/', a || '//' || b || '/./', '/' || a || '/../' || b || '/c/..')[p_partkey % 12 + 1] AS path
  FROM (SELECT p_partkey, 'a' || (p_partkey % 7) AS a, 'b' || (p_partkey % 5) AS b FROM part))""",
    "path_resolve": f"WITH {_TARGETS} SELECT path, real_path, there FROM re",
    "path_facts": f"""WITH {_TARGETS}, rp AS (SELECT DISTINCT '/real/r' || (c_custkey % 4) AS root, CASE WHEN c_custkey % 4 = 3 THEN '/real/r0' ELSE '/real/r' || (c_custkey % 4) END AS main, 'git@h:o/r' || (c_custkey % 4) AS url, CASE WHEN c_custkey % 4 = 1 THEN 'trunk' ELSE 'main' END AS base FROM customer)
SELECT path, real_path, there AND real_path IS NOT NULL AS exists, COALESCE(main, '') AS repo_root, url AS origin_url, base FROM re LEFT JOIN rp ON starts_with(re.real_path, rp.root || '/')""",
    "windowed_rates": _ev("""SELECT implicated_artifact AS artifact, signal_type, w * 604800 AS start, count(*) AS incidents, round(count(*) / 7.0, 6) AS per_day FROM (SELECT *, CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 604800) AS BIGINT) AS w FROM inc) GROUP BY ALL"""),
    "merge_trend": _ev("""SELECT m.artifact, m.signal_type, m.url, mt AS merged_at, count(*) FILTER (WHERE s < mt) AS before, count(*) FILTER (WHERE s >= mt) AS after, round(count(*) FILTER (WHERE s >= mt) / NULLIF(count(*) FILTER (WHERE s < mt), 0), 6) AS ratio
  FROM (SELECT DISTINCT lc.clean AS artifact, lc.signal_type, lc.pr_url AS url, 1704067200 + s_suppkey % 29 * 86400 + s_suppkey % 24 * 3600 AS mt FROM lc JOIN supplier ON lc.pr_url = 'https://github.com/own' || (s_suppkey % 4) || '/rep' || (s_suppkey % 2) || '/pull/' || s_suppkey WHERE s_suppkey % 4 = 0) m
  LEFT JOIN (SELECT implicated_artifact AS artifact, signal_type, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS s FROM inc) i ON i.artifact = m.artifact AND i.signal_type = m.signal_type AND s >= mt - 9 * 86400 AND s < mt + 9 * 86400 GROUP BY ALL""", _LEDGER),
    "hooked": f"WITH {_PROPOSALS} SELECT id, CASE WHEN id LIKE '%7' THEN NULL ELSE CAST(length(diagnosis) AS BIGINT) END AS words, CASE WHEN id LIKE '%7' THEN 'ValueError: no answer' END AS error FROM pr WHERE id LIKE '%7' OR confidence <> 'low'",
    "turn_numbering": _ev("SELECT session_id, event_id, turn, k FROM ev"),
    "since_filter": _ev(f"SELECT {_FLAT} FROM inc WHERE signal_type = 'tool_error' AND ts >= '2024-01-15'"),
    "transcript_records": f"WITH {_LINES} SELECT session_id, turn, uuid, ts, role AS type, cwd, conv_id % 9 = 4 AS is_sidechain, content_kind, total_lines FROM n",
    "excerpt_projection": f"""WITH {_LINES} SELECT session_id, turn, role AS type, substr('{{"role":"' || role || '","content":' || CASE WHEN role = 'assistant' THEN '[{{"type":"text","text":' || to_json(text) || '}},{{"type":"tool_use","id":"' || uuid || '","name":"' || tool || '","input":' || input_str || '}}]'
  WHEN said_at = 0 THEN CAST(to_json(text) AS VARCHAR) ELSE '[{{"type":"tool_result","tool_use_id":"c' || conv_id || '-' || (said_at - 1) || '"' || CASE WHEN conv_id % 5 <> 0 THEN ',"is_error":' || CASE WHEN (conv_id + said_at) % 4 = 0 THEN 'true' ELSE 'false' END ELSE '' END || '}}' || list_aggregate(list_transform(string_split(text, chr(10)), lambda x: ',{{"type":"text","text":' || to_json(x) || '}}'), 'string_agg', '') || ']' END || '}}', 1, 300) AS excerpt FROM n""",
    "content_union": f"WITH {_LINES} SELECT session_id, turn, text FROM ut",
    "block_explode": f"WITH {_LINES} SELECT session_id, turn, tuid, tool, file_path, rd_offset, rd_limit, input_str FROM tu",
    "tool_result_blocks": f"WITH {_LINES} SELECT session_id, turn, tuid, is_error, total_lines FROM tr",
    "string_agg_per_turn": f"WITH {_LINES} SELECT session_id, turn, text FROM ut WHERE content_kind = 'array'",
    "transcript_sessions": f"WITH {_LINES} SELECT session_id, cwd, is_subagent, implicated_artifact FROM am",
    "transcript_incidents": _INCIDENTS,
    "session_meta": _ev("SELECT session_id, cwd, is_subagent FROM sm"),
    "artifact_candidates": _ev("SELECT session_id, implicated_artifact, candidates FROM am"),
    "tool_error": _ev('SELECT incident_id, session_id, project, ts, implicated_artifact, turn, "window" FROM inc JOIN win USING (incident_id) WHERE signal_type = \'tool_error\''),
    "tool_error_events": _ev(f"SELECT {_FLAT}, turn FROM inc WHERE signal_type = 'tool_error'"),
    "inefficiency_tiers": _ev(f"SELECT {_FLAT}, turn FROM inc WHERE signal_type = 'inefficiency'"),
    "retry_after_error": _ev(f"SELECT {_FLAT}, turn FROM inc WHERE signal_type = 'retry'"),
    "user_correction": f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS turn, lpad(CAST(turn AS VARCHAR), 6, '0') AS ts, role, text FROM conversations)
SELECT md5(u.session_id || ':' || u.turn || ':user_correction') AS incident_id, u.session_id, CAST(NULL AS VARCHAR) AS project, u.ts, 'user_correction' AS signal_type, '{G}' AS implicated_artifact, '{G},{G}' AS candidates, 'medium' AS confidence, u.turn, substr(u.text, 1, 200) AS text
FROM c u WHERE u.role = 'user' AND (regexp_matches(lower(u.text), '{_PLAIN_WORD}') OR lower(u.text) LIKE '%request interrupted%') AND EXISTS (SELECT 1 FROM c a WHERE a.role = 'assistant' AND a.session_id = u.session_id AND a.turn < u.turn AND u.turn - a.turn <= 2)""",
    "context_window": _ev('SELECT incident_id, turn, "window" FROM inc JOIN win USING (incident_id) WHERE signal_type = \'tool_error\''),
    "incidents_union": _ev(f'SELECT {_FLAT}, "window" FROM inc JOIN win USING (incident_id)'),
    "insert_ignore": _ev(f"SELECT {_FLAT} FROM inc WHERE CAST(session_id AS BIGINT) % 2 <> 0"),
    "signal_summary": _ev("SELECT signal_type, count(*) AS n FROM inc GROUP BY signal_type"),
    "cluster_gate": _ev("SELECT * FROM ga"),
    "stratified_sample": _ev("SELECT artifact, signal_type, distinct_sessions, total_incidents, incident_id, session_id, rn_in_session, pick FROM sa WHERE pick <= 20"),
    "uncapped_sample": _ev("SELECT artifact, signal_type, distinct_sessions, total_incidents, incident_id, session_id, rn_in_session, pick FROM sa"),
    "cluster_bundle": _ev("SELECT cluster_id, signal_type, artifact, distinct_sessions, total_incidents, incidents FROM cl"),
    "top_clusters": _ev("SELECT cluster_id, distinct_sessions, total_incidents FROM cl ORDER BY distinct_sessions DESC, total_incidents DESC, cluster_id LIMIT 10"),
    "nested_caps": _ev('SELECT signal_type || \'::\' || artifact AS cluster_id, pick - 1 AS pos, incident_id, tail AS "window" FROM sa JOIN win USING (incident_id) WHERE pick <= 5'),
    "cluster_index": _ev("SELECT cluster_id, signal_type, artifact, distinct_sessions, total_incidents, sampled_incidents FROM cl"),
    "byte_truncate": "SELECT o_orderkey, CASE WHEN length(o_orderstatus || '-' || o_orderpriority) <= 6 THEN o_orderstatus || '-' || o_orderpriority ELSE substr(o_orderstatus || '-' || o_orderpriority, 1, 6) || '[cut]' END AS cut FROM orders",
    "artifact_exists": _ev("SELECT cluster_id, artifact, md5(content) AS digest, length(content) AS chars FROM cl JOIN cut USING (artifact)", _CONTENT),
    "artifact_missing": _ev("SELECT cluster_id, artifact FROM cl WHERE artifact NOT IN (SELECT artifact FROM ct0)", _CONTENT),
    "ledger_parse": f"WITH {_LEDGER} SELECT path, id, artifact, signal_type, outcome_raw, CASE WHEN outcome_raw = '' THEN 'open' ELSE outcome_raw END AS outcome_or_open, pr_url FROM le",
    "declined_anti_join": _ev("SELECT cluster_id FROM cl WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.artifact = cl.artifact AND dk.signal_type = cl.signal_type)", _LEDGER),
    "declined_skipped": _ev("SELECT cluster_id FROM cl WHERE EXISTS (SELECT 1 FROM dk WHERE dk.artifact = cl.artifact AND dk.signal_type = cl.signal_type)", _LEDGER),
    "proposal_validate": f"WITH {_PROPOSALS} SELECT path, error FROM pe WHERE error IS NOT NULL",
    "proposal_dedup": f"WITH {_PROPOSALS} SELECT id, implicated_artifact, fix_type, confidence, diagnosis FROM pr",
    "plan_status": f"WITH {_PROPOSALS} SELECT proposal_id, status, reason, repo_root, file_path, section, owner, base, group_id, branch_name FROM pl",
    "plan_groups": f"WITH {_PROPOSALS} SELECT group_id, min(proposal_id) AS first, count(*) AS proposals FROM pl WHERE status = 'ready' GROUP BY group_id",
    "dedup_gate": f"""WITH {_PROPOSALS}, {_LEDGER},
op AS (SELECT s_suppkey AS number, CASE WHEN s_suppkey % 2 = 0 THEN 'docs' ELSE 'chore' END || '/tallyrook-r' || (s_suppkey % 7) || '-docs-f' || (s_suppkey % 31) || '-md-' || substr(sha1('/repo/r' || (s_suppkey % 7)), 1, 8) AS head, 'https://github.com/o/r/pull/' || s_suppkey AS url FROM supplier),
a AS (SELECT head AS branch_name, min_by('open PR #' || number || ' (' || url || ')', number) AS by_pr FROM op GROUP BY head),
b AS (SELECT proposal_id, min_by('reason-log entry "' || le.id || '" (PR ' || pr_url || ')', le.path) AS by_entry FROM pl JOIN lc AS le ON pl.file_path = le.clean AND {_SLUG.format("section")} = {_SLUG.format("split_part(le.artifact, '#', 2)")} AND le.id <> proposal_id
  WHERE status = 'ready' AND pr_url <> '' AND outcome_raw = 'open' GROUP BY proposal_id)
SELECT proposal_id, CASE WHEN COALESCE(by_pr, by_entry) IS NULL THEN 'ready' ELSE 'skip-duplicate' END AS status, COALESCE(by_pr, by_entry, '') AS supersedes FROM pl LEFT JOIN a USING (branch_name) LEFT JOIN b USING (proposal_id) WHERE status = 'ready'""",
    "pr_messages": f"""WITH {_PROPOSALS},
ap AS (SELECT p.*, pr.reason_log, right(id, 1) IN ('1', '2', '4') AS told FROM pl p JOIN pr ON pr.id = p.proposal_id WHERE status = 'ready' AND right(id, 1) NOT IN ('3', '6', '9')),
bl AS (SELECT *, CASE WHEN told THEN 'docs: about ' || proposal_id ELSE diagnosis END AS said, CASE WHEN told THEN '' WHEN fix_type = 'escalate-out-of-instructions' THEN 'chore: ' ELSE 'docs: ' END AS kind,
  'What is wrong: ' || diagnosis || chr(10) || chr(10) || 'Seen in: ' || signal_type || chr(10) || chr(10) || 'Why this helps: ' || reason_log || chr(10) || chr(10) || '(' || proposal_id || ', ' || fix_type || ')' || chr(10) AS block FROM ap)
SELECT group_id, CAST(count(*) AS INTEGER) AS items, CASE WHEN count(*) = 1 THEN min(kind || said) ELSE split_part(branch_name, '/', 1) || ': apply ' || count(*) || ' proposals to ' || split_part(min(file_path), '/', -1) END AS title, string_agg(DISTINCT signal_type, ',' ORDER BY signal_type) AS files,
  md5(CASE WHEN count(*) = 1 THEN min(block) ELSE 'Changes to ' || split_part(min(file_path), '/', -1) || ' by ' || string_agg(proposal_id, ', ' ORDER BY proposal_id) || '.' || chr(10) || string_agg(chr(10) || said || chr(10) || chr(10) || block, chr(10) ORDER BY proposal_id) END) AS body FROM bl GROUP BY group_id, branch_name""",
    "pr_reconcile": f"""WITH {_LEDGER}, st AS (SELECT 'https://github.com/own' || (s_suppkey % 4) || '/rep' || (s_suppkey % 2) || '/pull/' || s_suppkey AS url, CASE WHEN s_suppkey % 4 = 0 THEN 'merged' WHEN s_suppkey % 4 = 1 THEN 'closed' ELSE 'open' END AS outcome FROM supplier)
SELECT path, outcome, outcome AS written FROM le JOIN st ON st.url = le.pr_url WHERE outcome <> 'open' AND outcome_raw <> '' AND outcome_raw <> outcome""",
    "entry_repos": f"WITH {_LEDGER} SELECT DISTINCT split_part(pr_url, '/', 4) || '/' || split_part(pr_url, '/', 5) AS repo FROM le WHERE pr_url <> ''",
    "fnv_hash": """SELECT p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(octet_length(encode(p_name))), lambda i: ('0x' || substr(hex(p_name), 2 * i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)) AS fnv FROM part""",
    "preflight_diff": "SELECT DISTINCT 'f' || (o_custkey % 500) AS file FROM orders WHERE o_custkey % 500 NOT IN (SELECT o_custkey % 500 FROM orders WHERE o_custkey % 500 < 300)",
    "slug_hash": f"SELECT p_partkey, {_SLUG.format('n')} AS slug, md5(n) AS md5, substr(sha1(n), 1, 8) AS sha FROM (SELECT p_partkey, '-' || p_name || ' / ' || p_brand || '!' AS n FROM part)",
    "project_dirs": "SELECT page_id, translate(url, '/.', '--') AS dir, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS path FROM (SELECT page_id, url, regexp_replace(split_part(url, '#', 1), '/{2,}', '/', 'g') AS p FROM pages)",
    "artifact_counts": _ev("SELECT signal_type, implicated_artifact, count(*) AS incidents, count(DISTINCT session_id) AS sessions FROM inc GROUP BY ALL"),
    "rate_trend": _ev("SELECT implicated_artifact, signal_type, count(*) FILTER (WHERE ts < '2024-01-15') AS before, count(*) FILTER (WHERE ts >= '2024-01-15') AS after FROM inc GROUP BY ALL"),
}
