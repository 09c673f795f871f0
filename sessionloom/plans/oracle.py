"""The registered queries in SQL, written from their definitions."""

from __future__ import annotations

def _token() -> str:
    """Word boundaries of Unicode's annex 29 without look-around: a token ends with its extending characters, which words hold in between.

    Hebrew quotes and extending characters after white space, which counts can't tell, aside.
    """
    extend = r"(?:[\p{M}\x{FF9E}\x{FF9F}\x{1F3FB}-\x{1F3FF}]|[^\P{Cf}\x{200B}])*"
    alone = r"\p{Han}\p{Hiragana}\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}\p{Ahom}"
    kana = r"\p{Katakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}"
    letter, digit, katakana, join = rf"[^\P{{L}}\x{{FF9E}}\x{{FF9F}}{alone}{kana}]", r"\p{Nd}", f"[{kana}]", r"\p{Pc}"
    quotes = r"''\x{2018}\x{2019}."
    letters = rf"{letter}(?:{extend}(?:[:\x{{B7}}{quotes}]{extend})?{letter})*"
    digits = rf"{digit}(?:{extend}(?:[,;{quotes}]{extend})?{digit})*"
    run = f"(?:(?:{letters}|{digits})(?:{extend}(?:{letters}|{digits}))*|{katakana}(?:{extend}{katakana})*)"
    joined = f"{join}(?:{extend}{join})*(?:{extend}{run})?"
    word = f"(?:{run}|{joined})(?:{extend}{joined})*"
    flag = rf"[\x{{1F1E6}}-\x{{1F1FF}}](?:{extend}[\x{{1F1E6}}-\x{{1F1FF}}])?"
    other = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    picture = r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{2B55}\x{3030}\x{303D}\x{1F000}-\x{1F1E5}\x{1F201}-\x{1F3FA}\x{1F400}-\x{1FAFF}]"
    return rf"(?:{word}|{flag}|{other})(?:{extend}\x{{200D}}{picture})*{extend}"


TOKEN = _token()
_CONSTRAINT = r"(?i)\b(do not|don''t|must not|never|always|must|avoid|only)\b"


def count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))::BIGINT"


CHATS = f"""items AS (
  SELECT conv_id::VARCHAR AS session_id, 'c-' || conv_id || '-' || lpad(turn::VARCHAR, 6, '0') AS item_id, turn AS seq,
         CASE role WHEN 'system' THEN 'SystemPrompt' WHEN 'developer' THEN 'DeveloperPrompt' WHEN 'assistant' THEN 'AssistantMessage' WHEN 'tool' THEN 'ToolResult' ELSE 'UserMessage' END AS kind,
         coalesce(text, '') AS content, sha256(coalesce(text, '')) AS content_hash, {count("coalesce(text, '')")} AS token_count, false AS recoverable, NULL AS file_path
  FROM conversations
)"""


def files(session: str = "source") -> str:
    return f"""items AS (
  SELECT coalesce({session}, '') AS session_id, 'd-' || lpad(doc_id::VARCHAR, 12, '0') AS item_id, doc_id AS seq, 'FileContent' AS kind,
         coalesce(text, '') AS content, sha256(coalesce(text, '')) AS content_hash, {count("coalesce(text, '')")} AS token_count, true AS recoverable, 'docs/' || doc_id AS file_path
  FROM documents
)"""


INDEXED = """indexed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, item_id) - 1 AS idx, count(*) OVER (PARTITION BY session_id) AS n_items FROM items
), grouped AS (
  SELECT *, CASE WHEN kind IN ('FileContent', 'AssistantMessage', 'ToolResult') THEN count(*) OVER g ELSE 1 END AS dup_count,
         CASE WHEN kind IN ('FileContent', 'AssistantMessage', 'ToolResult') THEN max(idx) OVER g = idx ELSE true END AS is_canonical
  FROM indexed WINDOW g AS (PARTITION BY session_id, kind, content_hash)
)"""

# Kinds that the tables give: the rest have no rows here.
SCORED = f"""{INDEXED}, parts AS (
  SELECT *, kind = 'SystemPrompt' OR (kind = 'UserMessage' AND regexp_matches(content, '{_CONSTRAINT}')) AS is_pinned,
         (CASE kind WHEN 'SystemPrompt' THEN 1 WHEN 'UserMessage' THEN 0.95 WHEN 'AssistantMessage' THEN 0.85 WHEN 'FileContent' THEN 0.55 ELSE 0.35 END)::FLOAT AS relevance,
         idx::FLOAT / n_items::FLOAT AS recency, 0::FLOAT AS dependency, 0::FLOAT AS unresolved,
         (CASE kind WHEN 'SystemPrompt' THEN 1 WHEN 'UserMessage' THEN 0.9 ELSE 0 END)::FLOAT AS authority,
         (CASE WHEN dup_count <= 1 THEN 1 WHEN is_canonical THEN 0.7 ELSE 0.1 END)::FLOAT AS uniqueness,
         (CASE WHEN kind = 'FileContent' THEN CASE WHEN recoverable OR file_path IS NOT NULL THEN 0.9 ELSE 0.5 END WHEN kind = 'ToolResult' THEN 0.4
               WHEN kind IN ('SystemPrompt', 'UserMessage') THEN 0 ELSE 0.3 END)::FLOAT AS recoverability_penalty,
         (CASE WHEN dup_count > 1 THEN 1 ELSE 0 END)::FLOAT AS redundancy_penalty
  FROM grouped
), scored AS (
  SELECT *, CASE WHEN is_pinned THEN 1::FLOAT ELSE greatest(least(
           relevance * 0.15::FLOAT + recency * 0.15::FLOAT + dependency * 0.10::FLOAT + unresolved * 0.20::FLOAT + authority * 0.15::FLOAT
           + uniqueness * 0.10::FLOAT - recoverability_penalty * 0.10::FLOAT - redundancy_penalty * 0.15::FLOAT, 1::FLOAT), 0::FLOAT) END AS importance
  FROM parts
)"""


def goals(usable: int, extra: int) -> str:
    return f"""sums AS (
  SELECT session_id, sum(token_count)::BIGINT AS before_tokens, sum(CASE WHEN deduplicated THEN 0 ELSE token_count END)::BIGINT AS current_tokens FROM candidates GROUP BY session_id
), pressures AS (
  SELECT *, {usable}::BIGINT AS usable_tokens, before_tokens::FLOAT / {usable}::FLOAT AS pressure_before, (before_tokens + {extra})::FLOAT / {usable}::FLOAT AS predicted_pressure FROM sums
), states AS (
  SELECT *, CASE WHEN predicted_pressure >= 0.90::FLOAT THEN 'Emergency' WHEN predicted_pressure >= 0.82::FLOAT THEN 'Aggressive' WHEN predicted_pressure >= 0.72::FLOAT THEN 'Compact'
                 WHEN predicted_pressure >= 0.60::FLOAT THEN 'Trim' WHEN predicted_pressure >= 0.45::FLOAT THEN 'Observe' ELSE 'Green' END AS pressure_state,
         trunc(0.55::FLOAT * {usable}::FLOAT)::BIGINT AS configured_target, greatest(trunc(0.72::FLOAT * {usable}::FLOAT)::BIGINT - {extra}, 0) AS forecast
  FROM pressures
), goals AS (
  SELECT *, CASE WHEN pressure_state IN ('Emergency', 'Aggressive', 'Compact') THEN least(configured_target, forecast) ELSE configured_target END AS target_tokens FROM states
)"""


# No reducer applies to these kinds, so a first step is an artifact (where one may be made) or eviction.
def plan(usable: int, extra: int, large: int, scored: str = SCORED) -> str:
    candidates = f"""SELECT *, 0 AS from_n, NOT is_pinned AND dup_count > 1 AND NOT is_canonical AS deduplicated, token_count AS reduced_tokens, token_count AS extracted_tokens,
         CASE WHEN recoverable AND token_count >= {large} THEN {count("'artifact://file/' || item_id")} ELSE token_count END AS external_tokens,
         greatest(1::FLOAT - importance, 0.01::FLOAT) AS loss
  FROM scored"""
    return f"{scored}, candidates AS ({candidates}\n), {chosen(usable, extra)}"


def chosen(usable: int, extra: int) -> str:
    """From candidates with costs by level: every level that costs less than all before it is a step; a step's rank is the smallest utility so far."""
    return f"""{goals(usable, extra)}, costs AS (
  SELECT session_id, item_id, idx, loss, from_n, token_count, unnest([1, 2, 4, 5]) AS ordinal, unnest([reduced_tokens, extracted_tokens, external_tokens, 0]) AS after
  FROM candidates WHERE NOT is_pinned AND NOT deduplicated AND from_n < 5
), lows AS (
  SELECT *, least(token_count, coalesce(min(after) OVER (PARTITION BY session_id, idx ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), token_count)) AS before
  FROM costs WHERE ordinal > from_n
), steps AS (
  SELECT session_id, item_id, idx, loss, ordinal, 'L' || ordinal AS level, after, before - after AS savings, row_number() OVER (PARTITION BY session_id, idx ORDER BY ordinal) AS k FROM lows WHERE after < before
), valued AS (
  SELECT *, savings::FLOAT / (loss * (1::FLOAT + ordinal::FLOAT * 0.15::FLOAT)) AS utility FROM steps
), chained AS (
  SELECT *, min(utility) OVER (PARTITION BY session_id, idx ORDER BY k) AS low FROM valued
), first_pass AS (
  SELECT c.*, g.current_tokens, g.configured_target, g.target_tokens,
         coalesce(sum(savings) OVER (PARTITION BY c.session_id ORDER BY low DESC, idx, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < g.current_tokens - g.configured_target AS taken
  FROM chained c JOIN goals g USING (session_id)
), second_pass AS (
  SELECT *, coalesce(sum(CASE WHEN NOT taken AND level <> 'L5' THEN savings END) OVER (PARTITION BY session_id ORDER BY low DESC, idx, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         current_tokens - coalesce(sum(CASE WHEN taken THEN savings END) OVER (PARTITION BY session_id), 0) - target_tokens AS due
  FROM first_pass
), last_step AS (
  SELECT session_id, idx, arg_max(level, k) AS level, arg_max(after, k) AS after FROM second_pass WHERE taken OR (level <> 'L5' AND spent < due) GROUP BY session_id, idx
), actions AS (
  SELECT c.session_id, c.item_id, c.idx, c.kind, c.content,
         CASE WHEN is_pinned THEN 'Pin' WHEN deduplicated THEN 'Deduplicate' WHEN l.level IS NULL THEN 'Keep' ELSE ['Reduce', 'Extract', '', 'Externalize', 'Evict'][substr(l.level, 2)::INTEGER] END AS action,
         'L' || from_n AS from_level, CASE WHEN is_pinned THEN 'L' || from_n WHEN deduplicated THEN 'L5' ELSE coalesce(l.level, 'L' || from_n) END AS to_level, c.token_count AS estimated_before,
         CASE WHEN is_pinned THEN c.token_count WHEN deduplicated THEN 0 ELSE coalesce(l.after, c.token_count) END::BIGINT AS estimated_after,
         CASE WHEN is_pinned THEN 'pin: mandatory or user constraint' WHEN deduplicated THEN 'deduplicate: repeated content' WHEN l.level IS NULL THEN 'keep: baseline'
              ELSE ['reduce: structural cleanup', 'extract: keep only key parts', '', 'externalize: recoverable content', 'evict: low importance'][substr(l.level, 2)::INTEGER] END AS reason
  FROM candidates c LEFT JOIN last_step l USING (session_id, idx)
)"""


FILE_PLAN = f"WITH {files()}, {plan(12_000, 1_500, 400)}"
CHAT_PLAN = f"WITH {CHATS}, {plan(750, 0, 6_000)}"
WORKING = f"""{FILE_PLAN}, working AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos, item_id, idx, kind,
         CASE WHEN action = 'Externalize' THEN 'artifact://file/' || item_id ELSE content END AS content,
         CASE WHEN to_level = 'L0' THEN greatest(estimated_before, 1) ELSE greatest({count("'artifact://file/' || item_id")}, 1) END AS token_count, to_level AS compression_level,
         CASE WHEN action = 'Externalize' THEN 'artifact://file/' || item_id END AS artifact_ref
  FROM actions WHERE to_level <> 'L5'
)"""


def second(items: str, large: int = 400) -> str:
    """A plan of ``items``, which have a compression_level: its names get a suffix so that both plans fit one query."""
    out = plan(5_000, 0, large).replace("0 AS from_n,", "substr(compression_level, 2)::INTEGER AS from_n,", 1)
    for name in ("items", "indexed", "grouped", "parts", "scored", "candidates", "sums", "pressures", "states", "goals", "costs", "lows", "steps", "valued", "chained", "first_pass", "second_pass", "last_step", "actions"):
        for before in ("FROM ", "JOIN "):
            out = out.replace(f"{before}{name} ", f"{before}{name}_2 ").replace(f"{before}{name}\n", f"{before}{name}_2\n")
        out = out.replace(f"{name} AS (", f"{name}_2 AS (")
    return f"items_2 AS (\n  {items}\n), {out}"


def again() -> str:
    """The plan of the working sets."""
    items = "SELECT session_id, item_id, idx AS seq, kind, content, sha256(content) AS content_hash, token_count, true AS recoverable, 'docs' AS file_path, compression_level FROM working"
    return f"""{WORKING}, {second(items)}
SELECT session_id, item_id, action, from_level, to_level, estimated_before, estimated_after FROM actions_2"""


def past_views() -> str:
    """The working sets of the first wave, of the first two, what joined each, and what was there before."""
    joined = lambda wave: f"""SELECT i.session_id, coalesce(p, 0) + row_number() OVER (PARTITION BY i.session_id ORDER BY seq) AS pos, item_id, content, token_count, 'L0' AS compression_level, NULL::VARCHAR AS artifact_ref
  FROM every i LEFT JOIN ends_{wave} USING (session_id) WHERE seq % 3 = {wave}"""  # noqa: E731
    view = """SELECT session_id, item_id, e.seq, e.kind, v.content, sha256(v.content) AS content_hash, v.token_count, true AS recoverable, 'docs' AS file_path, compression_level
  FROM (FROM set_1 UNION ALL FROM later_1) v JOIN every e USING (session_id, item_id)"""
    first = WORKING.replace("WITH items AS (", "WITH every AS (", 1).replace("), indexed AS (", "), items AS (SELECT * FROM every WHERE seq % 3 = 0), indexed AS (", 1)
    uri = "'artifact://file/' || item_id"
    return f"""{first}, set_1 AS (
  SELECT session_id, pos, item_id, content, token_count, compression_level, artifact_ref FROM working
), ends_1 AS (SELECT session_id, max(pos) AS p FROM set_1 GROUP BY session_id), later_1 AS ({joined(1)}), {second(view)}, set_2 AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos, item_id, CASE WHEN to_level = 'L4' THEN {uri} ELSE content END AS content,
         greatest(CASE WHEN to_level = 'L0' THEN estimated_before ELSE {count(uri)} END, 1) AS token_count, to_level AS compression_level, CASE WHEN to_level = 'L4' THEN {uri} END AS artifact_ref
  FROM actions_2 WHERE to_level <> 'L5'
), ends_2 AS (SELECT session_id, max(pos) AS p FROM set_2 GROUP BY session_id), later_2 AS ({joined(2)}), fresh AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS pos, item_id, content, token_count, 'L0' AS compression_level, NULL::VARCHAR AS artifact_ref FROM every WHERE seq % 3 = 0
), found AS (
  SELECT 200 AS ask_id, * FROM fresh UNION ALL SELECT unnest([700, 1200]), * FROM set_1 UNION ALL SELECT 1200, * FROM later_1
  UNION ALL SELECT unnest([1700, 2200]), * FROM set_2 UNION ALL SELECT 2200, * FROM later_2
)
SELECT ask_id, session_id, pos, item_id, sha256(content) AS content_hash, token_count, compression_level, artifact_ref FROM found"""


def r5(*names: str) -> str:
    return ", ".join(f"round({n}::DOUBLE, 5) AS {n}" for n in names)


# Logs are made, as the tables have none, with the whole text behind; every 50th is long.
_LOG = """WITH logs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, substr(sha256(coalesce(text, '')), 1, 8) AS w FROM documents
), build AS (
  SELECT doc_id, source, array_to_string(list_transform(range(1, CASE WHEN doc_id % 50 = 7 THEN 401 ELSE 13 + doc_id % 9 END), lambda i: CASE (i * 7 + doc_id) % 11
    WHEN 0 THEN '' WHEN 1 THEN '| / -' WHEN 2 THEN 'Downloading ' || w WHEN 3 THEN i || '% done' WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'error[E04' || i % 10 || ']: bad ' ELSE 'error: bad ' END || w
    WHEN 5 THEN '  --> src/' || w || '.rs:' || i || ':5' WHEN 6 THEN 'same line' WHEN 7 THEN 'same line' WHEN 8 THEN chr(27) || '[32mstep ' || i || chr(27) || '[0m'
    WHEN 9 THEN 'fatal: it failed' ELSE 'note ' || w END), chr(10)) || chr(10) || text AS content
  FROM logs
), tests AS (
  SELECT doc_id, source, array_to_string(list_transform(range(1, CASE WHEN doc_id % 50 = 9 THEN 1001 ELSE 4 + doc_id % 5 END), lambda i: 'test case_' || i || CASE WHEN doc_id % 3 = 0 AND i % 4 = 1 THEN ' ... FAILED' ELSE ' ... ok' END), chr(10)) || chr(10)
         || CASE WHEN doc_id % 3 = 0 THEN 'failures:' || chr(10) || '---- case_1 ----' || chr(10) || 'test result: FAILED. finished' ELSE 'test result: ok. finished in 0.01s' END || chr(10) || text AS content
  FROM logs
)"""


def lines(content: str) -> str:
    return f"regexp_split_to_array(regexp_replace({content}, '\\r?\\n$', ''), '\\r?\\n')"


def single(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: i = 1 OR x <> ({xs})[i - 1])"


_CLEAN = r"""list_filter(LINES, lambda x: NOT regexp_matches(x, '^[\s\|/\\\-]*$') AND NOT regexp_matches(x, '(?i)\b\d+%|\[={0,50}>\s*\]|\b(eta|downloading|extracting)\b'))""".replace("LINES", lines(r"regexp_replace(content, '\x1b\[[0-9;]*[A-Za-z]', '', 'g')"))
_MARKS = rf"""list_filter({lines('content')}, lambda x: regexp_matches(x, '(?i)^\s*error(\[.*\])?\s*:.*$') OR regexp_matches(x, '^\s*-->\s*([^\s]+):(\d+):(\d+)'))"""


def reduced(rows: str, keep: str) -> str:
    """CTEs that end with ``shell`` (xs, es), ``compiler`` and ``tested`` (reduced) over a CTE with doc_id and content."""
    return rf"""clean AS (SELECT {keep}, content, {_CLEAN} AS xs FROM {rows}
), kept AS (SELECT {keep}, content, {single('xs')} AS xs FROM clean
), errors AS (SELECT {keep}, content, xs, list_filter(xs, lambda x: regexp_matches(x, '(?i)error|fail|fatal|panic')) AS es FROM kept
), shell AS (SELECT {keep}, content, xs, ({single('es')})[1:20] AS es FROM errors
), marks AS (SELECT {keep}, content, {_MARKS} AS xs FROM {rows}
), compiler AS (SELECT {keep}, array_to_string({single('xs')}, chr(10)) AS reduced FROM marks
), counted AS (
  SELECT {keep}, xs, len(list_filter(xs, lambda x: regexp_matches(x, '^test .* \.\.\. ok$'))) AS p, len(list_filter(xs, lambda x: regexp_matches(x, '^test .* \.\.\. FAILED$'))) AS f,
         list_filter(xs, lambda x: regexp_matches(x, 'test result: .*\.|ran for|time:.*s|duration'))[-1] AS d FROM (SELECT {keep}, {lines('content')} AS xs FROM {rows})
), tested AS (
  SELECT {keep}, CASE WHEN f = 0 AND p > 0 THEN rtrim(p || ' tests passed' || chr(10) || '0 failed' || chr(10) || coalesce('duration ' || d, ''))
    ELSE array_to_string(list_filter(xs, lambda x: regexp_matches(x, '^test .* \.\.\. FAILED$') OR regexp_matches(x, '(?i)failures:') OR starts_with(x, '----'))[1:201], chr(10)) END AS reduced FROM counted
)"""


def extracted(command: str, code: str) -> str:
    return f"""array_to_string(list_concat(['command: ' || {command}, 'exit_code: ' || {code}, 'errors:'],
  CASE WHEN len(es) > 0 THEN list_transform(es, lambda x: '  ' || x) ELSE ['  <none>'] END,
  CASE WHEN len(xs) > 0 THEN list_concat(['final_status:'], list_transform(xs[greatest(len(xs) - 2, 1):], lambda x: '  ' || x)) ELSE [] END), chr(10))"""


# Sessions of command outputs, test results and errors: a reducer applies to most, some errors are resolved, some items have parents.
_LOG_PLAN = f"""{_LOG}, items AS (
  SELECT coalesce(b.source, '') AS session_id, 'd-' || lpad(b.doc_id::VARCHAR, 12, '0') AS item_id, b.doc_id AS seq, b.doc_id,
         CASE b.doc_id % 4 WHEN 1 THEN 'TestResult' WHEN 2 THEN 'Error' ELSE 'CommandOutput' END AS kind,
         CASE WHEN b.doc_id % 4 IN (0, 2) THEN b.content ELSE t.content END AS content, b.doc_id % 3 AS exit_code, 'make ' || b.doc_id AS command,
         CASE WHEN b.doc_id % 5 = 0 THEN 'Resolved' ELSE 'Active' END AS state, b.doc_id % 3 = 0 AS has_parent
  FROM build b JOIN tests t USING (doc_id)
), hashed AS (
  SELECT *, sha256(content) AS content_hash, {count('content')} AS token_count FROM items
), indexed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, item_id) - 1 AS idx, count(*) OVER (PARTITION BY session_id) AS n_items,
         count(*) OVER (PARTITION BY session_id, kind, content_hash) AS dup_count, max(seq) OVER (PARTITION BY session_id, kind, content_hash) = seq AS is_canonical FROM hashed
), parts AS (
  SELECT *, state = 'Active' AND kind = 'Error' AS is_pinned,
         (CASE kind WHEN 'Error' THEN 0.9 WHEN 'TestResult' THEN 0.4 ELSE 0.35 END)::FLOAT AS relevance, idx::FLOAT / n_items::FLOAT AS recency,
         (CASE WHEN has_parent THEN 0.8 ELSE 0 END)::FLOAT AS dependency, (CASE WHEN state = 'Active' AND (kind = 'Error' OR exit_code <> 0) THEN 1 ELSE 0 END)::FLOAT AS unresolved, 0::FLOAT AS authority,
         (CASE WHEN dup_count <= 1 THEN 1 WHEN is_canonical THEN 0.7 ELSE 0.1 END)::FLOAT AS uniqueness, (CASE kind WHEN 'CommandOutput' THEN 0.8 ELSE 0.3 END)::FLOAT AS recoverability_penalty,
         (CASE WHEN dup_count > 1 THEN 1 ELSE 0 END)::FLOAT AS redundancy_penalty
  FROM indexed
), scored AS (
  SELECT *, CASE WHEN is_pinned THEN 1::FLOAT ELSE greatest(least(
           relevance * 0.15::FLOAT + recency * 0.15::FLOAT + dependency * 0.10::FLOAT + unresolved * 0.20::FLOAT + authority * 0.15::FLOAT
           + uniqueness * 0.10::FLOAT - recoverability_penalty * 0.10::FLOAT - redundancy_penalty * 0.15::FLOAT, 1::FLOAT), 0::FLOAT) END AS importance
  FROM parts
), {reduced('items', 'doc_id')}, texts AS (
  SELECT s.*, CASE WHEN kind <> 'TestResult' AND contains(s.content, 'error[') THEN c.reduced WHEN kind = 'Error' THEN s.content
                   WHEN kind = 'TestResult' OR contains(s.content, 'test result:') OR p + f > 0 THEN t.reduced ELSE array_to_string(l.xs, chr(10)) END AS short,
         CASE WHEN kind <> 'TestResult' AND contains(s.content, 'error[') THEN c.reduced WHEN kind = 'Error' THEN s.content
              WHEN kind = 'TestResult' OR contains(s.content, 'test result:') OR p + f > 0 THEN t.reduced ELSE {extracted('command', 'exit_code')} END AS shorter
  FROM scored s JOIN compiler c USING (doc_id) JOIN tested t USING (doc_id) JOIN (SELECT doc_id, p, f FROM counted) n USING (doc_id) JOIN shell l USING (doc_id)
), candidates AS (
  SELECT *, 0 AS from_n, NOT is_pinned AND dup_count > 1 AND NOT is_canonical AS deduplicated, {count('short')} AS reduced_tokens, {count('shorter')} AS extracted_tokens, {count('shorter')} AS external_tokens,
         greatest(1::FLOAT - importance, 0.01::FLOAT) AS loss
  FROM texts
), {chosen(5_000, 1_500)}"""

_E = "SELECT user_id, event_type, round(value)::FLOAT AS v, ts, event_id FROM events"
_STATS = f"""WITH {CHATS}, typed AS (
  SELECT session_id, CASE kind WHEN 'AssistantMessage' THEN 'assistant' WHEN 'ToolResult' THEN 'tool' ELSE 'other' END AS event_type, token_count::FLOAT AS v, seq, item_id FROM items
), stats AS (
  SELECT session_id, event_type, list_reduce(list(v ORDER BY seq, item_id), lambda a, x: (0.25::FLOAT * x + 0.75::FLOAT * a)::FLOAT) AS ema FROM typed GROUP BY session_id, event_type
)"""

# Letters become characters of many scripts, marks, flags and pictures.
SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "\u6f22\u5b57\u3072\u30ab\u30ca\u0e01\u0e34\ud55c\uae00\u00e9\u0301\U0001f600\u200d\U0001f469\U0001f1e9\U0001f1ea\u2764\ufe0f\u0439\u03a9\u0639\u00b7\u2019\u0661\u203f\u30fc")

ORACLES = {
    "script_token_counts": f"SELECT doc_id, {count(f"coalesce(translate(text, '{SCRIPTS[0]}', '{SCRIPTS[1]}'), '')")} AS token_count FROM documents",
    "items_from_conversations": f"WITH {CHATS}, {INDEXED} SELECT session_id, item_id, kind, content_hash, token_count, idx, n_items FROM indexed",
    "items_from_pages": f"SELECT coalesce(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS session_id, 'p-' || lpad(page_id::VARCHAR, 12, '0') AS item_id, 'ToolResult' AS kind, 'fetch' AS tool_name, {count('html')} AS token_count, 'fetch' AS event_type FROM pages",
    "wire_items": f"WITH {CHATS} SELECT 'wire' AS session_id, 'c-' || c.conv_id || '-' || c.turn AS item_id, kind, content_hash, token_count, 'Active' AS state, 'L0' AS compression_level FROM items JOIN conversations c ON item_id = 'c-' || conv_id || '-' || lpad(turn::VARCHAR, 6, '0')",
    "active_items": f"WITH {CHATS}, {INDEXED} SELECT session_id, item_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS idx FROM indexed WHERE idx % 5 <> 4 AND idx % 7 <> 6",
    "history_totals": f"WITH {files()} SELECT session_id, count(*) AS item_count, sum(token_count)::BIGINT AS total_tokens FROM items GROUP BY session_id",
    "session_pressure": f"""WITH {CHATS}, sums AS (SELECT session_id, sum(token_count)::BIGINT AS current_tokens, count(*) AS item_count FROM items GROUP BY session_id), p AS (SELECT *, current_tokens::FLOAT / 750::FLOAT AS pressure FROM sums)
SELECT session_id, current_tokens, item_count, 750::BIGINT AS usable_tokens, round(pressure::DOUBLE, 5) AS pressure,
       CASE WHEN pressure >= 0.90::FLOAT THEN 'Emergency' WHEN pressure >= 0.82::FLOAT THEN 'Aggressive' WHEN pressure >= 0.72::FLOAT THEN 'Compact' WHEN pressure >= 0.60::FLOAT THEN 'Trim' WHEN pressure >= 0.45::FLOAT THEN 'Observe' ELSE 'Green' END AS pressure_state FROM p""",
    "composition": f"WITH {CHATS} SELECT session_id, kind, sum(token_count)::BIGINT AS tokens, count(*) AS items FROM items GROUP BY session_id, kind",
    "duplicate_summary": f"WITH {files('lang')} SELECT session_id, content_hash, count(*) AS count, max(item_id) AS canonical_id FROM items GROUP BY session_id, content_hash HAVING count(*) > 1",
    "dedup_roles": f"WITH {files('lang')}, {INDEXED} SELECT session_id, item_id, dup_count, is_canonical FROM grouped",
    "pinned_items": f"WITH {CHATS} SELECT session_id, item_id, kind, regexp_matches(content, '{_CONSTRAINT}') AS constraint_like, kind = 'SystemPrompt' OR (kind = 'UserMessage' AND regexp_matches(content, '{_CONSTRAINT}')) AS is_pinned FROM items",
    "importance_scores": f"WITH {files('lang')}, {SCORED} SELECT session_id, item_id, is_pinned, {r5('relevance', 'recency', 'dependency', 'unresolved', 'authority', 'uniqueness', 'recoverability_penalty', 'redundancy_penalty', 'importance')} FROM scored",
    "event_type_ema": f"WITH e AS ({_E}) SELECT user_id, event_type, round(list_reduce(list(v ORDER BY ts, event_id), lambda a, x: (0.25::FLOAT * x + 0.75::FLOAT * a)::FLOAT)::DOUBLE, 5) AS ema, count(*) AS count FROM e GROUP BY user_id, event_type",
    "token_prediction": f"""{_STATS}, sums AS (SELECT session_id, avg(ema)::FLOAT AS i, max(ema) FILTER (contains(event_type, 'tool')) AS t, max(ema) FILTER (event_type = 'assistant') AS a FROM stats GROUP BY session_id)
SELECT session_id, trunc(i)::BIGINT AS expected_input, trunc(coalesce(t, 0))::BIGINT AS expected_tool_output, trunc(coalesce(a, i * 0.5::FLOAT))::BIGINT AS expected_assistant_output FROM sums""",
    "compaction_targets": f"WITH {files()}, candidates AS (SELECT *, false AS deduplicated FROM items), {goals(12_000, 1_500)} SELECT session_id, before_tokens, usable_tokens, {r5('pressure_before', 'predicted_pressure')}, pressure_state, configured_target, target_tokens FROM goals",
    "candidate_steps": f"{FILE_PLAN} SELECT session_id, item_id, k::BIGINT AS k, level, after::BIGINT AS after, savings::BIGINT AS savings, {r5('utility', 'low')} FROM chained",
    "compaction_plan": f"{FILE_PLAN} SELECT session_id, item_id, action, from_level, to_level, estimated_before, estimated_after, reason FROM actions",
    "plan_headers": f"{FILE_PLAN}, after AS (SELECT session_id, sum(estimated_after)::BIGINT AS expected_after_tokens FROM actions GROUP BY session_id) SELECT session_id, before_tokens, usable_tokens, {r5('pressure_before', 'predicted_pressure')}, target_tokens, expected_after_tokens, pressure_state FROM goals JOIN after USING (session_id)",
    "chat_plan": f"{CHAT_PLAN} SELECT session_id, item_id, action, to_level, estimated_before, estimated_after, reason FROM actions",
    "working_set": f"{WORKING} SELECT session_id, pos, item_id, sha256(content) AS content_hash, token_count, compression_level, artifact_ref FROM working",
    "artifacts": f"{FILE_PLAN} SELECT session_id, 'artifact://file/' || item_id AS artifact_id, item_id, sha256(content) AS content_hash FROM actions WHERE action = 'Externalize'",
    "second_compaction": again(),
    "past_views": past_views(),
    "top_candidates": f"""{FILE_PLAN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY estimated_before - estimated_after DESC, idx) AS rank FROM actions WHERE action NOT IN ('Keep', 'Pin'))
SELECT session_id, rank, item_id, from_level AS kind, kind AS item_kind, action, estimated_before AS before_tokens, estimated_after AS after_tokens FROM ranked WHERE rank <= 5""",
    "appended_set": f"""WITH {CHATS.replace("FROM conversations", "FROM conversations WHERE turn < 2")}, {plan(750, 0, 6_000)}, working AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos, item_id, greatest(estimated_before, 1) AS token_count, to_level AS compression_level FROM actions WHERE to_level <> 'L5'
), later AS (
  SELECT conv_id::VARCHAR AS session_id, turn, 'c-' || conv_id || '-' || lpad(turn::VARCHAR, 6, '0') AS item_id, {count("coalesce(text, '')")} AS token_count FROM conversations WHERE turn >= 2
), ends AS (SELECT session_id, max(pos) AS p FROM working GROUP BY session_id)
SELECT session_id, pos, item_id, token_count, compression_level FROM working
UNION ALL SELECT l.session_id, coalesce(p, 0) + row_number() OVER (PARTITION BY l.session_id ORDER BY turn), item_id, token_count, 'L0' FROM later l LEFT JOIN ends USING (session_id)""",
    "session_status": f"""{FILE_PLAN}, after AS (SELECT session_id, sum(estimated_after)::BIGINT AS expected_after_tokens, count(*) AS item_count, arg_min(item_id, (estimated_after - estimated_before) * 1000000 + idx) FILTER (action NOT IN ('Keep', 'Pin')) AS first_candidate FROM actions GROUP BY session_id)
SELECT session_id, before_tokens AS current_tokens, item_count,
       CASE WHEN pressure_before >= 0.90::FLOAT THEN 'Emergency' WHEN pressure_before >= 0.82::FLOAT THEN 'Aggressive' WHEN pressure_before >= 0.72::FLOAT THEN 'Compact' WHEN pressure_before >= 0.60::FLOAT THEN 'Trim' WHEN pressure_before >= 0.45::FLOAT THEN 'Observe' ELSE 'Green' END AS pressure_state,
       pressure_state AS predicted_state, target_tokens, expected_after_tokens, 'FileContent' AS most_kind, first_candidate
FROM goals JOIN after USING (session_id)""",
    "telemetry": f"{FILE_PLAN}, after AS (SELECT session_id, sum(estimated_after) AS a FROM actions GROUP BY session_id) SELECT session_id, count(*) AS compactions, count(*) FILTER (pressure_state = 'Emergency') AS emergency_compactions, sum(greatest(before_tokens - a, 0))::BIGINT AS reclaimed_tokens FROM goals JOIN after USING (session_id) GROUP BY session_id",
    "memory_search": f"""WITH {files()}, said AS (SELECT session_id, item_id, seq, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS t, sha256(length(session_id)::VARCHAR || ':' || session_id || item_id) AS key FROM items),
words AS (SELECT session_id, item_id, key, len(t) AS length, unnest(t) AS term FROM said), tf AS (SELECT session_id, item_id, key, length, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT session_id, count(*) AS n, avg(len(t)) AS average FROM said GROUP BY session_id), df AS (SELECT session_id, term, count(*) AS df FROM tf GROUP BY session_id, term),
asked AS (SELECT item_id AS query_id, session_id, unnest(list_distinct(t)) AS term FROM said WHERE seq % 100 = 0),
scores AS (SELECT query_id, item_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 9) AS score
  FROM asked JOIN tf USING (session_id, term) JOIN df USING (session_id, term) JOIN sizes USING (session_id) GROUP BY query_id, item_id, key)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, item_id, key, round(score, 6) AS score FROM scores QUALIFY rank <= 5""",
    "stored_history": f"""{_STATS}, typed_counts AS (SELECT session_id, event_type, count(*) AS count FROM typed GROUP BY session_id, event_type),
sums AS (SELECT session_id, count(*) AS items, sum(token_count)::BIGINT AS tokens FROM items GROUP BY session_id)
SELECT session_id, event_type, round(ema::DOUBLE, 5) AS ema, count, items, tokens, items AS events, tokens AS recounted FROM stats JOIN typed_counts USING (session_id, event_type) JOIN sums USING (session_id)""",
    "latest_event": "SELECT user_id AS session_id, event_type AS type, arg_max(props, event_id) AS payload_json, max(event_id) AS event_id FROM events GROUP BY user_id, event_type",
    "checkpoint_items": "SELECT conv_id::VARCHAR AS session_id, 'k-' || conv_id AS item_id, 'Checkpoint' AS kind, arg_min(text, turn) AS goal, 'open' AS status, count(*) || ' turns' AS summary, 'compaction' AS source_type FROM conversations GROUP BY conv_id",
    "reducer_choice": f"""{_LOG}
SELECT doc_id, 'CommandOutput' AS kind, CASE WHEN contains(content, 'error[') THEN 'compiler' WHEN contains(content, 'test result:') THEN 'test' ELSE 'shell' END AS reducer FROM build
UNION ALL SELECT doc_id, 'TestResult', 'test' FROM tests""",
    "shell_reduce": f"{_LOG}, {reduced('build', 'doc_id')} SELECT doc_id, array_to_string(xs, chr(10)) AS reduced FROM shell",
    "shell_extract": f"""{_LOG}, {reduced('build', 'doc_id')} SELECT doc_id, {extracted("'make ' || doc_id", "doc_id % 3")} AS reduced FROM shell""",
    "compiler_reduce": f"{_LOG}, {reduced('build', 'doc_id')} SELECT doc_id, reduced FROM compiler",
    "test_reduce": f"{_LOG}, {reduced('tests', 'doc_id')} SELECT doc_id, reduced FROM tested",
    "log_scores": f"{_LOG_PLAN} SELECT session_id, item_id, is_pinned, {r5('dependency', 'unresolved', 'relevance', 'recoverability_penalty', 'importance')}, CASE WHEN is_pinned THEN 0 ELSE reduced_tokens END AS reduced_tokens, CASE WHEN is_pinned THEN 0 ELSE extracted_tokens END AS extracted_tokens FROM candidates",
    "log_plan": f"{_LOG_PLAN} SELECT session_id, item_id, action, from_level, to_level, estimated_before, estimated_after, reason FROM actions",
    "log_working_set": f"""{_LOG_PLAN}, working AS (
  SELECT a.*, CASE a.action WHEN 'Reduce' THEN c.short WHEN 'Extract' THEN c.shorter ELSE a.content END AS now FROM actions a JOIN candidates c USING (session_id, item_id) WHERE to_level <> 'L5'
) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos, item_id, sha256(now) AS content_hash, greatest({count('now')}, 1) AS token_count, to_level AS compression_level FROM working""",
}
ORACLES["stream_event_ema"] = ORACLES["event_type_ema"]
