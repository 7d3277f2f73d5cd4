"""DuckDB text of the same rules, built from the same tables; its regular expressions are RE2's."""

from __future__ import annotations

from ..functions import rules
from .fixtures import COMMANDS, OBSERVATIONS, PATHS, TOOLS


def q(s: str) -> str:
    """A string literal; control characters by their codes."""
    parts = [p for piece in s.split("\n") for p in ("'" + piece.replace("'", "''") + "'", "chr(10)")][:-1]
    text = " || ".join(parts).replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '")
    return f"({text})" if "||" in text else text


def find(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def holds(x: str, tokens) -> str:
    return "(" + " or ".join(f"contains({x}, {q(t)})" for t in tokens) + ")"


def isin(x: str, values) -> str:
    return f"{x} in ({', '.join(map(q, values))})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normalize(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+(\\n|\\z)', '\\1', 'g')"


def without_lines(x: str, pattern: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: not {find('l', pattern)}), chr(10))"


def scrub(x: str) -> str:
    """For texts without diffs."""
    calm = f"regexp_replace({normalize(x)}, {q(rules.REMINDER)}, chr(10), 'g')"
    return normalize(without_lines(normalize(calm), rules.HARNESS_LINE))


def case(pairs, default: str) -> str:
    return "case " + " ".join(f"when {c} then {q(n)}" for n, c in pairs) + f" else {default} end"


def basename(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def normal_path(x: str) -> str:
    p = f"regexp_replace(regexp_replace({strip(x)}, '[\\\\/]+', '/', 'g'), '^(?:\\./)+', '')"
    p = f"(case when regexp_matches({p}, '(?:^|/)testbed/') and ({p} like '/%' or contains({p}, '/tmp/') or {p} like 'tmp/%') then regexp_extract({p}, '(?:^|/)testbed/(.*)$', 1) else {p} end)"
    p = f"regexp_replace({p}, '^(?:[^/]*swebench[^/]*/)+testbed/', '')"
    return f"regexp_replace(regexp_replace(regexp_replace({p}, '^testbed/', ''), '^(?:\\./)+', ''), '/+', '/', 'g')"


def path_class(raw: str, policy: str) -> str:
    """raw: a column."""
    p = f"lower({normal_path(raw)})" if policy == "strip" else f"lower({raw})"
    name = basename(p)
    common = f"({name} like '%\\_preds.json' escape '\\' or {isin(name, rules.PREDICTION_FILES)} or {name} like '%.patch' or {name} like '%.diff')"
    artifact = f"({common} or {p} like 'output/%')" if policy == "strip" else f"({common} or ({p} like 'output/%' and {name} like '%preds.json'))"
    words = "|".join(rules.SCRATCH_WORDS[policy])
    folders = lambda names, x: find(x, "(?:^|/)(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")(?:/|$)")
    scratch = f"({isin(name, rules.SCRATCH_FILES[policy])} or {find(name, f'^(?:{words})[_-]')} or {find(name, rf'[_-](?:{words})[.][^.]+$')} or {folders(rules.SCRATCH_FOLDERS, p)})"
    parents = f"regexp_replace({p}, '[^/]*$', '')"
    test = f"({find(parents, '(?:^|/)(?:' + '|'.join(rules.TEST_FOLDERS) + ')/')} or {name} like 'test\\_%' escape '\\' or " + " or ".join(f"ends_with({name}, {q(e)})" for e in rules.TEST_ENDINGS) + ")"
    source = f"(contains({basename(raw)}, '.') and {isin(f'lower(regexp_extract({raw}, ' + chr(39) + '[^.]*$' + chr(39) + '))', rules.SOURCE_EXTENSIONS)})"
    tail = [("scratch", scratch), ("test", test), ("source", source)]
    if policy == "memory":
        return case([("other", f"{raw} = ''"), ("submission_artifact", artifact), *tail], "'other'")
    root = isin(p, ("", ".", "./", "testbed", "./testbed"))
    harness = "(" + isin(name, rules.HARNESS_FILES) + " or " + " or ".join(f"{p} = {q(f)} or starts_with({p}, {q(f + '/')})" for f in rules.HARNESS_FOLDERS) + ")"
    return case([("empty_path", f"{raw} = ''"), ("workspace_root", root), ("submission_artifact", artifact), ("harness", harness), *tail], "'other'")


def _one_line(c: str) -> str:
    return strip(f"regexp_replace({strip(f'regexp_replace({c}, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '(?i)^(?:cd\\s+\\S+\\s*&&\\s*)+', '')")


def command_class(x: str, policy: str) -> str:
    c = strip(normalize(x))
    low = f"lower(replace({c}, '\\', '/'))"
    noise_of = strip(scrub(c)) if policy == "strip" else c
    noise = f"(not contains({noise_of}, chr(10)) and ({find(_one_line(noise_of), rules.GIT_STATE)} or {find(_one_line(noise_of), rules.PROBE)}))"
    artifact = f"({holds(low, rules.ARTIFACT_TEXT)} or {find(low, rules.ARTIFACT[policy])})"
    tail = [("destructive", find(c, rules.DESTRUCTIVE)), ("test", find(c, rules.TEST[policy])), ("build_install", find(c, rules.BUILD_INSTALL[policy])), ("setup", find(c, rules.SETUP)), ("diagnostic", find(c, rules.DIAGNOSTIC))]
    if policy == "memory":
        return case([("other", artifact), ("diagnostic", noise), *tail], "'other'")
    return case([("submission_artifact", artifact), ("harness", holds(low, rules.HARNESS_TEXT)), ("patch_dump_or_staging", find(c, rules.PATCH_STAGING)), ("diagnostic_environment_noise", noise), *tail], "'other'")


def forbidden(x: str) -> str:
    return find(x, rules.HARD_FORBIDDEN)


def patch_payload(x: str) -> str:
    g = lambda k: f"nullif(regexp_extract({x}, {q(rules.PATCH_WRITE)}, {k}), '')"
    name = f"lower({basename(f'coalesce({g(1)}, {g(2)}, {g(3)}, ' + chr(39) * 2 + ')')})"
    return f"({forbidden(x)} or {find(name, '^(?:patch|diff)(?:[.].*)?$|[.](?:patch|diff)$')})"


def noise(x: str, policy: str = "strip") -> str:
    low = f"lower({strip(normalize(x))})"
    missing = f"({isin(low, rules.MISSING_ALONE)} or {holds(low, rules.MISSING_TEXT)} or (contains({low}, 'no such file or directory') and {holds(low, rules.MISSING_PROGRAMS)}))"
    setup = "(" + " or ".join("(" + " and ".join(f"contains({low}, {q(t)})" for t in ts) + ")" for ts in rules.SETUP_FAILURES) + ")"
    lines = f"list_filter(list_transform(string_split({normalize(x)}, chr(10)), lambda l: trim(l)), lambda l: l <> '')"
    joined = f"lower(array_to_string({lines}, chr(10)))"
    listing = f"(len({lines}) = 0 or (len({lines}) <= 3 and {isin(joined, rules.LISTING_ALONE)}) or (len({lines}) <= 20 and {holds(joined, rules.LISTING_TOKENS)} and not {find(joined, rules.REPOSITORY_WORDS)}))"
    return f"({listing} or {missing} or {setup})" if policy == "strip" else f"({missing} or {setup})"


def failure_rule(x: str) -> str:
    return case([(n, find(x, p)) for n, p in rules.FAILURES], "null")


def pick(values, by: str) -> str:
    return f"([{', '.join(map(q, values))}])[1 + {by} % {len(values)}]"


AGENT_EVENTS = f"""
select 'u' || user_id as traj_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
  case when event_type = 'click' then 'code_action' when event_type = 'purchase' then 'api_action' when event_type = 'signup' and event_id % 2 = 1 then 'message_action' else 'text_observation' end as class_,
  case when event_type = 'signup' and event_id % 2 = 0 then 'user' when event_type in ('view', 'error') then 'environment' end as source,
  case when event_type = 'click' then {pick(COMMANDS, 'event_id')} when event_type in ('view', 'error') then {pick(OBSERVATIONS, 'event_id')}
    when event_type = 'signup' and event_id % 2 = 0 then 'repo: r' || (event_id % 7) || chr(10) || 'instance_id: i' || event_id || chr(10) || 'problem_statement: fix  ' || chr(10) || 'it ' || event_id
    when event_type = 'signup' then 'all done ' || event_id end as content,
  case when event_type = 'click' then 'bash' end as language,
  case when event_type = 'purchase' then {pick(TOOLS, 'event_id')} end as function,
  case when event_type = 'purchase' then {pick(PATHS, 'event_id')} end as file_path,
  case when event_type = 'purchase' then '{{"file_path":"' || {pick(PATHS, 'event_id')} || '","old_string":"a' || event_id || '","new_string":"b","pattern":"p' || (event_id % 5) || '"}}' end as kwargs_json,
  case when event_id % 3 = 0 then 'step ' || event_id end as description,
  case when event_id % 11 = 0 and event_type in ('click', 'purchase') then 'because' end as reasoning_content, event_id
from events
"""


def primary_path(policy: str) -> str:
    """Of AGENT_EVENTS: a Glob has no path argument there."""
    return f"case when function = 'Glob' or function is null then '' else {normal_path('file_path')} end"


def decisions() -> str:
    """AGENT_EVENTS with path, path_class, command_class, reason, decision, reason_codes and new_idx, as the strip stage decides."""
    tools = lambda ts: isin("function", ts)
    env, api, bash = "(class_ = 'text_observation' and source = 'environment')", "class_ = 'api_action'", "(class_ = 'code_action' and language = 'bash')"
    alone = [
        ("drop.empty_environment_observation", f"{env} and {strip('clean')} = ''"),
        ("drop.todo_observation", f"{env} and contains(clean, 'Todos have been modified')"),
        ("drop.hard_forbidden_environment_payload", f"{env} and {forbidden('clean')}"),
        ("keep.user_issue_prompt", "class_ = 'text_observation' and source = 'user'"),
        ("keep.text_observation", "class_ = 'text_observation'"),
        ("drop.final_message_default_off", "class_ = 'message_action'"),
        ("drop.todowrite", f"{api} and {tools(rules.PLANNING_TOOLS)}"),
        ("drop.submission_payload", f"{api} and {forbidden('kwargs_json')} and {holds('kwargs_json', rules.ARTIFACT_TEXT)}"),
        ("drop.harness_payload", f"{api} and {forbidden('kwargs_json')}"),
        ("drop.submission_artifact_path", f"{api} and path_class = 'submission_artifact'"),
        ("drop.harness_path", f"{api} and path_class = 'harness'"),
        ("drop.scratch_file_body", f"{api} and path_class = 'scratch' and {tools(rules.EDIT_TOOLS)}"),
        ("drop.scratch_file_read", f"{api} and path_class = 'scratch'"),
        *((f"keep.{t.lower()}_evidence", f"{api} and function = {q(t)}") for t in rules.INSPECT_TOOLS),
        ("keep.edit_evidence", f"{api} and {tools(rules.EDIT_TOOLS)}"),
        ("keep.api_action", api),
        ("drop.patch_payload_command", f"{bash} and {patch_payload('clean')}"),
        *((f"drop.{c}_command", f"{bash} and seen = {q(c)}") for c in ("submission_artifact", "harness", "patch_dump_or_staging", "diagnostic_environment_noise", "destructive", "setup", "build_install")),
        ("keep.diagnostic_command", f"{bash} and seen = 'diagnostic'"),
        ("keep.test_command", f"{bash} and seen = 'test'"),
        ("keep.other_command", bash),
    ]
    return f"""
with a0 as ({AGENT_EVENTS}), a1 as (select *, {scrub('content')} as clean, {primary_path('strip')} as path from a0),
a2 as (select *, {path_class('path', 'strip')} as path_class, case when {bash} then {command_class('content', 'strip')} end as command_class, case when {bash} then {command_class('clean', 'strip')} end as seen from a1),
a3 as (select *, {case(alone, "'keep.unknown_item_class'")} as reason from a2),
a4 as (select *, last_value(case when class_ in ('api_action', 'code_action') then struct_pack(r := reason, c := class_, f := function) end ignore nulls) over (partition by traj_id order by idx rows between unbounded preceding and 1 preceding) as prev from a3),
a5 as (select *, case when {env} and prev.r like 'drop.%' then 'drop.observation_after_dropped_action' when {env} and prev.c = 'api_action' and prev.f in ('Edit', 'Write', 'MultiEdit') then 'drop.edit_tool_result_snippet'
    when {env} and {noise('clean')} then 'drop.environment_observation_noise' end as over1 from a4),
a6 as (select *, case when source = 'user' and sum(case when source = 'user' then 1 else 0 end) over (partition by traj_id order by idx rows unbounded preceding) > 1 then 'drop.additional_user_message_default_off' else over1 end as over2 from a5),
a7 as (select *, coalesce(over2, reason) as final, case when reasoning_content is not null and over2 is null then 1 else 0 end as gone from a6),
decided as (select *, case when final like 'keep.%' then 'keep' else 'drop' end as decision, case when gone = 1 then 'strip.reasoning_content_field_removed,' || final else final end as codes,
    case when final like 'keep.%' then sum(case when final like 'keep.%' then 1 else 0 end) over (partition by traj_id order by idx rows unbounded preceding) - 1 end as new_idx from a7)
"""
