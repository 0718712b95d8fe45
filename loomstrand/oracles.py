"""DuckDB SQL for the session-log queries, written apart from the operators."""

from __future__ import annotations

CONV_LOG = r"""conv_log as (
  select conv_id as session_id, turn as seq, case when role = 'assistant' then 'assistant/message' else 'user/message' end as type,
    cast(null as bigint) as step, 0 as tool_calls, text, length(text) as chars,
    case when role = 'assistant' then sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) end as turn,
    8 + greatest(
      cast(ceil((length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) / 4) as bigint),
      cjk + cast(ceil((length(text) - cjk) / 4) as bigint)) as tokens,
    row_number() over (partition by conv_id order by turn) - 1 as pos
  from (select *, length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}]', '', 'g')) as cjk from conversations))"""

TOOL_LOG = """e as (select user_id as session_id, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
    row_number() over (partition by user_id order by ts, event_id) - 1 as ev_no from events),
n as (select e.*, case event_type when 'click' then 1 when 'view' then k % 3 + 1 else 0 end as n_res from e),
x as (select n.*, s.sub from n join (values (0), (1), (2), (3)) as s(sub) on s.sub <= n.n_res),
t as (select *, row_number() over (partition by session_id order by ev_no, sub) - 1 as seq,
    case when event_type = 'signup' then 'user/message' when event_type = 'error' then 'turn/end' when sub > 0 then 'tool/result' else 'assistant/message' end as type,
    case when event_type = 'error' then case when k % 2 = 0 then 'completed' else 'error' end end as reason from x),
l as (select *, coalesce(sum(case when type = 'turn/end' then 1 else 0 end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding), 0) as turn_no,
    case when type = 'tool/result' then 200 + (event_id * 37 + sub * 101) % 9000 else 40 + event_id % 200 end as chars from t),
tool_log as (select session_id, seq, type, reason, k, case when type <> 'user/message' then turn_no end as turn,
    case when type in ('assistant/message', 'tool/result') then ev_no end as step, case when type = 'assistant/message' then n_res else 0 end as tool_calls, chars,
    (chars + 3) // 4 + 8 as tokens from l),
surface as (select *, row_number() over (partition by session_id order by seq) - 1 as pos from tool_log where type <> 'turn/end')"""


def cuts(source: str) -> str:
    """CTEs up to `cuts` over a surface."""
    return f"""d as (select *, case type when 'assistant/message' then tool_calls when 'tool/result' then -1 else 0 end as delta,
    lead(turn) over w as next_turn, lead(step) over w as next_step, lag(turn) over w as prev_turn, lag(step) over w as prev_step from {source} window w as (partition by session_id order by pos)),
cuts as (select *, sum(delta) over w as open_after, sum(delta) over w - delta as open_before, sum(tokens) over w as upto,
    sum(tokens) over (partition by session_id order by pos desc rows unbounded preceding) as suffix,
    not coalesce(turn = next_turn and step = next_step, false) as step_end, not coalesce(turn = prev_turn and step = prev_step, false) as step_begin
    from d window w as (partition by session_id order by pos rows unbounded preceding))"""


def zones(recent: int, forget: int) -> str:
    """CTEs `starts` and `zoned` after `cuts`."""
    return f"""raws as (select session_id, coalesce(max(pos) filter (suffix >= {recent}), 0) as r, coalesce(max(pos) filter (suffix >= {forget}), 0) as f from cuts group by 1),
starts as (select c.session_id, coalesce(max(pos) filter (open_before = 0 and step_begin and pos <= r), 0) as recent_start,
    least(coalesce(max(pos) filter (open_before = 0 and step_begin and pos <= r), 0), coalesce(max(pos) filter (open_before = 0 and step_begin and pos <= f), 0)) as forget_start
    from cuts c join raws using (session_id) group by 1),
zoned as (select c.*, recent_start, forget_start, case when pos >= recent_start then 'recent' when pos >= forget_start then 'tool' else 'forget' end as zone
    from cuts c join starts using (session_id))"""


ZONE_TOTALS = "select session_id, zone, count(*) as n, cast(sum(tokens) as bigint) as tokens, min(pos) as first_pos, max(pos) as last_pos from zoned group by all"

SEGMENTS = """b as (select *, (type = 'assistant/message' and tool_calls > 0) or type = 'tool/result' as burst from cuts),
b2 as (select *, burst and not coalesce(lag(burst) over w, false) or (burst and lag(turn) over w is distinct from turn) as breaks from b window w as (partition by session_id order by pos)),
b3 as (select *, sum(cast(breaks as int)) over (partition by session_id order by pos rows unbounded preceding) as island from b2),
calls as (select session_id, island, min(pos) as c from b3 where burst and type = 'assistant/message' group by 1, 2),
edge as (select b3.session_id, b3.island, min(pos) filter (open_before = 0) as a, max(pos) filter (open_after = 0) as z
    from b3 join calls on b3.session_id = calls.session_id and b3.island = calls.island and pos >= c where burst group by 1, 2),
seg as (select b3.* from b3 join edge on b3.session_id = edge.session_id and b3.island = edge.island and burst and a < z and pos between a and z)"""

CHUNKS = """atoms0 as (select *, coalesce(sum(cast(open_after = 0 and step_end as int)) over (partition by session_id, island order by pos rows between unbounded preceding and 1 preceding), 0) as atom from picked),
atoms as (select session_id, island, atom, sum(tokens) as tokens from atoms0 group by all),
fold as (select session_id, island, atom, tokens as held, 0 as chunk from atoms where atom = 0
    union all select a.session_id, a.island, a.atom, case when held + tokens > {cap} then tokens else held + tokens end, case when held + tokens > {cap} then chunk + 1 else chunk end
    from fold f join atoms a on a.session_id = f.session_id and a.island = f.island and a.atom = f.atom + 1)"""

REPLACED = """longs as (select session_id, seq, row_number() over (partition by session_id order by seq) - 1 as i from tool_log where type = 'tool/result' and chars > 7000),
size as (select session_id, count(*) as n, count(*) filter (type = 'tool/result' and chars > 7000) as m from tool_log group by 1),
oldest as (select s.session_id, s.pos, coalesce(n + 2 * i + 1, s.seq) as now, n + 2 * m as top from surface s join size using (session_id) left join longs l on l.session_id = s.session_id and l.seq = s.seq where pos < 9),
sum1 as (select session_id, list(now order by pos) as covers, max(top) as seq from oldest group by 1),
rlog as (select session_id, seq, type, reason, cast(null as varchar) as source_kind, cast([] as bigint[]) as covers, cast(null as bigint) as shadow from tool_log
  union all select session_id, n + 2 * i, 'compaction/prune', null, null, [], seq from longs join size using (session_id)
  union all select session_id, n + 2 * i + 1, 'tool/result', null, null, [seq], null from longs join size using (session_id)
  union all select session_id, seq, 'user/message', null, 'checkpoint', covers, null from sum1
  union all select session_id, seq + 1, 'user/message', null, 'checkpoint', [seq], null from sum1 where session_id % 3 = 0)"""

AUTHORITY = """ev as (select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_type, event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events),
au as (select *, count(*) filter (event_type = 'signup') over (partition by session_id order by seq rows unbounded preceding) as revision from ev),
goals as (select session_id, seq, case when k = 0 then 'cleared' else 'current' end as status, case when k <> 0 then 'g' || (k % 7) end as goal_id, case when k <> 0 then revision end as revision,
    case when k <> 0 then 'objective ' || event_id end as objective from au where event_type = 'signup'),
todos as (select session_id, seq, case when k % 5 = 0 then 'cleared' else 'current' end as status,
    case when k % 5 = 0 then '' else 'task ' || event_id || ' [' || case when k % 2 = 0 then 'done' else 'pending' end || ']' end as items from au where event_type = 'view')"""

GROUP_AUDIT = """ga0 as (select user_id as session_id, event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events where event_type = 'click'),
ga as (select session_id, 'r' || lpad(cast(event_id as varchar), 9, '0') as request_id, 'f' || (event_id % 5) as fingerprint,
    ['open', 'success', 'failure', 'fallback', 'aborted', 'repaired'][k % 6 + 1] as status, case when k % 4 <> 0 then k % 3 + 1 end as attempt,
    case when event_id % 2 = 0 then 'me' else 'other' end as owner_id, case when k % 6 <> 0 and k % 7 = 0 then 'interrupted-attempt' end as diagnostic,
    case when event_id % 3 = 0 then [event_id % 11, event_id % 11 + 1] else [] end as claims from ga0),
landed as (select user_id as session_id, 'f' || (event_id % 5) as fingerprint, list(distinct event_id % 11) as landed from events where event_type = 'purchase' and event_id % 4 = 0 group by 1, 2)"""

AUDIT = """audit as (select user_id as session_id, 'r' || lpad(cast(event_id as varchar), 9, '0') as request_id, event_id // 3 as time,
    ['success', 'failure', 'manual', 'terminal-infeasible', 'aborted', 'repair', 'failure', 'open'][cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 8 + 1] as status,
    ['BUDGET', 'ABORTED', 'SCHEMA', 'TIMEOUT', 'SERVICE_DISPOSED'][event_id % 5 + 1] as code, event_id % 40 as revision from events)"""

TOTALS = """min(pos) as start_pos, max(pos) as end_pos, count(*) as n, count(*) filter (type = 'tool/result') as results,
    cast(coalesce(sum(chars) filter (type = 'tool/result'), 0) as bigint) as chars, cast(sum(tokens) as bigint) as tokens"""

ENTRIES = """en as (select user_id as session_id, event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, event_type, ['fact', 'decision', 'constraint', 'risk'][event_id % 4 + 1] as own, 'entry ' || (event_id % 13) as words from events),
base as (select session_id, 'e' || event_id as id, own as kind, words as content, event_id from en where event_type = 'view'),
cand as (select session_id, case when k % 19 = 0 then 'risk' else own end as kind, event_id as ordinal, case when event_type = 'view' and k % 7 <> 0 then 'e' || event_id when event_type = 'click' and k % 17 = 0 then 'e' || event_id end as id,
    case when k % 23 = 0 then words || ' changed' else words end as content from en where event_type in ('view', 'click'))"""

MINTED = "kind || '-' || left(sha256(session_id || '|' || kind || '|' || ordinal || '|' || content), 16)"

ORACLE_SQL = {
    "token_estimate": f"with {CONV_LOG} select session_id, seq, tokens from conv_log",
    "zone_partition": f"with {CONV_LOG}, {cuts('conv_log')}, {zones(200, 500)} {ZONE_TOTALS}",
    "zone_partition_safe": f"with {TOOL_LOG}, {cuts('surface')}, {zones(12000, 30000)} {ZONE_TOTALS}",
    "pairing_balance": f"""with {TOOL_LOG}, {cuts('surface')} select session_id, pos, cast(open_before as bigint) as open_before, cast(open_after as bigint) as open_after,
        min(open_after) over (partition by session_id) < 0 as corrupt from cuts""",
    "forget_batch_plan": f"""with {TOOL_LOG}, {cuts('surface')}, {zones(12000, 30000)},
        ends as (select session_id, pos, upto from zoned where zone = 'forget' and open_after = 0 and step_end),
        pick as (select session_id, min(pos) filter (upto between 4000 and 6000) as a, max(pos) filter (upto <= 6000) as b, count(*) as n from ends group by 1)
        select s.session_id, e.pos as end_pos, cast(e.upto as bigint) as tokens,
          case when forget_start = 0 then 'no-forget-range' when e.pos is not null then null when p.n > 0 then 'oldest-unit-too-large' else 'no-safe-batch-end' end as reason
        from starts s left join pick p using (session_id) left join ends e on e.session_id = s.session_id and e.pos = coalesce(p.a, p.b)""",
    "pressure_span_plan": f"""with {TOOL_LOG}, {cuts('surface')}, {zones(12000, 30000)},
        ends as (select session_id, pos, upto from zoned where pos < recent_start and open_after = 0 and step_end and upto <= 20000),
        pick as (select session_id, min(pos) filter (upto >= 9001) as a, max(pos) as b from ends group by 1)
        select s.session_id, cast(case when e.upto > 1000 then 0 end as bigint) as start_pos, case when e.upto > 1000 then e.pos end as end_pos, cast(case when e.upto > 1000 then e.upto end as bigint) as tokens,
          case when e.pos is null then 'no-safe-prefix' when e.upto <= 1000 then 'span-below-minimum' end as reason
        from starts s left join pick p using (session_id) left join ends e on e.session_id = s.session_id and e.pos = coalesce(p.a, p.b)""",
    "legacy_tail_split": f"""with {TOOL_LOG}, {cuts('surface')}, r as (select session_id, coalesce(max(pos) filter (suffix >= 12000), 0) as raw from cuts group by 1)
        select c.session_id, coalesce(max(pos) filter (open_before = 0 and pos <= raw), 0) as tail_start from cuts c join r using (session_id) group by 1""",
    "retained_tail_floor": f"""with {TOOL_LOG},
        done as (select session_id, arg_max(turn, seq) as completed from tool_log where type = 'turn/end' and reason = 'completed' group by 1),
        s as (select surface.*, completed from surface left join done using (session_id)),
        firsts as (select session_id, turn, max(pos) as pos from s where turn is not null group by 1, 2),
        stops as (select f.session_id, f.pos from firsts f join (select distinct session_id, completed from s) c using (session_id)
          where (select count(*) from firsts g where g.session_id = f.session_id and g.pos > f.pos) >= 2
          and (c.completed is null or exists (select 1 from s g where g.session_id = f.session_id and g.pos > f.pos and g.turn = c.completed))),
        cut as (select session_id, max(pos) as pos from stops group by 1)
        select s.session_id, cast(sum(tokens) filter (s.pos > coalesce(cut.pos, -1)) as bigint) as tokens from s left join cut using (session_id) group by 1""",
    "envelope_budget": f"""with {TOOL_LOG}, b as (select session_id, sum(tokens) as s, sum(tokens) + session_id % 5 * 3000 as t from surface group by 1),
        c as (select *, greatest(0, t - s) as e from b), g as (select *, greatest(0, 60000 - e - 8192 - 2048) as room, greatest(0, 42000 - e) as under from c)
        select session_id, cast(e as bigint) as envelope, cast(room as bigint) as room, cast(greatest(2000, least(room, 12000)) as bigint) as tail, cast(greatest(0, room - 1500) as bigint) as cap,
          greatest(0, room - 1500) <= 0 as dominated, cast(least(30000, under) as bigint) as zone_forget, cast(greatest(0, s - under) as bigint) as deficit,
          e + greatest(2000, least(under, 12000)) >= 48000 as zone_dominated from g""",
    "prune_documents": """select doc_id % 50 as session_id, doc_id as seq, length(text) as chars_before,
        length(case when length(text) > 8192 then substr(text, 1, 4096) || chr(10) || chr(10) || '[... tool result middle pruned ...]' || chr(10) || chr(10) || substr(text, length(text) - 1023) else text end) as chars_after,
        md5(case when length(text) > 8192 then substr(text, 1, 4096) || chr(10) || chr(10) || '[... tool result middle pruned ...]' || chr(10) || chr(10) || substr(text, length(text) - 1023) else text end) as digest from documents where length(text) > 8192""",
    "bounded_text": """with c as (select doc_id, text, strlen(text) as n, [substr(text, 1, 100 - i) for i in range(0, 100)] as tries from documents)
        select doc_id, case when n <= 100 then text else list_filter(tries, lambda t: strlen(t) <= 97)[1] || '…' end as bounded, n > 100 as truncated from c""",
    "tool_segments": f"with {TOOL_LOG}, {cuts('surface')}, {SEGMENTS} select session_id, {TOTALS} from seg group by session_id, island",
    "group_chunks": f"""with recursive {TOOL_LOG}, {cuts('surface')}, {SEGMENTS}, picked as (select * from seg), {CHUNKS.format(cap=3000)}
        select session_id, {TOTALS} from atoms0 join (select session_id, island, atom, chunk from fold) using (session_id, island, atom) group by session_id, island, chunk""",
    "tool_groups": f"""with recursive {TOOL_LOG}, {cuts('surface')}, {zones(12000, 30000)}, {SEGMENTS},
        good as (select session_id, island from seg join starts using (session_id) group by all having count(*) filter (type = 'tool/result') >= 2
          and sum(chars) filter (type = 'tool/result') >= 12000 and sum(tokens) >= 2000 and max(pos) < max(recent_start)),
        picked as (select seg.* from seg join good using (session_id, island)), {CHUNKS.format(cap=12000)},
        g as (select session_id, {TOTALS} from atoms0 join (select session_id, island, atom, chunk from fold) using (session_id, island, atom) group by session_id, island, chunk)
        select * exclude (r) from (select *, row_number() over (partition by session_id order by start_pos) as r from g where results >= 2 and chars >= 12000 and tokens between 2000 and 12000) where r <= 2""",
    "surface_replay": f"""with recursive {TOOL_LOG}, {REPLACED},
        chain as (select session_id, seq, case when len(covers) > 0 then covers[1] else seq end as root, 0 as depth from rlog
          union all select c.session_id, c.seq, r.covers[1], depth + 1 from chain c join rlog r on r.session_id = c.session_id and r.seq = c.root and len(r.covers) > 0 where c.root <> c.seq),
        roots as (select session_id, seq, arg_max(root, depth) as root from chain group by 1, 2),
        gone as (select distinct session_id, unnest(covers) as seq from rlog)
        select session_id, row_number() over (partition by session_id order by root) - 1 as pos, seq, root, type from rlog join roots using (session_id, seq)
        where type in ('user/message', 'assistant/message', 'tool/result') and (session_id, seq) not in (select session_id, seq from gone)""",
    "surface_generations": f"with {TOOL_LOG}, {REPLACED} select session_id, count(*) filter (len(covers) > 0) as generation from rlog group by 1",
    "turns_after": f"with {TOOL_LOG} select session_id, seq, count(*) filter (type = 'turn/end' and reason = 'completed') over (partition by session_id order by seq rows between 1 following and unbounded following) as turns_after from tool_log",
    "source_index": f"""with {TOOL_LOG}, {REPLACED}, w as (select session_id, seq, type, covers, lag(seq) over s as before, lag(type) over s as before_type, lag(shadow) over s as before_shadow
          from rlog window s as (partition by session_id order by seq)),
        k as (select session_id, seq, case when type = 'user/message' and len(covers) > 0 then 'history-summary' when type <> 'tool/result' or len(covers) = 0 then 'original'
          when before = seq - 1 and before_type = 'compaction/prune' and before_shadow = covers[1] then 'tool-pruned' else 'unknown-replacement' end as kind
          from w where type in ('user/message', 'assistant/message', 'tool/result'))
        select session_id, seq, kind, cast(0 as bigint) as turns_after, kind = 'original' as foldable from k""",
    "provenance_digest": f"""with {TOOL_LOG}, {REPLACED} select session_id, seq, sha256('v1|' || session_id || '|' || seq || '|' || type || '|' || array_to_string(covers, ',')) as digest from rlog where len(covers) > 0""",
    "evidence_counters": f"""with {TOOL_LOG}, {REPLACED} select session_id, count(*) filter (type = 'request/header') as requests, count(*) filter (type = 'compaction/prune') as pruner,
        count(*) filter (type = 'compaction/end') as compaction from rlog group by 1""",
    "compaction_lock": """with ev as (select user_id as session_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events),
        held as (select session_id, seq, k % 3 as lock_id from ev s where event_type = 'click' and not exists (select 1 from ev e where e.session_id = s.session_id and e.seq > s.seq
          and ((e.event_type = 'view' and e.k % 3 = s.k % 3) or (e.event_type = 'error' and e.k % 9 = 0))))
        select session_id, max(seq) as seq, arg_max(lock_id, seq) as lock_id from held group by 1""",
    "event_filter": """with c as (select conv_id as session_id, turn as seq, role, text from conversations where trim(text) <> '' and (role = 'user' or (role = 'assistant' and turn % 7 <> 3))),
        ev as (select user_id as session_id, event_type, event_id as i, props, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, row_number() over (partition by user_id order by ts, event_id) - 1 as seq,
          sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as rev from events),
        m as (select *, ['request/header', 'agent-preset/selected', 'compaction/start', 'compaction/end', 'plan/mode', 'command/run'][i % 6 + 1] as marker from ev where event_type = 'signup'),
        rows as (
        select session_id, seq, case role when 'user' then 'user/message' else 'assistant/message' end as type, case when role = 'assistant' then 'assistant' when seq % 4 = 2 then 'goal-continuation' else 'user' end as kind,
          ',"text":' || to_json(text) as rest, '' as truncation from c
        union all select session_id, seq, 'goal/change', 'goal/change', case when k = 0 then ',"operation":"clear"' else ',"operation":"set","goal":{"id":"g' || k % 7 || '","revision":' || rev || ',"objective":"objective ' || i || '"}' end, '' from ev where event_type = 'signup'
        union all select session_id, seq, 'todo/write', 'todo/write', case when k % 5 = 0 then ',"status":"cleared","todos":[]' else ',"status":"current","todos":[{"content":"task ' || i || '","status":"' || case when k % 2 = 0 then 'done' else '' end || '"}]' end, '' from ev where event_type = 'view'
        union all select session_id, seq, 'tool/call', 'tool/call', ',"name":"tool_' || k % 5 || '","callId":"c' || i || '","arguments":"' ||
            case when k % 9 = 0 then 'raw ' || repeat('xé', 664) || 'x…' when k % 4 = 0 then 'not json ' || i else '{\\"k\\":\\"' || k || '\\"}' end || '"', case when k % 9 = 0 then 'tool/call.arguments:2000:2000' else '' end from ev where event_type = 'click'
        union all select session_id, seq, 'tool/result', 'tool/result', ',"callId":"c' || i || '","isError":' || case when k % 2 = 0 then 'true' else 'false' end || case when k % 7 = 0 then '' else ',"text":"result ' || i || '"' end ||
            case when k % 5 <> 0 then '' when k % 2 = 0 then ',"error":{"name":"ToolError","code":"E' || k % 3 || '"}' else ',"error":{"name":"ToolError"}' end ||
            case when k % 3 <> 0 then '' else ',"meta":"{\\"meta.k\\":\\"' || k || '\\",\\"meta.note\\":\\"' || case when k % 2 = 0 then left(repeat('no ', 250), 397) || '…' else 'no no ' end || '\\"}"' end,
            case when k % 6 = 0 then 'meta.note:400:400' else '' end from ev where event_type = 'view' and (k % 7 <> 0 or k % 5 = 0 or k % 3 = 0)
        union all select session_id, seq, 'turn/end', 'turn/end', ',"turn":' || k || ',"reason":{"kind":' || case k % 3 when 0 then '"completed"' when 1 then '"aborted","reason":{"kind":"' || case when k % 2 = 0 then 'user' else 'unknown' end || '"}'
            else '"error"' || case when k % 2 = 0 then ',"code":"E1"' else '' end end || '}', '' from ev where event_type = 'error'
        union all select session_id, seq, marker, marker, case marker
            when 'request/header' then ',"reason":"' || case when k % 4 = 1 then 'change' else 'initial' end || '","provider":"p","model":"m' || k % 3 || '"' || case when k % 2 = 0 then ',"reasoningEffort":"high"' else '' end
            when 'agent-preset/selected' then ',"preset":"preset ' || k || '"'
            when 'compaction/start' then ',"compactionId":"z' || i || '"' || case when k % 2 = 0 then ',"turn":' || k else '' end
            when 'compaction/end' then ',"compactionId":"z' || i || '"' || case when k % 2 = 0 then ',"error":"' || left(repeat('boom ', 100), 397) || '…"' else '' end
            when 'plan/mode' then ',"active":' || case when k % 2 = 0 then 'true' else 'false' end
            else ',"commandId":"r' || i || '","name":"' || case when k % 2 = 0 then 'plan' else 'goal' end || '"' || case when k % 3 = 0 then ',"args":"go on"' else '' end || ',"source":"user"' end,
            case when marker = 'compaction/end' and k % 2 = 0 then 'compaction/end.error:400:400' else '' end
          from m where not (marker = 'request/header' and (k % 4 = 0 or k % 5 = 0)) and not (marker in ('agent-preset/selected', 'command/run') and k % 5 = 0))
        select session_id, seq, type, kind, '{"kind":"' || kind || '"' || rest || '}' as fields, truncation from rows""",
    "authority_views": f"""with {AUTHORITY}, g as (select session_id, max(seq) as seq from goals group by 1), t as (select session_id, max(seq) as seq from todos group by 1),
        ids as (select session_id from goals union select session_id from todos)
        select ids.session_id, goals.status as goal_status, goal_id, revision as goal_revision, objective, todos.status as todo_status, todos.seq as source_seq, items
        from ids left join g using (session_id) left join goals on goals.session_id = g.session_id and goals.seq = g.seq left join t on t.session_id = ids.session_id left join todos on todos.session_id = t.session_id and todos.seq = t.seq""",
    "urgent_events": f"""with {AUTHORITY}, g as (select *, lag(status || '|' || coalesce(objective, '') || '|' || coalesce(cast(revision as varchar), '')) over (partition by session_id order by seq) as before,
          status || '|' || coalesce(objective, '') || '|' || coalesce(cast(revision as varchar), '') as now from goals)
        select session_id, seq, 'todo' as view from todos union all select session_id, seq, 'goal' from g where before is distinct from now""",
    "batch_window_count": f"""with {AUTHORITY}, r as (select session_id, seq, row_number() over (partition by session_id order by seq) as r from todos where seq > session_id % 20 - 1)
        select session_id, count(*) as n, min(seq) as first_seq, max(seq) as source_cursor from r where r <= 12 group by 1""",
    "audit_timeline": f"""with {AUDIT} select session_id, row_number() over (partition by session_id order by time, request_id) as place, request_id, time,
        case status when 'open' then 'aborted' when 'aborted' then 'aborted' when 'terminal-infeasible' then 'terminal-infeasible' when 'failure' then
          case code when 'BUDGET' then 'terminal-infeasible' when 'ABORTED' then 'aborted' when 'SERVICE_DISPOSED' then 'aborted' else 'transient-failure' end else 'committed' end as classification,
        status in ('success', 'manual', 'repair') as certified, case when status in ('success', 'manual', 'repair') then revision end as certified_revision from audit""",
    "audit_repair": f"""with {AUDIT}, h as (select session_id, coalesce(max(revision) filter (status in ('success', 'manual', 'repair')), 0) as highest from audit group by 1),
        o as (select a.session_id, arg_max(request_id, (time, request_id)) as repair_row from audit a join h using (session_id) where status = 'open' and revision = highest + 1 group by 1)
        select session_id, highest, repair_row from h left join o using (session_id)""",
    "audit_recovery": f"""with {GROUP_AUDIT}, j as (select ga.*, coalesce(landed, []) as landed from ga left join landed using (session_id, fingerprint) where status in ('open', 'aborted')),
        v as (select *, len(list_filter(claims, lambda c: not list_contains(landed, c))) > 0 as conflict from j),
        p as (select session_id, request_id, status as was, diagnostic as said, case when conflict then 'aborted' when len(landed) > 0 then 'repaired' when status = 'open' and owner_id <> 'me' then 'aborted' end as status,
          case when conflict then 'landing-claim-conflict' when len(landed) > 0 then 'session-evidence-served' when status = 'open' and owner_id <> 'me' then 'interrupted-attempt' end as diagnostic from v)
        select session_id, request_id, status, diagnostic from p where status is not null and (was <> status or said is distinct from diagnostic)""",
    "audit_attempts": f"""with {GROUP_AUDIT}, g as (select session_id, fingerprint, sum(coalesce(attempt, 1)) as spent, min(request_id) filter (status = 'open') as o, min(request_id) filter (status = 'aborted') as a,
          arg_min(len(claims), request_id) filter (status = 'open') as c, bool_or(status in ('success', 'repaired')) as served, bool_or(status = 'fallback') as refused from ga group by 1, 2)
        select session_id, fingerprint, cast(spent as bigint) as spent, coalesce(o, a) as slot,
          case when landed is not null or served then false when o is not null then c = 0 and spent < 2 when refused then false else spent < 2 end as owed from g left join landed using (session_id, fingerprint)""",
    "control_latest": """with f as (select user_id as session_id, event_id as arrival, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) + event_id % 17 as revision from events where event_type in ('signup', 'purchase', 'error'))
        select session_id, revision, case when event_type <> 'error' then 'state ' || arrival end as stable from (select *, row_number() over (partition by session_id order by revision desc, arrival desc) as r from f) where r = 1""",
    "slot_render": f"""with {AUTHORITY}, g as (select session_id, max(seq) as seq from goals group by 1), t as (select session_id, max(seq) as seq from todos group by 1),
        lastev as (select session_id, max(seq) as last from ev group by 1), ids as (select session_id from goals union select session_id from todos),
        bought as (select user_id as session_id, event_id from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 6),
        facts as (select session_id, list('- fact about purchase ' || event_id order by event_id) as facts from bought group by 1),
        st as (select ids.session_id, last, goals.status as gs, goal_id, revision, objective, todos.status as ts, todos.seq as tseq, items, facts from ids join lastev using (session_id)
          left join g using (session_id) left join goals on goals.session_id = g.session_id and goals.seq = g.seq left join t on t.session_id = ids.session_id left join todos on todos.session_id = t.session_id and todos.seq = t.seq
          left join facts on facts.session_id = ids.session_id),
        a as (select session_id, list_filter(['Durable task state (revision ' || (session_id % 9 + 1) || ', source event ' || (last - session_id % 2) || ', digest ' || md5(cast(session_id as varchar)) || ').',
          case when session_id % 2 = 1 then '[Task-state snapshot is stale; durable cursor lags eligible session events.]' end,
          case gs when 'cleared' then 'Current goal: cleared (no authoritative goal is set).' when 'current' then 'Current goal: ' || objective end,
          case when gs = 'current' then 'Goal identity: goal ' || goal_id || ', revision ' || revision end,
          case ts when 'cleared' then 'TODO list: cleared (the authoritative list is empty).' when 'current' then 'TODO list (session event ' || tseq || '):' end,
          case when ts = 'current' then '- [' || regexp_extract(items, '[[](.*)[]]', 1) || '] ' || regexp_extract(items, '(.*) [[]', 1) end], lambda x: x is not null) as au,
          case when facts is null then [] else list_concat(['', 'Facts:'], facts) end as more from st),
        f as (select *, list_concat(au, more) as lines, array_to_string(list_concat(au, more), chr(10)) as whole from a),
        n as (select session_id, unnest(range(len(au), len(lines) + 1)) as k from f),
        c as (select session_id, k, array_to_string(lines[1:k], chr(10)) || chr(10) || '[Task-state snapshot truncated; the committed durable state remains authoritative.]' as cut from n join f using (session_id)),
        best as (select session_id, arg_max(cut, k) as cut from c where strlen(cut) <= 420 and 8 + ceil(length(cut) / 4) <= 120 group by 1),
        r as (select session_id, whole, case when strlen(whole) <= 420 and 8 + ceil(length(whole) / 4) <= 120 then whole when len(more) > 0 then coalesce(cut, '') else '' end as text from f left join best using (session_id))
        select session_id, text, text <> '' and text <> whole as truncated, text = '' as blocked, cast(case when text = '' then 0 else 8 + ceil(length(text) / 4) end as bigint) as tokens from r""",
    "slot_decisions": """with ev as (select user_id as session_id, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events),
        u as (select session_id, max(event_id) as e from ev group by 1), v as (select * from ev where event_type = 'purchase' and k % 23 = 0),
        h as (select session_id, count(*) as n, max(pos) - min(pos) + 1 = count(*) as near, string_agg(cast(event_id as varchar), ',' order by pos) as seqs, bool_and(event_id % 5 <> 0) as own from v group by 1),
        d as (select u.session_id, e, seqs, case when u.session_id % 11 = 0 then 'blocked' when n > 1 and not near then 'refuse' when n > 1 then 'collapse' when n is null then 'create'
          when own and u.session_id % 2 = e % 2 then 'keep' else 'replace' end as decision from u left join h using (session_id))
        select session_id, decision, case when decision in ('collapse', 'create', 'replace') then e % 6 + 1 end as generation, case when decision in ('collapse', 'replace') then seqs end as covered from d""",
    "summary_violations": """with r as (select event_id, event_id // 10 as g, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, event_type || ' ' || props as content from events),
        i as (select g, case when k % 41 = 0 then event_id + 1000000000 else event_id end as s, k, event_id, event_type, content from r where k % 29 <> 0),
        bad as (select g, s, case when s >= 1000000000 then 'unknown-source' when k % 47 = 0 then 'duplicate-source' when k % 3 = 0 and k % 43 = 0 then 'call-mismatch'
          when k % 31 = 0 or k % 37 = 0 then 'claim-not-in-source' end as reason from i)
        select g as group_id, s as source_seq, reason from bad where reason is not null
        union all select r.g, r.event_id, 'missing-source' from r where r.g in (select g from i) and r.event_id not in (select s from i)""",
    "entry_verdicts": f"""with {ENTRIES}, c as (select cand.*, count(*) over (partition by session_id, kind) as size, case when id is not null then count(*) over (partition by session_id, id) end as times from cand)
        select c.session_id, c.kind, ordinal, c.content, coalesce(c.id, {MINTED.replace('kind', 'c.kind').replace('session_id', 'c.session_id').replace('content', 'c.content')}) as id,
          case when size > 50 then 'too-many-entries' when c.id is null then null when b.id is null then 'unknown-id' when times > 1 then 'repeated-id' when b.kind <> c.kind then 'moved-id' when b.content <> c.content then 'changed-content' end as reason
        from c left join base b on b.session_id = c.session_id and b.id = c.id""",
    "merged_edit": f"""with {ENTRIES}, t as (select *, row_number() over (partition by session_id, kind, content order by ordinal) as n from cand), b as (select *, row_number() over (partition by session_id, kind, content order by id) as n from base)
        select session_id, kind, ordinal, content, coalesce(b.id, {MINTED}) as id, b.id is not null as kept from (select * exclude (id) from t) t left join (select session_id, kind, content, n, id from b) b using (session_id, kind, content, n)""",
    "content_digest": f"""with {ENTRIES} select session_id, sha256(string_agg(kind || '|' || id || '|' || content, chr(10) order by kind, event_id)) as digest from base group by 1""",
    "evidence_split": """select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_type = 'view' as kept from events""",
    "maintenance_tiers": f"""with {TOOL_LOG}, sums as (select session_id, cast(sum(tokens) as bigint) as total from surface group by 1)
        select session_id, total, case when total >= 48000 then 'pressure' when total >= 42000 then 'forget' when total >= 24000 then 'tools' else 'none' end as tier from sums""",
    "prune_pass": f"""with {TOOL_LOG}, {cuts('surface')}, {zones(12000, 30000)}, ends as (select session_id, max(seq) + 1 as top from tool_log group by 1),
        p as (select z.session_id, z.seq, z.tokens, top, row_number() over (partition by z.session_id order by pos) - 1 as i from zoned z join ends using (session_id) where type = 'tool/result' and chars > case when zone = 'recent' then 9000 else 6000 end)
        select session_id, top + 2 * i as seq, 'compaction/prune' as type, null as covered, cast(tokens as bigint) as tokens from p
        union all select session_id, top + 2 * i + 1, 'tool/result', seq, (4096 + 39 + 1024 + 3) // 4 + 8 from p""",
    "group_replacements": f"""with {TOOL_LOG}, {cuts('surface')}, {SEGMENTS}, ends as (select session_id, max(seq) + 1 as top from tool_log group by 1),
        p as (select *, pos * 37 % 1500 + 60 as price from seg where type = 'tool/result'), q as (select p.*, top, row_number() over (partition by p.session_id order by pos) - 1 as i from p join ends using (session_id) where price < tokens)
        select session_id, top + 2 * i as seq, 'compaction/prune' as type, null as covered, cast(tokens as bigint) as tokens from q union all select session_id, top + 2 * i + 1, 'tool/result', seq, price from q""",
    "region_replacements": f"""with {TOOL_LOG}, {cuts('surface')}, {zones(12000, 30000)}, ends as (select session_id, max(seq) + 1 as top from tool_log group by 1),
        b as (select session_id, pos, upto from zoned where zone = 'forget' and open_after = 0 and step_end and upto <= 6000),
        pick as (select session_id, coalesce(min(pos) filter (upto >= 4000), max(pos)) as pos from b group by 1),
        s as (select pick.session_id, pick.pos + 1 as n, upto, session_id % 7 * 900 + 100 as price, top from pick join b using (session_id, pos) join ends using (session_id))
        select session_id, top as seq, 'compaction/start' as type, cast(0 as bigint) as n_covered, cast(null as varchar) as error from s
        union all select session_id, top + 1, 'compaction/summary', 0, null from s where price < upto union all select session_id, top + 2, 'user/message', n, null from s where price < upto
        union all select session_id, top + 3, 'compaction/end', 0, null from s where price < upto union all select session_id, top + 1, 'compaction/end', 0, 'summary-not-smaller' from s where price >= upto""",
    "reentry_verdicts": f"""with {TOOL_LOG}, {REPLACED}, gone as (select session_id, unnest(covers) as seq from rlog),
        shown as (select * from rlog where type in ('user/message', 'assistant/message', 'tool/result') and (session_id, seq) not in (select session_id, seq from gone))
        select session_id, seq, case when len(covers) = 0 or type = 'tool/result' then 'new-original-content' when max(seq) over (partition by session_id) > seq then 'new-coverage' else 'no-new-coverage' end as verdict from shown""",
    "tool_debt": f"""with recursive {TOOL_LOG}, {cuts('surface')}, {zones(12000, 30000)}, {SEGMENTS},
        good as (select session_id, island from seg join starts using (session_id) group by all having count(*) filter (type = 'tool/result') >= 2
          and sum(chars) filter (type = 'tool/result') >= 12000 and sum(tokens) >= 2000 and max(pos) < max(recent_start)),
        picked as (select seg.* from seg join good using (session_id, island)), {CHUNKS.format(cap=12000)},
        g as (select session_id, {TOTALS} from atoms0 join (select session_id, island, atom, chunk from fold) using (session_id, island, atom) group by session_id, island, chunk),
        gg as (select session_id, min(start_pos) as p, count(*) as n from g where results >= 2 and chars >= 12000 and tokens between 2000 and 12000 group by 1),
        longs as (select session_id, min(pos) as p from zoned where zone <> 'recent' and type = 'tool/result' and chars > 9150 group by 1),
        ids as (select distinct session_id from zoned where zone <> 'recent')
        select session_id, case when coalesce(longs.p, case when session_id % 4 <> 0 then gg.p end) is not null then 'actionable' when gg.n > 0 then 'inert' else 'none' end as debt,
          coalesce(longs.p, case when session_id % 4 <> 0 then gg.p end) as first_pos from ids left join longs using (session_id) left join gg using (session_id)""",
    "effective_cursors": """with r as (select user_id as s, count(*) filter (event_type = 'click') as c, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'error') as e from events group by 1),
        m as (select *, case when s % 3 <> 0 then e end as b, case when s % 5 < 3 then case when s % 3 <> 0 then e end when s % 5 = 3 then e + 1 end as marker from r)
        select s as session_id, case when marker is not null and marker is distinct from b then coalesce(b - 1, -1)
          else greatest(case when c % 4 <> 0 then c else -1 end, case when v % 3 = 0 then v else -1 end, coalesce(b - 1, -1)) end as cursor from m""",
    "surface_alignment": f"""with {TOOL_LOG}, p as (select session_id, seq, case when seq % 89 = 0 then 2 else 1 end as n from tool_log where seq % 97 <> 0 and (type <> 'turn/end' or seq % 10 = 0))
        select session_id, seq, case when n is null then 'unpriced' when pos is null then 'not-on-surface' else 'priced-twice' end as reason
        from (select session_id, seq, pos from surface) s full join p using (session_id, seq) where n is null or pos is null or n > 1""",
    "surface_ranges": f"""with {TOOL_LOG}, a as (select distinct session_id, r as range_id, lo, hi from surface cross join (values (0, 0, 9), (1, 5, 30), (2, 40, 100000)) as v(r, lo, hi)),
        sizes as (select session_id, count(*) as n from surface group by 1)
        select a.session_id, range_id, arg_min(seq, pos) as start_seq, arg_max(seq, pos) as end_seq, cast(sum(tokens) as bigint) as tokens
        from a join sizes using (session_id) left join surface s on s.session_id = a.session_id and pos between lo and hi and hi < n group by 1, 2""",
    "span_checks": f"""with {TOOL_LOG}, {cuts('surface')}, a as (select session_id, seq as s, seq + case when seq % 70 = 3 then -2 else 6 end as e from tool_log)
        select a.session_id, s as range_id, case when x.pos is null then 'start-not-on-surface' when y.pos is null then 'end-not-on-surface' when x.pos > y.pos then 'reversed'
          when x.open_before <> 0 then 'open-before-start' when y.open_after <> 0 then 'open-after-end' end as reason
        from a left join cuts x on x.session_id = a.session_id and x.seq = s left join cuts y on y.session_id = a.session_id and y.seq = e""",
    "fold_backlog": """with ev as (select user_id as session_id, event_type, event_id as i, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events),
        r as (select session_id as s, count(*) filter (event_type = 'click') as c, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'error') as e from ev group by 1),
        m as (select *, case when s % 3 <> 0 then e end as b, case when s % 5 < 3 then case when s % 3 <> 0 then e end when s % 5 = 3 then e + 1 end as marker from r),
        k as (select s as session_id, case when marker is not null and marker is distinct from b then coalesce(b - 1, -1)
          else greatest(case when c % 4 <> 0 then c else -1 end, case when v % 3 = 0 then v else -1 end, coalesce(b - 1, -1)) end as cursor from m),
        said as (select *, case event_type when 'click' then true when 'error' then true when 'view' then k % 7 <> 0 or k % 5 = 0 or k % 3 = 0
          else case i % 6 when 0 then k % 4 <> 0 and k % 5 <> 0 when 1 then k % 5 <> 0 when 5 then k % 5 <> 0 else true end end as means from ev where event_type <> 'purchase')
        select k.session_id, count(*) filter (seq > cursor and means) as waiting, coalesce(max(seq), 0) as high_water from k left join said on said.session_id = k.session_id group by 1""",
    "audit_counts": f"""with {AUDIT}, c as (select session_id, case when status in ('success', 'manual', 'repair') then 'committed' when status in ('open', 'aborted') or (status = 'failure' and code in ('ABORTED', 'SERVICE_DISPOSED')) then 'aborted'
        when status = 'terminal-infeasible' or code = 'BUDGET' then 'terminal-infeasible' else 'transient-failure' end as classification from audit) select session_id, classification, count(*) as n from c group by 1, 2""",
}
