"""DuckDB SQL for queries over operations in order, written as state machines that take one operation at a time."""

from __future__ import annotations

from loomstrand.oracles import AUTHORITY, GROUP_AUDIT, REPLACED, SEGMENTS, TOOL_LOG, cuts
from loomstrand.oracles import ORACLE_SQL as SURFACE_SQL

OPERATIONS = """ev as (select user_id as session_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as op_no, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events),
o0 as (select *, op_no // 5 as r, case when op_no % 5 = 0 then k % 11 <> 0 else event_type = 'signup' end as opens from ev),
ops as (select session_id, 'q' || r as request_id, op_no, case when opens then 'open' when event_type in ('purchase', 'error') then 'settle' else 'finish' end as op,
    session_id * 10 + cast(k % 13 = 0 as int) as created_at, case when session_id % 4 <> 0 then 'dir' || cast(k % 17 = 0 as int) end as cwd, r as revision,
    case when not opens and k % 29 <> 0 then ['success', 'repair', 'failure', 'aborted'][k % 4 + 1] end as outcome,
    r + cast(k % 7 = 0 as int) + cast(k % 19 = 0 as int) as end_revision, k + cast(k % 23 = 0 as int) as end_cursor, r + cast(k % 7 = 0 as int) as stable_revision, k as stable_cursor,
    row_number() over (partition by session_id, r order by op_no) as n from o0),
fold(session_id, request_id, n, is_open, created_at, cwd, revision, outcome, end_revision, end_cursor, op_no, op, verdict) as (
  select session_id, request_id, 0::bigint, false, null::bigint, null::varchar, null::bigint, null::varchar, null::bigint, null::bigint, null::bigint, null::varchar, null::varchar from ops where n = 1
  union all
  select session_id, request_id, n, is_open or v = 'opened', case when v = 'opened' then o_created else created_at end, case when v = 'opened' then o_cwd else cwd end,
    case when v = 'opened' then o_revision else revision end, case when v in ('settled', 'repair-replaced') then o_outcome else outcome end,
    case when v in ('settled', 'repair-replaced') then o_end else end_revision end, case when v in ('settled', 'repair-replaced') then o_cursor else end_cursor end, op_no, op, v
  from (select f.session_id, f.request_id, o.n, f.is_open, f.created_at, f.cwd, f.revision, f.outcome, f.end_revision, f.end_cursor, o.op_no, o.op,
      o.created_at as o_created, o.cwd as o_cwd, o.revision as o_revision, o.outcome as o_outcome, o.end_revision as o_end, o.end_cursor as o_cursor,
      case when o.op = 'open' then case when f.is_open then 'already-open' else 'opened' end
        when not f.is_open then 'missing-key' when o.outcome is null then 'no-outcome'
        when o.op = 'settle' and (o.created_at is distinct from f.created_at or o.cwd is distinct from f.cwd) then 'other-lifecycle'
        when o.op = 'settle' and f.revision is distinct from o.stable_revision then 'other-revision'
        when o.op = 'settle' and o.outcome in ('success', 'repair') and (o.end_revision <> o.stable_revision or o.end_cursor <> o.stable_cursor) then 'uncertified'
        when f.outcome is null then 'settled'
        when o.op = 'finish' and f.outcome = 'repair' and o.outcome = 'success' then 'repair-replaced' else 'already-settled' end as v
    from fold f join ops o on o.session_id = f.session_id and o.request_id = f.request_id and o.n = f.n + 1))"""

#: Blocks in order, written out by hand for each form of the derived messages.
BLOCKS = """bt as (select doc_id as k, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
bp as (select k, k % 50 as session_id, k % 3 = 0 as recent, row_number() over (partition by k % 50 order by k) - 1 as pos, lambda_parts.* from bt,
    lateral (select substr(t, 1, n * 15 // 100) as a, substr(t, n * 15 // 100 + 1, n * 40 // 100 - n * 15 // 100) as b, substr(t, n * 40 // 100 + 1, n * 55 // 100 - n * 40 // 100) as c,
      substr(t, n * 55 // 100 + 1, n * 60 // 100 - n * 55 // 100) as d, substr(t, n * 60 // 100 + 1, n * 90 // 100 - n * 60 // 100) as e, substr(t, n * 90 // 100 + 1, n - n * 90 // 100) as f,
      substr(t, 1, n * 50 // 100) as g, substr(t, n * 50 // 100 + 1, n - n * 50 // 100) as h, t as whole) as lambda_parts),
bl as (select k, session_id, recent, pos, unnest(case
    when k % 7 = 3 then [{'path': '0', 'kind': 'text', 'text': g}, {'path': '1', 'kind': 'image', 'text': null}, {'path': '2', 'kind': 'text', 'text': h}]
    when k % 7 = 5 then [{'path': '0', 'kind': 'tool-result', 'text': null}, {'path': '0.0', 'kind': 'image', 'text': null}]
    when k % 11 = 4 then [{'path': '0', 'kind': 'text', 'text': ''}, {'path': '1', 'kind': 'tool-result', 'text': null}, {'path': '1.0', 'kind': 'text', 'text': ''}, {'path': '1.1', 'kind': 'text', 'text': whole}]
    else [{'path': '0', 'kind': 'text', 'text': a}, {'path': '1', 'kind': 'tool-result', 'text': null}, {'path': '1.0', 'kind': 'text', 'text': b}, {'path': '1.1', 'kind': 'image', 'text': null},
      {'path': '1.2', 'kind': 'tool-result', 'text': null}, {'path': '1.2.0', 'kind': 'text', 'text': c}, {'path': '1.3', 'kind': 'text', 'text': d}, {'path': '2', 'kind': 'image', 'text': null},
      {'path': '3', 'kind': 'text', 'text': e}, {'path': '4', 'kind': 'tool-result', 'text': null}, {'path': '4.0', 'kind': 'text', 'text': f}, {'path': '4.1', 'kind': 'image', 'text': null}] end) as b from bp),
bb as (select k, session_id, recent, pos, b.path as path, b.kind as kind, b.text as text, coalesce(length(b.text), 0) as size, row_number() over (partition by k order by b.path) as i from bl),
units as (select *, 4 + coalesce(cast(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4) as bigint), 0) as tokens from bb),
ends as (select session_id, max(k) + 1 as next_seq from bp group by 1)"""


#: Both rows of every node picked from `made` (k, written, tokens) beside `before` (k, session_id, pos, tokens).
LANDED = """picked as (select b.k, b.session_id, b.tokens as old, m.tokens as new, m.written, next_seq + 2 * (row_number() over (partition by b.session_id order by b.pos) - 1) as begin_at
      from made m join before b using (k) join ends on ends.session_id = b.session_id where {chosen})
    select session_id, begin_at as seq, 'compaction/prune' as type, cast(null as bigint) as covered, cast(old as bigint) as tokens, cast(null as varchar) as digest from picked
    union all select session_id, begin_at + 1, 'tool/result', k, cast(new as bigint), md5(written) from picked"""
BEFORE = "before as (select k, session_id, pos, 4 + sum(tokens) as tokens, cast(sum(size) as bigint) as total from units group by all)"
UNITS = r"""4 + coalesce(cast(ceil((length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) / 4) as bigint), 0)"""
WRITTEN = """string_agg(path || ':' || kind || ':' || coalesce(text, case when kind = 'image' then '{"data":"i' || k || '","type":"image"}'
    else '{"toolCallId":"' || case when k % 7 = 5 then 'c' when k % 11 = 4 then 'd' when path = '1' then 'a' when path = '4' then 'b' else 'in' end || '"}' end), chr(10) order by path)"""

PROVENANCE = """rec as (select session_id, seq, shadow, (session_id * 7 + seq) % 17 as v, shadow % 2 = 0 as summary from rlog where shadow is not null),
rf as (select session_id, seq, shadow, v, case when v = 2 then 'other' else 'loomstrand' end as producer, case when v = 3 then 2 else 1 end as version,
    case when v = 4 then 'other' when summary then 'tool-summary' else 'tool-pruned' end as kind, case when v = 5 then [shadow + 1] when v = 12 then [] else [shadow] end as covered,
    case when v = 6 then [shadow + 1] when v = 7 then [shadow, seq + 5] when v = 11 then [shadow, shadow] when shadow > 0 then [shadow, shadow - 1] else [shadow] end as sources,
    case when v = 8 then case when summary then '' else 'g' end when summary then 'f' || shadow % 5 end as group_id, case when v = 9 then 99999 else 0 end as generation from rec),
rd as (select *, case when v = 10 then 'stale' else sha256(to_json(['loomstrand', '1', kind, '[' || array_to_string(covered, ',') || ']', '[' || array_to_string(sources, ',') || ']',
    coalesce('"' || group_id || '"', 'null'), cast(generation as varchar), '["kept \\"text\\" ' || (seq + 1) || '"]'])) end as digest from rf),
gen as (select session_id, count(*) filter (len(covers) > 0) as now from rlog group by 1),
rb as (select r.session_id, r.seq, d.kind, d.group_id, d.digest, d.covered, case when d.seq is null then 'no-price' when d.v = 1 then 'no-record' when d.producer <> 'loomstrand' then 'foreign-producer'
    when d.version <> 1 then 'unknown-version' when d.kind not in ('tool-summary', 'tool-pruned') then 'unknown-kind' when len(d.covered) = 0 or len(d.sources) = 0 then 'malformed-seqs'
    when d.covered <> [d.shadow] then 'other-range' when not list_has_all(d.sources, d.covered) then 'uncited-cover'
    when list_max(d.sources) >= r.seq or len(list_distinct(d.sources)) < len(d.sources) then 'later-or-repeated-source'
    when (d.kind = 'tool-summary' and coalesce(d.group_id, '') = '') or (d.kind = 'tool-pruned' and d.group_id is not null) then 'wrong-group' when d.generation > gen.now then 'wrong-generation'
    when d.digest = 'stale' then 'stale-digest' end as fault
  from rlog r join gen using (session_id) left join rd d on d.session_id = r.session_id and d.seq = r.seq - 1 where r.type = 'tool/result' and len(r.covers) > 0),
sk as (select l.session_id, l.seq, l.type, l.covers, (select count(*) from rlog e where e.session_id = l.session_id and e.seq > l.seq and e.type = 'turn/end' and e.reason = 'completed') as after,
    case when l.type = 'user/message' and l.source_kind = 'checkpoint' and len(l.covers) > 0 then 'history-summary' when l.type <> 'tool/result' or len(l.covers) = 0 then 'original'
      when rb.fault is not null then 'unknown-replacement' else rb.kind end as own, case when rb.fault is null then rb.covered end as stated
  from rlog l left join rb using (session_id, seq) where l.type in ('user/message', 'assistant/message', 'tool/result'))"""

ATTEMPTS = """ev as (select user_id as session_id, 'f' || event_id % 9 as fingerprint, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events),
rows as (select session_id, fingerprint, event_id as opened, case when k % 5 <> 0 then event_id + k * 40 end as ended, ['success', 'failure', 'fallback', 'aborted', 'failure', 'repaired'][k % 6 + 1] as status,
    case when k % 4 <> 0 then k % 3 end as attempt, k % 7 = 0 as claims from ev where event_type = 'click' and k % 4 <> 1)"""

SLOTS = """sv as (select user_id as session_id, event_id as seq, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events),
slot as (select session_id, seq, pos from sv where event_type = 'purchase' and k % 23 = 0)"""

ORACLE_SQL = {
    "json_leaves": f"""with {AUTHORITY}, g as (select session_id, seq, k, revision, event_id from au where event_type = 'signup'), t as (select session_id, seq, k, event_id from au where event_type = 'view' and k % 5 <> 0)
        select session_id, seq, 'operation' as path, case when k = 0 then 'clear' else 'set' end as leaf from g
        union all select session_id, seq, 'goal.id', 'g' || k % 7 from g where k <> 0 union all select session_id, seq, 'goal.revision', cast(revision as varchar) from g where k <> 0
        union all select session_id, seq, 'goal.objective', 'objective ' || event_id from g where k <> 0
        union all select session_id, seq, 'todos[0].content', 'task ' || event_id from t union all select session_id, seq, 'todos[0].status', 'done' from t where k % 2 = 0""",
    "batch_window_bytes": """with recursive c as (select conv_id as session_id, turn as seq, role, case when strlen(text) <= 200 then text else left(text, list_last(list_filter(range(0, 198), lambda n: strlen(left(text, n)) <= 197))) || '…' end as said
          from conversations where trim(text) <> '' and (role = 'user' or (role = 'assistant' and turn % 7 <> 3))),
        e as (select session_id, '{"seq":' || seq || ',"type":"' || case role when 'user' then 'user/message' else 'assistant/message' end || '","kind":"' || case when role = 'assistant' then 'assistant'
            when seq % 4 = 2 then 'goal-continuation' else 'user' end || '","text":' || to_json(said) || '}' as written, seq, row_number() over (partition by session_id order by seq) as n from c),
        fold(session_id, n, list, source_cursor, bytes) as (select session_id, 0::bigint, '', null::bigint, cast(strlen('{"base":"","views":{},"events":[]}') as bigint) from e where n = 1
          union all select f.session_id, e.n, f.list || case when f.n > 0 then ',' else '' end || written, e.seq, cast(strlen('{"base":"","views":{},"events":[' || f.list || case when f.n > 0 then ',' else '' end || written || ']}') as bigint)
          from fold f join e on e.session_id = f.session_id and e.n = f.n + 1 where e.n <= 20 and f.bytes <= 2000),
        last as (select session_id, max(n) as n from fold where bytes <= 2000 group by 1)
        select f.session_id, case when l.n > 0 then 'window' else 'infeasible' end as outcome, l.n, f.source_cursor, case when l.n > 0 then f.bytes else (select bytes from fold k where k.session_id = f.session_id and k.n = 1) end as bytes
        from fold f join last l on l.session_id = f.session_id and l.n = f.n""",
    "eligible_spans": f"""with recursive {TOOL_LOG}, {cuts('surface')}, {SEGMENTS},
        r as (select session_id, island, pos, type = 'tool/result' as is_result, chars <= 6000 as ok, open_after = 0 and step_end as safe, row_number() over (partition by session_id, island order by pos) - 1 as i from seg),
        fold(session_id, island, i, current, last, safe_at, cut_list) as (select session_id, island, -1::bigint, null::boolean, -1::bigint, -1::bigint, [0::bigint] from r where i = 0
          union all select f.session_id, f.island, r.i, case when r.is_result and (current is null or (r.ok <> current and safe_at >= greatest(0, last))) then r.ok else current end, case when r.is_result then r.i else last end,
            case when r.safe then r.i else safe_at end,
            case when r.is_result and current is not null and r.ok <> current and safe_at >= greatest(0, last) and safe_at + 1 > list_last(cut_list) then list_append(cut_list, safe_at + 1) else cut_list end
          from fold f join r on r.session_id = f.session_id and r.island = f.island and r.i = f.i + 1),
        ends as (select session_id, island, cut_list from fold qualify row_number() over (partition by session_id, island order by i desc) = 1),
        parts as (select r.*, len(list_filter(cut_list, lambda c: c <= r.i)) as part from r join ends using (session_id, island))
        select session_id, min(pos) as start_pos, max(pos) as end_pos from parts group by session_id, island, part having bool_and(not is_result or ok)""",
    "segment_owners": f"""with {TOOL_LOG}, {cuts('surface')}, {SEGMENTS}, firsts as (select session_id, island, arg_min(seq, pos) as first_seq from seg group by 1, 2)
        select t.session_id, t.seq, first_seq, case when s.seq is null then 'not-on-surface' end as reason from tool_log t left join surface s on s.session_id = t.session_id and s.seq = t.seq
        left join seg on seg.session_id = t.session_id and seg.seq = t.seq left join firsts on firsts.session_id = seg.session_id and firsts.island = seg.island""",
    "ledger_snapshot": f"""with {TOOL_LOG}, {REPLACED}, {SLOTS}, sums as (select session_id, sum(tokens) as total from surface group by 1),
        f as (select session_id, arg_min(seq, pos) as seq from slot group by 1), g as (select session_id, count(*) filter (len(covers) > 0) as generation from rlog group by 1)
        select sums.session_id, generation, cast(total as bigint) as before_tokens, cast(total as bigint) as after_tokens, cast(48000 as bigint) as threshold, cast(42000 as bigint) as exit, total <= 42000 as exit_reached,
          cast(coalesce(case when f.seq % 2 = 0 then s.tokens end, case when f.seq % 3 > 0 then f.seq % 100 end, 0) as bigint) as injection_tokens
        from sums join g using (session_id) left join f using (session_id) left join surface s on s.session_id = f.session_id and s.seq = f.seq""",
    "slot_diagnostics": f"""with {SLOTS}, newest as (select session_id, max(pos) as generation, arg_max(seq, pos) as slot_seq from slot where seq % 5 <> 0 group by 1), lastev as (select session_id, max(pos) as last from sv group by 1)
        select r.session_id, slot_seq, generation, r.session_id % 9 + 1 as revision, md5(cast(r.session_id as varchar)) as digest, cast(strlen(r.text) as bigint) as text_bytes, r.session_id % 2 = 1 as stale, r.tokens, r.truncated
        from ({SURFACE_SQL['slot_render']}) r left join newest using (session_id) join lastev using (session_id)""",
    "attempt_gates": f"""with {ATTEMPTS}, asks as (select session_id, fingerprint, event_id as time from ev where event_type = 'view'),
        known as (select a.session_id, a.fingerprint, a.time,
          (select count(*) from ev l where l.session_id = a.session_id and l.fingerprint = a.fingerprint and l.event_type = 'purchase' and l.event_id % 11 = 0 and l.event_id <= a.time) as landed,
          (select count(*) from ev u where u.session_id = a.session_id and u.fingerprint = a.fingerprint and u.event_type = 'error' and u.k % 2 = 0 and u.event_id <= a.time) as lost,
          (select coalesce(sum(coalesce(attempt, 1)), 0) from rows r where r.session_id = a.session_id and r.fingerprint = a.fingerprint and opened <= a.time) as spent,
          (select count(*) from rows r where r.session_id = a.session_id and r.fingerprint = a.fingerprint and ended <= a.time and status in ('success', 'repaired')) as served,
          (select count(*) from rows r where r.session_id = a.session_id and r.fingerprint = a.fingerprint and opened <= a.time and (ended is null or ended > a.time) and claims) as claimed,
          (select count(*) from rows r where r.session_id = a.session_id and r.fingerprint = a.fingerprint and opened <= a.time and (ended is null or ended > a.time)) as held,
          (select count(*) from rows r where r.session_id = a.session_id and r.fingerprint = a.fingerprint and ended <= a.time and status = 'fallback') as refused from asks a)
        select session_id, fingerprint, time, case when landed > 0 then 'landed' when lost >= 2 then 'unwritten-exhausted' when spent >= 2 then 'attempts-exhausted' when served + claimed > 0 then 'served' when held > 0 then 'owed'
          when refused > 0 then 'refused' else 'owed' end as gate from known""",
    "served_seqs": f"with {GROUP_AUDIT} select distinct session_id, unnest(claims) as seq from ga where status in ('success', 'repaired') or (status = 'open' and len(claims) > 0)",
    "landed_merge": f"""with {GROUP_AUDIT}, u as (select session_id, fingerprint, request_id, unnest(claims) as c, generate_subscripts(claims, 1) as i from ga),
        f as (select session_id, fingerprint, c, min(request_id || lpad(cast(i as varchar), 5, '0')) as at_first from u group by 1, 2, 3),
        l as (select session_id, fingerprint, string_agg(cast(c as varchar), ',' order by at_first) as landed from f group by 1, 2)
        select distinct ga.session_id, ga.fingerprint, coalesce(landed, '') as landed from ga left join l using (session_id, fingerprint)""",
    "group_fingerprints": f"""with {TOOL_LOG}, s as (select session_id, pos // 8 as group_id, pos, seq, type, step, chars from surface where type <> 'user/message'),
        u as (select session_id, group_id, 2 * pos as at_pos, 'c' || step as id from s where type = 'tool/result' union all select session_id, group_id, 2 * pos + 1, 'c' || step % 3 from s where type = 'tool/result'),
        c as (select session_id, group_id, list(id order by at_pos) as ids from (select session_id, group_id, id, min(at_pos) as at_pos from u group by 1, 2, 3) group by 1, 2),
        g as (select session_id, group_id, list(seq order by pos) as seqs, list(type order by pos) as types, list('said "' || chars || '"' order by pos) as texts from s group by 1, 2)
        select session_id, group_id, sha256('{{"lifecycle":' || session_id || ',"sourceSeqs":' || to_json(seqs) || ',"callIds":' || to_json(coalesce(ids, [])) || ',"eventTypes":' || to_json(types) || ',"contentDigest":"'
          || sha256(to_json(texts)) || '","schemaVersion":1}}') as fingerprint from g left join c using (session_id, group_id)""",
    "view_carry": f"""with {AUTHORITY}, ids as (select session_id, max(seq) as through from ev group by 1),
        pick as (select session_id, through, (select max(seq) from goals g where g.session_id = ids.session_id) as gs, (select max(seq) from todos t where t.session_id = ids.session_id) as ts,
          (select max(seq) from goals g where g.session_id = ids.session_id and seq < 15) as bgs, (select max(seq) from todos t where t.session_id = ids.session_id and seq < 15) as bts from ids)
        select p.session_id, g.status as goal_status, g.objective, t.status as todo_status, t.seq as source_seq, through,
          array_to_string(list_filter([case when (g.status, g.goal_id, g.revision, g.objective) is distinct from (bg.status, bg.goal_id, bg.revision, bg.objective) then 'goal' end,
            case when (t.status, t.items) is distinct from (bt.status, bt.items) then 'todo' end], lambda x: x is not null), ',') as changed,
          array_to_string(list_filter([case when g.status = 'cleared' and bg.status = 'current' then 'goal' end, case when t.status = 'cleared' and bt.status = 'current' then 'todo' end], lambda x: x is not null), ',') as cleared
        from pick p left join goals g on g.session_id = p.session_id and g.seq = gs left join goals bg on bg.session_id = p.session_id and bg.seq = bgs
          left join todos t on t.session_id = p.session_id and t.seq = ts left join todos bt on bt.session_id = p.session_id and bt.seq = bts""",
    "fold_windows": """with recursive c as (select conv_id as session_id, turn as seq, role, text from conversations where trim(text) <> '' and (role = 'user' or (role = 'assistant' and turn % 7 <> 3))),
        e as (select session_id, '{"seq":' || seq || ',"type":"' || case role when 'user' then 'user/message' else 'assistant/message' end || '","fields":{"kind":"' || case when role = 'assistant' then 'assistant'
            when seq % 4 = 2 then 'goal-continuation' else 'user' end || '","text":' || to_json(text) || '}}' as written, seq, row_number() over (partition by session_id order by seq) as n from c),
        b as (select distinct conv_id as session_id, case when conv_id % 3 > 0 then '{"facts":"' || repeat('é', conv_id % 29 * 60) || '"}' else 'null' end as base from conversations),
        fold(session_id, base, n, list, source_cursor, bytes) as (select session_id, base, 0::bigint, '', null::bigint, cast(strlen('{"base":' || base || ',"events":[],"truncation":[]}') as bigint) from b
          union all select f.session_id, base, e.n, f.list || case when f.n > 0 then ',' else '' end || written, e.seq,
            cast(strlen('{"base":' || base || ',"events":[' || f.list || case when f.n > 0 then ',' else '' end || written || '],"truncation":[]}') as bigint)
          from fold f join e on e.session_id = f.session_id and e.n = f.n + 1 where e.n <= 20 and f.bytes <= 3000),
        last as (select session_id, max(n) as n from fold where bytes <= 3000 group by 1)
        select f0.session_id, case when f0.bytes > 3000 then 'infeasible' when f1.bytes is null then 'empty' when coalesce(l.n, 0) = 0 then 'infeasible' else 'window' end as outcome, coalesce(l.n, 0) as n,
          case when l.n > 0 then k.source_cursor end as source_cursor, case when f0.bytes > 3000 then f0.bytes when l.n > 0 then k.bytes else coalesce(f1.bytes, f0.bytes) end as bytes
        from fold f0 left join fold f1 on f1.session_id = f0.session_id and f1.n = 1 left join last l on l.session_id = f0.session_id left join fold k on k.session_id = f0.session_id and k.n = l.n where f0.n = 0""",
    "group_inputs": f"""with {TOOL_LOG}, x2 as (select session_id, pos // 8 as group_id, pos, case when type = 'tool/result' then '{{"sourceSeq":' || seq || ',"role":"tool-result","callId":"c' || seq || '","content":' || to_json(repeat('x"é' || chr(10) || '👍', chars // 10)) || '}}'
          when type = 'assistant/message' then '{{"sourceSeq":' || seq || ',"role":"tool-call","content":' || to_json(array_to_string(list_transform(range(0, tool_calls), lambda i: 'tool_' || k % 5 || ' {{"k": ' || k || '}}'), chr(10))) || '}}' end as item
          from surface where type <> 'user/message'),
        g as (select a.session_id, a.group_id, a.pos, count(*) as n, string_agg(b.item, ',' order by b.pos) as list from x2 a join x2 b on b.session_id = a.session_id and b.group_id = a.group_id and b.pos <= a.pos group by 1, 2, 3),
        p as (select *, 8 + cast(ceil((length(full_text) + length(regexp_replace(full_text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) / 4) as bigint) + 400 as tokens from (select *, 'Sum up.' || chr(10) || chr(10) || 'INPUT:' || chr(10) || '{{"version":1,"items":[' || list || ']}}' as full_text from g))
        select session_id, group_id, max(n) as items, coalesce(max(n) filter (tokens <= 3000), 0) as fitting, max(tokens) as tokens, max(tokens) <= 3000 as fits from p group by 1, 2""",
    "record_faults": f"""with {TOOL_LOG}, {REPLACED}, {PROVENANCE} select session_id, seq, case when fault is null then kind end as kind, case when fault is null then group_id end as group_id,
        case when fault is null then digest end as digest, fault from rb""",
    "replacement_coverage": f"""with recursive {TOOL_LOG}, {REPLACED}, {PROVENANCE},
        k as (select session_id, seq, case when type = 'tool/result' and len(covers) > 0 and (session_id + seq) % 3 = 0 and own <> 'tool-summary' then 'unknown-replacement' else own end as kind,
          case when len(covers) > 0 then coalesce(stated, covers) end as covered from sk),
        cites as (select distinct session_id, seq, unnest(covered) as cited, kind <> 'unknown-replacement' as proven from k where covered is not null),
        reach as (select session_id, seq, cited, proven from cites where cited < seq
          union select r.session_id, r.seq, c.cited, r.proven and c.proven from reach r join cites c on c.session_id = r.session_id and c.seq = r.cited where c.cited < c.seq),
        ends as (select session_id, seq, cited, bool_or(proven) as proven from reach r where not exists (select 1 from k where k.session_id = r.session_id and k.seq = r.cited and k.covered is not null) group by all),
        counted as (select session_id, seq, count(*) as origins, count(*) filter (proven) as proven from ends group by 1, 2)
        select k.session_id, k.seq, k.kind, array_to_string(covered, ',') as covered, coalesce(origins, 0) as origins, coalesce(proven, 0) as proven from k left join counted using (session_id, seq) where covered is not null""",
    "reentry_sources": f"""with {TOOL_LOG}, {REPLACED}, {PROVENANCE} select session_id, seq, own as kind, case when own = 'original' then 0 else after end as turns_after,
        own = 'original' or (own <> 'unknown-replacement' and after >= 2) as foldable, own = 'original' or (own <> 'unknown-replacement' and (after >= 2 or seq >= 60)) as at_once from sk""",
    "unrecorded_landings": f"""with {TOOL_LOG}, {REPLACED}, {PROVENANCE}, {GROUP_AUDIT} select distinct session_id, group_id from rb where fault is null and kind = 'tool-summary'
        and not exists (select 1 from ga where ga.session_id = rb.session_id and ga.fingerprint = rb.group_id and status = 'success' and len(claims) > 0)""",
    "block_measures": f"""with {BLOCKS} select session_id, k as seq, cast(sum(case when contains(path, '.') then 0 else size end) as bigint) as own_chars, cast(sum(size) as bigint) as chars,
        cast(4 + sum(tokens) as bigint) as tokens from units group by session_id, k""",
    "block_prunes": f"""with {BLOCKS}, {BEFORE}, placed as (select u.k, path, kind, text, size, i, recent, total, cast(sum(size) over (partition by u.k order by i) as bigint) - size as begin_at from units u join before using (k)),
        cutting as (select *, kind = 'text' and begin_at < total - 300 and begin_at + size > 700 as touched from placed where total > case when recent then 3000 else 1500 end),
        marked as (select *, min(i) filter (touched) over (partition by k) as first from cutting),
        cut as (select k, path, kind, case when kind = 'text' then substr(text, 1, least(size, greatest(0, 700 - begin_at))) || case when i = first then chr(10) || chr(10) || '[... tool result middle pruned ...]' || chr(10) || chr(10) else '' end
          || substr(text, least(size, greatest(0, total - 300 - begin_at)) + 1) end as text from marked),
        made as (select k, {WRITTEN} as written, 4 + sum({UNITS}) as tokens from cut where text is distinct from '' group by k),
        {LANDED.format(chosen='true')}""",
    "block_summaries": f"""with {BLOCKS}, {BEFORE}, tops as (select k, min(path) as first from units where kind = 'tool-result' and not contains(path, '.') group by 1),
        stays as (select k, path, kind, text from units join tops using (k) where not (kind = 'text' and length(path) - length(replace(path, '.', '')) = 1)
          union all select k, first || '.', 'text', repeat('summary ', k % 90) from tops),
        renamed as (select k, path, kind, text, case when ends_with(path, '.') then path || 'summary' else path end as shown from stays where k % 9 <> 1),
        made as (select k, {WRITTEN.replace("path || ':'", "shown || ':'")} as written, 4 + sum({UNITS}) as tokens from renamed group by k),
        {LANDED.format(chosen='m.tokens < b.tokens and b.total > 0')}""",
    "audit_rows": f"""with recursive {OPERATIONS} select session_id, request_id, created_at, cwd, revision, outcome, end_revision, end_cursor
        from fold where is_open qualify row_number() over (partition by session_id, request_id order by n desc) = 1""",
    "audit_operations": f"with recursive {OPERATIONS} select session_id, request_id, op_no, op, verdict from fold where n > 0",
    "control_mirror": """with recursive e0 as (select user_id % 8 as host, user_id as session_id, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
          row_number() over (partition by user_id % 8 order by event_id) - 1 as arrival from events),
        e1 as (select *, arrival // 400 as generation, arrival % 400 < 60 as opening, (arrival // 400) % 7 = 6 as empty from e0),
        opened as (select host, generation, row_number() over (partition by host order by generation) as rank from (select distinct host, generation from e1)),
        f as (select e1.*, rank, row_number() over (partition by host, session_id order by arrival) as n,
            case when event_type <> 'error' then k + event_id % 17 end as rev, case when event_type <> 'error' then 'state ' || event_id end as st
          from e1 join opened using (host, generation) where not (opening and empty)),
        fold(host, session_id, n, rank, generation, revision, stable) as (
          select host, session_id, n, rank, generation, rev, st from f where n = 1
          union all
          select f.host, f.session_id, f.n, f.rank, f.generation,
            case when not held then rev when rev is null then null when s.revision is null or rev > s.revision then rev else s.revision end,
            case when not held then st when rev is null then null when s.revision is null or rev > s.revision then st else s.stable end
          from (select fold.*, f.n as next, (f.rank = fold.rank or (f.rank = fold.rank + 1 and f.opening)) as held from fold join f on f.host = fold.host and f.session_id = fold.session_id and f.n = fold.n + 1) s
          join f on f.host = s.host and f.session_id = s.session_id and f.n = s.next)
        select host, session_id, generation, revision, stable from fold where rank = (select max(rank) from opened where opened.host = fold.host)
        qualify row_number() over (partition by host, session_id order by n desc) = 1""",
}
