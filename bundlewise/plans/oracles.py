"""DuckDB SQL that states each query's result independently, over the same tables."""

from __future__ import annotations

US = "epoch_us(ts)"
ISO = "strftime(ts,'%Y-%m-%dT%H:%M:%S.%fZ')"

LOGS = f"""logs as (
  select event_id as seq,
    case when event_id%97=0 then null else concat('u',user_id,'-',{US} // 3600000000) end as trace_id,
    case when event_id%89=0 then 'not-a-time' else {ISO} end as ts_text,
    case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then null else 'INFO' end as level,
    concat(event_type,' ',props) as message,
    case when event_id%3=0 then 'http' else 'kafka' end as source,
    {US} as us, ts, user_id
  from events),
valid as (select * from logs where trace_id is not null and ts_text <> 'not-a-time'),
bounds as (select trace_id, min(us) as first_us, max(us) as last_us, count(*) as n_trace from valid group by 1)"""

# malformed messages: truncated text or a JSON array
BROKEN = "(seq%101=0 or seq%103=0)"
STREAMED = f"streamed as (select * from valid where not {BROKEN})"

CALLS = f"""calls as (
  select event_id as call_id, ts, {US} as us, concat('svc',user_id%5) as service,
    case user_id%7 when 0 then 'gpt-4o-mini' when 1 then 'gpt-4o' when 2 then 'gpt-4.1-mini' when 3 then 'gpt-4.1'
                   when 4 then 'gpt-4' when 5 then 'gpt-35-turbo' else 'custom' end as model,
    cast(floor(value*10) as bigint) as pt, cast(floor(value*4) as bigint) as ct,
    case when event_type='error' then 'error' else 'ok' end as status, value/10 as latency_s
  from events),
prices(model, i, o) as (values ('gpt-4o-mini',15,60),('gpt-4o',250,1000),('gpt-4.1-mini',40,160),('gpt-4.1',200,800),
  ('gpt-4',3000,6000),('gpt-35-turbo',50,150)),
costed as (select c.*, strftime(ts,'%Y-%m-%d') as day,
    cast(pt*coalesce(i,250)+ct*coalesce(o,1000) as bigint) as cost_e8
  from calls c left join prices p on c.model = p.model)"""

ANSWERS = r"""answers as (
  select doc_id, doc_id%3 as kind, doc_id%13=0 as bad, concat('v',doc_id%3+1) as version,
    trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0b\x1c-\x1e\x{85}\x{2028}\x{2029}]+', ' ', 'g')) as cause,
    case doc_id%5 when 0 then 'db' when 1 then ' Auth ' when 2 then 'cache' when 3 then 'disk' else 'other' end as cat,
    case when n_chars%3=0 then 'High' when n_chars%3=1 then 'low' else 'medium' end as conf
  from documents),
kv as (select * from answers where kind=1 and not bad),
js as (select * from answers where kind=2 and not bad)"""

RUNS = """runs as (
  select c.*, v.embedding as vector, case when case_id%9=0 then null else concat('c', v.label) end as category from (
    select conv_id as case_id, row_number() over (partition by conv_id order by turn)-1 as run_idx,
      concat('v',conv_id%2+2) as version, case when turn=3 then '' else text end as text,
      case when turn=3 then 'timeout' end as err, (conv_id*8+turn)*7919%(select count(*) from embeddings) as vec_id, (length(text)%40)/10.0 as latency_s
    from conversations where role='assistant') c
  left join embeddings v on v.vec_id = c.vec_id),
gold as (
  select g.*, v.embedding as gold_vector from (
    select conv_id as case_id, arg_min(text, turn) as gold, conv_id*8*7919%(select count(*) from embeddings) as gold_vec_id
    from conversations where role='user' group by 1) g
  left join embeddings v on v.vec_id = g.gold_vec_id),
keyed as (
  select *, list_filter(string_split(gold,' '), lambda w, i: i%3=1) as expected,
    case when case_id%10=0 then []::varchar[] else list_filter(string_split(gold,' '), lambda w, i: i%5=2) end as anti_w from gold),
prime as (
  select case_id, count(*) as n_runs, max(case when run_idx=0 then version end) as version,
    max(case when run_idx=0 then text end) as text, max(case when run_idx=0 then category end) as category,
    cast(max(case when run_idx=0 then latency_s end) as double) as latency_s,
    case when coalesce(max(case when run_idx=0 then text end),'')='' then arg_min(err, run_idx) filter (where err is not null) end as error
  from runs group by 1)"""


def _r(x: str, digits: int) -> str:
    """printf rounds by the exact binary value, ties to even."""
    return f"cast(printf('%.{digits}f', {x}) as double)"


def _mean3(x: str) -> str:
    """Mean of values with three decimals over succeeded cases."""
    ok = "filter (where error is null)"
    return _r(f"cast(sum(cast({x} as decimal(18,3))) {ok} as double)/nullif(count({x}) {ok},0)", 3)


def _cos(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(range(1, len({a})+1), lambda i: cast({a}[i] as double)*cast({b}[i] as double)))"
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: cast(x as double)*cast(x as double))))"
    return f"(case when {a} is null or {b} is null then 0.0::double else {dot}/({norm(a)}*{norm(b)}) end)"


def _scored(answer: str) -> str:
    """CTE `scored` over rows (case_id, text, error, vector, latency_s, version) named `answer`."""
    hit = "cast(len(list_filter(expected, lambda w: contains(lower(text), lower(w)))) as double)/greatest(len(expected),1)"
    clean = "cast(len(list_filter(anti_w, lambda w: contains(lower(text), lower(w))=false)) as double)/greatest(len(anti_w),1)"
    emb = f"case when text='' or gold='' then 0.0::double else {_cos('vector', 'gold_vector')} end"
    blend = f"{_r('0.7::double*hit+0.3::double*clean', 3)}"
    return f"""scored0 as (
      select a.*, k.expected, k.anti_w, {hit} as hit, {clean} as clean, {emb} as emb
      from (select * replace (coalesce(text,'') as text) from {answer}) a join keyed k on a.case_id = k.case_id),
    scored as (
      select *, {blend} as keyword_score, case when error is null then {_r('emb', 3)} end as embedding_score from scored0),
    finals as (
      select *, case when embedding_score is null then keyword_score
        else {_r('0.5::double*keyword_score+0.5::double*embedding_score', 3)} end as both_score from scored)"""


FIRST = "first_answer as (select p.case_id, p.version, p.text, p.error, p.latency_s, r.vector from prime p join runs r on r.case_id=p.case_id and r.run_idx=0)"

AGREEMENT = f"""pairs as (
  select a.case_id, case when coalesce(a.text,'')<>'' and coalesce(b.text,'')<>'' then {_cos('a.vector', 'b.vector')} end as c,
    case when a.category is not null and b.category is not null then cast(a.category=b.category as int) end as m
  from runs a join runs b on a.case_id=b.case_id and a.run_idx<b.run_idx),
agreed as (
  select n.case_id, n.n_runs, p.pairwise_cos, p.category_agreement
  from (select case_id, count(*) as n_runs from runs group by 1) n
  left join (select case_id, {_r('avg(c)', 3)} as pairwise_cos, {_r('avg(m)', 3)} as category_agreement from pairs group by 1) p
    on n.case_id=p.case_id)"""

BUNDLES = """stepped as (select *, us - lag(us) over (partition by trace_id order by us, seq) as gap from {src}),
sessioned as (select *, sum(case when gap is null or gap>=600000000 then 1 else 0 end) over (partition by trace_id order by us, seq) as session from stepped),
placed as (select *, (row_number() over (partition by trace_id, session order by us, seq)-1)//2+1 as bundle from sessioned)"""

STREAKS = """marked as (select *, sum(cast(ok as int)) over (partition by k order by us, seq) as wins from attempts),
streaks as (select *, case when ok then 0 else sum(cast(not ok as int)) over (partition by k, wins order by us, seq) end as streak from marked)"""

ATTEMPTS = f"""attempts as (select user_id as k, event_id as seq, {US} as us, event_type not in ('error','click') as ok, props as record from events),
{STREAKS},
outcomes as (select k as bundle, seq, us, record, ok, cast(case when ok then 0 else (streak-1)%4+1 end as bigint) as attempt from streaks),
judged as (select *, case when ok then 'ok' when attempt>3 then 'dead_letter' else 'retry' end as outcome from outcomes)"""

LEDGER = f"""ledger as (select 'app.logs' as topic, user_id%8 as part, event_id as off, concat('u',user_id,'-',{US} // 3600000000) as trace_id,
  not (({US} // 3600000000)>=474000 and ({US} // 3600000000)%7=0) as done from events)"""

LINE = "concat('[',ts_text,'] ',coalesce(level,'?'),': ',coalesce(message,''))"

TEXTS = f"""texts as (
  select b.trace_id, count(*) as n_logs, count(*) filter (where l.trace_id=b.trace_id) as n_own,
    string_agg({LINE}, chr(10) order by l.us, l.seq) as log_text,
    count(*) filter (where level='ERROR') as n_err,
    coalesce(string_agg('"'||ts_text||'"', ', ' order by l.us, l.seq) filter (where level='ERROR'), '') as evidence,
    coalesce(string_agg('"'||ts_text||'"', ',' order by l.us, l.seq) filter (where level='ERROR'), '') as packed
  from bounds b join valid l on l.us between b.first_us-60000000 and b.last_us+60000000 group by 1)"""

KV_FIELDS = """doc_id, trim(cat) as category, cause as root_cause, cast(null as varchar) as next_step,
  'a|b' as evidence, conf as confidence"""
JS_FIELDS = """doc_id, cat as category, cause as root_cause, cast(null as varchar) as next_step,
  case doc_id%4 when 2 then '' when 3 then null else 'a|b' end as evidence, case when doc_id%5<>0 then conf end as confidence"""
NO_FIELDS = "cast(null as varchar) as category, cast(null as varchar) as root_cause, cast(null as varchar) as next_step, cast(null as varchar) as evidence, cast(null as varchar) as confidence"

ENRICHED = f"""enriched as (
  select doc_id, version, lower(trim(cat)) as category, cause as root_cause, cast(null as varchar) as next_step,
    '["a","b"]' as evidence, lower(conf) as confidence from kv
  union all
  select doc_id, version, lower(trim(cat)), cause, null,
    case when doc_id%4<2 then '["a","b"]' end, case when doc_id%5<>0 then lower(conf) end from js
  union all
  select doc_id, version, {NO_FIELDS} from answers where kind=0 or bad)"""


EMBED_MISSING = f"""with {RUNS} select distinct md5(text) as text_hash, length(text) as n_chars, length(text)-length(replace(text,'a','')) as n_a
            from runs where text<>'' and text not in (select gold from gold)"""

# what the default prompt v3 puts around the text of a bundle, for a window of 60 s
JOB_PROMPT = "Window 60s:\n\nKeys: category, root_cause, evidence"


def _admission(key: str, limit: int) -> str:
    """Hit by hit: the list of admitted instants of the last day decides."""
    live = "list_filter(f.q, lambda x: x >= h.us-86400000000)"
    return f"""with recursive h as (select {key} as k, {US} as us, event_id, row_number() over (partition by {key} order by ts,event_id) as rn from events),
            f as (select k,us,event_id,rn,true as allowed,[us] as q, cast(0 as bigint) as retry_us from h where rn=1
              union all
              select h.k,h.us,h.event_id,h.rn, len({live})<{limit},
                case when len({live})<{limit} then list_append({live}, h.us) else {live} end,
                case when len({live})<{limit} then 0 else 86400000000-(h.us-{live}[1]) end
              from f join h on h.k=f.k and h.rn=f.rn+1)
            select k as key, event_id as seq, allowed, cast(retry_us as bigint) as retry_us,
              case when not allowed then cast(retry_us//1000000+1 as bigint) end as retry_header from f"""


def oracle_sql() -> dict[str, str]:
    day = "strftime(ts,'%Y-%m-%d')"
    return {
        "parse_timestamps": f"""select event_id as seq, case event_id%14
            when 0 then {US} when 1 then {US} when 2 then epoch_us(date_trunc('second',ts))-19800000000
            when 3 then epoch_us(date_trunc('day',ts)) when 4 then epoch_us(date_trunc('second',ts))
            when 5 then epoch_us(date_trunc('millisecond',ts)) when 6 then null when 7 then null
            when 8 then epoch_us(date_trunc('minute',ts)) when 9 then {US}+7200000000
            when 10 then epoch_us(date_trunc('hour',ts)) when 11 then epoch_us(date_trunc('minute',ts))-19800000000
            else null end as us from events""",
        "validate_logs": f"""with {LOGS} select seq, case when {BROKEN} then 'not a json object' when trace_id is null then 'missing trace_id'
            when ts_text='not-a-time' then 'unreadable timestamp' else 'accepted' end as outcome from logs""",
        "raw_logs_normalized": f"""with {LOGS} select seq, trace_id, coalesce(level,'INFO') as level, message, us,
            concat('{{"user":',user_id,'}}') as payload, {day} as day from valid where not {BROKEN}""",
        "ingest_by_source": f"with {LOGS} select source, count(*) as n from logs group by 1",
        "client_key": """select event_id as seq, case event_id%4 when 0 then concat('10.0.0.',user_id) when 3 then 'unknown' else concat('h',user_id) end as client from events""",
        "oversize_requests": f"with {LOGS} select substr(ts_text,1,10) as request_id, count(*) as n_logs, count(*)>(select count(*)//count(distinct substr(ts_text,1,10)) from logs) as is_oversize from logs group by 1",
        "accepted_requests": f"with {LOGS} select substr(ts_text,1,10) as request_id, count(*) as n, cast(sum(seq) as bigint) as seqs from logs group by 1 having count(*)<=(select count(*)//count(distinct substr(ts_text,1,10)) from logs)",
        "trace_bounds": f"with {LOGS} select *, first_us-60000000 as lo_us, last_us+60000000 as hi_us from bounds",
        "correlate_bundles": f"""with {LOGS} select b.trace_id, row_number() over (partition by b.trace_id order by l.us, l.seq) as pos, l.seq,
            l.trace_id=b.trace_id as is_own, l.trace_id as log_trace_id
            from bounds b join valid l on l.us between b.first_us-60000000 and b.last_us+60000000""",
        "correlate_sizes": f"""with {LOGS} select b.trace_id, count(*) as n_logs, count(*) filter (where l.trace_id=b.trace_id) as n_own
            from bounds b join valid l on l.us between b.first_us-60000000 and b.last_us+60000000 group by 1""",
        "correlate_by_request": f"""with {LOGS}, v as (select *, substr(ts_text,1,10) as request_id from valid),
            b as (select request_id, trace_id, min(us)-3600000000 as lo, max(us)+3600000000 as hi from v group by 1,2)
            select b.request_id, b.trace_id, count(*) as n_logs, count(*) filter (where l.trace_id=b.trace_id) as n_own
            from b join v l on l.request_id=b.request_id and l.us between lo and hi group by 1,2""",
        "bundle_text": f"with {LOGS}, {TEXTS} select trace_id, n_logs, n_own, log_text from texts",
        "assign_bundles": f"""with {LOGS}, {BUNDLES.format(src='valid')}
            select trace_id, cast(session as bigint) as session, cast(bundle as bigint) as bundle, count(*) as n_logs,
              min(us) as first_us, max(us) as last_us, case when count(*)>=2 then 'batch_full' else 'idle' end as reason
            from placed group by 1,2,3""",
        "render_prompts": """select doc_id, concat('v',doc_id%4+1) as version,
            case doc_id%4 when 0 then md5(concat('Window 60s:',chr(10),text))
              when 1 then md5(concat('Window 60s:',chr(10),text,chr(10),'Fields: category, root_cause, evidence'))
              when 2 then md5(concat('Window 60s:',chr(10),text,chr(10),'Keys: category, root_cause, evidence')) end as message_hash,
            case when doc_id%4=3 then 'unknown prompt version: v4' end as reject_reason from documents""",
        "parse_kv_response": f"""with {ANSWERS} select {KV_FIELDS} from kv
            union all select doc_id, {NO_FIELDS} from answers where kind<>1 or bad""",
        "parse_json_response": f"""with {ANSWERS} select {JS_FIELDS} from js
            union all select doc_id, {NO_FIELDS} from answers where kind<>2 or bad""",
        "enrich_responses": f"with {ANSWERS}, {ENRICHED} select * from enriched",
        "vocab_violations": f"""with {ANSWERS}, {ENRICHED} select version, count(*) as n,
            count(*) filter (where category is null or category not in ('db','auth','network','memory','config','upstream','cache','kafka','other')) as bad_category,
            count(*) filter (where confidence is null or confidence not in ('high','medium','low')) as bad_confidence
            from enriched where category is not null or confidence is not null group by 1""",
        "analyze_stub": f"""with {LOGS}, {TEXTS} select trace_id, n_logs, concat('{{"category": "', case when n_err>0 then 'Upstream ' else 'other' end,
              '", "root_cause": "', n_err, ' of ', n_logs, ' lines are errors", "evidence": [', evidence, '], "confidence": "',
              case when n_err>1 then 'HIGH' else 'low' end, '"}}') as raw_text, 'stub' as model, n_err as completion_tokens,
              cast(null as varchar) as error from texts""",
        "triage_bundles": f"""with {LOGS}, {TEXTS} select trace_id, log_text, 'stub' as model, 'v3' as prompt_version,
              case when n_err>0 then 'upstream' else 'other' end as category, concat(n_err,' of ',n_logs,' lines are errors') as root_cause,
              case when n_err>0 then concat('[',packed,']') end as evidence, case when n_err>1 then 'high' else 'low' end as confidence
            from texts where trace_id <> ''""",
        "analyses_by_month": "select strftime(o_orderdate,'%Y-%m') as created_month, count(*) as n, count(distinct o_custkey) as n_traces from orders group by 1",
        "latest_analysis": """select concat('c',o_custkey) as trace_id, o_orderkey as id, o_orderstatus as analysis, concat('v',o_orderkey%3+1) as prompt_version,
            strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S.%fZ') as created_at
            from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn=1""",
        "retention_keep": "select o_orderkey as id, concat('c',o_custkey) as trace_id, strftime(o_orderdate,'%Y-%m') as created_month from orders where o_orderdate >= timestamp '1998-01-01'",
        "call_cost": f"with {CALLS} select call_id, cost_e8 from costed",
        "daily_spend": f"with {CALLS} select day, cast(sum(cost_e8) as bigint) as spent_e8, count(*) as n_calls from costed group by 1",
        "budget_status": f"""with {CALLS}, d as (select day, cast(sum(cost_e8) as bigint)/1e8::double as spent from costed group by 1)
            select day, 5.0::double as limit_usd, {_r('spent', 6)} as spent_usd, {_r('greatest(5.0::double-spent,0.0::double)', 6)} as remaining_usd from d""",
        "budget_admission": f"""with {CALLS} select call_id, day,
            coalesce(sum(cost_e8) over (partition by day order by us, call_id rows between unbounded preceding and 1 preceding),0) < 200000000 as allowed from costed""",
        "trailing_hits": f"""select distinct user_id as key, {US} as us,
            count(*) over (partition by user_id order by {US} range between 86400000000 preceding and current row) as hits from events""",
        "rate_limit_admission": _admission("user_id", 3),
        "rate_limit_busy_keys": _admission("user_id % 3", 40),
        "failure_incidents": f"""with {CALLS}, attempts as (select service as k, call_id as seq, us, status='ok' as ok from calls), {STREAKS},
            grouped as (select k, wins, count(*) as n_failures, min(us) as first_failure_us, max(case when streak=3 then us end) as opened_us
              from streaks where not ok group by 1,2 having count(*)>=3),
            closers as (select k, wins-1 as wins, us as closed_us from streaks where ok)
            select g.k as service, first_failure_us, opened_us, closed_us, n_failures from grouped g left join closers c on g.k=c.k and g.wins=c.wins""",
        "retry_outcomes": f"with {ATTEMPTS} select bundle, seq, attempt, outcome from judged",
        "dead_letter": f"with {ATTEMPTS} select bundle, seq, record, attempt, 'failed after 3 retries' as reason from judged where outcome='dead_letter'",
        "safe_offsets": f"with {LEDGER} select topic, part, coalesce(min(off) filter (where not done), max(off)+1) as commit_offset from ledger group by 1,2",
        "safe_offsets_for_trace": f"""with {LEDGER}, t as (select min(trace_id) as trace_id from ledger where not done),
            mine as (select distinct part from ledger where trace_id=(select trace_id from t)),
            rest as (select *, done or trace_id=(select trace_id from t) as fin from ledger where part in (select part from mine))
            select topic, part, coalesce(min(off) filter (where not fin), max(off)+1) as commit_offset from rest group by 1,2""",
        "triage_counters": f"""with {LOGS}, {CALLS}, {ATTEMPTS}, j as (select *, strftime(make_timestamp(us),'%Y-%m-%d') as day from judged)
            select {day} as day, 'logs_ingested' as metric, source as label, count(*) as n from valid group by 1,3
            union all select strftime(make_timestamp(first_us),'%Y-%m-%d'), 'windows_correlated', '', count(*) from bounds group by 1
            union all select {day}, 'results', substr(ts_text,1,10), count(distinct trace_id) from valid group by 1,3
            union all select day, 'calls', status, count(*) from costed group by 1,3
            union all select {day}, 'raw_logs_persisted', '', count(*) from valid group by 1
            union all select day, 'bundle_retries', '', count(*) from j where outcome='retry' group by 1
            union all select day, 'bundles_dlq', '', count(*) from j where outcome='dead_letter' group by 1""",
        "latency_histogram": f"""with {CALLS}, b(le, bound) as (values ('0.5',0.5),('1.0',1.0),('2.0',2.0),('5.0',5.0),('10.0',10.0),('20.0',20.0),
              ('30.0',30.0),('60.0',60.0),('+Inf',1e300)),
            s as (select service, count(*) as cnt, sum(latency_s) as total from calls group by 1)
            select s.service, b.le, (select count(*) from calls c where c.service=s.service and c.latency_s<=b.bound::double) as n,
              s.cnt as "count", round(s.total,3) as sum from s, b""",
        "latency_summary": f"""with {CALLS}, r as (select service, latency_s, row_number() over (partition by service order by latency_s) as rn,
              count(*) over (partition by service) as n, avg(latency_s) over (partition by service) as m from calls)
            select service, n, round(m,6) as mean_s, latency_s as p95_s, round(1.0::double/m,6) as rate_per_s from r
            where rn=greatest(cast(floor(n*0.95::double) as bigint),1)""",
        "cosine_pairs": f"""select a.vec_id, round({_cos('a.embedding', 'b.embedding')},6) as cos from embeddings a left join embeddings b on b.vec_id=a.vec_id+1""",
        "embed_missing": EMBED_MISSING,
        "embed_missing_bucketed": EMBED_MISSING,
        "primary_run": f"with {RUNS} select case_id, n_runs, version, md5(text) as text_hash, category, latency_s, error from prime",
        "score_keywords": f"""with {RUNS}, {FIRST}, {_scored('first_answer')}
            select case_id, {_r('hit', 3)} as keyword_hit, {_r('clean', 3)} as anti_clean, keyword_score,
              array_to_string(list_filter(expected, lambda w: contains(lower(text), lower(w))=false),'|') as missed,
              array_to_string(list_filter(anti_w, lambda w: contains(lower(text), lower(w))),'|') as violations from scored""",
        "score_embedding": f"with {RUNS}, {FIRST}, {_scored('first_answer')} select case_id, round(emb,6) as score from scored",
        "case_scores": f"""with {RUNS}, {FIRST}, {_scored('first_answer')}, m as (
              select case_id, 'keyword' as mode, cast(null as double) as embedding_score, keyword_score as case_score from finals
              union all select case_id, 'embedding', embedding_score, coalesce(embedding_score,0.0) from finals
              union all select case_id, 'both', embedding_score, both_score from finals)
            select *, case_score>=0.7::double as passed from m""",
        "run_agreement": f"with {RUNS}, {AGREEMENT} select * from agreed",
        "eval_report": f"""with {RUNS}, {FIRST}, {_scored('first_answer')}, {AGREEMENT}, r as (
              select f.*, a.pairwise_cos, a.category_agreement from finals f left join agreed a on a.case_id=f.case_id)
            select version, count(*) as n_cases, count(*) filter (where error is null) as n_succeeded,
              count(*) filter (where error is null and both_score>=0.7::double) as n_passing,
              coalesce({_mean3('both_score')},0.0) as mean_score,
              coalesce({_mean3('keyword_score')},0.0) as mean_keyword_score,
              {_mean3('embedding_score')} as mean_embedding_score,
              {_mean3('pairwise_cos')} as mean_agreement_pairwise_cos,
              {_mean3('category_agreement')} as mean_agreement_category,
              coalesce({_mean3('latency_s')},0.0) as mean_latency_s
            from r group by 1""",
        "compare_versions": f"""with {RUNS}, each_run as (select case_id, run_idx, version, text, err as error, latency_s, vector from runs),
            {_scored('each_run')}, a as (select concat('case',case_id) as id, both_score as s from finals where run_idx=0),
            b as (select concat('case',case_id) as id, both_score as s from finals where run_idx=1),
            j as (select coalesce(a.id,b.id) as id, a.s as a, b.s as b, b.s-a.s as d from a full join b on a.id=b.id)
            select id, a, b, {_r('d', 6)} as delta, case when d is null then '?' when d>0.05::double then '↑' when d<-0.05::double then '↓' else ' ' end as marker from j""",
        "stream_ingest": f"""with {LOGS} select 'app.logs' as topic, cast(user_id%8 as int) as partition, seq as "offset", 
            case when {BROKEN} then null else trace_id end as trace_id,
            case when {BROKEN} then 'not a json object' when trace_id is null then 'missing trace_id'
            when ts_text='not-a-time' then 'unreadable timestamp' else 'accepted' end as outcome from logs""",
        "stream_bundles": f"""with {LOGS}, {STREAMED}, {BUNDLES.format(src='streamed')}
            select trace_id, min(us) as first_us, max(us) as last_us, arg_min(seq, (us, seq)) as first_seq, arg_max(seq, (us, seq)) as last_seq,
              count(*) as n_logs, case when count(*)>=2 then 'batch_full' else 'idle' end as reason,
              md5(string_agg({LINE}, chr(10) order by us, seq)) as text_hash from placed group by trace_id, session, bundle""",
        "stream_bundles_arrival": f"""with {LOGS}, {STREAMED},
            placed as (select *, (row_number() over (partition by trace_id order by seq)-1)//2 as bundle from streamed)
            select trace_id, min(us) as first_us, max(us) as last_us, min(seq) as first_seq, max(seq) as last_seq,
              count(*) as n_logs, case when count(*)>=2 then 'batch_full' else 'idle' end as reason,
              md5(string_agg({LINE}, chr(10) order by seq)) as text_hash from placed group by trace_id, bundle""",
        "stream_triage": f"""with {LOGS}, {STREAMED}, {BUNDLES.format(src='streamed')},
            b as (select trace_id, count(*) as n, count(*) filter (where level='ERROR') as n_err from placed group by trace_id, session, bundle)
            select trace_id, count(*) as n_analyses, cast(sum(n_err) as bigint) as n_errors, cast(sum(n) as bigint) as n_raw, 'stub' as model,
              'v3' as prompt_version, '2026-05-06T10:00:00.000000Z' as created_at from b group by 1""",
        "stream_rejects": f"""with {LOGS}, r as (select cast(user_id%8 as int) as partition, seq, case when {BROKEN} then 'not a json object'
            when trace_id is null then 'missing trace_id' when ts_text='not-a-time' then 'unreadable timestamp' end as reject_reason from logs)
            select reject_reason, partition, count(*) as n, cast(sum(seq) as bigint) as offsets from r where reject_reason is not null group by 1,2""",
        "job_spend": f"""with {LOGS}, {TEXTS}, c as (select length(log_text)+{len(JOB_PROMPT)} as pt, n_err as ct from texts)
            select '2026-05-06' as day, cast(sum(pt*250+ct*1000) as bigint) as spent_e8, count(*) as n_calls from c""",
        "stream_sessions": f"""with {LOGS}, {STREAMED}, {BUNDLES.format(src='streamed')}
            select trace_id, min(us) as first_us, max(us) as last_us, count(*) as n_logs from placed group by trace_id, session""",
        "stream_daily_spend": f"with {CALLS} select day, cast(sum(cost_e8) as bigint) as spent_e8, count(*) as n_calls from costed group by 1",
        "stream_counters": f"with {LOGS} select us//3600000000*3600000000 as from_us, source, count(*) as n from logs group by 1,2",
    }
