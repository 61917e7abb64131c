"""SQL counterparts of the queries, for a row-by-row comparison in another engine."""

from __future__ import annotations

HOUR_MS = 3_600_000

_RECORDS = """
e as (select event_id, user_id, value, epoch_us(ts) // 1000 as ms,
             md5(concat('msg-', cast(event_id as varchar))) as h from events),
b as (select *, 0 as kind,
             event_id * 10 + case when event_id % 13 = 0 then 2005 else 0 end as ak from e),
d as (select * from b
      union all select * replace (1 as kind, ak + 3001 as ak) from b where event_id % 17 = 0
      union all select * replace (2 as kind, ak + 502 as ak) from b where event_id % 19 = 0),
s as (select *, row_number() over (order by ak, event_id, kind) - 1 as arrival_seq,
             (user_id % 50) % 4 as part,
             concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',
                    substr(h,21,12)) as u from d),
o as (select *, sum(case when kind <> 2 then 1 else 0 end)
             over (partition by part order by arrival_seq) - 1 as off0 from s),
r as (select *, max(case when kind = 0 then off0 end) over (partition by event_id) as base_off
      from o),
records as materialized (
  select cast(arrival_seq as bigint) as arrival_seq, 'events' as topic,
    cast({part} as int) as part, cast({off} as bigint) as off,
    cast(event_id as varchar) as key, cast(value as varchar) as value,
    case when event_id % 23 = 0 then null else concat('sender-', cast(user_id % 50 as varchar)) end
      as sender,
    case when event_id % 29 = 0 then 'invalid' else cast(ms as varchar) end as time_text,
    case when event_id % 31 = 0 then 'not-a-uuid' when event_id % 37 = 0 then null
         when kind = 1 and event_id % 2 = 0 then upper(u) else u end as id_text,
    cast(arrival_seq * 500 as bigint) as ingest_ms, kind, event_id
  from r),
n as materialized (
  select arrival_seq, topic, part, off, sender as sender_raw, sender as sender_key,
    time_text is not null as time_given, try_cast(time_text as bigint) as sender_ts,
    id_text is not null as id_given,
    case when length(id_text) = 36 then lower(id_text) end as message_id, ingest_ms, kind, value
  from records)"""

_SAME = {"part": "part", "off": "case when kind = 2 then base_off else off0 end"}
_ACROSS = {
    "part": "case when kind = 1 then (part + 1) % 4 else part end",
    "off": "case when kind = 1 then 100000 + arrival_seq when kind = 2 then base_off else off0 end",
}

_UNIQ_INPUT = """case when sender_key is null then 'no_sender' when not id_given then 'no_message_id'
  when message_id is null then 'invalid_uuid'"""


def _with(body: str, source: dict = _SAME) -> str:
    return f"with {_RECORDS.format(**source)}{body}"


def _chain(body: str, threshold: int = 0, cap: int = 10_000, ttl: int = 300_000,
           checks: tuple[str, ...] = ("custom", "uniqueness", "offset", "sender_watermark"),
           source: dict = _SAME, custom: bool = False, quota: int | None = None, lanes: bool = False) -> str:
    """One recursive step per record, all state in the row of the step."""
    tests = []
    if custom:
        tests.append("when cls = last_cls then 'value_repeat'")
    if quota is not None:
        tests.append(f"when taken >= {quota} then 'quota'")
    if "uniqueness" in checks:
        tests.append("when dup then 'uniqueness'")
    if "offset" in checks:
        tests.append("when off <= po then 'offset'")
    if "sender_watermark" in checks:
        tests.append(f"when pw - sender_ts > {max(0, threshold)} then 'sender_watermark'")
    failed = f"case {' '.join(tests)} end"
    entry, own, mine = "{'p': part, 'k': k, 't': ingest_ms}", "ids", "s.ids"
    if lanes:  # a key store for each partition
        own, mine = (f"list_filter({ids}, lambda x: x.p = {part})"
                     for ids, part in (("ids", "part"), ("s.ids", "q.part")))
    stored = (f"list_slice(list_filter(list_append({own}, {entry}), "
              f"lambda x: ingest_ms - x.t <= {ttl}), -{cap}, -1)")
    if lanes:
        stored = f"list_concat(list_filter(ids, lambda x: x.p <> part), {stored})"
    return f"""with recursive {_RECORDS.format(**source)},
q as materialized (
  select *, arrival_seq + 1 as i, concat(sender_key, ':', message_id) as k0,
    case when sender_key is not null and message_id is not null
         then concat(sender_key, ':', message_id) end as k,
    case when sender_raw is not null and sender_ts is not null
         then concat(sender_raw, '|', part) end as wk,
    cast(floor(cast(value as double) / 50) as int) as cls
  from n),
step as (
  select cast(0 as bigint) as i, map([]::int[], []::bigint[]) as offs,
    map([]::varchar[], []::bigint[]) as wms, []::struct(p int, k varchar, t bigint)[] as ids,
    map([]::varchar[], []::int[]) as classes, map([]::varchar[], []::int[]) as counts,
    cast(null as varchar) as failed_by, cast(null as bigint) as po, cast(null as bigint) as pw
  union all
  select i,
    case when failed_by is null then map_concat(offs, map([part], [off])) else offs end,
    case when failed_by is null and wk is not null
         then map_concat(wms, map([wk], [sender_ts])) else wms end,
    case when failed_by is null and k is not null
         then {stored} else ids end,
    case when failed_by is null and sender_raw is not null
         then map_concat(classes, map([sender_raw], [cls])) else classes end,
    case when failed_by is null and sender_raw is not null
         then map_concat(counts, map([sender_raw], [coalesce(taken, 0) + 1])) else counts end,
    failed_by, po, pw
  from (select *, {failed} as failed_by
        from (select q.*, s.offs, s.wms, s.ids, s.classes, s.counts, s.offs[q.part] as po, s.wms[q.wk] as pw,
                s.classes[q.sender_raw] as last_cls, s.counts[q.sender_raw] as taken,
                q.k is not null and list_contains(list_transform({mine}, lambda x: x.k), q.k) as dup
              from step s join q on q.i = s.i + 1) as looked_up) as tested),
judged as materialized (
  select q.arrival_seq, topic, part, off, sender_raw, sender_key, sender_ts, message_id, ingest_ms,
    id_given, time_given, kind, failed_by, failed_by is null as verified, po, pw,
    case when failed_by is null then 'SUCCESS' when failed_by = 'uniqueness'
         then 'FAILED_DUPLICATE' else 'FAILED_LATE_ARRIVAL' end as verdict,
    {_UNIQ_INPUT} when failed_by = 'uniqueness' then 'duplicate' else 'unique' end as uniq_outcome,
    case when failed_by = 'uniqueness' then null when po is null then 'first'
         when failed_by = 'offset' then 'out_of_order' else 'in_order' end as offset_outcome,
    case when failed_by in ('uniqueness', 'offset') then null
         when sender_raw is null or not time_given then 'no_headers'
         when sender_ts is null then 'invalid_timestamp' when pw is null then 'first'
         when failed_by = 'sender_watermark' then 'late_rejected'
         when sender_ts < pw then 'late_accepted' else 'in_order' end as wm_outcome
  from q join step on q.i = step.i)
{body}"""


_VERDICTS = ("select arrival_seq, verdict, verified, failed_by, uniq_outcome, offset_outcome, "
             "wm_outcome from judged")

_OFFSETS = """,
p as (select *, max(off) over (partition by topic, part order by arrival_seq
                               rows between unbounded preceding and 1 preceding) as prev_offset
      from n),
v as (select arrival_seq, part, off, prev_offset,
        coalesce(off > prev_offset, true) as verified,
        case when prev_offset is null then 'first' when off > prev_offset then 'in_order'
             else 'out_of_order' end as offset_outcome from p)"""

_WATERMARKS = """,
p as (select *, case when sender_raw is not null and sender_ts is not null then
          max(sender_ts) over (partition by sender_raw, topic, part order by arrival_seq
                               rows between unbounded preceding and 1 preceding) end
        as prev_watermark from n),
v as (select arrival_seq, sender_ts, prev_watermark,
        coalesce(sender_ts >= prev_watermark, true) as verified,
        case when sender_raw is null or not time_given then 'no_headers'
             when sender_ts is null then 'invalid_timestamp' when prev_watermark is null then 'first'
             when sender_ts >= prev_watermark then 'in_order' else 'late_rejected' end as wm_outcome
      from p)"""


def _watermark_walk(threshold: int, body: str) -> str:
    """Recursion per key, all keys side by side."""
    return f"""with recursive {_RECORDS.format(**_SAME)},
t as materialized (
  select *, row_number() over (partition by sender_raw, topic, part order by arrival_seq) as i
  from n where sender_raw is not null and sender_ts is not null),
step as (
  select arrival_seq, sender_raw, topic, part, i, cast(null as bigint) as prev_watermark,
         sender_ts as wm, true as ok from t where i = 1
  union all
  select t.arrival_seq, t.sender_raw, t.topic, t.part, t.i, s.wm,
         case when s.wm - t.sender_ts > {threshold} then s.wm else t.sender_ts end,
         s.wm - t.sender_ts <= {threshold}
  from step s join t on t.sender_raw = s.sender_raw and t.topic = s.topic and t.part = s.part
       and t.i = s.i + 1),
v as (select n.arrival_seq, s.prev_watermark, coalesce(s.ok, true) as verified,
        case when n.sender_raw is null or not time_given then 'no_headers'
             when n.sender_ts is null then 'invalid_timestamp'
             when s.prev_watermark is null then 'first' when not s.ok then 'late_rejected'
             when n.sender_ts < s.prev_watermark then 'late_accepted' else 'in_order' end
          as wm_outcome
      from n left join step s on s.arrival_seq = n.arrival_seq)
{body}"""


_LATE = ("case when verified then 'SUCCESS' else 'FAILED_LATE_ARRIVAL' end as verdict, verified")

_UNIQUE = f""",
f as (select *, row_number() over (partition by sender_key, message_id order by arrival_seq) as i
      from n),
v as (select arrival_seq, sender_key, message_id,
        sender_key is null or message_id is null or i = 1 as verified,
        {_UNIQ_INPUT} when i > 1 then 'duplicate' else 'unique' end as uniq_outcome from f)"""

_LOG = """,
log as materialized (select sender_key, message_id, ingest_ms as stored_ms,
                            arrival_seq as stored_seq, kind
        from n where sender_key is not null and message_id is not null),
store as materialized (select sender_key, message_id, max(stored_ms) as stored_ms,
                              max(stored_seq) as stored_seq from log group by all)"""

_SMALL_LIVE = """,
live as (select * from store where (select max(stored_ms) from log) - stored_ms <= 300000
         order by stored_ms desc, stored_seq desc limit 500)"""

_EXISTS = _LOG + _SMALL_LIVE + """
select p.arrival_seq, p.sender_key, p.message_id, l.message_id is not null as is_stored
from (select arrival_seq, message_id, unnest([sender_key, concat('x-', sender_key)]) as sender_key
      from n where sender_key is not null and message_id is not null) p
left join live l on l.sender_key = p.sender_key and l.message_id = p.message_id"""

_UUID = """,
c as (select arrival_seq, id_text as u from records where id_text is not null),
f as (select arrival_seq, unnest([
        u, upper(u), regexp_replace(u, '-0*', '-', 'g'), concat('0', u),
        concat(substr(u, 1, 4), '-1-2-3-', substr(u, 25, 12)),
        concat(substr(u, 1, 8), '-abcde-2-3-', substr(u, 25, 12)),
        replace(u, '-', ''), concat(substr(u, 1, 35), 'g'),
        concat('1-2-3-4-8', substr(replace(u, '-', ''), 1, 15)),
        concat('1-2-3-4-7', substr(replace(u, '-', ''), 1, 15))]) as id_text from c),
w as (select *, string_split(lower(id_text), '-') as p from f),
g as (select *, length(id_text) <= 36 and len(p) = 5 and list_bool_and(list_transform(p, lambda x:
          regexp_full_match(x, '0*([0-7][0-9a-f]{15}|[0-9a-f]{1,15})'))) as good from w)
select arrival_seq, id_text,
  case when good then concat(right(concat('00000000', p[1]), 8), '-',
    right(concat('0000', p[2]), 4), '-', right(concat('0000', p[3]), 4), '-',
    right(concat('0000', p[4]), 4), '-', right(concat('000000000000', p[5]), 12)) end as message_id
from g"""


_INF = "'infinity'::double"


def _pow2(n: int) -> str:
    """Bounds as rows (ord, upper_bound): 0, 1, 2, 4, ..., infinity."""
    return f"""select ord, case ord when 0 then 0.0 when {n - 1} then {_INF}
  else pow(2.0::double, ord - 1) end as upper_bound from (select unnest(range(0, {n})) as ord)"""


def _log_steps(n: int, low: float = 1.0, high: float = 1_000_000.0) -> str:
    """0, equal steps of the logarithm above ``low`` up to ``high``, infinity."""
    return f"""select ord, case ord when 0 then 0.0 when {n - 1} then {_INF}
  else exp(ln({low}::double) + (ln({high}::double) - ln({low}::double)) / {n - 2} * ord) end
  as upper_bound from (select unnest(range(0, {n})) as ord)"""


def _hybrid(n: int) -> str:
    """Tens up to a thousand, then geometric up to a million, infinity."""
    return f"""select ord, case when ord <= 100 then ord * 10.0::double when ord = {n - 1} then {_INF}
  else 1000 * pow(pow(1000.0::double, 1.0::double / {n - 102}), ord - 100) end as upper_bound
  from (select unnest(range(0, {n})) as ord)"""


def _histogram(source: str, bounds: str, prefix: str = "with ") -> str:
    """``source`` is a query with one double column x, ``bounds`` one with ord and upper_bound."""
    return f"""{prefix} src as ({source}),
bnd as (select ord as bucket, cast(upper_bound as double) as upper_bound from ({bounds})),
rng as (select bucket, upper_bound,
          lag(upper_bound, 1, '-infinity'::double) over (order by bucket) as below from bnd),
cnt as (select bucket, count(*) as n from src join rng on x > below and x <= upper_bound
        group by bucket)
select cast(b.bucket as int) as bucket, round(b.upper_bound, 4) as upper_bound,
  round(b.upper_bound, 2) as bound_2dp, coalesce(c.n, 0) as n
from bnd b left join cnt c on c.bucket = b.bucket"""


def _compare(source: str, methods: dict[str, str]) -> str:
    return "\nunion all\n".join(f"""select '{name}' as method, cast(count(*) as int) as n_bounds,
  max(upper_bound) filter (bucket = 1) as first_finite,
  max(upper_bound) filter (upper_bound < {_INF}) as last_finite,
  count(*) filter (n > 0) as occupied, max(n) as largest, cast(sum(n) as bigint) as n_rows
from ({_histogram(source, bounds)})""" for name, bounds in methods.items())


# Size of a filter for 12,000 keys and a false-positive rate of 0.01, and its bits.
_BLOOM = """
shape as (select 12000 as keys, cast(floor(-12000 * ln(0.01) / pow(ln(2), 2)) as bigint) as bits),
sized as (select keys, bits, cast(round(bits / keys * ln(2)) as int) as hashes from shape),
digests as (select distinct md5(concat(sender_key, ':', message_id)) as h from store),
numbers as (select cast(concat('0x', substr(h, 1, 15)) as bigint) as one,
                   cast(concat('0x', substr(h, 18, 15)) as bigint) as two from digests),
bits_of as (select distinct (one % bits + i * (two % (bits - 1) + 1)) % bits as bit
            from numbers, sized, range(0, 7) t(i) where i < hashes)
select keys as expected_keys, cast(bits as int) as n_bits, hashes as n_hashes, k as bits_set,
  k / bits as fill_ratio
from sized, (select count(*) as k from bits_of)"""


def _operations(body: str, cap: int = 75, ttl: int = 60_000) -> str:
    """One recursive step per store operation."""
    return f"""with recursive {_RECORDS.format(**_SAME)},
keyed as (select arrival_seq, concat(sender_key, ':', message_id) as k, sender_key, message_id, ingest_ms
          from n where sender_key is not null and message_id is not null),
ops as materialized (select *, row_number() over (order by op_seq) as i from (
  select 4 * arrival_seq as op_seq, 'store' as op, k, sender_key, message_id, ingest_ms as ms from keyed
  union all select 4 * (arrival_seq + 60) + 1, 'remove', k, sender_key, message_id, ingest_ms + 30000
            from keyed where arrival_seq % 5 = 0
  union all select 4 * (arrival_seq + 90) + 2, 'exists', k, sender_key, message_id, ingest_ms + 45000
            from keyed where arrival_seq % 3 = 0
  union all select 4 * arrival_seq + 3, 'clear', null, null, null, ingest_ms
            from n where arrival_seq % 3000 = 2999)),
step as (
  select cast(0 as bigint) as i, []::struct(k varchar, t bigint, s bigint)[] as ids,
    cast(null as boolean) as found
  union all
  select o.i,
    case o.op when 'clear' then []
      when 'remove' then list_filter(p.ids, lambda x: x.k <> o.k)
      when 'store' then list_slice(list_filter(list_append(
          list_filter(p.ids, lambda x: x.k <> o.k), {{'k': o.k, 't': o.ms, 's': o.op_seq}}),
        lambda x: o.ms - x.t <= {ttl}), -{cap}, -1)
      else p.ids end,
    case when o.op = 'exists' then list_contains(list_transform(p.ids, lambda x: x.k), o.k) end
  from step p join ops o on o.i = p.i + 1)
{body}"""


def oracle_sql() -> dict[str, str]:
    price = "select l_extendedprice as x from lineitem"
    total = "select o_totalprice as x from orders"
    accepted = "from judged where verified"
    offsets = f"select topic, part, max_by(off, arrival_seq) as latest_offset {accepted} group by all"
    watermarks = f"""
select sender_raw, topic, part, max_by(sender_ts, arrival_seq) as watermark_ms {accepted}
  and sender_raw is not null and sender_ts is not null group by all"""
    live = f""",
st as (select sender_key, message_id, max(ingest_ms) as stored_ms, max(arrival_seq) as stored_seq
       {accepted} and sender_key is not null and message_id is not null group by all)
select {{columns}} from st where (select max(stored_ms) from st) - stored_ms <= 300000
order by stored_ms desc, stored_seq desc limit 10000"""
    return {
        "envelope": _with("\nselect topic, part, off, key, value from records"),
        "header_last": _with("\nselect arrival_seq, case when event_id % 41 = 0 "
                             "then coalesce(sender, 'stale') else sender end as sender_raw, "
                             "time_text, id_text from records"),
        "parse_epoch_ms": _with("""
select arrival_seq, f as time_text, case when regexp_full_match(f, '[+-]?[0-9]+')
       then try_cast(f as bigint) end as epoch_ms
from (select arrival_seq, unnest([time_text, concat(' ', time_text), concat('+', time_text),
        concat('-', time_text), concat(time_text, '.0'), concat('9999999', time_text)]) as f
      from records)"""),
        "sender_instant": _with("""
select arrival_seq, sender_ts,
  strftime(make_timestamp(sender_ts * 1000), '%Y-%m-%d %H:%M:%S.%g') as instant_text
from n where sender_raw is not null and sender_ts is not null"""),
        "lateness": _with(_WATERMARKS + """
select arrival_seq, prev_watermark - sender_ts as lateness_ms from v
where prev_watermark is not null"""),
        "trim_blank": _with("""
select arrival_seq, case when event_id % 3 <> 1 then sender end as sender_key from records"""),
        "uuid_canonical": _with(_UUID),
        "record_keys": _with("""
select arrival_seq, concat(topic, '-', part) as topic_partition,
  case when sender_raw is not null and sender_ts is not null then
    concat('SenderPartitionKey{sender=''', sender_raw, ''', topic=''', topic, ''', partition=',
           part, '}') end as sender_partition,
  case when sender_key is not null and message_id is not null
       then concat(sender_key, ':', message_id) end as key_text,
  case when sender_key is not null and message_id is not null then
    concat('SenderMessageIdKey{sender=''', sender_key, ''', messageId=', message_id, '}') end
    as sender_message from n"""),
        "normalised_records": _with("""
select arrival_seq, topic, part, off, sender_raw, sender_key, time_given, sender_ts, id_given,
  message_id, ingest_ms from n"""),
        "bypassed_records": _with("""
select * from (select arrival_seq, sender_key is null or message_id is null as bypasses_uniqueness,
                 sender_raw is null or sender_ts is null as bypasses_watermark from n)
where bypasses_uniqueness or bypasses_watermark"""),
        "offset_order_verify": _with(_OFFSETS + f"""
select arrival_seq, part, off, prev_offset, {_LATE}, offset_outcome from v"""),
        "offset_outcome_counts": _with(_OFFSETS + """
select offset_outcome, count(*) as n from v group by all"""),
        "watermark_verify": _with(_WATERMARKS + f"""
select arrival_seq, prev_watermark, {_LATE}, wm_outcome from v"""),
        "watermark_verify_threshold": _watermark_walk(6 * HOUR_MS, f"""
select arrival_seq, prev_watermark, {_LATE}, wm_outcome from v"""),
        "watermark_outcome_counts": _watermark_walk(24 * HOUR_MS, """
select wm_outcome, count(*) as n from v group by all"""),
        "uniqueness_verify": _with(_UNIQUE + """
select arrival_seq, sender_key, message_id, verified, uniq_outcome,
  case when verified then 'SUCCESS' else 'FAILED_DUPLICATE' end as verdict from v"""),
        "uniqueness_outcome_counts": _with(_UNIQUE + """
select uniq_outcome, count(*) as n from v group by all"""),
        "uniqueness_verify_expiring": _chain(
            "select arrival_seq, sender_key, message_id, verdict, verified, uniq_outcome "
            "from judged", ttl=100_000, checks=("uniqueness",)),
        "stored_offsets_last": _with("""
select topic, part, max_by(off, arrival_seq) as stored_offset from n group by all"""),
        "stored_watermarks_last": _with("""
select sender_raw, topic, part, max_by(sender_ts, arrival_seq) as stored_watermark
from n where sender_raw is not null and sender_ts is not null group by all"""),
        "chain_verify": _chain(_VERDICTS),
        "chain_verify_chunked": _chain(_VERDICTS),
        "chain_verify_small_store": _chain(_VERDICTS, cap=100),
        "chain_small_store_chunked": _chain(_VERDICTS, cap=100),
        "uniqueness_expiring_chunked": _chain(
            "select arrival_seq, sender_key, message_id, verdict, verified, uniq_outcome "
            "from judged", ttl=100_000, checks=("uniqueness",)),
        "chain_custom_check_chunked": _chain(
            "select arrival_seq, verdict, verified, failed_by from judged", custom=True),
        "chain_verify_threshold": _chain(_VERDICTS, threshold=6 * HOUR_MS),
        "chain_verify_across_partitions": _chain(_VERDICTS, source=_ACROSS),
        "chain_custom_check": _chain(
            "select arrival_seq, verdict, verified, failed_by from judged", custom=True),
        "stream_chain_verify": _chain(_VERDICTS),
        "stream_lane_verify": _chain(_VERDICTS, cap=10**9, ttl=10**15),
        "stream_lane_offsets": _chain(offsets, cap=10**9, ttl=10**15),
        "stream_lane_keys": _chain(f""",
st as (select part, sender_key, message_id, max(ingest_ms) as stored_ms, max(arrival_seq) as stored_seq
       {accepted} and sender_key is not null and message_id is not null group by all),
placed as (select *, row_number() over (partition by part order by stored_seq desc) as place,
             max(stored_ms) over (partition by part) as newest from st)
select part, sender_key, message_id, stored_ms from placed
where place <= 100 and newest - stored_ms <= 100000""", cap=100, ttl=100_000, lanes=True),
        "stream_lane_store": _chain(_VERDICTS, cap=100, ttl=100_000, lanes=True),
        "accepted_records": _chain(
            f"select arrival_seq, part, off, sender_raw, sender_ts, message_id {accepted}"),
        "rejected_records": _chain("""
select arrival_seq, part, off, verdict, failed_by from judged where not verified"""),
        "accepted_payload": _chain("""
select r.arrival_seq, r.part, r.off, r.key, r.value, j.verdict
from records r join judged j on j.arrival_seq = r.arrival_seq where j.verified"""),
        "verdict_report": _chain("""
select arrival_seq, verdict, verified, failed_by, message_id,
  case failed_by
    when 'uniqueness' then concat('message id ', message_id, ' of sender ', sender_key,
                                  ' is already stored')
    when 'offset' then concat('offset ', off, ' of ', topic, '-', part, ' is not above ', po)
    when 'sender_watermark' then concat('SenderPartitionKey{sender=''', sender_raw, ''', topic=''',
      topic, ''', partition=', part, '} is ', pw - sender_ts, ' ms behind ', pw,
      ', threshold 0 ms') end as reason
from judged"""),
        "verdict_summary": _chain("""
select topic, part, verdict, failed_by, count(*) as n, min(arrival_seq) as first_seq,
  max(arrival_seq) as last_seq from judged group by all"""),
        "sender_summary": _chain("""
select sender_raw, count(*) as n, count(*) filter (not verified) as n_rejected
from judged group by all"""),
        "chain_counter_check": _chain(
            "select arrival_seq, verdict, verified, failed_by from judged", quota=150),
        "latest_offsets": _chain(offsets), "stream_latest_offsets": _chain(offsets),
        "latest_offset_lookup": _chain(f""",
a as (select topic, part, max_by(off, arrival_seq) as latest_offset {accepted} group by all)
select w.topic, w.part, coalesce(a.latest_offset, -1) as latest_offset
from (select distinct topic, unnest([part, part + 1]) as part from n) w
left join a on a.topic = w.topic and a.part = w.part"""),
        "all_watermarks": _chain(watermarks), "stream_watermarks": _chain(watermarks),
        "watermark_lookup": _chain(f""",
a as (select sender_raw, topic, part, max_by(sender_ts, arrival_seq) as watermark_ms {accepted}
        and sender_raw is not null and sender_ts is not null group by all)
select w.sender_raw, w.topic, w.part, a.watermark_ms
from (select distinct sender_raw, topic, unnest([part, (part + 1) % 4]) as part from n
      where sender_raw is not null) w
left join a on a.sender_raw = w.sender_raw and a.topic = w.topic and a.part = w.part"""),
        "key_store_upsert": _with(_LOG + "\nselect * from store"),
        "stored_keys_text": _with(_LOG + """
select *, concat(sender_key, ':', message_id) as key_text from store"""),
        "evict_by_time": _with(_LOG + """
select * from store where (select max(stored_ms) from log) - stored_ms <= 300000"""),
        "evict_by_size": _with(_LOG + """
select * from store order by stored_ms desc, stored_seq desc limit 500"""),
        "live_keys": _chain(live.format(columns="*")),
        "stream_live_keys": _chain(live.format(columns="sender_key, message_id, stored_ms")),
        "key_store_size": _with(_LOG + _SMALL_LIVE + "\nselect count(*) as n from live"),
        "key_store_ops": _operations("""
select op_seq, sender_key, message_id, found as is_stored from step join ops using (i)
where op = 'exists'"""),
        "key_store_after_ops": _operations("""
select o.sender_key, o.message_id, t as stored_ms, s as stored_seq
from (select unnest(ids, recursive := true) from (select ids from step order by i desc limit 1)) e
join ops o on o.op_seq = e.s"""),
        "key_remove": _with(_LOG + """
select * from store s where not exists (
  select 1 from log l where l.kind = 1 and l.sender_key = s.sender_key
    and l.message_id = s.message_id)"""),
        "key_store_after_clear": _with(_LOG + """
select sender_key, message_id, max(stored_ms) as stored_ms, max(stored_seq) as stored_seq
from log where stored_seq > (select max(stored_seq) // 2 from log) group by all"""),
        "key_exists": _with(_EXISTS),
        "bloom_then_exact": _with(_EXISTS),
        "bloom_build_stats": _with(_LOG + "," + _BLOOM),
        "stream_topic_verify": _chain(_VERDICTS),
        "stream_accepted": _chain("""
select r.off, r.part, r.key, r.value, r.ingest_ms
from records r join judged j on j.arrival_seq = r.arrival_seq where j.verified"""),
        "topic_round_trip": _chain("""
select 'accepted' as topic, r.key, r.value, r.sender as sender_text,
  1 + cast(r.sender is not null as int) + cast(r.id_text is not null as int) as n_headers
from records r join judged j on j.arrival_seq = r.arrival_seq where j.verified"""),
        "hist_hybrid": _histogram(total, _hybrid(150)),
        "hist_pow2": _histogram(price, _pow2(24)),
        "hist_log": _histogram(price, _log_steps(100)),
        "hist_log_range": _histogram(total, _log_steps(50, 100.0, 10_000.0)),
        "histogram_events_value": _histogram("select value as x from events", _pow2(10)),
        "histogram_lateness": _histogram(
            "select cast(prev_watermark - sender_ts as double) as x from v "
            "where prev_watermark is not null", _log_steps(30),
            _with(_WATERMARKS + ",")),
        "hist_compare": _compare(price, {
            "hybrid": _hybrid(150), "pow2": _pow2(24), "log": _log_steps(50),
            "log 0.1-100": _log_steps(50, 0.1, 100.0),
            "log 100-10000": _log_steps(50, 100.0, 10_000.0)}),
    }
