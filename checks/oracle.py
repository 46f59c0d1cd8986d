"""The fixture tables once more, as DuckDB common table expressions.

They follow FIXTURES.md and the operator rules directly: plain range joins and windows per
session, no buckets, blocks or running carries, so they check the Spark forms independently.
"""

from __future__ import annotations

import re


def rounded(x: str, digits: int) -> str:
    """Half-even rounding on the exact binary value."""
    s = f"{10 ** digits}::double"
    head = f"(({x})::float::double)"
    big, small = f"({head} * {s})", f"((({x}) - {head}) * {s})"
    whole = f"floor({big} + {small})"
    above = f"((({big} - {whole}) - 0.5::double) + {small})"
    return (f"(({whole} + case when {above} > 0 or ({above} = 0 and abs({whole}) % 2 = 1) "
            f"then 1::double else 0::double end) / {s})")


def whole_text(x: str) -> str:
    return f"({rounded(x, 0)}::bigint::varchar)"


def percent_text(x: str) -> str:
    return f"({whole_text(f'({x}) * 100::double')} || '%')"


def duration_text(x: str) -> str:
    return (f"(case when ({x}) < 60 then {whole_text(x)} || ' seconds' else "
            f"floor(({x}) / 60)::bigint::varchar || 'm ' || "
            f"lpad(floor(({x}) - floor(({x}) / 60) * 60)::bigint::varchar, 2, '0') || 's' end)")


LEX = r"(?:^|\s)(?:is|der|de|es)(?:\s|$)"

CTES: dict[str, str] = {}

CTES["utterances"] = """
select session_id, turn, role, text, start, start + dur as "end" from (
  select conv_id as session_id, turn, role, text, dur,
    2.0::double + coalesce(sum(dur + gap) over (partition by conv_id order by turn
      rows between unbounded preceding and 1 preceding), 0) as start
  from (select *, greatest(0.5::double, length(text) / 16.0::double) as dur,
          ((conv_id * 31 + turn * 17) % 23 - 6) / 4.0::double as gap from conversations))
"""
CTES["raw_turns"] = """
select session_id, turn, k, start + 8 * k as start, least("end", start + 8 * (k + 1)) as "end",
  case when role = 'assistant' then 'T' else 'S' || (turn % 2 + 1)::varchar end as speaker
from (select *, unnest(range(0, ceil(("end" - start) / 8)::bigint)) as k from utterances where role <> 'system')
union all
select session_id, turn, -1, start + 2, start + 3, 'S3' from utterances
where role <> 'system' and (session_id + turn) % 5 = 0 and start + 3 <= "end"
"""
CTES["turns"] = """
select session_id, (row_number() over (partition by session_id order by start, speaker, "end", turn, k))::int as turn_ix,
  start, "end", speaker from raw_turns
"""
CTES["segments"] = """
select session_id, (row_number() over (partition by session_id order by start, turn))::int as seg_ix, start, "end", text,
  case when (session_id + turn) % 7 <> 0 then -((session_id + turn) % 12) / 4.0::double end as avg_logprob,
  case when (session_id + turn) % 6 <> 0 then ((session_id + turn) % 8) / 8.0::double end as no_speech_prob
from utterances
"""
CTES["recordings"] = """select session_id, max("end") as actual_sec from utterances group by 1"""
CTES["transcripts"] = "select session_id, actual_sec as audio_sec from recordings where session_id % 13 <> 0"
CTES["spoken_segments"] = "select * from segments where session_id % 13 <> 0"
CTES["sessions"] = """
select session_id, case when session_id % 11 <> 0 then lpad((session_id % 30)::varchar, 5, '0') end as teacher_id,
  (['Paper Theatre', 'Paper Circuits', 'Bridge Building', 'Sound Lab'])[session_id % 4 + 1] as activity,
  (8 + session_id % 20)::int as total, ((8 + session_id % 20) // 2)::int as boys,
  (8 + session_id % 20 - (8 + session_id % 20) // 2 + case when session_id % 9 = 0 then 1 else 0 end)::int as girls,
  actual_sec, actual_sec * case session_id % 3 when 0 then 1.0::double when 1 then 1.5::double end as declared_sec,
  timestamp '2025-12-01 09:00:00' + to_days((session_id % 28)::int) + to_hours(session_id % 7) as recorded_at,
  case when session_id % 5 >= 3 then 19.0::double + (session_id % 8) / 8.0::double end as latitude,
  case when session_id % 5 >= 2 then 73.5::double end as longitude
from recordings
"""
CTES["spans"] = """
select session_id, min(start) as start, max("end") as "end" from (
  select *, sum(opens) over (partition by session_id order by start, "end" rows unbounded preceding) as island from (
    select *, case when start <= max("end") over (partition by session_id order by start, "end"
      rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens
    from (select session_id, greatest(start, 0) as start, least("end", actual_sec) as "end"
          from turns join recordings using (session_id)) where "end" > start))
group by session_id, island
"""
CTES["tiles"] = """
select session_id, (row_number() over (partition by session_id order by start) - 1)::int as segment_ix, start, "end", is_speech
from (
  select session_id, start, "end", true as is_speech from spans
  union all
  select session_id, coalesce(lag("end") over w, 0::double), start, false from spans
  window w as (partition by session_id order by start)
  union all
  select r.session_id, coalesce(max(s."end"), 0::double), r.actual_sec, false
  from recordings r left join spans s using (session_id) group by r.session_id, r.actual_sec)
where "end" > start
"""
CTES["timeline"] = """
select session_id, segment_ix, start, "end",
  -60.0::double + (session_id * 13 + segment_ix * 7) % 50 as rms_db,
  case when is_speech then 'speech' when -60 + (session_id * 13 + segment_ix * 7) % 50 >= -35 then 'handson' else 'dead' end as kind
from tiles
"""
CTES["main"] = """
select session_id, max(case when n = 1 then speaker end) as main_speaker,
  case when count(*) = 1 then 1.0::double
       else (max(case when n = 1 then sec end) - max(case when n = 2 then sec end))
            / (max(case when n = 1 then sec end) + max(case when n = 2 then sec end)) end as margin
from (select *, row_number() over (partition by session_id order by sec desc, first_ix) as n from (
  select session_id, speaker, sum("end" - start) as sec, min(turn_ix) as first_ix from turns group by 1, 2))
where n <= 2 group by 1
"""
CTES["coverage"] = """
select session_id, avg(case when hit then 1.0::double else 0.0::double end) as coverage from (
  select s.session_id, s.segment_ix, bool_or(t.turn_ix is not null) as hit
  from timeline s left join turns t on t.session_id = s.session_id and t.start < s."end" and t."end" > s.start
  where s.kind = 'speech' group by 1, 2) group by 1
"""
CTES["conf"] = """
select session_id, coverage, coverage * (0.5::double + 0.5::double * coalesce(margin, 0)) as confidence
from coverage left join main using (session_id)
"""
CTES["pieces"] = """
select session_id, segment_ix, pos as start, nxt as "end" from (
  select *, lead(pos) over (partition by session_id, segment_ix order by pos) as nxt from (
    select session_id, segment_ix, start as pos from timeline where kind = 'speech'
    union select session_id, segment_ix, "end" from timeline where kind = 'speech'
    union select s.session_id, s.segment_ix, e.pos from timeline s
      join (select session_id, start as pos from turns union select session_id, "end" from turns) e
        on e.session_id = s.session_id and e.pos > s.start and e.pos < s."end" where s.kind = 'speech'))
where nxt - pos >= 0.30::double
"""
CTES["piece_roles"] = """
select p.session_id, p.segment_ix, p.start, p."end",
  case when w.speaker is null then null when w.speaker = m.main_speaker then 'teacher' else 'student' end as role
from pieces p left join (
  select p.session_id, p.segment_ix, p.start, t.speaker, row_number() over (
    partition by p.session_id, p.segment_ix, p.start
    order by least(p."end", t."end") - greatest(p.start, t.start) desc, t."end" - t.start, t.turn_ix) as n
  from pieces p join turns t on t.session_id = p.session_id and t.start < p."end" and t."end" > p.start) w
  on w.session_id = p.session_id and w.segment_ix = p.segment_ix and w.start = p.start and w.n = 1
left join main m on m.session_id = p.session_id
"""
CTES["merged"] = """
select session_id, segment_ix, min(start) as start, max("end") as "end", nullif(max(held), 'none') as role from (
  select *, sum(opens) over (partition by session_id, segment_ix order by start rows unbounded preceding) as run from (
    select *, case when held = lag(held) over (partition by session_id, segment_ix order by start) then 0 else 1 end as opens from (
      select *, coalesce(last_value(case when role is not null then role when "end" - start > 1.0::double then 'none' end ignore nulls)
        over (partition by session_id, segment_ix order by start rows unbounded preceding), 'none') as held from piece_roles)))
group by session_id, segment_ix, run
"""
CTES["labelled"] = """
select t.session_id, t.segment_ix,
  case when m.n = 1 or m.start is null then t.start else m.start end as start,
  coalesce(m.nxt, t."end") as "end", t.kind, t.rms_db, m.role,
  case when m.role is not null then c.confidence end as role_conf
from timeline t left join (
  select *, lead(start) over w as nxt, row_number() over w as n from merged
  window w as (partition by session_id, segment_ix order by start)) m
  on m.session_id = t.session_id and m.segment_ix = t.segment_ix
left join conf c on c.session_id = t.session_id
"""
CTES["numbered"] = """
select *, (row_number() over (partition by session_id order by start) - 1)::int as seg_no from labelled
"""
CTES["span_text"] = """
select r.session_id, r.seg_no, string_agg(s.text, ' ' order by s.seg_ix) as text
from numbered r join spoken_segments s on s.session_id = r.session_id and s.start < r."end" and s."end" > r.start and s.text <> ''
group by 1, 2
"""
CTES["talk"] = """
select session_id,
  sum(case when kind = 'speech' and role = 'teacher' then "end" - start else 0 end) as teacher_sec,
  sum(case when kind = 'speech' and role = 'student' then "end" - start else 0 end) as student_sec,
  sum(case when kind = 'handson' then "end" - start else 0 end) as handson_sec,
  sum(case when kind = 'dead' then "end" - start else 0 end) as dead_sec,
  sum(case when kind = 'speech' and role is null then "end" - start else 0 end) as unattributed_sec,
  count(*) filter (kind = 'speech' and role = 'student') as student_turns,
  avg(role_conf) filter (kind = 'speech' and role is not null) as mean_role_conf
from labelled group by 1
"""
CTES["switches"] = """
select session_id, count(*) filter (role <> was) as switches from (
  select *, lag(role) over (partition by session_id order by start) as was
  from labelled where kind = 'speech' and role is not null) group by 1
"""
CTES["stretch"] = """
select session_id, max(till - since) as stretch_sec from (
  select session_id, min(start) as since, max("end") as till from (
    select *, sum(opens) over (partition by session_id order by start rows unbounded preceding) as run from (
      select *, case when start - lag("end") over w <= 3.0::double and foreign_before = lag(foreign_before) over w then 0 else 1 end as opens
      from (select *, count(*) filter (kind = 'speech' and role is distinct from 'teacher') over (
              partition by session_id order by start rows unbounded preceding) as foreign_before from labelled)
      where kind = 'speech' and role = 'teacher' window w as (partition by session_id order by start)))
  group by session_id, run) group by 1
"""
CTES["stats"] = """
select t.session_id, coalesce(sum(s."end" - s.start), 0) as speech_sec,
  least(1.0::double, coalesce(sum(s."end" - s.start), 0) / t.audio_sec) as speech_density,
  sum(s.avg_logprob * (s."end" - s.start)) filter (s.avg_logprob is not null and s."end" > s.start)
    / sum(s."end" - s.start) filter (s.avg_logprob is not null and s."end" > s.start) as mean_logprob,
  avg(s.no_speech_prob) as mean_no_speech, count(s.seg_ix) as segments
from transcripts t left join spoken_segments s using (session_id) group by t.session_id, t.audio_sec
"""
CTES["marked"] = """
select t.*, t.speaker = m.main_speaker as is_teacher from turns t join main m using (session_id)
"""
CTES["owners"] = """
select session_id, seg_ix, text, s_end, turn_ix, start, "end" from (
  select s.session_id, s.seg_ix, s.text, s."end" as s_end, t.turn_ix, t.start, t."end",
    row_number() over (partition by s.session_id, s.seg_ix order by t.start, t.turn_ix) as n
  from spoken_segments s join marked t on t.session_id = s.session_id and t.start < s."end" and t."end" > s.start
  where t.is_teacher and s.text <> '') where n = 1
"""
CTES["asked"] = rf"""
select session_id, turn_ix, start, "end", max(s_end) as span_end from owners group by 1, 2, 3, 4
having regexp_matches(string_agg(text, ' ' order by seg_ix), '\?|{LEX}')
"""
CTES["q_ends"] = """
select q.*, greatest(q."end", coalesce((select max(t."end") from marked t where t.session_id = q.session_id and t.is_teacher
    and (t.start > q.start or (t.start = q.start and t.turn_ix > q.turn_ix)) and t.start < q.span_end
    and not exists (select 1 from marked o where o.session_id = q.session_id and not o.is_teacher
      and (o.start > q.start or (o.start = q.start and o.turn_ix > q.turn_ix))
      and (o.start < t.start or (o.start = t.start and o.turn_ix < t.turn_ix)))), q."end")) as q_end
from asked q
"""
CTES["answers"] = """
select session_id, turn_ix, start, span_end, q_end, already as already_talking,
  case when not already then gap end as gap,
  already or coalesce(gap <= 15, false) as answered,
  case when already then 0.0::double when gap <= 15 and gap > 1e-6 then gap end as wait
from (select q.*,
    exists (select 1 from marked o where o.session_id = q.session_id and not o.is_teacher and o.start < q.q_end and o."end" > q.q_end) as already,
    (select min(o.start) from marked o where o.session_id = q.session_id and not o.is_teacher and o.start >= q.q_end) - q.q_end as gap
  from q_ends q)
"""
CTES["discourse"] = """
select session_id, count(*) as questions, count(*) filter (answered) as responses, count(wait) as waits,
  median(wait) as median from answers group by 1
"""
CTES["facts"] = """
select *, confidence >= 0.0 as _ok,
  case when confidence >= 0.65::double then 'usable' when confidence >= 0.40::double then 'partial' else 'unreliable' end as verdict,
  conf_attribution >= 0.15::double as split_usable, least(confidence, conf_attribution) as split_conf,
  has_transcript and conf_attribution >= 0.15::double and confidence >= 0.40::double as lexical_usable
from (select *, greatest(0::double, least(1::double, 0::double + 0.30::double * conf_speech_density + 0.30::double * conf_attribution
    + 0.20::double * conf_completeness + 0.20::double * conf_asr)) as confidence
  from (select k.*, r.actual_sec as audio_sec, r.actual_sec / 60.0::double as minutes, s.total as roster_total,
      coalesce(w.switches, 0) as switches, coalesce(g.stretch_sec, 0) as stretch_sec,
      least(1::double, least(1::double, (teacher_sec + student_sec) / r.actual_sec) / 0.5::double) as conf_speech_density,
      coalesce(mean_role_conf, 0) as conf_attribution,
      coalesce(least(1::double, s.actual_sec / s.declared_sec), 1) as conf_completeness,
      case when t.mean_logprob is null then 0.5::double else greatest(0::double, least(1::double, (t.mean_logprob + 3) / 3)) end as conf_asr,
      t.session_id is not null as has_transcript, d.questions, d.responses, d.waits, d.median
    from talk k join recordings r using (session_id) join sessions s using (session_id)
    left join switches w using (session_id) left join stretch g using (session_id)
    left join stats t using (session_id) left join discourse d using (session_id)))
"""
CTES["vals"] = """
select *, case when split_usable and teacher_sec + student_sec > 0 then teacher_sec / (teacher_sec + student_sec) end as m1,
  case when split_usable and roster_total > 0 and minutes > 0 then student_turns / roster_total::double / minutes * 60 end as m2,
  case when split_usable and minutes > 0 then switches / minutes end as m3,
  case when split_usable then stretch_sec end as m4,
  case when lexical_usable and coalesce(waits, 0) >= 3 then median end as m5,
  case when lexical_usable then coalesce(questions, 0) end as m7,
  case when lexical_usable then coalesce(responses, 0) end as m8,
  case when lexical_usable then coalesce(waits, 0) else 0 end as wait_count
from facts
"""


def _band(x: str, low: float, high: float) -> str:
    return (f"case when {x} is null then 'unknown' when {x} < {low}::double then 'low' "
            f"when {x} > {high}::double then 'high' else 'normal' end")


METRICS = (
    ("M1_teacher_talk_ratio", "m1", "ratio", _band("m1", 0.4, 0.7), "0.4::double", "split_conf"),
    ("M2_student_participation", "m2", "turns/child/hour", _band("m2", 1, 6), "null", "split_conf"),
    ("M3_interaction_density", "m3", "switches/min", _band("m3", 0.5, 4), "null", "split_conf"),
    ("M4_longest_teacher_stretch", "m4", "sec", _band("m4", 60, 300), "null", "split_conf"),
    ("M5_wait_time_1", "m5", "sec", _band("m5", 1, 8), "3.0::double",
     "split_conf * case when has_transcript then 0.6::double else 0 end * case when m5 is not null "
     "then least(1::double, wait_count / 6.0::double) else 0 end"),
    ("M7_teacher_questions", "m7", "questions", _band("(m7 / minutes * 60)", 30, 120), "null",
     "split_conf * case when has_transcript then 0.6::double else 0 end"),
    ("M8_student_responses", "m8", "responses", _band("(m8 / nullif(m7, 0)::double)", 0.4, 0.8), "null",
     "split_conf * case when has_transcript then 0.6::double else 0 end"),
)
CTES["metric_rows"] = "\nunion all\n".join(
    f"select session_id, '{key}' as key, {value}::double as value, '{unit}' as unit, {band} as band, "
    f"{bench}::double as benchmark, ({conf})::double as confidence from vals"
    for key, value, unit, band, bench, conf in METRICS)
CTES["aliases"] = """
select teacher_id, 'Teacher ' || case when n <= 26 then chr((64 + n)::int)
    else chr((64 + (n - 1) // 26)::int) || chr((65 + (n - 1) % 26)::int) end as alias
from (select teacher_id, row_number() over (order by teacher_id) as n from (
  select distinct teacher_id from sessions where teacher_id is not null))
"""
CTES["corpus"] = """
select s.*, coalesce(a.alias, 'Teacher ?') as alias,
  case when declared_sec <> 0 then actual_sec / declared_sec end as completeness,
  latitude is not null and longitude is not null as has_gps
from sessions s left join aliases a using (teacher_id)
"""
CTES["contender_text"] = """
select item_id, 'as_is' as label, text from benchmark
union all
select item_id, 'dropped', (select string_agg(w, ' ' order by i) from (
    select unnest(ws) as w, generate_subscripts(ws, 1) as i) where i % 5 <> 0)
from (select item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from benchmark)
union all
select item_id, 'looped', array_to_string(ws[1:(len(ws) // 2)] || ws[1:(len(ws) // 2)], ' ')
from (select item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from benchmark)
"""


# The first two minutes of every session: the same expressions over cut tables.
_WINDOWED = ("spans", "tiles", "timeline", "main", "coverage", "conf", "pieces", "piece_roles", "merged", "labelled", "talk")
CTES["w_turns"] = 'select session_id, turn_ix, start, least("end", 120::double) as "end", speaker from turns where start < 120'
CTES["w_recordings"] = "select session_id, least(actual_sec, 120::double) as actual_sec from recordings"
for _name in _WINDOWED:
    CTES[f"w_{_name}"] = re.sub(rf"\b(from|join)\s+({'|'.join((*_WINDOWED, 'turns', 'recordings'))})\b", r"\1 w_\2", CTES[_name])


_DOWNSTREAM = ("owners", "asked", "q_ends", "answers", "discourse", "talk", "switches", "stretch", "facts", "vals", "metric_rows")


def add_mixed_path(loud_roles: str) -> None:
    """Every seventeenth session without turns: its tiles get their roles from loudness, its attributed
    tiles stand for turns, and the same expressions follow. ``loud_roles``: session_id, segment_ix, role, role_conf."""
    CTES["x_loud_roles"] = loud_roles
    CTES["x_labelled"] = """
select session_id, segment_ix, start, "end", kind, rms_db, role, role_conf from labelled where session_id % 17 <> 0
union all select t.session_id, t.segment_ix, t.start, t."end", t.kind, t.rms_db, k.role, k.role_conf
from timeline t left join x_loud_roles k on k.session_id = t.session_id and k.segment_ix = t.segment_ix where t.session_id % 17 = 0
"""
    CTES["x_marked"] = """
select session_id, turn_ix, start, "end", is_teacher from marked where session_id % 17 <> 0
union all select session_id, (row_number() over (partition by session_id order by start))::int, start, "end", role = 'teacher'
from x_labelled where session_id % 17 = 0 and kind = 'speech' and role is not null
"""
    for name in _DOWNSTREAM:
        CTES[f"x_{name}"] = re.sub(rf"\b(from|join)\s+({'|'.join((*_DOWNSTREAM, 'labelled', 'marked'))})\b", r"\1 x_\2", CTES[name])


def with_ctes(query: str) -> str:
    """Prefix a query with every fixture expression it needs."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(query)
    parts = [f"{name} as materialized ({sql.strip()})" for name, sql in CTES.items() if name in needed]
    return (f"with {', '.join(parts)}\n" if parts else "") + query.strip()
