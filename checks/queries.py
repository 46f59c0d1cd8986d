"""One query per operator over the fixture tables, each next to the DuckDB text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import QUESTION_LEXICON, Corpus
from checks.oracle import METRICS, add_mixed_path, duration_text, percent_text, rounded, whole_text, with_ctes
from turnlake.config import ACOUSTIC_KEYS, METRIC_KEYS
from turnlake.functions import numbers, signal
from turnlake.functions import text as tx
from turnlake.operators import attribution, discourse, insight, labels, metrics, report, scoring, sequences
from turnlake.operators import corpus as cp
from turnlake.operators import intervals as iv
from turnlake.plans import incremental, stitching
from turnlake.plans import transcriber_comparison as compare
from turnlake.scan import new_folder
from turnlake.sources import documents as docs
from turnlake.sources import sessions as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_CORPORA: dict[tuple[str, str], Corpus] = {}


def corpus_of(spark: SparkSession, folder: str) -> Corpus:
    """One corpus per application and folder, so queries share the tables derived from it."""
    return _CORPORA.setdefault((spark.sparkContext.applicationId, folder), Corpus(spark, folder))


def forget_corpora() -> None:
    """Make the next query start from the given tables again."""
    for corpus in _CORPORA.values():
        corpus.release()
    _CORPORA.clear()


def query(sql: str | None = None):
    """Register a function of a corpus under its own name."""
    def register(fn: Callable[[Corpus], DataFrame]):
        name = fn.__name__
        QUERIES[name] = lambda spark, folder: fn(corpus_of(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return register


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


# =========================================================================== sources
def _sid(c: Corpus) -> DataFrame:
    return c.table("conversations").select(F.col("conv_id").alias("session_id")).distinct()


def _raw_metadata(c: Corpus) -> DataFrame:
    """Sidecar JSON per session, some malformed, as a capture app would leave it."""
    sid = F.col("session_id")
    fields = F.struct(
        F.concat(F.lit("K"), (sid % 30).cast("string")).alias("teacherId"), F.lit("Paper Theatre").alias("activityType"),
        F.when(sid % 6 != 0, (8 + sid % 20).cast("int")).alias("totalStudents"),
        F.when(sid % 6 != 0, (sid % 9).cast("int")).alias("boys"), (sid % 7).cast("int").alias("girls"),
        F.when(sid % 4 == 0, 0).when(sid % 4 > 1, (60 + sid) * 1000).cast("bigint").alias("duration"),
        _stamp(sid).alias("timestamp"),
        F.struct(F.lit("A. Name").alias("teacherName"),
                 F.when(sid % 5 >= 3, 19.5).alias("latitude")).alias("photoMetadata"))
    text = F.to_json(fields)
    # Head counts also come as text and as decimals; a negative one and a word are no counts.
    girls = lambda as_: F.regexp_replace(text, r'"girls":(\d+)', f'"girls":{as_}')
    raw = (F.when(sid % 23 == 7, F.lit('{"teacherId": "K1", "duration"')).when(sid % 23 == 11, F.lit("[1, 2]"))
           .when(sid % 23 == 13, girls("-1")).when(sid % 23 == 17, girls('"many"'))
           .when(sid % 5 == 1, girls('"$1"')).when(sid % 5 == 2, girls("$1.0")))
    return _sid(c).select("session_id", raw.otherwise(text).alias("raw"))


def _stamp(sid: Column) -> Column:
    day = F.concat(F.lit("2025-12-"), F.lpad((sid % 28 + 1).cast("string"), 2, "0"))
    short = F.concat(F.lit("2025-12-"), (sid % 28 + 1).cast("string"))
    return (F.when(sid % 8 == 4, F.concat(short, F.lit(" 9:30:0"))).when(sid % 4 == 0, F.concat(day, F.lit(" 09:30:00"))).when(sid % 4 == 1, F.concat(day, F.lit("T09:30:00")))
            .when(sid % 4 == 2, "31/12/2025"))


@query("select session_id from recordings where session_id % 10 <> 9")
def session_discovery(c):
    return src.discover(c.recordings, _sid(c).filter("session_id % 10 <> 9"))


@query("select session_id from recordings where session_id % 10 = 9")
def session_orphans(c):
    return src.orphans(c.recordings, _sid(c).filter("session_id % 10 <> 9"))


@query("""select session_id, 'K' || (session_id % 30)::varchar as teacher_id,
  case when session_id % 6 <> 0 then 8 + session_id % 20 else 0 end::int as total,
  case when session_id % 6 <> 0 then session_id % 9 else 0 end::int as boys, (session_id % 7)::int as girls,
  case when session_id % 4 > 1 then (60 + session_id)::double end as declared_sec,
  case when session_id % 4 < 2 then '2025-12-' || lpad((session_id % 28 + 1)::varchar, 2, '0') || ' 09:30:00' end as recorded_at,
  case when session_id % 5 >= 3 then 19.5::double end as latitude
from recordings where session_id % 23 not in (7, 11, 13, 17)""")
def metadata_load(c):
    good, _ = src.load_metadata_leniently(_raw_metadata(c))
    return good.select(
        "session_id", "teacher_id", "roster.total", "roster.boys", "roster.girls", "declared_sec",
        F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("recorded_at"), "photo.latitude")


@query("select session_id from recordings where session_id % 23 in (7, 11, 13, 17)")
def metadata_quarantine(c):
    _, bad = src.load_metadata_leniently(_raw_metadata(c))
    return bad.select("session_id")


@query("""select session_id, case when session_id % 4 < 2 then '2025-12-' || lpad((session_id % 28 + 1)::varchar, 2, '0')
  || ' 09:30:00' end as parsed from recordings""")
def timestamp_parsing(c):
    stamped = _sid(c).withColumn("raw", _stamp(F.col("session_id")))
    return stamped.select("session_id", F.date_format(cp.parse_timestamp(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("select session_id, actual_sec from recordings")
def measured_audio(c):
    return src.measured_audio(c.recordings).select("session_id", "actual_sec")


@query("""select session_id::varchar as session_id from recordings""")
def result_index(c):
    return docs.index_rows(c.recordings.select(F.col("session_id").cast("string").alias("session_id")).unionByName(
        c.recordings.filter("session_id = 0").select(F.lit("index").alias("session_id"))))


@query("""select session_id::varchar as session_id, actual_sec from recordings
where session_id % 7 <> 3 and session_id % 10 <> 4""")
def result_reader(c):
    sid = F.col("session_id")
    text = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), sid.cast("string").alias("session_id"), F.struct("actual_sec").alias("audio")))
    raw = c.recordings.select(sid.cast("string").alias("session_id"), F.when(
        sid % 10 == 4, F.substring(text, 1, 30)).otherwise(text).alias("value"))
    index = _sid(c).filter("session_id % 7 <> 3").select(sid.cast("string").alias("session_id"))
    return docs.parse_documents(raw, index).select("session_id", "audio.actual_sec")


@query(f"""select session_id, seg_ix::bigint * 3 as seg_ix, {rounded('start', 3)} as start, {rounded('"end"', 3)} as "end", text, avg_logprob,
  no_speech_prob from spoken_segments""")
def transcript_round_trip(c):
    sparse = c.spoken_segments.withColumn("seg_ix", F.col("seg_ix") * 3)
    back = docs.transcript_rows(docs.transcript_heads(c.transcripts), docs.transcript_lines(sparse))
    return back.select("session_id", "seg_ix", "start", "end", "text", "avg_logprob", "no_speech_prob")


@query("""select doc_id, substr(sha256(text), 1, 20) || '-' || substr(sha256('indic|conformer-hi|' || coalesce(lang, 'auto')), 1, 10) as key
from documents d where not exists (select 1 from documents f where f.doc_id % 3 = 0 and f.doc_id % 2 = 0
  and f.text = d.text and f.lang is not distinct from d.lang)""")
def pending_work(c):
    work = c.table("documents").select("doc_id", docs.content_key(
        F.col("text"), F.lit("indic"), F.lit("conformer-hi"), F.col("lang")).alias("key"))
    entry = F.when(F.col("doc_id") % 2 == 0, F.lit('{"turns": []}')).otherwise(F.lit('{"turns": [{"start"'))
    return docs.pending(work, work.filter("doc_id % 3 = 0").select("key", entry.alias("value")))


@query("""with w as (select doc_id, case when doc_id % 7 = 0 then text || '!' else text end as text, lang from documents),
f as (select distinct text, lang from documents where doc_id % 3 = 0)
select doc_id, length(w.text)::int as chars, case when f.text is not null then 'r1' else 'r2' end as run
from w left join f on f.text = w.text and f.lang is not distinct from w.lang""")
def second_run(c):
    """A first run over a third of the texts, then one over all, some of them changed: only what is new is computed."""
    def work(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "text", docs.content_key(F.col("text"), F.lit("indic"), F.col("lang")).alias("key"))

    def compute(rows: DataFrame) -> DataFrame:
        return rows.select("key", F.to_json(F.struct(F.array().cast("array<string>").alias("turns"), F.length("text").alias("chars"))).alias("value"))

    table, store = c.table("documents"), new_folder(c.spark, "store")
    incremental.run_pending(work(table.filter("doc_id % 3 = 0")), store, compute, "r1")
    changed = table.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    rows = incremental.run_pending(work(changed), store, compute, "r2")
    return rows.select("doc_id", F.get_json_object("value", "$.chars").cast("int").alias("chars"), "run")


@query("""select source as sheet, 'doc.' || doc_id::varchar || '#0001' as row_id, doc_id / 4.0::double as start,
  n_chars / 16.0::double as "end", case when n_chars >= 1000 then 'teacher' else 'student' end as predicted,
  (doc_id % 100) / 100.0::double as confidence,
  case when doc_id % 5 = 1 then 'teacher' when doc_id % 5 = 2 then 'student' end as truth, lang as text
from documents where doc_id % 10 not in (8, 9)""")
def label_sheet_lines(c):
    d = F.col("doc_id")
    cells = F.concat_ws(
        " | ", F.concat(F.lit("| `doc."), d.cast("string"), F.lit("#0001`")),
        F.when(d % 10 == 9, F.lit("soon")).otherwise((d / 4.0).cast("string")),
        (F.col("n_chars") / 16.0).cast("string"),
        F.when(d % 10 == 8, F.lit("nobody")).when(F.col("n_chars") >= 1000, F.lit("Teacher")).otherwise(F.lit("student")),
        ((d % 100) / 100.0).cast("string"),
        F.when(d % 5 == 1, F.lit("teacher")).when(d % 5 == 2, F.lit("STUDENT")).when(d % 5 == 3, F.lit("?")).otherwise(F.lit("")),
        F.concat(F.col("lang"), F.lit(" |")))
    lines = c.table("documents").select(F.col("source").alias("sheet"), cells.alias("line"))
    heads = c.table("documents").select(F.col("source").alias("sheet"), F.explode(F.array(
        F.lit("| Row | Start | End | Pred | Conf | Truth | Transcript |"), F.lit("|---|---:|---:|---|---:|---|---|"))).alias("line"))
    return src.parse_label_lines(lines.unionByName(heads))


@query("""select item_id as sample_id, text as reference from benchmark where item_id % 4 <> 1 and item_id % 7 <> 2
order by item_id limit 12""")
def benchmark_samples(c):
    rows = c.table("benchmark").select(
        F.col("item_id").alias("sample_id"), F.when(F.col("item_id") % 7 != 2, F.col("text")).alias("reference"),
        F.when(F.col("item_id") % 4 != 1, F.col("text").cast("binary")).alias("audio"))
    return scoring.benchmark_samples(rows, 12).select("sample_id", "reference")


# =========================================================================== projections
@query("select session_id, completeness from corpus")
def completeness(c):
    rows = c.sessions.join(c.recordings, "session_id")
    return rows.select("session_id", metrics.completeness(F.col("actual_sec"), F.col("declared_sec")).alias("completeness"))


_FLAGS = """array_to_string(list_filter([case when completeness < 0.98::double then 'audio_truncated' end,
  case when boys + girls <> total then 'roster_mismatch' end, case when not has_gps then 'no_gps' end], lambda f: f is not null), ',')"""


@query(f"select session_id, {_FLAGS} as flags from corpus")
def quality_flags(c):
    return c.sessions.join(c.recordings, "session_id").select("session_id", joined(cp.quality_flags()).alias("flags"))


@query("select session_id, boys + girls = total as consistent from sessions")
def roster_check(c):
    return cp.checked_roster(c.sessions).select("session_id", cp.roster_consistent().alias("consistent"))


@query(f"""select session_id, teacher_id, alias, activity, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S') as recorded_at,
  total as roster_total, boys as roster_boys, girls as roster_girls, {rounded('declared_sec', 1)} as declared_sec,
  {rounded('actual_sec', 1)} as actual_sec, {rounded('completeness', 3)} as completeness, 16000::int as sample_rate,
  1::int as channels, has_gps, {_FLAGS} as flags from corpus""")
def public_projection(c):
    return cp.public_projection(c.analysis.corpus).withColumn("flags", joined(F.col("flags")))


@query("select teacher_id, alias from aliases")
def teacher_aliases(c):
    return cp.aliases(c.sessions)


@query("select session_id, segment_ix, kind from timeline where kind <> 'speech'")
def non_speech_kind(c):
    return c.analysis.timeline.filter("kind <> 'speech'").select("session_id", "segment_ix", "kind")


@query("select session_id, start, \"end\", role from labelled where kind = 'speech' and role is not null")
def attributed_speech(c):
    return c.analysis.labelled.filter(metrics.attributed()).select("session_id", "start", "end", "role")


@query("""select session_id, seg_ix, start + 0.25::double as start, "end" + 0.25::double as "end",
  start + 1.25::double as word_start from segments""")
def time_offset(c):
    word = F.array(F.struct((F.col("start") + 1.0).alias("start"), F.col("end").alias("end"), F.lit("w").alias("word")))
    moved = sequences.shift(c.segments.withColumn("words", word), F.lit(0.25))
    return moved.select("session_id", "seg_ix", "start", "end", F.col("words")[0]["start"].alias("word_start"))


@query("select session_id, seg_ix, text from segments")
def segment_validity(c):
    padded = c.segments.withColumn("text", F.concat(F.lit(" \t "), "text", F.lit("  \n")))
    return cp.valid_segments(padded).select("session_id", "seg_ix", "text")


@query("""select session_id, least(actual_sec, 60.0::double) as analysed_sec, coalesce(sum(t."end" - t.start), 0) as turn_sec
from (select * from recordings order by session_id limit 40) r
left join (select session_id, start, least("end", 60.0::double) as "end" from turns where start < 60) t using (session_id)
group by session_id, actual_sec""")
def analysis_window(c):
    first = iv.window_recordings(cp.first_sessions(c.recordings, 40), 60.0)
    talk = iv.window_turns(c.turns, 60.0).groupBy("session_id").agg(F.sum(F.col("end") - F.col("start")).alias("turn_sec"))
    return first.join(talk, "session_id", "left").select(
        "session_id", F.col("actual_sec").alias("analysed_sec"), F.coalesce("turn_sec", F.lit(0.0)).alias("turn_sec"))


_PUBLISHED = f"""select n.session_id, n.seg_no, {rounded('n.start', 3)} as t0, {rounded('n."end"', 3)} as t1, n.kind,
  {rounded('n.rms_db', 2)} as rms_db, n.role, case when n.role is not null then {rounded('n.role_conf', 3)} end as role_conf,
  case when n.kind = 'speech' then x.text end as text
from numbered n left join span_text x using (session_id, seg_no)"""


@query(_PUBLISHED)
def published_timeline(c):
    return c.analysis.published_timeline


@query("""select session_id, case when speaker = main_speaker then 'teacher' else 'student' end as role,
  count(*) as turns, sum("end" - start) as sec from turns join main using (session_id) group by 1, 2""")
def role_collapse(c):
    rows = c.turns.join(c.analysis.main, "session_id")
    return rows.groupBy("session_id", iv.collapse_role(F.col("speaker"), F.col("main_speaker")).alias("role")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.col("end") - F.col("start")).alias("sec"))


_LABEL_ROWS = """select n.session_id::varchar || '#' || lpad(n.seg_no::varchar, 4, '0') as row_id, n.session_id, n.start, n."end",
  n.role as predicted, n.role_conf as confidence, coalesce(x.text, '') as text
from numbered n left join span_text x using (session_id, seg_no) where n.kind = 'speech' and n.role is not null"""


@query(_LABEL_ROWS)
def labelling_sample(c):
    a = c.analysis
    return labels.sample_rows(a.labelled, a.segments, c.split)


@query(f"select session_id, seg_no, text from ({_PUBLISHED}) where kind = 'speech' and text <> ''")
def spoken_lines(c):
    return report.spoken_lines(c.analysis.published_timeline).select("session_id", "seg_no", "text")


@query("""select doc_id, case lang when 'en' then 'en' when 'fr' then 'french' when 'es' then 'hi' else 'unknown' end as code
from documents""")
def language_codes(c):
    raw = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "French").when(F.col("lang") == "es", "HINDI")
    return c.table("documents").select("doc_id", cp.language_code(raw.otherwise("")).alias("code"))


@query("select session_id, key from metric_rows where value is null")
def withheld_metrics(c):
    return report.withheld_metrics(c.analysis.metrics)


@query("select session_id, verdict from facts where verdict <> 'unreliable'")
def shown_sessions(c):
    return report.shown_sessions(c.analysis.values).select("session_id", "verdict")


@query("""select session_id, array_to_string(list_filter([
  case when completeness < 0.98::double then 'Recording is truncated — only ' || floor(completeness * 100 + 0.5)::bigint::varchar
    || '% of the declared duration was saved.' end,
  case when not has_gps then 'No GPS recorded for this session.' end,
  case when boys + girls <> total then 'Headcount does not add up: boys + girls ≠ total.' end], lambda f: f is not null), ' / ') as notes
from corpus""")
def capture_notes(c):
    rows = c.sessions.join(c.recordings, "session_id")
    share = metrics.completeness(F.col("actual_sec"), F.col("declared_sec"))
    return rows.select("session_id", F.array_join(cp.capture_notes(cp.quality_flags(), share), " / ").alias("notes"))


# =========================================================================== joins
@query("select session_id, seg_no, text from span_text")
def span_text(c):
    a = c.analysis
    return iv.text_of_spans(iv.numbered(a.labelled, c.split), a.segments, ["seg_no"])


@query("""select session_id, turn, speaker from (
  select u.session_id, u.turn, t.speaker, row_number() over (partition by u.session_id, u.turn
    order by least(u."end", t."end") - greatest(u.start, t.start) desc,
      (least(u."end", t."end") - greatest(u.start, t.start)) / (t."end" - t.start) desc, t.turn_ix) as n
  from utterances u join turns t on t.session_id = u.session_id and t.start < u."end" and t."end" > u.start) where n = 1""")
def overlap_winner(c):
    return iv.speaker_for_spans(c.utterances, c.turns, ["turn"])


@query("select session_id, seg_ix, turn_ix from owners")
def first_owner(c):
    a = c.analysis
    return discourse.first_owner(a.segments, a.marked).select("session_id", "seg_ix", "turn_ix")


@query("select session_id, turn_ix, gap, answered, wait from answers where not already_talking")
def next_answer(c):
    return c.analysis.discourse.filter(~F.col("already_talking")).select("session_id", "turn_ix", "gap", "answered", "wait")


@query("select session_id, turn_ix, wait from answers where already_talking")
def already_talking(c):
    return c.analysis.discourse.filter("already_talking").select("session_id", "turn_ix", "wait")


@query("select session_id, turn_ix, start, span_end, q_end from q_ends")
def question_end(c):
    a = c.analysis
    asked = discourse.questions(a.segments, a.marked, QUESTION_LEXICON)
    return discourse.question_ends(asked, a.marked)


CONTENDERS = ("as_is", "dropped", "looped")


def _contender_text(c: Corpus) -> DataFrame:
    ws = tx.words(F.col("text"))
    kept = F.filter(ws, lambda w, i: (i + 1) % 5 != 0)
    half = F.slice(ws, 1, F.floor(F.size(ws) / 2).cast("int"))
    texts = F.array(F.struct(F.lit("as_is").alias("label"), F.col("text").alias("text")),
                    F.struct(F.lit("dropped").alias("label"), F.array_join(kept, " ").alias("text")),
                    F.struct(F.lit("looped").alias("label"), F.array_join(F.concat(half, half), " ").alias("text")))
    return c.table("benchmark").select("item_id", (F.size(ws) / 2.5).alias("audio_sec"), F.inline(texts))


def _bakeoff_input(c: Corpus) -> DataFrame:
    """The contender that drops words has no text for every tenth clip; the looping one no confidence."""
    item = F.col("item_id")
    return _contender_text(c).select(
        item.alias("clip_id"), "label", "audio_sec",
        F.when(~((F.col("label") == "dropped") & (item % 10 == 3)), F.col("text")).alias("text"),
        F.when(F.col("label") != "looped", -(item % 12) / F.lit(4.0)).alias("mean_logprob"),
        ((item % 5) / F.lit(4.0)).alias("speech_density"), ((item % 3) + 1.0).alias("elapsed_sec"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_AGREE = f"""select a.item_id as clip_id, a.label, avg(len(list_intersect(a.bag, b.bag)) / len(list_distinct(a.bag || b.bag))::double) as agreement
from (select item_id, label, {_WORDS} as bag from contender_text where not (label = 'dropped' and item_id % 10 = 3)) a
left join (select item_id, label, {_WORDS} as bag from contender_text where not (label = 'dropped' and item_id % 10 = 3)) b
  on a.item_id = b.item_id and a.label <> b.label group by 1, 2"""


@query(f"select clip_id, label, round(agreement, 9) as agreement from ({_AGREE})")
def contender_agreement(c):
    rows = scoring.agreement(_bakeoff_input(c).filter("text is not null"))
    return rows.select("clip_id", "label", F.round("agreement", 9).alias("agreement"))


def _chunks(c: Corpus) -> DataFrame:
    return sequences.plan_chunks(c.recordings, 90.0, 2.0)


def _part_segments(c: Corpus) -> DataFrame:
    """Segments as each chunk heard them: those in an overlap twice, half a second apart."""
    chunks = _chunks(c).select("session_id", "chunk_ix", F.col("start").alias("c_start"), "duration")
    # A chunk is 90 s; the overlap reaches into the next one and a short rest into the one before.
    own = F.floor(F.col("start") / 90.0).cast("int")
    near = c.segments.withColumn("chunk_ix", F.explode(F.array(own - 1, own, own + 1)))
    rows = near.join(chunks, ["session_id", "chunk_ix"]).filter(
        (F.col("start") >= F.col("c_start")) & (F.col("start") < F.col("c_start") + F.col("duration")))
    late = F.when((F.col("chunk_ix") > 0) & (F.col("start") < F.col("c_start") + 2.0), 0.5).otherwise(0.0)
    return rows.select("session_id", "chunk_ix", "seg_ix", (F.col("start") - F.col("c_start") + late).alias("start"),
                       (F.col("end") - F.col("c_start") + late).alias("end"), "text")


_CHUNKS = """select session_id, i::int as chunk_ix, case when i = 0 then 0.0::double else greatest(0::double, i * 90 - 2) end as start,
  case when i = n - 1 then actual_sec else (i + 1) * 90.0::double end
    - case when i = 0 then 0.0::double else greatest(0::double, i * 90 - 2) end as duration
from (select *, unnest(range(0, n)) as i from (select *, case when k > 1 and actual_sec - (k - 1) * 90 < 4.5::double then k - 1 else k end as n
  from (select *, ceil((actual_sec - 1e-9) / 90)::bigint as k from recordings)))"""
_PLACED = f"""select s.session_id, h.chunk_ix, s.seg_ix, s.text,
  s.start + case when h.chunk_ix > 0 and s.start < h.start + 2 then 0.5::double else 0 end as start,
  s."end" + case when h.chunk_ix > 0 and s.start < h.start + 2 then 0.5::double else 0 end as "end"
from segments s join ({_CHUNKS}) h on h.session_id = s.session_id and s.start >= h.start and s.start < h.start + h.duration"""


@query(f'select session_id, chunk_ix, seg_ix, start, "end" from ({_PLACED})')
def placed_parts(c):
    placed = sequences.place_parts(_chunks(c).select("session_id", "chunk_ix"), _part_segments(c), _chunks(c))
    return placed.select("session_id", "chunk_ix", "seg_ix", "start", "end")


@query(f"""select session_id, count(*) as planned, count(*) filter (chunk_ix <> 1) as got from ({_CHUNKS})
group by 1 having count(*) filter (chunk_ix = 1) > 0""")
def chunk_mismatch(c):
    return sequences.chunk_counts(_chunks(c).filter("chunk_ix <> 1"), _chunks(c))


@query(f"""select row_id, predicted, case when session_id % 3 <> 0 then case when seg_ix % 2 = 0 then 'teacher' else 'student' end end as truth
from (select session_id, seg_no as seg_ix, session_id::varchar || '#' || lpad(seg_no::varchar, 4, '0') as row_id, role as predicted
  from numbered where kind = 'speech' and role is not null)""")
def truth_lookup(c):
    rows = labels.sample_rows(c.analysis.labelled, c.analysis.segments, c.split)
    number = F.substring_index("row_id", "#", -1).cast("int")
    truth = rows.filter("session_id % 3 <> 0").select("row_id", F.when(number % 2 == 0, "teacher").otherwise("student").alias("truth"))
    return labels.with_truth(rows, truth).select("row_id", "predicted", "truth")


@query("select session_id, alias, activity, actual_sec, declared_sec from corpus")
def corpus_assembly(c):
    return c.analysis.corpus.select("session_id", "alias", "activity", "actual_sec", "declared_sec")


@query("""select item_id as clip_id, label, text is null or (label = 'dropped' and item_id % 10 = 3) or item_id % 4 = 3 as failed
from contender_text""")
def bakeoff_attempts(c):
    clips = c.table("benchmark").select(F.col("item_id").alias("clip_id"))
    outputs = _bakeoff_input(c).filter("clip_id % 4 <> 3").select("clip_id", "label", "text")
    return scoring.attempts(clips, CONTENDERS, outputs).select("clip_id", "label", "failed")


GRID = (("default", 0.1, 2, 6), ("tight", 0.15, 1, 1), ("loose", 0.05, 3, 4))


def _frames(c: Corpus) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("clip_id"), F.posexplode("embedding").alias("frame_ix", "score")
                                        ).withColumn("score", F.abs("score").cast("double"))


_SWEEP = """select setting, clip_id, coalesce(sum(len) filter (len >= min_speech), 0) * 100.0::double / 64 as coverage
from (select g.setting, f.vec_id as clip_id, g.min_speech, r.len from embeddings f cross join grid g left join (
  select setting, clip_id, max(ix) - min(ix) + 1 as len from (
    select *, sum(case when ix - was - 1 < min_silence then 0 else 1 end) over (partition by setting, clip_id order by ix rows unbounded preceding) as run
    from (select setting, clip_id, min_silence, ix, lag(ix) over (partition by setting, clip_id order by ix) as was
      from (select vec_id as clip_id, unnest(range(0, len(embedding))) as ix, abs(unnest(embedding)::double) as score from embeddings)
      cross join grid where score >= threshold))
  group by setting, clip_id, run) r on r.setting = g.setting and r.clip_id = f.vec_id) group by 1, 2"""
_GRID_CTE = ("with grid as (select * from (values ('default', 0.1::double, 2, 6), ('tight', 0.15::double, 1, 1), "
             "('loose', 0.05::double, 3, 4)) v(setting, threshold, min_speech, min_silence)) ")


@query(_GRID_CTE + _SWEEP)
def setting_coverage(c):
    return sequences.sweep_settings(_frames(c), GRID)


@query(_GRID_CTE + f"select setting, round(avg(coverage), 6) as mean_coverage from ({_SWEEP}) group by 1")
def setting_means(c):
    means = sequences.mean_by_setting(sequences.sweep_settings(_frames(c), GRID))
    return means.select("setting", F.round("mean_coverage", 6).alias("mean_coverage"))


_KEY_ROWS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(METRIC_KEYS))


@query(f"""select r.session_id, k.position::int as position, k.key, round(m.value, 9) as value, coalesce(m.band, 'unknown') as band
from recordings r cross join (values {_KEY_ROWS}) k(position, key)
left join metric_rows m on m.session_id = r.session_id and m.key = k.key
  and not (k.key like 'M7%' and r.session_id % 2 = 0)""")
def ordered_metrics(c):
    older = c.analysis.metrics.filter(~(F.col("key").startswith("M7") & (F.col("session_id") % 2 == 0)))
    rows = report.ordered_metrics(c.recordings, older)
    return rows.select("session_id", "position", "key", F.round("value", 9).alias("value"), "band")


# =========================================================================== intervals, sequences
@query("""select session_id, min(start) as start, max("end") as "end" from (
  select *, sum(opens) over (partition by session_id order by start, "end" rows unbounded preceding) as island from (
    select *, case when start <= max("end") over (partition by session_id order by start, "end"
      rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from turns where "end" > start))
group by session_id, island""")
def interval_union(c):
    return iv.union_spans(c.turns, c.split)


@query('select session_id, start, "end" from spans')
def clipped_union(c):
    return iv.clip_and_union(c.turns, c.recordings, c.split)


@query('select session_id, segment_ix, start, "end", kind, rms_db from timeline')
def timeline_tiling(c):
    return c.analysis.timeline.select("session_id", "segment_ix", "start", "end", "kind", "rms_db")


#: Blocks of 64 samples out of the vectors, 20 recordings at 8 samples a second.
_SAMPLED = """select t.session_id, t.segment_ix, x::double as x, w.first + i - floor(t.start * 8)::bigint as i
from tiles t join (select vec_id % 20 as session_id, (vec_id // 20) * 64 as first, unnest(range(64)) as i, unnest(embedding) as x from embeddings) w
  on w.session_id = t.session_id and w.first + i >= floor(t.start * 8) and w.first + i < floor(t."end" * 8)"""


_SPECTRUM = f"""select session_id, segment_ix, k, greatest(power(sum(y * cos(2 * pi() * ((k * i) % n) / n)), 2) + power(sum(y * sin(2 * pi() * ((k * i) % n) / n)), 2), 1e-12::double) as p
from (select *, x * (0.5::double - 0.5::double * cos(2 * pi() * i / (n - 1))) as y, unnest(range(1, n // 2 + 1)) as k from (
  select *, count(*) over (partition by session_id, segment_ix) as n from ({_SAMPLED})) where n >= 32) group by 1, 2, 3"""


@query(f"""select t.session_id, t.segment_ix, round(coalesce(rms_db, -120), 6) as rms_db, round(coalesce(flatness, 0), 6) as flatness
from tiles t
left join (select session_id, segment_ix, 20 * log10(greatest(sqrt(avg(x * x)), 1e-12::double)) as rms_db from ({_SAMPLED}) group by 1, 2) using (session_id, segment_ix)
left join (select session_id, segment_ix, exp(avg(ln(p))) / avg(p) as flatness from ({_SPECTRUM}) group by 1, 2) using (session_id, segment_ix)""")
def tile_samples(c):
    """Loudness and flatness from the samples themselves, the spectrum being that of the whole tile."""
    waves = c.table("embeddings").select((F.col("vec_id") % 20).alias("session_id"),
                                         (F.floor(F.col("vec_id") / 20) * 64).alias("first"), F.col("embedding").alias("samples"))
    tiles = c.analysis.timeline.select("session_id", "segment_ix", "start", "end")
    return iv.measured_samples(tiles, waves, 8).select("session_id", "segment_ix", F.round("rms_db", 6).alias("rms_db"), F.round("flatness", 6).alias("flatness"))


_FRAMES = """select vec_id % 20 as session_id, (vec_id // 20) * 2.5::double as at, list_transform(embedding, lambda x: x::double * x::double) as p
from embeddings"""


@query(f"""select t.session_id, t.segment_ix, round(case when e is null then -120 else 20 * log10(greatest(sqrt(e / n), 1e-12)) end, 6) as rms_db,
  round(coalesce(exp(l / n) / (e / n), 0), 6) as flatness from tiles t left join (
  select t.session_id, t.segment_ix, sum(list_sum(p)) as e, sum(len(p)) as n, sum(list_sum(list_transform(p, lambda x: ln(greatest(x, 1e-12))))) as l
  from tiles t join ({_FRAMES}) f on f.session_id = t.session_id and f.at >= t.start and f.at < t."end" group by 1, 2) using (session_id, segment_ix)""")
def tile_measurement(c):
    """Frames out of the vectors; their squares stand for the power of the bins."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    frames = c.table("embeddings").select(
        (F.col("vec_id") % 20).alias("session_id"), (F.floor(F.col("vec_id") / 20) * 2.5).alias("at"), squares.alias("p")).select(
        "session_id", "at", F.size("p").alias("samples"), total(F.col("p")).alias("energy"), F.size("p").alias("bins"),
        total(F.col("p")).alias("power"), total(F.transform("p", lambda x: F.log(F.greatest(x, F.lit(1e-12))))).alias("log_power"))
    tiles = c.analysis.timeline.select("session_id", "segment_ix", "start", "end")
    return iv.measured(tiles, frames).select("session_id", "segment_ix", F.round("rms_db", 6).alias("rms_db"), F.round("flatness", 6).alias("flatness"))


@query('select session_id, segment_ix, start, "end" from pieces')
def speech_pieces(c):
    return iv.cut_at_turn_edges(c.analysis.timeline, c.analysis.turns, c.split)


@query('select session_id, segment_ix, start, "end", role from merged')
def merged_pieces(c):
    a = c.analysis
    voices = a.marked.drop("speaker").withColumnRenamed("role", "speaker")
    pieces = iv.speaker_of_pieces(iv.cut_at_turn_edges(a.timeline, voices, c.split), voices)
    return iv.merge_adjacent(pieces.withColumnRenamed("speaker", "role"), c.split)


@query('select session_id, start, "end", kind, role, round(role_conf, 12) as role_conf from labelled')
def labelled_timeline(c):
    return c.analysis.labelled.select("session_id", "start", "end", "kind", "role", F.round("role_conf", 12).alias("role_conf"))


@query("""select t.session_id, t.segment_ix, case when w.speaker is null then null when w.speaker = m.main_speaker then 'teacher' else 'student' end as role
from timeline t left join main m using (session_id) left join (
  select s.session_id, s.segment_ix, t.speaker, row_number() over (partition by s.session_id, s.segment_ix
    order by least(s."end", t."end") - greatest(s.start, t.start) desc,
      (least(s."end", t."end") - greatest(s.start, t.start)) / (t."end" - t.start) desc, t.turn_ix) as n
  from timeline s join turns t on t.session_id = s.session_id and t.start < s."end" and t."end" > s.start
  where s.kind = 'speech') w on w.session_id = t.session_id and w.segment_ix = t.segment_ix and w.n = 1""")
def whole_segment_labels(c):
    a = c.analysis
    return iv.label_whole_segments(a.timeline, a.turns, a.main).select("session_id", "segment_ix", "role")


@query("""select r.session_id, coalesce(stretch_sec, 0) as stretch_sec from recordings r left join stretch using (session_id)""")
def longest_stretch(c):
    return metrics.timeline_facts(c.analysis.labelled, split=c.split).select("session_id", "stretch_sec")


@query("select r.session_id, coalesce(switches, 0) as switches from recordings r left join switches using (session_id)")
def floor_switches(c):
    return metrics.timeline_facts(c.analysis.labelled, split=c.split).select("session_id", "switches")


_TOKEN_GAP = 21600.0


def _tokens(c: Corpus) -> DataFrame:
    seconds = (F.unix_date(F.to_date("ts")) - 19723) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    micros = seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), "ts") * 1_000_000).cast("bigint")
    at = micros / F.lit(1e6)
    return c.table("events").select(
        F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("token_ix"), F.col("event_type").alias("token"),
        at.alias("at"), F.when(F.col("event_id") % 3 != 0, -(F.col("event_id") % 8) / F.lit(8.0)).alias("logprob"),
        F.lit(1e9).alias("audio_sec"))


@query("""select session_id, min(sec_at) as start, least(max(sec_at) + greatest(coalesce(min(step), 0.2::double), 0.05::double), 1e9::double) as "end",
  string_agg(event_type, '' order by ts, event_id) as text, avg(logprob) as avg_logprob
from (select *, sum(opens) over (partition by session_id order by ts, event_id rows unbounded preceding) as run from (
  select *, case when sec_at - was <= 21600 then 0 else 1 end as opens, case when sec_at - was <= 21600 then sec_at - was end as step from (
    select user_id as session_id, ts, event_id, event_type, (epoch_us(ts) - 1704067200000000) / 1e6::double as sec_at,
      lag((epoch_us(ts) - 1704067200000000) / 1e6::double) over (partition by user_id order by ts, event_id) as was,
      case when event_id % 3 <> 0 then -(event_id % 8) / 8.0::double end as logprob from events)))
group by session_id, run""")
def token_runs(c):
    runs = sequences.segments_from_tokens(_tokens(c), _TOKEN_GAP)
    return runs.select("session_id", "start", "end", "text", "avg_logprob")


@query(f"""select session_id, chunk_ix, seg_ix, start from (
  select *, lag(text) over w as was, lag(start) over w as was_start from ({_PLACED})
  window w as (partition by session_id order by chunk_ix, seg_ix))
where not coalesce(text = was and abs(start - was_start) <= 1, false)""")
def stitched_segments(c):
    placed = sequences.place_parts(_chunks(c).select("session_id", "chunk_ix"), _part_segments(c), _chunks(c))
    return sequences.drop_repeats(placed, c.split).select("session_id", "chunk_ix", "seg_ix", "start")


@query(_CHUNKS)
def chunk_plan(c):
    return _chunks(c)


@query(f"""select session_id, i::int as clip_ix, session_id::varchar || '_c' || lpad(i::varchar, 2, '0') as clip_id,
  case when whole then 0.0::double else {rounded('lo + gap * (i + 1) + 30.0::double * i', 3)} end as start,
  case when whole then actual_sec else 30.0::double end as duration
from (select *, unnest(range(0, n)) as i, (span - n * 30.0::double) / (n + 1) as gap from (
  select *, case when whole then 1 else greatest(1, least(3, floor(span / 30)::int)) end as n from (
    select *, actual_sec <= 30 as whole, actual_sec * 0.05::double as lo,
      actual_sec * 0.95::double - actual_sec * 0.05::double as span from recordings)))""")
def clip_selection(c):
    return sequences.select_clips(c.recordings, 3, 30.0)


_GRAMS = """list_transform(range(1, greatest(len(ws) - 2, 1)), lambda i: array_to_string(ws[i:i+3], ' '))"""
_DOC_WORDS = "select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from"
_REPEAT = f"case when len(ws) < 8 then 0.0::double else (len(ws) - 3 - len(list_distinct({_GRAMS}))) / (len(ws) - 3)::double end"


@query(f"select doc_id, {_REPEAT} as rate from ({_DOC_WORDS} documents)")
def repetition_rate(c):
    return c.table("documents").select("doc_id", tx.repetition_rate(F.col("text")).alias("rate"))


@query(f"""select p.session_id, p.seg_no, (p.t1 - p.t0) / nullif(r.actual_sec, 0) * 100 as width_percent,
  case when kind = 'speech' then coalesce(role, 'unattributed') else kind end as css_class,
  case when kind = 'speech' then coalesce(role, 'speech, speaker unknown') when kind = 'handson' then 'hands-on' else 'quiet' end as label
from ({_PUBLISHED}) p join recordings r using (session_id)""")
def timeline_bars(c):
    sized = c.recordings.withColumn("analysed_sec", F.when(F.col("session_id") % 2 == 0, F.col("actual_sec")).otherwise(0.0))
    return report.timeline_bars(c.analysis.silent_timeline, sized).select(
        "session_id", "seg_no", "width_percent", "css_class", "label")


@query("""select session_id, alias, m1, m1 - lag(m1) over (partition by alias order by recorded_at, session_id) as change
from vals join corpus using (session_id)""")
def teacher_trend(c):
    rows = c.analysis.corpus.select("session_id", "alias", "recorded_at").join(
        c.analysis.values.select("session_id", "m1"), "session_id")
    return report.teacher_trend(rows, "m1").select("session_id", "alias", "m1", "change")


# =========================================================================== aggregations, metrics
@query("select session_id, teacher_sec, student_sec, handson_sec, dead_sec, unattributed_sec from talk")
def talk_time(c):
    return iv.talk_time(c.analysis.labelled)


@query("select session_id, main_speaker, margin from main")
def main_speaker(c):
    return iv.main_speaker(c.turns)


_KM = """with recursive loud as (
  select session_id, list(rms_db order by segment_ix) as xs from timeline where kind = 'speech' group by 1),
km(session_id, xs, i, lo, hi, plo, phi) as (
  select session_id, xs, 0, list_min(xs), list_max(xs), list_min(xs), list_max(xs) from loud
  union all
  select session_id, xs, i + 1,
    case when nlo is null or abs(nlo - lo) <= 1e-8 + 1e-5 * abs(lo) then lo else nlo end,
    case when nhi is null or abs(nhi - hi) <= 1e-8 + 1e-5 * abs(hi) then hi else nhi end, lo, hi
  from (select *, list_avg(list_filter(xs, lambda x: abs(x - lo) <= abs(x - hi))) as nlo,
      list_avg(list_filter(xs, lambda x: abs(x - lo) > abs(x - hi))) as nhi from km where i < 40)),
"""


def _recursive(body: str) -> str:
    """Put the fixture expressions in front of a recursive query's own."""
    own, final = body.split("\n--\n")
    plain = with_ctes(final.replace("LOUD", "timeline"))
    prefix = plain[:plain.rindex(final.replace("LOUD", "timeline").strip())].rstrip()
    return prefix.replace("with ", "with recursive ", 1) + ",\n" + own + "\n" + final.replace("LOUD", "timeline")


_KMEANS = _KM.replace("with recursive ", "").rstrip().rstrip(",") + """
--
select t.session_id, t.segment_ix,
  case when len(xs) = 1 or list_max(xs) - list_min(xs) < 1e-6 or ((abs(rms_db - plo) <= abs(rms_db - phi)) = (lo > hi)) then 'teacher' else 'student' end as role,
  round(case when len(xs) = 1 or list_max(xs) - list_min(xs) < 1e-6 then 0::double else
    greatest(0::double, least(1::double, case when abs(rms_db - plo) <= abs(rms_db - phi)
      then (abs(rms_db - hi) - abs(rms_db - lo)) else (abs(rms_db - lo) - abs(rms_db - hi)) end / greatest(abs(lo - hi), 1e-9::double)))
    * greatest(0::double, least(1::double, abs(lo - hi) / 12)) end, 9) as role_conf
from timeline t join km using (session_id) where km.i = 40 and t.kind = 'speech'
"""


@query()
def loudness_roles(c):
    rows = attribution.roles_from_loudness(c.analysis.timeline).filter("kind = 'speech'")
    return rows.select("session_id", "segment_ix", "role", F.round("role_conf", 9).alias("role_conf"))


ORACLES["loudness_roles"] = _recursive(_KMEANS)


@query("select session_id, coverage, confidence from conf")
def coverage_confidence(c):
    a = c.analysis
    return iv.coverage_confidence(a.timeline, a.turns, a.main)


@query("""select session_id, round(confidence, 9) as confidence, round(conf_speech_density, 9) as density,
  round(conf_attribution, 9) as attribution, round(conf_completeness, 9) as completeness, round(conf_asr, 9) as asr from facts""")
def session_confidence(c):
    r = lambda name: F.round(name, 9)
    return c.analysis.values.select(
        "session_id", r("confidence").alias("confidence"), r("conf_speech_density").alias("density"),
        r("conf_attribution").alias("attribution"), r("conf_completeness").alias("completeness"), r("conf_asr").alias("asr"))


@query("select session_id, verdict, split_usable, lexical_usable from facts")
def verdicts(c):
    return c.analysis.values.select("session_id", "verdict", "split_usable", "lexical_usable")


def _metric(prefix: str) -> Callable[[Corpus], DataFrame]:
    def run(c: Corpus) -> DataFrame:
        acoustic = any(key.startswith(prefix) for key in ACOUSTIC_KEYS)
        rows = c.analysis.acoustic_metrics if acoustic else c.analysis.metrics
        rows = rows.filter(F.col("key").startswith(prefix))
        return rows.select("session_id", F.round("value", 9).alias("value"), "unit", "band", "benchmark",
                           F.round("confidence", 9).alias("confidence"))
    return run


for _key, _name in zip(METRIC_KEYS, ("talk_ratio", "participation", "interaction_density", "teacher_stretch", "wait_time",
                                     "teacher_questions", "student_responses")):
    _fn = _metric(_key[:3])
    _fn.__name__ = f"metric_{_name}"
    query(f"""select session_id, round(value, 9) as value, unit, band, benchmark, round(confidence, 9) as confidence
from metric_rows where key = '{_key}'""")(_fn)


@query("select session_id, turn_ix, q_end, answered, wait from answers")
def discourse_walk(c):
    return c.analysis.discourse.select("session_id", "turn_ix", "q_end", "answered", "wait")


@query("""select f.session_id, f.lexical_usable, case when f.lexical_usable then coalesce(f.questions, 0) end as questions,
  case when f.lexical_usable then coalesce(f.responses, 0) end as responses, case when f.lexical_usable then coalesce(f.waits, 0) else 0 end as waits
from facts f""")
def lexical_gate(c):
    return c.analysis.values.select("session_id", "lexical_usable", F.col("m7").alias("questions"),
                                    F.col("m8").alias("responses"), F.col("wait_count").alias("waits"))


_LOUD = _KMEANS.replace("\n--\n", "\n").replace("round(case", "(case").replace(", 9) as role_conf", ") as role_conf").replace("LOUD", "timeline").strip()
add_mixed_path(_LOUD.replace("loud as (", "with recursive loud as (", 1))


@query("""select session_id, key, round(value, 9) as value, band, round(confidence, 9) as confidence from x_metric_rows""")
def mixed_path_metrics(c):
    """Turns where there are any, loudness and the tiles it attributes elsewhere."""
    rows = c.analyse(loudness_path=True).metrics
    return rows.select("session_id", "key", F.round("value", 9).alias("value"), "band", F.round("confidence", 9).alias("confidence"))


@query("""select session_id, speech_sec, speech_density, mean_logprob, segments::bigint as segments, mean_no_speech from stats""")
def transcript_stats(c):
    return metrics.transcript_stats(c.spoken_segments, c.transcripts).select(
        "session_id", "speech_sec", "speech_density", "mean_logprob", "segments", "mean_no_speech")


@query("select session_id, string_agg(text, ' ' order by start, seg_ix) as text from spoken_segments where text <> '' group by 1")
def transcript_text(c):
    return metrics.transcript_text(c.spoken_segments)


_LOST = """select session_id, other_sec, student_sec, other_sec >= 2 and coalesce(student_sec, 0) <= 0 as lost
from (select session_id, sum(case when speaker <> main_speaker then "end" - start else 0 end) as other_sec
  from turns join main using (session_id) group by 1)
left join (select session_id, sum(case when role = 'student' then "end" - start else 0 end) as student_sec from labelled group by 1) using (session_id)"""


@query(_LOST)
def lost_students(c):
    a = c.analysis
    return metrics.lost_students(a.marked, a.labelled)


LATIN = "\\u00C0-\\u024F"
LICENSES = {"license": ("license", "licence"), "copyright": ("copyright", "all rights reserved")}


def _signals(c: Corpus) -> DataFrame:
    # One row group of a file is one task; the figures of a text cost more than moving it.
    rows = c.table("documents").repartition("doc_id").select(
        "doc_id", "text", (F.col("n_chars") / F.lit(16.0)).alias("audio_sec"), (-(F.col("doc_id") % 12) / F.lit(4.0)).alias("mean_logprob"),
        ((F.col("doc_id") % 5) / F.lit(4.0)).alias("speech_density"))
    return scoring.text_signals(rows, LATIN, LICENSES)


_LETTERS = "regexp_replace(text, '[^\\p{L}]', '', 'g')"
_SCRIPT = f"case when {_LETTERS} = '' then 0.0::double else length(regexp_replace({_LETTERS}, '[^\\x{{00C0}}-\\x{{024F}}]', '', 'g')) / length({_LETTERS})::double end"
_HITS = """case when contains(lower(text), 'copyright') or contains(lower(text), 'all rights reserved') then 'copyright' end,
  case when contains(lower(text), 'license') or contains(lower(text), 'licence') then 'license' end"""
_HIT_LIST = f"array_to_string(list_filter([{_HITS}], lambda f: f is not null), ',')"
_WPS = "case when n_chars > 0 then len(ws) / (n_chars / 16.0::double) else 0.0::double end"
_SIGNALS = f"""select doc_id, {_REPEAT} as repetition_rate, {_SCRIPT} as script_ratio, {_WPS} as words_per_sec, {_HIT_LIST} as artefacts,
  length(text)::int as chars, -(doc_id % 12) / 4.0::double as mean_logprob, (doc_id % 5) / 4.0::double as speech_density
from ({_DOC_WORDS} documents)"""


@query(f"""select doc_id, repetition_rate, script_ratio, words_per_sec, artefacts, chars, mean_logprob, speech_density, chars = 0 as is_empty,
  chars > 0 as compressed from ({_SIGNALS})""")
def quality_signals(c):
    """Signals of texts. DuckDB has no gzip: whether there is a ratio is checked here, its size in ``compression_bounds``."""
    return _signals(c).select("doc_id", "repetition_rate", "script_ratio", "words_per_sec", joined(F.col("artefacts")).alias("artefacts"), "chars",
                              "mean_logprob", "speech_density", (F.col("chars") == 0).alias("is_empty"), (F.col("compression_ratio") > 0).alias("compressed"))


@query(f"""select s.session_id, s.speech_density, s.mean_logprob, s.mean_no_speech, s.segments::bigint as segments, {_REPEAT} as repetition_rate,
  {_SCRIPT} as script_ratio, case when r.actual_sec > 0 then len(ws) / r.actual_sec else 0.0::double end as words_per_sec, {_HIT_LIST} as artefacts,
  length(text)::int as chars, text = '' as is_empty
from stats s
join recordings r using (session_id) join (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from (
  select session_id, coalesce(x.text, '') as text from stats left join (
    select session_id, string_agg(text, ' ' order by start, seg_ix) as text from spoken_segments where text <> '' group by 1) x using (session_id))) t using (session_id)""")
def transcript_signals(c):
    rows = scoring.transcript_signals(c.spoken_segments, c.transcripts, LATIN, LICENSES)
    return rows.select("session_id", "speech_density", "mean_logprob", "mean_no_speech", "segments", "repetition_rate", "script_ratio",
                       "words_per_sec", joined(F.col("artefacts")).alias("artefacts"), "chars", "is_empty")


@query("""select doc_id, true as within_bounds, true as loop_alarm, 0.0::double as of_nothing from documents where text <> ''""")
def compression_bounds(c):
    """gzip adds at most 18 bytes and 5 a block of 16 KB, and saves at most a factor of 1032.

    A text said again and again loops, if it repeats within the 32 KB that gzip looks back. So each whole text is
    cut into pieces of at most 2,000 characters, and the alarm must ring for every one of them said 200 times.
    """
    text, n = F.col("text"), F.octet_length("text")
    ratio = tx.compression_ratio(text)
    docs_ = c.table("documents").repartition("doc_id").filter("text <> ''")
    whole = docs_.select("doc_id", ((ratio <= 1032.0) & (ratio >= n / (n + 18.0 + 5.0 * F.ceil(n / 16000.0)))).alias("within_bounds"))
    cuts = F.sequence(F.lit(0), F.ceil(F.length(text) / 2000).cast("int") - 1)
    piece = F.col("piece")
    looped = docs_.select("doc_id", F.explode(F.transform(cuts, lambda i: F.substr(text, i * 2000 + 1, F.lit(2000)))).alias("piece")).select(
        "doc_id", tx.compression_ratio(piece, 200).alias("compression_ratio"), tx.compression_ratio(F.lit("")).alias("_nothing"))
    rows = looped.select("doc_id", scoring.looping_alarm().alias("_rings"), "_nothing").groupBy("doc_id").agg(
        F.bool_and("_rings").alias("loop_alarm"), F.max("_nothing").alias("of_nothing"))
    return whole.join(rows, "doc_id").select("doc_id", "within_bounds", "loop_alarm", "of_nothing")


_CLAMP = "greatest(0::double, least(1::double, {0}))"
_COMPOSITE = f"""case when chars = 0 then 0.0::double else {_CLAMP.format('''(
  0.40::double * case when mean_logprob is null then 0.5::double else greatest(0::double, least(1::double, (mean_logprob + 3) / 3)) end
  + 0.20::double * greatest(0::double, least(1::double, speech_density)) + 0.25::double * (1 - repetition_rate) + 0.15::double * (1 - (1 - script_ratio)))
  * case when artefacts <> '' then 0.5::double else 1 end
  * case when words_per_sec > 4 then greatest(0.2::double, 4 / words_per_sec) else 1 end''')} end"""


@query(f"select doc_id, round({_COMPOSITE}, 9) as composite from ({_SIGNALS})")
def composite_score(c):
    return _signals(c).select("doc_id", F.round(scoring.composite(), 9).alias("composite"))


_BAKEOFF_ROWS = f"""select t.item_id as clip_id, t.label, t.repetition_rate, t.script_ratio, t.words_per_sec, '' as artefacts, t.chars,
  case when t.label <> 'looped' then -(t.item_id % 12) / 4.0::double end as mean_logprob, (t.item_id % 5) / 4.0::double as speech_density,
  (t.item_id % 3 + 1)::double as elapsed_sec, a.agreement
from (select item_id, label, {_REPEAT} as repetition_rate, {_SCRIPT} as script_ratio, length(text) as chars,
    len(ws) / (n / 2.5::double) as words_per_sec
  from ({_DOC_WORDS} contender_text) join (select item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n from benchmark) using (item_id)
  where not (label = 'dropped' and item_id % 10 = 3)) t
left join ({_AGREE}) a on a.clip_id = t.item_id and a.label = t.label"""


@query(f"""select clip_id, label, round({_COMPOSITE}, 9) as composite, round(agreement, 9) as agreement from ({_BAKEOFF_ROWS})""")
def bakeoff_rows(c):
    rows = compare.bakeoff(_bakeoff_input(c), LATIN, {})
    return rows.select("clip_id", "label", F.round("composite", 9).alias("composite"), F.round("agreement", 9).alias("agreement"))


_RANKING = f"""select label, count(*) as clips_scored, round(avg({_COMPOSITE}), 9) as composite, round(avg(agreement), 9) as agreement,
  round(avg(mean_logprob), 9) as mean_logprob, round(avg(repetition_rate), 9) as repetition_rate, round(avg(elapsed_sec), 9) as mean_elapsed_sec
from ({_BAKEOFF_ROWS}) group by 1"""


@query(f"select *, row_number() over (order by composite desc, label)::int as position from ({_RANKING})")
def contender_ranking(c):
    rows = compare.ranking(_bakeoff_input(c), script=LATIN, patterns={})
    r = lambda n: F.round(n, 9).alias(n)
    return rows.select("label", "clips_scored", r("composite"), r("agreement"), r("mean_logprob"), r("repetition_rate"),
                       r("mean_elapsed_sec"), "position")


def _samples(c: Corpus) -> DataFrame:
    return c.table("benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("reference"))


def _outputs(c: Corpus) -> DataFrame:
    item, dropped = F.col("item_id"), F.col("label") == "dropped"
    text = F.when(dropped & (item % 10 == 3), None).when(dropped & (item % 10 == 7), "").otherwise(F.col("text"))
    # The dropped backend has no row at all for some samples.
    return _contender_text(c).filter(~(dropped & (item % 10 == 5))).select(item.alias("sample_id"), F.col("label").alias("backend"), text.alias("hypothesis"),
                                     (item % 3 + 1.0).alias("elapsed_sec"))


_NORMAL = "trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\\p{{P}}\\p{{So}}]', '', 'g'), '\\s+', ' ', 'g'))"
_CODES = "array_to_string(list_transform({0}, lambda w: chr((33 + list_position(known, w))::int)), '')"
_EDITS = f"""select sample_id, backend, hyp is null as failed, elapsed, reference, hyp, len(rw) as ref_words,
  case when hyp is not null then levenshtein({_CODES.format('rw')}, {_CODES.format('hw')}) end as word_edits
from (select *, list_distinct(rw || hw) as known from (
  select b.item_id as sample_id, c.label as backend, b.text as reference, b.item_id % 3 + 1.0::double as elapsed,
    case when c.label = 'dropped' and b.item_id % 10 = 3 then null when c.label = 'dropped' and b.item_id % 10 = 7 then '' else c.text end as hyp,
    list_filter(string_split({_NORMAL.format('b.text')}, ' '), lambda w: w <> '') as rw,
    list_filter(string_split({_NORMAL.format("coalesce(case when c.label = 'dropped' and b.item_id % 10 in (3, 7) then '' else c.text end, '')")}, ' '), lambda w: w <> '') as hw
  from benchmark b join contender_text c using (item_id) where not (c.label = 'dropped' and item_id % 10 = 5)))"""


_SCORES = f"""select backend, count(*) filter (not failed) as scored,
  (select count(*) from benchmark) - count(*) filter (not failed) as failed,
  sum(word_edits) / sum(ref_words) filter (not failed)::double as wer, sum(elapsed) as elapsed_sec from ({_EDITS}) group by 1"""


@query(f"select * from ({_SCORES})")
def backend_scores(c):
    return scoring.score_backends(_samples(c), _outputs(c)).select("backend", "scored", "failed", "wer", "elapsed_sec")


@query(f"""select n as backend, coalesce(scored, 0) as scored, coalesce(failed, (select count(*) from benchmark)) as failed, wer,
  row_number() over (order by wer asc nulls last, n)::int as position
from (select unnest(['as_is', 'dropped', 'mute']) as n) left join ({_SCORES}) on backend = n""")
def asked_backends(c):
    """Three backends were asked: two with rows, one that answered nothing at all."""
    return compare.benchmark(_samples(c), _outputs(c), ["as_is", "dropped", "mute", "mute"]).select(
        "backend", "scored", "failed", "wer", "position")


@query(f"select backend, scored, failed, wer from ({_SCORES})")
def score_export(c):
    """Scores written as rows and read again, as a report does."""
    scores = scoring.score_backends(_samples(c), _outputs(c)).select("backend", "scored", "failed", "wer")
    path = new_folder(c.spark, "scores")
    docs.write_rows(scores, path)
    return docs.read_rows(c.spark, path, scores.schema)


@query(f"select backend, wer, row_number() over (order by wer asc nulls last, backend)::int as position from ({_SCORES})")
def backend_ranking(c):
    return compare.benchmark(_samples(c), _outputs(c)).select("backend", "wer", "position")


_CHARS = f"""select sample_id, backend, hyp is null as failed, len(rc) as ref_chars,
  case when hyp is not null then levenshtein({_CODES.format('rc')}, {_CODES.format('hc')}) end as char_edits
from (select *, list_distinct(rc || hc) as known from (select sample_id, backend, hyp,
    list_filter(string_split(replace({_NORMAL.format('reference')}, ' ', ''), ''), lambda w: w <> '') as rc,
    list_filter(string_split(replace({_NORMAL.format("coalesce(hyp, '')")}, ' ', ''), ''), lambda w: w <> '') as hc
  from ({_EDITS})))"""


@query(f"""select sample_id, backend, word_edits::int as word_edits, word_edits / ref_words::double as wer, char_edits / ref_chars::double as cer
from ({_EDITS}) e join ({_CHARS}) using (sample_id, backend) where not e.failed""")
def sample_error_rates(c):
    pairs = _samples(c).join(_outputs(c), "sample_id").filter("hypothesis is not null")
    return scoring.pair_rates(pairs).select("sample_id", "backend", "word_edits", "wer", "cer")


@query(f"""select backend, sum(char_edits) / sum(ref_chars) filter (not failed)::double as cer from ({_CHARS}) group by 1""")
def character_error_rates(c):
    return scoring.score_backends(_samples(c), _outputs(c)).select("backend", "cer")


@query(f"""select backend, sample_id, wer from (select *, word_edits / ref_words::double as wer,
  row_number() over (partition by backend order by word_edits / ref_words::double, sample_id) as n from ({_EDITS}) where not failed) where n = 1""")
def best_samples(c):
    return scoring.best_samples(_samples(c).join(_outputs(c), "sample_id")).select("backend", "sample_id", "wer")


def _label_rows(c: Corpus) -> DataFrame:
    return c.table("documents").join(c.table("labels"), "doc_id", "left").select(
        F.col("source").alias("sheet"), F.col("doc_id").alias("row_id"),
        F.when(F.col("n_chars") >= 1000, "teacher").otherwise("student").alias("predicted"),
        F.when(F.col("quality") == 1, "teacher").when(F.col("quality") == 0, "student").alias("truth"),
        ((F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence"))


_LABEL_INPUT = """select source as sheet, case when n_chars >= 1000 then 'teacher' else 'student' end as predicted,
  case quality when 1 then 'teacher' when 0 then 'student' end as truth, (doc_id % 100) / 100.0::double as confidence
from documents left join labels using (doc_id)"""
_LABEL_SCORES = """count(*) as total, count(truth) as labelled, count(*) filter (predicted = truth) as correct,
  count(*) filter (predicted = truth) / nullif(count(truth), 0)::double as accuracy,
  count(*) filter (predicted = truth and confidence >= 0.15::double) / nullif(count(truth) filter (confidence >= 0.15::double), 0)::double as confident_accuracy,
  count(*) filter (predicted = truth and truth = 'teacher') / nullif(count(*) filter (truth = 'teacher'), 0)::double as recall_teacher,
  count(*) filter (predicted = truth and truth = 'student') / nullif(count(*) filter (truth = 'student'), 0)::double as recall_student"""


@query(f"select {_LABEL_SCORES} from ({_LABEL_INPUT})")
def label_scores(c):
    return labels.score_labels(_label_rows(c))


@query(f"select truth, predicted, count(*) as n from ({_LABEL_INPUT}) where truth is not null group by 1, 2")
def label_confusion(c):
    return labels.confusion(_label_rows(c))


@query(f"select sheet, grouping(sheet) = 1 as is_total, {_LABEL_SCORES} from ({_LABEL_INPUT}) group by rollup (sheet)")
def label_scores_by_sheet(c):
    return labels.score_by_sheet(_label_rows(c))


@query("""select r.session_id, 100 * s.speech / r.actual_sec as speech_percent, 60 * s.n / r.actual_sec as spans_per_minute,
  s.med as median_span, round(20 * log10(l.level), 6) as loudness_db
from recordings r join (select session_id, sum("end" - start) as speech, count(*) as n, median("end" - start) as med from spans group by 1) s using (session_id)
join (select session_id, avg(10 ** (rms_db / 20)) as level from timeline group by 1) l using (session_id)""")
def speech_profile(c):
    return metrics.speech_profile(c.analysis.timeline, c.recordings).withColumn("loudness_db", F.round("loudness_db", 6))


ORACLES_LANGUAGE = f"""select session_id, case when i % 3 = 0 then 'hi' when i % 3 = 1 then 'mr' else 'en' end as language,
  p as language_prob from (select *, row_number() over (partition by session_id order by coalesce(p, -1) desc, i) as n
  from (select session_id, chunk_ix as i, case when chunk_ix % 4 <> 2 then ((session_id + chunk_ix * 3) % 5) / 4.0::double end as p from ({_CHUNKS}))) where n = 1"""


@query(ORACLES_LANGUAGE)
def language_vote(c):
    return sequences.language_vote(_parts(c))


def _parts(c: Corpus) -> DataFrame:
    ix = F.col("chunk_ix")
    return _chunks(c).select(
        "session_id", "chunk_ix", F.when(ix % 3 == 0, "hi").when(ix % 3 == 1, "mr").otherwise("en").alias("language"),
        F.when(ix % 4 != 2, ((F.col("session_id") + ix * 3) % 5) / F.lit(4.0)).alias("language_prob"),
        F.when(ix == 0, "indic").otherwise("other").alias("backend"), F.lit("conformer-hi").alias("model"))


_KEPT = f"""select *, row_number() over (partition by session_id order by chunk_ix, seg_ix) as no from (
  select *, lag(text) over w as was, lag(start) over w as was_start from ({_PLACED})
  window w as (partition by session_id order by chunk_ix, seg_ix))
where not coalesce(text = was and abs(start - was_start) <= 1, false)"""


@query(f"""select v.session_id, v.language, v.language_prob, 'indic' as backend, 'conformer-hi' as model, r.actual_sec as audio_sec,
  k.segments, k.first_start, k.last_end from ({ORACLES_LANGUAGE}) v join recordings r using (session_id)
left join (select session_id, count(*) as segments, min_by(start, no) as first_start, max_by("end", no) as last_end from ({_KEPT}) group by 1) k
using (session_id)""")
def stitched_transcripts(c):
    heads, segments = stitching.stitch(_parts(c), _part_segments(c), _chunks(c), c.recordings)
    ends = segments.groupBy("session_id").agg(F.max("seg_ix").alias("segments"), F.min_by("start", "seg_ix").alias("first_start"),
                                              F.max_by("end", "seg_ix").alias("last_end"))
    return heads.join(ends, "session_id", "left")


@query("""select sum(coalesce(declared_sec, actual_sec)) / 60 as declared_min, sum(actual_sec) / 60 as measured_min,
  1 - sum(actual_sec) / sum(coalesce(declared_sec, actual_sec)) as lost_share from sessions""")
def corpus_totals(c):
    return cp.corpus_totals(c.sessions.join(c.recordings, "session_id"))


@query(f"""select session_id, bucket, {rounded('sec', 2)} as sec from (unpivot (select session_id, teacher_sec as teacher, student_sec as student,
  handson_sec as handson, dead_sec as dead, unattributed_sec as unattributed from talk)
  on teacher, student, handson, dead, unattributed into name bucket value sec) where sec > 0 and bucket <> 'unattributed'""")
def display_totals(c):
    return report.display_totals(report.published_totals(iv.talk_time(c.analysis.labelled)))


_RATIO = """select session_id, case when mean_role_conf >= 0.15::double and teacher_sec + student_sec > 0
  then teacher_sec / (teacher_sec + student_sec) end as ratio from {0}"""


@query(f"""select session_id, w.ratio as window_ratio, f.ratio as full_ratio, f.ratio - w.ratio as shift
from ({_RATIO.format('w_talk')}) w join ({_RATIO.format('talk')}) f using (session_id)""")
def window_bias(c):
    """Talk ratio of the first two minutes against the whole."""
    return report.window_bias(c.analyse(minutes=2.0).acoustic, c.analysis.acoustic)


# =========================================================================== functions
@query(r"select session_id, seg_ix, regexp_matches(text, '\?|(?:^|\s)(?:is|der|de|es)(?:\s|$)') as asks from segments")
def question_detection(c):
    return c.segments.select("session_id", "seg_ix", tx.is_question(F.col("text"), QUESTION_LEXICON).alias("asks"))


@query(f"select item_id, {_NORMAL.format('text')} as folded from benchmark")
def scoring_normaliser(c):
    return c.table("benchmark").select("item_id", tx.for_scoring(F.col("text")).alias("folded"))


@query()
def compression_ratio(c):
    """Bytes over gzip bytes; DuckDB has no gzip function."""
    return c.table("documents").select("doc_id", F.round(tx.compression_ratio(F.col("text")), 9).alias("ratio"))


@query(f"select doc_id, {_SCRIPT} as ratio from documents")
def script_ratio(c):
    return c.table("documents").select("doc_id", tx.script_ratio(F.col("text"), LATIN).alias("ratio"))


@query(f"select doc_id, {_WPS} as rate from ({_DOC_WORDS} documents)")
def words_per_second(c):
    return c.table("documents").select("doc_id", tx.words_per_second(F.col("text"), F.col("n_chars") / 16.0).alias("rate"))


@query(f"select doc_id, {_HIT_LIST} as hits from documents")
def artefact_hits(c):
    return c.table("documents").select("doc_id", joined(tx.artefact_hits(F.col("text"), LICENSES)).alias("hits"))


@query(f"""select item_id, round(avg(len(list_intersect(a.bag, b.bag)) / len(list_distinct(a.bag || b.bag))::double), 9) as agreement
from (select item_id, label, {_WORDS} as bag from contender_text) a join (select item_id, label, {_WORDS} as bag from contender_text) b
using (item_id) where a.label < b.label group by 1""")
def set_agreement(c):
    # Three texts per item by construction, so the list is bounded.
    texts = _contender_text(c).groupBy("item_id").agg(F.collect_list("text").alias("texts"))
    return texts.select("item_id", F.round(tx.mean_agreement(F.col("texts")), 9).alias("agreement"))


@query(f"select clip_id, label, round(agreement, 9) as agreement, 2 as copies from ({_AGREE}) cross join range(2)")
def doubled_agreement(c):
    """Every row twice: the agreement of a contender is what it is without the copies."""
    once = _bakeoff_input(c).filter("text is not null")
    rows = scoring.agreement(once.unionByName(once))
    copies = rows.groupBy("clip_id", "label").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return rows.join(copies, ["clip_id", "label"]).select("clip_id", "label", F.round("agreement", 9).alias("agreement"), "copies")


@query("""select session_id, case when m2 is null then 'unknown' when m2 < 1 then 'low' when m2 > 6 then 'high' else 'normal' end as band from vals""")
def banding(c):
    return c.analysis.values.select("session_id", numbers.band(F.col("m2"), 1.0, 6.0).alias("band"))


@query("""select vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)), 1e-12::double)), 6) as rms_db
from embeddings""")
def loudness_db(c):
    return c.table("embeddings").select("vec_id", F.round(signal.rms_db(F.col("embedding")), 6).alias("rms_db"))


@query("""select vec_id, round(exp(avg(ln(p))) / avg(p), 6) as flatness from (
  select vec_id, k, greatest(power(sum(x * w * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * w * sin(2 * pi() * k * i / 64)), 2), 1e-12::double) as p
  from (select vec_id, i, x, 0.5::double - 0.5::double * cos(2 * pi() * i / 63) as w from (
    select vec_id, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from embeddings))
  cross join (select unnest(range(1, 33)) as k) group by 1, 2) group by 1""")
def spectral_flatness(c):
    rows = signal.spectral_flatness(c.table("embeddings"), "vec_id", "embedding")
    return rows.select("vec_id", F.round("flatness", 6).alias("flatness"))


@query(f"select session_id, {duration_text('actual_sec')} as length from recordings")
def duration_texts(c):
    return c.recordings.select("session_id", numbers.duration_text(F.col("actual_sec")).alias("length"))


# =========================================================================== rule-based text
_VALS = "vals join (select session_id, activity, alias from corpus) using (session_id)"
_SPOKEN = "(teacher_sec + student_sec)"
_HEADLINE = f"""case when m1 is null then activity || ': ' || {duration_text(_SPOKEN)} || ' of talking, but the recording could not tell your voice from the children''s.'
  when m1 > 0.70::double then 'You spoke ' || {percent_text('m1')} || ' of the talking time in ' || activity || ' — a hands-on session usually works better below 40%.'
  when m1 > 0.40::double then 'You spoke ' || {percent_text('m1')} || ' of the talking time in ' || activity || ' — close to the target.'
  else 'You spoke ' || {percent_text('m1')} || ' of the talking time in ' || activity || ' — the children did most of the talking.' end"""


def _one(x: str) -> str:
    return f"printf('%.1f', {rounded(x, 1)})"


_SUGGEST = f"""case when m4 > 300 then 'Your longest unbroken stretch was ' || {duration_text('m4')} || '. Try breaking it with a question at the halfway point.'
  when m5 < 1 then 'After you asked a question you moved on in ' || {_one('m5')} || 's. Count to three before taking an answer — research finds responses get longer and more children join in.'
  when m1 > 0.70::double then 'Try handing one explanation to a group to give back to the class — it moves talking time to them without losing the content.'
  when m2 < 1 then 'Only a few children spoke. Try asking a question to a named group rather than the whole room.'
  when m4 > 120 then 'Your longest unbroken stretch was ' || {duration_text('m4')} || ' — about right, but worth watching if it grows.'
  else 'Nothing stands out to change. Keep the phone where it is; the recording came through clearly.' end"""
_ADVICE = """case when conf_speech_density < 0.4::double then 'This recording was mostly room noise. Try keeping the phone on the front desk rather than in a pocket or bag.'
  when conf_completeness < 0.8::double then 'The recording stopped early — only part of the lesson was saved. Check the app is still recording before you put the phone down.'
  else 'This recording was too noisy to read. Try keeping the phone closer to where you are standing.' end"""
_SUMMARY = f"""activity || ': ' || coalesce(nullif(array_to_string(list_filter([
  case when {_SPOKEN} > 0 then {duration_text(_SPOKEN)} || ' of talking' end,
  case when handson_sec > 0 then {duration_text('handson_sec')} || ' hands-on' end,
  case when dead_sec > 30 then {duration_text('dead_sec')} || ' quiet' end,
  case when m3 > 0 then {_one('m3')} || ' exchanges a minute' end], lambda b: b is not null), ', '), '') || '.', 'nothing measurable.')"""


def _texts(c: Corpus) -> DataFrame:
    return c.analysis.values.join(c.analysis.corpus.select("session_id", "activity"), "session_id")


@query(f"select session_id, {_HEADLINE} as headline from {_VALS}")
def headlines(c):
    return _texts(c).select("session_id", insight.headline().alias("headline"))


@query(f"select session_id, {_SUGGEST} as suggestion from {_VALS}")
def suggestions(c):
    return _texts(c).select("session_id", insight.suggestion().alias("suggestion"))


@query(f"select session_id, {_ADVICE} as advice from {_VALS}")
def recording_advice(c):
    return _texts(c).select("session_id", insight.recording_advice().alias("advice"))


@query(f"select session_id, {_SUMMARY} as summary from {_VALS}")
def summaries(c):
    return _texts(c).select("session_id", insight.summary().alias("summary"))


_SHOWN = ("array_to_string(list_filter([" + ", ".join(
    f"case when {m[1]} is not null then '{m[0]}' end" for m in METRICS) + "], lambda k: k is not null), ',')")
_INSIGHT = f"""select session_id, alias, verdict,
  case when verdict = 'unreliable' then activity || ' was too noisy to analyse reliably.' else {_HEADLINE} end as headline,
  case when verdict = 'unreliable' then {_ADVICE} else {_SUGGEST} end as suggestion,
  case when verdict = 'unreliable' then 'No metrics are shown for this recording. A number here would be a guess, and a guess is worse than nothing.' else {_SUMMARY} end as summary,
  case when verdict = 'unreliable' then '' else {_SHOWN} end as metrics_shown from {_VALS}"""


@query(f"select session_id, verdict, headline, suggestion, summary, metrics_shown from ({_INSIGHT})")
def insights(c):
    return c.analysis.insight.select("session_id", "verdict", "headline", "suggestion", "summary", joined(F.col("metrics_shown")).alias("metrics_shown"))


_BODY = "'नमस्ते ' || alias || '!' || chr(10) || chr(10) || headline || chr(10) || chr(10) || '💡 ' || suggestion"


@query(f"""select session_id, case when length(body) > 400 then rtrim(substr(body, 1, 399)) || '…' else body end as message
from (select session_id, {_BODY} as body from ({_INSIGHT}))""")
def messages(c):
    return c.analysis.insight.select("session_id", "message")


# =========================================================================== documents
_DOCUMENTS = f"""select c.session_id::varchar as session_id, '1.0' as schema_version, c.teacher_id, c.alias, c.activity,
  strftime(c.recorded_at, '%Y-%m-%dT%H:%M:%S') as recorded_at, c.total as roster_total, c.boys as roster_boys, c.girls as roster_girls,
  {rounded('nullif(c.declared_sec, 0)', 1)} as declared_sec, {rounded('c.actual_sec', 1)} as actual_sec, {rounded('c.actual_sec', 1)} as analysed_sec,
  {rounded('c.completeness', 3)} as completeness, 16000::int as sample_rate, 1::int as channels, c.has_gps,
  case when c.session_id % 13 <> 0 then 'conformer-hi' end as asr, case when c.session_id % 13 <> 0 then 'indic' end as asr_backend,
  'pyannote-community-1' as attribution, 'pyannote-community-1-segmentation' as vad,
  {rounded('t.teacher_sec', 2)} as teacher_sec, {rounded('t.student_sec', 2)} as student_sec, {rounded('t.handson_sec', 2)} as handson_sec,
  {rounded('t.dead_sec', 2)} as dead_sec, {rounded('t.unattributed_sec', 2)} as unattributed_sec,
  {rounded('f.confidence', 3)} as confidence, {rounded('f.conf_speech_density', 3)} as conf_speech_density,
  {rounded('f.conf_attribution', 3)} as conf_attribution, {rounded('f.conf_completeness', 3)} as conf_completeness, {rounded('f.conf_asr', 3)} as conf_asr,
  f.verdict, i.headline, i.suggestion, i.summary, i.metrics_shown, m.message as whatsapp, g.flags, l.lost
from corpus c join talk t using (session_id) join facts f using (session_id) join ({_INSIGHT}) i using (session_id)
join (select session_id, case when length(body) > 400 then rtrim(substr(body, 1, 399)) || '…' else body end as message
  from (select session_id, {_BODY} as body from ({_INSIGHT}))) m using (session_id)
join (select session_id, {_FLAGS} as flags from corpus) g using (session_id) left join ({_LOST}) l using (session_id)"""


def _stored(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Documents and timeline written to a new folder under the shared one, an old run before them, and read back."""
    a = c.analysis
    path = new_folder(c.spark, "documents")
    docs.write_documents(a.documents.filter("session_id % 2 = 0").withColumn("activity", F.lit("old")), a.published_timeline.limit(3), path, "r0")
    docs.write_documents(a.documents, a.published_timeline, path, "r1")
    # A run that stopped before its timeline: it is not listed and counts for nothing.
    half = F.regexp_replace("value", '"activity":"[^"]*"', '"activity":"half"')
    c.spark.read.text(f"{path}/documents/run=r1").select(half.alias("value")).write.text(f"{path}/documents/run=r2")
    docs.write_index(c.recordings, f"{path}/index")
    return docs.read_documents(c.spark, path, f"{path}/index")


@query(f"""select * exclude (flags, lost), array_to_string(list_filter([nullif(flags, ''), case when lost then 'attribution_lost_students' end],
  lambda x: x is not null), ',') as flags from ({_DOCUMENTS})""")
def result_documents(c):
    """Every field of every document, after writing and reading."""
    rows, _ = _stored(c)
    return rows.select(
        "session_id", "schema_version", F.col("teacher.id").alias("teacher_id"), "teacher.alias", "activity", "recorded_at",
        F.col("roster.total").alias("roster_total"), F.col("roster.boys").alias("roster_boys"), F.col("roster.girls").alias("roster_girls"),
        "audio.declared_sec", "audio.actual_sec", "audio.analysed_sec", "audio.completeness", "audio.sample_rate", "audio.channels",
        "audio.has_gps", "models.asr", "models.asr_backend", "models.attribution", "models.vad",
        *[F.col("totals_sec")[k].alias(f"{k}_sec") for k in ("teacher", "student", "handson", "dead", "unattributed")],
        F.col("confidence.overall").alias("confidence"),
        *[F.col(f"confidence.components.{k}").alias(f"conf_{k}") for k in ("speech_density", "attribution", "completeness", "asr")],
        "confidence.verdict", "insight.headline", "insight.suggestion", "insight.summary",
        joined(F.col("insight.metrics_shown")).alias("metrics_shown"), "insight.whatsapp", joined(F.col("flags")).alias("flags"))


@query(f"""select session_id::varchar as session_id, key, {rounded('value', 4)} as value, unit, band, benchmark, {rounded('confidence', 3)} as confidence
from metric_rows""")
def document_metrics(c):
    """The seven metrics inside every document, after writing and reading."""
    rows, _ = _stored(c)
    return rows.select("session_id", F.explode("metrics").alias("key", "m")).select(
        "session_id", "key", "m.value", "m.unit", "m.band", "m.benchmark", "m.confidence")


@query(f"select * replace (session_id::varchar as session_id, seg_no::bigint as seg_no) from ({_PUBLISHED})")
def document_timeline(c):
    """All timeline rows beside the documents, after writing and reading."""
    return _stored(c)[1]
