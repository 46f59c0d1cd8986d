"""Schemas of the session tables and of the published documents."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _d, _b, _l = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ROSTER = _struct(total=_i, boys=_i, girls=_i)

# The sidecar a capture app writes next to a recording.
METADATA_JSON = _struct(
    teacherId=_s, activityType=_s, totalStudents=_s, boys=_s, girls=_s, duration=_d, timestamp=_s,
    photoMetadata=_struct(teacherName=_s, capturedAt=_s, latitude=_d, longitude=_d, address=_s))

WORD = _struct(start=_d, end=_d, word=_s)

TRANSCRIPT_HEAD = _struct(language=_s, language_prob=_d, backend=_s, model=_s, audio_sec=_d)
TRANSCRIPT_LINE = _struct(seg_ix=_l, start=_d, end=_d, text=_s, avg_logprob=_d, no_speech_prob=_d, words=T.ArrayType(WORD))

_METRIC = _struct(value=_d, unit=_s, band=_s, benchmark=_d, confidence=_d, formula=_s, explanation=_s,
                  interpretation=_s)

RESULT = _struct(
    schema_version=_s, session_id=_s, teacher=_struct(id=_s, alias=_s), activity=_s, recorded_at=_s,
    roster=ROSTER,
    audio=_struct(declared_sec=_d, actual_sec=_d, analysed_sec=_d, completeness=_d, sample_rate=_i,
                  channels=_i, has_gps=_b),
    models=_struct(asr=_s, asr_backend=_s, attribution=_s, vad=_s),
    totals_sec=T.MapType(_s, _d), metrics=T.MapType(_s, _METRIC),
    confidence=_struct(overall=_d, components=_struct(speech_density=_d, attribution=_d, completeness=_d,
                                                      asr=_d), verdict=_s),
    insight=_struct(headline=_s, suggestion=_s, summary=_s, metrics_shown=T.ArrayType(_s), verdict=_s,
                    generated_by=_s, whatsapp=_s),
    flags=T.ArrayType(_s))

# A row of the published timeline, which lies beside the documents.
TIMELINE_ROW = _struct(session_id=_s, seg_no=_l, t0=_d, t1=_d, kind=_s, rms_db=_d, role=_s, role_conf=_d, text=_s)
