"""Thresholds of the analysis, in one frozen object so a job can override any of them."""

from __future__ import annotations

from dataclasses import dataclass, field


# They must equal the published thresholds for results to match.
@dataclass(frozen=True)
class Thresholds:
    conf_unreliable: float = 0.40
    conf_usable: float = 0.65
    completeness_ok: float = 0.98
    handson_rms_db: float = -35.0
    role_conf_floor: float = 0.15
    min_piece_sec: float = 0.30
    merge_gap_sec: float = 1.0
    stretch_merge_gap_sec: float = 3.0
    wait_max_sec: float = 15.0
    wait_min_samples: int = 3
    wait_low_sec: float = 1.0
    wait_target_sec: float = 3.0
    tie_sec: float = 1e-6
    talk_benchmark: float = 0.40
    talk_high: float = 0.70
    transcript_discount: float = 0.6
    min_other_speaker_sec: float = 2.0
    message_max_chars: int = 400
    token_gap_sec: float = 1.0
    chunk_sec: float = 90.0
    chunk_overlap_sec: float = 2.0
    duplicate_tolerance_sec: float = 1.0
    max_plausible_wps: float = 4.0
    compression_alarm: float = 2.4
    # Bake-off score: weights of the signals, and what artefacts and an implausible speed leave of it.
    signal_weights: dict[str, float] = field(
        default_factory=lambda: {"confidence": 0.40, "density": 0.20, "looping": 0.25, "script": 0.15}
    )
    unknown_confidence: float = 0.5
    logprob_range: float = 3.0
    artefact_factor: float = 0.5
    least_speed_factor: float = 0.2
    conf_weights: dict[str, float] = field(
        default_factory=lambda: {
            "speech_density": 0.30,
            "attribution": 0.30,
            "completeness": 0.20,
            "asr": 0.20,
        }
    )


DEFAULTS = Thresholds()

# Hindi interrogatives, matched as whole words.
QUESTION_WORDS = (
    "क्या", "कौन", "कौनसा", "कहाँ", "कहां", "कब", "क्यों", "कैसे", "कितना", "कितने",
    "कितनी", "किसने", "किसका", "किसकी", "किसे", "बताओ", "बताइए",
)

# Phrases transcribers are known to invent, by pattern group.
ARTEFACT_PATTERNS = {
    "subscribe": ("सब्सक्राइब", "सबस्क्राइब", "subscribe to", "चैनल को लाइक"),
    "thanks_watching": ("देखने के लिए धन्यवाद", "thanks for watching", "धन्यवाद देखने"),
    "news_bulletin": (
        "प्रदेश के अन्य जिलों", "इस अभियान के तहत", "जागरूकता कार्यक्रम", "संवाददाता", "समाचार",
    ),
}

# Language names as a hosted transcriber spells them, and their ISO codes.
LANGUAGE_CODES = {
    "hindi": "hi", "marathi": "mr", "english": "en", "urdu": "ur",
    "bengali": "bn", "tamil": "ta", "telugu": "te", "kannada": "kn",
    "malayalam": "ml", "gujarati": "gu", "punjabi": "pa", "odia": "or",
}

# Metric keys in reading order.
METRIC_KEYS = (
    "M1_teacher_talk_ratio",
    "M2_student_participation",
    "M3_interaction_density",
    "M4_longest_teacher_stretch",
    "M5_wait_time_1",
    "M7_teacher_questions",
    "M8_student_responses",
)
# Those that rest on the timeline, not on what was said.
ACOUSTIC_KEYS = METRIC_KEYS[:4]

# The Devanagari block, as a Java regex character range.
DEVANAGARI = "\\u0900-\\u097F"
