import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").appName("turnlake-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="turnlake-tests-")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: [(v is None, str(v)) for v in t])


TURNS = "session_id long, turn_ix int, start double, end double, speaker string"
SEGMENTS = "session_id long, seg_ix int, start double, end double, text string, avg_logprob double, no_speech_prob double"
TIMELINE = ("session_id long, segment_ix int, start double, end double, kind string, rms_db double, flatness double, "
            "role string, role_conf double")


@pytest.fixture
def make(spark):
    class Make:
        def turns(self, *sessions):
            """Each session is a list of (speaker, start, end)."""
            return spark.createDataFrame([(s, i, float(a), float(b), who) for s, turns in enumerate(sessions)
                                          for i, (who, a, b) in enumerate(turns, 1)], TURNS)

        def segments(self, *sessions):
            """Each session is a list of (start, end, text)."""
            return spark.createDataFrame([(s, i, float(a), float(b), text, None, None) for s, segs in enumerate(sessions)
                                          for i, (a, b, text) in enumerate(segs, 1)], SEGMENTS)

        def timeline(self, *sessions):
            """Each session is a list of (kind, start, end) or (kind, start, end, role)."""
            return spark.createDataFrame([
                (s, i, float(x[1]), float(x[2]), x[0], -20.0, 0.1, x[3] if len(x) > 3 else None,
                 0.9 if len(x) > 3 and x[3] else None)
                for s, segs in enumerate(sessions) for i, x in enumerate(segs)], TIMELINE)
    return Make()
