"""The entry offers the session queries whatever the training-data part needs and lacks."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {hidden!r} or name == {hidden!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op1") for n in e.queries()))
"""


def offered(hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden, repo=str(REPO))], capture_output=True, text=True, check=True)
    queries, oracles, corpus = out.stdout.split()
    return int(queries), int(oracles), corpus == "True"


def test_a_missing_wheel_costs_only_the_queries_that_need_it():
    from checks.queries import ORACLES, QUERIES
    for hidden in ("xxhash", "corpus_pipeline", "turnlake.llm"):
        assert offered(hidden) == (len(QUERIES), len(ORACLES), False)
