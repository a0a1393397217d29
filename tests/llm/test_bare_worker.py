"""The operators run where the executors cannot import the package."""

import os
import subprocess
import sys

from tests.conftest import SF

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = ["op2_sentencepiece_n_best", "op5_wrapper_induction", "op7_secret_automaton", "op11_threshold_sketch", "op12_jacobi_davidson_whitening",
         "op13_merkle_butterfly"]
CODE = """
import sys
sys.path.insert(0, {repo!r})
from modelsieve.llm.queries import QUERIES
from modelsieve.session import local_session
spark = local_session(4, "2g")
for name in {names!r}:
    print(name, QUERIES[name](spark, {sf!r}).count(), flush=True)
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSTARTUP")}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO, names=NAMES, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert list(rows) == NAMES and all(int(n) > 0 for n in rows.values()), done.stderr[-2000:]
