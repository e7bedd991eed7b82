"""Worker-side code loads where the package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle

from sourceloom.operators.usage import _mark_hits


def test_functions_travel_by_value(tmp_path):
    # the streaming cache-hit job has no worker code of its own; it marks its log with this function
    loaded = subprocess.run(
        [sys.executable, "-c", "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"],
        input=cloudpickle.dumps(_mark_hits(5)), cwd=tmp_path, capture_output=True, timeout=120, env={"PATH": "/usr/bin"},
    )
    assert loaded.returncode == 0, loaded.stderr.decode()
