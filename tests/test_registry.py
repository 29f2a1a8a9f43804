"""The registry loads from its own modules alone: no data, jar or word-list
file is opened while the queries and their SQL are put together."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import builtins, glob, io, sys, zipfile
sys.path.insert(0, {root!r})
import pyspark.sql, pandas, numpy  # libraries may read their own files
real = builtins.open
def guarded(path, *a, **k):
    raise AssertionError("opened while importing: " + str(path))
builtins.open = glob.glob = zipfile.ZipFile = guarded
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 110 and set(o) <= set(q), (len(q), set(o) - set(q))
print(len(q), len(o))
"""


def test_queries_and_oracles_load_without_files(tmp_path):
    out = subprocess.run([sys.executable, "-c", PROBE.format(root=ROOT)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]


def test_stop_words():
    from revlens.functions.text import english_stop_words
    w = english_stop_words()
    assert len(w) == len(set(w)) == 181 and w[:2] == ["i", "me"] and w[-1] == "would" and "i'll" in w
