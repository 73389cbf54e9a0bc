"""Executors need no copy of the package: every query with Python workers runs from a folder
outside the repository, with the package on the driver's path only."""

import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from fraudlake.session import build_session

spark = build_session("local[4]", 4)
probe = spark.sparkContext.parallelize([0], 1).map(
    lambda _: __import__("importlib").util.find_spec("fraudlake") is None).collect()
assert probe == [True], "the package is on the workers' path"
for name in {names!r}:
    n = entry.queries()[name](spark, {sf!r}).count()
    print("ran", name, n)
"""

NAMES = ["op4_token_counts", "op6_simhash", "op7_packing", "op8_html_extraction", "op9_language_id", "op10_bpe",
         "op11_token_alignment", "op13_hard_negatives", "pipeline", "attribute_sampled", "bootstrap_ci",
         "alert_for_stream"]


def test_queries_without_the_package_on_the_workers_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=ROOT, names=NAMES, sf=SF_SMALL).replace("__import__(\"importlib\").util",
                                                                      "__import__(\"importlib.util\").util")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=900)
    assert [x.split()[1] for x in done.stdout.splitlines() if x.startswith("ran ")] == NAMES, done.stderr[-3000:]
