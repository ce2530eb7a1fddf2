"""What a task holds: the bytes of its Arrow batches, and what its worker keeps when the task is over."""

import os
import re
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain

import corpus_pipeline
from ledgerweave.llm import batches

SF = "/root/testdata/sf0.001"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_send_small_batches(spark):
    """By rows alone, the 4,000 texts would be one batch of 16 MB."""
    few = plain.table(spark, [(1, "a b c d e f g h i j k", "en")], 1)
    long = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4096) as text")

    def sizes(found):
        import pyarrow as pa

        for batch in found:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(BYTES)
        stage(spark, few, SF)
        assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) <= batches.BATCH + (1 << 16)
    spark.conf.unset(BYTES)


#: A worker's life in a process of its own: a task that leaves gaps between small arrays, as words and names do.
WORKER = """
import re
import numpy as np, pyarrow as pa
from ledgerweave.llm import batches
def own():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
kept = []
def run(found):
    for batch in found:
        many = [np.ones(2000 + k % 7) for k in range(8000)]
        kept.append(many[-1])
        del many
        yield batch
task = getattr(batches, "frugal", lambda f: f)(run)
before = own()
for batch in task(pa.RecordBatch.from_arrays([pa.array(np.arange(1 << 19))], names=["a"]) for _ in range(8)):
    pass
print("grown", own() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")
def test_workers_give_memory_back():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = subprocess.run([sys.executable, "-c", WORKER], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert float(re.search(r"grown (\S+)", made.stdout).group(1)) < 40
