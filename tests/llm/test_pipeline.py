import subprocess
import sys
from pathlib import Path

import brute
from tokenizers import Tokenizer

import corpus_pipeline
from inkmill.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            assert after == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            assert after == {i for i, x in brute.exact(before.items()).items() if x[2]}
        elif name == "near_dedup":
            assert after == {i for i, x in brute.jaccard(before.items()).items() if x[1] == i}
        elif name == "mixing":
            assert 0 < len(after) < len(before)
        else:
            library = Tokenizer.from_file(WORD_BPE)
            for r in docs.collect():
                assert r.token_ids == library.encode(before[r.doc_id], add_special_tokens=False).ids
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS


HELD = """
import numpy as np
from inkmill.llm.common import lean

def held():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) // 1024

def task(batches):
    blocks = [np.ones(7500) for _ in range(4000)]
    yield held()
    keep.append(np.ones(7500))

keep = []
(peak,) = lean(task)([])
print(peak - held())
"""


def test_workers_give_back_what_a_task_held():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) > 180
