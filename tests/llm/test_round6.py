import ast
import subprocess
import sys

import numpy as np
import pyarrow as pa

from lectern.llm import ctw

SCORED = """
import sys
import pyarrow as pa
from lectern.llm import ctw

texts, values = (pa.ipc.open_stream(bytes.fromhex(x)).read_all() for x in sys.argv[1:])
print(ctw._scored(pa.int64(), 6, 3)(texts, values).to_pylist())
"""


def _sent(t):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes().hex()


def test_scores_in_a_worker_that_has_done_nothing_else():
    """Spark ends workers that idle for a minute, as they do on large tables; the last step's may have run no other step."""
    some = ctw.Texts([b"ab a"])
    codes, words = (np.unique(c).view(np.int64) for c in (next(some.codes())[1], some.words()[1]))
    kind, value = np.repeat([0, 1], [len(codes), len(words)]), np.repeat([-0.5, 2.0], [len(codes), len(words)])
    values = pa.table({"kind": pa.array(kind, pa.int8()), "code": np.r_[codes, words], "value": value})
    texts = pa.table({"texts": [ctw.packed(pa.RecordBatch.from_pydict({"key": [7], "held_out": [False], "body": [b"ab a"]}))]})
    out = subprocess.run([sys.executable, "-c", SCORED, _sent(texts), _sent(values)], check=True, timeout=120, capture_output=True, text=True).stdout
    assert [(x["key"], x["n_tokens"], x["n_known"], x["score"]) for x in ast.literal_eval(out)] == [(7, 3, 3, -2.5)]
