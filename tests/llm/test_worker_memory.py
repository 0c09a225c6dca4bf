"""What Python workers hold after a task, and how many of them a task needs."""

import re

import public_tokenizers
import pyarrow as pa

from tidemark.llm import byte_bpe, pii_sanitise


def test_waiting_workers_hold_no_pieces(spark):
    def pieces_held(batches):
        for _ in batches:
            pass
        loaded = list(byte_bpe._LOADED.values())
        yield pa.RecordBatch.from_pydict({"loaded": [len(loaded)], "held": [sum(x[0].keys.size for x in loaded)]})

    docs = spark.createDataFrame([(i, f"tide mark {i} of the harbour " * 20) for i in range(64)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.encode_documents(docs.repartition(4), path, public_tokenizers.PATTERN).collect()
    assert len(rows) == 64 and all(r.n_tokens > 0 for r in rows)
    seen = spark.range(64).repartition(16).mapInArrow(pieces_held, "loaded bigint, held bigint").collect()
    assert any(r.loaded for r in seen)
    assert all(r.held == 0 for r in seen)


def test_sanitise_runs_one_python_function_in_a_task(spark):
    rows = [(i, f"the berth of ada@harbour.org is quay{i % 3} and nothing else\n{i}") for i in range(12)]
    made = pii_sanitise.sanitise(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    above, functions = [], 0
    for line in plan.splitlines():
        node = re.search(r"[A-Za-z]\w*", line)
        if node is None:
            continue
        above = [x for x in above if x[0] < node.start()]
        own = [x[1] for x in above]
        own = own[max((i for i, x in enumerate(own) if "Exchange" in x), default=-1) + 1 :]
        name = re.search(r"MapInArrow|\w*Exchange", line)
        if name and name[0] == "MapInArrow":
            functions += 1
            assert "MapInArrow" not in own, plan
        above.append((node.start(), name[0] if name else node[0]))
    assert functions == 3
    assert made.count() == 13
