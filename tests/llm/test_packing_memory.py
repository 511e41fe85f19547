from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
from millrace.llm import packing
from millrace.llm.queries import BYTES


def test_a_worker_holds_small_blocks(monkeypatch):
    """A large batch is encoded and handed on in parts: with 8 MB of text at once this held over 100 MB."""
    held: dict = {}
    monkeypatch.setattr(packing, "doc_text", lambda df: SimpleNamespace(mapInArrow=lambda f, schema: held.update(f=f)))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing.pack_sequences(None, BYTES, 1)
    text = " ".join(f"{i % 97} of {i % 89}" for i in range(250))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": [text] * 5000})
    tokens = most = 0
    tracemalloc.start()
    for b in held["f"](iter([batch])):
        tokens += sum(b["length"].to_pylist())
        most = max(most, b.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = packing.encoder(BYTES).tokenizer.encode(text, add_special_tokens=False)
    assert tokens == 5000 * (len(one.ids) + 1)
    assert peak < 60 << 20, peak
