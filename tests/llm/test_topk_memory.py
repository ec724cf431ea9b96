"""What a shard's build keeps in memory."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from stallkeeper.llm import topk_search


def test_build_keeps_different_words_only(monkeypatch):
    monkeypatch.setattr(topk_search, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = " ".join(f"w{i % 40}" for i in range(20_000))
    batches = pa.table({"id": list(range(60)), "text": [text] * 60}).to_batches(5)
    tracemalloc.start()
    (row,) = topk_search._build(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row.column("lengths")[0].as_py() == [20_000] * 60 and row.column("frequencies")[0].as_py() == [60] * 40
    assert row.column("postings")[0].as_py() == list(range(60)) * 40 and set(row.column("counts")[0].as_py()) == {500}
    assert peak < 30e6, peak
