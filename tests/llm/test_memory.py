"""What a Python worker holds at once is bounded by bytes, not by rows."""

import numpy as np
import pyarrow as pa
from public_tokenizers import path as vocabulary_path

from folioflow.llm import coding, common, packing


def test_packing_reads_a_batch_in_pieces(spark, monkeypatch):
    class Source:
        def mapInArrow(self, run, schema):
            return run

    sizes = []
    ids = coding.WordIds.ids
    monkeypatch.setattr(coding.WordIds, "ids", lambda self, some: sizes.append(sum(map(len, some))) or ids(self, some))
    monkeypatch.setattr(packing, "texts", lambda df: Source())
    monkeypatch.setattr(packing, "READ_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(["some words " * 30] * 40)], names=["doc_id", "text"])
    run = packing.pieces(None, vocabulary_path("word_bpe_49k.json"))
    found = pa.Table.from_batches(run(iter([batch])))
    assert max(sizes) <= 1000
    assert found["doc_id"].to_pylist() == list(range(40)) and len(set(found["ids_crc32"].to_pylist())) == 1


def test_powers_are_kept_once(monkeypatch):
    monkeypatch.setattr(common, "_kept", [])
    small = common.powers(70_000)
    large = common.powers(300_000)
    again = common.powers(70_000)
    assert again[0].base is large[0] or again[0].base is large[0].base
    assert all(np.array_equal(a, b) for a, b in zip(small, again, strict=True))
    assert len(common._kept) == 2 and len(common._kept[0]) == len(large[0])
