"""Python memory of row-wise operators is that of a slice, not of a batch."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from reviewlake.operators import chunking


def test_chunking_holds_a_slice_of_a_batch():
    texts = pa.array([f"def f{k}():\n" + "    x = 1\n" * 800 for k in range(4000)])
    tracemalloc.start()
    out = chunking._sliced(chunking.units, pa.list_(pa.string()), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4000 and peak < 8 << 20 < texts.nbytes
