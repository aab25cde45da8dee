"""A tokenizing task encodes a chunk once, also where it meets as many as a file partition of 16 MB has."""

import numpy as np
import pyarrow as pa

from mesoflux.llm import packing, queries


def test_chunks_of_a_partition_are_encoded_once(monkeypatch):
    encoder, seen = packing.ChunkEncoder(queries.tokenizer_path()), []
    inner = encoder._encode_chunks
    monkeypatch.setattr(encoder, "_encode_chunks", lambda chunks: seen.append(len(chunks)) or inner(chunks))
    texts = [" ".join(f"w{k * 104_729 + j:09d}" for j in range(1000)) for k in range(240)]  # 2.4 million characters
    first = [encoder.encode(pa.array(texts[low : low + 80])) for low in (0, 80, 160)]
    again = [encoder.encode(pa.array(texts[low : low + 80])) for low in (0, 80, 160)]
    assert sum(seen) == len({w for t in texts for w in t.split()})
    for (ids, bounds), (ids2, bounds2) in zip(first, again, strict=True):
        assert np.array_equal(ids, ids2) and np.array_equal(bounds, bounds2)
    assert first[0][0][: first[0][1][1]].tolist() == [*encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids, packing.END_ID]
