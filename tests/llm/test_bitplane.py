import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakeingest.llm import bitplane
from lakeingest.llm.tokens import public_tokenizer


class Held(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", (1, 8))
@pytest.mark.parametrize("n", (0, 1, 255, 256, 700, 2048))
def test_round_trip(bits, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50_000 if n % 2 else 1 << 32, n, dtype=np.uint32)
    out = Held()
    writer = bitplane.PlaneWriter(out, bits, 256)
    cuts = [0, n // 3, n // 3, n]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        writer.append(None if k == 1 else k, ids[a:b].tobytes())
    assert writer.close() == out.size()
    reader = bitplane.PlaneReader(out)
    assert np.array_equal(reader.ids(0, n), ids)
    if n > 300:
        assert np.array_equal(reader.ids(250, 20), ids[250:270])
    want = [(None if k == 1 else k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert list(reader.documents()) == want


def test_planes_of_zeros_take_no_bytes():
    out = Held()
    writer = bitplane.PlaneWriter(out, 8, 256)
    writer.append(1, np.full(512, 7, np.uint32).tobytes())
    writer.close()
    assert (bitplane.PlaneReader(out).sizes[:, 1:] == 0).all()
    with pytest.raises(ValueError):
        bitplane.PlaneReader(Held(b"something else, but long enough for a trailer of this kind of file"))
    with pytest.raises(ValueError):
        bitplane.PlaneWriter(Held(), 3)


@pytest.mark.parametrize("bits", (1, 8))
def test_files_of_hard_documents(spark, hard, bits):
    path = public_tokenizer("word_bpe_49k.json")
    got = [tuple(r) for r in bitplane.read(bitplane.write(hard, path, "word_end", bits=bits, block=512)).collect()]
    rows = sorted(((r["doc_id"], r["text"] or "") for r in hard.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    library = Tokenizer.from_file(path)
    for doc_id, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    key = lambda r: r[1]
    assert sorted(got, key=key) == want


def test_empty_table(nothing):
    assert bitplane.read(bitplane.write(nothing, public_tokenizer("word_bpe_49k.json"), "word_end")).collect() == []
