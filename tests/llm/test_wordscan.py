"""Word hashes depend on the word alone."""

import numpy as np

from tallyforge.llm import wordscan


def test_hashes_by_content():
    assert _is_inverse()
    words = [b"w%d" % (i % 977) for i in range(120_000)] + [b"y" * 70_000, b"w5", b"y" * 70_000]
    data = b" ".join(words)
    flags = np.array([b != 32 for b in range(256)])
    starts, ends = wordscan.spans(data, flags)
    got = wordscan.hashes(data, starts, ends)
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, got.tolist())) and len(set(seen.values())) == len(seen) == 978
    runs = wordscan.windows(got[:119_000], 3)
    assert len(set(runs.tolist())) == 977 and (runs[:977] == runs[977:1954]).all()


def _is_inverse():
    return (wordscan._POW[:1000] * wordscan._INVERSE[:1000] == 1).all() and wordscan._POW[1:].all()
