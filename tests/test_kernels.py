import random

import numpy as np
import pytest

from helixframe.functions import kernels as K


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def number(word):
    n = 0
    for c in word:
        n = n * 4 + "ACGT".index(c)
    return n


def naive(texts, k, step):
    out = []
    for t, s in enumerate(texts):
        s = s.upper().replace("U", "T")
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT") and (i % step == 0 or i == len(s) - k):
                out.append((t, i, number(min(w, rc(w)))))
    return out


@pytest.mark.parametrize("k", [1, 2, 7, 15, 16, 21, 30, 31, 32, 33, 64, 65])
@pytest.mark.parametrize("step", [1, 3, 4])
def test_canonical_kmers_equal_naive_windows(k, step):
    rng = random.Random(k * 10 + step)
    texts = ["".join(rng.choice("ACGTACGTACGTacgtUuN") for _ in range(rng.choice([0, 1, k - 1, k, k + 1, 90]))) for _ in range(40)]
    found = K.canonical([t.encode() for t in texts], k, step)
    found = [(t, i, number(w.decode()) if k > 31 else w) for t, i, w in zip(*(x.tolist() for x in found), strict=True)]
    assert found == naive(texts, k, step)


def test_strands_share_kmers():
    text = "ACGTTGCAACCGGTTAACGATCGATCGGCTAGCTAACG"
    one, two = (np.sort(K.canonical([x.encode()], 11)[2]) for x in (text, rc(text)))
    assert np.array_equal(one, two)


def test_k_out_of_range_is_an_error():
    with pytest.raises(ValueError):
        K.kmers(K.CODES[np.frombuffer(b"ACGT", np.uint8)], 32)
    with pytest.raises(ValueError):
        K.canonical([b"ACGT"], 256)


def test_fnv_and_edit_distance():
    assert K.fnv1a(b"") == 0xCBF29CE484222325 and K.fnv1a(b"a") == 0xAF63DC4C8601EC8C

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 12))) for _ in range(2))
        d = full(a, b)
        for most in (0, 1, 3):
            assert K.edit_distance_within(a, b, most) == (d if d <= most else None)


def test_window_minima():
    r = random.Random(5)
    for _ in range(200):
        w, rows = r.randint(1, 12), [[r.randint(0, 30) for _ in range(r.choice([0, 0, 1, 3, 9, 10, 11, 40]))] for _ in range(r.randint(0, 6))]
        number = np.repeat(np.arange(len(rows)), [len(x) for x in rows]).astype(np.int64)
        of, low = K.window_minima(number, np.array([v for x in rows for v in x], np.int64), w)
        for i, x in enumerate(rows):
            assert set(low[of == i].tolist()) == {min(x[j : j + w]) for j in range(max(len(x) - w, 0) + 1)} if x else not (of == i).any()


def test_window_minima_take_few_comparisons(monkeypatch):
    """Eight and ten wide windows take three and four comparisons of all values, not as many as they are wide."""
    calls, own = [], np.minimum

    class Counted:
        reduceat = own.reduceat

        def __call__(self, a, b):
            calls.append(len(a))
            return own(a, b)

    monkeypatch.setattr(np, "minimum", Counted())
    K.window_minima(np.zeros(1000, np.int64), np.arange(1000), 10)
    assert len(calls) == 4
