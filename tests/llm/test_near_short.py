"""Near copies of few shingles: every pair with one common key is verified, and short texts have more keys."""

from math import comb

import numpy as np

from common_cases import collected, frame
from sievemark.llm import op4_near


def test_keys_of_short_texts():
    single = op4_near.single_keys(16, 3, 0.8)
    assert single[5] > 0 and single[-1] == 0 and sorted(single, reverse=True) == single
    for a in range(4, 200):
        for b in range(4, a + 1):
            common = next(x for x in range(a + b + 1) if 5 * x >= 4 * (a + b - x))
            if common <= b and not common == a == b:
                missed = (1 - comb(common, 3) / comb(a + b - common, 3)) ** 16 * 0.2 ** single[a]
                assert missed <= 2 * (1 - 0.8**3) ** 16 * 1.0001, (a, b)


def test_pairs_of_one_key(spark):
    """Pairs of five and four shingles at 0.8 that share just one key, or none but a further one, are linked."""
    np.seterr(over="ignore")
    rows, k = [], 0
    while len(rows) < 24:
        words = [f"w{k}x{i}" for i in range(9)]
        texts = " ".join(words), " ".join(words[:8])
        first, second = (set(op4_near.sketch(op4_near.labelled_shingles(t.encode(), 5), 16, 3)) for t in texts)
        if len(first & second) == 1 or not first & second:
            rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        k += 1
    found = {r["doc_id"]: r["class_id"] for r in collected(op4_near.near_classes(frame(spark, rows)))}
    assert found == {i: i - i % 2 for i, _ in rows}
