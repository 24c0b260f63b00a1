"""Clustering and hard negatives against brute force, with small blocks so that many of them meet."""

import hashlib
import math

import numpy as np
import pytest

from hexloom.llm import clustering, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, number int, n int"


def vectors(draw, n, width, copies=0):
    rows = [(int(i), draw.standard_normal(width).round(2).astype("f4").tolist(), int(draw.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 4) for i in range(copies)]
    odd = [0.5] * width
    rows += [(5000, None, 1), (5001, odd[:-1] + [None], 1), (5002, odd[:-1] + [math.nan], 1), (5003, odd[:-1] + [-math.inf], 1)]
    rows += [(5100, odd, None), (None, odd, 1), (5200, odd[:-1], 1), (5300, odd[:-1], 2), (5400, [], 1), (5400, [], 2)]
    return rows + rows[:3]


@pytest.fixture(scope="module")
def wide():
    return vectors(np.random.default_rng(3), 400, 64, 60)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(parts)


def good(v, width=None):
    return v is not None and (width is None or len(v) == width) and all(x is not None and math.isfinite(x) for x in v)


def clustered_by_hand(rows):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v, _ in rows if good(v, 64)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:8]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(10):
        near = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (_, k) in zip(kept, near) if k == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    whole = [sum(d for d, k in near if k == c) for c in range(len(centres))]
    return sorted(((i, k, d, whole[k], sum(whole), digest[k]) for (i, _), (d, k) in zip(kept, near)), key=str)


@pytest.mark.parametrize("block", [37, 32768])
def test_clusters(spark, wide, block):
    got = sorted((tuple(r) for r in clustering.clusters(frame(spark, wide), block=block).collect()), key=str)
    assert got == clustered_by_hand(wide)


def test_few_and_no_vectors(spark, wide):
    got = sorted((tuple(r) for r in clustering.clusters(frame(spark, wide[:3])).collect()), key=str)
    assert got == clustered_by_hand(wide[:3])
    empty = spark.createDataFrame([], SCHEMA)
    assert clustering.clusters(empty).count() == 0 and hard_negatives.mine(empty, "{id} % 100 = 0").count() == 0
    with pytest.raises(Exception, match="64 bits"):
        clustering.clusters(frame(spark, [*wide[:3], (9, [1e9] * 64, 1)])).collect()


def test_dictionaries_lose_nothing():
    draw = np.random.default_rng(1)
    base = draw.integers(-300, 300, (50, 64))
    for matrix in (base, base[draw.integers(0, 50, 4000)], np.zeros((9, 64), int), base[:1], draw.integers(-3, 3, (4000, 64))):
        codes, words = clustering.encoded(matrix)
        assert (np.concatenate([w[c] for c, w in zip(codes, words)], axis=1) == matrix).all()
    codes, words = clustering.encoded(base[draw.integers(0, 50, 4000)])
    assert len(codes) == 1 and len(words[0]) <= 50  # Copies share one wide dictionary.


def mined_by_hand(rows, step):
    use = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and good(v)]
    out = []
    for a, lab, q in use:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, m) for i, m, v in use if i != a and len(v) == len(q))
        for p, positive, _ in [s for s in scored if s[2] == lab][:5]:
            inside = [s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a, positive, r, i, -p, -n) for r, (n, i, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, anchors, width", [(32768, 4096, 64), (23, 3, 64), (40, 5, 9)])
def test_hard_negatives(spark, block, anchors, width):
    rows = vectors(np.random.default_rng(8), 300, width, 40)
    got = hard_negatives.mine(frame(spark, rows), "{id} % 25 = 0", block=block, anchors=anchors).collect()
    assert sorted(tuple(r) for r in got) == mined_by_hand(rows, 25) and len(got) > 100


def test_scan_equals_sorting():
    """Random windows over random columns, with ties, zero components and windows that hold nothing."""
    draw = np.random.default_rng(5)
    for _ in range(200):
        n, width = int(draw.integers(1, 900)), int(draw.integers(1, 70))
        cells = draw.integers(-40, 40, (width, n)) * draw.integers(0, 2, (width, 1))
        q, k = draw.integers(-40, 40, width), int(draw.integers(1, 12))
        scores = q @ cells
        windows = [(b, *sorted(draw.integers(scores.min() - 5, scores.max() + 5, 2).tolist())) for b in range(3)]
        found = {b: (c, s) for b, c, s in hard_negatives.scan(cells, cells.min(axis=1), cells.max(axis=1), q, windows, k)}
        for b, lo, hi in windows:
            best = sorted((-int(s), i) for i, s in enumerate(scores) if lo <= s <= hi)[:k]
            c, s = found.get(b, ([], []))
            assert sorted((-int(x), int(i)) for i, x in zip(c, s))[:k] == best


def test_scan_reads_less_than_everything():
    """With skewed magnitudes a few dimensions decide nearly all candidates."""
    draw = np.random.default_rng(2)
    cells = (draw.standard_normal((64, 5000)) * 256 / (1 + np.arange(64)[:, None])).astype(np.int64)
    reads = []

    class Counting(np.ndarray):
        def __mul__(self, other):
            reads.append(len(self))
            return np.asarray(self) * other

    list(hard_negatives.scan(cells.view(Counting), cells.min(axis=1), cells.max(axis=1), np.asarray(cells[:, 7]), [(0, -(1 << 62), 1 << 62)], 5))
    assert sum(reads) < 0.5 * cells.size
