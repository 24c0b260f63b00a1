"""Near duplicates of a whole table against all pairs, and rows that share an id."""

import numpy as np

from hexloom.llm import near_dedup


def by_hand(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 75 * (len(a) + len(b) - n):
                    parent[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def test_a_whole_table_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == by_hand(rows)


def test_chains_of_edits_with_repeated_ids(spark):
    """Texts drift apart edit by edit; ids repeat over different texts."""
    draw = np.random.default_rng(4)
    rows = []
    for group in range(6):
        text = [f"g{group}w{i}" for i in range(120)]
        for step in range(12):
            rows.append((group * 12 + step if step % 5 else group, " ".join(text)))
            text[int(draw.integers(0, 120))] = f"new{group}x{step}"
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == by_hand(rows)


def test_rows_with_texts_of_their_own_stay(spark):
    prose = " ".join(f"p{i}" for i in range(40))
    other = " ".join(f"q{i}" for i in range(40))
    rows = [(0, prose), (1, prose), (1, other), (2, prose + " tail"), (None, prose), (3, None), (3, ""), (4, "few words"), (5, "few words")]
    got = near_dedup.drop_near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, rep int")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(0, prose), (1, other), (None, prose), (3, None), (3, ""), (4, "few words")], key=str)
    assert near_dedup.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_screen_unrelated_sets():
    draw = np.random.default_rng(6)
    factor, shift = near_dedup._multipliers()
    limit = near_dedup._largest_difference(0.75)

    def differ(share):
        n = 400
        both = int(2 * n * share / (1 + share))
        base = draw.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        a, b = base[:n], np.concatenate([base[:both], base[n : 2 * n - both]])
        with np.errstate(over="ignore"):
            x, y = (near_dedup._odd_sketch(near_dedup._minima(s, factor, shift)) for s in (a, b))
        return int(np.unpackbits((x ^ y).view(np.uint8)).sum())

    assert all(differ(0.75) <= limit for _ in range(60))
    assert sum(differ(0.0) <= limit for _ in range(60)) == 0 and sum(differ(0.3) <= limit for _ in range(60)) <= 6


def test_a_large_bucket_of_loose_copies_never_becomes_a_row_per_pair(spark, monkeypatch):
    """Texts from one template, most at 0.5 to 0.7 to each other, a few linked in ways that the first meetings can miss."""
    draw = np.random.default_rng(11)
    rows = []
    for i in range(240):
        text = [f"t{k}" for k in range(150)]
        for k in draw.choice(150, 5 if i % 3 else 3, replace=False):
            text[k] = f"own{i}x{k}"
        rows.append((i, " ".join(text)))
    frames = {}
    settle = near_dedup.settle

    def recorded(df, name="stage"):
        out = settle(df, name)
        if out.columns == ["a", "b"]:
            frames[name] = max(frames.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "settle", recorded)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == by_hand(rows)
    assert frames and max(frames.values()) <= 4 * len(rows), frames


def test_units_join_what_blocks_of_members_ask_for(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "FIRST_BANDS", 0)
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    rows = []
    for group in range(2):
        text = [f"g{group}w{i}" for i in range(100)]
        for step in range(10):
            rows.append((group * 10 + step, " ".join(text)))
            text[9 * step + 5] = f"new{group}x{step}"
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == by_hand(rows)


def test_the_screen_drops_most_pairs_at_one_half():
    assert near_dedup._largest_difference(0.75) < 512 * (1 - np.exp(-2 * 384 * 2 * 0.45 / 1024)) + 1
