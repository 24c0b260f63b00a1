"""Quality rules against a plain rewrite: counts, proposals, exact bounds and verdicts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from hexloom.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, lang string, steps int, stratum string, w string"


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
        "n_marks": len(re.findall("[!?]", text)), "n_capitals": len(re.findall("[A-Z]", text)),
        "n_digits": len(re.findall("[0-9]", text)), "n_lines": len(lines),
    }


def plain_steps(c):
    both = (
        (c["n_symbols"], c["n_words"]), (c["n_marks"], c["n_words"]), (c["n_capitals"], c["word_chars"]),
        (c["n_digits"], c["word_chars"]), (c["n_dup_lines"], c["n_lines"]), (c["n_repeat_words"], c["n_words"]),
        (c["word_chars"], 32 * c["n_words"]), (max(8 * c["n_words"] - c["word_chars"], 0), 8 * c["n_words"]),
    )
    return [min(63, 64 * a // b) if b else 0 for a, b in both]


def at_most(k, n, share):
    return math.fsum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))


def plain_verdicts(rows, labels, risk, error):
    """(id, stratum, base_failed, steps) rows and labels to (id, kept, level)."""
    good = defaultdict(bool)
    for i, label in labels:
        if label is not None:
            good[i] |= label == 1
    observed = {}
    for i, text, stratum, counts, steps in rows:
        if not counts["base_failed"] and i in good:
            key = stratum, hashlib.md5((text or "").encode()).hexdigest()
            observed[key] = (observed.get(key, (False,))[0] or good[i], steps)
    learn, hold = defaultdict(list), defaultdict(list)
    for (stratum, digest), seen in observed.items():
        (hold if int(digest[:4], 16) % 2 else learn)[stratum].append(seen)
    cuts = {}
    for stratum, seen in learn.items():
        levels, found = [], False
        for share in qr.TOLERANCES:
            cut = []
            for r in range(len(qr.RULES)):
                # A rule speaks from a step some learning text has; its all_good counts every good text.
                steps = {s[r] for _, s in seen if s[r] > 0}
                fits = []
                for c in steps:
                    g, b = sum(x and s[r] >= c for x, s in seen), sum(not x and s[r] >= c for x, s in seen)
                    if b > 0 and b >= g:
                        found = True
                        if g <= share * sum(x for x, _ in seen):
                            fits.append(c)
                cut.append(min(fits, default=qr.STEPS))
            levels.append(cut)
        if found:
            cuts[stratum] = levels
    tested = {s: [x for x in hold[s] if x[0]] for s in cuts}
    tested = {s: x for s, x in tested.items() if x}
    level = {}
    for stratum, seen in tested.items():
        for j, cut in enumerate(cuts[stratum]):
            k = sum(any(a >= b for a, b in zip(s, cut)) for _, s in seen)
            if k > len(seen) * risk or at_most(k, len(seen), risk) > error / len(tested):
                break
            level[stratum] = j + 1
    out = {}
    for i, _, stratum, counts, steps in rows:
        cut = cuts[stratum][level[stratum] - 1] if stratum in level else [qr.STEPS] * len(qr.RULES)
        out[i] = (not counts["base_failed"] and not any(a >= b for a, b in zip(steps, cut)), level.get(stratum, 0))
    return out


def compare(spark, docs, labels, risk, error):
    frame = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], SCHEMA)
    got = {r["doc_id"]: r for r in qr.judge(frame, spark.createDataFrame(labels, "doc_id long, label int"), risk=risk, error=error).collect()}
    rows = []
    for i, text, lang in docs:
        c = plain_counts(text)
        n = c["n_words"]
        rows.append((i, text, (lang or "", 0 if n < 200 else 1 if n < 800 else 2), c, plain_steps(c)))
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
            assert got[i][name] == c[name], (i, name)
    expected = plain_verdicts(rows, labels, risk, error)
    assert {i: (r["kept"], r["level"]) for i, r in got.items()} == expected
    return got


def test_hard_texts(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    texts = [None, "", " \t\n", "a b c", "a b c a b c", "a a a a a", "x\x0by\x0cz\rq r s", "same\n\nsame\n same\nsame \nsame", "é # $ü <|>" * 30,
             long, "y" * 300_000, "one two three " * 4000, "A\nB\nA\nB\n" * 100, "the of and " + long[:50_000] + " the of and"]
    docs = [(i, t, None if i % 3 else "en") for i, t in enumerate(texts)]
    compare(spark, docs, [(i, i % 2) for i in range(len(texts))] + [(0, None), (None, 1)], 0.02, 0.05)
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert qr.judge(empty, none).count() == 0
    twice = spark.createDataFrame([(1, "a", "en"), (1, "a b", None), (None, "c", "en"), (None, "c", "en")], "doc_id long, text string, lang string")
    assert sorted(r["n_words"] for r in qr.judge(twice, none).collect()) == [1, 1, 1, 2]


def test_verdicts_on_a_whole_table(spark, sf):
    """At a risk loose enough for the small tables to certify something."""
    folder = sf.replace("0.001", "0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()]
    got = compare(spark, docs, labels, 0.15, 0.2)
    assert max(r["level"] for r in got.values()) > 0
    quality = dict(labels)
    gone = Counter(quality[i] for i, r in got.items() if i in quality and not r["base_failed"] and not r["kept"])
    assert gone[0] > 0 and gone[1] <= 0.15 * sum(quality.values())


@pytest.mark.parametrize("n, share", [(1, 0.02), (30, 0.02), (400, 0.02), (5000, 0.01), (300, 0.3)])
def test_binomial_bounds_are_exact(spark, n, share):
    ks = sorted({0, 1, int(n * share / 2), int(n * share)})
    ks = [k for k in ks if k <= n * share]
    frame = spark.createDataFrame([(k, n) for k in ks], "k long, n long")
    for k, p in frame.selectExpr("k", f"{qr.binomial_at_most('k', 'n', share)} AS p").collect():
        assert p == pytest.approx(at_most(k, n, share), rel=1e-9)


def test_binomial_bounds_of_large_counts(spark):
    """A million draws: the complement of the tail, by a normal bound only, and no long fold."""
    p = spark.range(1).selectExpr(f"{qr.binomial_at_most('20000L', '1000000L', 0.02)} AS p").first()[0]
    assert p == pytest.approx(0.5, abs=0.01)


def test_clean_texts_stay_and_bad_ones_go(spark):
    """With enough labels bad texts go, while a stratum with few labels keeps everything."""
    text = lambda i, bad: " ".join(f"w{(i * 37 + k * k * 7 + k) % 5003}{'!!' if bad else ''}" for k in range(80))
    docs = [(i, text(i, i % 4 == 0), "en") for i in range(2400)] + [(9000 + i, text(9000 + i, i % 4 == 0), "fr") for i in range(40)]
    labels = [(i, int(i % 4 != 0)) for i in range(2000)] + [(9000 + i, int(i % 4 != 0)) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in qr.judge(frame, spark.createDataFrame(labels, "doc_id long, label int")).collect()}
    assert all(got[i]["kept"] == (i % 4 != 0) for i in range(2400))
    assert all(r["kept"] and r["level"] == 0 for i, r in got.items() if i >= 9000)
