"""Each operator on small inputs with hard cases, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexloom.llm import ann, language_id, near_dedup, packing, passages, quality, secrets, suffix_tree_lm, trie_bpe
from hexloom.llm.common import WordHashes, word_hashes, words
from hexloom.llm.components import components
from hexloom.llm.exact_dedup import drop_repeats, exact_groups
from hexloom.session import settle

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, maybe int, rep int, kept string"
PROSE = " ".join(f"word{i * i % 97} and{i % 13} the" for i in range(60))
ROWS = [
    (1, PROSE, "en"), (2, PROSE.upper(), "en"), (3, PROSE + " tail", "en"), (4, None, None), (5, "", "de"), (6, " \t\n", None),
    (7, "one two", "en"), (8, "One TWO", "en"), (8, "One TWO", "en"), (None, "lost id", "en"), (9, "ÄÖ ä Ä é " * 30, "de"),
    (10, "x" * 5000 + " end", None), (11, "password = abcdefghijklmnop <|endoftext|> 0123456789abcdef0", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls, blanks, repeats, a long word and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, 2, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, empty):
    got = Counter(tuple(r) for r in exact_groups(docs).collect())
    plain = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, _ in ROWS]
    expected = Counter()
    for i, t in plain:
        ids = [j for j, u in plain if u == t]
        keep = max([j for j in ids if j is not None], default=None)
        expected[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == expected
    assert exact_groups(empty).count() == 0
    assert drop_repeats(docs).columns == docs.columns


def test_repeats_go_by_id_and_text(spark):
    """A text of its own stays, though its id also stands on a text that repeats."""
    rows = [(1, "repeats"), (1, "of its own"), (2, "Repeats"), (3, "else"), (None, "repeats")]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["text"]) for r in got} - {(None, "repeats")} == {(1, "of its own"), (2, "Repeats"), (3, "else")}


def test_near_components(docs, empty):
    got = {r["doc_id"]: r for r in near_dedup.near_components(docs).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == got[3]["component_id"] == 1
    assert got[8]["component_id"] == 7 and not got[8]["kept"] and got[7]["n_shingles"] == 1
    assert got[4]["component_id"] == 4 and got[4]["n_shingles"] == 0 and got[6]["component_id"] == 6
    assert near_dedup.near_components(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_secret_spans(spark, docs, empty):
    got = {r["doc_id"]: r for r in secrets.secrets(docs).collect()}
    text = ROWS[-1][1]
    assert got[11]["n_assign"] == 1 and got[11]["n_hex"] == 1 and f"assign:0:{text.index(' <')}" in got[11]["spans"]
    assert got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.secrets(empty).count() == 0
    masked = {r["doc_id"]: r["text"] for r in secrets.mask(docs).collect()}
    assert masked[11] == "[SECRET] <|endoftext|> [SECRET]" and masked[4] is None and masked[1] == PROSE
    # A failing match uses up its text: the key inside it starts no match of its own.
    frame = spark.createDataFrame([(1, "é password: token: longvalue12345678"), (2, "0123456789abcdef " * 700)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.secrets(frame).collect()}
    assert got[1]["n_assign"] == 0 and got[2]["n_hex"] == 700 and got[2]["spans"].split(",")[-1] == "hex:11883:11899"


ALPHABETS = {
    "hex": "0123456789abcdef", "upper_hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower_base32": "abcdefghijklmnopqrstuvwxyz234567",
    "upper_base36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "lower_base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "lower_url": "abcdefghijklmnopqrstuvwxyz0123456789-_", "upper_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def test_random_tokens_of_every_alphabet(spark):
    """Hardly any uniformly random token has structure, and one planted in prose for each alphabet and length is found."""
    rng = np.random.default_rng(5)
    sizes = (16, 20, 24, 32, 48, 64, 128)
    draw = lambda symbols, n: "".join(symbols[i] for i in rng.integers(0, len(symbols), n))
    uuid = lambda: re.sub("(.{8})(.{4})(.{4})(.{4})(.{12})", r"\1-\2-\3-\4-\5", draw(ALPHABETS["hex"], 32))
    rows = [(f"{name} {n}", draw(symbols, n)) for name, symbols in ALPHABETS.items() for n in sizes for _ in range(20)]
    rows += [("uuid 36", uuid()) for _ in range(20)]
    tokens = spark.createDataFrame([(i, 0, len(w), w, kind) for i, (kind, w) in enumerate(rows)], "row long, start int, end int, w string, kind string").repartition(4)
    usable = Counter(kind for kind, w in rows if re.search("[0-9]", w) and re.search("[A-Za-z]", w))
    tested = secrets._measured(tokens.drop("kind")).filter("encoding != 'text'")
    tested = settle(tested, "tested")
    passed = {r["kind"]: r["n"] for r in tested.filter(f"deviate <= {secrets.STRUCTURE}").join(tokens.select("row", "kind"), "row").groupBy("kind").agg(F.expr("count(1) AS n")).collect()}
    for kind, n in usable.items():
        assert passed.get(kind, 0) >= 0.9 * n, kind

    # Of each sort the token that changes most often between letters and digits, as few others differ from text when short.
    changes = lambda w: len(re.findall("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", w))
    planted = dict(sorted(rows, key=lambda r: changes(r[1])))
    plain = ["some-kebab-case-name-of-2024", "articles/about/the-first-10-things", "SOME_CONSTANT_NAME_NO_12", "internationalisation2"]
    texts = [*(f"before {w} behind" for w in planted.values()), *plain]
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    missed = [kind for i, (kind, w) in enumerate(planted.items()) if f"random:7:{7 + len(w)}" not in got[i]]
    assert not missed
    assert not any(got[i] for i in range(len(planted), len(texts)))


def test_suffix_tree(docs, empty):
    got = suffix_tree_lm.score(docs).collect()
    tokens = {i: (t or "").encode().lower().split() for i, t, _ in ROWS}
    learnt = [(t or "").encode().lower().split() for i, t, _ in ROWS if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    counts = Counter(w for t in learnt for w in t)
    n, v = sum(counts.values()) + len(learnt), len(counts) + 1
    assert len(got) == len(ROWS)
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(learnt) + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n and r["score"] < 0
        assert r["n_known"] == sum(counts[w] > 0 for w in own) + 1
    assert suffix_tree_lm.score(empty).count() == 0


def grown_by_hand(texts, root):
    """log10 probability of a next word after a tuple of words, by the definition of the tree."""
    counts, totals = Counter(), Counter()
    for t in texts:
        whole = ["\0", *t, "\0"]
        for k in (1, 2):
            for i in range(len(whole) - k):
                counts[tuple(whole[i : i + k + 1])] += 1
                totals[tuple(whole[i : i + k])] += 1
    branches = {}
    for string, n in counts.items():
        if n >= suffix_tree_lm.LEAST:
            branches.setdefault(string[:-1], {})[string[-1]] = n

    def p(context, word):
        if not context:
            return root(word)
        own, total = branches.get(context, {}), totals[context]
        if own:
            s, less = sum(own.values()), {w: p(context[1:], w) for w in own}
            g = sum(n * math.log(n / total / less[w]) for w, n in own.items())
            if total > s:
                g += (total - s) * math.log((total - s) / total / max(1 - sum(less.values()), 1e-12))
            if 2 * g > len(own) + suffix_tree_lm.DEVIATIONS * math.sqrt(2 * len(own)):
                rest = total - s + len(own)
                return (own.get(word, 0) + rest * p(context[1:], word)) / (total + len(own))
        return p(context[1:], word)

    return p


@pytest.mark.parametrize("most, hot", [(10**6, 2e-6), (20, 0.04), (0, 2.0)])
def test_suffix_tree_against_the_definition(spark, monkeypatch, most, hot):
    """Whether values are broadcast, joined or both; texts with repeats, of which a seventh isn't learnt."""
    monkeypatch.setattr(suffix_tree_lm, "MOST", most)
    monkeypatch.setattr(suffix_tree_lm, "HOT", hot)
    draw = np.random.default_rng(5)
    texts = {i: " ".join(f"w{min(int(z), 40)}" for z in draw.zipf(1.4, int(draw.integers(0, 30)))) for i in range(150)}
    texts |= {200 + i: "a fixed phrase that comes again" for i in range(12)}
    learnt = [t.split() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learnt for w in [*t, "\0"])
    size = sum(counts.values()) + len(counts) + 1
    p = grown_by_hand(learnt, lambda w: (counts[w] + 1) / size)
    rows = suffix_tree_lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        whole = ["\0", *texts[r["doc_id"]].split(), "\0"]
        expected = sum(math.log10(p(tuple(whole[max(i - 2, 0) : i]), whole[i])) for i in range(1, len(whole)))
        assert r["score"] == pytest.approx(expected)
    for context in [("\0",), ("w1",), ("w1", "w2"), ("a", "fixed"), ("nothing",)]:
        assert sum(p(context, w) for w in [*counts, "unseen"]) == pytest.approx(1)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_suffix_tree_looks_strings_up_in_the_order_of_the_table(monkeypatch):
    """Searched in the order of the text, every string read far parts of a table of two million rows anew."""
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda table, keys: asked.append(keys) or search(table, keys))
    strings = np.array([70, 10, 90, 30, 70, 50, 20], np.uint64)
    table = np.array([10, 30, 60, 70], np.uint64)
    inside, at, found = suffix_tree_lm._looked_up(table, strings, np.array([0, 2, 3, 4, 6]))
    assert (np.diff(asked[0].astype(int)) >= 0).all()
    assert sorted(inside.tolist()) == [0, 2, 3, 4, 6] and set(inside[found].tolist()) == {0, 3, 4}
    assert (table[at[found]] == strings[inside[found]]).all()
    inside, at, found = suffix_tree_lm._looked_up(table[:0], strings, np.array([1, 5]))
    assert len(inside) == len(at) == 2 and not found.any()


def test_suffix_tree_keeps_long_contexts(spark):
    """Only the word three places back tells what comes: a context of two words can't."""
    texts = {i: f"{'xy'[i % 2]} middle of {'pq'[i % 2]}" for i in range(200)}
    texts |= {1000 + i: f"{'vw'[i % 2]} three {'rs'[i % 2]}" for i in range(200)}
    wrong = {i: f"{'yx'[i % 2]} middle of {'pq'[i % 2]}" for i in range(200)}
    both = spark.createDataFrame([*texts.items(), *((3000 + i, t) for i, t in wrong.items() if i < 10 and zlib.crc32(str(3000 + i).encode()) % 7 == 2)], "doc_id long, text string")
    mixed = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(both, depth=None).collect()}
    assert len(mixed) > len(texts) and all(mixed[i] < mixed[0] - 1 for i in mixed if i >= 3000)


def test_suffix_tree_ends_with_long_repeats(spark):
    """A passage of 300 words on many texts, and periodic ones, don't make the tree as deep as they are long."""
    passage = " ".join(f"p{i * i % 1009}" for i in range(300))
    texts = {i: f"own{i} {passage} end{i}" for i in range(40)} | {100 + i: "round and round " * (10 + i) for i in range(30)}
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    deep = {r["doc_id"]: (r["score"], r["base_score"]) for r in suffix_tree_lm.score(frame, depth=None).collect()}
    assert len(deep) == len(texts) and all(s > b for s, b in deep.values())


def test_hashes_of_long_strings_depend_on_every_word():
    draw = np.random.default_rng(3).integers(0, 1 << 64, 4000, dtype=np.uint64)
    for length in (3, 4, 5, 9, 17, 24):
        for place in range(length):
            x = np.repeat(draw[:length][None], 2000, axis=0)
            x[:, place] = draw[2000:]
            for k in range(2, length + 1):
                x = suffix_tree_lm._longer(x[:, :-1], x[:, 1:], k)
            assert len(np.unique(x)) == 2000, (length, place)


def test_trie_bpe_against_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    for r in trie_bpe.round_trip(docs.filter("doc_id != 8"), VOCABULARY).collect():
        text = {i: t for i, t, _ in ROWS}[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert trie_bpe.round_trip(empty, VOCABULARY).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs.filter("doc_id IS NOT NULL AND doc_id != 8"), VOCABULARY).collect()
    of, at = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in (*of.values(), *at.values()):
        end = 0
        for piece in sorted(pieces):
            assert piece[0] == end
            end += piece[1]
    assert all(sum(n for _, n in p) <= 1024 for p in at.values())
    assert all(sum(p[1] for p in pieces) == pieces[0][2] for pieces in of.values()) and of[4] == [(0, 1, 1)]
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_differencing_is_nearly_equal():
    sizes = np.random.default_rng(3).integers(1, 256, 900).tolist()
    windows = packing.balance(sizes)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(900)) and max(sums) <= 1024
    assert max(sums) - min(sums) <= 8


def test_passages(spark, docs, empty):
    draw = np.random.default_rng(5)
    shared = " ".join(f"s{i}" for i in draw.integers(0, 10**6, 60))
    rows = [(i, " ".join(f"w{k}" for k in draw.integers(0, 10**6, 80)) + f" {shared} " + f"z{i} y{i} x{i}") for i in range(12)]
    rows += [(100 + i, " ".join(f"c{k}" for k in draw.integers(0, 10**6, 200))) for i in range(12)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(12)) and all((r["start_word"], r["end_word"]) == (80, 140) for r in got)
    assert passages.repeated_passages(empty).count() == 0
    assert {1, 2, 3} <= {r["doc_id"] for r in passages.repeated_passages(docs).collect()}


def test_words_are_hashed_side_by_side():
    """One Python object a word was half of the time of a pass over the texts."""
    texts = ["", "  A b ", None, " ", "a\tb\nc\x0bd\x0ce\rf", "x\x1cy\x1fv", "É\x85é\xa0Ü k", "\x00a \x00", "ÄB cD"]
    texts += ["x" * n + " " + "yÖZ" * n for n in range(40)] + [f"a{chr(i)}b{chr(i)}" for i in range(300)]
    whole = pa.array(texts * 3)
    for column in (whole, whole[5:60], whole[:0], pa.array([None, ""], pa.string())):
        got, want = list(word_hashes(column)), [WordHashes().of(words(t)) for t in column.to_pylist()]
        assert len(got) == len(want) and all(np.array_equal(g, w) for g, w in zip(got, want))


def test_passages_are_aligned_without_a_grid_of_distances(monkeypatch):
    """Every pair compared all its places under all distances."""
    plain, rng = passages._aligned, np.random.default_rng(9)
    monkeypatch.setattr(passages, "_aligned", None)
    found = 0
    for k in range(400):
        a = rng.integers(0, 1 << 62, rng.integers(30, 200))
        a[rng.integers(0, len(a), k % 9)] = a[0]
        b = np.insert(a, rng.integers(0, len(a), k % 7), rng.integers(0, 1 << 62, k % 7))
        b[rng.integers(0, len(b), k % 5)] = 7
        first, last = sorted(rng.integers(-30, 40, 2).tolist())
        want = passages._similar(*plain(a, b, first, last)) if np.isin(a, b).sum() >= passages.EQUAL else []
        assert passages._stretches(a, b, first, last) == want
        found += bool(want)
    assert 100 < found < 400
    monkeypatch.setattr(passages, "_aligned", plain)
    one = np.full(300, 5)
    assert passages._stretches(one, one[:250], -20, 20) == passages._similar(*plain(one, one[:250], -20, 20)) != []


def test_passages_with_inserted_and_deleted_words(spark):
    """Sides that are too short to be passages of their own still make one."""
    rng = np.random.default_rng(11)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    rows, kinds = [], ("inserted", "deleted", "five inserted")
    for k, kind in enumerate(kinds * 4):
        own = draw(70 if kind == kinds[2] else 60)
        half = len(own) // 2
        other = own[:half] + (own[half + 1 :] if kind == kinds[1] else draw(5 if kind == kinds[2] else 1) + own[half:])
        rows += [(2 * k, " ".join(draw(80) + own + draw(80))), (2 * k + 1, " ".join(draw(33) + other + draw(90)))]
    got = {(r["doc_id"], r["with_doc"]): r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, kind in enumerate(kinds * 4):
        size = 70 if kind == kinds[2] else 60
        r, back = got[2 * k, 2 * k + 1], got[2 * k + 1, 2 * k]
        assert (r["start_word"], r["end_word"], r["with_start"]) == (80, 80 + size, 33), kind
        assert back["end_word"] - back["start_word"] == size + (1, -1, 5)[k % 3] and back["with_start"] == 80
    assert len(got) == len(rows)


def test_passages_with_a_phrase_that_many_share(spark):
    """Pairs with a passage of their own around a phrase of all are found whole, though neither is the phrase's first or last document."""
    rng = np.random.default_rng(23)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    phrase, rows = draw(60), []
    for k in range(8):
        before, after = draw(60), draw(60)
        rows += [(i, " ".join(draw(20) + before + phrase + after + draw(20))) for i in (k, 100 + k)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {(r["doc_id"], r["with_doc"]) for r in got if (r["start_word"], r["end_word"]) == (20, 200)}
    assert whole == {pair for k in range(8) for pair in ((k, 100 + k), (100 + k, k))}


def test_language(spark, docs, empty):
    got = {r["doc_id"]: r for r in language_id.languages(docs).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == "und" and got[4]["score"] == 0
    assert got[9]["lang_pred"] == "de" and got[1]["lang_pred"] == "en"
    assert language_id.languages(empty).count() == 0


def test_language_held_out(spark, sf):
    table = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    found = language_id.languages(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count()


def test_language_rejects_what_it_never_learnt(spark):
    """Foreign and garbage texts go; nearly all held-out ones stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(language_id.split(table))
    draw = np.random.default_rng(9)
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Все люди рождаются свободными и равными в своём достоинстве и правах.",
        *("".join(draw.choice([*"bcdfghjklmnpqrstvwxz "], n)) for n in (100, 300, 1000)),
    ]
    got = language_id.identify(spark.createDataFrame([*enumerate(strange)], "doc_id long, text string"), model).select("doc_id", "language.*").collect()
    assert [r["doc_id"] for r in got if not r["rejected"]] == []
    held = language_id.identify(table, model).filter("crc32(string(doc_id)) % 3 = 1 AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    gone = held.selectExpr("avg(int(language.rejected))").first()[0]
    assert gone < 0.02


def test_quality_held_out(spark, sf, docs):
    folder = sf.replace("0.001", "0.01")
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    found = quality.qualities(table, labels.selectExpr("doc_id", "quality AS label"))
    assert found.count() == table.count() and found.filter("score < 0 OR score > 1").count() == 0
    held = found.join(labels, "doc_id").filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.9 * held.count()
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality.qualities(docs, none).collect()} == {0.5}


def test_nearest(spark):
    draw = np.random.default_rng(9)
    vectors = draw.standard_normal((300, 8)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0]) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0]), (2004, [None] * 8)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rep int")
    got: dict = {}
    for r in ann.nearest(frame, "{id} % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v in rows[:340]}
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        near = sorted(((-round(float(good[q] @ v), 9), i) for i, v in good.items() if i != q))[:20]
        assert [i for i, _ in found] == [i for _, i in near]
    assert ann.nearest(frame.limit(0), "{id} % 20 = 0").count() == 0


@pytest.mark.parametrize("block", [16_384, 300])
def test_nearest_opens_part_of_the_forest(spark, monkeypatch, block):
    """Rounds and blocks give exactly the best of all opened leaves; on clusters these are few and hold the nearest."""
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERIES", 16_384 if block > 300 else 20)
    draw = np.random.default_rng(5)
    vectors = (draw.standard_normal((40, 16))[draw.integers(0, 40, 6000)] + 0.2 * draw.standard_normal((6000, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest(frame, "{id} % 100 = 0", share=0.03).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    exact = vectors.astype(float)
    forest = ann.Forest.fit(exact, len(exact))
    leaves, count = forest.leaves(exact), max(4 * ann.TREES, int(0.03 * ann.TREES * 2**forest.depth))
    found, scored = 0, 0
    assert set(got) == set(range(0, 6000, 100))
    for q, ids in got.items():
        scores = exact @ exact[q]
        opened = np.isin(leaves, forest.probes(exact[q], count)).any(1)
        scored += opened.sum()
        for some in (opened, np.ones(6000, bool)):
            best = [int(i) for i in np.lexsort((np.arange(6000), -scores)) if some[i] and i != q][:20]
            if some is opened:
                assert ids == best
        found += len(set(ids) & set(best))
    assert found >= 0.9 * 20 * len(got) and scored < 0.5 * 6000 * len(got)


def test_passages_among_many_around_a_shorter_phrase(spark):
    """Pairs are found though all their windows lie in a phrase of all documents that is too short to be a passage."""
    rng = np.random.default_rng(70)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    phrase, rows = draw(40), []
    for k in range(40):
        before, after = draw(7), draw(7)
        rows += [(i, " ".join(draw(60) + before + phrase + after + draw(60))) for i in (k, 100 + k)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["with_doc"]) for r in got if r["equal_share"] == 1} >= {pair for k in range(40) for pair in ((k, 100 + k), (100 + k, k))}


def test_passages_against_all_pairs(spark):
    """Near copies of a few passages, every one with other words changed: following partners leads to all that are similar."""
    rng = np.random.default_rng(37)
    rows, texts = [], {}
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(80)]
        for k in range(12):
            own = [f"n{group}x{k}y{i}" if i in set(rng.choice(80, 2).tolist()) else w for i, w in enumerate(base)]
            texts[100 * group + k] = own
            rows.append((100 * group + k, " ".join([f"a{group}b{k}c{i}" for i in range(50)] + own + [f"d{group}e{k}f{i}" for i in range(50)])))
    sets = {i: {tuple(t[j : j + 5]) for j in range(76)} for i, t in texts.items()}
    found: dict = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], set()).add(r["with_doc"])

    def reached(i):
        seen, new = {i}, [i]
        while new:
            new = [j for j in {o for n in new for o in found.get(n, ())} if j not in seen]
            seen.update(new)
        return seen

    similar = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])]
    assert len(similar) > 50 and all(j in reached(i) for i, j in similar)


def test_three_copies_are_linked_with_the_first_and_the_last(spark):
    text = " ".join(f"w{i}" for i in range(90))
    got = passages.repeated_passages(spark.createDataFrame([(i, text) for i in (3, 5, 8)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["with_doc"]) for r in got} == {(a, b) for a in (3, 5, 8) for b in (3, 5, 8) if a != b}
    assert all((r["start_word"], r["end_word"], r["equal_share"]) == (0, 90, 1) for r in got)
