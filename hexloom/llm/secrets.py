"""Secrets in whole texts, in SQL functions only.

Three patterns give the base spans. A battery of randomness tests adds spans of kind ``random``:

* candidates are runs of at least ``MIN_LENGTH`` characters of the base64 alphabets; each gets the
  smallest encoding that holds it (hex, base32 and base36 in either case, base62, base64 in two forms).
  In tokens of one case signs may part groups, as in a UUID, and are left out of the tests: what is left
  of a random token is random, too. Runs of letters alone are ordinary words; they aren't tested but
  show what text looks like;
* against randomness: a chi-squared test of even use of the encoding's alphabet, a runs test about
  its middle and a serial correlation test of the symbol numbers, summed into one deviate. A candidate
  that it rejects has structure and is no secret;
* against text: equal pairs of symbols are compared with their share in the words of the whole corpus,
  and changes between letters and digits with ``CHANGES``, into one p-value for "as irregular as this,
  were it text";
* Benjamini-Hochberg at level ``RATE`` then runs over all candidates of an encoding and length class
  at once, by counts per p-value step, so long tokens aren't judged by the errors of short ones.

Positions count code points, ends are exclusive. Defined cases: a null text is an empty one and has no
spans; repeated rows are scanned each for itself; an empty table gives an empty result; other columns
take no part. Positions are prefix sums in blocks, so a text with very many matches stays near linear.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import LOWER, UPPER, whole_text
from hexloom.session import settle

#: Fixed values of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LENGTH = 12

MIN_LENGTH = 16
CANDIDATE = f"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
RATE = 0.05
#: Share of neighbours in an ordinary identifier of which one is a letter and one a digit.
CHANGES = 0.1
#: Share of equal pairs in words where the corpus has no long word to count it in.
EQUAL_PAIRS = 0.065
#: A combined deviate above this has too much structure for a random token.
STRUCTURE = 3.5
#: P-values are counted in steps: 100 for each power of ten, down to 1e-30.
STEPS, DECADES = 100, 30
LENGTH_CLASSES = (20, 24, 32, 48, 64, 128)
BASE_KINDS = ("assign", "access", "hex")
MASK = "[SECRET]"


def _with_matches(df: DataFrame, text: str, pattern: str, into: str, likely: Column | None = None) -> DataFrame:
    """Adds the matches of a pattern as ``into`` and the text between them as ``into_gaps``."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn(into, found if likely is None else F.when(likely, found).otherwise(none))
    gaps = F.split(F.col(text), pattern, -1)
    return df.withColumn(f"{into}_gaps", F.when(F.size(into) > 0, gaps).otherwise(none))


def _with_spans(df: DataFrame, matches: str, into: str) -> DataFrame:
    """Adds (start, end) of each match: sums of what stands before it, within blocks and over blocks.

    Each step is a column of its own that the next one names at least twice, so that it is evaluated once
    per row and not once per element of a lambda.
    """
    keep = df.columns
    sums = "aggregate(slice({a}, 1, {n}), 0, (a, v) -> a + v)"
    return (
        df.selectExpr("*", f"zip_with(slice({matches}_gaps, 1, size({matches})), {matches}, (g, m) -> length(g) + length(m)) AS _lengths")
        .selectExpr(
            *keep,
            "if(size(_lengths) = 0, array(), transform(sequence(0, cast(floor((size(_lengths) - 1) / 256) as int)), b -> slice(_lengths, b * 256 + 1, 256))) AS _parts",
        )
        .selectExpr("*", "transform(_parts, p -> aggregate(p, 0, (a, v) -> a + v)) AS _totals")
        .selectExpr(
            *keep, f"flatten(zip_with(_parts, transform(_totals, (t, i) -> {sums.format(a='_totals', n='i')}), "
            f"(p, s) -> transform(p, (v, i) -> s + {sums.format(a='p', n='i')}))) AS _before",
        )
        .selectExpr(
            *keep, f"zip_with(zip_with(_before, slice({matches}_gaps, 1, size({matches})), (s, g) -> s + length(g)), {matches}, "
            f"(s, m) -> struct(s AS start, s + length(m) AS end)) AS {into}",
        )
    )


_LETTERS = UPPER + LOWER
#: Symbols of each encoding, numbered in this order.
_SYMBOLS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": UPPER + "234567",
    "lower_base32": LOWER + "234567",
    "upper_base36": UPPER + "0123456789",
    "lower_base36": LOWER + "0123456789",
    "base62": _LETTERS + "0123456789",
    "base64": _LETTERS + "0123456789+/",
    "url64": _LETTERS + "0123456789-_",
    "all": _LETTERS + "0123456789+/-_",
}


def _core(token: str) -> str:
    """What is tested of a token: all of it in mixed case, else what is left without signs, which may just part groups."""
    return f"if({token} RLIKE '[A-Z]' AND {token} RLIKE '[a-z]', {token}, translate({token}, '+/_-', ''))"


def _inferred(token: str, core: str) -> str:
    """Tightest encoding of a token; null for digits alone and for words with signs in between."""
    return f"""CASE WHEN {token} RLIKE '^[A-Za-z]+$' THEN 'text'
        WHEN NOT {token} RLIKE '[0-9]' OR NOT {token} RLIKE '[A-Za-z]' THEN NULL
        WHEN {core} RLIKE '^[0-9a-f]+$' THEN 'hex'
        WHEN {core} RLIKE '^[0-9A-F]+$' THEN 'upper_hex'
        WHEN {core} RLIKE '^[A-Z2-7]+$' THEN 'base32'
        WHEN {core} RLIKE '^[a-z2-7]+$' THEN 'lower_base32'
        WHEN {core} RLIKE '^[A-Z0-9]+$' THEN 'upper_base36'
        WHEN {core} RLIKE '^[a-z0-9]+$' THEN 'lower_base36'
        WHEN {core} RLIKE '^[A-Za-z0-9]+$' THEN 'base62'
        WHEN {core} RLIKE '^[A-Za-z0-9+/]+$' THEN 'base64'
        WHEN {core} RLIKE '^[A-Za-z0-9_-]+$' THEN 'url64' ELSE 'all' END"""


def _measured(tokens: DataFrame) -> DataFrame:
    """What the tests need of each candidate ``w``: size, equal pairs, changes of class, deviate from randomness."""
    letters = "CASE encoding " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SYMBOLS.items()) + " ELSE 'abcdefghijklmnopqrstuvwxyz' END"
    side = "signum(c[{i}] - (k - 1) / 2D)"
    runs = f"aggregate(sequence(1, n - 1), 1D, (a, i) -> a + if({side.format(i='i')} != {side.format(i='i - 1')}, 1, 0))"
    chi = "(((k * (2D * equal + n) / n - n) - (k - 1)) / sqrt(2D * (k - 1)))"
    return (
        tokens.withColumn("core", F.expr(_core("w")))
        .withColumn("encoding", F.expr(_inferred("w", "core")))
        .filter("encoding IS NOT NULL")
        .withColumn("letters", F.expr(letters))
        .withColumn("c", F.expr("transform(filter(split(if(encoding = 'text', lower(core), core), ''), x -> x != ''), x -> instr(letters, x) - 1)"))
        .withColumns({"n": F.size("c"), "k": F.length("letters")})
        .withColumn("equal", F.expr("(aggregate(array_distinct(c), 0D, (a, x) -> a + pow(size(filter(c, y -> y = x)), 2)) - n) / 2D"))
        .withColumn("mean", F.expr("aggregate(c, 0D, (a, x) -> a + x) / n"))
        .withColumn("energy", F.expr("aggregate(c, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
        .withColumn("serial", F.expr("aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (c[i] - mean) * (c[i - 1] - mean))"))
        .withColumn("runs", F.expr(f"(({'n'} + 1) / 2D - {runs}) / (sqrt(n - 1) / 2D)"))
        .selectExpr(
            "row", "start", "end", "encoding", "n", "equal",
            "size(split(w, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])', -1)) - 1 AS changes",
            f"({chi} + runs + abs(serial) / greatest(energy, 1e-9D) * sqrt(n)) / sqrt(3D) AS deviate",
            f"{_length_class('n')} AS class",
        )
    )


def _length_class(n: str) -> str:
    return "(" + " + ".join(f"cast({n} >= {edge} as int)" for edge in LENGTH_CLASSES) + ")"


def _found(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(row, doc_id, base, tokens): base spans (start, kind, end) and candidates (start, end, w) of each row."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), whole_text(text).alias("t"))
    df = _with_matches(df, "t", ASSIGN, "assign")
    df = _with_matches(df, "t", ACCESS, "access", F.col("t").contains("AKIA"))
    df = _with_matches(df, "t", HEX, "hex")
    df = _with_matches(df, "t", CANDIDATE, "token")
    for m in (*BASE_KINDS, "token"):
        df = _with_spans(df, m, f"{m}_at")
    long_enough = F.filter(
        F.zip_with("assign", "assign_at", lambda m, s: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LENGTH, s)),
        lambda s: s.isNotNull(),
    )
    df = df.withColumn("assign_at", long_enough)
    ranked = [f"transform({k}_at, s -> struct(s.start AS start, {i} AS kind, s.end AS end))" for i, k in enumerate(BASE_KINDS)]
    return df.selectExpr(
        "row", "doc_id", f"array_sort(concat({', '.join(ranked)})) AS base",
        "zip_with(token_at, token, (s, w) -> struct(s.start AS start, s.end AS end, w AS w)) AS tokens",
    )


def _stepped(tested: DataFrame, equal_pairs: float) -> DataFrame:
    """Adds the p-value step against text; 0 where a candidate's structure rules it out."""
    pairs, even = "(n * (n - 1) / 2D)", f"{equal_pairs!r}D"
    against = f"(({pairs} * {even} - equal) / sqrt(2D * {pairs} * {even}))"
    mixed = f"((changes - (n - 1) * {CHANGES}D) / sqrt((n - 1) * {CHANGES * (1 - CHANGES)}D))"
    # Half of exp(-z^2 / 2) is never below the normal tail beyond z.
    p = f"log10(2D) + z * z * {math.log10(math.e) / 2!r}D"
    return tested.withColumn("z", F.expr(f"greatest(({against} + {mixed}) / sqrt(2D), 0D)")).withColumn(
        "step", F.expr(f"if(deviate > {STRUCTURE}D, 0, cast(least(floor(({p}) * {STEPS}), {STEPS * DECADES}) as int))")
    )


def _cutoffs(stepped: DataFrame) -> DataFrame:
    """Smallest accepted step of each encoding and length class, from the counts of all candidates."""
    ranked = stepped.groupBy("encoding", "class", "step").agg(F.expr("count(1) AS n")).selectExpr(
        "encoding", "class", "step",
        "sum(n) OVER (PARTITION BY encoding, class) AS tests",
        "sum(n) OVER (PARTITION BY encoding, class ORDER BY step DESC ROWS UNBOUNDED PRECEDING) AS rank",
    )
    passed = ranked.filter(f"step > 0 AND tests * pow(10D, -step / {STEPS}D) <= {RATE} * rank")
    return passed.groupBy("encoding", "class").agg(F.min("step").alias("least"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found): base spans and all spans of each row as (start, kind, end); kinds 0-2 base, 3 random."""
    found = settle(_found(docs, id, text), "secrets")
    tested = settle(_measured(found.selectExpr("row", "inline(tokens)")), "candidates")
    words = tested.filter("encoding = 'text'").selectExpr("sum(equal)", "sum(n * (n - 1) / 2D)").first()
    stepped = _stepped(tested.filter("encoding != 'text'"), max(words[0] / words[1], 1e-6) if words[1] else EQUAL_PAIRS)
    # One row per encoding and length class at most.
    accepted = stepped.join(F.broadcast(_cutoffs(stepped)), ["encoding", "class"]).filter("step >= least")
    more = settle(
        accepted.groupBy("row").agg(F.expr("collect_list(struct(start, 3 AS kind, end)) AS more")).withColumnRenamed("row", "in_row"), "random"
    )
    bare = found.filter("size(tokens) = 0").selectExpr("doc_id", "base", "base AS found")
    joined = found.filter("size(tokens) > 0").join(more, F.expr("row = in_row"), "left")
    return bare.unionByName(joined.selectExpr("doc_id", "base", "array_sort(concat(base, coalesce(more, array()))) AS found"))


def _digest(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in (*BASE_KINDS, "random")) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    counts = [
        f"cast(size(filter(found, s -> s.kind = {i})) as long) AS n_{k}" for i, k in enumerate((*BASE_KINDS, "random"))
    ]
    return scan(docs, id, text).selectExpr("doc_id", *counts, f"sha2({_digest('base')}, 256) AS base_sha256", f"{_digest('found')} AS spans")


def mask(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every found secret replaced by ``MASK``; only texts that hold one are moved.

    Equal texts have equal spans, so texts are matched to them by digest, whatever their ids. A text is
    rebuilt from the pieces between its merged spans; ``length`` becomes that of a changed text.
    """
    named = docs.select(F.sha2(whole_text(text), 256).alias("__digest"), F.col(text))
    hits = scan(named, "__digest", text).filter("size(found) > 0")
    # Overlapping spans melt into one; they are sorted, so each either extends the last one or follows it.
    merged = """aggregate(found, cast(array() as array<struct<start: int, end: int>>), (a, s) ->
        if(size(a) > 0 AND s.start < element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, s.end) AS end))),
           concat(a, array(struct(s.start AS start, s.end AS end)))))"""
    hits = settle(hits.selectExpr("doc_id AS __of", f"{merged} AS __spans").dropDuplicates(["__of"]), "hits")
    # Without one of these a text can hold no span, and stays where it is.
    likely = F.coalesce(F.col(text).rlike(CANDIDATE) | F.col(text).rlike(ASSIGN[:-2] + "{%d,})" % ASSIGN_LENGTH), F.lit(False))
    untouched = docs.filter(~likely)
    touched = docs.filter(likely).withColumn("__digest", F.sha2(whole_text(text), 256)).join(hits, F.expr("__digest = __of"), "left")
    pieces = f"""concat(array(substring({text}, 1, __spans[0].start)),
        transform(__spans, (s, i) -> concat('{MASK}', substring({text}, s.end + 1,
            if(i + 1 < size(__spans), __spans[least(i + 1, size(__spans) - 1)].start, length({text})) - s.end))))"""
    new = touched.withColumn(text, F.expr(f"if(__spans IS NULL, {text}, array_join({pieces}, ''))"))
    if length in docs.columns:
        new = new.withColumn(length, F.expr(f"if(__spans IS NULL, {length}, length({text}))"))
    return untouched.unionByName(new.select(*docs.columns))
