"""Quality rules whose cutoffs are certified against false rejection, in SQL functions only.

Every whole text gets counts (words, symbols, repeated lines, repeated three-word windows, ...) and from
them one badness per rule, in ``STEPS`` steps. Which steps reject is decided per stratum (language and
length class) from labelled texts, each distinct text counting once:

* the learning half proposes. At level ``j`` a rule rejects from the lowest step on whose share of
  good learning texts is at most ``TOLERANCES[j]`` and that catches at least as many bad ones as
  good ones. Levels grow stricter; level 0 rejects nothing;
* the held-out half certifies. For each level the exact binomial probability of seeing at most the
  observed number of rejected good texts, were the true share ``RISK``, is its p-value. Levels are
  tested from the mildest on until one fails (a fixed sequence needs no correction of its own), each
  at ``ERROR`` divided by the number of strata (Bonferroni over strata);
* the strictest certified level holds. So with probability ``1 - ERROR`` no stratum loses more than
  ``RISK`` of its good texts to the rules; a stratum with too few labels keeps everything.

Defined cases: a null text has no words; repeated rows and ids are judged each for themselves; a
document with several labels counts as good if any of them is 1, null labels say nothing; a null
language is a stratum of its own; without labels only the base rules reject; an empty table gives an
empty result; other columns take no part. Windows are compared by 64-bit hashes. Memory follows the
longest text, as a row holds its words.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import whole_text
from hexloom.session import settle

#: Fixed values of the contract.
BLANK = "[\x20\x09-\x0d]"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
WINDOW = 3

#: Largest share of good texts that a stratum may lose, and the probability of being wrong anywhere.
RISK, ERROR = 0.02, 0.05
#: Share of good learning texts that one rule may reject, by level.
TOLERANCES = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.016)
STEPS = 64
#: Length classes by number of words: lower ends of the second and third.
LENGTHS = (200, 800)
#: Badness of each rule as (numerator, denominator); 1 and more is the last step.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "32 * n_words"),
    "short_words": ("greatest(8 * n_words - word_chars, 0L)", "8 * n_words"),
}


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document with its counts, stratum, text digest and ``steps`` of all rules.

    The counts of repeated windows come from two sorts of primitive arrays: hashes with the position in
    the low bits first, then full hashes of the few windows that met another one.
    """
    rows = docs.select(
        F.col(id).alias("doc_id"),
        whole_text(text).alias("t"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
    )
    split = rows.select(
        "doc_id", "lang", "t",
        F.array_remove(F.split("t", BLANK + "+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike("[^" + BLANK[1:])).alias("lines"),
    )
    n = f"size(w) - {WINDOW - 1}"
    hashed = split.select(
        "doc_id", "lang", F.md5("t").alias("digest"),
        F.expr("bigint(size(w)) AS n_words"),
        F.expr("bigint(char_length(array_join(w, ''))) AS word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.expr("bigint(size(lines)) AS n_lines"),
        F.expr("bigint(size(lines) - size(array_distinct(lines))) AS n_dup_lines"),
        F.expr(f"if({n} > 1, transform(sequence(0, {n} - 1), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))), array()) AS k"),
    )
    # The position takes the low bits it needs; the rest holds the top of the hash.
    packed = hashed.selectExpr("*", "int(ceil(log2(n_words + 1))) + 1 AS bits").selectExpr(
        "*", "sort_array(transform(k, (h, i) -> shiftleft(shiftright(h, bits), bits) + bigint(i))) AS p"
    )
    near = "shiftright(x, bits) = shiftright(coalesce(get(p, i {0} 1), -1L - x), bits)"
    met = packed.selectExpr(
        "* EXCEPT (p)", f"filter(p, (x, i) -> {near.format('-')} OR {near.format('+')}) AS c"
    ).selectExpr(
        "* EXCEPT (c, k, bits)",
        "sort_array(transform(c, x -> struct(get(k, int(x - shiftleft(shiftright(x, bits), bits))) AS h, "
        "int(x - shiftleft(shiftright(x, bits), bits)) AS at))) AS s",
    )
    equal = "x.h <=> get(s, i {0} 1).h"
    starts = met.selectExpr(
        "* EXCEPT (s)",
        f"sort_array(transform(filter(s, (x, i) -> {equal.format('-')} OR {equal.format('+')}), x -> x.at)) AS q",
    ).selectExpr(
        "* EXCEPT (q)",
        f"bigint(aggregate(q, struct({-WINDOW} AS last, 0 AS n), "
        f"(a, x) -> struct(x AS last, a.n + least({WINDOW}, x - a.last) AS n)).n) AS n_repeat_words",
    )
    step = ", ".join(
        f"int(least({STEPS - 1}, coalesce(({STEPS} * ({a})) div nullif({b}, 0L), 0L)))" for a, b in RULES.values()
    )
    low, high = LENGTHS
    return starts.selectExpr(
        "* EXCEPT (lang)",
        f"struct(lang, CASE WHEN n_words < {low} THEN 0 WHEN n_words < {high} THEN 1 ELSE 2 END AS length) AS stratum",
        f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed",
        f"array({step}) AS steps",
    )


def log_factorial(x: str) -> str:
    """SQL text of ln(x!) to double precision: a Stirling series eight steps up, then down again."""
    z = f"({x} + 9D)"
    series = f"(({z} - 0.5D) * ln{z} - {z} + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12D * {z}) - 1 / (360D * {z} * {z} * {z}) + 1 / (1260D * power({z}, 5)) - 1 / (1680D * power({z}, 7)))"
    return f"({series} - ln({' * '.join(f'({x} + {i}D)' for i in range(1, 9))}))"


def binomial_at_most(k: str, n: str, share: float) -> str:
    """SQL text of P(X <= k), X binomial with ``n`` draws at ``share``.

    Terms are summed from ``k`` down by their exact ratio. Forty standard deviations below they are
    under the precision of a double, so a row never folds over more than that; from the upper tail
    on the result is 1, where no caller needs it.
    """
    top = f"({log_factorial(f'double({n})')} - {log_factorial(f'double({k})')} - {log_factorial(f'double({n} - {k})')} + {k} * {math.log(share)!r}D + ({n} - {k}) * {math.log1p(-share)!r}D)"
    reach = f"int(least({k}, ceil(40 * sqrt({n} * {share * (1 - share)!r}D)) + 100))"
    ratio = f"({k} - i) * {(1 - share) / share!r}D / ({n} - {k} + i + 1)"
    folded = f"aggregate(sequence(0, {reach}), struct(1D AS t, 0D AS s), (a, i) -> struct(a.t * ({ratio}) AS t, a.s + a.t AS s)).s"
    return f"if({k} > {n} * {share!r}D, 1D, least(1D, exp({top}) * {folded}))"


def proposed(observed: DataFrame) -> DataFrame:
    """(stratum, cuts): for each level the lowest rejecting step of each rule; ``STEPS`` rejects nothing."""
    tally = (
        observed.filter("learning")
        .selectExpr("stratum", "good", "posexplode(steps) AS (rule, step)")
        .groupBy("stratum", "rule", "step")
        .agg(F.expr("count_if(good) AS good"), F.expr("count_if(NOT good) AS bad"))
    )
    below = "OVER (PARTITION BY stratum, rule ORDER BY step DESC ROWS UNBOUNDED PRECEDING)"
    tails = tally.selectExpr(
        "stratum", "rule", "step", f"sum(good) {below} AS good", f"sum(bad) {below} AS bad",
        "sum(good) OVER (PARTITION BY stratum, rule) AS all_good",
    ).filter("bad > 0 AND bad >= good AND step > 0")
    cut = lambda rule, share: f"coalesce(min(step) FILTER (WHERE rule = {rule} AND good <= {share!r}D * all_good), {STEPS})"
    levels = ", ".join(f"array({', '.join(cut(r, share) for r in range(len(RULES)))})" for share in TOLERANCES)
    return tails.groupBy("stratum").agg(F.expr(f"array({levels}) AS cuts"))


_HIT = "exists(zip_with(steps, {0}, (s, c) -> s >= c), hit -> hit)"


def certified(observed: DataFrame, cuts: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, level, cuts, good, rejected, p): the strictest level that the held-out half certifies."""
    first = f"transform(cuts, c -> if({_HIT.format('c')}, 1L, 0L))"
    hits = observed.filter("NOT learning AND good").join(cuts, "stratum").selectExpr("stratum", f"{first} AS hits")
    columns = [F.expr(f"sum(hits[{j}]) AS r{j}") for j in range(len(TOLERANCES))]
    sums = settle(hits.groupBy("stratum").agg(F.expr("count(1) AS good"), *columns), "holdout")
    alone = error / max(sums.count(), 1)
    levels = sums.selectExpr(
        "stratum", "good", f"posexplode(array({', '.join(f'r{j}' for j in range(len(TOLERANCES)))})) AS (level, rejected)"
    ).selectExpr("*", f"{binomial_at_most('rejected', 'good', risk)} AS p")
    passed = levels.selectExpr(
        "*", f"sum(if(p <= {alone!r}D, 0, 1)) OVER (PARTITION BY stratum ORDER BY level) AS failures"
    ).filter("failures = 0")
    best = passed.groupBy("stratum").agg(F.expr("max_by(struct(level + 1 AS level, good, rejected, p), level) AS best"))
    return best.join(cuts, "stratum").selectExpr("stratum", "best.*", "cuts[best.level - 1] AS cuts")


def judge(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """One row per document: the counts, base_failed, kept, the stratum, its level and the rules that reject.

    ``labels`` has ``doc_id`` and ``label`` (1: good).
    """
    rows = settle(counted(docs, id, text, lang), "counts")
    marks = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.expr("max(label) = 1 AS good"))
    observed = (
        rows.filter("NOT base_failed").join(marks, "doc_id").groupBy("stratum", "digest")
        .agg(F.expr("bool_or(good) AS good"), F.expr("max(steps) AS steps"))
        .selectExpr("*", "bigint(conv(left(digest, 4), 16, 10)) % 2 = 0 AS learning")
    )
    observed = settle(observed, "observed")
    chosen = settle(certified(observed, settle(proposed(observed), "cuts"), risk, error), "certified")
    names = "array(" + ", ".join(f"'{name}'" for name in RULES) + ")"
    judged = rows.join(chosen.select("stratum", "level", "cuts"), "stratum", "left").selectExpr(
        "*", f"array_compact(transform({names}, (name, r) -> if(get(steps, r) >= get(cuts, r), name, NULL))) AS hits"
    )
    return judged.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "NOT base_failed AND size(hits) = 0 AS kept",
        "stratum.lang AS stratum_lang", "stratum.length AS stratum_length", "coalesce(level, 0) AS level", "array_join(hits, ',') AS rules",
    )
