"""Near duplicates: MinHash bands find candidates, odd sketches screen them, full sets confirm them.

A document's set holds its distinct shingles of five words. 384 minima per set give 64 bands of six,
which miss a pair of similarity 0.75 with a probability of 4e-6. The minima are also folded into a
parity bitmap of 1024 bits; the number of ones in the XOR of two bitmaps estimates high similarities
closely, and pairs that it places six deviations below the threshold leave before any set is read, as do
pairs whose sizes alone rule the threshold out. Pairs from about 0.58 on pass, next to none under 0.4.

Work stays linear in groups of copies. Documents with the same set are one class, of which only the
representative goes on. First a few bands alone join large groups: a member is compared with at most four
of the smallest members of its buckets. Then only buckets of any band that hold more than one component
are opened. In rounds their members meet a few random ones of other components, as long as that finds
links. What is left is compared only between members still in different components, in blocks: a task
screens all pairs of a block at once, and each member goes on as one row with the list of its partners.
Members with a common smallest partner form a unit, cut into blocks, to which each set is sent once, so
that sets are never repeated for every pair; of a unit's links only those that join something are kept.

Defined cases: null or blank texts have an empty set and are linked with nothing; a text under five
words is one shingle; a null id never names a component, and a group of null ids has a null one;
repeated rows are members of one class, and rows that share an id are told apart by their sets, when
links are found and when rows are dropped; an empty table gives an empty result; other columns
of the input take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm import bloom
from hexloom.llm.common import WordHashes, discard, shingles, small_batches, words
from hexloom.llm.components import components
from hexloom.llm.repeats import filter_of, within
from hexloom.llm.skew import join_groups
from hexloom.session import settle

BANDS, ROWS = 64, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
PERCENT = 75
#: Members of a large bucket compared with each other at a time.
BLOCK = 256
#: Bands that large groups are joined by before the others are looked at.
FIRST_BANDS = 8
#: Rounds of random meetings before what is left of a bucket is compared as a whole; they end early once
#: fewer than one meeting in ``WORTH`` is a link.
ROUNDS, WORTH = 3, 20

#: The sketch as 64-bit columns.
_PARTS = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_SIGNATURE = f"doc_id long, h long, n_shingles long, d1 long, d2 long, {', '.join(f'{c} long' for c in _PARTS)}, bands array<bigint>"
#: A class of equal sets, by its digests.
_CLASS = "xxhash64(d1, d2, n_shingles)"


def _largest_difference(similarity: float) -> int:
    """Bits that two sketches of sets this similar differ in, plus six standard deviations."""
    flips = 2 * (1 - similarity) * SAMPLES
    expected = SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS))
    # The number of flips varies, and so does how many of a given number meet in a bit.
    decay = math.exp(-4 * flips / SKETCH_BITS)
    spread = math.sqrt(decay * 4 * SAMPLES * similarity * (1 - similarity) + SKETCH_BITS / 4 * (1 - decay) - flips * decay)
    return math.ceil(expected + 6 * spread)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    factor = draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
    return factor[:, None], draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]


def _minima(values: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    low = values.astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (factor * low[at : at + 512] + shift).min(axis=1), out=out)
    return out


def _odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Each (sample, minimum) flips one of the bits."""
    with np.errstate(over="ignore"):
        salted = (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32)) | minima.astype(np.uint64)
        z = salted * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    flips = np.bincount((z >> np.uint64(54)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


def _digests(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    sums = [np.uint64(((own ^ (own >> np.uint64(31))) * m).sum()).view(np.int64) for m in mult]
    return int(sums[0]), int(sums[1] ^ np.bitwise_xor.reduce(own * mult[0]).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factor, shift = _multipliers()
    hashes = WordHashes()
    old = np.seterr(over="ignore")
    try:
        for batch in batches:
            numbers, bands = [], []
            for text in batch.column(1):
                own = np.unique(shingles(hashes.of(words(text.as_py()))))
                if not len(own):
                    numbers.append((0,) * (3 + len(_PARTS)))
                    bands.append([])
                    continue
                minima = _minima(own, factor, shift)
                keyed = minima.reshape(BANDS, ROWS).astype(np.uint64)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for i in range(ROWS):
                    key = (key ^ keyed[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                numbers.append((len(own), *_digests(own), *map(int, _odd_sketch(minima))))
                bands.append(key.view(np.int64))
            columns = list(zip(*numbers, strict=True)) if numbers else [[]] * (3 + len(_PARTS))
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), batch.column(2), *(pa.array(c, pa.int64()) for c in columns), pa.array(bands, pa.list_(pa.int64()))],
                names=[f.split(" ")[0] for f in _SIGNATURE.split(", ")],
            )
    finally:
        np.seterr(**old)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    old = np.seterr(over="ignore")
    try:
        for batch in batches:
            own = [np.unique(shingles(hashes.of(words(t.as_py())))) for t in batch.column(0)]
            digests = [*zip(*map(_digests, own), strict=True)] or [[], []]
            yield pa.record_batch(
                [
                    *(pa.array(d, pa.int64()) for d in digests), pa.array([len(o) for o in own], pa.int64()),
                    pa.array([o.view(np.int64) for o in own], pa.list_(pa.int64())),
                ],
                names=["d1", "d2", "n_shingles", "own"],
            )
    finally:
        np.seterr(**old)


def _buckets_of(batch: pa.RecordBatch) -> np.ndarray:
    """Buckets of a batch of (bands); a bucket's value holds its band."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _entries(shared):
    """(rep, band, bucket) of all buckets that may have a second member, from (bands, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            buckets = _buckets_of(batch)
            again = np.flatnonzero(within(bits, buckets))
            rep = batch.column(1).to_numpy(zero_copy_only=False)[again // BANDS]
            yield pa.record_batch(
                [pa.array(rep), pa.array((again % BANDS).astype(np.int32)), pa.array(buckets[again].view(np.int64))], names=["rep", "band", "bucket"]
            )

    return run


def _differing(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}{i} ^ {b}{i})" for i in range(len(_PARTS)))


def _sizes_fit(n: str, m: str) -> str:
    """Whether sets of these sizes can reach the threshold at all."""
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def _screened(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) whose sketches differ in ``limit`` bits at most."""
    degrees = settle(pairs.groupBy("b").agg(F.expr("count(1) AS degree")), "degrees")
    mine = sketches.selectExpr("rep AS a", "n_shingles AS n", *[f"{c} AS p{c[1:]}" for c in _PARTS])
    centres = settle(
        degrees.join(sketches.selectExpr("rep AS b", "n_shingles AS m", *[f"{c} AS q{c[1:]}" for c in _PARTS]), "b"), "centres"
    )
    near = f"{_sizes_fit('n', 'm')} AND {_differing('p', 'q')} <= {limit}"
    return join_groups(pairs, centres, ["b"], "degree").join(mine, "a").filter(near).select("a", "b")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of sorted batches, one table for each run of equal values in the first ``keys`` columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]])
        cuts = (np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = own[:, lo].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _lists(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all values of a column of lists without nulls."""
    whole = rows.column(name).combine_chunks()
    return whole.value_lengths().to_numpy(zero_copy_only=False), whole.flatten().to_numpy(zero_copy_only=False)


def _partners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct pairs: the members, their smallest partner or themselves, and as lists (lengths, values) the b of each a."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    members, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    least = members.copy()
    np.minimum.at(least, at[: len(a)], b)
    np.minimum.at(least, at[len(a) :], a)
    return members, least, np.bincount(at[: len(a)], minlength=len(members)), b


def _as_lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _meet(limit: int):
    """(rep, least, asked) of each block of rows (bucket, bi, bj, block, rep, label, n_shingles, sketch) that pass the screen."""

    def found(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        bi, bj = rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py()
        block, rep, label, n = (_column(rows, c) for c in ("block", "rep", "label", "n_shingles"))
        x, y = np.flatnonzero(block == bi)[:, None], np.flatnonzero(block == bj)[None, :]
        fits = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
        if bi == bj:
            fits &= rep[x] < rep[y]
        if not fits.any():
            return rep[:0], rep[:0]
        differing = np.zeros(fits.shape, np.int32)
        for c in _PARTS:
            part = _column(rows, c).view(np.uint64)
            differing += np.bitwise_count(part[x] ^ part[y])
        i, j = np.nonzero(fits & (differing <= limit))
        one, other = rep[x[i, 0]], rep[y[0, j]]
        return np.maximum(one, other), np.minimum(one, other)

    def told(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        members, least, lengths, asked = _partners(*np.unique(np.stack([np.concatenate(c) for c in zip(*pairs, strict=True)]), axis=1))
        return pa.record_batch([pa.array(members), pa.array(least), _as_lists(lengths, asked)], names=["rep", "least", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0
        for rows in _runs(batches, 3):
            pairs.append(found(rows))
            size += len(pairs[-1][0]) + 1
            if size > BLOCK * BLOCK:
                yield told(pairs)
                pairs, size = [], 0
        if pairs:
            yield told(pairs)

    return run


def _unit_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(home, ba, bb, rep, asked) of every member that a unit of such rows asks or is asked for."""
    for rows in _runs(batches, 3):
        lengths, asked = _lists(rows, "asked")
        members, _, lengths, asked = _partners(np.repeat(_column(rows, "rep"), lengths), asked)
        unit = [pa.array(np.full(len(members), rows.column(c)[0].as_py()), rows.column(c).type) for c in ("home", "ba", "bb")]
        yield pa.record_batch([*unit, pa.array(members), _as_lists(lengths, asked)], names=["home", "ba", "bb", "rep", "asked"])


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join something within a unit, by the full sets of its rows (home, ba, bb, rep, asked, own)."""
    for rows in _runs(batches, 3):
        rep, (sizes, values) = _column(rows, "rep"), _lists(rows, "own")
        distinct, codes = np.unique(values, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(distinct), bool)
        order = np.argsort(rep)
        lengths, asked = _lists(rows, "asked")
        # A member whose set could not be read is no one's partner.
        at = order[np.minimum(np.searchsorted(rep, asked, sorter=order), len(rep) - 1)]
        known, ends = rep[at] == asked, np.cumsum(lengths)
        group, links = np.arange(len(rep)), []
        for i in np.flatnonzero(lengths):
            span = slice(ends[i] - lengths[i], ends[i])
            others = at[span][known[span]]
            others = others[group[others] != group[i]]
            if not len(others):
                continue
            own = codes[starts[i] : starts[i] + sizes[i]]
            mark[own] = True
            common = np.add.reduceat(mark[codes], starts, dtype=np.int64)[others]
            mark[own] = False
            for j in others[100 * common >= PERCENT * (sizes[i] + sizes[others] - common)]:
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    links.append((rep[i], rep[j]))
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets_of(reps: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, own): the full sets of classes; texts are read again for the classes in question only.

    A class is read from the row of its smallest id whose set has the class's digests.
    """
    ids = settle(reps.join(classes.select("rep", "first"), "rep"), "ids")
    asked, segments = bloom.build(ids, "first", ids.count())
    asked = settle(asked, "filter")
    texts = bloom.possibly(docs.filter("doc_id IS NOT NULL"), "doc_id", asked, segments, "__asked")
    sets = texts.filter("__asked").select("text").mapInArrow(_sets, "d1 long, d2 long, n_shingles long, own array<bigint>")
    sets = settle(sets.selectExpr(f"{_CLASS} AS rep", "own").join(ids, "rep", "left_semi").dropDuplicates(["rep"]), "sets")
    for done in (ids, asked):
        discard(done)
    return sets


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold, for pairs that grow with the rows alone."""
    sets = _sets_of(pairs.selectExpr("inline(array(struct(a AS rep), struct(b AS rep)))").distinct(), docs, classes)
    # A centre with very many partners is repeated once for every 256 of them, so that no task gets them all.
    parts = pairs.groupBy("b").agg(F.expr("cast(ceil(count(1) / 256) as int) AS parts"))
    spread = pairs.join(parts, "b").withColumn("part", F.expr("cast(pmod(xxhash64(a), parts) as int)"))
    centres = sets.join(parts, sets["rep"] == parts["b"]).selectExpr("b", "own AS theirs", "explode(sequence(0, parts - 1)) AS part")
    both = spread.join(centres, ["b", "part"]).join(sets.selectExpr("rep AS a", "own"), "a")
    common = both.selectExpr("a", "b", "size(array_intersect(own, theirs)) AS i", "size(own) + size(theirs) AS n")
    links = settle(common.filter(f"100 * i >= {PERCENT} * (n - i)").select("a", "b"), "links")
    discard(sets)
    return links


def _confirmed_in_units(near: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links enough to join all that (rep, least, asked) of ``_meet`` link, compared in blocks of units."""
    asks = settle(near.groupBy("rep").agg(F.min("least").alias("home"), F.expr("array_distinct(flatten(collect_list(asked))) AS asked")), "asks")
    homes = settle(asks.groupBy("home").agg(F.expr("count(1) AS members")), "homes")
    dealt = join_groups(asks, homes, ["home"], "members").withColumn("blocks", F.expr(f"cast(ceil(members / {BLOCK}) as int)"))
    dealt = dealt.selectExpr("home", "cast(pmod(xxhash64(rep), blocks) as int) AS ba", "explode(sequence(0, blocks - 1)) AS bb", "rep", "asked", "blocks")
    dealt = dealt.withColumn("asked", F.expr("if(blocks = 1, asked, filter(asked, x -> pmod(xxhash64(x), blocks) = bb))")).drop("blocks").filter("size(asked) > 0")
    unit = ["home", "ba", "bb"]
    shape = "home long, ba int, bb int, rep long, asked array<bigint>"
    units = settle(dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_unit_members, shape), "units")
    sets = _sets_of(asks.select("rep"), docs, classes)
    links = units.join(sets, "rep").select(*unit, "rep", "asked", "own").repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_unit_links, "a long, b long")
    links = settle(links, "links")
    for done in (asks, homes, units, sets):
        discard(done)
    return links


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components once more links (a, b) are known."""
    if links.isEmpty():
        return found
    return components(found.selectExpr("node AS a", "component AS b").unionByName(links), "a", "b")


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, d1, d2, component_id) of every row of (doc_id, text, h)."""
    small_batches(docs.sparkSession)
    signed = settle(docs.mapInArrow(_sign, _SIGNATURE), "signatures")
    limit = _largest_difference(PERCENT / 100)

    # One class for each distinct set, read from the row of its smallest id.
    classes = settle(
        signed.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("first"), F.expr("count(1) AS copies"))
        .withColumn("rep", F.expr(_CLASS)),
        "classes",
    )
    # Only rows of sets that may occur twice are shuffled to find the class's own.
    sets = signed.filter("n_shingles > 0").withColumn("rep", F.expr(_CLASS))
    repeated = classes.filter("copies > 1")
    asked, segments = bloom.build(repeated, "rep", repeated.count())
    flagged = bloom.possibly(sets, "rep", settle(asked, "filter"), segments, "__again").select("rep", "doc_id", "d1", "d2", "n_shingles", *_PARTS, "bands", "__again")
    several = flagged.filter("__again").join(
        classes.selectExpr("first AS doc_id", "d1", "d2", "n_shingles", "rep"), ["rep", "doc_id", "d1", "d2", "n_shingles"]
    ).dropDuplicates(["rep"])
    single = flagged.filter("NOT __again AND doc_id IS NOT NULL")
    reps = settle(single.unionByName(several).select("rep", "n_shingles", *_PARTS, "bands"), "reps")
    sketches = reps.drop("bands")

    # Buckets of one member leave before anything of them is shuffled row by row.
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(reps.select("bands"), _buckets_of, 2))
    all_entries = settle(reps.select("bands", "rep").mapInArrow(_entries(shared), "rep long, band int, bucket long"), "entries")
    shared.destroy()

    # A few bands: buckets of two or more, and the smallest member of each in up to four draws a row.
    entries = all_entries.filter(f"band < {FIRST_BANDS}")
    buckets = settle(
        entries.groupBy("band", "bucket").agg(F.min("rep").alias("least"), F.expr("count(1) AS members")).filter("members > 1"), "buckets"
    )
    met = join_groups(entries, buckets, ["band", "bucket"], "members")
    pairs = met.filter("rep != least").groupBy("rep", F.expr("band % 4 AS draw")).agg(F.min("least").alias("b")).selectExpr("rep AS a", "b").distinct()
    links = _confirmed(settle(_screened(settle(pairs, "pairs"), sketches, limit), "screened"), docs, classes)
    found = components(links, "a", "b")

    # All bands: only the members of buckets with several components go on.
    named = all_entries.join(found.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("rep", "coalesce(component, rep) AS label", "band", "bucket")
    several = settle(
        named.groupBy("band", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.expr("count(1) AS members"))
        .filter("lo != hi").select("band", "bucket", "members"),
        "several",
    )
    asked, segments = bloom.build(several, "bucket", several.count())
    likely = bloom.possibly(all_entries, "bucket", settle(asked, "filter"), segments, "__open").filter("__open").drop("__open")
    likely = settle(likely, "likely")
    met = settle(join_groups(likely, several, ["band", "bucket"], "members"), "met")
    for done in (all_entries, buckets, likely, several):
        discard(done)

    # Buckets whose members are still in different components. First, in rounds, every member meets up to
    # four random members of other components, which joins what belongs to a large group.
    worth = True
    for turn in range(ROUNDS + 1):
        labelled = met.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        labelled = settle(
            labelled.selectExpr("band", "bucket", "rep", "members", "coalesce(component, rep) AS label"), "labelled"
        )
        mixed = settle(
            labelled.groupBy("band", "bucket").agg(
                F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("members").alias("members"),
                F.expr(f"min_by(struct(rep, label), xxhash64(rep, band, bucket, {turn}))").alias("centre"),
            ).filter("lo != hi"),
            "mixed",
        )
        if turn == ROUNDS or not worth:
            break
        open_rows = join_groups(labelled.select("band", "bucket", "rep", "label"), mixed, ["band", "bucket"], "members")
        drawn = open_rows.filter("label != centre.label").groupBy("rep", F.expr("band % 4 AS draw")).agg(
            F.expr("min_by(centre.rep, xxhash64(centre.rep, rep))").alias("other")
        )
        drawn = settle(drawn.selectExpr("greatest(rep, other) AS a", "least(rep, other) AS b").distinct(), "drawn")
        if drawn.isEmpty():
            break
        links = _confirmed(settle(_screened(drawn, sketches, limit), "screened"), docs, classes)
        found = _joined(found, links)
        worth = links.count() * WORTH >= drawn.count()
        for done in (labelled, mixed, drawn, links):
            discard(done)

    # Then the pairs of a bucket that are still apart, block by block.
    mixed = mixed.drop("centre")
    open_rows = join_groups(labelled.drop("members"), mixed.drop("lo", "hi"), ["band", "bucket"], "members")
    open_rows = open_rows.join(sketches, "rep").selectExpr(
        "band", "bucket", "rep", "label", "n_shingles", *_PARTS,
        f"cast(ceil(members / {BLOCK}) as int) AS blocks", f"cast(pmod(xxhash64(rep, 3), ceil(members / {BLOCK})) as int) AS block",
    )
    # A row goes to every block that its own one meets.
    open_rows = open_rows.withColumn("other", F.expr("explode(sequence(0, blocks - 1))")).selectExpr(
        "bucket", "least(block, other) AS bi", "greatest(block, other) AS bj", "block", "rep", "label", "n_shingles", *_PARTS
    )
    meeting = open_rows.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    near = settle(meeting.mapInArrow(_meet(limit), "rep long, least long, asked array<bigint>"), "near")
    for done in (met, labelled):
        discard(done)
    if not near.isEmpty():
        found = _joined(found, _confirmed_in_units(near, docs, classes))

    # A component is named by the smallest id in any of its classes.
    joined = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.expr("coalesce(component, rep)"))
    smallest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named_classes = settle(joined.join(smallest, "label").select("d1", "d2", "n_shingles", "copies", "component_id"), "named")
    slim = signed.select("doc_id", "h", "n_shingles", "d1", "d2")
    linked = join_groups(slim.filter("n_shingles > 0"), named_classes, ["d1", "d2", "n_shingles"], "copies")
    blank = slim.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return linked.select(*blank.columns).unionByName(blank)


def _plain(docs: DataFrame, id: str, text: str) -> DataFrame:
    own = F.col(text).cast("string")
    return docs.select(F.col(id).cast("long").alias("doc_id"), own.alias("text"), F.xxhash64(own).alias("h"))


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    found = _labelled(_plain(docs, id, text)).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.expr("doc_id <=> component_id"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with its smallest id.

    Rows go by id and text, so a row with a text of its own stays though its id also stands on a
    repeated one. Rows without an id always stay.
    """
    from hexloom.llm.exact_dedup import without_ids

    found = _labelled(_plain(docs, id, text)).filter("doc_id != component_id")
    dropped = settle(found.selectExpr("doc_id AS __dropped", "h AS __of").distinct(), "dropped")
    return without_ids(docs, dropped, "__dropped", id, F.xxhash64(F.col(text).cast("string")))
