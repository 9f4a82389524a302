"""Exact Jaccard join of documents by word n-grams: a blocked sparse product of the document by n-gram
incidence with its transpose.

A document is a row of the incidence matrix, an n-gram a column. The product's entries are overlaps, and
only those that can reach the bound are worth adding up:

- Rows with equal sets are one row: their digest names the vertex, whatever number of copies there are.
- A row of n n-grams can only reach the bound with another if they share one of its first
  ``n - ceil(t n) + 1`` n-grams in a common order. Only that part of the matrix is stored. Against a row that is no
  smaller, its first ``n - ceil(2 t n / (1 + t)) + 1`` are enough. The order puts
  n-grams of busy hash buckets last, so columns of boilerplate are left out; bucket counts cover all texts.
- Column blocks are multiplied by joins on the n-gram. A pair is needed once, from the first n-gram in the order that
  both rows have. What stands before that one is in one row only, so an entry counts only if what
  stands from there on reaches the bound of the two sizes in either row.
- Of a column only rows stay that have another row of a size within the bound in it; of a column of two, also only
  if the n-gram may be the first of the pair. Most columns are shared by chance.
- A row has a signature of at least two bits for each n-gram, in which each of its n-grams flips one. Two rows' signatures
  differ in no more bits than their sets in n-grams, and linked rows differ in at most (1 - t) / (1 + t) of the sum of
  their sizes. Pairs that differ in more are dropped; the last product looks at 256 bits as it joins.
- What remains is decided by the exact overlap of the whole sets. These and their signatures are written once, for
  rows of the stored part.

Large groups of near copies would have a quadratic number of entries. Components need only enough of them, so
the first products link each row to a number of ``leaders`` of a column, the smallest under as many hashes;
rows of one group mostly have the same leaders. The last product skips entries within a component found so far,
and loses none between different ones. It also skips an entry if one of the few n-grams before it is in both rows, as the
pair then has an earlier one. No entry is decided twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from case_insights.llm import words as W
from case_insights.llm.graph import components
from case_insights.llm.store import discard, saved

_SALT = np.uint64(0xD6E8FEB86659FD93)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of each row that has any."""
    row = 0
    for part in W.slices(batch):
        data, offsets = W.text_bytes(part.column("text"))
        start, end, first = W.split_words(data, offsets)
        h = W.hash_words(data, start, end, lower=True)
        grams = W.run_hashes(h, k)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b - a >= k:
                yield row + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield row + i, W.mix(W.run_hashes(h[a:b], b - a)[:1] ^ (_SALT >> np.uint64(b - a)))
        row += part.num_rows


def _digest(grams: np.ndarray) -> int:
    total = W.mix(np.bitwise_xor(grams, _SALT)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(W.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _signature(grams: np.ndarray) -> np.ndarray:
    """The bytes of a power of two of bits, 256 at least and two for each n-gram; each is the parity of the n-grams that
    flip it. Half as many bits are the exclusive or of both halves."""
    size = max(256, 1 << (2 * len(grams) - 1).bit_length())
    flips = W.mix(np.bitwise_xor(grams, _SALT >> np.uint64(1))) & np.uint64(size - 1)
    return np.packbits(np.bincount(flips.astype(np.int64), minlength=size).astype(np.uint8) & 1)


def _folded(signature: np.ndarray, size: int) -> np.ndarray:
    while len(signature) > size:
        half = len(signature) // 2
        signature = signature[:half] ^ signature[half:]
    return signature


def _classes(k: int, bits: int):
    """Rows (0, doc_id, size, digest) of documents, and at the end of a task (1, bucket, count, null)."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            size, digest = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            buckets, held = [], 0
            for row, grams in _sets(batch, k):
                size[row], digest[row] = len(grams), _digest(grams)
                buckets.append((grams >> np.uint64(64 - bits)).astype(np.int32))
                held += len(grams)
                if held >= 1 << 18:
                    counts += np.bincount(np.concatenate(buckets), minlength=1 << bits)
                    buckets, held = [], 0
            if buckets:
                counts += np.bincount(np.concatenate(buckets), minlength=1 << bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("doc_id").cast(pa.int64()),
                 pa.array(size), pa.array(digest, pa.int64())],
                ["kind", "id", "n", "v"],
            )
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(counts[used]), pa.nulls(len(used), pa.int64())],
            ["kind", "id", "n", "v"],
        )

    return run


def _ordered(grams: np.ndarray, rank: np.ndarray, bits: int) -> np.ndarray:
    """The n-grams renamed, one to one, so that numeric order is the common order."""
    shift = np.uint64(64 - bits)
    low = grams & ((np.uint64(1) << shift) - np.uint64(1))
    return np.sort((rank[(grams >> shift).astype(np.int64)] << shift) | low)


def _incidence(k: int, percent: int, rank, bits: int):
    """Rows (gram, v, n, place) of the stored part; a task writes a set once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            grams, vs, ns, places = [], [], [], []
            for _, found in _sets(batch, k):
                v = _digest(found)
                if v in seen:
                    continue
                seen.add(v)
                n = len(found)
                head = _ordered(found, rank.value, bits)[: n - (percent * n + 99) // 100 + 1]
                grams.append(head)
                vs.append(np.full(len(head), v, np.int64))
                ns.append(np.full(len(head), n, np.int32))
                places.append(np.arange(len(head), dtype=np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(vs)),
                     pa.array(np.concatenate(ns)), pa.array(np.concatenate(places))],
                    ["gram", "v", "n", "place"],
                )

    return run


def _wanted_sets(k: int, bitmap):
    """Rows (v, grams, bits, short) of sets whose digest may be wanted, with their signatures, whole and of 256 bits; a
    task writes a set once."""

    def run(batches):
        seen: set[int] = set()
        wanted = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            vs, sets, bits, short = [], [], [], []
            for _, found in _sets(batch, k):
                v = _digest(found)
                at = v % (8 * len(wanted))
                if v not in seen and wanted[at >> 3] >> (at & 7) & 1:
                    seen.add(v)
                    signature = _signature(found)
                    vs.append(v)
                    sets.append(found.tobytes())
                    bits.append(signature.tobytes())
                    short.append(_folded(signature, 32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(vs, pa.int64()), *(pa.array(x, pa.binary()) for x in (sets, bits, short))], ["v", "grams", "bits", "short"]
            )

    return run


def _close(percent: int):
    """Pairs whose signatures let them link."""

    def run(batches):
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("left_bits", "right_bits", "an", "bn"))
            for a, b, an, bn in zip(*columns):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                size = min(len(a), len(b))
                differ = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
                keep.append((100 + percent) * differ <= (100 - percent) * (an + bn))
            yield batch.select(["a", "b", "an", "bn"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlaps(batches):
    for batch in batches:
        shared = []
        for a, b in zip(batch.column("left_grams").to_pylist(), batch.column("right_grams").to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            at = np.searchsorted(a, b)
            shared.append(int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("an"), batch.column("bn"), pa.array(shared, pa.int64())],
            ["a", "b", "an", "bn", "shared"],
        )


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, filter_bits: int) -> DataFrame:
    """Written rows (v, grams, bits, short) of the sets with a digest in ``wanted``, and of others that a bitmap of bounded
    size lets through. A task writes a set once, so each has a few rows at most; they are equal."""
    x = (F.pmod("v", F.lit(filter_bits)) + 1).alias("x")
    blocks = (
        wanted.select(x)
        .groupBy(F.bitmap_bucket_number("x").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bitmap"))
        .collect()  # at most filter_bits / 32768 rows of 4 KiB
    )
    bitmap = bytearray(filter_bits // 8)
    for block, bits in blocks:
        bitmap[(block - 1) * 4096 : block * 4096] = bits
    marks = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    sets = docs.mapInArrow(_wanted_sets(k, marks), "v long, grams binary, bits binary, short binary")
    sets = saved(sets, "sets")
    marks.destroy()
    return sets


def _with_both(sets: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The (written) pairs with a column of either set. As pairs are written, Spark knows whether they are few; then only
    their sets are shuffled."""
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b"))
    one = sets.select("v", column).join(ends, "v", "left_semi").groupBy("v").agg(F.first(column).alias(column))
    both = pairs.join(one.toDF("b", f"right_{column}"), "b").join(one.toDF("a", f"left_{column}"), "a")
    return both.select("a", "b", "an", "bn", f"left_{column}", f"right_{column}")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the (written) pairs that link."""
    return saved(
        _with_both(sets, pairs, "grams")
        .mapInArrow(_overlaps, "a long, b long, an int, bn int, shared long")
        .filter(f"100 * shared >= {percent} * (an + bn - shared)")
        .select("a", "b"),
        "links",
    )


def _may_be_first(n: str, place: str, m: str, at: str, percent: int) -> str:
    """SQL: whether an n-gram in these places of rows of sizes ``n`` and ``m`` may be the first that two linked rows share:
    all that they share then stands from there on, in either row."""
    need = f"div({percent} * ({n} + {m}) + {99 + percent}, {100 + percent})"
    return f"(100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and least({n} - {place}, {m} - {at}) >= {need})"


def _alike(percent: int) -> str:
    """SQL: whether the short signatures abits0 to abits3 and bbits0 to bbits3 let rows of sizes an and bn link."""
    differ = " + ".join(f"bit_count(abits{i} ^ bbits{i})" for i in range(4))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * (an + bn)"


def _mixed(rows: DataFrame, turn: int, leaders: int) -> DataFrame:
    """Written rows of the columns with several components, and whether a row is one of the ``leaders`` of its column."""
    column = Window.partitionBy("gram")
    # digests are random, so the least under exclusive or with a salt is a random row, and names it
    salts = [F.lit(int(x)) for x in W.mix(np.arange(1000 * turn + 1, 1000 * turn + 1 + leaders, dtype=np.uint64)).view(np.int64)]
    heads = [F.min(F.col("v").bitwiseXOR(x)).over(column).bitwiseXOR(x) for x in salts]
    rows = rows.withColumns({"low": F.min("c").over(column), "high": F.max("c").over(column), "heads": F.array(*heads)}).filter("low < high")
    leads = F.array_contains("heads", F.col("v")) if leaders else F.lit(False)
    return saved(rows.select("gram", "v", "n", "place", "c", leads.alias("leads")), "mixed")


def _product(rows: DataFrame, leaders: int, percent: int, short: DataFrame) -> DataFrame:
    """Pairs a, b, an, bn of different components in ``rows``, those of mixed columns: of each row with each leader of its
    column, or without ``leaders`` of all pairs of rows. ``short``: v, bits0 to bits3."""
    first = _may_be_first("an", "ap", "bn", "bp", percent)
    if leaders:
        left, right = rows, rows.filter("leads")
    else:
        # the few n-grams before one, of those that count
        before = F.collect_list("gram").over(Window.partitionBy("v").orderBy("place").rowsBetween(-8, -1))
        left = right = rows.withColumn("before", before).join(short, "v")
        first = f"{first} and {_alike(percent)} and not arrays_overlap(abefore, bbefore)"
    left, right = (
        side.select(
            F.col("gram").alias(f"{x}gram"), F.col("v").alias(x), F.col("n").alias(f"{x}n"), F.col("place").alias(f"{x}p"), F.col("c").alias(f"{x}c"),
            *(F.col(c).alias(f"{x}{c}") for c in side.columns if c.startswith("b")),
        )
        for side, x in ((left, "a"), (right, "b"))
    )
    both = left.join(right, F.expr(f"agram = bgram and {'a <> b' if leaders else 'a < b'} and ac <> bc and {first}"))
    if leaders:
        both = both.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, an, bn)").alias("an"), F.expr("if(a < b, bn, an)").alias("bn")
        )
    return both.select("a", "b", "an", "bn").distinct()


def jaccard_components(
    docs: DataFrame,
    k: int = 4,
    percent: int = 85,
    leaders: tuple[int, ...] = (6, 16, 32),
    bucket_bits: int = 16,
    filter_bits: int = 1 << 24,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text; other columns are
    ignored).

    A document's set: the distinct ``k``-word shingles of its words, A-Z lower-cased; with fewer words the
    whole sequence; without words or text the empty set, which links with nothing (its component is its
    own doc_id). Two documents link when 100 * intersection >= percent * union; equal sets always link.
    ``component_id`` is the smallest doc_id reachable. Repeated rows and ids each keep their row; a null
    doc_id takes the component of its text, which is null if all of its ids are. An empty table gives no
    rows. Shingles are compared by 64-bit hashes and equal sets by a 64-bit digest.

    ``bucket_bits`` and ``filter_bits`` bound what is broadcast (8 bytes a bucket, one bit each); they
    change the work, never the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    context = docs.sparkSession.sparkContext
    seen = saved(docs.mapInArrow(_classes(k, bucket_bits), "kind int, id long, n long, v long"), "classes")
    counts = np.zeros(1 << bucket_bits, np.int64)
    for bucket, n in seen.filter("kind = 1").groupBy("id").agg(F.sum("n")).collect():  # 2^bucket_bits at most
        counts[bucket] = n
    rank = np.empty(1 << bucket_bits, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << bucket_bits, dtype=np.uint64)

    ranks = context.broadcast(rank)
    stored = docs.mapInArrow(_incidence(k, percent, ranks, bucket_bits), "gram long, v long, n int, place int")
    # a task writes a set once; here each n-gram and set meet once, on the exchange that the columns need
    stored = stored.repartition("gram").groupBy("gram", "v").agg(F.first("n").alias("n"), F.first("place").alias("place"))
    by_size = Window.partitionBy("gram").orderBy("n", "v")
    stored = stored.withColumns({
        "before": F.lag(F.struct("n", "place")).over(by_size), "after": F.lead(F.struct("n", "place")).over(by_size),
        "third": F.coalesce(F.lag("n", 2).over(by_size), F.lead("n", 2).over(by_size)),
    })
    partner = F.coalesce("before", "after")
    pair = F.expr(_may_be_first("least(n, other.n)", "if(n <= other.n, place, other.place)", "greatest(n, other.n)", "if(n <= other.n, other.place, place)", percent))
    # within a column of three and more the middle row has neighbours on both sides
    two = F.col("third").isNull() & (F.col("before").isNull() | F.col("after").isNull())
    pair &= partner.isNotNull()
    sized = f"(100 * before.n >= {percent} * n) or (100 * n >= {percent} * after.n)"
    stored = stored.withColumn("other", partner).filter(F.coalesce(F.when(two, pair).otherwise(F.expr(sized)), F.lit(False)))
    stored = saved(stored.select("gram", "v", "n", "place"), "stored")
    ranks.destroy()
    sets = _sets_of(docs, stored.select("v"), k, filter_bits)
    short = sets.groupBy("v").agg(F.first("short").alias("short")).select("v", *(F.conv(F.hex(F.substring("short", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"bits{i}") for i in range(4)))

    labels, decided = None, []
    for turn, most in enumerate((*leaders, 0)):
        rows = stored.withColumn("c", F.col("v"))
        if labels is not None:
            rows = stored.join(labels.toDF("v", "c"), "v", "left").withColumn("c", F.coalesce("c", "v"))
        mixed = _mixed(rows, turn, most)
        pairs = _product(mixed, most, percent, short)
        for known in decided:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        tried = saved(pairs, "candidates")
        discard(mixed)
        decided.append(tried.select("a", "b"))
        pairs = _with_both(sets, tried, "bits")
        pairs = saved(pairs.mapInArrow(_close(percent), "a long, b long, an int, bn int"), "pairs")
        if pairs.isEmpty():
            continue
        links = _verified(sets, pairs, percent)
        if labels is not None:
            links = links.union(labels.toDF("b", "a").select("a", "b"))
        labels = saved(components(links), "labels")
    discard(stored, sets)

    member = seen.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "v")
    if labels is None:
        member = member.withColumn("c", F.col("v"))
    else:
        member = member.join(labels.toDF("v", "c"), "v", "left").withColumn("c", F.coalesce("c", "v"))
    lowest = member.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("low"))
    return member.join(lowest, "c", "left").select(
        "doc_id", "n_shingles", F.expr("if(c is null, doc_id, low)").alias("component_id")
    )
