"""SimHash near-duplicates through the generalised pigeonhole principle.

Fingerprints of 64 bits link at `max_bits` or fewer differing bits. The bits are dealt to m partitions, each with its
own threshold; if the thresholds add up to max_bits - m + 1, two linked fingerprints differ in at most the threshold in
one partition at least (a threshold of -1 leaves a partition out). Correlated bits are put into the same partition, so
that different partitions say different things. The thresholds come from a dynamic programme over the candidate counts
expected of each partition, and m is the number of partitions whose best plan costs least. All these counts are taken
over every distinct fingerprint.

Fingerprints that are equal are one node from the start. Those that share a partition's value, or a variant of it
within the threshold, meet in a run of rows and are compared there. A run of more than `block` rows is cut into blocks
and every pair of blocks meets in a task of its own; such runs give a star per connected part, not all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import NUMBER_BATCH_ROWS, map_arrow, slices, text_batches, text_list
from siftlake.llm.components import components
from siftlake.session import materialise

BITS = 64
#: Cost of a signature row in units of one comparison of two fingerprints.
ROW_COST = 30
#: Partitions that are tried.
PARTITIONS = (2, 3, 4)
#: Runs of at most so many rows give all their links, larger ones a star per connected part.
SMALL_RUN = 64


def shingle_hashes(text: str, words_each: int, seed: int) -> list[int]:
    """XXH64 of each shingle of the text's words, A-Z lower-cased; one of all words where there are fewer."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return []
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(x), seed) for x in zip(*(words[i:] for i in range(words_each)), strict=False)]


def fingerprints(docs: DataFrame, words_each: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a bit of fp is set if it is set in over half of the shingles' hashes; no words give 0."""
    text_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = text_list(batch.column(1))
        for begin, end in slices(texts):
            hashes = [shingle_hashes(x, words_each, seed) for x in texts[begin:end]]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for own in hashes for h in own), np.uint64, int(counts.sum()))
            result, has = np.zeros(len(hashes), np.uint64), np.flatnonzero(counts)
            if len(flat):
                bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[has], axis=0, dtype=np.int64)
                set_bits = (2 * ones > counts[has, None]).astype(np.uint8)
                result[has] = np.packbits(set_bits, axis=1, bitorder="little").copy().view("<u8").ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[begin:end], pa.array(result.view(np.int64))], names=["doc_id", "fp"]
            )

    return map_arrow(docs, run, "doc_id long, fp long", "doc_id", "text")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits how many have both set; 4,096 sums in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both, n = both + bits.T @ bits, n + len(own)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    sums = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(BITS * BITS + 1)
    for cell, n in sums.collect():
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits dealt to m partitions of nearly equal size, each filled with bits correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left -= set(own)
        while len(own) < size:
            own.append(max(sorted(left), key=lambda b: corr[b, own].sum()))
            left.discard(own[-1])
        parts.append(sorted(own))
    return parts


def within(differs: list[float], t: int) -> float:
    """The share of pairs that differ in at most t of these bits, taking the bits as independent."""
    shares = [1.0] + [0.0] * max(t, 0)
    for d in differs:
        for k in range(len(shares) - 1, -1, -1):
            shares[k] = shares[k] * (1 - d) + (shares[k - 1] * d if k else 0)
    return sum(shares) if t >= 0 else 0.0


def best_thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one for each partition, that add up to total at the least cost; by dynamic programming."""
    plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in plans.items():
            for t, extra in own.items():
                if spent + t not in grown or cost + extra < grown[spent + t][0]:
                    grown[spent + t] = (cost + extra, [*chosen, t])
        plans = grown
    return plans[total]


def allocate(nodes: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """The bits and the threshold of each partition in use."""
    n, both = bit_statistics(nodes)
    tried = {m: correlated_partitions(n, both, m) for m in PARTITIONS}
    masks = {(m, i): mask(bits) for m, parts in tried.items() for i, bits in enumerate(parts)}
    sets = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.lit(x).alias("x")) for (m, i), x in masks.items()])
    values = nodes.select("fp", F.explode(sets).alias("s")).select("s.m", "s.i", F.col("fp").bitwiseAND(F.col("s.x")).alias("v"))
    shared = values.groupBy("m", "i", "v").count().groupBy("m", "i").agg(F.sum(F.expr("count * (count - 1) / 2")).alias("n"))
    pairs = {(r["m"], r["i"]): r["n"] for r in shared.collect()}  # a number per partition tried
    p = np.diag(both) / max(n, 1)
    differs = 2 * p * (1 - p)
    best = None
    for m, parts in tried.items():
        costs = []
        for i, bits in enumerate(parts):
            own = {-1: 0.0}
            equal = max(within(differs[bits].tolist(), 0), 1e-30)
            for t in range(max_bits + 1):
                rows = sum(comb(len(bits), k) for k in range(t + 1))
                expected = max(pairs.get((m, i), 0), n * n / 2 * equal) * within(differs[bits].tolist(), t) / equal
                own[t] = ROW_COST * n * rows + expected
            costs.append(own)
        cost, thresholds = best_thresholds(costs, max_bits - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0])
    return best[1]


def mask(bits: tuple[int, ...] | list[int]) -> int:
    """The bits as a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links_of_run(fp: np.ndarray, first: np.ndarray, exact: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Links within runs of rows; first marks the first row of a run, exact the rows that are no variants.

    Fingerprints are unsigned: numpy counts the bits of a signed number's absolute value.
    """
    run = np.cumsum(first) - 1
    sizes = np.bincount(run)
    found = []
    small = np.flatnonzero(sizes[run] <= SMALL_RUN)
    step = 1
    while len(small):
        small = small[small + step < len(fp)]
        small = small[run[small] == run[small + step]]
        a, b = fp[small], fp[small + step]
        hit = (np.bitwise_count(a ^ b) <= max_bits) & (a != b) & (exact[small] | exact[small + step])
        found.append(np.stack([a[hit], b[hit]]))
        step += 1
    starts = np.cumsum(sizes) - sizes
    for k in np.flatnonzero(sizes > SMALL_RUN):
        own = np.unique(fp[starts[k] : starts[k] + sizes[k]])
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= max_bits
        label = np.arange(len(own))
        while True:
            lower = np.where(near, label[None, :], len(own)).min(1)
            if (lower == label).all():
                break
            label = lower
        star = np.flatnonzero(label != np.arange(len(own)))
        found.append(np.stack([own[star], own[label[star]]]))
    return found


def fingerprint_links(nodes: DataFrame, max_bits: int = 3, block: int = 512) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs of distinct fp at max_bits or less.

    Every linked pair of different fingerprints is compared; in crowded runs some pairs are only implied by a path.
    """
    text_batches(nodes.sparkSession, NUMBER_BATCH_ROWS)
    choices = []
    for part, (bits, t) in enumerate(allocate(nodes, max_bits)):
        flips = [()] + [c for k in range(1, t + 1) for c in combinations(bits, k)]
        choices += [(part, mask(bits), mask(x), not x) for x in flips]
    names = ("part", "mask", "flip", "exact")
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, row, strict=True)]) for row in choices])
    key = F.xxhash64("c.part", F.col("fp").bitwiseAND(F.col("c.mask")).bitwiseXOR(F.col("c.flip")))
    signed = nodes.select("fp", F.explode(table).alias("c")).select("fp", key.alias("key"), F.col("c.exact").alias("exact"))
    crowded = signed.groupBy("key").count().where(F.col("count") > block)
    crowded = crowded.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = signed.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks"))
    dealt = dealt.select("fp", "key", "exact", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = F.xxhash64("key", F.least("own", F.col("other").cast("long")), F.greatest("own", F.col("other").cast("long")))
    runs = dealt.select(met.alias("run"), "fp", "exact").repartition("run").sortWithinPartitions("run")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            run, fp, exact = columns
            first = np.append(True, run[1:] != run[:-1])
            found = links_of_run(fp.view(np.uint64), first, exact, max_bits)
            a, b = np.concatenate(found or [np.zeros((2, 0), np.uint64)], axis=1)
            ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

        for batch in batches:
            held = [np.append(h, c.to_numpy(zero_copy_only=False)) for h, c in zip(held, batch.columns, strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
            if cut:
                yield links([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield links(held)

    return runs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = 3, words_each: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint as 16 hex digits, and component_id, the smallest doc_id reachable.

    Null, empty and wordless texts have the fingerprint 0 and are linked like any other. Rows with equal doc_id stay
    rows of their own; a null doc_id is kept, and is a component_id only where the whole component has none. An empty
    table gives no rows. Other columns are ignored.
    """
    printed = materialise(fingerprints(docs, words_each), "fingerprints")
    text_batches(docs.sparkSession, NUMBER_BATCH_ROWS)
    nodes = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprint-nodes")
    links = materialise(fingerprint_links(nodes.select("fp"), max_bits).distinct(), "fingerprint-links")
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_print = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return printed.join(of_print, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, max_bits: int = 3) -> DataFrame:
    """The documents whose doc_id is the smallest of their component; equal rows of that doc_id are kept as they are."""
    found = near_duplicates(docs, max_bits)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
