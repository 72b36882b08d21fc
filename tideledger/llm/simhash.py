"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text gets a 64-bit majority fingerprint of its word shingles. Two
fingerprints within `distance` bits link, and linked documents form a
component. The search for links:

1. Bit statistics (64 means, 64 x 64 products) over all distinct fingerprints
   group correlated bits into partitions, so that what one partition selects is
   as independent as possible of the others.
2. If every partition i has a threshold t_i >= -1 and the sum of (t_i + 1) is
   distance + 1, a linked pair differs by at most t_i bits in some partition i.
   Dynamic programming picks the thresholds (and the number of partitions)
   of least estimated cost: probe keys plus candidate pairs.
3. Each fingerprint emits its probe keys: a partition's value with every choice
   of t_i bits masked. Fingerprints that share a key are candidates; groups of
   at most `group_limit` are verified bit by bit.
4. A larger group (a cluster of near copies) is not compared pair by pair: its
   members emit every value within half the distance. Two members share such a
   value exactly if they link, and no value has more members than the ball has
   points, so this way is linear and loses nothing.
5. Verified groups return a spanning forest of their links, and components grow
   from those by alternating large-star and small-star steps.

Of these only bit statistics and a bounded sample reach the driver. `keep_one` verifies the texts of
linked fingerprints by their shingles and completes the search by an index of
shingles (`similar_texts`); for that a table of shingle counts of fixed size
reaches the driver. Edge cases: a null text is empty; a text
without words has fingerprint zero and links like any other; a shorter text
than a shingle is one shingle; exact copies share one fingerprint and are one
node of the search; rows with a null doc_id take part and never name a
component unless no other member has an id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideledger.llm.common import SEGMENT_BYTES, batch_tokens, byte_groups, checkpointed, discard, few, in_small_batches, pack, packed, read_table, release, splitmix, text_bytes, unpack, written

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
GROUP_LIMIT = 4096
#: Fingerprints whose pairs estimate how many candidates a partition gives.
SAMPLE = 2048
VERIFY_WORDS = 5
SIMILARITY = 0.8
CELLS = 1 << 20
#: Cells whose counts a task sends in one row.
COUNT_BLOCK = 1 << 14
BLOCK = 1024
#: Members up to which a shingle's group is compared in the JVM.
SMALL_GROUP = 64
#: Cells whose parities bound how many shingles two texts share; a multiple of 64.
PARITIES = 2048
HOT_PAIRS = 1024
#: Rows of one shingle that one task may get.
HOT_ROWS = 20_000
#: Rows of two numbers that may be broadcast; more of them are joined by a shuffle.
MAX_BROADCAST = 500_000


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(itertools.accumulate(map(len, tokens), lambda a, b: a + 1 + b))
    starts = [0, *[e + 1 for e in ends[: len(tokens) - words]]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=True)]
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 4096):
        block = np.array(hashes[low : low + 4096], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    @F.arrow_udf("long")
    def udf(text: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t, words, seed) for t in text_bytes(text)], np.uint64)
        return pa.array(values.view(np.int64))

    return udf


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 counts of bits set together."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, together = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(values), 1 << 16):
                bits = _bits(values[low : low + (1 << 16)]).astype(np.float32)
                together += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(BITS * BITS)], pa.int64()), pa.array([float(n), *together.ravel()])], names=["cell", "n"])

    sums = dict(prints.select("fp").mapInArrow(partial, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect())
    return int(sums.get(-1, 0)), np.array([sums.get(k, 0.0) for k in range(BITS * BITS)]).reshape(BITS, BITS)


def correlated_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into equal parts, each grown around a seed from the bits most correlated with it."""
    mean = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    related = np.abs((together / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = math.ceil(len(left) / (parts - k))
        group = [max(left, key=lambda b: (sum(related[b][c] for c in left), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (sum(related[b][c] for c in group), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def print_sample(prints: DataFrame, n: int, most: int = SAMPLE) -> np.ndarray:
    """About `most` fingerprints, chosen by a hash; they only estimate costs."""
    some = prints.filter(F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(max(1, n // most))) == 0).select("fp").limit(2 * most)
    return np.sort(np.array([r.fp for r in some.collect()], np.int64)).view(np.uint64)


def pair_share(n: int, together: np.ndarray, sample: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ by at most 0, 1, ... `most` bits of the group.

    Counted over the pairs of a sample, which sees how the group's bits hang
    together, and at least what independent bits would give, for shares that
    are too small for a sample.
    """
    mean = np.diag(together) / max(n, 1)
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for b in group:
        differ = 2 * mean[b] * (1 - mean[b])
        ways = ways * (1 - differ) + np.concatenate([[0.0], ways[:-1]]) * differ
    counts, pairs = np.zeros(BITS + 1), max(1, len(sample) * (len(sample) - 1) // 2)
    mask = np.uint64(sum(1 << b for b in group))
    for i in range(len(sample) - 1):
        counts += np.bincount(np.bitwise_count((sample[i + 1 :] ^ sample[i]) & mask), minlength=BITS + 1)
    return list(np.maximum(np.cumsum(ways), np.cumsum(counts)[: most + 1] / pairs))


def allocate(n: int, together: np.ndarray, sample: np.ndarray, groups: list[list[int]], distance: int, key_cost: float = 1.0, pair_cost: float = 0.01) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) whose (t + 1) sum to distance + 1, of least cost by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        share = pair_share(n, together, sample, group, distance)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(distance - used, len(group) - 1) + 1):
                more = 0.0 if t < 0 else key_cost * n * math.comb(len(group), t) + pair_cost * n * n / 2 * share[t]
                if used + t + 1 not in step or cost + more < step[used + t + 1][0]:
                    step[used + t + 1] = cost + more, [*chosen, t]
        best = step
    return best[distance + 1]


def plan(n: int, together: np.ndarray, sample: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The partitions to probe with their thresholds."""
    n = max(n, 2)  # with no pairs every plan would be free, and the one with most keys as good as any
    options = []
    for parts in range(1, distance + 3):
        groups = correlated_groups(n, together, parts)
        cost, thresholds = allocate(n, together, sample, groups, distance)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _probe_keys(prints: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    probes = []
    for i, (group, t) in enumerate(chosen):
        whole = sum(1 << b for b in group)
        for j, masked in enumerate(itertools.combinations(group, t)):
            mask = whole & ~sum(1 << b for b in masked)
            probes.append(F.struct(F.lit(i * 100_000 + j).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value")))
    return prints.select("fp", F.inline(F.array(*probes)))


def _ball(prints: DataFrame, radius: int) -> DataFrame:
    masks = [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in itertools.combinations(range(BITS), r)]
    flips = F.array(*[F.lit(m) for m in masks])
    return prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.lit(-1).alias("probe"), F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints, by breadth-first search."""
    left, links = values.astype(np.int64), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= distance
            links += [(int(at), int(v)) for v in left[near]]
            reached += list(left[near])
            left = left[~near]
    return links


def _verified(groups: DataFrame, distance: int) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat, offsets = members.flatten().to_numpy(zero_copy_only=False), members.offsets.to_numpy()
            links = [x for s, e in itertools.pairwise(offsets) for x in spanning_links(flat[s:e], distance)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return groups.select("members").mapInArrow(verify, "a long, b long")


def links(prints: DataFrame, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the distance, enough of them to connect every linked pair."""
    n, together = bit_statistics(prints)
    keyed = _probe_keys(prints, plan(n, together, print_sample(prints, n), distance))
    sizes = checkpointed(keyed.groupBy("probe", "value").count().filter("count > 1"))
    gathered = F.collect_list("fp").alias("members")
    small = keyed.join(sizes.filter(F.col("count") <= group_limit), ["probe", "value"]).groupBy("probe", "value").agg(gathered)
    large = sizes.filter(F.col("count") > group_limit).drop("count")
    if not large.isEmpty():
        crowded = keyed.join(large, ["probe", "value"], "left_semi").select("fp").distinct()
        ball = _ball(crowded, (distance + 1) // 2).groupBy("probe", "value").agg(gathered).filter(F.size("members") > 1)
        small = small.unionByName(ball)
    return _verified(small, distance).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the smallest node it reaches.

    Large-star and small-star steps until nothing changes; each round is
    checkpointed, none collects nodes or edges.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.filter("u <> v").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every document."""
    column = F.col(f"`{text}`")
    prints = checkpointed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(column).alias("text_hash"), _fingerprints(words, SEED)(column).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), distance))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(placed.select("fp", "root").join(named, "root"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; texts without words have one shingle, the same for all."""
    factors = splitmix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for low, high in byte_groups(texts, SEGMENT_BYTES):
        hashes, counts = batch_tokens([t.lower() for t in texts[low:high]])
        sums = np.zeros(len(hashes), np.uint64)
        for k in range(words):
            sums[: len(hashes) - k] += hashes[k:] * factors[k]
        at = 0
        for n in counts.tolist():
            if n >= words:
                found = sums[at : at + n - words + 1]
            else:
                found = np.array([(hashes[at : at + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)])
            yield np.unique(splitmix(found))
            at += n


def _sets(words: int):
    @F.arrow_udf("array<long>")
    def udf(text: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for s in shingle_sets(text_bytes(text), words)], pa.list_(pa.int64()))

    return udf


def shingle_counts(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How often shingles of all texts fall into each of CELLS cells: of no shingle are there more texts than its cell's count.

    Each task sends its counts as compressed blocks of cells, at most a byte or so a cell however many shingles it read.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in shingle_sets(text_bytes(batch.column(0)), words):
                np.add.at(counts, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
        found = [(i, pack(block)) for i, block in enumerate(counts.reshape(-1, COUNT_BLOCK)) if block.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + unpack(blob)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block long, counts binary"
    found = in_small_batches(docs).select(F.col(f"`{text}`")).mapInArrow(partial, schema).repartition("block").mapInArrow(total, schema).collect()
    counts = np.zeros((CELLS // COUNT_BLOCK, COUNT_BLOCK), np.int64)
    for row in found:
        counts[row.block] = np.frombuffer(row.counts, np.int64)
    return counts.ravel()


def majority(hashes: np.ndarray) -> np.uint64:
    """Bit k is set if it is set in over half of the hashes."""
    sums = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 14):
        sums += np.unpackbits(hashes[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls into each of PARITIES cells, as 64-bit words."""
    cells = np.bincount((hashes >> np.uint64(32)) % np.uint64(PARITIES), minlength=PARITIES) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8")


SKETCH = "struct<n:int,fp:long,parity:array<long>,prefix:array<long>,salts:array<int>>"


def _sketches(words: int, similarity: float, counts: np.ndarray):
    """Of each text: its number of shingles, its fingerprint, the parities of its shingles, and its rarest shingles, as many as one of any near copy's must be among.

    salts: into how many parts the rows of each of these shingles are dealt; null if none needs more than one.
    """

    @F.arrow_udf(SKETCH)
    def udf(text: pa.Array) -> pa.Array:
        sizes, prints, parity, prefixes, salts = [], [], [], [], []
        for s in shingle_sets(text_bytes(text), words):
            often = counts[(s & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((s, often))
            order = order[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
            parts = -(-often[order] // HOT_ROWS)
            sizes.append(len(s))
            prints.append(majority(s))
            parity.append(parities(s))
            prefixes.append(s[order].view(np.int64))
            salts.append(np.maximum(parts, 1).astype(np.int32) if (parts > 1).any() else None)
        columns = [pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(parity, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(columns, names=["n", "fp", "parity", "prefix", "salts"])

    return udf


def _can_be_similar(n: Column, pos: Column, n2: Column, pos2: Column, similarity: float) -> Column:
    """Whether texts of n and n2 shingles whose first common one stands at these positions can reach the similarity."""
    most = F.least(n - pos, n2 - pos2)
    return most >= F.lit(similarity) * (n + n2 - most) - 1e-9


def _candidates(blocks: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) across the arrays left and right of (node, n, pos, root), of other roots, that can still be similar.

    A pair's first common shingle, at positions p and q, leaves at most
    min(n - p, m - q) shingles to share.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in batch.columns:
                offsets, flat = column.offsets.to_numpy(), column.flatten()
                sides.append((offsets - offsets[0], [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]))
            (ls, left), (rs, right) = sides
            for k in range(len(ls) - 1):
                node, n, pos, root = (x[ls[k] : ls[k + 1], None] for x in left)
                node2, n2, pos2, root2 = (x[rs[k] : rs[k + 1]] for x in right)
                most = np.minimum(n - pos, n2 - pos2)
                a, b = np.nonzero((root != root2) & (most >= similarity * (n + n2 - most) - 1e-9))
                a, b = node[a, 0], node2[b]
                found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return in_small_batches(blocks).select("left", "right").mapInArrow(pairs, "a long, b long").distinct()


def plausible(pairs: DataFrame, index: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs that can have the similarity by their parities.

    Every cell whose parities differ holds a shingle of just one of the texts,
    so at most (n + m - cells) / 2 are shared: a bound that loses no pair.
    """
    of = lambda c: index.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    cells = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITIES // 64)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    shared = (total - cells) / 2
    return checkpointed(both.filter(shared >= F.lit(similarity) * (total - shared) - 1e-9).select("a", "b"))


def _verified_copies(pairs: DataFrame, index: DataFrame, docs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """The candidate pairs whose texts' shingle sets have at least the similarity; salts spread a hot text's pairs."""
    pairs = plausible(pairs, index, similarity)
    wanted = checkpointed(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    nodes = F.broadcast(wanted) if few(wanted, MAX_BROADCAST) else wanted
    column = F.col(f"`{text}`")
    texts = docs.select(F.xxhash64(column).alias("node"), column.alias("_text")).join(nodes, "node", "left_semi")
    sets = checkpointed(texts.select("node", _sets(words)("_text").alias("set")).dropDuplicates(["node"]))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT_PAIRS).cast("int").alias("salts"))
    mine = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).join(sets.select(F.col("node").alias("b"), "set"), "b")
    hubs = salts.join(sets, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("set").alias("hub_set"))
    shared, total = F.size(F.array_intersect("set", "hub_set")), F.size("set") + F.size("hub_set")
    found = checkpointed(mine.join(hubs, ["a", "salt"]).filter(shared >= F.lit(similarity) * (total - shared)).select("a", "b"))
    release(docs.sparkSession)
    return found


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def fingerprint_pairs(index: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of texts to verify, from fingerprints: each text with the first of its fingerprint, and the firsts of linked fingerprints."""
    first = checkpointed(index.groupBy("fp").agg(F.min("node").alias("first")))
    same = index.join(first, "fp").filter("node <> first").select(*_ordered(F.col("node"), F.col("first")))
    linked = links(first.select("fp"), distance).select(F.col("a").alias("fp"), F.col("b").alias("fp_b"))
    near = linked.join(first, "fp").select(F.col("first").alias("a"), F.col("fp_b").alias("fp")).join(first, "fp").select(*_ordered(F.col("a"), F.col("first")))
    return same.unionByName(near)


def shingle_rows(index: DataFrame) -> DataFrame:
    """(shingle, hot, node, place, hub, hub_place): the rarest shingles that texts share, each text beside its group's first.

    place: the text's number of shingles and the shingle's position in one
    number. A shingle of more than HOT_ROWS texts (hot: itself, else null) is
    dealt into groups under names of their own, and is listed in whole.
    """
    each = index.select("node", F.shiftleft(F.col("n").cast("long"), 32).alias("n"), "salts", F.posexplode("prefix").alias("pos", "shingle"))
    parts = F.coalesce(F.get("salts", F.col("pos")), F.lit(1))
    salted = F.when(parts > 1, F.xxhash64("shingle", F.pmod(F.xxhash64("node"), parts))).otherwise(F.col("shingle"))
    rows = each.select(salted.alias("group"), F.when(parts > 1, F.col("shingle")).alias("hot"), "node", (F.col("n") + F.col("pos")).alias("place"))
    group = W.partitionBy("group")
    seen = rows.withColumn("first", F.min(F.struct("node", "place")).over(group)).withColumn("members", F.count("*").over(group)).filter("members > 1 or hot is not null")
    return seen.select(F.coalesce("hot", "group").alias("shingle"), "hot", "node", "place", F.col("first.node").alias("hub"), F.col("first.place").alias("hub_place"))


def _n(place: Column) -> Column:
    return F.shiftright(place, 32)


def _pos(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1))


def _near(place: Column, place2: Column, similarity: float) -> Column:
    """Whether texts with these places of a shingle, the first that they share, can reach the similarity."""
    return _can_be_similar(_n(place), _pos(place), _n(place2), _pos(place2), similarity)


def hub_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) to verify: each text with the first of its group, and the firsts of a hot shingle's groups with the first of all."""
    own = shared.filter("node <> hub").filter(_near(F.col("place"), F.col("hub_place"), similarity)).select(*_ordered(F.col("node"), F.col("hub")))
    hubs = shared.filter("node = hub and hot is not null").select("hot", F.struct("node", "place").alias("h"))
    firsts = hubs.groupBy("hot").agg(F.min("h").alias("least"))
    between = hubs.join(firsts, "hot").filter("h.node <> least.node").filter(_near(F.col("h.place"), F.col("least.place"), similarity))
    return own.unionByName(between.select(*_ordered(F.col("h.node"), F.col("least.node")))).distinct()


def group_pairs(groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the members (node, place, root) of each group that no link connects yet and that can be similar.

    Small groups are compared in the JVM, larger ones in blocks of pairs.
    """
    size = F.size("members")
    each = groups.filter(size <= SMALL_GROUP).select(F.explode("members").alias("x"), "members").select("x", F.explode("members").alias("y"))
    fit = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _near(F.col("x.place"), F.col("y.place"), similarity)
    small = each.filter(fit).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    members = F.transform("members", lambda m: F.struct(m["node"].alias("node"), _n(m["place"]).alias("n"), _pos(m["place"]).alias("pos"), m["root"].alias("root")))
    large = groups.filter(size > SMALL_GROUP).select("shingle", members.alias("members"))
    last = F.floor((F.size("members") - 1) / BLOCK).cast("int")
    at = lambda i: F.slice("members", F.col(i) * BLOCK + 1, F.lit(BLOCK))
    blocks = large.withColumn("last", last).withColumn("i", F.explode(F.sequence(F.lit(0), "last"))).withColumn("j", F.explode(F.sequence("i", "last")))
    blocks = blocks.select("shingle", "i", "j", at("i").alias("left"), at("j").alias("right")).repartition("shingle", "i", "j")
    return small.unionByName(_candidates(blocks, similarity)).distinct()


def similar_texts(docs: DataFrame, text: str = "text", words: int = VERIFY_WORDS, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """(node, root): the texts, by hash, that have near copies, with the smallest hash of their component.

    All pairs of distinct texts with the similarity end in one component. The
    generalised pigeonhole search finds fingerprints of the shingles within
    `distance` bits, and their texts are to be verified. Fingerprints of texts at the
    similarity itself lie some ten bits apart, beyond any search of the kind, so
    prefix filters complete it: with shingles in one order for all texts, two similar texts share one among the first
    n - ceil(similarity * n) + 1 of each. Any order is right; rare shingles
    first makes few candidates. In the group of a shingle each member is
    verified against one of them, and after that all pairs that links don't
    connect yet, so a cluster of near copies is not compared pair by pair;
    blocks of pairs spread a hot group.
    """
    spark, column = docs.sparkSession, F.col(f"`{text}`")
    counts = shingle_counts(docs, text, words)
    sketched = in_small_batches(docs).select(F.xxhash64(column).alias("node"), _sketches(words, similarity, counts)(column).alias("p")).dropDuplicates(["node"])
    index = written(sketched.select("node", "p.*"), "sketches")
    release(spark)
    shared = written(shingle_rows(index), "shared")
    release(spark)
    pairs = checkpointed(fingerprint_pairs(index.select("node", "fp"), distance).unionByName(hub_pairs(shared, similarity)).distinct())
    edges = _verified_copies(pairs, index, docs, text, words, similarity)
    roots = checkpointed(components(edges))
    release(spark)
    rooted = shared.select("shingle", "node", "place").join(F.broadcast(roots) if few(roots, MAX_BROADCAST) else roots, "node", "left").select("shingle", "node", "place", F.coalesce("root", "node").alias("root"))
    unsettled = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    groups = rooted.join(unsettled, "shingle").groupBy("shingle").agg(F.collect_list(F.struct("node", "place", "root")).alias("members"))
    rest = group_pairs(groups, similarity)
    rest = checkpointed(rest.join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        roots = checkpointed(components(edges.unionByName(_verified_copies(rest, index, docs, text, words, similarity))))
    for table in (index, shared):
        discard(table)
    return roots


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = VERIFY_WORDS, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (a null id only if none has one).

    Near copies are equal texts, and texts whose shingles of `words` words have
    a Jaccard similarity of at least `similarity`; groups are the components of
    these links, each verified. Columns pass through whatever their names; of
    rows with equal id and text one stays.
    """
    column = F.col(f"`{text}`")
    order = F.struct(F.col(f"`{doc_id}`").isNull().alias("no_id"), F.col(f"`{doc_id}`").alias("id"))
    each = checkpointed(docs.select(F.xxhash64(column).alias("hash"), order.alias("k")).groupBy("hash", "k").agg(F.count("*").alias("rows")))
    least = each.groupBy("hash").agg(F.min(F.struct("k", "rows")).alias("m")).select("hash", "m.k", "m.rows")
    roots = similar_texts(docs, text, words, similarity, distance)
    grouped = least.join(roots, least.hash == roots.node, "left").select(F.coalesce("root", "hash").alias("root"), F.struct("k.no_id", "k.id", "hash", "rows").alias("k"))
    kept = checkpointed(grouped.groupBy("root").agg(F.min("k").alias("k")).select("k.id", "k.hash", "k.rows"))
    rows = packed(docs).withColumn("row_hash", F.xxhash64(F.col(f"row.`{text}`"))).withColumn("row_id", F.col(f"row.`{doc_id}`"))
    same = F.col("id").eqNullSafe(F.col("row_id")) & (F.col("hash") == F.col("row_hash"))
    found = rows.join(kept.select("id", "hash"), same, "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        found = found.dropDuplicates(["row_id", "row_hash"])
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
