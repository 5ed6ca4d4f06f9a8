"""SimHash near-duplicates: fingerprints, a binary-trie self-join, components.

Fingerprints are made in one narrow pass. Equal ones are folded first, so a
group of copies is one leaf whatever its size.

Trie join. Two fingerprints that differ in at most k of 64 bits, cut into
k + 1 blocks in a circle, have a block from which every run of j blocks holds
at most floor(j k / (k + 1)) differing bits. So k + 1 tries are joined with
themselves, each over the bits rotated to start at another block: node pairs
are followed from the root, differing bits are added up, and a pair is pruned
as soon as it exceeds the budget of its depth. The first block must be equal,
which is where the traversal starts. Nodes with more than ``leaf_size``
fingerprints are split in Spark, a few bits at a time, so no task ever gets
more than two bounded nodes; those pairs are finished inside tasks, bit by bit,
for all pairs of a partition at once.

Components come from the links by large-star and small-star rounds, each
checkpointed; only distinct fingerprints that have links take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm.common import broadcast_if_small, pick_rows, stored, table

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of a trie node that a task joins in memory.
LEAF_SIZE = 4096
#: Bits by which larger nodes are split in one round.
STEP_BITS = 3


# ---- fingerprints -------------------------------------------------------

def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])] or [digest(line, SEED)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i:i + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def add_fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text",
                     shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp``: the fingerprint's 64 bits as a signed long. Words are
    runs of characters other than space and x09-x0D; A-Z are lower-cased. Null
    texts count as empty, and a text without words has fingerprint zero."""
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    slim = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return slim.mapInArrow(run, schema)


# ---- trie self-join -----------------------------------------------------

def block_widths(k: int) -> list[int]:
    return [64 // (k + 1) + (i < 64 % (k + 1)) for i in range(k + 1)]


def rotation(k: int, r: int) -> tuple[int, list[int]]:
    """Bits to rotate left by, and the budget of differing bits at each depth 0..64."""
    widths = block_widths(k)
    shift = sum(widths[:r]) % 64
    budget, j = [0], 0
    for w in widths[r:] + widths[:r]:
        j += 1
        budget += [j * k // (k + 1)] * w
    return shift, budget


def _rotated(fp, shift: int):
    return fp if shift == 0 else F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, 64 - shift))


def _prefix(rot, depth: int):
    return rot if depth == 64 else F.shiftrightunsigned(rot, 64 - depth)


def node_pairs(rotated: DataFrame, k: int, leaf_size: int, step: int) -> list[tuple[int, int, DataFrame | None]]:
    """For each rotation, node pairs (a, b) with at most ``leaf_size`` leaves
    each, as (rotation, depth, frame); None stands for every node with itself."""
    counts = {}
    found = []
    for r in range(k + 1):
        _, budget = rotation(k, r)
        depth = block_widths(k)[r]
        mine = rotated.filter(F.col("r") == r)
        nodes = mine.groupBy(_prefix(F.col("rot"), depth).alias("n")).count()
        counts[r] = stored(nodes.filter(F.col("count") > leaf_size), "trie-large")
        if counts[r].isEmpty():
            found.append((r, depth, None))
            continue
        small = nodes.filter(F.col("count") <= leaf_size)
        found.append((r, depth, stored(small.select(F.col("n").alias("a"), F.col("n").alias("b"),
                                                    F.lit(0).alias("err")), "trie-pairs")))
        pairs = counts[r].select(F.col("n").alias("a"), F.col("n").alias("b"), F.lit(0).alias("err"))
        while True:
            below = min(64, depth + step)
            by = below - depth
            child = (mine.groupBy(_prefix(F.col("rot"), below).alias("c")).count()
                     .withColumn("p", F.shiftrightunsigned("c", by)))
            child = stored(child, "trie-children")
            left = child.select(F.col("p").alias("a"), F.col("c").alias("a2"), F.col("count").alias("na"))
            right = child.select(F.col("p").alias("b"), F.col("c").alias("b2"), F.col("count").alias("nb"))
            apart = F.bit_count(F.col("a2").bitwiseXOR(F.col("b2"))).cast("int")
            # differing bits of the prefixes so far are those of the whole child prefixes
            pairs = stored(pairs.select("a", "b").join(left, "a").join(right, "b")
                           .withColumn("err", apart)
                           .filter((F.col("err") <= budget[below])
                                   & ((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))))
                           .select(F.col("a2").alias("a"), F.col("b2").alias("b"), "err", "na", "nb"), "trie-pairs")
            depth = below
            large = (F.col("na") > leaf_size) | (F.col("nb") > leaf_size)
            if depth == 64:
                large = F.lit(False)
            found.append((r, depth, pairs.filter(~large).select("a", "b", "err")))
            pairs = pairs.filter(large)
            if pairs.isEmpty():
                break
    return found


def _join_leaves(rots, group, side, self_pair, depth, budgets, k):
    """Links between the leaves of node pairs, for all pairs of a batch at once.

    ``rots``: unsigned fingerprints sorted within (group, side). Returns index
    pairs of leaves that differ in at most ``k`` bits.
    """
    import numpy as np

    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[starts[1:], len(rots)]
    g, s = group[starts], side[starts]
    first = s == 0
    a_lo, a_hi = starts[first], ends[first]
    own = self_pair[a_lo]
    other = dict(zip(g[~first].tolist(), np.flatnonzero(~first).tolist(), strict=True))
    at = np.array([other.get(x, -1) for x in g[first].tolist()], dtype=np.int64)
    keep = own | (at >= 0)
    a_lo, a_hi, own, at = a_lo[keep], a_hi[keep], own[keep], at[keep]
    b_lo, b_hi = np.where(own, a_lo, starts[at]), np.where(own, a_hi, ends[at])
    rot_of = budgets[1][a_lo]  # which budget line each pair follows
    d = depth[a_lo].astype(np.int64)
    err = np.zeros(len(a_lo), dtype=np.int64)
    if len(a_lo):
        cut = np.where(d >= 64, 0, 64 - d).astype(np.uint64)
        diff = np.where(d > 0, (rots[a_lo] >> np.minimum(cut, 63)) ^ (rots[b_lo] >> np.minimum(cut, 63)), 0)
        diff = np.where(d >= 64, rots[a_lo] ^ rots[b_lo], diff)
        err = np.bitwise_count(diff.astype(np.uint64)).astype(np.int64)
    lines = budgets[0]
    for t in range(int(d.min()) if len(d) else 64, 64):
        bit = (rots >> np.uint64(63 - t)) & np.uint64(1)
        ones = np.r_[0, np.cumsum(bit.astype(np.int64))]
        wait = d > t  # pairs that start deeper
        am, bm = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        n = len(a_lo)
        parts = [
            (a_lo, am, b_lo, bm, own, err), (am, a_hi, bm, b_hi, own, err),
            (a_lo, am, bm, b_hi, np.zeros(n, bool), err + 1), (am, a_hi, b_lo, bm, np.zeros(n, bool), err + 1)]
        limit = lines[rot_of, t + 1]
        kept = []
        for i, (al, ah, bl, bh, o, e) in enumerate(parts):
            ok = ~wait & (al < ah) & (bl < bh) & (e <= limit)
            if i == 3:
                ok &= ~own
            kept.append((al[ok], ah[ok], bl[ok], bh[ok], o[ok], e[ok], rot_of[ok], d[ok]))
        kept.append((a_lo[wait], a_hi[wait], b_lo[wait], b_hi[wait], own[wait], err[wait], rot_of[wait], d[wait]))
        a_lo, a_hi, b_lo, b_hi, own, err, rot_of, d = (np.concatenate(x) for x in zip(*kept, strict=True))
        # a node of one leaf joined with itself has no links left
        done = own & (a_hi - a_lo == 1)
        if done.any():
            a_lo, a_hi, b_lo, b_hi, own, err, rot_of, d = (x[~done] for x in (a_lo, a_hi, b_lo, b_hi, own, err, rot_of, d))
    ok = ~own & (err <= k)
    return a_lo[ok], b_lo[ok]


def trie_links(fps: DataFrame, k: int = MAX_BITS, leaf_size: int = LEAF_SIZE, step: int = STEP_BITS) -> DataFrame:
    """Pairs (u, v), u < v, of distinct values of ``fp`` that differ in 1 to ``k`` bits."""
    if not 1 <= k <= 15:
        raise ValueError("k must be 1 to 15")
    rotated = None
    for r in range(k + 1):
        one = fps.select(F.lit(r).alias("r"), _rotated(F.col("fp"), rotation(k, r)[0]).alias("rot"))
        rotated = one if rotated is None else rotated.unionAll(one)
    parts = []
    for r, depth, pairs in node_pairs(rotated, k, leaf_size, step):
        leaves = rotated.filter(F.col("r") == r).withColumn("n", _prefix(F.col("rot"), depth))
        if pairs is None:
            parts.append(leaves.select("r", F.lit(depth).alias("depth"), F.col("n").alias("a"), F.col("n").alias("b"),
                                       F.lit(0).alias("side"), "rot"))
            continue
        for side, node in ((0, "a"), (1, "b")):
            use = pairs if side == 0 else pairs.filter("a != b")
            parts.append(use.join(leaves, F.col(node) == F.col("n")).select(
                "r", F.lit(depth).alias("depth"), "a", "b", F.lit(side).alias("side"), "rot"))
    members = parts[0]
    for p in parts[1:]:
        members = members.unionAll(p)
    members = (members.withColumn("u", F.col("rot").bitwiseXOR(F.lit(-(1 << 63))))  # sorts as unsigned
               .repartition("r", "depth", "a", "b").sortWithinPartitions("r", "depth", "a", "b", "side", "u")
               .select("r", "depth", "a", "b", "side", "rot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lines = np.array([rotation(k, r)[1] for r in range(k + 1)], dtype=np.int64)
        shifts = np.array([rotation(k, r)[0] for r in range(k + 1)], dtype=np.uint64)
        names = ("r", "depth", "a", "b", "side", "rot")
        rest = None

        def links(cols):
            new = np.r_[True, np.zeros(len(cols["r"]) - 1, bool)]
            for c in ("r", "depth", "a", "b"):
                new[1:] |= cols[c][1:] != cols[c][:-1]
            rots = cols["rot"].view(np.uint64)
            i, j = _join_leaves(rots, np.cumsum(new), cols["side"], cols["a"] == cols["b"],
                                cols["depth"], (lines, cols["r"]), k)
            back = shifts[cols["r"][i]]
            def unrotate(x):
                return np.where(back == 0, x, (x >> back) | (x << ((np.uint64(64) - back) & np.uint64(63))))
            u, v = unrotate(rots[i]).view(np.int64), unrotate(rots[j]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            if rest is not None:
                cols = {n: np.concatenate([rest[n], cols[n]]) for n in names}
            # the last node pair may go on in the next batch
            same = np.ones(len(cols["r"]), bool)
            for c in ("r", "depth", "a", "b"):
                same &= cols[c] == cols[c][-1]
            whole = int(np.argmax(same)) if same.any() else len(same)
            rest = {n: x[whole:].copy() for n, x in cols.items()}
            if whole:
                yield links({n: x[:whole] for n, x in cols.items()})
        if rest is not None:
            yield links(rest)

    return members.mapInArrow(run, "u long, v long").distinct()


# ---- components ---------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``links`` (u, v): root is the smallest vertex
    reachable. Star rounds: every vertex hands its smallest neighbour to its
    larger ones, then to its smaller ones, until nothing changes."""
    edges = stored(links.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u"))
                   .filter("u != v").distinct(), "cc-edges")
    while True:
        # large star: neighbours above v go to the smallest of v and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("v").alias("c")).agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = (both.filter("u > v").join(least, F.col("v") == F.col("c"))
                 .select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        # small star: neighbours below v, and v, go to the smallest of them
        low = large.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        joined = large.join(low, F.col("v") == F.col("c"))
        new = stored(joined.select(F.col("u").alias("v"), F.col("m").alias("u"))
                     .unionAll(low.select(F.col("c").alias("v"), F.col("m").alias("u")))
                     .filter("u != v").distinct(), "cc-edges")
        # stars: every vertex has one edge, and no centre is a leaf
        state = new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("d")).first()
        if state["n"] == state["d"] and new.join(new.select(F.col("v").alias("w")), F.col("u") == F.col("w"),
                                                 "left_semi").isEmpty():
            return new.select("v", F.col("u").alias("root")).unionAll(
                new.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())
        edges = new


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, leaf_size: int = LEAF_SIZE, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (64 bits as a long), component_id
    (smallest id reachable over links of at most ``max_bits`` bits, itself
    included), component_fp (the same for all rows of a component), and the
    further ``keys`` of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Null
    ids never name a component; one of null ids only has component_id null.
    Repeated rows come out once each. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), *keys, F.col(text_col).alias("__body"))
    marked = stored(add_fingerprints(slim, ["doc_id", *keys], "__body", shingle), "simhash")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = trie_links(fps.select("fp"), max_bits, leaf_size)
    comp = components(links)
    rooted = (fps.join(comp, F.col("fp") == F.col("v"))
              .select("fp", "least", "root"))
    rooted = stored(rooted, "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(named, "root").select("fp", "component_id", F.col("root").alias("component_fp"))
    of_fp = (fps.join(broadcast_if_small(stored(linked, "simhash-linked")), "fp", "left")
             .select("fp", F.when(F.col("component_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
                     F.coalesce("component_fp", "fp").alias("component_fp")))
    return marked.join(of_fp, "fp").select("doc_id", *keys, "fp", "component_id", "component_fp")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id, with the
    columns of ``docs``; of a component of null ids only, one of its rows."""
    content = F.xxhash64("text")
    found = simhash_groups(docs.withColumn("__content", content), keys=("__content",))
    # rows of one id and text are one document; of a component the smallest id counts, nulls last
    rows = found.groupBy("component_fp", "doc_id", "__content").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__content", "times")).alias("f")
    kept = rows.groupBy("component_fp").agg(first).select("f.doc_id", "f.__content", "f.times")
    return pick_rows(docs, kept, {"doc_id": F.col("doc_id"), "__content": content})


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
