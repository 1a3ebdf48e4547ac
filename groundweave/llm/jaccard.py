"""Documents linked by the Jaccard similarity of their word shingles, and the components of those links.

Adaptive multi-match prefixes: a set of n shingles, in one global order from rare to
frequent, has for each l = 1, 2, ... a prefix of n - ceil(t n) + l shingles; two sets of
similarity t or more share at least min(l, l') shingles of their prefixes. Each document
takes the l of least estimated cost: postings that its prefix makes, and candidates that
they bring, from the frequencies of a sketch over all documents.

1. One pass over the texts gives each document's set size, set hash and parity bits (a bit
   for about each shingle: whether an odd number of them falls on it), and the sketch
   (fixed size, summed over all tasks). Documents of equal sets are one node, named by the hash.
2. A second pass sends prefixes as packed postings to partitions by shingle, as many as
   their number asks for. There every node of a bucket (the nodes of one shingle) is a
   candidate with the bucket's leader, the node with fewest rare shingles before it: linear
   in the postings, and counted before the shuffle by pairs. Shingles that the sketch knows
   as hot are dealt by node, and joined with their leaders by Spark.
3. Of the pairs that share enough and pass the size and position bounds, those go whose
   parity bits differ in more places than similar sets can: an exact bound, from a bit in
   place of the 8 bytes of a shingle. Of a node's leaders left, the ``LEADERS`` that share
   most are verified on their sets, which a pass over the texts gives for the nodes of such
   pairs alone. The others wait for step 4.
4. Components of the links found are labelled. What is left are waiting pairs and pairs of
   one bucket, both of different components: those of a bucket's largest component need no
   look at each other, so only the rest is compared with the bucket. Where that makes few
   pairs, they are joined, filtered, counted and verified alike; where it makes many, the
   nodes are dealt into blocks, and parity bits are compared block by block, without a row
   for a pair; the sets of nodes that have a partner left are then compared likewise.

Steps 3 and 4 together look at every pair that could link but those already connected, so
the components are exact, while a group of g near copies costs about g pairs, not g^2. In
a bucket of many nodes that are alike in rare shingles but not linked, step 4 compares
what the bounds leave.

Null and empty texts, or texts without words, have empty sets and link with nothing;
repeated rows are copies; rows that repeat a doc_id with other texts are documents of
their own; a row with a null doc_id links like others and gets the least doc_id of its
component, null if that has none; an empty table gives no rows; columns other than the two
are ignored by ``jaccard_components`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bit_table, id_and_text, in_table, merged_sketch, remove, shared_dir, sketch_blocks, stored, texts_of, trim
from ._components import connected_components
from ._words import Words, shingle_sets, slices, text_buffer

#: Cells of the frequency sketch (a power of two), most matches asked of a prefix, frequency from which a shingle is dealt by node.
CELLS, MOST_MATCHES, HOT = 1 << 21, 3, 20_000
#: Pairs in a bucket from which its nodes are compared by blocks, and nodes of a block.
WIDE, BLOCK_NODES = 1024, 256
#: Leaders that a node is compared with first; those that share most of its prefix.
LEADERS = 2
#: Postings of a partition, on average at most; hashes that a task keeps to tell copies.
PART_POSTINGS, SEEN = 500_000, 1_000_000


def _sets(batches, k: int):
    """(slice of the batch, hashes, offsets) of each slice's shingle sets."""
    for batch in batches:
        raw, offsets = text_buffer(texts_of(batch))
        for i, j in slices(offsets):
            values, bounds = shingle_sets(Words(raw, offsets[i : j + 1]), k)
            yield batch.slice(i, j - i), values, bounds
    trim()


def _set_hash(values: np.ndarray) -> tuple[int, int]:
    digest = blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _node(values: np.ndarray, clash: frozenset) -> int:
    h1, h2 = _set_hash(values)
    return h2 if h1 in clash else h1


class _New:
    """Tells hashes that this task hasn't met; forgets all beyond a bound, which costs repeats, not results."""

    def __init__(self):
        self.seen = set()

    def __call__(self, h) -> bool:
        if h in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(h)
        return True


def parity_bits(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set a bit for one to two shingles (64 at least, a power of two): whether an odd number falls on it."""
    sizes = np.diff(bounds)
    width = np.left_shift(64, np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / 64)).astype(np.int64)))
    off = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = off[owner] + (values & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=off[-1]) & 1).astype(np.uint8))
    return [packed[a:b].tobytes() for a, b in zip((off[:-1] // 8).tolist(), (off[1:] // 8).tolist(), strict=True)]


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity bits (bytes) brought to ``width`` bytes; the parities of halves add up."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


_FIRST = "doc_id long, mark long, n int, h1 long, h2 long, bits binary, block int, cells binary"


def _first_pass(k: int):
    def run(batches):
        sketch = np.zeros(CELLS, np.uint32)
        new, waiting, held = _New(), [], 0

        def counted():
            nonlocal waiting, held, sketch
            if waiting:
                sketch += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
            waiting, held = [], 0

        for batch, values, bounds in _sets(batches, k):
            bits = parity_bits(values, bounds)
            hashes, fresh = [], np.zeros(len(values), dtype=bool)
            for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                h = _set_hash(values[a:b]) if b > a else (None, None)
                hashes.append(h)
                if b > a and new(h):
                    fresh[a:b] = True
                else:
                    bits[d] = None
            waiting.append((values[fresh] & np.uint64(CELLS - 1)).astype(np.int64))
            held += len(waiting[-1])
            if held > CELLS:
                counted()
            rows = len(hashes)
            h1, h2 = (pa.array(x, pa.int64()) for x in (zip(*hashes, strict=True) if rows else ([], [])))
            yield _batch([batch.column(0), batch.column(2), pa.array(np.diff(bounds).astype(np.int32)), h1, h2, pa.array(bits, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())])
        counted()
        blocks = list(sketch_blocks(sketch))
        none = [pa.nulls(len(blocks), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        yield _batch([*none, pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())])

    return run


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FIRST.split(", ")])


def choose_matches(n: int, frequency: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, size of the prefix) of least cost; ``frequency``: of the set's shingles in global order, ascending."""
    base = n - (percent * n + 99) // 100
    sums = np.cumsum(frequency[: min(n, base + MOST_MATCHES)])
    best = None
    for matches in range(1, MOST_MATCHES + 1):
        size = base + matches
        if size > n:
            break
        cost = size + float(sums[size - 1]) / matches + 0.05 * float(sums[size - 1])
        if best is None or cost < best[0]:
            best = cost, matches, size
    return best[1], best[2]


#: ``x``: the place in the set's order, whether the shingle is hot, and l - 1.
_POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("x", "<u4")])


def _second_pass(k: int, percent: int, sketch, parts: int, clash: frozenset):
    def run(batches):
        cells = sketch.value
        noise = float(cells.sum(dtype=np.float64)) / CELLS
        new = _New()
        for _, values, bounds in _sets(batches, k):
            counts = cells[(values & np.uint64(CELLS - 1)).astype(np.int64)]
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b == a or not new(node := _node(values[a:b], clash)):
                    continue
                order = np.argsort(counts[a:b], kind="stable")  # then by hash, as the values ascend
                frequency = np.maximum(counts[a:b][order].astype(np.float64) - noise, 0)
                matches, size = choose_matches(b - a, frequency, percent)
                posting = np.empty(size, _POSTING)
                posting["token"] = values[a:b][order[:size]]
                posting["node"], posting["n"] = node, b - a
                posting["x"] = (np.arange(size) << 3) | ((frequency[:size] >= HOT) << 2) | (matches - 1)
                out.append(posting)
            if not out:
                continue
            postings = np.concatenate(out)
            key = postings["token"] ^ np.where(postings["x"] & 4, postings["node"].view(np.uint64), np.uint64(0))
            part = (key >> np.uint64(24)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, postings = part[order], postings[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(first[1:], len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array([postings[x:y].tobytes() for x, y in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())], ["part", "postings"])

    return run


#: Pairs of a leader a and a node b, and what a partition counts of them; else, without b, postings: of buckets that hold more than two nodes, and hot ones.
_BUCKETS = "kind int, token long, a long, b long, n_a int, n_b int, pos_a int, pos_b int, l_a int, l_b int, shared int"
_PAIR, _LEFT, _HOT = 0, 1, 2


def _buckets(percent: int):
    """Candidates of a partition's buckets, by their leaders, and the postings that other steps need."""

    def run(batches):
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        postings = np.frombuffer(b"".join(blobs), _POSTING)
        del blobs
        place = postings["x"] >> 3
        postings = postings[np.lexsort((postings["node"], place / postings["n"], postings["token"]))]
        new_token = np.ones(len(postings), dtype=bool)
        new_token[1:] = postings["token"][1:] != postings["token"][:-1]
        new_node = new_token.copy()
        new_node[1:] |= postings["node"][1:] != postings["node"][:-1]
        postings, new_token = postings[new_node], new_token[new_node]
        hot = (postings["x"] & 4) > 0
        yield from _postings(postings[hot], _HOT)
        postings, new_token = postings[~hot], new_token[~hot]
        first = np.flatnonzero(new_token)
        size = np.diff(np.append(first, len(postings)))
        size, lead = np.repeat(size, size), np.repeat(first, size)
        yield from _postings(postings[size > 2], _LEFT)
        own = np.flatnonzero((size > 1) & ~new_token)
        a, b = postings[lead[own]], postings[own]
        columns = [a["node"], b["node"], *(x.astype(np.int64) for x in (a["n"], b["n"], a["x"] >> 3, b["x"] >> 3, (a["x"] & 3) + 1, (b["x"] & 3) + 1))]
        columns = [c[_possible(percent, *columns[2:])] for c in columns]
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        if len(order):
            at = np.flatnonzero(np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]))
            shared = np.diff(np.append(at, len(order)))
            least = [np.minimum.reduceat(c, at) for c in columns[4:6]]
            columns = [*(c[at] for c in columns[:4]), *least, *(c[at] for c in columns[6:]), shared]
            for c in range(0, len(at), 50_000):
                yield _rows(_PAIR, np.zeros(len(at[c : c + 50_000]), np.int64), *(x[c : c + 50_000] for x in columns))
        trim()

    return run


def _postings(p: np.ndarray, kind: int):
    for c in range(0, len(p), 50_000):
        q = p[c : c + 50_000]
        zero = np.zeros(len(q), np.int64)
        yield _rows(kind, np.ascontiguousarray(q["token"]).view("<i8"), q["node"], zero, q["n"], zero, q["x"] >> 3, zero, (q["x"] & 3) + 1, zero, zero)


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = [(n, pa.int64() if t == "long" else pa.int32()) for n, t in (x.split() for x in _BUCKETS.split(", "))]
    every = [np.full(len(columns[0]), kind), *columns]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype("<i8" if t == pa.int64() else "<i4")) for c, (_, t) in zip(every, kinds, strict=True)], [n for n, _ in kinds])


def _possible(percent: int, n_a, n_b, pos_a, pos_b, l_a, l_b) -> np.ndarray:
    """Which pairs the sizes and the places of a shared shingle allow."""
    needed = -(-percent * (n_a + n_b) // (100 + percent))
    rest = np.minimum(n_a - pos_a, n_b - pos_b)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (rest + np.minimum(l_a, l_b) - 1 >= needed)


def _needed(percent: int):
    """Least intersection of two sets that link."""
    return F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))


def _close(percent: int):
    """``_possible`` in Spark."""
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (rest + F.least("l_a", "l_b") - 1 >= _needed(percent))


def _counted(matches: DataFrame, percent: int) -> DataFrame:
    """Pairs that share enough prefix shingles, of which the first lies early enough."""
    per = matches.groupBy("a", "b").agg(F.sum("shared").alias("shared"), *(F.min(c).alias(c) for c in ("n_a", "n_b", "pos_a", "pos_b", "l_a", "l_b")))
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return per.where((F.col("shared") >= F.least("l_a", "l_b")) & (rest >= _needed(percent))).select("a", "b", "n_a", "n_b", "shared")


def _side(frame: DataFrame, s: str, *more: str) -> DataFrame:
    return frame.select("token", F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "l", *more)))


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b and shared of the pairs whose parity bits allow the similarity; no pair that links is lost.

    Every shingle of one set alone flips a bit, so the bits that differ are at most the
    shingles that do, and those are at most (100 - percent) / (100 + percent) of both sizes.
    """

    def check(batches):
        for batch in batches:
            n = batch.column(3).to_numpy() + batch.column(4).to_numpy()
            left, right = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
            keep = np.zeros(len(n), dtype=bool)
            for x, y in np.unique(sizes, axis=0).tolist():
                at = np.flatnonzero((sizes[:, 0] == x) & (sizes[:, 1] == y))
                step = max(1, (1 << 22) // max(x, y))
                for c in range(0, len(at), step):
                    some = at[c : c + step]
                    bits = [_folded(np.frombuffer(b"".join([side[i] for i in some.tolist()]), np.uint8).reshape(len(some), -1), min(x, y)) for side in (left, right)]
                    keep[some] = _apart(bits[0] ^ bits[1]) * (100 + percent) <= n[some] * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(3)], ["a", "b", "shared"]).filter(pa.array(keep))

    bits = classes.select("node", "bits")
    joined = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    return joined.select("a", "b", "shared", F.col("n_a").cast("long"), F.col("n_b").cast("long"), "bits_a", "bits_b").mapInArrow(check, "a long, b long, shared long")


def _apart(bits: np.ndarray) -> np.ndarray:
    """Bits set along the last axis, whose bytes are a multiple of eight."""
    return np.bitwise_count(np.ascontiguousarray(bits).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _sets_of(source: DataFrame, k: int, clash: frozenset, path: str, **nodes: DataFrame) -> DataFrame:
    """node, uid, shingles and a flag for each frame that may have it: the sets, stored at ``path``, of these nodes (one column a frame).

    A pass over the texts; what passes the bounded bit tables by chance falls away in the
    joins. A node of copies in several tasks has several rows, of different uid.
    """
    shared = source.sparkSession.sparkContext.broadcast([bit_table(f) for f in nodes.values()])
    names = list(nodes)

    def run(batches):
        new = _New()
        for _, values, bounds in _sets(batches, k):
            at = np.flatnonzero(np.diff(bounds)).tolist()
            own = [_node(values[bounds[d] : bounds[d + 1]], clash) for d in at]
            passed = [in_table(t, np.array(own, np.int64)) for t in shared.value]
            some = [i for i in np.flatnonzero(np.logical_or.reduce(passed)).tolist() if new(own[i])]
            flags = [pa.array([bool(p[i]) for i in some], pa.bool_()) for p in passed]
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in some], pa.int64()), *flags, pa.array([values[bounds[at[i]] : bounds[at[i] + 1]].tobytes() for i in some], pa.binary())], ["node", *names, "shingles"])

    found = source.mapInArrow(run, f"node long, {', '.join(f'{n} boolean' for n in names)}, shingles binary")
    return stored(found.withColumn("uid", F.monotonically_increasing_id()), path)


def _one_of(sets: DataFrame) -> DataFrame:
    """node and uid: one row of each node, found without moving the sets."""
    return sets.groupBy("node").agg(F.min("uid").alias("uid"))


def _verified(source: DataFrame, pairs: DataFrame, k: int, percent: int, clash: frozenset) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their sets' intersection."""
    spark = source.sparkSession
    path = shared_dir(spark, "sets")
    sets = _sets_of(source, k, clash, path, hub=pairs.select("a").distinct(), leaf=pairs.select("b").distinct())
    one = _one_of(sets)
    named = pairs.select("a", "b").join(one.toDF("a", "uid_a"), "a").join(one.toDF("b", "uid_b"), "b")
    left = sets.where("hub").select(F.col("node").alias("a"), F.col("uid").alias("uid_a"), F.col("shingles").alias("set_a"))
    right = sets.where("leaf").select(F.col("node").alias("b"), F.col("uid").alias("uid_b"), F.col("shingles").alias("set_b"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = named.join(right, ["b", "uid_b"]).join(left, ["a", "uid_a"]).select("a", "b", "set_a", "set_b")
    links = stored(joined.mapInArrow(check, "a long, b long").distinct(), shared_dir(spark, "links"))
    remove(spark, path)
    return links


def _dealt(members: DataFrame, held: DataFrame, payload: list[str]):
    """(nodes outside their group's main component, all nodes), each dealt to the block pairs (grp, i, j) that compare it."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("component") != F.col("grp")).alias("u"))
    sizes = sizes.select("grp", F.ceil(F.col("n") / BLOCK_NODES).cast("int").alias("n_blocks"), F.ceil(F.col("u") / BLOCK_NODES).cast("int").alias("u_blocks")).where("u_blocks > 0")
    held = held.join(sizes, "grp")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = held.where("component <> grp").select("grp", own("u_blocks").alias("i"), every("n_blocks").alias("j"), "node", "component", *payload)
    right = held.select(F.col("grp").alias("grp_r"), every("u_blocks").alias("i_r"), own("n_blocks").alias("j_r"), *(F.col(c).alias(f"{c}_r") for c in ("node", "component", *payload)))
    return left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp_r", "i_r", "j_r"))


def _near_blocks(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The members (grp, node, component) that have, by parity bits, a possible partner of another component in the group."""

    def check(some, others):
        import pandas as pd

        others = others.rename(columns=lambda c: c.removesuffix("_r"))
        marked = [np.zeros(len(some), dtype=bool), np.zeros(len(others), dtype=bool)]
        sides = [(f["bits"].to_numpy(), f["n"].to_numpy(np.int64), f["component"].to_numpy()) for f in (some, others)]
        widths = [np.array([len(x) for x in s[0]]) for s in sides]
        for x in np.unique(widths[0]).tolist():
            for y in np.unique(widths[1]).tolist():
                rows, cols = np.flatnonzero(widths[0] == x), np.flatnonzero(widths[1] == y)
                low = min(x, y)
                left, right = (_folded(np.frombuffer(b"".join(s[0][at]), np.uint8).reshape(len(at), -1), low) for s, at in zip(sides, (rows, cols), strict=True))
                step = max(1, (1 << 24) // (low * len(cols)))
                for c in range(0, len(rows), step):
                    r = rows[c : c + step]
                    apart = _apart(left[c : c + step, None, :] ^ right[None, :, :])
                    good = (apart * (100 + percent) <= (sides[0][1][r][:, None] + sides[1][1][cols][None, :]) * (100 - percent)) & (sides[0][2][r][:, None] != sides[1][2][cols][None, :])
                    marked[0][r[good.any(axis=1)]] = True
                    marked[1][cols[good.any(axis=0)]] = True
        return pd.concat([f[m][["grp", "node", "component"]] for f, m in zip((some, others), marked, strict=True)]).drop_duplicates()

    held = members.join(classes.select("node", "n", "bits"), "node")
    return _dealt(members, held, ["n", "bits"]).applyInPandas(check, "grp long, node long, component long").distinct()


def _blockwise(source: DataFrame, members: DataFrame, k: int, percent: int, clash: frozenset) -> DataFrame:
    """Links between each group's nodes outside its main component and all its nodes, a block against a block.

    ``members``: grp, node, component. A task holds the sets of two blocks of about ``BLOCK_NODES``
    nodes and counts their intersections by shingle; of a node's links to one component it
    returns one. No row stands for a pair, so a group of many near copies costs comparisons only.
    """
    spark, path = source.sparkSession, shared_dir(source.sparkSession, "sets")
    sets = _sets_of(source, k, clash, path, member=members.select("node").distinct()).select("node", "uid", "shingles")
    held = members.join(_one_of(sets), "node").join(sets, ["node", "uid"]).drop("uid")

    def check(some, others):
        import pandas as pd

        found = []
        others = others.rename(columns=lambda c: c.removesuffix("_r"))
        if len(some) and len(others):
            arrays = [np.frombuffer(v, "<u8") for v in others["shingles"]]
            sizes_of = np.array([len(v) for v in arrays])
            owner = np.repeat(np.arange(len(arrays)), sizes_of)
            tokens = np.concatenate(arrays)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            nodes, components = others["node"].to_numpy(), others["component"].to_numpy()
            for node, component, raw in zip(some["node"], some["component"], some["shingles"], strict=True):
                mine = np.frombuffer(raw, "<u8")
                lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
                count = hi - lo
                at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(arrays))
                good = (100 * both >= percent * (len(mine) + sizes_of - both)) & (components != component)
                if good.any():
                    _, first = np.unique(components[good], return_index=True)
                    found += [(node, int(b)) for b in nodes[good][first]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links = stored(_dealt(members, held, ["shingles"]).applyInPandas(check, "a long, b long"), shared_dir(spark, "blocks"))
    remove(spark, path)
    return links


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's doc_id, mark (hash of the text), n and rep: of its component the least doc_id and that row's mark."""
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    gone: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        gone.append(shared_dir(spark, name))
        return stored(df, gone[-1])

    first = stored(source.mapInArrow(_first_pass(k), _FIRST), shared_dir(spark, "first"))
    cells = merged_sketch(first.where("block is not null").select("block", "cells"), CELLS)
    every = first.where("block is null")
    some = every.where("n > 0")
    # Two sets with one 64-bit hash are about as many as rows^2 / 2^65: none up to 10^9, a few dozen at 10^10.
    clash = frozenset(r.h1 for r in some.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo <> hi").collect())
    node = F.when(F.col("h1").isin(list(clash)), F.col("h2")).otherwise(F.col("h1")) if clash else F.col("h1")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("least")
    classes = stored(some.groupBy(node.alias("node")).agg(least, F.max("n").alias("n"), F.max("bits").alias("bits")), shared_dir(spark, "classes"))

    total = classes.agg(F.sum(F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + MOST_MATCHES)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART_POSTINGS))
    sketch = spark.sparkContext.broadcast(cells)
    packed = source.mapInArrow(_second_pass(k, percent, sketch, parts, clash), "part int, postings binary").repartitionById(parts, "part")
    buckets = kept(packed.mapInArrow(_buckets(percent), _BUCKETS), "buckets")
    sketch.unpersist()

    stars = buckets.where(F.col("kind") == _PAIR).drop("kind", "token")
    postings = lambda *kinds: buckets.where(F.col("kind").isin(*kinds)).select("token", F.col("a").alias("node"), F.col("n_a").alias("n"), F.col("pos_a").alias("pos"), F.col("l_a").alias("l"))
    hot = postings(_HOT)
    if _some(hot):
        lead = hot.groupBy("token").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "node", "n", "pos", "l")).alias("x")).select("token", "x.node", "x.n", "x.pos", "x.l")
        more = _side(hot, "b").join(_side(lead, "a"), "token").where((F.col("a") != F.col("b")) & _close(percent))
        stars = stars.unionByName(more.withColumn("shared", F.lit(1)).drop("token"))
    nearest = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))
    near = kept(_near(_counted(stars, percent), classes, percent).withColumn("rank", nearest), "near")
    links = _verified(source, near.where(F.col("rank") <= LEADERS), k, percent, clash)
    parts_of = kept(connected_components(links), "round")

    label = lambda s: parts_of.select(F.col("node").alias(s), F.col("component").alias(f"component_{s}"))
    waiting = near.where(F.col("rank") > LEADERS).select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left")
    waiting = waiting.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")

    named = kept(postings(_LEFT, _HOT).join(parts_of, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    sizes = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("x"), F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes")).where("components > 1")
    largest = largest.select("token", F.col("x.component").alias("main"), ((F.col("nodes") - F.col("x.size")) * F.col("nodes") > WIDE).alias("wide"))
    split = kept(named.join(largest, "token"), "mixed")
    mixed = split.where("not wide").drop("wide")
    members = kept(split.where("wide").select(F.col("main").alias("grp"), "node", "component").distinct(), "members")
    apart = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main_b")) | (F.col("a") < F.col("b")))
    minor = _side(mixed.where("component <> main"), "a", "component")
    rest = minor.join(_side(mixed, "b", "component", "main"), "token").where(apart & _close(percent))
    swap = F.col("a") > F.col("b")
    ordered = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for c in ("", "n_", "pos_", "l_") for x, y in ((f"{c}a", f"{c}b"), (f"{c}b", f"{c}a"))]
    rest = _near(_counted(rest.select(*ordered, F.lit(1).alias("shared")), percent), classes, percent).select("a", "b")
    known = kept(waiting.union(rest), "rest")
    more = links
    if _some(known):
        more = more.union(_verified(source, known, k, percent, clash))
    if _some(members):
        members = kept(_near_blocks(members, classes, percent), "near-members")
        if _some(members):
            more = more.union(_blockwise(source, members, k, percent, clash))
    if more is not links:
        parts_of = stored(connected_components(more), shared_dir(spark, "final"))
    else:
        gone.pop(gone.index(next(p for p in gone if "groundweave-round-" in p)))
    for path in gone:
        remove(spark, path)

    labelled = classes.select("node", "least").join(parts_of, "node", "left")
    # Stored, so that a component of very many nodes can be split in the join.
    whole = stored(labelled.where("component is not null").groupBy("component").agg(F.min("least").alias("whole")), shared_dir(spark, "whole"))
    labelled = labelled.join(whole, "component", "left").select("node", F.coalesce("whole", "least").alias("rep"))
    return every.select("doc_id", "mark", "n", node.alias("node")).join(labelled, "node", "left")


def jaccard_components(docs: DataFrame, *, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    found = _grouped(docs, k, percent, id_col, text_col)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep.doc_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the least doc_id (of a null one only where all are null); all columns stay.

    Rows are told apart by doc_id and text: a doc_id with two texts is two documents. Of rows
    alike in both one stays, whichever comes first; rows without words stay, but for repeats of
    a doc_id.
    """
    spark = docs.sparkSession
    found = stored(_grouped(docs, k, percent, id_col, text_col), shared_dir(spark, "components"))
    mark = F.xxhash64(F.col(text_col).cast("string"))
    same = lambda: F.col(id_col).cast("long").eqNullSafe(F.col("__doc_id")) & (mark == F.col("__mark"))
    key = [F.col("doc_id").alias("__doc_id"), F.col("mark").alias("__mark")]
    other = ~F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) | (F.col("mark") != F.col("rep.mark"))
    kept = docs.join(found.where(F.col("rep").isNotNull() & other).select(*key).distinct(), same(), "left_anti")
    repeated = found.where("doc_id is not null or n > 0").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*key)
    if _some(repeated):
        # Only rows that repeat both are brought together.
        once = kept.join(repeated, same(), "left_semi")
        names = [f"__{i}" for i in range(len(docs.columns))]
        at = docs.columns.index(id_col), docs.columns.index(text_col)
        once = once.toDF(*names).dropDuplicates([names[i] for i in at]).toDF(*docs.columns)
        kept = kept.join(repeated, same(), "left_anti").union(once)
    return kept
