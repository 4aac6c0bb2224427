"""Near-duplicate groups by SimHash fingerprints and BK-trees.

``near_groups``: every 3-word shingle of a text is hashed (XXH64, seed 42) and
a fingerprint bit is set where over half the hashes have it; fingerprints that
differ in at most ``RADIUS`` bits link, and a document's component is the
smallest doc_id reachable.

``near_copies`` serves filtering: texts link whose sets of distinct five-word
shingles have a Jaccard similarity of 0.8 or more.  Fingerprints of ``NARROW``
bits with a wider radius gather candidates (in 64 bits such texts differ in
about ten), and within each component of candidates the shingle sets
themselves decide, every pair that isn't connected yet being compared.

Equal fingerprints are one node.  Shards hold nodes that agree on chosen bits.
For ``near_groups`` two linked fingerprints agree on all but RADIUS of
``blocks`` bit blocks, by the pigeonhole principle, so every choice of blocks
is one table and no link is missed; the number of blocks follows from the
number of fingerprints so that a shard stays small.  For ``near_copies`` each
table takes bits at random, and there are so many tables that a pair at the
threshold meets in one with probability ``RECALL``.  A shard with more than
``SHARD`` nodes (many near copies) is dealt into chunks, and each pair of chunks
is a task's work of its own: one chunk's tree, the other chunk's queries.  In a
shard a BK-tree (children keyed by integer Hamming distance to the parent) is
walked with all queries at once, each following only edges within the radius;
a union-find keeps one link per merge, so a shard of n nodes yields fewer than
n links.  Components of the links are found on the cluster.

Defined cases: a null or wordless text has fingerprint zero, linked like any
other; fewer words than a shingle's make one shingle; ties (exactly half) give
0; repeated rows share a fingerprint; null doc_ids never name a component
unless alone, and their rows are never dropped; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, log, pi

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import few_files, packed, save, scratch, small_batches
from strandlake.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
SHARD = 4096
NARROW, COPY_SHINGLE, SIMILARITY, RECALL = 256, 5, 0.8, 0.97
#: Texts and characters of a chunk of candidates that are confirmed against each other.
CHUNK, CHUNK_CHARS = 1024, 2_000_000


def hashes(text: str | None, xxh, shingle: int = SHINGLE) -> list[int]:
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters, space and \x09-\x0d only
    if len(words) < shingle:
        return [xxh(b" ".join(words), SEED)] if words else []
    return [xxh(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(shingle)))]


def mixed(h, k: int):
    """Word k of the wide hash of each 64-bit hash; word 0 is the hash itself."""
    import numpy as np

    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def majority(rows: list[list[int]], words: int = 1):
    """Fingerprints, (rows, words) of uint64, of lists of 64-bit hashes; empty lists give 0."""
    import numpy as np

    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), words), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    every = np.fromiter((h for r in rows for h in r), np.uint64, int(sizes.sum()))
    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    # Eight byte-wide counters to a word: segments of at most 255 hashes don't overflow.
    starts = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begins, sizes[full])])
    firsts = np.searchsorted(starts, begins)
    for word in range(words):
        wide = mixed(every, word)
        for shift in range(8):
            lanes = np.add.reduceat((wide >> np.uint64(shift)) & np.uint64(0x0101010101010101), starts)
            counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
            for byte in range(8):
                out[full, word] |= (counts[:, byte] * 2 > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, f0, f1, ...) per row of ``docs``; each f holds 64 bits as a signed long.

    ``distinct`` counts a repeated shingle once.
    """
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = [hashes(t, xxhash.xxh64_intdigest, shingle) for t in part.column("text").to_pylist()]
                fp = majority([list(set(r)) for r in rows] if distinct else rows, words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in fp.T.copy().view("int64")]], names=["doc_id", *names])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names))


def distances(a, b):
    """Hamming distances of rows of words."""
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


class BKTree:
    """BK-tree over 64-bit fingerprints, built and walked with numpy arrays."""

    def __init__(self, items):
        """items: indices into the fingerprints given to ``walk``."""
        self.items = items

    def walk(self, fps, queries, radius, link):
        """link(node, queries) for each tree node and the queries within the radius of it."""
        import numpy as np

        todo = [(self.items, queries)]
        while todo:
            items, asks = todo.pop()
            node, rest = items[0], items[1:]
            near = distances(fps[asks], fps[node])
            hits = asks[near <= radius]
            if len(hits):
                link(node, hits)
            if not len(rest):
                continue
            edge = distances(fps[rest], fps[node])
            for k in np.unique(edge).tolist():
                follow = asks[np.abs(near - k) <= radius]
                if len(follow):
                    todo.append((rest[edge == k], follow))


def small_shard(fps: list[int], radius: int, link) -> None:
    """The same tree for few fingerprints, one insertion at a time: each asks the tree before it joins."""
    root: list = [0, {}]  # index, children by distance
    for i in range(1, len(fps)):
        q, todo = fps[i], [root]
        while todo:
            at, children = todo.pop()
            d = (q ^ fps[at]).bit_count()
            if d <= radius:
                link(at, i)
            for k, child in children.items():
                if -radius <= d - k <= radius:
                    todo.append(child)
        here = root
        while True:
            d = (q ^ fps[here[0]]).bit_count()
            if d not in here[1]:
                here[1][d] = [i, {}]
                break
            here = here[1][d]


def shard_links(fps, side, radius=RADIUS):
    """Links (a, b) of one shard that keep its connections: a spanning forest.

    fps: (n, words) of uint64.  side: None, or 0 for the fingerprints of the tree and 1 for those that only ask.
    """
    import numpy as np

    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []

    def link(a, b):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))

    if side is None and len(fps) <= 48:
        small_shard([int.from_bytes(r.tobytes(), "little") for r in fps], radius, link)
    else:
        every = np.arange(len(fps))
        tree, asks = (every, every) if side is None else (every[side == 0], every[side == 1])
        if len(tree) and len(asks):
            BKTree(tree).walk(fps, asks, radius, lambda node, hits: [link(int(node), h) for h in hits.tolist()])
    return out


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    at = [BITS * k // blocks for k in range(blocks + 1)]
    return list(zip(at, at[1:]))


def blocks_for(n: int) -> int:
    """Blocks whose tables give keys of enough bits for n fingerprints: about 16 of them to a shard."""
    blocks = RADIUS + 1
    while BITS * (blocks - RADIUS) // blocks < min(44, max(n // 16, 1).bit_length()):
        blocks += 1
    return blocks


def pigeonhole_keys(n: int) -> list:
    """Shard keys of one-word fingerprints f0: no pair within RADIUS misses all of them."""
    bounds, keys = block_bounds(blocks_for(n)), []
    for chosen in combinations(bounds, len(bounds) - RADIUS):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in chosen)
        keys.append(F.col("f0").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")))
    return keys


def differing(similarity: float) -> float:
    """Share of bits in which two equally long texts of a Jaccard similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def random_keys(n: int, words: int = NARROW // 64) -> list:
    """Shard keys from random bits: about four of n unrelated fingerprints to a shard, RECALL at the threshold."""
    import random

    rng, bits = random.Random(SEED), max(12, (n // 4).bit_length())
    tables = ceil(log(1 - RECALL) / log(1 - (1 - differing(SIMILARITY)) ** bits))
    keys = []
    for _ in range(tables):
        masks = [0] * words
        for b in rng.sample(range(64 * words), bits):
            masks[b // 64] |= 1 << b % 64
        keys.append(F.xxhash64(*[F.col(f"f{k}").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")) for k, m in enumerate(masks) if m]))
    return keys


def links(nodes: DataFrame, keys: list, radius: int) -> DataFrame:
    """(u, v): links between nodes (id, f0, ...) within the radius that share a key, enough to connect what is connected."""
    words = [c for c in nodes.columns if c != "id"]
    dealt = nodes.select("id", *words, F.posexplode(F.array(*keys)).alias("t", "key"))
    large = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD).select("t", "key", F.ceil(F.col("n") / SHARD).cast("int").alias("c"))
    spread = dealt.join(large, ["t", "key"], "left").withColumn("i", F.pmod(F.xxhash64("id"), F.coalesce("c", F.lit(1))).cast("int"))
    each = spread.select("t", "key", "id", *words, "i", F.explode(F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1)).alias("j"))
    work = each.select("t", "key", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "i", "id", *words).repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")

    def run(batches):
        import numpy as np

        def shard(rows):
            if rows.shape[1] < 2:
                return []
            fps = np.ascontiguousarray(rows[6:].T).view(np.uint64)
            side = None if rows[2, 0] == rows[3, 0] else (rows[4] != rows[2]).astype(np.int8)
            return [(int(rows[5, a]), int(rows[5, b])) for a, b in shard_links(fps, side, radius)]

        held = np.empty((6 + len(words), 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            ends = np.flatnonzero((held[:4, 1:] != held[:4, :-1]).any(axis=0)) + 1
            if len(ends):
                cut = [0, *ends.tolist()]
                # Only shards of two or more have work.
                out = [x for a, b in zip(cut, cut[1:]) if b - a > 1 for x in shard(held[:, a:b])]
                held = held[:, cut[-1] :]
                yield from edge_batch(out)
        yield from edge_batch(shard(held))

    def edge_batch(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return work.mapInArrow(run, "u long, v long")


def _named(nodes: DataFrame, edges: DataFrame, n: int, base: str) -> DataFrame:
    """(id, component_id, first) of every one of the n nodes (id, least, ...); first: the id of the node that holds the component's least."""
    star = components(edges, n)
    named = nodes.select("id", "least").join(star.select(F.col("u").alias("id"), F.col("v").alias("hub")), "id", "left").withColumn("hub", F.coalesce("hub", "id"))
    named = save(few_files(named, n), f"{base}/named")
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "id")))
    hubs = named.groupBy("hub").agg(first.alias("first"))
    return save(few_files(named.join(hubs, "hub").select("id", F.col("first.least").alias("component_id"), F.col("first.id").alias("first")), n), f"{base}/components")


def _nodes(held: DataFrame, words: list[str], base: str) -> tuple[DataFrame, int]:
    """((id, words, least), how many): one row per fingerprint."""
    nodes = save(few_files(held.groupBy("id", *words).agg(F.min("doc_id").alias("least")), held.count()), f"{base}/nodes")
    return nodes, nodes.count()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 hex digits, one row per row of ``docs``."""
    base = scratch(docs.sparkSession, "simhash")
    held = save(fingerprints(docs).withColumn("id", F.col("f0")), f"{base}/fingerprints")
    nodes, n = _nodes(held, ["f0"], base)
    found = _named(nodes, links(nodes.select("id", "f0"), pigeonhole_keys(n), RADIUS), n, base)
    return held.join(found, "id").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar(a, b) -> bool:
    """Whether two sets have a Jaccard similarity of SIMILARITY or more."""
    common = len(a & b)
    return common / (len(a) + len(b) - common) >= SIMILARITY


def few_similar(sets: list[set]) -> list[tuple[int, int]]:
    """A spanning forest of the similar ones among few sets."""
    out, left = [], list(range(len(sets)))
    while left:
        todo = [left.pop()]
        while todo and left:
            at = todo.pop()
            hits = [i for i in left if similar(sets[at], sets[i])]
            out += [(at, i) for i in hits]
            left = [i for i in left if i not in hits]
            todo += hits
    return out


def many_similar(sets: list) -> list[tuple[int, int]]:
    """The same for many sets, arrays of distinct hashes, by lists of the sets that hold a hash.

    A set asks only those not reached yet.  One that is similar to it shares one of
    its rarest hashes, as many as may be missing and one more, so these are looked up first.
    """
    import numpy as np

    sizes, n = np.array([len(x) for x in sets]), len(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, token, held_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((held_by[token], owner))  # a set's rarest hashes first
    token, ends = token[order], np.cumsum(sizes)
    left = np.ones(n, bool)

    def listed():
        keep = left[owner]
        t, o = token[keep], owner[keep]
        by = np.argsort(t, kind="stable")
        return o[by], np.searchsorted(t[by], np.arange(len(held_by) + 1)), int(left.sum())

    def holders(tokens):
        begin, count = bounds[tokens], bounds[tokens + 1] - bounds[tokens]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        return np.bincount(lists[at], minlength=n)

    (lists, bounds, listed_n), remain, out = listed(), n, []
    for root in range(n):
        if not left[root]:
            continue
        left[root], remain, todo = False, remain - 1, [root]
        while todo and remain:
            if remain * 2 <= listed_n:
                lists, bounds, listed_n = listed()
            at = todo.pop()
            mine = token[ends[at] - sizes[at] : ends[at]]
            rare = len(mine) - ceil(SIMILARITY * len(mine) - 1e-6) + 1
            some = holders(mine[:rare])
            if not (some.astype(bool) & left).any():
                continue
            common = some + holders(mine[rare:])
            hits = np.flatnonzero(left & (common / (sizes[at] + sizes - common) >= SIMILARITY)).tolist()
            out += [(at, i) for i in hits]
            left[hits] = False
            remain -= len(hits)
            todo += hits
    return out


def confirmed(texts: DataFrame) -> DataFrame:
    """(u, v): links between texts (hub, c, id, text) of one hub whose shingle sets are similar, enough to connect what is.

    All pairs of a hub's texts are looked at.  Its texts are dealt into c chunks,
    and each pair of chunks is a task's work of its own.
    """
    dealt = texts.withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), F.col("c")).cast("int"))
    each = dealt.withColumn("j", F.explode(F.expr("if(c = 1, array(0), filter(sequence(0, c - 1), j -> j != i))")))
    work = each.select("hub", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "id", "text").repartition("hub", "a", "b").sortWithinPartitions("hub", "a", "b")

    def run(batches):
        import numpy as np
        import xxhash

        def group(ids, sets):
            if len(ids) <= 32:
                found = few_similar([set(x.tolist()) for x in sets])
            else:
                found = many_similar(sets)
            return [(ids[a], ids[b]) for a, b in found]

        key, ids, sets, out = None, [], [], []
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128).to_pydict()
                for hub, a, b, at, text in zip(*(part[c] for c in ("hub", "a", "b", "id", "text"))):
                    if (hub, a, b) != key:
                        out += group(ids, sets)
                        key, ids, sets = (hub, a, b), [], []
                    ids.append(at)
                    # Texts without words are alike.
                    sets.append(np.unique(np.array(hashes(text, xxhash.xxh64_intdigest, COPY_SHINGLE) or [0], np.uint64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
                out = []
        out = group(ids, sets)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return work.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key, component_id, first) per row of ``docs`` by the exact similarity of sets of five-word shingles.

    key: XXH64 of the text; first: the key of the component's text that holds its smallest doc_id.

    Fingerprints only gather texts: a link between candidates says nothing but
    that both lie in one gathering, so a forest of them is enough.
    """
    base, words = scratch(docs.sparkSession, "simhash"), [f"f{k}" for k in range(NARROW // 64)]
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    marked = fingerprints(texts.withColumn("doc_id", F.struct("doc_id", "key", "size")), COPY_SHINGLE, len(words), True)
    held = save(marked.select("doc_id.*", *words, F.xxhash64(*words).alias("id")), f"{base}/fingerprints")
    nodes, n = _nodes(held, words, base)
    p = differing(SIMILARITY)
    radius = round(p * NARROW + 4 * (p * (1 - p) * NARROW) ** 0.5)
    found = save(few_files(links(nodes.select("id", *words), random_keys(n), radius).distinct(), 2 * n), f"{base}/candidates")
    star = components(found, n).select(F.col("u").alias("id"), F.col("v").alias("hub"))
    each = held.groupBy("key", "id").agg(F.min("doc_id").alias("least"), F.max("size").alias("size"))
    each = save(few_files(each.join(star, "id", "left").select(F.col("key").alias("id"), "least", "size", F.coalesce("hub", "id").alias("hub")), n), f"{base}/texts")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("size") / CHUNK_CHARS)).cast("int")
    hubs = each.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.greatest(chunks, F.lit(1)).alias("c")).filter("n > 1").select("hub", "c")
    wanted = save(few_files(each.join(hubs, "hub").select("id", "hub", "c"), n), f"{base}/wanted")
    near = confirmed(texts.select(F.col("key").alias("id"), "text").join(wanted, "id").dropDuplicates(["id"]))
    named = _named(each.select("id", "least"), save(few_files(near.distinct(), n), f"{base}/links"), n, base)
    return held.select("doc_id", F.col("key").alias("id")).join(named, "id").select("doc_id", F.col("id").alias("key"), "component_id", "first")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose near copies come before them, by doc_id and then by the text's hash.

    A row is told by its doc_id and text, so rows that share a doc_id stay or
    go each for itself; rows that repeat both stay or go together, and rows
    with a null doc_id stay.
    """
    dropped = near_copies(docs).filter("doc_id > component_id OR doc_id = component_id AND key != first").select(F.col("doc_id").alias("_gone"), "key").distinct()
    held = docs.select(packed(docs), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    return held.join(dropped, (F.col("_id") == F.col("_gone")) & (F.col("_key") == F.col("key")), "left_anti").select("_row.*")
