"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is the stream of its documents in the order of a seeded hash, cut
into blocks of ``BLOCK_WORDS`` words.  Its target says how many words the mix
takes: whole passes over the source, then the first blocks of one more
permuted pass, the last of them cut so that the sum is exact.  Draw number d
of a source is block ``p`` of pass ``d // n`` where the pass's permutation puts
p at ``d % n``, so draws of one pass are disjoint.  The permutations are keyed
Feistel networks, so a place costs the same however many blocks there are.

The tree starts with every source's number of draws and halves the output
shards; at each node a multivariate hypergeometric draw fixes how many of each
source's draws go left, so shards have equal sizes and the quotas stay exact.
That draw is taken by halving the catalogue of sources as well: the share of
its first half is hypergeometric, and so on within each half.  Every single
draw has a seed of its own (tree node, range of sources), so a task works out
the few nodes its draws pass through when it meets them; nothing of the size
sources times shards exists anywhere.  A shard takes a consecutive range of
each source's draws, and the words of the mix are what the shards hold, each
shuffled locally by a hash.

Only (source, words, documents) sums reach the driver and the tasks, one row a
source; ``MAX_SOURCES`` is checked and a longer catalogue is an error, never a
cut.  A document's place in its stream is a two-level prefix sum over hash
buckets, so a source with a third of all rows is dealt over many tasks.

Defined cases: null text has size 0; the null source comes last; sources
without words have target 0; empty texts are taken 0 words; rows that share a
doc_id, null ones too, are documents of their own, told apart by text and
source, and by number where these are equal as well; other columns pass
through ``materialise`` untouched and don't matter before; empty tables give
empty results.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, packed, save, scratch, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 512
SHARDS, SHARD_WORDS, SEED = 16, 2_000_000, 11
MAX_SOURCES = 100_000
BUCKET_DOCS, MIN_BUCKETS = 20_000, 64
#: Nodes a task remembers; more are worked out again.
TREE_NODES = 500_000
#: Partitions of the mixed documents at most; a partition holds whole shards.
PARTITIONS = 20_000
DRAWS = "array<struct<epoch:int,block:long,at:long,words:long,shard:int>>"
#: What tells documents apart.
KEY = ["doc_id", "t", "source_key", "k"]


def targets(words: list[int], weights: list[float]) -> list[float]:
    """Words to take from each source: shares by weight of all words, at most MOST times the source, the excess reshared."""
    total, out = float(sum(words)), [0.0] * len(words)
    open_ = [i for i, w in enumerate(words) if w]
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > MOST * words[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(MOST * words[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


@lru_cache(maxsize=1024)
def keys(*of: int) -> tuple:
    """Six seeded 64-bit words."""
    import numpy as np

    return tuple(np.random.SeedSequence((SEED, *of)).generate_state(6, np.uint64))


def places(n: int, key: int, epoch: int, blocks):
    """Places of ``blocks`` (an array) in a pass over the n blocks of a source: a Feistel network, walked until within n."""
    import numpy as np

    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask, out, todo = np.uint64((1 << int(half)) - 1), np.array(blocks, np.uint64), np.arange(len(blocks))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys(key, epoch):
            x = (right + k) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def planned(key: int, words: int, target: float) -> dict:
    """How a source is drawn: blocks, whole passes, draws, words of the last draw."""
    want, block = round(target), BLOCK_WORDS
    n = -(-words // block) if words else 0
    passes, rest = divmod(want, words) if words else (0, 0)
    plan = {"key": key, "words": words, "target": target, "n": n, "draws": passes * n, "last": None}
    if rest:
        short, at = block - (n * block - words), int(places(n, key, passes, [n - 1])[0])  # the stream's last block may be short
        m = -(-rest // block)
        if m > at:
            m = -(-(rest + block - short) // block)
        before = (m - 1) * block - (block - short if m - 1 > at else 0)
        plan |= {"draws": passes * n + m, "last": rest - before}
    return plan


def hypergeometric(rng, good: int, bad: int, need: int) -> int:
    """Good ones among ``need`` taken of good and bad; beyond the library's 10^9 by the normal limit."""
    if not good or not need:
        return 0
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, need)) if bad else need
    total = good + bad
    mean = need * good / total
    sd = (mean * (bad / total) * ((total - need) / max(1, total - 1))) ** 0.5
    return min(max(round(mean + sd * rng.standard_normal()), need - bad, 0), good, need)


class Tree:
    """The splitting tree over ``draws`` (one number a source) and output shards, worked out where it is asked.

    Nodes and ranges of sources are numbered like a heap: 1 is the whole, 2 x
    and 2 x + 1 are the halves of x.
    """

    def __init__(self, draws: list[int], shards: int, seed: int = SEED):
        self.shards, self.seed, self.sources, self.memo = shards, seed, len(draws), {}
        self.before = [0]
        for d in draws:
            self.before.append(self.before[-1] + d)

    @staticmethod
    def span(x: int, n: int) -> tuple[int, int]:
        """What part of 0..n heap number x is."""
        lo, hi = 0, n
        for bit in f"{x:b}"[1:]:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if bit == "1" else (lo, mid)
        return lo, hi

    @lru_cache(maxsize=4096)  # noqa: B019
    def leaf(self, source: int) -> int:
        x, lo, hi = 1, 0, self.sources
        while hi - lo > 1:
            mid = (lo + hi) // 2
            x, lo, hi = (2 * x, lo, mid) if source < mid else (2 * x + 1, mid, hi)
        return x

    def held(self, node: int, of: int) -> int:
        """Draws of the sources in range ``of`` that node ``node`` holds."""
        import numpy as np

        found = self.memo.get((node, of))
        if found is not None:
            return found
        if node == 1:
            lo, hi = self.span(of, self.sources)
            found = self.before[hi] - self.before[lo]
        elif node & 1:
            found = self.held(node >> 1, of) - self.held(node - 1, of)
        elif of == 1:
            lo, hi = self.span(node >> 1, self.shards)
            found = self.held(node >> 1, 1) * ((lo + hi) // 2 - lo) // (hi - lo)
        elif of & 1:
            found = self.held(node, of >> 1) - self.held(node, of - 1)
        else:
            good, bad, need = self.held(node >> 1, of), self.held(node >> 1, of + 1), self.held(node, of >> 1)
            found = hypergeometric(np.random.default_rng((self.seed, node, of)), good, bad, need)
        if len(self.memo) >= TREE_NODES:
            self.memo.clear()
        self.memo[node, of] = found
        return found

    def shard(self, source: int, draw: int) -> int:
        """The shard that a draw of a source goes to."""
        node, lo, hi, of = 1, 0, self.shards, self.leaf(source)
        while hi - lo > 1:
            mid, left = (lo + hi) // 2, self.held(2 * node, of)
            if draw < left:
                node, hi = 2 * node, mid
            else:
                node, lo, draw = 2 * node + 1, mid, draw - left
        return lo


def source_key(name: str = "source"):
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("n"))


def keyed(df: DataFrame, *more) -> DataFrame:
    """(doc_id, t, source_key, k, ...) of rows with doc_id, t and source_key; k numbers rows that are equal in these."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "t", "source_key").orderBy(F.lit(0)))).select(*KEY, *more)


def sized(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, t, source_key, k, size, h) of every document, saved."""
    text = text_or_empty()
    held = docs.select("doc_id", source_key().alias("source_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("t"))
    return save(keyed(held.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "t")), "size", "h"), f"{folder}/sized")


def catalogue(held: DataFrame, weights=WEIGHTS) -> tuple[dict, int]:
    """({source_key: plan}, documents)."""
    rows = held.groupBy("source_key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    found = rows.limit(MAX_SOURCES + 1).collect()  # sources, not documents
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source_key"][0] == "n", r["source_key"][1:]))
    goal = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))])
    return {r["source_key"]: planned(i, r["words"], t) for i, (r, t) in enumerate(zip(found, goal))}, sum(r["docs"] for r in found)


def shards_for(plans: dict) -> int:
    """Output shards so that one holds about SHARD_WORDS words, SHARDS at least."""
    return max(SHARDS, -(-round(sum(p["target"] for p in plans.values())) // SHARD_WORDS))


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, t, source_key, k, size, source_size, target, draws): the draws that take words of each document.

    A draw takes ``words`` words of the document from word ``at`` on, in pass
    ``epoch``, for output shard ``shard``.
    """
    return _mix(docs, shards)[0]


def _mix(docs: DataFrame, shards: int | None) -> tuple[DataFrame, int]:
    folder = scratch(docs.sparkSession, "mix")
    held = sized(docs, folder)
    plans, n = catalogue(held)
    shards = shards or shards_for(plans)
    tree = Tree([p["draws"] for p in plans.values()], shards)
    buckets = max(MIN_BUCKETS, -(-n // BUCKET_DOCS))
    dealt = held.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 16), F.lit(buckets)))
    sums = dealt.groupBy("source_key", "bucket").agg(F.sum("size").alias("of"))
    base = sums.select("source_key", "bucket", (F.sum("of").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("of")).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "t", "k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("inner", inner).join(base, ["source_key", "bucket"]).select(*KEY, "size", (F.col("base") + F.col("inner")).alias("start"))

    def drawn(p, rows, draws):
        """Add to ``draws`` the draws of the rows (number, start, size) of one source."""
        import numpy as np

        spans = [(i, start, size, start // BLOCK_WORDS, (start + size - 1) // BLOCK_WORDS) for i, start, size in rows]
        blocks, owner = np.concatenate([np.arange(a, b + 1) for *_, a, b in spans]), np.repeat(np.arange(len(spans)), [b - a + 1 for *_, a, b in spans])
        for epoch in range(-(-p["draws"] // p["n"])):
            place = epoch * p["n"] + places(p["n"], p["key"], epoch, blocks)
            hit = np.flatnonzero(place < p["draws"])
            for block, draw, k in zip(blocks[hit].tolist(), place[hit].tolist(), owner[hit].tolist()):
                i, start, size = spans[k][:3]
                begin = block * BLOCK_WORDS
                end = begin + p["last"] if p["last"] is not None and draw == p["draws"] - 1 else min(begin + BLOCK_WORDS, p["words"])
                a, b = max(begin, start), min(end, start + size)
                if a < b:
                    draws[i].append({"epoch": epoch, "block": block, "at": a - start, "words": b - a, "shard": tree.shard(p["key"], draw)})

    def run(batches):
        kinds = pa.list_(pa.struct([("epoch", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("words", pa.int64()), ("shard", pa.int32())]))
        for batch in batches:
            of = [plans[x] for x in batch.column("source_key").to_pylist()]
            draws, by_source = [[] for _ in of], {}
            for i, (p, start, size) in enumerate(zip(of, batch.column("start").to_pylist(), batch.column("size").to_pylist())):
                if size:
                    by_source.setdefault(p["key"], (p, []))[1].append((i, start, size))
            for p, rows in by_source.values():
                drawn(p, rows, draws)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*KEY, "size")), pa.array([p["words"] for p in of], pa.int64()), pa.array([p["target"] for p in of], pa.float64()), pa.array(draws, kinds)],
                names=[*KEY, "size", "source_size", "target", "draws"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    mixed = placed.mapInArrow(run, f"doc_id {kind}, t long, source_key string, k int, size long, source_size long, target double, draws {DRAWS}")
    return save(mixed, f"{folder}/mixed"), shards


def local_order(*of):
    """A shard's own shuffle."""
    return F.xxhash64(F.lit(SEED), *of)


def shard_rows(mixed: DataFrame) -> DataFrame:
    """(shard, place, doc_id, t, source_key, k, epoch, block, at, words): what each shard holds, in its shuffled order."""
    rows = mixed.select(*KEY, F.explode("draws").alias("d")).select("d.shard", *KEY, "d.epoch", "d.block", "d.at", "d.words")
    turn = Window.partitionBy("shard").orderBy(local_order("doc_id", "t", "k", "epoch"), "block", "at")
    return rows.withColumn("place", F.row_number().over(turn))


def taken(docs: DataFrame) -> DataFrame:
    """The query's columns, summed over what the shards hold, and ``shards``: shard:place:words of each piece, by shard."""
    mixed = mix(docs)
    own = [*KEY, "size", "source_size", "target"]
    piece = F.struct("shard", "place", "words")
    held = mixed.select(*own, F.lit(None).cast("struct<shard:int,place:int,words:bigint>").alias("p"))
    pieces = shard_rows(mixed.filter(F.size("draws") > 0)).select(*KEY, *[F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("source_size", "long"), ("target", "double"))], piece.alias("p"))
    each = held.unionByName(pieces).groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target")], F.sort_array(F.collect_list("p")).alias("p"))
    listed = F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["shard"].cast("string"), p["place"].cast("string"), p["words"].cast("string"))), ",")
    return each.select("doc_id", "size", "source_size", "target", F.aggregate("p", F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("taken"), listed.alias("shards"))


def materialise(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mixed documents: ``docs``' columns, one row for each pass and shard that takes words of a document.

    ``text`` holds the words taken (with the white space between adjacent
    ones; the whole text where all are), ``n_chars``, where there is one, its
    length.  Rows lie by output shard, in hashed order.
    """
    mixed, count = _mix(docs, shards)
    pieces = mixed.select(*KEY, F.col("size").alias("_size"), F.explode("draws").alias("d"))
    piece = F.struct("d.block", "d.at", "d.words")
    passes = pieces.groupBy(*KEY, "_size", F.col("d.epoch").alias("_epoch"), F.col("d.shard").alias("_shard")).agg(F.sort_array(F.collect_list(piece)).alias("_draws"))
    text = text_or_empty()
    held = docs.select(packed(docs), "doc_id", F.xxhash64(text).alias("t"), source_key().alias("source_key"))
    rows = keyed(held, "_row")
    same = rows["doc_id"].eqNullSafe(passes["doc_id"])
    for c in KEY[1:]:
        same = same & (rows[c] == passes[c])
    joined = rows.join(passes.hint("merge"), same).select("_row", rows["t"], rows["k"], "_size", "_epoch", "_shard", "_draws")
    whole = F.aggregate("_draws", F.lit(0).cast("long"), lambda s, d: s + d["words"]) == F.col("_size")
    # Pieces of a text by word numbers: its words with the white space that precedes each.
    words = F.regexp_extract_all(text_or_empty("_row.text"), F.lit(r"(?s)[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.array_join(F.flatten(F.transform("_draws", lambda d: F.slice(words, (d["at"] + 1).cast("int"), d["words"].cast("int")))), "")
    cut = F.regexp_replace(some, r"^[\x20\x09-\x0D]+", "")
    row = F.col("_row").withField("text", F.when(whole, F.col("_row.text")).otherwise(cut))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(row["text"]).cast(dict(docs.dtypes)["n_chars"]))
    out = joined.select(row.alias("_row"), "_shard", "_epoch", "t", "k")
    parts = min(count, PARTITIONS)
    dealt = out.repartitionById(parts, F.pmod(F.col("_shard"), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("_shard", local_order("_row.doc_id", "t", "k", "_epoch")).select("_row.*")
