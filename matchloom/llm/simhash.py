"""SimHash near-dedup: fingerprints of word shingles, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import attach, cut, free_memory, partitions, table
from matchloom.llm.components import connected_components, local_roots

HASH_SEED = 42
#: Children of an index node, and words that go down an index at once.
FANOUT, AT_ONCE = 8, 65_536


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; fewer words make one shingle, none make none."""
    tokens = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    starts = np.concatenate(([0], ends[: len(tokens) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def simhash(h: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half the hashes; 0 where there are none."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 where there is no word."""
    return simhash(shingle_hashes(text, words))


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp: the fingerprint's bits as a signed long), one row for each row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    inner = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return inner.mapInArrow(run, inner.drop("text").schema.add("fp", "long"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in Gray order, where neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


@dataclass
class Turns:
    """Orders of a word's blocks: each puts two of bits + 2 blocks on top, on which words within the limit agree at least once."""

    bits: int

    def __post_init__(self):
        n = self.bits + 2
        cuts = [64 * i // n for i in range(n + 1)]
        self.blocks = list(zip(cuts, (b - a for a, b in zip(cuts, cuts[1:]))))
        self.orders = [[i, j, *(x for x in range(n) if x not in (i, j))] for i, j in combinations(range(n), 2)]
        #: Bits of each order's two blocks on top, as a mask.
        self.tops = [((1 << (self.blocks[o[0]][1] + self.blocks[o[1]][1])) - 1) << (64 - self.blocks[o[0]][1] - self.blocks[o[1]][1]) for o in self.orders]

    def turn(self, x: np.ndarray, k: int, back: bool = False) -> np.ndarray:
        """Words with their blocks in order k, or back from it."""
        out, at = np.zeros_like(x), 64
        for i in self.orders[k]:
            low, width = self.blocks[i]
            at -= width
            a, b = (at, low) if back else (low, at)
            out |= ((x >> np.uint64(a)) & np.uint64((1 << width) - 1)) << np.uint64(b)
        return out


def apart(x: np.ndarray, pattern: np.ndarray, mask: np.ndarray, top: int) -> np.ndarray:
    """Differences from a pattern on its mask; any difference on the bits of `top` counts as 64."""
    d = (x ^ pattern) & mask
    return np.bitwise_count(d) + np.where(d & np.uint64(top), np.uint8(64), np.uint8(0))


class GrayIndex:
    """A hierarchy over words in Gray order. A node holds the bits that all words under it share: a mask and a pattern."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.levels, self.first = [(np.full(len(words), ~np.uint64(0)), words)], [np.arange(len(words))]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FANOUT)
            one, zero = np.bitwise_and.reduceat(pattern & mask, at), np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((one | zero, one))
            self.first.append(self.first[-1][at])

    def links(self, search: np.ndarray, bits: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in search, in words) that tie each searched word to all words within `bits` bits that agree on `top`.

        A search goes down from the root, adds up the differences on the bits that a node's words share, and drops the
        node with all that is under it beyond the limit. A node whose free bits cannot pass the limit any more is tied
        as one: all its words are within the limit of its first.
        """
        for at in range(0, len(search), AT_ONCE):
            x = search[at : at + AT_ONCE]
            q, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[depth]
                # the masks of a path grow, so the sum over the path's new bits is the difference on the node's own mask
                d = apart(x[q], pattern[node], mask[node], top)
                on = d <= bits
                q, node, d = q[on], node[on], d[on]
                free = ~mask[node]
                whole = (d + np.bitwise_count(free) <= bits) & (free & np.uint64(top) == 0)
                yield q[whole] + at, self.first[depth][node[whole]]
                q, node = q[~whole], node[~whole]
                if depth:
                    q = np.repeat(q, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    on = node < len(self.levels[depth - 1][0])
                    q, node = q[on], node[on]


def tied(words: np.ndarray, guests: np.ndarray, bits: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, smallest word tied to it) for those of words and guests that the index of the words ties to another."""
    order = np.argsort(gray_rank(words), kind="stable")
    every = np.concatenate((words[order], guests))
    found = list(GrayIndex(every[: len(words)]).links(every, bits, top)) if len(words) else []
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    root = local_roots(len(every), a, b)
    on = np.flatnonzero(root != np.arange(len(every)))
    return every[on], every[root[on]]


def near_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that tie all words of `fps` (fp: distinct longs) within `bits` bits of each other.

    Words within the limit agree on two of bits + 2 blocks at least, so each word is put into one Gray order for each
    pair of blocks, with the pair on top. An order is dealt out by ranges of its ranks; an index holds one range. The
    bits that a range's words share are its node one level up. These upper nodes, one or two a range, are sent to all
    tasks: a word searches its own range and each later one that can hold words of its top bits and that its node does
    not rule out. So near words of one pair of blocks fill as many ranges as they need. Links leave a range as a forest.
    """
    spark = fps.sparkSession
    turns, n = Turns(bits), partitions(fps.sparkSession)
    sign = np.uint64(1 << 63)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for k in range(len(turns.orders)):
                w = turns.turn(x, k)
                columns = [pa.array(np.full(len(w), k, np.int32)), pa.array((gray_rank(w) ^ sign).view(np.int64)), pa.array(w.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["turn", "rank", "word"])

    dealt = fps.select("fp").mapInArrow(turned, "turn int, rank long, word long").repartitionByRange(n, "turn", "rank")
    dealt = cut(dealt.withColumn("range", F.spark_partition_id()))
    upper = dealt.groupBy("turn", "range").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.bit_and("word").alias("ones"), F.bit_or("word").alias("some"))
    upper = upper.orderBy("turn", "low").toPandas()  # a row for each range, and one more for each turn at most
    nodes = {k: u.drop(columns="turn").to_numpy(np.int64).T.copy() for k, u in upper.groupby("turn")}
    sent = spark.sparkContext.broadcast(nodes)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(turn: int, at: np.ndarray, word: np.ndarray, guest: bool) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(word), turn, np.int32)), pa.array(at.astype(np.int32)), pa.array(word), pa.array(np.full(len(word), guest))]
            return pa.RecordBatch.from_arrays(columns, names=["turn", "range", "word", "guest"])

        for b in batches:
            turn, rank, word, own = (b.column(i).to_numpy() for i in range(4))
            for k in np.unique(turn).tolist():
                on = turn == k
                r, w, o = rank[on], word[on], own[on]
                yield batch_of(k, o, w, False)
                at, low, high, ones, some = sent.value[k]
                rest = ~turns.tops[k] & (2**64 - 1)
                # the top bits of a rank depend on the top bits of the word only
                last = np.searchsorted(low, (r.view(np.uint64) | np.uint64(rest)).view(np.int64), "right")
                next_ = np.searchsorted(low, low[np.searchsorted(high, r)], "right")
                mask, pattern = (ones | ~some).view(np.uint64), ones.view(np.uint64)
                while len(r := np.flatnonzero(next_ < last)):
                    x = next_[r]
                    d = apart(w[r].view(np.uint64), pattern[x], mask[x], turns.tops[k])
                    yield batch_of(k, at[x[d <= bits]], w[r[d <= bits]], True)
                    next_[r] += 1

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            turn, word, guest = (t[c].to_numpy() for c in ("turn", "word", "guest"))
            for k in np.unique(turn).tolist():
                w, g = word[turn == k].view(np.uint64), guest[turn == k]
                ends = tied(w[~g], w[g], bits, turns.tops[k])
                yield pa.RecordBatch.from_arrays([pa.array(turns.turn(x, k, True).view(np.int64)) for x in ends], names=["a", "b"])

        for b in batches:  # sorted by range
            at = b.column(1).to_numpy()
            for part in np.split(np.arange(len(at)), np.flatnonzero(at[1:] != at[:-1]) + 1):
                if held and len(part) and held[-1].column(1)[0].as_py() != at[part[0]]:
                    yield from links()
                    held = []
                if len(part):
                    held.append(b.slice(part[0], len(part)))
        if held:
            yield from links()

    asked = dealt.select("turn", "rank", "word", "range").mapInArrow(visits, "turn int, range int, word long, guest boolean")
    return asked.repartition(n, "range").sortWithinPartitions("range").mapInArrow(link, "a long, b long").distinct()


def near_dedup(df: DataFrame, id_col: str, text_col: str, words: int = 5, bits: int = 3) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row: component_id is the smallest id reachable by links.

    Fingerprints link at `bits` or fewer differing bits. Equal fingerprints are one node, so copies never make pairs.
    Texts without a word (null, empty, white space) have fingerprint 0 and link like others; a text of fewer than
    `words` words is one shingle. Null ids get the smallest non-null id of their component, or null. Repeated rows
    stay. An empty table gives no rows.
    """
    docs = cut(fingerprints(df, id_col, text_col, words))
    nodes = cut(docs.groupBy("fp").agg(F.min("id").alias("low")))
    roots = connected_components(near_links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    of = nodes.join(least, "root").select("fp", "component_id")
    return docs.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Minima of a signature, and how many in a row make a key of candidates: at a similarity of 0.8, 997 in 1,000 pairs share one.
MINIMA, RUN = 256, 8
#: Groups of candidates whose pairs are listed at once; larger ones are compared block by block, of so many texts each.
PAIRED, BLOCK = 16, 1_024
#: Estimates this far from the wanted similarity, four standard deviations at 0.8, are decided; the shingles decide between.
SLACK = 0.1
_MIX = np.random.default_rng(3).integers(1, 1 << 63, (2, MINIMA), dtype=np.uint64) | np.uint64(1)


def signature(h: np.ndarray) -> bytes:
    """16 bits of the least of the hashes under each of MINIMA permutations; no hashes give an empty signature."""
    if not len(h):
        return b""
    h = np.unique(h)
    least = np.full(MINIMA, ~np.uint64(0))
    for at in range(0, len(h), 256):
        x = h[at : at + 256, None] * _MIX[0][None] + _MIX[1][None]
        np.minimum(least, x.min(0), out=least)
    least ^= least >> np.uint64(32)
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2").tobytes()


def fingerprint_ties(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b) that tie the nodes (node, fp) whose fingerprints link at `bits` or fewer differing bits: each to the smallest of its component."""
    roots = connected_components(near_links(nodes.select("fp").distinct(), bits)).withColumnRenamed("node", "fp")
    of = nodes.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("node").alias("b"))
    return of.join(low, "root").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_copies(df: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, bits: int | None = None) -> DataFrame:
    """(id, component_id), one row for each row, for texts whose sets of word shingles are `similarity` alike or more.

    With `bits`, texts are linked as by near_dedup first: all whose SimHash differs in so many bits or fewer, through the
    Gray-order index. What follows then adds the pairs that SimHash's distance leaves open, and decides no pair that is tied.

    A 64-bit SimHash of texts that are 0.8 alike differs in 5 to 17 bits, as that of many that are not, and no index
    finds such distances without comparing most pairs. Candidates therefore share a run of a signature's minima; 3 in
    1,000 pairs of 0.8 share none. All pairs of a group are decided: signatures estimate the similarity, and within
    SLACK of `similarity` the sets of shingle hashes (32 bits of each) decide, unless other links tie both texts. In groups above PAIRED, texts that the first of the group
    and the Gray order of the SimHash have tied already are not compared with each other. Equal sets are one node.
    Texts without a word are copies of each other. Null ids get the smallest non-null id of their group. An empty
    table gives no rows.
    """
    spark = df.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                fp, node, sig = [], [], []
                for t in batch.column(2):
                    h = shingle_hashes(t.as_py(), words)
                    fp.append(simhash(h))
                    sig.append(signature(h))
                    node.append(xxhash.xxh64_intdigest(np.unique(h).tobytes()) >> 4)
                columns = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(node, pa.int64()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["id", "t", "fp", "node", "sig"])
        free_memory()

    inner = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("t"), F.col(text_col).alias("text"))
    docs = cut(inner.mapInArrow(sketch, inner.drop("text").schema.add("fp", "long").add("node", "long").add("sig", "binary")))
    nodes = docs.groupBy("node").agg(F.min("id").alias("low"), F.min("t").alias("t"), F.min("fp").alias("fp"), F.min("sig").alias("sig"))
    nodes = cut(nodes)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, node, fp = [], [], []
            for n, f, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                for k in range(0, len(s), 2 * RUN):
                    key.append(xxhash.xxh64_intdigest(s[k : k + 2 * RUN], k) >> 1)
                    node.append(n)
                    fp.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(fp, pa.int64())], names=["key", "node", "fp"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the last key's rows

        def made(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((node, gray_rank(fp.view(np.uint64)), key))
            key, node = key[order], node[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            small = np.repeat(size <= PAIRED, size)
            i, j = [np.flatnonzero(key[:-1] == key[1:])], []
            j.append(i[0] + 1)
            for step in range(2, PAIRED):
                x = np.flatnonzero(small[:-step] & (key[:-step] == key[step:]))
                i.append(x)
                j.append(x + step)
            first = np.repeat(start, size)
            x = np.flatnonzero(~small & (np.arange(len(key)) > first + 1))
            a, b = node[np.concatenate((*i, first[x]))], node[np.concatenate((*j, x))]
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            large = np.concatenate((np.zeros(len(both), bool), np.ones(np.count_nonzero(~small), bool)))
            a, b = np.concatenate((both[:, 0], key[~small])), np.concatenate((both[:, 1], node[~small]))
            return pa.RecordBatch.from_arrays([pa.array(large), pa.array(a), pa.array(b)], names=["large", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(3)]
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            if whole or (held and held[-1][0][-1] != columns[0][0]):  # another key begins
                held.append([c[:whole] for c in columns])
                yield made(*(np.concatenate(c) for c in zip(*held)))
                held, columns = [], [c[whole:] for c in columns]
            held.append(columns)
        if held:
            yield made(*(np.concatenate(c) for c in zip(*held)))

    rows = nodes.select("node", "fp", "sig").mapInArrow(runs, "key long, node long, fp long")
    rows = rows.repartition(partitions(spark), "key").sortWithinPartitions("key")
    rows = cut(rows.mapInArrow(pairs, "large boolean, a long, b long"))  # pairs, or key and node of a large group
    candidates = rows.where("NOT large").select("a", "b").distinct()
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"{c}_sig"))
    both = candidates.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_sig", "b_sig")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, MINIMA) for k in (2, 3))
                share = (x == y).mean(1)
                on = pa.array(share >= similarity - SLACK)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on), pa.array(share >= similarity + SLACK).filter(on)], names=["a", "b", "sure"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique((shingle_hashes(t.as_py(), words) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def sets_of(some: DataFrame) -> DataFrame:
        """(node, shingles) for nodes with the digest `t` of a text that has them."""
        texts = attach(inner.select("t", "text"), some, ["t"]).select("node", "text").dropDuplicates(["node"])
        return texts.mapInArrow(shingles, "node long, shingles binary")

    judged = both.mapInArrow(alike, "a long, b long, sure boolean")
    if bits is not None:
        judged = judged.union(fingerprint_ties(docs.select("node", "fp").distinct(), bits).select("a", "b", F.lit(True)))
    judged = cut(judged)
    large = rows.where("large").select(F.col("a").alias("key"), F.col("b").alias("node"))
    if not large.isEmpty():
        members = cut(nodes.select("node", "t").join(large.select("node").distinct(), "node"))
        members = nodes.select("node", "sig").join(sets_of(members), "node")
        judged = cut(judged.union(_large_groups(large, judged.where("sure"), members, similarity)))
    # what the sure links tie needs no decision
    certain = connected_components(judged.where("sure").select("a", "b"))
    unsure = judged.where("NOT sure").select("a", "b").distinct()
    for c in ("a", "b"):
        unsure = unsure.join(certain.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    unsure = cut(unsure.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
    ends = unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = cut(nodes.select("node", "t").join(ends, "node"))

    sets = sets_of(ends)
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_ = lambda v: np.frombuffer(v.as_py(), np.uint32)
            on = pa.array([_alike(of_(x), of_(y), similarity) for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], names=["a", "b"])

    decided = unsure.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(decide, "a long, b long")
    roots = connected_components(certain.select(F.col("node").alias("a"), F.col("root").alias("b")).union(decided)).withColumnRenamed("node", "n")
    tied = nodes.select("node", "low").join(roots, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "node"))
    least = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    return docs.select("id", "node").join(tied.join(least, "root").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _large_groups(large: DataFrame, sure: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure) for the pairs of large groups (key, node) that `sure` does not tie: a forest of those that are alike.

    Signatures and sets (node, sig, shingles) go to the tasks, which decide all pairs that they have not tied yet.
    A component of BLOCK texts or more of a group has blocks of its own, the others share blocks; each pair of blocks
    is one task, but for those of one component.
    """
    roots = connected_components(sure.select("a", "b"))
    large = cut(large.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    own = F.when(F.col("n") >= BLOCK, F.col("root")).otherwise(-1)  # nodes are not negative
    sizes = cut(large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).withColumn("own", own))
    marks = cut(sizes.groupBy("key", "own").agg(F.count(F.lit(1)).alias("roots"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts")))
    name = lambda part: F.concat_ws(":", F.col("own").cast("string"), part.cast("string"))
    blocks = marks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "own", "roots", name(F.col("part")).alias("i"))
    tasks = blocks.join(blocks.select("key", F.col("own").alias("other"), F.col("i").alias("j")), "key").where("i <= j AND (own <> other OR own = -1 AND roots > 1)")
    tasks = tasks.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    members = large.join(sizes.select("key", "root", "own"), ["key", "root"]).join(marks.select("key", "own", "parts"), ["key", "own"])
    members = members.select("key", "node", "root", name(F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    dealt = members.join(tasks, ["key", "block"]).join(sets, "node").select("key", "i", "j", (F.col("block") == F.col("i")).alias("first"), "node", "root", "sig", "shingles")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group.sig), "<u2").reshape(-1, MINIMA)
        node, root, first = group.node.to_numpy(), group.root.to_numpy(), group["first"].to_numpy(bool)
        same = group.i.iloc[0] == group.j.iloc[0]
        start, stop = (np.arange(len(x)), None) if same else (np.flatnonzero(first), np.flatnonzero(~first))
        tie = np.unique(root, return_inverse=True)[1]
        own = [np.frombuffer(v, np.uint32) for v in group.shingles]
        runs, key = x.reshape(len(x), -1, RUN), int(group.key.iloc[0])
        this = next(k for k in range(runs.shape[1]) if xxhash.xxh64_intdigest(runs[0, k].tobytes(), 2 * RUN * k) >> 1 == key)
        found_a, found_b = [], []
        for i in start:
            j = np.arange(i + 1, len(x)) if same else stop
            j = j[tie[j] != tie[i]]
            share = (x[j] == x[i]).mean(1)
            on = share >= similarity - SLACK
            j, certain = j[on], share[on] >= similarity + SLACK
            for t in np.unique(tie[j[certain]]):
                k = j[certain][tie[j[certain]] == t][0]
                found_a.append(i), found_b.append(k)
                tie[tie == t] = tie[i]
            j = j[~certain]
            j = j[(runs[j] == runs[i]).all(2).argmax(1) == this]  # a pair is decided where it shares its first run
            for k in j:
                if tie[k] != tie[i] and _alike(own[i], own[k], similarity):
                    found_a.append(i), found_b.append(k)
                    tie[tie == tie[k]] = tie[i]
        a, b = node[np.array(found_a, np.int64)], node[np.array(found_b, np.int64)]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": np.ones(len(a), bool)})

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long, sure boolean")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, bits=2)
