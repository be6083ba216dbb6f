"""Suffix-array dedup: long repeats marked with a run-length index (run-compressed BWT with sampled run ends).

A window is a string of `least` bytes. Each window picks its anchor: the 32 bytes in it whose hash is least. Equal
windows pick equal anchors at the same place, and hold the anchor with half of their other bytes before or after it: a
window can only repeat in the group of that longer string's hash. The bytes around each such string that occurs again
are its context. Equal contexts have one representative; those of a group are trimmed to what another member can match,
and indexed together; matching statistics streamed from the index's sampled run ends mark the windows that repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import attach_skewed, cut, free_memory, hot_keys, partitions, table

#: Bytes of an anchor.
GRAM = 32
#: Texts are looked at in pieces of at most so many window starts.
PIECE = 1 << 20
#: Different contexts that a group is indexed with at most; a longer one is divided into its single windows.
GROUP_ROWS = 4_000
#: Contexts of an index at most, unless one group has more: groups are indexed together up to so many.
INDEX_ROWS = 1_000
#: Bytes of texts or contexts after which a task hands on what it made of them.
OUT_BYTES = 8_000_000
_rng = np.random.default_rng(5)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def anchors(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, starts, place) of groups of windows; each start is in one.

    The windows of an anchor make two groups at most: those with half of the other bytes or more before the anchor have
    the hash of that half and the anchor as their key, the others that of the anchor and the half after it. `place` is
    the anchor's, counted from the first start.
    """
    half = (least - GRAM) // 2
    at_core = [*range(0, half, GRAM), half]  # strings of GRAM bytes that cover both
    out = [[np.zeros(0, np.int64)] * 4]
    width = least - GRAM + 1
    for at in range(0, len(text) - least + 1, PIECE):
        h = _TABLE[np.frombuffer(text[at : at + PIECE + least - 1], np.uint8)]
        k = 1
        for step in _STEPS:
            h = h[:-k] * step + h[k:]
            k *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # the least hash wins, of equal ones the last
        v = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        k = 1
        while 2 * k <= width:
            v = np.minimum(v[:-k], v[k:])
            k *= 2
        v = np.minimum(v[: len(v) - (width - k)], v[width - k :])
        place = (_LOW - (v & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        for side, lo, hi in ((1, first, np.minimum(last, place - half)), (0, np.maximum(first, place - half + 1), last)):
            on = lo <= hi
            key = np.full(np.count_nonzero(on), side, np.uint64)
            for c, mix in zip(at_core, np.resize(_TABLE, len(at_core))):
                key = (key ^ h[place[on] - side * half + c]) * mix
                key ^= key >> np.uint64(31)
            out.append([key.view(np.int64), lo[on] + at, (hi - lo)[on] + 1, (place - lo)[on]])
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_order(text: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """The suffix array of `text` (0: separator, else byte + 1), suffixes ending at their separator, ties by place."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(6, text.dtype)))
    pack, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(7):
        c = np.where(ended, 0, padded[j : j + n])
        pack <<= 9
        pack |= c
        ended |= c == 0
    # a suffix that ends here differs from all others: its separator's number decides
    tail = np.where(ended, sep, 0)
    del padded, ended, c
    order = np.lexsort((tail, pack)).astype(np.int32)
    pack, tail = pack[order], tail[order]
    new = np.concatenate(([True], (pack[1:] != pack[:-1]) | (tail[1:] != tail[:-1])))
    del pack, tail
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    h = 7
    open_ = order[~(new & np.append(new[1:], True))]  # suffixes that share a rank with others
    while len(open_):
        nxt = rank[np.minimum(open_ + h, n - 1)]
        by = np.lexsort((nxt, rank[open_]))
        o, r, x = open_[by], rank[open_][by], nxt[by]
        group = np.concatenate(([True], r[1:] != r[:-1]))
        new = group | np.concatenate(([True], x[1:] != x[:-1]))
        place = np.arange(len(o), dtype=np.int32)
        first = np.maximum.accumulate(np.where(group, place, 0))
        rank[o] = r + np.maximum.accumulate(np.where(new, place, 0)) - first
        open_ = o[~(new & np.append(new[1:], True))]
        h *= 2
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return order


def matching_lengths(parts: list[bytes]) -> np.ndarray:
    """For each byte of the parts, each closed by a separator: the longest string from there that also starts
    elsewhere in the parts.

    The suffix order gives the Burrows-Wheeler transform; only where its runs start and end are suffixes sampled and
    compared with their neighbours. Inside a run the neighbour of the next suffix is the next of the neighbour, so
    the lengths of all other places follow in one stream over the text: each is one less than that before it.
    """
    n = sum(map(len, parts)) + len(parts)
    text = np.zeros(n, np.int16)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    body = np.ones(n, bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    sep = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(np.append(-1, ends)))
    order = suffix_order(text, sep)
    bwt = np.where(order > 0, text[order - 1], 0)
    head = np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)))  # separators differ from one another
    starts = np.flatnonzero(head)[1:]
    here, there = order[starts], order[starts - 1]
    common, live = np.zeros(len(starts), np.int32), np.arange(len(starts))
    while len(live):
        a, b = text[here[live] + common[live]], text[there[live] + common[live]]
        live = live[(a == b) & (a > 0)]
        common[live] += 1
    first, last = order[0], order[-1]
    del body, sep, order, bwt, head, starts
    places = np.arange(n, dtype=np.int32)
    best = np.zeros(n, np.int32)
    for sampled, none in ((here, first), (there, last)):  # with the suffix before at run starts, with that after at run ends
        reach = np.full(n, -1, np.int32)
        reach[none] = none
        reach[sampled] = sampled + common
        at = np.maximum.accumulate(np.where(reach >= 0, places, -1))
        length = np.where(at >= 0, reach[np.maximum(at, 0)] - places, 0)
        np.maximum(best, length, out=best)
    return best


class Marker:
    """Contexts of whole groups in; spans of repeated windows out."""

    def __init__(self, least: int):
        self.least = least

    def spans(self, key: np.ndarray, context: list[bytes], place: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each context (first, last) in window starts counted from its first; `starts` windows from there belong to it.

        `place` is the anchor's place in its context; n tells how often the context occurs.
        """
        least = self.least
        low_, high = self._reach(key, [c[p::-1] if p else c[:1] for c, p in zip(context, place)]), self._reach(key, [c[p:] for c, p in zip(context, place)])
        # the anchor's first byte is on both sides; a window that starts at s reaches place - s bytes to its left
        first = np.where(n > 1, 0, np.maximum(0, place - (low_ - 1)))
        last = np.where(n > 1, starts - 1, np.minimum(starts - 1, place + high - least))
        cutout: dict[tuple[int, bytes], list[int]] = {}
        for i in np.flatnonzero(first <= last).tolist():
            cutout.setdefault((int(key[i]), context[i][first[i] : last[i] + least]), []).append(i)
        found: list[list[tuple[int, int]]] = [[] for _ in context]
        if not cutout:
            return found
        length = matching_lengths([c for _, c in cutout])
        at = 0
        for (_, c), own in cutout.items():
            k = len(c) - least + 1
            on = np.full(k, True) if n[own].sum() > 1 else length[at : at + k] >= least
            at += len(c) + 1
            for i in own:
                found[i] = [(int(first[i]) + a, int(first[i]) + b) for a, b in runs(on)]
        return found

    def _reach(self, key: np.ndarray, side: list[bytes]) -> np.ndarray:
        """How many first bytes of each string another of its key shares at most."""
        size = np.fromiter(map(len, side), np.int64, len(side))
        width = int(size.max())
        m = np.zeros((len(side), width + 8), np.uint8)
        m[:, :8] = (key.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        m[:, 8:][np.arange(width)[None] < size[:, None]] = np.frombuffer(b"".join(side), np.uint8)
        order = np.argsort(m.view(f"S{width + 8}").ravel(), kind="stable")
        m, size = m[order], size[order]
        apart = m[1:] != m[:-1]
        same = np.where(apart.any(1), apart.argmax(1), width + 8) - 8  # below 0: another key
        same = np.clip(np.minimum(same, np.minimum(size[1:], size[:-1])), 0, None)
        out = np.zeros(len(order), np.int64)
        out[order] = np.maximum(np.append(0, same), np.append(same, 0))
        return out


def runs(on: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _found(key: list[int], d: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    on = [i for i, x in enumerate(spans) if x]
    columns = [pa.array([key[i] for i in on], pa.int64()), pa.array([d[i] for i in on], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in spans[i]] for i in on], _SPANS)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "d", "spans"])


def _mark(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(least)
        names = ["key", "d", "copies", "context", "place", "starts"]
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(t: pa.Table) -> pa.RecordBatch:
            key, n, place, starts = (t[c].to_numpy().astype(np.int64) for c in ("key", "copies", "place", "starts"))
            return _found(key.tolist(), t["d"].to_pylist(), marker.spans(key, t["context"].to_pylist(), place, starts, n))

        def index(t: pa.Table, ended: bool) -> Iterator[tuple[int, int]]:
            """The first row of each index and that after its last; without `ended`, the last group may go on and is left."""
            key = t["key"].to_numpy()
            border = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), *[len(key)] * ended]
            at = 0
            for x, y in zip(border, [*border[1:], None]):
                if y is None or y - at > INDEX_ROWS:
                    yield at, x
                    at = x

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= INDEX_ROWS:
                t = pa.Table.from_batches(held).select(names)
                done = 0
                for x, done in index(t, False):
                    yield flush(t.slice(x, done - x))
                held, rows = t.slice(done).to_batches(), t.num_rows - done
        if held:
            t = pa.Table.from_batches(held).select(names)
            for x, y in index(t, True):
                yield flush(t.slice(x, y - x))
        free_memory()

    return run


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about OUT_BYTES of the texts in that column, so that no result is held for a whole batch."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = np.flatnonzero(np.diff(size // OUT_BYTES, prepend=-1)).tolist()
        for x, y in zip(first, [*first[1:], b.num_rows]):
            yield b.slice(x, y - x)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated windows of each context (key, d, s: array of starts)."""
    for b in batches:
        spans = []
        for s in b.column(2):
            on = np.zeros(max(s.as_py()) + 1, bool)
            on[s.as_py()] = True
            spans.append(runs(on))
        yield _found(b.column(0).to_pylist(), b.column(1).to_pylist(), spans)


def find_repeats(df: DataFrame, id_col: str, text_col: str, least: int = 400) -> DataFrame:
    """id, n_bytes, spans (array of start, end in UTF-8 bytes), kept (the remaining bytes): one row for each row.

    A span is a maximal run of bytes that are covered by strings of `least` bytes that also start elsewhere, in this
    text or another; overlaps count, and strings never cross texts. Rows of equal texts are each other's elsewhere.
    Null texts count as empty; texts under `least` bytes have no spans. Ids may repeat or be null. A group of more than
    GROUP_ROWS different contexts (a passage in as many surroundings) is divided into single windows: each is then a
    group of its own, of one string, whose copies are counted.
    """
    spark = df.sparkSession
    n = partitions(spark)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", F.unhex(F.md5("text")))
    known = rows.groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    texts = rows.select("t", F.col("text").cast("binary").alias("text")).dropDuplicates(["t"])

    kinds = [("key", pa.int64()), ("d", pa.binary()), ("lo", pa.int32()), ("starts", pa.int32()), ("place", pa.int32())]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            ts: list[bytes] = []
            out: list[list] = [[] for _ in kinds]
            for t, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                if len(text) >= least:
                    key, lo, starts, place = anchors(text, least)
                    ends = (lo + starts - 1 + least).tolist()
                    d = [hashlib.blake2b(text[x:y], digest_size=8, salt=b"%d" % p).digest() for x, y, p in zip(lo.tolist(), ends, place.tolist())]
                    ts.append(t.as_py())
                    for x, v in zip(out, (key, d, lo, starts, place)):
                        x.append(v)
            columns = [pa.array(ts, pa.binary()), *[pa.array(x, pa.list_(k)) for x, (_, k) in zip(out, kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=["t", *[c for c, _ in kinds]])
        free_memory()

    # what copies have is thrown away again: that moves far fewer bytes than their texts would
    fields = "key array<long>, d array<binary>, lo array<int>, starts array<int>, place array<int>"
    every = rows.select("t", F.col("text").cast("binary").alias("text")).mapInArrow(packed, f"t binary, {fields}")
    found = cut(every.dropDuplicates(["t"]))
    again = cut(found.select(F.explode("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    member = found.select("t", F.inline(F.arrays_zip(*[c for c, _ in kinds])))
    member = cut(attach_skewed(member, again, hot_keys(again, "key"), "key", ["t", "lo"]).drop("n"))
    # one representative of equal contexts
    one = cut(member.groupBy("key", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "lo", "starts", "place")).alias("x")))
    long_ = cut(one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS).withColumn("ways", F.ceil(F.col("n") / GROUP_ROWS)))
    shown = attach_skewed(one.withColumnRenamed("n", "copies"), long_, hot_keys(long_, "key"), "key", ["d"], "left")
    shown = shown.select("x.t", F.struct("key", "d", "copies", "x.lo", "x.starts", "x.place", F.coalesce("ways", F.lit(0).cast("long")).alias("ways")).alias("x"))
    shown = shown.groupBy("t").agg(F.collect_list("x").alias("x"))
    names = ["key", "d", "copies", "context", "place", "starts", "ways"]
    types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for text, some in zip(*b.columns):
                text = text.as_py()
                for x in some.as_py():
                    lo, end = x["lo"], x["lo"] + x["starts"]
                    x["context"] = text[lo : end - 1 + least]
                    if x["ways"]:  # a digest for each window
                        x["context"] = b"".join(hashlib.blake2b(text[k : k + least], digest_size=16).digest() for k in range(lo, end))
                    size += len(x["context"])
                    for y, c in zip(out, names):
                        y.append(x[c])
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, types)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, types)], names=names)
        free_memory()

    around = texts.join(shown, "t").select("text", "x").mapInArrow(contexts, "key long, d binary, copies long, context binary, place int, starts int, ways long")
    results = "key long, d binary, spans array<struct<a: int, b: int>>"
    marked = around.where("ways = 0").drop("ways").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_mark(least), results)
    if not long_.isEmpty():
        each = F.expr("transform(sequence(0, starts - 1), s -> substring(context, 16 * s + 1, 16))")
        windows = around.where("ways > 0").select("key", "d", "copies", "ways", F.posexplode(each).alias("s", "w"))
        # a window's rows are dealt out in parts by the number of contexts of its group
        windows = windows.withColumn("part", F.pmod(F.xxhash64("d"), F.col("ways")))
        twice = windows.groupBy("w").agg(F.sum("copies").alias("times"), F.max("ways").alias("ways")).where("times > 1")
        twice = twice.select("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("part"))
        repeated = windows.join(twice, ["w", "part"]).groupBy("key", "d").agg(F.collect_list("s").alias("s"))
        marked = marked.union(repeated.mapInArrow(_merge, results))
    spans = attach_skewed(member, marked.withColumnRenamed("key", "k"), hot_keys(one, "d"), "d", ["t", "lo"]).where("key = k").select("t", "lo", F.explode("spans").alias("x"))
    spans = spans.select("t", (F.col("lo") + F.col("x.a")).cast("long").alias("a"), (F.col("lo") + F.col("x.b") + least).cast("long").alias("b"))
    spans = spans.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            out: list[list] = [[], [], [], []]
            for t, text, copies, spans in zip(*b.columns):
                text = text.as_py()
                merged: list[list[int]] = []
                if copies.as_py() > 1 and len(text) >= least:
                    merged = [[0, len(text)]]
                else:
                    for s in spans.as_py() or ():
                        if merged and s["a"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["b"])
                        else:
                            merged.append([s["a"], s["b"]])
                cuts = [0, *[x for s in merged for x in s], len(text)]
                kept = b"".join(text[a:c] for a, c in zip(cuts[::2], cuts[1::2]))
                for x, v in zip(out, (t.as_py(), len(text), [{"start": s, "end": e} for s, e in merged], kept)):
                    x.append(v)
            kind = (pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kind)], names=["t", "n_bytes", "spans", "kept"])
        free_memory()

    full = texts.join(known, "t").join(spans, "t", "left").select("t", "text", "copies", "spans")
    done = full.mapInArrow(remove, "t binary, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return rows.select("id", "t").join(done, "t").select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
