"""Suffix-array deduplication: removes every byte that a repeated string of `LENGTH` bytes covers.

Only suffixes that can share LENGTH bytes with another are sorted.  Each window of LENGTH bytes has an anchor, its
KMER-byte piece with the least hash, so equal windows have equal anchors at equal places.  Successive windows with one
anchor are a run.  Runs are counted by anchor: those whose anchor occurs once hold nothing repeated; those whose anchor
always stands in the same bytes are repeated whole; what is left, one copy of each different run, is shipped as bytes.

These suffixes are range-partitioned by their anchor's leading bytes, with splitters that Spark samples.  Each bucket
sorts its windows by multikey quicksort, eight bytes a step, and compares neighbours on all LENGTH bytes.  Equal windows
have equal leading bytes, so no pair of them is ever divided by a splitter.  An anchor that stands in more than `max_bucket`
different runs is not sorted in one bucket: its windows are dealt by their own hash and counted with partial sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded, byte_values, cut, free_name, mix64, partitions_for, spans, string_buffers, text_or_empty

LENGTH, KMER = 200, 40
#: Different runs of one anchor that one bucket sorts, at most.
MAX_BUCKET = 20_000
#: Bytes of runs that a bucket sorts in one step (an anchor's runs are never divided).
STEP_BYTES = 1 << 21


class Anchors:
    """Runs of windows by anchor, of texts in Arrow buffers."""

    def __init__(self, length: int, kmer: int):
        self.length, self.kmer, self.width = length, kmer, length - kmer + 1
        self.value, self.rolling = byte_values(3), Rolling()

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        """(row, anchor hash, anchor's place, first and last window start, body hash), places counted in the row."""
        n, w = len(data), self.width
        empty = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))
        if n < self.length:
            return empty
        prefix = self.rolling.prefix(self.value[data])
        m = n - self.kmer + 1
        h = mix64((prefix[self.kmer :] - prefix[:m]) * self.rolling.inverse[:m])
        bits = np.uint64(max(20, int(m).bit_length()))
        packed = (h >> bits << bits) | np.arange(m, dtype=np.uint64)
        rows = -(-m // w)
        block = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        block[:m] = packed
        block = block.reshape(rows, w).T  # accumulating along the first axis is the fast direction
        ahead = np.minimum.accumulate(block, 0).T.ravel()
        behind = np.minimum.accumulate(block[::-1], 0)[::-1].T.ravel()
        starts = n - self.length + 1
        least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # Windows that end in the row they start in.
        valid = np.zeros(starts + 1, np.int64)
        size = np.diff(offsets)
        long = size >= self.length
        np.add.at(valid, offsets[:-1][long], 1)
        np.add.at(valid, offsets[1:][long] - self.length + 1, -1)
        ok = np.cumsum(valid[:-1]) > 0
        border = np.zeros(starts, bool)
        border[offsets[:-1][long]] = True
        change = np.r_[True, place[1:] != place[:-1]] | border
        change[1:] |= ok[1:] & ~ok[:-1]
        first = np.flatnonzero(change & ok)
        if not len(first):
            return empty
        stop = np.flatnonzero(np.r_[(change | ~ok)[1:], True] & ok)
        row = np.searchsorted(offsets, first, side="right") - 1
        at, base = place[first], offsets[row]
        body = mix64(self.rolling.of(prefix, first, stop + self.length) + (stop - first).astype(np.uint64))
        return row, h[at], at - base, first - base, stop - base, body


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text, and a key of the row: id (0 for null) and the text's hash, which also tells a null id from 0."""
    text, doc = text_or_empty(text_column), F.col(id_column).cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(0)).alias("key"), F.xxhash64(text, doc.isNull()).alias("xx"), text.alias("text"))


def run_table(rows: DataFrame, length: int, kmer: int, place: bool) -> DataFrame:
    """anchor, body and, if place, key, xx and packed: window start << 16 | windows less one << 8 | anchor less start."""

    def run(batches):
        tool = Anchors(length, kmer)
        for batch in batches:
            raw, offsets, _ = string_buffers(batch.column("text"))
            for i, j in spans(offsets):
                row, anchor, at, first, last, body = tool.runs(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                columns = [pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64))]
                if place:
                    take = pa.array(row + i)
                    columns += [batch.column("key").take(take), batch.column("xx").take(take), pa.array(first << 16 | (last - first) << 8 | (at - first))]
                yield pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])

    source = rows.select("key", "xx", "text") if place else rows.select("text")
    NAMES = ["anchor", "body", "key", "xx", "packed"]
    return source.mapInArrow(bounded(run), "anchor long, body long" + (", key long, xx long, packed long" if place else ""))


def multikey_groups(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal another one: (their numbers, group of each), by multikey quicksort on eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    index, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, length, 8):
        at = starts[index] + min(depth, length - 8)
        key = np.zeros(len(index), np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | padded[at + k]
        order = np.lexsort((key, group))
        index, group, key = index[order], group[order], key[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])] if len(index) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        alone = np.bincount(number, minlength=1)[number] < 2
        index, group = index[~alone], number[~alone]
        if not len(index):
            break
    return index, group


def sort_buckets(segments: DataFrame, length: int) -> DataFrame:
    """anchor, body, spans of window offsets that are repeated; segments come range-partitioned and sorted by anchor."""

    def settle(rows):
        anchors, bodies, copies, blobs = zip(*rows)
        data = np.frombuffer(b"".join(blobs), np.uint8)
        sizes = np.array([len(b) for b in blobs])
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        index, _ = multikey_groups(data, (np.cumsum(sizes) - sizes)[owner] + offset, length)
        flag = np.zeros(len(owner), bool)
        flag[index] = True
        flag |= (np.array(copies) > 1)[owner]
        return owner, offset, flag, anchors, bodies

    def run(batches):
        waiting, size, last, seen = [], 0, None, set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "body", "copies", "blob"))):
                if row[0] != last:
                    if size > STEP_BYTES:
                        yield from flagged_spans(*settle(waiting))
                        waiting, size = [], 0
                    seen = set()
                if row[1] in seen:
                    continue
                seen.add(row[1])
                waiting.append(row)
                size, last = size + len(row[3]), row[0]
        if waiting:
            yield from flagged_spans(*settle(waiting))

    return segments.mapInArrow(bounded(run), "anchor long, body long, spans array<struct<a:int,b:int>>")


def flagged_spans(owner, offset, flag, anchors, bodies):
    edge = np.r_[True, (owner[1:] != owner[:-1]) | (flag[1:] != flag[:-1])]
    first = np.flatnonzero(edge)
    stop = np.r_[first[1:], len(owner)] - 1
    keep = flag[first]
    first, stop = first[keep], stop[keep]
    if not len(first):
        return
    rows, counts = np.unique(owner[first], return_counts=True)
    pairs = pa.StructArray.from_arrays([pa.array(offset[first].astype(np.int32)), pa.array(offset[stop].astype(np.int32))], ["a", "b"])
    bounds = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array([anchors[k] for k in rows], pa.int64()), pa.array([bodies[k] for k in rows], pa.int64()), pa.ListArray.from_arrays(bounds, pairs)], ["anchor", "body", "spans"]
    )


def window_rows(segments: DataFrame, length: int) -> DataFrame:
    """A row for each window of the segments: hash, anchor, body, offset, copies."""

    def run(batches):
        value, rolling = byte_values(5), Rolling()
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                blobs = part.column("blob").to_pylist()
                data = np.frombuffer(b"".join(blobs), np.uint8)
                sizes = np.array([len(b) for b in blobs])
                count = sizes - length + 1
                owner = np.repeat(np.arange(len(blobs)), count)
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = (np.cumsum(sizes) - sizes)[owner] + offset
                h = mix64(rolling.of(rolling.prefix(value[data]), start, start + length))
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column("anchor").take(take), part.column("body").take(take), pa.array(offset.astype(np.int32)), part.column("copies").take(take)],
                    ["hash", "anchor", "body", "offset", "copies"],
                )

    return segments.mapInArrow(bounded(run), "hash long, anchor long, body long, offset int, copies long")


def repeated_spans(rows: DataFrame, dealt: DataFrame, length: int = LENGTH, kmer: int = KMER, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """key, xx, spans: for each row with repeated windows, the starts (first, last) of their unbroken sequences.  dealt: rows, partitioned by key and xx."""
    parts = partitions_for(rows)
    anchors = run_table(rows, length, kmer, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("runs"), F.min("body").alias("lo"), F.max("body").alias("hi"))
    anchors = anchors.where("runs > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    first, width, lead = F.shiftright("packed", 16), F.shiftright("packed", 8).bitwiseAND(F.lit(255)), F.col("packed").bitwiseAND(F.lit(255))
    runs = cut(run_table(rows, length, kmer, True).join(anchors, "anchor").select("anchor", "body", "mixed", "key", "xx", "packed"))
    runs = runs.select("anchor", "body", "mixed", "key", "xx", first.alias("first"), width.alias("width"), lead.alias("lead"))
    whole = runs.where("not mixed").select("key", "xx", F.col("first").alias("a"), (F.col("first") + F.col("width")).alias("b"))

    # One copy of each different run whose anchor stands in several, with its bytes.
    mixed = runs.where("mixed")
    one = mixed.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "xx", "first", "width", "lead")).alias("at")).select("anchor", "body", "copies", "at.*")
    one = cut(one)
    one = one.join(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("bodies")), "anchor")
    wanted = one.groupBy("key", "xx").agg(F.collect_list(F.struct("anchor", "body", "copies", "first", "width", "lead", "bodies")).alias("runs"))

    def slices(batches):
        for batch in batches:
            raw, offsets, _ = string_buffers(batch.column("text"))
            flat = batch.column("runs").flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("runs").value_lengths()))
            get = lambda name: np.asarray(flat.field(name))
            start = offsets[owner] + get("first")
            blobs = [raw[a:b].tobytes() for a, b in zip(start.tolist(), (start + get("width") + length).tolist())]
            leads = [b[k : k + 16] for b, k in zip(blobs, get("lead").tolist())]
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("body"), flat.field("copies"), flat.field("bodies"), pa.array(leads, pa.binary()), pa.array(blobs, pa.binary())], ["anchor", "body", "copies", "bodies", "lead", "blob"])

    # Repeated rows give a segment once each; the copies are already counted.
    segments = dealt.join(wanted, ["key", "xx"]).mapInArrow(bounded(slices), "anchor long, body long, copies long, bodies long, lead binary, blob binary")
    buckets = segments.where(F.col("bodies") <= max_bucket).repartitionByRange(parts, "lead", "anchor").sortWithinPartitions("anchor")
    found = sort_buckets(buckets.select("anchor", "body", "copies", "blob"), length)
    windows = window_rows(segments.where(F.col("bodies") > max_bucket).select("anchor", "body", "copies", "blob").dropDuplicates(["anchor", "body"]), length)
    repeated = windows.groupBy("hash").agg(F.sum("copies").alias("n")).where("n > 1").select("hash")
    loose = windows.join(repeated, "hash").groupBy("anchor", "body").agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("a"), F.col("offset").alias("b")))).alias("spans"))
    some = mixed.join(found.unionByName(loose), ["anchor", "body"]).select("key", "xx", "first", F.explode("spans").alias("s"))
    some = some.select("key", "xx", (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b"))
    return whole.unionByName(some).groupBy("key", "xx").agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("spans"))


def covered(spans_of: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows with these first and last starts cover."""
    out: list[list[int]] = []
    for a, b in spans_of[np.lexsort((spans_of[:, 1], spans_of[:, 0]))].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, id_column: str, text_column: str, length: int, kmer: int, max_bucket: int) -> DataFrame:
    # The texts are dealt by their key once, for the runs' bytes and for the result.
    rows = keyed(docs, id_column, text_column)
    dealt = rows.repartition(partitions_for(rows), "key", "xx")
    return dealt.join(repeated_spans(rows, dealt, length, kmer, max_bucket), ["key", "xx"], "left")


def _pieces(batch, length):
    """Of each row: its bytes, and the removed ranges."""
    raw, offsets, _ = string_buffers(batch.column("text"))
    spans_of = batch.column("spans")
    flat = spans_of.flatten()
    pairs = np.stack([np.asarray(flat.field("a")), np.asarray(flat.field("b"))], 1) if len(flat) else np.empty((0, 2), np.int64)
    sizes = np.asarray(spans_of.value_lengths().fill_null(0))
    upto = 0
    for k, n in enumerate(sizes.tolist()):
        body = raw[offsets[k] : offsets[k + 1]].tobytes()
        yield body, covered(pairs[upto : upto + n], length) if n else []
        upto += n


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, kmer: int = KMER, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null counts as empty; texts of fewer than `length` bytes lose nothing.  Repeated rows repeat each other's text, so
    both lose all of it that is long enough.  Null ids are rows like others.  Empty tables give no rows; extra columns
    are ignored.
    """

    def run(batches):
        for batch in batches:
            size, removed, count, digest = [], [], [], []
            for body, gone in _pieces(batch, length):
                sha, upto = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(body[upto:a])
                    upto = b
                sha.update(body[upto:])
                size.append(len(body))
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
                digest.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (size, removed, count)), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = _with_spans(docs, id_column, text_column, length, kmer, max_bucket)
    return rows.mapInArrow(bounded(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, kmer: int = KMER, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """docs with what is left in text; a character of which a byte was removed goes as a whole.  All columns stay, whatever
    they are called, and a null text stays null.  Cases as in report()."""

    def run(batches):
        for batch in batches:
            texts = []
            for body, gone in _pieces(batch, length):
                kept, upto = [], 0
                for a, b in gone:
                    kept.append(body[upto:a].decode("utf-8", "ignore"))
                    upto = b
                texts.append("".join([*kept, body[upto:].decode("utf-8", "ignore")]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("xx"), pa.array(texts, pa.string())], ["key", "xx", "left"])

    rows = _with_spans(docs, id_column, text_column, length, kmer, max_bucket)
    key, xx, left = (free_name(docs, c) for c in ("key", "xx", "left"))
    cut_rows = rows.where(F.size("spans") > 0).mapInArrow(bounded(run), "key long, xx long, left string").dropDuplicates(["key", "xx"]).toDF(key, xx, left)
    doc = F.col(f"`{id_column}`").cast("long")
    on = (F.coalesce(doc, F.lit(0)) == F.col(key)) & (F.xxhash64(text_or_empty(f"`{text_column}`"), doc.isNull()) == F.col(xx))
    return docs.join(cut_rows, on, "left").select(*[F.coalesce(left, F.col(f"`{c}`")).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
