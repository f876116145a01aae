"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned by the token windows of all documents.

The benchmark's windows are hashed into a set that is broadcast if it has at most `max_windows` entries.  A larger
benchmark is cut into blocks of that size; every block is broadcast in turn and scans all documents, and the hits of a
document are merged afterwards.  Blocks count real windows, longer items are split, and a block's broadcast is freed when
it has scanned.  A hash hit counts only after its words have been compared with the test window's.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded, byte_values, cut, fold_case_table, free_name, grams, mix64, spans, string_buffers, words_of

WINDOW = 10
#: Windows in one broadcast block: 2**18 of them take some 60 MB on an executor.
MAX_WINDOWS = 1 << 18


def word_bytes() -> np.ndarray:
    """The bytes that make up words once A-Z is folded: 0-9, a-z and all of non-ASCII characters."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


class Scanner:
    """Words and hashed windows of texts in Arrow buffers."""

    def __init__(self):
        self.fold, self.inside, self.value, self.rolling = fold_case_table(), word_bytes(), byte_values(), Rolling()

    def words(self, data: np.ndarray, offsets: np.ndarray):
        data = self.fold[data]
        start, end, first = words_of(data, offsets, self.inside)
        prefix = self.rolling.prefix(self.value[data])
        return data, start, end, first, mix64(self.rolling.of(prefix, start, end) + (end - start).astype(np.uint64))


def windows_of(items: list[tuple[str | None, str | None]], window: int) -> dict[int, tuple[dict[int, list], dict[bytes, set]]]:
    """Length -> (hash -> window texts, window text -> item ids).  An item with fewer words, but not none, is one window."""
    scan, out = Scanner(), {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        data, start, end, _, hashed = scan.words(raw, np.array([0, len(raw)]))
        n = min(window, len(start))
        if not n:
            continue
        by_hash, ids = out.setdefault(n, ({}, {}))
        words = [data[a:b].tobytes() for a, b in zip(start, end)]
        for k, g in enumerate(grams(hashed, n).tolist()):
            body = b" ".join(words[k : k + n])
            by_hash.setdefault(g, [])
            if body not in by_hash[g]:
                by_hash[g].append(body)
            ids.setdefault(body, set()).add(item)
    return out


def scan_batches(batches, blocks, emit):
    """Feeds emit with the batch and, for each row, the number of words, hit intervals of words, item ids and cut byte spans."""
    scan, sets = Scanner(), blocks.value
    ready = []
    for n, (by_hash, ids) in sets.items():
        keys = np.array(sorted(by_hash), np.uint64)
        maybe = np.zeros(1 << 20, bool)
        maybe[keys >> np.uint64(44)] = True
        ready.append((n, keys, maybe, by_hash, ids))
    for batch in batches:
        raw, offsets, _ = string_buffers(batch.column("text"))
        counts, hits = np.zeros(batch.num_rows, np.int64), {}
        for i, j in spans(offsets):
            base = offsets[i]
            data, start, end, first, hashed = scan.words(raw[base : offsets[j]], offsets[i : j + 1] - base)
            counts[i:j] = np.diff(first)
            for n, keys, maybe, by_hash, ids in ready:
                g = grams(hashed, n)
                at = np.flatnonzero(maybe[g >> np.uint64(44)])
                if not len(at):
                    continue
                place = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
                at = at[keys[place] == g[at]]
                row = np.searchsorted(first, at, side="right") - 1
                inside = at + n <= first[row + 1]
                for k, r in zip(at[inside].tolist(), row[inside].tolist()):
                    body = b" ".join(data[start[x] : end[x]].tobytes() for x in range(k, k + n))
                    if body in by_hash[int(g[k])]:
                        spans_of, items = hits.setdefault(i + r, ([], set()))
                        f = int(first[r])
                        spans_of.append((k - f, k - f + n, int(base + start[k] - offsets[i + r]), int(base + end[k + n - 1] - offsets[i + r])))
                        items |= ids[body]
        yield from emit(batch, counts, hits, raw, offsets)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def sha(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, window: int, max_windows: int):
    """(item, text) of the benchmark in lists of at most max_windows windows, of which one is held at a time.  Items are
    streamed to the driver, and an item of more windows is cut into texts that overlap by window - 1 words."""
    scan, block, room = Scanner(), [], max_windows
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        data, start, end, _, _ = scan.words(raw, np.array([0, len(raw)]))
        words, n = [data[a:b].tobytes() for a, b in zip(start, end)], min(window, len(start))
        k, count = 0, len(words) - n + 1 if words else 0
        while k < count:
            if not room:
                yield block
                block, room = [], max_windows
            some = min(room, count - k)
            block.append((item, b" ".join(words[k : k + some + n - 1]).decode("utf-8", "surrogatepass")))
            k, room = k + some, room - some
    yield block


def _first(blocks):
    """The first of blocks, and an iterator of all of them if there are several."""
    one, two = next(blocks), next(blocks, None)
    return one, None if two is None else chain([one, two], blocks)


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits.  Repeated rows give repeated results.  An item with a null id still
    marks words as hit but is no entry of the list of items; null and empty items have no windows; of repeated items each
    id counts once.  With an empty benchmark nothing is contaminated, and empty documents give no rows.  Extra columns
    are ignored.  Several items with one window all count.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one, blocks = _first(_blocks(benchmark, window, max_windows))
    if blocks is None:
        block = docs.sparkSession.sparkContext.broadcast(windows_of(one, window))

        def whole(batches):
            def emit(batch, counts, hits, raw, offsets):
                n_hit, n_items = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                digest = [EMPTY] * len(counts)
                for r, (at, items) in hits.items():
                    items = {x for x in items if x is not None}
                    n_hit[r] = sum(b - a for a, b in merged([x[:2] for x in at]))
                    n_items[r], digest[r] = len(items), sha(items)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_hit > 0)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

            EMPTY = sha(())
            return scan_batches(batches, block, emit)

        return source.mapInArrow(bounded(whole), REPORT)

    # Many blocks: rows get numbers in a table of their own, each block reports only rows that it hits.
    rows = cut(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    union = _hits(rows, blocks, window, 0)
    grouped = union.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")),
        lambda s: s["n"].cast("long"),
    )
    return grouped.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("at") > 0).alias("contaminated"),
    )


PARTIAL = "row long, doc_id long, n_words long, at array<struct<a:int,b:int>>, items array<string>"


def _hits(rows: DataFrame, blocks, window: int, of: int) -> DataFrame:
    """The hits of every block in rows (row, doc_id, text): intervals of words (of 0) or of bytes (of 2)."""
    out = None
    for k, items in enumerate(blocks):
        block = rows.sparkSession.sparkContext.broadcast(windows_of(items, window))
        part = cut(rows.mapInArrow(bounded(_partial(block, not k and not of, of)), PARTIAL))
        block.unpersist(blocking=True)
        out = part if out is None else out.unionByName(part)
    return out


def _partial(block, first: bool, of: int):
    def run(batches):
        def emit(batch, counts, hits, raw, offsets):
            take = list(range(len(counts))) if first else sorted(hits)
            at = [[{"a": a, "b": b} for a, b in merged([x[of : of + 2] for x in hits[r][0]])] if r in hits else [] for r in take]
            items = [[x for x in hits[r][1] if x is not None] if r in hits else [] for r in take]
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array(counts[take] if take else [], pa.int64()), pa.array(at, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "at", "items"],
            )

        return scan_batches(batches, block, emit)

    return run


def without(text: bytes, spans_of: list[tuple[int, int]]) -> str:
    kept, upto = [], 0
    for a, b in merged(spans_of):
        kept.append(text[upto:a])
        upto = b
    return b"".join([*kept, text[upto:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without benchmark passages, in the columns of docs: action "drop" removes contaminated documents, "spans"
    cuts the hit words (with what stands between them) out of the text; hits are those in the text as it came.  Cases are
    those of report(); rows are treated one by one, so ids may be null or repeated, and texts without a hit stay as they
    are, null included.  Other columns may have any names."""
    if action not in ("drop", "spans"):
        raise ValueError(f"unknown action {action}")
    names, schema = docs.columns, docs.schema
    one, blocks = _first(_blocks(benchmark, window, max_windows))
    if blocks is None:
        block = docs.sparkSession.sparkContext.broadcast(windows_of(one, window))

        def clean(batches):
            def emit(batch, counts, hits, raw, offsets):
                if action == "drop":
                    keep = np.ones(batch.num_rows, bool)
                    keep[list(hits)] = False
                    yield batch.filter(pa.array(keep))
                    return
                texts = batch.column("text").to_pylist()
                for r, (at, _) in hits.items():
                    texts[r] = without(raw[offsets[r] : offsets[r + 1]].tobytes(), [x[2:] for x in at])
                columns = [pa.array(texts, batch.column(k).type) if c == "text" else batch.column(k) for k, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

            return scan_batches(batches, block, emit)

        return docs.mapInArrow(bounded(clean), schema)

    row, at = free_name(docs, "row"), free_name(docs, "at")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _hits(texts, blocks, window, 2).groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("at")).alias(at))
    if action == "drop":
        return rows.join(found.select(row), row, "left_anti").select(*names)

    def cut_out(batches):
        for batch in batches:
            body = [t if not x else without(t.encode("utf-8", "surrogatepass"), [(y["a"], y["b"]) for y in x]) for t, x in zip(batch.column("text").to_pylist(), batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(body, batch.column(c).type) if c == "text" else batch.column(c) for c in names], names)

    return rows.join(found, row, "left").select(*names, at).mapInArrow(bounded(cut_out), schema)
