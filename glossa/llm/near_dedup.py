"""MinHash near-duplicates by a signature-coordinate inverted join.

A text's set is its distinct shingles of five words.  Texts with one set are one class.  Each class posts its least
document id under every coordinate-value pair of its signature.  Two classes whose signatures agree in at least
`matches` coordinates are candidates, found as in a merge with count threshold:

- a pair that one class alone posts is skipped, and so is a class with fewer than `matches` shared pairs;
- of the rest each class keeps a prefix, its rarest shared pairs but for `matches - 1`; candidates share a prefix pair;
- lists are not expanded into all pairs.  First each class is compared with one head of a list, the one that most of
  its lists name.  Then, in lists that still hold several components, every class is measured against the centre of the
  main one, and finer lists are made of the shingles that the centre lacks (`finer_lists`): two classes that are not
  linked through the centre can be linked only if they meet there.  In finer lists each class is compared with a few
  neighbours of an order of the list, and only classes that are outside of their main component after that are compared
  with the others, if enough coordinates agree.

So every candidate pair is inside one component already, or compared, or out of reach, and groups of near copies take a
few comparisons a member.  All links are decided on full sets.

With 64 coordinates and 34 matches, a pair at a similarity of exactly 0.75 is missed with a chance of 4.4e-5, and at 0.8 of
3.2e-7.  A pair of that many agreements shares at least one prefix pair, and the last step takes every such pair up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Rolling, bounded, byte_values, cut, fold_case_table, free_name, grams, mix64, shuffled, spans, string_buffers, text_or_empty, words_of
from .components import merge_labels

SHINGLE, COORDINATES, MATCHES = 5, 64, 34
#: Similarity of linked texts, in hundredths.
PERCENT = 75
#: Passes that drop classes without enough shared pairs.
PRUNES = 1
#: Places in the order of a finer list over which members are compared before all that are still apart are.
BESIDE = 2


def space_bytes() -> np.ndarray:
    t = np.ones(256, bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


class Shingler:
    """Shingle sets and signatures of texts in Arrow buffers."""

    def __init__(self, shingle: int, coordinates: int):
        self.shingle, self.inside, self.fold = shingle, space_bytes(), fold_case_table()
        self.value, self.rolling = byte_values(7), Rolling()
        seeds = mix64(np.arange(2 * coordinates, dtype=np.uint64) + np.uint64(99))
        self.factor = (seeds[:coordinates] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.shift = (seeds[coordinates:] >> np.uint64(32)).astype(np.uint32)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of all rows, and the number of each row."""
        data = self.fold[data]
        start, end, first = words_of(data, offsets, self.inside)
        hashed = mix64(self.rolling.of(self.rolling.prefix(self.value[data]), start, end) + (end - start).astype(np.uint64))
        count, n = np.diff(first), self.shingle
        g = grams(hashed, n)
        row = np.repeat(np.arange(len(count)), np.maximum(0, count - n + 1))
        at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(0, count - n + 1)) - np.maximum(0, count - n + 1), np.maximum(0, count - n + 1)) + first[row]
        rows, codes = [row], [g[at]]
        for k in range(1, n):  # fewer words: the whole sequence
            few = np.flatnonzero(count == k)
            if len(few):
                rows.append(few)
                codes.append(mix64(grams(hashed, k)[first[few]] + np.uint64(k)))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])] if len(row) else np.empty(0, bool)
        return code[new], np.bincount(row[new], minlength=len(count))

    def signatures(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """uint32 [rows with a set, coordinates]."""
        low = (code >> np.uint64(32)).astype(np.uint32)
        start = (np.cumsum(sizes) - sizes)[sizes > 0]
        out = np.empty((len(start), len(self.factor)), np.uint32)
        for k, (a, b) in enumerate(zip(self.factor, self.shift)):
            out[:, k] = np.minimum.reduceat(low * a + b, start)
        return out


def sketch(rows: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (hashes of the set), sig (null without a set)."""

    def run(batches):
        tool = Shingler(shingle, coordinates)
        for batch in batches:
            raw, offsets, _ = string_buffers(batch.column("text"))
            for i, j in spans(offsets):
                code, sizes = tool.sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row = np.repeat(np.arange(len(sizes)), sizes)
                h = np.zeros((2, len(sizes)), np.uint64)
                np.add.at(h[0], row, mix64(code + np.uint64(17)))
                np.add.at(h[1], row, mix64(code ^ np.uint64(0x5555555555555555)))
                h = mix64(h)
                sig, full = [None] * len(sizes), np.flatnonzero(sizes > 0)
                if len(full):
                    for r, s in zip(full.tolist(), tool.signatures(code, sizes)):
                        sig[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "h1", "h2", "sig"],
                )

    return rows.mapInArrow(bounded(run), "doc_id long, n long, h1 long, h2 long, sig binary")


def post(classes: DataFrame, coordinates: int) -> DataFrame:
    """token, id: each coordinate-value pair of each class."""

    def run(batches):
        salt = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, coordinates)
            token = mix64(sig.astype(np.uint64) | salt).ravel()
            ids = np.repeat(np.asarray(batch.column("id")), coordinates)
            for k in range(0, len(token), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(token[k : k + (1 << 18)].view(np.int64)), pa.array(ids[k : k + (1 << 18)])], ["token", "id"])

    return classes.select("id", "sig").mapInArrow(bounded(run), "token long, id long")


def prefixes(postings: DataFrame, matches: int) -> DataFrame:
    """token, id: of each class with at least `matches` shared pairs, the rarest but for matches - 1.

    A class with fewer shared pairs has no partner, and no longer counts as one for others: this is done over until
    little changes, or PRUNES times.
    """
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1").select("token")
    left = cut(postings.join(shuffled(shared), "token"))
    for _ in range(PRUNES):
        alive = left.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= matches).select("id")
        left = left.join(shuffled(alive), "id")
        left = cut(left.join(shuffled(left.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")), "token").select("token", "id"))
    both = left.join(shuffled(left.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))), "token")
    by_id = Window.partitionBy("id")
    ranked = both.withColumn("m", F.count(F.lit(1)).over(by_id)).where(F.col("m") >= matches)
    ranked = ranked.withColumn("r", F.row_number().over(by_id.orderBy("freq", "token"))).where(F.col("r") <= F.col("m") - (matches - 1))
    return ranked.select("token", "id")


def full_sets(rows: DataFrame, ids: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """id, sig, codes (sorted shingle hashes): of the documents with these ids; one row for each of an id's sets."""

    def run(batches):
        tool = Shingler(shingle, coordinates)
        for batch in batches:
            raw, offsets, _ = string_buffers(batch.column("text"))
            for i, j in spans(offsets):
                code, sizes = tool.sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full, upto = np.flatnonzero(sizes > 0), np.cumsum(sizes)
                sig = tool.signatures(code, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).take(pa.array(full)), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([code[upto[r] - sizes[r] : upto[r]].tobytes() for r in full.tolist()], pa.binary())],
                    ["id", "sig", "codes"],
                )

    wanted = rows.join(shuffled(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return wanted.select("doc_id", "text").mapInArrow(bounded(run), "id long, sig binary, codes binary").distinct()


def _sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs with the column of both sides, as <column>_a and <column>_b."""
    for c in ("a", "b"):
        pairs = pairs.join(shuffled(sets.select(F.col("id").alias(c), F.col(column).alias(f"{column}_{c}"))), c)
    return pairs


def agreement(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, agree: the number of coordinates in which the signatures agree."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).sum(1).astype(np.int32))], ["a", "b", "agree"])

    return _sides(pairs, sets, "sig").mapInArrow(bounded(run), "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both, either: sizes of the intersection and the union of the full sets (of the nearest ones, if an id has
    several)."""

    def run(batches):
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column("codes_a"), batch.column("codes_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
                either.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    rows = _sides(pairs, sets, "codes").mapInArrow(bounded(run), "a long, b long, both long, either long")
    best = F.max(F.struct((F.col("both") / F.col("either")).alias("j"), "both", "either"))
    return rows.groupBy("a", "b").agg(best.alias("m")).select("a", "b", "m.both", "m.either")


def links_of(scored: DataFrame, percent: int) -> DataFrame:
    return scored.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


def star(lists: DataFrame, labels: DataFrame, link) -> DataFrame:
    """labels after each class of lists (token, id) has been compared with one head, the one that most of its lists name."""
    heads = lists.groupBy("token").agg(F.min("id").alias("head"))
    votes = lists.join(shuffled(heads), "token").where("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("head")).alias("minus"))).alias("top"))
    return merge_labels(labels, link(best.select(F.col("id").alias("a"), (-F.col("top.minus")).alias("b"))))


def neighbours(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: members of different components that are among the next BESIDE of each other in an order of their list.

    The order is another one in each list, so a class meets others in each of its lists, and there are at most BESIDE
    pairs a row.  They only settle in advance what the comparison of all would: neighbours that are parted by the end of
    a partition or batch are left to that.
    """

    def run(batches):
        for batch in batches:
            token, ids, comp = (np.asarray(batch.column(c)) for c in ("token", "id", "comp"))
            for k in range(1, BESIDE + 1):
                at = np.flatnonzero((token[k:] == token[:-k]) & (comp[k:] != comp[:-k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[at], ids[at + k])), pa.array(np.maximum(ids[at], ids[at + k]))], ["a", "b"])

    member = lists.join(shuffled(labels), "id").select("token", "id", "comp", F.xxhash64("token", "id").alias("place"))
    dealt = member.repartitionByRange("token", "place").sortWithinPartitions("token", "place")
    return dealt.select("token", "id", "comp").mapInArrow(bounded(run), "a long, b long").distinct()


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """token, id, comp, main: lists that hold several components, and the component with most members there."""
    member = lists.join(shuffled(labels), "id").select("token", "id", "comp")
    sizes = member.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("token").agg(F.max(F.struct("n", (-F.col("comp")).alias("minus"))).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return member.join(shuffled(several.select("token", (-F.col("m.minus")).alias("main"))), "token")


def against_centres(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """centre, id, n, n_centre, s, rest: classes of open lists against the centre (least id) of the main component.

    n and n_centre are the sizes of the two sets, s of their intersection, and rest is what of the class's set the centre
    lacks.  A centre with several sets stands for its least one; all its sets are members as well.
    """

    def run(batches):
        for batch in batches:
            own, most, both, rest = [], [], [], []
            for x, y in zip(batch.column("codes"), batch.column("codes_centre")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                own.append(len(x))
                most.append(len(y))
                both.append(int(hit.sum()))
                rest.append(x[~hit].tobytes())
            columns = [pa.array(own, pa.int64()), pa.array(most, pa.int64()), pa.array(both, pa.int64()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("id"), *columns], ["centre", "id", "n", "n_centre", "s", "rest"])

    pairs = open_.select(F.col("main").alias("centre"), "id").unionByName(open_.select(F.col("main").alias("centre"), F.col("main").alias("id"))).distinct()
    centres = sets.groupBy(F.col("id").alias("centre")).agg(F.min("codes").alias("codes_centre"))
    return pairs.join(shuffled(sets.select("id", "codes")), "id").join(shuffled(centres), "centre").mapInArrow(bounded(run), "centre long, id long, n long, n_centre long, s long, rest binary")


def shingles_of(rows: DataFrame) -> DataFrame:
    """The columns of rows but rest, and each shingle of rest as code."""
    names = [c for c in rows.columns if c != "rest"]

    def run(batches):
        for batch in batches:
            codes = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("rest")]
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in codes]))
            flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in names), pa.array(flat)], [*names, "code"])

    return rows.mapInArrow(bounded(run), ", ".join([f"{c} {t}" for c, t in rows.dtypes if c != "rest"] + ["code long"]))


def finer_lists(measured: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """token, id: lists in which all links between different components of one centre's classes are found.

    Two classes with s and t shingles of the centre share at most min(s, t) of these, so the rest of what a link takes
    must come from shingles that the centre lacks.  With m the size of the smallest class that may be linked, a class of n
    shingles needs `need` = percent (n + m) / (100 + percent) - s of them.  It is posted under its rarest such shingles but
    for need - 1, which is as in the signatures' lists.  Where need is 0 or less, a link may also take shingles of
    the centre alone.  Of two such classes in different components one is not linked with the centre, and so the other is
    smaller than the centre: these meet under sizes.
    """
    rows = measured.join(shuffled(labels), "id").withColumn("row", F.xxhash64("centre", "id", "rest"))
    group = rows.groupBy("centre").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = rows.join(shuffled(group.select("centre", "least")), "centre")
    rows = rows.withColumn("m", F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)))
    rows = cut(rows.withColumn("need", F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent)) - F.col("s")).where(F.col("need") * 8 <= F.octet_length("rest")))

    posted = shingles_of(rows.select("centre", "id", "comp", "row", "need", "rest"))
    shared = posted.groupBy("centre", "code").agg(F.count(F.lit(1)).alias("freq"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("centre", "code", "freq")
    own = Window.partitionBy("centre", "id", "row")
    ranked = posted.join(shuffled(shared), ["centre", "code"]).withColumn("have", F.count(F.lit(1)).over(own)).withColumn("r", F.row_number().over(own.orderBy("freq", "code")))
    by_shingle = ranked.where(F.col("r") <= F.col("have") - F.greatest(F.col("need"), F.lit(1)) + 1).select(F.xxhash64("centre", "code").alias("token"), "id")

    small = rows.where("need <= 0 and n < n_centre")
    sizes = small.select("centre", F.col("n").alias("size")).distinct()
    apart = rows.where("need <= 0").where(F.col("comp") != F.col("centre"))
    fits = F.col("size").between(F.col("m"), F.floor(F.col("s") * (100 + percent) / percent) - F.col("n"))
    by_size = apart.join(shuffled(sizes), "centre").where(fits).select("centre", "size", "id")
    met = by_size.select("centre", "size").distinct()
    by_size = by_size.unionByName(small.withColumnRenamed("n", "size").join(shuffled(met), ["centre", "size"]).select("centre", "size", "id"))
    return by_shingle.unionByName(by_size.select(F.xxhash64(F.lit("size"), "centre", "size").alias("token"), "id")).distinct()


def components_of(rows: DataFrame, classes: DataFrame, shingle: int, coordinates: int, matches: int, percent: int) -> DataFrame:
    """id, comp of the classes that may have links."""
    prefix = cut(prefixes(post(classes, coordinates), matches))
    ids = prefix.select("id").distinct()
    sets = cut(full_sets(rows, ids, shingle, coordinates))
    labels = star(prefix, cut(ids.select("id", F.col("id").alias("comp"))), lambda pairs: links_of(similarity(pairs, sets), percent))
    return the_rest(prefix, labels, sets, matches, percent)


def the_rest(prefix: DataFrame, labels: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """labels after all candidates that are still in different components have been compared, or ruled out."""
    link = lambda pairs: links_of(similarity(pairs, sets), percent)
    measured = cut(against_centres(open_lists(prefix, labels), sets))
    if measured.isEmpty():
        return labels
    of_centre = measured.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"), F.col("s").alias("both"), (F.col("n") + F.col("n_centre") - F.col("s")).alias("either"))
    labels = merge_labels(labels, links_of(of_centre, percent))

    lists = cut(finer_lists(measured, labels, percent))
    if lists.isEmpty():
        return labels
    labels = merge_labels(labels, link(neighbours(lists, labels)))
    member = open_lists(lists, labels)
    pairs = member.where("comp <> main").join(shuffled(member.select("token", F.col("id").alias("other"), F.col("comp").alias("comp_other"))), "token").where("comp <> comp_other")
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    likely = agreement(pairs, sets).where(F.col("agree") >= matches).select("a", "b")
    return merge_labels(labels, link(likely))


def groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, coordinates: int = COORDINATES, matches: int = MATCHES, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null, empty and wordless texts have no shingles and stand alone.  Ids are the vertices: repeated rows get equal
    results, and rows with one id but different texts are one vertex with several sets.  A row with a null id is linked
    with nothing, its component_id is null and it is kept.  Empty tables give no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    table = cut(sketch(rows, shingle, coordinates))
    real = table.where("n > 0 and doc_id is not null")
    classes = real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"))
    least = real.join(shuffled(classes.withColumnRenamed("id", "doc_id")), ["doc_id", "h1", "h2", "n"], "left_semi")
    reps = least.select(F.col("doc_id").alias("id"), "sig").distinct()
    labels = components_of(rows, reps, shingle, coordinates, matches, percent)
    of_class = classes.join(shuffled(labels), "id", "left").select("h1", "h2", "n", F.coalesce("comp", "id").alias("comp"))
    # Rows with one id and several texts are in several classes: their components meet in the id.
    ids = real.join(shuffled(of_class), ["h1", "h2", "n"]).select("doc_id", "comp")
    again = ids.groupBy("doc_id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    of_class = _join_split_ids(of_class, ids, again)
    out = table.join(shuffled(of_class), ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _join_split_ids(of_class: DataFrame, ids: DataFrame, again: DataFrame) -> DataFrame:
    again = cut(again)
    if again.isEmpty():
        return of_class
    links = ids.join(shuffled(again.select("doc_id", "lo")), "doc_id").where("comp <> lo").select(F.col("lo").alias("a"), F.col("comp").alias("b")).distinct()
    comps = of_class.select(F.col("comp").alias("id"), "comp").distinct()
    final = merge_labels(cut(comps), links).withColumnRenamed("comp", "final")
    return of_class.join(shuffled(final.withColumnRenamed("id", "comp")), "comp").select("h1", "h2", "n", F.col("final").alias("comp"))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows of docs that groups() keeps, in the columns of docs, whatever these are called.

    Rows without shingles (null, empty and wordless texts) and rows with a null id all stay.  Of repeated rows with one
    id, all stay or none: they are one vertex.  An empty table gives an empty one.
    """
    kept, name = groups(docs, id_column, text_column, **parameters).where("kept and doc_id is not null"), free_name(docs, "kept_id")
    of_kept = docs.join(shuffled(kept.select(F.col("doc_id").alias(name)).distinct()), F.col(id_column).cast("long") == F.col(name), "left_semi")
    return of_kept.unionByName(docs.where(F.col(id_column).isNull()))
