"""Fill-in-middle transformation by run-length classes of characters.

A text's units are maximal runs of ASCII letters and single other code points.  Its maximal runs of one character class
are stored with their cumulative unit counts; a cut after u units lies in the run that a binary search finds, at an offset
that follows from the counts: a run of letters is one unit, in any other run each code point is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are transformed, and how many of those have their suffix first.
RATE, SPM_RATE = 90, 20


class Runs:
    """The class runs of a text: first code point, class and cumulative units of each."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lower = points | np.uint32(32)
        letter = (lower >= 97) & (lower <= 122)
        self.start = np.flatnonzero(np.r_[True, letter[1:] != letter[:-1]]) if len(points) else np.empty(0, np.int64)
        self.letter = letter[self.start]
        units = np.where(self.letter, 1, np.diff(np.r_[self.start, len(points)]))
        self.before = np.r_[0, np.cumsum(units)]
        self.units, self.length = int(self.before[-1]), len(points)

    def offset(self, units: int) -> int:
        """The code points of the first units."""
        if units >= self.units:
            return self.length
        k = int(np.searchsorted(self.before, units, side="right")) - 1
        return int(self.start[k]) + (0 if self.letter[k] else units - int(self.before[k]))


def draws(id_column: str, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of `seed:id`, as numbers; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output.

    form is plain where the text is empty, has a mark of its own or is drawn to stay; spm (suffix, prefix, middle) or psm
    (prefix, suffix, middle) otherwise.  The draws depend on the id alone, so repeated rows come out alike.  A null text
    counts as empty; columns of docs with one of the new names are replaced; an empty table gives no rows.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    names = [c for c in docs.columns if c.lower() not in made]
    body, drawn = free_name(docs, "body"), free_name(docs, "drawn")
    rows = docs.select(*(F.col(f"`{c}`") for c in names), text_or_empty(f"`{text_column}`").alias(body), F.array(*draws(f"`{id_column}`", seed)).alias(drawn))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c in names] + ["n long, form string, prefix_chars long, middle_chars long, output string"])

    def one(text: str, h: list[int]):
        runs = Runs(text)
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= RATE:
            return runs.units, "plain", None, None, text
        first, second = sorted(runs.offset(x % (runs.units + 1)) for x in h[:2])
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        if h[3] % 100 < SPM_RATE:
            return runs.units, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return runs.units, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for batch in batches:
            done = [one(text, h) for text, h in zip(batch.column(body).to_pylist(), batch.column(drawn).to_pylist())]
            new = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new[:4], new[4].cast(pa.string())], [*names, *made])

    return rows.mapInArrow(bounded(run), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  A transformed output has each mark once, as texts with marks stay plain."""
    middle, head = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    before = lambda mark: F.substr(F.substring_index(head, mark, 1), F.lit(4))  # noqa: E731  # without the mark of three characters
    after = lambda mark: F.substring_index(head, mark, -1)
    psm, spm = F.concat(before(SUFFIX), middle, after(SUFFIX)), F.concat(after(PREFIX), middle, before(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """The transformed documents by digests of their output and of the text restored from it."""
    rows = transform(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
