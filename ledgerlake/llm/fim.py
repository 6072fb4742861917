"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and rebuilt from what training sees.

Cuts fall between code points, texts are UTF-8. A text is stored as its maximal runs of characters of one
class, the class being the bytes a character takes, with how many units (code points) and bytes stand before
each run. A binary search over the cumulative units finds the run that holds a cut; inside a run every unit
takes the same bytes, so the byte offset follows by arithmetic and no text is decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.shared import freed

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents, how many are cut at all, and of 100 cut ones, how many have their suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"


@dataclass(frozen=True)
class Runs:
    """Maximal runs of one class: bytes a unit takes, and units and bytes before each run; the last entries of both are the totals."""

    widths: np.ndarray
    units: np.ndarray
    starts: np.ndarray

    @property
    def total(self) -> int:
        return int(self.units[-1])

    def offset(self, unit: int) -> int:
        """The byte at which unit number ``unit`` starts; the length of the text for the number of its units."""
        run = int(np.searchsorted(self.units, unit, side="right")) - 1
        return int(self.starts[run] + (unit - self.units[run]) * self.widths[run]) if run < len(self.widths) else int(self.starts[-1])


def encoded(text: bytes) -> Runs:
    """The runs of a UTF-8 text; none for an empty one."""
    if text.isascii():
        counts = np.array([len(text)] if text else [], dtype=np.int64)
        widths = np.ones(len(counts), dtype=np.int64)
    else:
        units = np.frombuffer(text, dtype=np.uint8)
        first = units[(units & 0xC0) != 0x80]  # a character's first byte tells its length
        kinds = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
        borders = np.flatnonzero(np.diff(kinds, prepend=0))
        counts, widths = np.diff(borders, append=len(kinds)), kinds[borders]
    before = lambda x: np.concatenate(([0], np.cumsum(x)))
    return Runs(widths, before(counts), before(counts * widths))


def _proper(sentinels: tuple[str, str, str]) -> None:
    """Refuses marks that could be found where two others or a mark and a text meet."""
    for a in sentinels:
        for b in sentinels:
            if not a or a != b and a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks may not overlap: {a!r}, {b!r}")


def draws(key: Column, seed: str = "1") -> Column:
    """Four numbers below 2^32 that depend on the key and the seed only: the first digits of a SHA-256. A null key draws as an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, cut_share: int = CUT_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one per row of ``docs``.

    n is a text's code points. The first two draws of a document's id, each modulo n + 1, are its cuts; the
    third decides whether it is cut, the fourth whether the suffix comes first. A text that is empty or null,
    or that holds a mark, stays plain, with null lengths. Rows with one id are cut at the same draws, those
    without an id at the draws of an empty one. Long texts are cut whole, other columns are ignored, and no
    rows give none. Nothing is shuffled.
    """
    _proper(sentinels)
    p, s, m = (x.encode() for x in sentinels)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), draws(F.col(id_col), seed).alias("draws"))

    def one(text: bytes, drawn: list[int]) -> tuple:
        runs = encoded(text)
        n = runs.total
        if not n or drawn[2] % 100 >= cut_share or p in text or s in text or m in text:
            return n, PLAIN, None, None, text
        first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
        i, j = runs.offset(first), runs.offset(second)
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if drawn[3] % 100 < suffix_first_share:
            return n, SUFFIX_FIRST, first, second - first, b"".join((s, suffix, p, prefix, m, middle))
        return n, PREFIX_FIRST, first, second - first, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            made = [one(t.as_py(), d.as_py()) for t, d in zip(texts, batch.column(2))]
            n, form, prefix, middle, output = zip(*made) if made else [()] * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(freed(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)  # noqa: E731  each mark stands in a cut output once
    middle = F.substring_index(output, m, -1)
    cut = F.when(form == PREFIX_FIRST, F.concat(between(p, s), middle, between(s, m)))
    return cut.when(form == SUFFIX_FIRST, F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def digests(cut: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with the SHA-256 of the output and of the text restored from it in their place."""
    found = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return cut.withColumns(found).drop("output")
