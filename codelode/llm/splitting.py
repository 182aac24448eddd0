"""Splitting oversized items at natural boundaries.

A recursive separator hierarchy (section, paragraph, line, sentence, word, character) cuts a text into atoms that fit;
atoms are packed greedily into pieces of at most ``limit`` characters (Unicode code points). Every piece after the first
repeats up to ``overlap`` characters from the end of the piece before it, from the strongest natural boundary that fits;
fewer where the next paragraph, sentence or the like would otherwise be cut though it fits.

Defined results
* null text: no row; a text within the limit, the empty one too, is one piece;
* a piece's ``start`` is where its new text begins and ``overlap`` how many characters before that it repeats, so the
  new parts of all pieces joined in order are the text again;
* module lines: a null start is line 1, a null or overlong end the last line, start above end an empty text;
* rows delivered twice count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3000, 300

#: From strong to weak. Each pattern matches at the end of an atom, which keeps its separator.
SECTION = re.compile(r"\n(?=#{1,6} |=+ |(?:export |public |abstract |final |async )*(?:class|interface|def|function) )")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?;](?:\s+|$)|[。！？；]")
WORD = re.compile(r"\s+")
LEVELS = (SECTION, PARAGRAPH, LINE, SENTENCE, WORD)


def atoms(text: str, lo: int, hi: int, most: int, hard: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of at most ``most`` characters that cover text[lo:hi] in order; where no boundary is left, of ``hard``."""
    if hi - lo <= most:
        if hi > lo:
            yield lo, hi
        return
    if level == len(LEVELS):
        for k in range(lo, hi, hard):
            yield k, min(hi, k + hard)
        return
    at = lo
    run: list[int] = []  # spans of this level are packed before they are cut further
    for m in LEVELS[level].finditer(text, lo, hi):
        run.append(m.end())
    run.append(hi)
    start = at
    for end in run:
        if end == start:
            continue
        yield from atoms(text, start, end, most, hard, level + 1)
        start = end


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, repeated) of each piece: the piece is text[start - repeated : end]."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap below it")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    out: list[tuple[int, int, int]] = []
    start = repeated = end = 0
    for lo, hi in atoms(text, 0, len(text), limit, limit - overlap):
        if end > start and hi - start + repeated > limit:
            out.append((start, end, repeated))
            # what fits by itself isn't cut for the sake of the overlap
            start, repeated = end, tail(text, start, end, min(overlap, limit - (hi - lo)))
        end = hi
    out.append((start, end, repeated))
    return out


def tail(text: str, lo: int, hi: int, overlap: int) -> int:
    """How many characters at the end of text[lo:hi] to repeat: from the strongest boundary within ``overlap``, not all of it."""
    first = max(lo + 1, hi - overlap)
    if first >= hi:
        return 0
    for level in (PARAGRAPH, LINE, SENTENCE, WORD):
        for m in level.finditer(text, max(lo, first - 1), hi):
            if first <= m.end() < hi:
                return hi - m.end()
    return hi - first


def split_items(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, piece_no (from 0), start, overlap, piece for every row whose text isn't null. Other columns are left out."""
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    src = df.filter(F.col(text).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("body"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False):
                rows += [(*row[:-1], i, lo, rep, row[-1][lo - rep : hi]) for i, (lo, hi, rep) in enumerate(split_text(row[-1], limit, overlap))]
            yield pd.DataFrame(rows, columns=[*names, "piece_no", "start", "overlap", "piece"])

    got = src.mapInPandas(cut, ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, names)) + ", piece_no int, start int, overlap int, piece string")
    return got.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "piece_no", "start", "overlap", "piece")


def module_texts(modules: DataFrame, contents: DataFrame, longer_than: int | None = None) -> DataFrame:
    """(item_id, text): the lines of each module. With ``longer_than``, only modules whose text is longer; files that are too short for that are dropped before the join."""
    files = contents.filter(F.col("content").isNotNull()).select("file_id", "content")
    if longer_than is not None:
        files = files.filter(F.length("content") > longer_than)
    files = files.dropDuplicates(["file_id"]).select("file_id", F.split("content", "\n").alias("lines"))
    lo = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    hi = F.least(F.coalesce("end_line", F.size("lines")), F.size("lines"))
    lines = F.when((hi >= lo) & (lo <= F.size("lines")), F.slice("lines", lo, F.greatest(hi - lo + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    text = modules.select("id", "file_id", "start_line", "end_line").dropDuplicates(["id"]).join(files, "file_id").select(F.col("id").alias("item_id"), F.array_join(lines, "\n").alias("text"))
    return text if longer_than is None else text.filter(F.length("text") > longer_than)


def pieces(embeddings: DataFrame, modules: DataFrame, contents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item_kind, item_id, piece_no, start, overlap, piece of every item above the limit."""
    e = embeddings.filter(F.length("content") > limit).select("id", "content").dropDuplicates(["id"]).select(F.lit("embedding").alias("item_kind"), F.col("id").alias("item_id"), F.col("content").alias("text"))
    m = module_texts(modules, contents, limit).select(F.lit("module").alias("item_kind"), "item_id", "text")
    return split_items(e.unionByName(m), ["item_kind", "item_id"], "text", limit, overlap)


def oversized(embeddings: DataFrame, modules: DataFrame, contents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_id) of the items that come out in more than one piece."""
    return pieces(embeddings, modules, contents, limit, overlap).filter(F.col("piece_no") == 1).select("item_kind", "item_id")
