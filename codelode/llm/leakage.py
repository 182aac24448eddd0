"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over the normalised test prompts and answers, whole and in runs of three words, scans every
text once; each hit knows its item, its place in the item and its offset in the original text. A hit of a whole one is a
leak by itself. Documents and items that share enough runs are aligned exactly: words in running order, single words
changed or added allowed.

Defined results
* normalised: compatibility forms, case, accents, look-alike letters, zero-width characters, mark-up and punctuation;
* an instruction that opens many prompts of a suite is not an item's own wording;
* a document leaks an item if at least 20 of the item's words stand in it in one or two places, dense enough to be a
  quotation, or a whole answer given as code; the same frame with other names and numbers is too thin;
* ``passages`` reports a prompt or answer of three words or more that stands in a document as a whole at any length,
  ``leaks`` only counts it from 20 words on, as shorter quotes are no cases;
* start and end are offsets in the original text (Unicode code points) of the longest place;
* the same wording under any number of items is found once and reported for each of them;
* null and blank texts leak nothing; null prompts and answers offer nothing; repeated rows give one row;
* the items are broadcast: their size is measured first; beyond ``most_chars`` suites are taken together up to that
  size and the documents scanned once for each such part. A single suite beyond it is an error.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import ship

RUN = 3
#: Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans(dict(x.split(":") for x in "а:a в:b е:e к:k м:m н:h о:o р:p с:c т:t у:y х:x і:i ј:j ѕ:s һ:h ԁ:d ԛ:q ԝ:w ѵ:v ӏ:l ɡ:g ɑ:a ı:i α:a β:b ε:e η:n ι:i κ:k ν:v ο:o ρ:p τ:t υ:u χ:x ø:o ł:l đ:d".split()))
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|&(?:[a-z]+|#\d+);|\\[nrt](?=\w)|\[/?[A-Z]+\]|\]\([^)\s]*\)")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n\s*(?:[>#*|/]+\s*)?(?=[a-zß-ÿ])")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words and where each begins and ends in the original text."""
    plain = text.isascii()
    words, at = [], []
    if plain:
        t = _TAG.sub(lambda m: " " * len(m.group()), text)
        for m in _WORD.finditer(t):
            words.append(m.group().lower())
            at.append(m.span())
        return words, at
    # each original character gives none or more normalised ones; places keeps where from
    out, places = [], []
    t = _TAG.sub(lambda m: " " * len(m.group()), text)
    for i, c in enumerate(t):
        if c < "\x80":
            out.append(c.lower())
            places.append(i)
        elif _INVISIBLE.match(c):
            continue
        else:
            for d in unicodedata.normalize("NFKD", c):
                if not unicodedata.combining(d):
                    for e in d.casefold().translate(ALIKE):
                        out.append(e)
                        places.append(i)
    s = "".join(out)
    for m in _WORD.finditer(s):
        words.append(m.group())
        at.append((places[m.start()], places[m.end() - 1] + 1))
    return words, at


def key(word: str) -> str:
    """What a word is compared by: swapped letters don't matter, swapped digits do."""
    return "".join(sorted(word)) if len(word) > 3 and word.isalpha() else word


def own_wording(items: list[tuple[int, str | None, str | None, str | None]], shared: int = 3) -> list[tuple[int, str, list[str]]]:
    """(item_id, prompt or answer, words) of each text; an opening sentence that ``shared`` prompts of a suite have is left out."""
    openings: Counter[tuple[str | None, str]] = Counter()
    for suite, prompt in {(suite, prompt) for _, suite, prompt, _ in items}:  # repeated items are no frame
        if prompt:
            openings.update((suite, p) for p in {x for x in _openings(prompt)})
    out = []
    for item, suite, prompt, answer in items:
        if prompt:
            cut = max((len(p) for p in _openings(prompt) if openings[suite, p] >= shared), default=0)
            out.append((item, "prompt", [key(w) for w in words_of(prompt[cut:])[0]]))
        if answer:
            out.append((item, "answer", [key(w) for w in words_of(answer)[0]]))
    return [x for x in out if x[2]]


def _openings(prompt: str) -> list[str]:
    """The prompt up to the end of each of its first sentences and lines."""
    return [prompt[: m.end()] for m in list(re.finditer(r"[.!?:]\s+|\n+", prompt))[:6]]


def is_code(text: str | None) -> bool:
    """Whether an answer is given as code."""
    return bool(text and re.search(r"^\s*(?:def |class |function |public |return |import |for |if .*:$)|[{};]\s*$", text, re.M) and re.search(r"[=(){}\[\];]", text))


def matches(a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place in a, place in b) of words in running order on both sides around the seeds ``pairs``: longest chain of equal words."""
    pairs = sorted(set(pairs))
    # longest increasing chain over the places in b
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = [-1] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0], -pairs[i][1]))
    for i in order:
        y = pairs[i][1]
        k = bisect_right(tails, y - 1)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            ends.append(i)
        else:
            tails[k] = y
            ends[k] = i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


class Carrier:
    """All items' wording, the automaton over it, and the judgement of a text."""

    def __init__(self, items: list[tuple[int, str | None, str | None, str | None]], least: int = 20) -> None:
        import ahocorasick

        self.least = least
        self.texts = own_wording(items)
        # the same wording counts once, however many items have it
        number: dict[tuple[str, ...], int] = {}
        self.wording = [number.setdefault(tuple(words), len(number)) for _, _, words in self.texts]
        common = Counter(w for words in number for w in set(words))
        # names, numbers and the like, as against the words of frames that many items share
        self.special = {w for w, n in common.items() if n <= max(3, 0.05 * len(number))}
        self.code = {(i, "answer") for i, _, _, a in items if is_code(a)}
        places: dict[str, list[tuple[int, int]]] = {}
        for t, (_, _, words) in enumerate(self.texts):
            for k in range(len(words) - RUN + 1):
                places.setdefault(" ".join(words[k : k + RUN]), []).append((t, k))
        # runs that many wordings share are frames: they are counted when a pair is aligned, they don't propose it
        rare = {run for run, at in places.items() if len({self.wording[t] for t, _ in at}) <= 8}
        needed = self._needed(rare)
        whole: dict[str, list[int]] = {}
        for t, (_, _, words) in enumerate(self.texts):
            if len(words) >= RUN:
                whole.setdefault(" ".join(words), []).append(t)
        self.automaton = ahocorasick.Automaton()
        for run in places.keys() | whole.keys():
            at = places.get(run, [])
            self.automaton.add_word(f" {run} ", (at if run in rare else [p for p in at if p in needed], whole.get(run, ()), len(run) + 2))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def _needed(self, rare: set[str]) -> set[tuple[int, int]]:
        """(text, place) of the frequent runs in stretches of ``least`` words that have rare ones for less than half of their runs."""
        out: set[tuple[int, int]] = set()
        for t, (_, _, words) in enumerate(self.texts):
            runs = [" ".join(words[k : k + RUN]) in rare for k in range(len(words) - RUN + 1)]
            size = self.least - RUN + 1
            for k in range(max(1, len(runs) - size + 1)):
                part = runs[k : k + size]
                if 2 * sum(part) < len(part):
                    out.update((t, k + i) for i, r in enumerate(part) if not r)
        return out

    def proposals(self, text: str) -> tuple[list[str], list[tuple[int, int]], dict[int, list[tuple[int, int]]], dict[int, int]]:
        """The text's words, their places, for each item's text the (place in it, place in the words) of shared runs, and
        for each that stands there as a whole the first place."""
        words, at = words_of(text)
        words = [key(w) for w in words]
        found: dict[int, list[tuple[int, int]]] = {}
        whole: dict[int, int] = {}
        if self.empty or len(words) < RUN:
            return words, at, found, whole
        joined = " " + " ".join(words) + " "
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        number = {s: i for i, s in enumerate(starts)}
        for end, (where, wholes, size) in self.automaton.iter(joined):
            if where or wholes:
                w = number[end - size + 1]
                for t, k in where:
                    found.setdefault(t, []).append((k, w))
                for t in wholes:
                    whole.setdefault(t, w)
        return words, at, found, whole

    def carried(self, words: list[str], t: int, seeds: list[tuple[int, int]]) -> tuple[int, float, int, int]:
        """How many words of the item's text stand in the words in one or two dense places; the longest one's share of the
        item's text, and its first and last word."""
        mine = self.texts[t][2]
        best: list[tuple[int, int, int, int]] = []
        # windows around the seeds' diagonals, so a long text isn't aligned as a whole
        groups: list[list[tuple[int, int]]] = []
        for k, w in sorted(seeds, key=lambda s: s[1]):
            if groups and w - groups[-1][-1][1] <= 2 * len(mine) // 3 + 12:
                groups[-1].append((k, w))
            else:
                groups.append([(k, w)])
        index: dict[str, list[int]] = {}
        for k, w in enumerate(mine):
            index.setdefault(w, []).append(k)
        for g in groups:
            lo, hi = max(0, g[0][1] - len(mine)), min(len(words), g[-1][1] + len(mine) + RUN)
            pairs = [(k, j) for j in range(lo, hi) for k in index.get(words[j], ())]
            chain = matches(mine, words, pairs)
            best += self._segments(mine, chain)
        best.sort(reverse=True)
        if not best:
            return 0, 0.0, 0, 0
        return best[0][0] + (best[1][0] if len(best) > 1 else 0), best[0][0] / len(mine), best[0][2], best[0][3]

    def _segments(self, mine: list[str], chain: list[tuple[int, int]], gap: int = 3, dense: float = 0.7, least: int = 5) -> list[tuple[int, int, int, int]]:
        """(words, start in the item, start in the text, end in the text) of the dense stretches of a chain.

        ``dense`` holds for all words of both spans, and by itself for the special words of the item's span: a frame with
        other names and numbers has the first but not the second.
        """
        out = []
        special = [0]
        for w in mine:
            special.append(special[-1] + (w in self.special))
        least_special = min(2, special[-1])  # wording that many items share may have none
        i, n = 0, len(chain)
        while i < n:
            end, got = -1, 0
            for j in range(i, n):
                if j > i and (chain[j][0] - chain[j - 1][0] > gap + 1 or chain[j][1] - chain[j - 1][1] > gap + 1):
                    break
                got += mine[chain[j][0]] in self.special
                size, a, b = j - i + 1, chain[j][0] - chain[i][0] + 1, chain[j][1] - chain[i][1] + 1
                of = special[chain[j][0] + 1] - special[chain[i][0]]
                if size >= dense * a and size >= dense * b and got >= dense * of and got >= least_special:
                    end = j
            if end - i + 1 >= least:
                out.append((end - i + 1, chain[i][0], chain[i][1], chain[end][1]))
                i = end + 1
            else:
                i += 1
        return out

    def passages(self, text: str) -> list[tuple[int, str, int, float, bool, int, int]]:
        """(item, prompt or answer, words, share, whether it is a case, start, end) of each item's text that the text carries."""
        words, at, found, whole = self.proposals(text)
        out = []
        judged: dict[int, tuple[int, float, int, int]] = {}
        for t in found.keys() | whole.keys():
            item, kind, mine = self.texts[t]
            if t in whole:
                n, share, lo, hi = len(mine), 1.0, whole[t], whole[t] + len(mine) - 1
            elif len(found[t]) < 2:
                continue
            else:
                same = self.wording[t]
                if same not in judged:
                    judged[same] = self.carried(words, t, found[t])
                n, share, lo, hi = judged[same]
            case = n >= self.least or ((item, kind) in self.code and share >= 0.9)
            if case or t in whole:
                out.append((item, kind, n, share, case, at[lo][0], at[hi][1]))
        return out

    def items_in(self, text: str) -> set[int]:
        return {p[0] for p in self.passages(text) if p[4]}


_CARRIERS: dict[str, Carrier] = {}


def _carrier(digest: str, rows: list, least: int) -> Carrier:
    """One automaton a worker, not one a task."""
    if digest not in _CARRIERS:
        if len(_CARRIERS) > 3:
            _CARRIERS.clear()
        _CARRIERS[digest] = Carrier(rows, least)
    return _CARRIERS[digest]


def passages(documents: DataFrame, items: DataFrame, least: int = 20, most_chars: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, part, words, share, is_case, start, end) of what each document carries of the items."""
    spark = documents.sparkSession
    ship(spark)
    own = items.filter(F.col("item_id").isNotNull()).select("item_id", "suite", "prompt", "answer").distinct()
    length = F.coalesce(F.length("prompt"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0))
    parts: list[tuple[int, list[str | None]]] = []
    for r in own.groupBy("suite").agg(F.sum(length).alias("n")).sort("suite").toLocalIterator():
        if r["n"] > most_chars:
            raise ValueError(f"suite {r['suite']} has more than {most_chars} characters of test items; pass it in parts")
        if parts and parts[-1][0] + r["n"] <= most_chars:
            parts[-1] = (parts[-1][0] + r["n"], [*parts[-1][1], r["suite"]])
        else:
            parts.append((r["n"], [r["suite"]]))
    text = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    kind = dict(text.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, part string, words int, share double, is_case boolean, start int, end int"
    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.int32()]

    def scan_for(suites: list[str | None]) -> DataFrame:
        mine = own.filter(F.col("suite").isin([x for x in suites if x is not None]) | (F.col("suite").isNull() if None in suites else F.lit(False)))
        rows = [tuple(r) for r in mine.sort("item_id").collect()]
        digest = hashlib.blake2b(repr((least, rows)).encode("utf-8", "replace"), digest_size=16).hexdigest()
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            carrier = _carrier(digest, shared.value, least)
            for b in batches:
                doc, got = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for p in carrier.passages(t):
                        doc.append(i)
                        got.append(p)
                cols = [pa.array([p[k] for p in got], x) for k, x in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *cols], ["doc_id", "item_id", "part", "words", "share", "is_case", "start", "end"])

        return text.mapInArrow(scan, schema)

    if not parts:
        return spark.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionAll, (scan_for(suites) for _, suites in parts)).distinct()


def leaks(documents: DataFrame, items: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, item_id) of every document that carries an item."""
    return passages(documents, items, least).filter("is_case").select("doc_id", "item_id").distinct()
