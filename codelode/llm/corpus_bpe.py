"""Encoding of the whole corpus with a public tokenizer, by content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text into chunks; where texts share a passage they share its inner
chunks. Each distinct chunk is encoded once. To join two neighbours, the last pre-token of the left one is encoded
again together with the right one's text until a pre-token boundary agrees with one the right chunk has by itself; from
there on its ids stand as they are. Pre-tokens are matched from left to right without looking back, so the result is
exactly the encoding of the whole text.

Defined results: null and empty texts give an empty list; special tokens' strings in a text are ordinary text; every row
of the table gives one row, a repeated one too.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import shared_dir, ship

#: Fixed value: the pre-tokenizer of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MASK_BITS, LEAST, MOST = 9, 128, 4096


@functools.cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_PRE = regex.compile(PATTERN)
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last 32 bytes asks for a cut. data: uint8."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) <= k:
            break
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h = g
    return np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1


def chunks_of(data: bytes, asked: np.ndarray, base: int = 0) -> list[bytes]:
    """The chunks of one text; ``asked`` are the cut points of its bytes, counted from ``base``. No cut inside a character."""
    out, at, n = [], 0, len(data)
    wanted = [int(p) - base for p in asked]
    wanted.append(n)
    for p in wanted:
        while p - at > MOST:
            q = at + MOST
            while data[q] & 0xC0 == 0x80:
                q -= 1
            out.append(data[at:q])
            at = q
        if p < n and (p - at < LEAST or data[p] & 0xC0 == 0x80):
            continue
        if p > at:
            out.append(data[at:p])
            at = p
    return out


#: No pre-token spans the place between such a sign and a letter or digit, nor the one before a white space.
_SURE = regex.compile(r"[!-&(-/:-@\[-`{-~](?=[A-Za-z0-9])|\S(?=\s)")


@functools.cache
def _lengths(enc) -> np.ndarray:
    """Bytes of each token."""
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def encode_chunk(enc, data: bytes, head: int = 6) -> tuple[list[int], int, list[tuple[int, int]]]:
    """ids; how many of them may change with what follows; (bytes, ids) up to each of the first pre-tokens' ends."""
    text = data.decode()
    ids = enc.encode_ordinary(text)
    upto = np.cumsum(_lengths(enc)[ids])
    sizes, plain = [], len(text) == len(data)
    for m in _PRE.finditer(text):
        sizes.append(m.end() if plain else len(text[: m.end()].encode()))
        if len(sizes) == head:
            break
    counts = (np.searchsorted(upto, sizes) + 1).tolist()
    # the last pre-tokens, read from the last sure boundary that is not far away
    start = max(0, len(text) - 64)
    for m in _SURE.finditer(text, start):
        start = m.end()
    before = last = ""
    for m in _PRE.finditer(text, start if start and start > len(text) - 64 else 0):
        before, last = last, m.group()
    # what follows can lengthen the last pre-token; of 're, 'll and 've cut after one letter the apostrophe is one by itself here
    open_ = len(ids) - int(np.searchsorted(upto, len(data) - len(last.encode()), "right")) + (before == "'" and last in ("r", "l", "v"))
    return ids, open_, list(zip(sizes, counts))


def joined(enc, parts: list[tuple[list[int], int, list[tuple[int, int]]]]) -> list[int]:
    """The ids of the text whose chunks these are."""
    if not parts:
        return []
    ids, last, _ = parts[0]
    out, pend = list(ids[: len(ids) - last]), enc.decode_bytes(ids[len(ids) - last :])
    for ids, last, ends in parts[1:]:
        right = enc.decode_bytes(ids[: ends[-1][1]])
        text = (pend + right).decode()
        mine = {size: count for size, count in ends[:-1] if count <= len(ids) - last}
        size, new, agreed = -len(pend), [], False
        for m in _PRE.finditer(text):
            size += len(m.group().encode())
            new.append(m.group())
            if size in mine:
                agreed = True
                break
        if not agreed:  # nothing agrees in the right one's head: all of it stays open
            pend += enc.decode_bytes(ids)
        else:
            for t in new:  # one by one: a white-space run that ends here would be matched otherwise
                out += enc.encode_ordinary(t)
            out += ids[mine[size] : len(ids) - last]
            pend = enc.decode_bytes(ids[len(ids) - last :])
    return out + enc.encode_ordinary(pend.decode())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for every row of docs."""
    # rows are told apart by their place, so a row that is there twice comes out twice
    ship(docs.sparkSession)
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key_, seq, digest, body = [], [], [], [], []
            seen: set[bytes] = set()
            texts = [(t or "").encode() for t in b.column(2).to_pylist()]
            asked = cut_points(np.frombuffer(b"".join(texts), np.uint8))
            lo = 0
            for r, d, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                if not data:
                    doc.append(r)
                    key_.append(d)
                    seq.append(-1)
                    digest.append(None)
                    body.append(None)
                    continue
                here = asked[np.searchsorted(asked, lo, "right") : np.searchsorted(asked, lo + len(data), "left")]
                for i, c in enumerate(chunks_of(data, here, lo)):
                    h = hashlib.blake2b(c, digest_size=16).digest()
                    doc.append(r)
                    key_.append(d)
                    seq.append(i)
                    digest.append(h)
                    body.append(None if h in seen else c)
                    seen.add(h)
                lo += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key_, b.column(1).type), pa.array(seq, pa.int32()), pa.array(digest, pa.binary()), pa.array(body, pa.binary())], ["row", "doc_id", "seq", "digest", "body"])

    kind = dict(src.dtypes)["doc_id"]
    # cut once; three readers take their columns of it
    at = f"{shared_dir(docs.sparkSession)}/chunks-{uuid.uuid4().hex}"
    src.mapInArrow(cut, f"row long, doc_id {kind}, seq int, digest binary, body binary").write.option("compression", "zstd").parquet(at)
    parts = docs.sparkSession.read.parquet(at)
    distinct = parts.filter(F.col("body").isNotNull()).groupBy("digest").agg(F.first("body").alias("body"))

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in batches:
            got = [encode_chunk(enc, c) for c in b.column(1).to_pylist()]
            rows = [np.asarray(i, np.uint16).tobytes() for i, _, _ in got]
            ends = [np.asarray(e, np.int32).tobytes() for _, _, e in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), pa.array([t for _, t, _ in got], pa.int32()), pa.array(ends, pa.binary())], ["digest", "ids", "last", "ends"])

    coded = distinct.mapInArrow(encode_chunks, "digest binary, ids binary, last int, ends binary")
    # of a chunk that a third of all texts share, the references are one skewed partition, which AQE splits
    lists = parts.filter("seq >= 0").select("row", "doc_id", "seq", "digest").join(coded, "digest").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ids", "last", "ends"))).alias("parts"))

    def join_up(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in frames:
            out = []
            for ps in b.column(2).to_pylist():
                got = [(np.frombuffer(p["ids"], np.uint16).tolist(), p["last"], list(map(tuple, np.frombuffer(p["ends"], np.int32).reshape(-1, 2).tolist()))) for p in ps]
                out.append(joined(enc, got))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    done = lists.mapInArrow(join_up, f"doc_id {kind}, ids array<int>")
    empty = parts.filter("seq < 0").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return done.unionByName(empty).select(F.col("doc_id").alias(key), "ids")
