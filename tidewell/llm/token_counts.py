"""Token counts: pieces counted once for each distinct pre-token, joined to the documents' pre-token frequencies.

1. Map: each stretch of about ``STRETCH`` bytes of documents is cut to
   pre-tokens; its (pre-token, document, frequency) triples are packed by
   pre-token bucket, each distinct pre-token written once.  A directory of the
   stretch's documents goes along.  Nothing is kept per token of the corpus.
2. Reduce, by bucket: the library counts the pieces of each distinct
   pre-token of the bucket once; the counts are joined to the packed
   frequencies and summed by document.  Lists of ids are never made.  The
   counts remembered are at most ``REMEMBERED``; beyond that a pre-token may be
   counted again.
3. The partial sums of a stretch meet its directory, one small group for each
   stretch, whose pre-token totals are compared: a mismatch is an error.

A pre-token that is in over an eighth of a stretch's documents goes to a
bucket that also depends on the stretch, so that no bucket has to take one
entry for each document of the corpus; such a pre-token is counted once for
each bucket instead of once.

The rows of each partition are sorted by text hash and id before they are cut
to stretches, so a task that runs again makes the same stretches whatever order
its input arrives in, and the partial sums of the first run still fit.

The tokenizer's file is read on the driver and shipped (a fixed size).  Its
special strings are single tokens inside texts, as by the library's default;
ones that also take the blanks around them, or only stand as whole words, are
refused.  doc_id may be of any type that has an order.
Null and empty texts have no bytes and no tokens.  Repeated rows are counted
alike, each on its own.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import text_of

LIMIT = 1024
STRETCH, REMEMBERED = 12 << 20, 1 << 20
#: White space and the pre-token pattern of byte-level BPE: fixed values.
WHITE_POINTS = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
WHITE = "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in WHITE_POINTS)
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
PACKED = "stretch string, bucket int, kind int, payload binary"


def _pack(*arrays) -> bytes:
    return zlib.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(b: bytes) -> tuple:
    return pickle.loads(zlib.decompress(b))


def _stretch(name: str, ids: list, texts: list[str], sizes: list[int], cut, specials, buckets: int) -> Iterator[tuple]:
    """The packed rows of one stretch."""
    vocab: dict[str, int] = {}
    add = vocab.setdefault
    toks, docs, freqs = [], [], []
    fixed, pre = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for j, text in enumerate(texts):
        parts = specials.split(text) if specials else [text]
        fixed[j] = len(parts) - 1
        own = [add(t, len(vocab)) for p in parts for t in cut(p)]
        if own:
            u, n = np.unique(np.array(own, np.int32), return_counts=True)
            pre[j] = len(own)
            toks.append(u)
            docs.append(np.full(len(u), j, np.int32))
            freqs.append(n.astype(np.int32))
    yield name, zlib.crc32(name.encode()) % buckets, 0, _pack(ids, sizes, fixed, pre)
    if not vocab:
        return
    tok, doc, freq = map(np.concatenate, (toks, docs, freqs))
    words = list(vocab)
    coded = [w.encode() for w in words]
    df = np.bincount(tok, minlength=len(words))
    home = np.fromiter((zlib.crc32(c) for c in coded), np.int64, len(words))
    home = np.where(8 * df > len(texts), home + zlib.crc32(name.encode()), home) % buckets
    order = np.lexsort((doc, tok, home[tok]))
    tok, doc, freq = tok[order], doc[order], freq[order]
    bounds = np.searchsorted(home[tok], np.arange(buckets + 1))
    for b in range(buckets):
        i, j = bounds[b], bounds[b + 1]
        if i < j:
            used, first = np.unique(tok[i:j], return_index=True)
            step = np.diff(doc[i:j], prepend=np.int32(0))
            yield name, b, 1, _pack(len(texts), b"".join(coded[t] for t in used), np.array([len(coded[t]) for t in used], np.uint32), np.diff(np.append(first, j - i)).astype(np.uint32), _narrow(step), _narrow(freq[i:j]))


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16):
        if len(x) and np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _mapper(special: list[str], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        cut = regex.compile(PRE_TOKEN).findall
        specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        at, part = 0, TaskContext.get().partitionId()

        def out(ids, texts, sizes):
            nonlocal at
            name = f"{part}-{at}-{zlib.crc32(repr((ids, sizes)).encode()):08x}"
            at += 1
            rows = list(_stretch(name, ids, texts, sizes, cut, specials, buckets))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["stretch", "bucket", "kind", "payload"])

        ids, texts, sizes, room = [], [], [], STRETCH
        for b in batches:
            doc_ids, column, lengths = b.column("doc_id"), b.column("text"), b.column("n_bytes")
            for k in range(b.num_rows):
                n = lengths[k].as_py()
                ids.append(doc_ids[k].as_py())
                texts.append(column[k].as_py())
                sizes.append(n)
                room -= n + 64
                if room < 0:
                    yield out(ids, texts, sizes)
                    ids, texts, sizes, room = [], [], [], STRETCH
        if ids:
            yield out(ids, texts, sizes)

    return run


def _reducer(tokenizer_json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library, pieces = None, {}
        for b in batches:
            names, payloads = [], []
            for name, kind, payload in zip(*(b.column(c).to_pylist() for c in ("stretch", "kind", "payload")), strict=True):
                if kind == 1:
                    n_docs, joined, lengths, df, step, freq = _unpack(payload)
                    ends = np.cumsum(lengths)
                    coded = [joined[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    if len(pieces) > REMEMBERED:
                        pieces.clear()
                    new = [c for c in coded if c not in pieces]
                    if new:
                        library = library or Tokenizer.from_str(tokenizer_json)
                        for i in range(0, len(new), 4096):
                            few = new[i : i + 4096]
                            pieces.update(zip(few, (len(e) for e in library.encode_batch_fast([c.decode() for c in few], add_special_tokens=False)), strict=True))
                    each = np.repeat(np.fromiter((pieces[c] for c in coded), np.int64, len(coded)), df)
                    doc = np.cumsum(step.astype(np.int64))
                    sums = np.bincount(doc, weights=freq * each, minlength=n_docs).astype(np.int64)
                    payload = _pack(_narrow(sums), int(freq.sum(dtype=np.int64)))
                names.append(name)
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column("kind"), pa.array(payloads, pa.binary())], ["stretch", "kind", "payload"])

    return run


def _gather(limit: int, kind: pa.DataType):
    def run(rows: pa.Table) -> pa.Table:
        name = rows.column("stretch")[0].as_py()
        heads = [p for p, k in zip(rows.column("payload").to_pylist(), rows.column("kind").to_pylist(), strict=True) if k == 0]
        if len(heads) != 1:
            raise ValueError(f"stretch {name}: {len(heads)} directories; its input was not read alike twice")
        ids, sizes, total, pre = _unpack(heads[0])
        seen = 0
        for payload, k in zip(rows.column("payload"), rows.column("kind").to_pylist(), strict=True):
            if k == 1:
                sums, n = _unpack(payload.as_py())
                total = total + sums
                seen += n
        if seen != pre.sum():
            raise ValueError(f"stretch {name}: {seen} of {pre.sum()} pre-tokens; its input was not read alike twice")
        return pa.table({"doc_id": pa.array(ids, kind), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total, pa.int64()), "n_pre_tokens": pa.array(pre, pa.int64()), "over_limit": pa.array(total > limit)})

    return run


def special_strings(own: dict) -> list[str]:
    """The added tokens of a tokenizer's description, which must be a plain byte-level BPE."""
    if own["pre_tokenizer"]["type"] != "ByteLevel" or not own["pre_tokenizer"].get("use_regex", True) or own["pre_tokenizer"]["add_prefix_space"] or own.get("normalizer"):
        raise ValueError("a byte-level BPE without normaliser and prefix space is needed")
    if any(t.get(k) for t in own["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take blanks or stand only as whole words are not supported")
    return [t["content"] for t in own["added_tokens"]]


def count(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_pre_tokens, over_limit for every row.  tokenizer_file: a byte-level BPE file of the tokenizers library, on the driver."""
    with open(tokenizer_file, encoding="utf-8") as f:
        described = f.read()
    special = special_strings(json.loads(described))
    session = docs.sparkSession
    wide = int(session.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 2 * wide
    field = docs.schema["doc_id"].dataType
    kind = field.simpleString()
    rows = docs.select(F.col("doc_id"), text_of().alias("text"), F.octet_length(text_of()).cast("bigint").alias("n_bytes"), F.xxhash64(text_of()).alias("th")).sortWithinPartitions("th", "doc_id")
    packed = rows.mapInArrow(_mapper(special, buckets), PACKED).repartition(wide, "bucket")
    summed = packed.mapInArrow(_reducer(described), "stretch string, kind int, payload binary")
    return summed.groupBy("stretch").applyInArrow(_gather(limit, to_arrow_type(field)), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_pre_tokens bigint, over_limit boolean")
