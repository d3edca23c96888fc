"""Media columns: payloads kept as FLAC streams in a binary column.

``encode`` stores a text's bytes as 8-bit mono samples, ``decode`` verifies streams
and turns them into PCM blocks with the first sample of each, which is where a
reader can seek to, and ``features`` describes what such blocks hold. ``round_trip``
does all three, with the streams written as Parquet in the shared folder and read
back from there. All work is within rows, so there is no shuffle.

Defined cases: null or empty text is a payload of 64 zero bytes; repeated rows
keep a row each; null doc_id is kept; other columns are not read. A stream with a
wrong checksum fails the job.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _text as X
from tarn.llm import flac
from tarn.llm._store import table

UNIT = 64


def payload(text: bytes) -> bytes:
    """The text's bytes, with zero bytes up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def _payloads(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded payloads of a slice of texts, as one array of int8 samples (byte - 128), and their offsets."""
    n = np.diff(offs)
    full = np.maximum(UNIT, -(-n // UNIT) * UNIT)
    bounds = np.concatenate(([0], np.cumsum(full)))
    out = np.zeros(int(bounds[-1]), np.uint8)
    out[np.arange(len(buf)) + np.repeat(bounds[:-1] - offs[:-1], n)] = buf
    return (out ^ np.uint8(128)).view(np.int8), bounds


def _feature(x: np.ndarray) -> str:
    """Energy, zero crossings, peak and sum of samples, as whole numbers."""
    y = x.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"energy={int((y * y).sum())};crossings={crossings};peak={int(np.abs(y).max())};sum={int(y.sum())}"


def _encode(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        buf, offs = X.column(batch, "text")
        for a, b in X.slices(offs):
            samples, bounds = _payloads(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            media = flac.encode_many(samples, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offs[a : b + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _decode(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        media = [m.as_buffer().to_pybytes() for m in batch.column("media")]
        got = flac.decode_many(media)
        first = [f for _, f in got]
        per = np.cumsum([0, *map(len, first)])
        size = np.array([len(x) for x, _ in got], np.int64)
        offset = np.concatenate([np.zeros(0, np.int64), *first]).astype(np.int64)
        ends = np.append(offset[1:], 0)
        ends[per[1:] - 1] = size
        pcm = b"".join([x.tobytes() for x, _ in got])
        cuts = np.append(0, np.cumsum(ends - offset)).astype(np.int64)
        blocks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offset), [None, pa.py_buffer(cuts), pa.py_buffer(pcm)]).cast(pa.binary())
        each = pa.StructArray.from_arrays([pa.array(offset), pa.array((ends - offset).astype(np.int32)), blocks], ["first_sample", "n_samples", "pcm"])
        sums = pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string())
        cols = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(list(map(len, media)), pa.int64()), sums, pa.ListArray.from_arrays(pa.array(per, pa.int32()), each)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])


def _features(batches: Iterator[pa.RecordBatch]):
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        col = batch.column("blocks")
        at, pcm = np.asarray(col.offsets), col.values.field("pcm").cast(pa.large_binary())
        first, size = (np.asarray(col.values.field(c)).astype(np.int64) for c in ("first_sample", "n_samples"))
        _, bounds, data = pcm.buffers()
        bounds = np.frombuffer(bounds, np.int64)[pcm.offset : pcm.offset + len(pcm) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        follows = np.append(0, first[:-1] + size[:-1])
        follows[at[:-1]] = 0  # each payload begins with a block of its own
        if len(first) and (follows[at[0] : at[-1]] != first[at[0] : at[-1]]).any():
            raise ValueError("blocks don't follow each other")
        rows = []
        for a, b, n, sha in zip(bounds[at[:-1]], bounds[at[1:]], batch.column("media_bytes").to_pylist(), batch.column("media_sha256").to_pylist(), strict=True):
            x = data[a:b].view(np.int8)
            raw = (data[a:b] ^ np.uint8(128)).tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), n, sha, _feature(x)))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", *names])


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _id(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's payload as a FLAC stream."""
    return docs.select("doc_id", "text").mapInArrow(_encode, f"{_id(docs)}, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256 and ``blocks``: of each stream its PCM blocks (signed bytes) with the first sample of each."""
    blocks = "array<struct<first_sample:long,n_samples:int,pcm:binary>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, f"{_id(media)}, n_bytes long, media_bytes long, media_sha256 string, blocks {blocks}")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, n_samples, pcm: a row for each block of each stream of ``decode``."""
    return decoded.select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.*")


def features(decoded: DataFrame) -> DataFrame:
    """Sums and features of the payload that the blocks of ``decode`` hold."""
    return decoded.mapInArrow(_features, f"{_id(decoded)}, n_bytes long, {_FEATURES}")


def round_trip(docs: DataFrame) -> DataFrame:
    """Streams are written to the shared folder, read from there, decoded to PCM blocks, and described by those.

    The blocks aren't written as well: both would be twice the text. ``pcm_blocks`` of ``decode`` writes them where they are wanted.
    """
    return features(decode(table(encode(docs), "flac")))
