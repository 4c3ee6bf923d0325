"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in WAV containers.

mu-law and A-law are expanded by lookup tables. ADPCM blocks depend on nothing outside
themselves, so numpy steps through the samples of a block once, over all blocks of many
files side by side. Expanded audio is resampled by linear interpolation in integers and
stored as 16-bit PCM at twice the recordings' rate, in a form that loses nothing (``packed``),
beside the recording it comes from, in a table that is read back.

A null or empty recording has no samples. A container that can't be read gives nulls: one that
is cut off, isn't mono, has a rate of 0 or ADPCM blocks without room for samples, or another codec.
A payload that isn't whole ADPCM blocks loses nothing: the last block counts as padded by 0.
Texts count as empty where they are null, are stored whole however long they are, and equal
texts (repeated rows) give equal values. Of ``docs`` only doc_id and text are read, whatever
else there is. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import windows
from .shared import clean_name, documents, small_batches, tidied, written

UNIT = 64
#: Samples a second of the recordings, and of the PCM stored beside them.
RECORDED, RATE = 8_000, 16_000
#: Recordings that are expanded side by side.
TOGETHER = 128
#: WAV format tags (fixed values of the format).
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")
#: Fixed values of IMA ADPCM: what a nibble's size does to the index.
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM (fixed values)."""
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
            130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
            1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
            7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        np.int32,
    )


STEPS = _steps()


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    size = ((((u & 15).astype(np.int32) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    part, segment = (a & 15).astype(np.int32) << 4, ((a >> 4) & 7).astype(np.int32)
    size = np.where(segment == 0, part + 8, (part + 264) << np.maximum(segment - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of n blocks of equal size (n x bytes, uint8): n x (1 + 2 * (bytes - 4)), int16."""
    n, size = blocks.shape
    head = blocks[:, :4].astype(np.int32)
    level = ((head[:, 0] | (head[:, 1] << 8)) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], 88)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = level
    for k, column in enumerate(np.ascontiguousarray(blocks[:, 4:].T)):
        for half, nibble in enumerate((column & 15, column >> 4)):
            step = STEPS[index]
            small = (nibble & 7).astype(np.int32)
            delta = (step >> 3) + np.where(small & 4, step, 0) + np.where(small & 2, step >> 1, 0) + np.where(small & 1, step >> 2, 0)
            level = np.clip(np.where(nibble & 8, level - delta, level + delta), -32768, 32767)
            index = np.clip(index + INDEX[small], 0, 88)
            out[1 + 2 * k + half] = level
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: str, rate: int = RECORDED, block: int = UNIT) -> bytes:
    """A mono container around the payload."""
    tag, adpcm = TAGS[codec], codec == "adpcm"
    samples = 1 + 2 * (block - 4)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * block // samples if adpcm else rate, block if adpcm else 1, 4 if adpcm else 8)
    fmt += struct.pack("<HH", 2, samples) if adpcm else struct.pack("<H", 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[str, int, int, bytes] | None:
    """Codec, rate, block size and payload; None if it isn't such a container."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16:
            if at + 8 + size > len(media):
                return None
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            found = next(((c, rate, block) for c, t in TAGS.items() if t == tag), None)
            if channels != 1 or not rate or (found and found[0] == "adpcm" and block <= 4):
                return None
        elif name == b"data" and found and at + 8 + size <= len(media):
            return (*found, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return None


def expand_all(items: list[tuple[str, int, bytes]]) -> list[np.ndarray]:
    """PCM of (codec, block size, payload)s; the ADPCM blocks of all items of one block size go together."""
    out: list[np.ndarray | None] = [None] * len(items)
    together: dict[int, list[int]] = {}
    for i, (codec, block, payload) in enumerate(items):
        if codec == "adpcm":
            together.setdefault(block, []).append(i)
        else:
            out[i] = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, np.uint8)]
    for block, which in together.items():
        raw = [items[i][2] + b"\0" * (-len(items[i][2]) % block) for i in which]
        pcm = adpcm_blocks(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, block))
        ends = np.cumsum([0, *(len(x) // block for x in raw)])
        for i, a, b in zip(which, ends, ends[1:], strict=False):
            out[i] = pcm[a:b].reshape(-1)
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample is held."""
    if not len(pcm) or rate == to:
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    place = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    i, part = place // to, place % to
    wide = pcm.astype(np.int64)
    return ((wide[i] * (to - part) + wide[np.minimum(i + 1, len(pcm) - 1)] * part) // to).astype(np.int16)


def plain(pcm: np.ndarray) -> bytes:
    """16-bit little-endian PCM."""
    return pcm.astype("<i2").tobytes()


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The means of n samples and those after them; the last sample is held."""
    wide = even.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:])) >> 1)[:n]


def packed(pcm: np.ndarray) -> bytes:
    """Any PCM as 16-bit numbers that a compressor shortens well: every other sample, then how far each of the rest is from the mean of its neighbours, modulo 2**16."""
    even, odd = pcm[::2], pcm[1::2]
    return plain(even) + plain((odd - _between(even, len(odd))).astype(np.int16))


def unpacked(stored: bytes) -> np.ndarray:
    """The PCM that packed() was given."""
    numbers = np.frombuffer(stored, "<i2")
    out = np.empty(len(numbers), np.int16)
    half = (len(numbers) + 1) // 2
    out[::2] = numbers[:half]
    out[1::2] = (numbers[half:] + _between(numbers[:half], len(numbers) - half)).astype(np.int16)
    return out


def decode_media(df: DataFrame, media: str = "media", to: int = RATE, form: Callable[[np.ndarray], bytes] = plain) -> DataFrame:
    """``df`` with codec, rate (``to``) and pcm (16-bit little-endian, or as ``form`` gives it) of the binary column ``media``."""
    kept = [c for c in df.columns if c not in ("codec", "rate", "pcm")]
    hidden = clean_name(*kept, stem="_media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                found = [parse_wav(x.as_py() or b"") for x in part.column(part.num_columns - 1)]
                pcm = expand_all([(c, b, p) for c, _, b, p in filter(None, found)])
                sound = iter([form(resample(x, r, to)) for x, (_, r, _, _) in zip(pcm, filter(None, found), strict=True)])
                columns = [pa.array([x[0] if x else None for x in found], pa.string()), pa.array([to if x else None for x in found], pa.int32()), pa.array([next(sound) if x else None for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], "codec", "rate", "pcm"])

    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{media}`").alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "codec string, rate int, pcm binary"])
    return source.mapInArrow(tidied(run), schema)


def feature(codec: str, pcm: np.ndarray, rate: int) -> str:
    """codec : samples : peak : mean square : sign changes : rate and crc32 of the PCM."""
    wide = pcm.astype(np.int32)
    changes = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    square = float(np.dot(pcm.astype(np.float64), pcm.astype(np.float64))) / max(len(pcm), 1)
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max(initial=0))}:{square:.3f}:{changes}:{rate}:{zlib.crc32(plain(pcm)):08x}"


def recorded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: texts' bytes as telephony audio, in 64-byte units.

    The codec goes by the number of units, so equal texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in windows(batch.column(1), lower=False):
                media, sizes = [], []
                for a, b in zip(w.offsets, w.offsets[1:], strict=False):
                    size = int(b - a)
                    payload = w.data[a:b].tobytes().ljust(max(UNIT, -(-size // UNIT) * UNIT), b"\0")
                    sizes.append(size)
                    media.append(wav(payload, CODECS[len(payload) // UNIT % len(CODECS)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: pa.Array, pcm: pa.Array, rate: pa.Array) -> pa.Array:
    """DIGESTS of stored recordings and their stored PCM (as packed() gives it)."""
    rows = []
    for m, p, r in zip(media, pcm, rate, strict=True):
        m, p = m.as_py(), p.as_py()
        codec, _, _, payload = parse_wav(m)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(codec, unpacked(p), r.as_py())))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])


def store_texts(docs: DataFrame, keep_media: bool = False, to: int = RATE) -> DataFrame:
    """doc_id, n_bytes, DIGESTS: texts' bytes are written as recordings with their PCM at ``to`` samples a second, and what is returned comes from reading those."""
    small_batches(docs.sparkSession)
    stored = written(decode_media(recorded(docs), to=to, form=packed), "media", "zstd")
    found = stored.select("doc_id", "n_bytes", "media", F.arrow_udf(read_back, DIGESTS)("media", "pcm", "rate").alias("found"))
    return found.select("doc_id", "n_bytes", "found.*", *(["media"] if keep_media else []))


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(documents(spark, sf_dir))
