"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM blocks, resampled PCM, in WAV containers.

Companded samples expand by 256-entry tables; ADPCM decodes step by step within a block and across all
blocks of a batch at once. ``store`` puts payload bytes into a WAV file column beside the resampled PCM that
they expand to, ``telephony`` writes both as Parquet to the shared folder, and ``read`` takes the stored bytes
out again and measures them. PCM is stored without loss as its even samples and what their neighbours leave of
the odd ones, as lossless codecs do: four times the payload otherwise.

Defined results: null text counts as empty and gives one block of padding; equal texts give equal files
and features; an empty table gives an empty result; very long texts become long files, never cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, pieces, saved, text_bytes

#: Bytes of an ADPCM block: 4 of state and 572 of nibbles; payloads are multiples of it.
BLOCK = 576
RATE, RESAMPLED = 8000, 16000
#: Bytes of payload that a worker handles at a time; a longer text is handled alone.
STEP_BYTES = 1 << 19

# Fixed values of the IMA ADPCM format: how the step index moves.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# Fixed values of the IMA ADPCM format: the 89 step sizes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of each block (rows of BLOCK bytes: predictor as little-endian int16, step index, 0, then nibbles, low first)."""
    n = len(blocks)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    for j, column in enumerate(np.ascontiguousarray(blocks[:, 4:].T)):
        for k, nibble in enumerate((column & 15, column >> 4)):
            step, magnitude = STEPS[index], (nibble & 7).astype(np.int32)
            change = ((2 * magnitude + 1) * step) >> 3
            value += np.where(nibble & 8, -change, change)
            np.clip(value, -32768, 32767, out=value)
            index += INDEX_MOVES[magnitude]
            np.clip(index, 0, len(STEPS) - 1, out=index)
            out[1 + 2 * j + k] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers: sample k stands at k * rate / to."""
    if rate == to or not len(pcm):
        return pcm
    x = np.append(pcm, pcm[-1:]).astype(np.int32)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        out[1::2] = (x[:-1] + x[1:]) >> 1
        return out
    where = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    at, part = where // to, (where % to).astype(np.int64)
    return ((x[at] * (to - part) + x[at + 1] * part) // to).astype(np.int16)


def wav(payload: bytes, tag: int = 7, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono WAV file; tag 1 is PCM, 6 A-law, 7 mu-law."""
    width = bits // 8
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * width, width, bits, 0)
    fact = struct.pack("<I", len(payload) // width)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<I", 4) + fact + b"data" + struct.pack("<I", len(payload) & 0xFFFFFFFF) + payload
    return b"RIFF" + struct.pack("<I", (len(chunks) + 4) & 0xFFFFFFFF) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, sample rate and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pad(data: bytes, block: int = BLOCK) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // block)) * block - len(data))


def _sound(payload: bytes, tag: int, rate: int) -> np.ndarray:
    """The samples of companded bytes, at RESAMPLED a second."""
    return resample((ALAW if tag == 6 else MULAW)[np.frombuffer(payload, np.uint8)], rate, RESAMPLED)


def shorten(sound: np.ndarray) -> bytes:
    """Samples as their number, the even ones, and what the mean of its neighbours leaves of each odd one."""
    even, odd = sound[0::2], sound[1::2]
    return struct.pack("<I", len(sound)) + even.astype("<i2").tobytes() + (odd - _between(even, len(odd))).astype("<i2").tobytes()


def lengthen(data: bytes) -> np.ndarray:
    """The samples that ``shorten`` was given."""
    n = struct.unpack_from("<I", data)[0]
    even = np.frombuffer(data, "<i2", (n + 1) // 2, 4)
    out = np.empty(n, np.int16)
    out[0::2] = even
    out[1::2] = np.frombuffer(data, "<i2", n // 2, 4 + 2 * len(even)) + _between(even, n // 2)
    return out


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The mean of each of the first ``n`` samples and the next one, as 16 bits that wrap."""
    x = even.astype(np.int32)
    return ((x + np.append(x[1:], x[-1:])) >> 1)[:n].astype(np.int16)


def _energy(x: np.ndarray) -> int:
    return int(np.einsum("i,i->", x, x, dtype=np.float64) / max(1, len(x)))


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media, pcm: each text's padded bytes as the samples of a mu-law WAV file, and the resampled sound of
    these, shortened."""

    def run(batches):
        for batch in pieces(batches, "bytes", STEP_BYTES):
            payloads = [pad(b) for b in batch.column(1).to_pylist()]
            sizes = np.diff(flat(batch.column(1))[1])
            files = [wav(p) for p in payloads]
            pcm = [shorten(_sound(p, 7, RATE)) for p in payloads]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(pcm, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "media", "pcm"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_bytes(text).alias("bytes")).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, media binary, pcm binary")


def read(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Take the payload out of each media file and measure it; the stored PCM must be the sound of that payload, which its CRC tells:
    the samples themselves stay where they are."""

    def run(batches):
        for batch in pieces(batches, "media", STEP_BYTES):
            media = batch.column(2).to_pylist()
            read_back = [unwav(m) for m in media]
            payloads = [p for _, _, p in read_back]
            adpcm = decode_adpcm(np.frombuffer(b"".join(p[: len(p) // BLOCK * BLOCK] for p in payloads), np.uint8).reshape(-1, BLOCK))
            rows, at = [], 0
            for (tag, rate, payload), file, stored in zip(read_back, media, batch.column(3).to_pylist(), strict=True):
                raw = np.frombuffer(payload, np.uint8)
                mu, a = MULAW[raw], ALAW[raw]
                blocks = adpcm[at : at + len(raw) // BLOCK]
                at += len(raw) // BLOCK
                sound = _sound(payload, tag, rate)
                if zlib.crc32(shorten(sound)) != stored:
                    raise ValueError("the stored PCM is not the sound of the stored payload")
                crossings = int(np.count_nonzero((mu[1:] < 0) != (mu[:-1] < 0)))
                feature = (
                    f"tag={tag};rate={rate};n={len(raw)};mulaw_power={_energy(mu)};crossings={crossings};alaw_power={_energy(a)};"
                    f"adpcm_blocks={len(blocks)};adpcm_crc={zlib.crc32(np.ascontiguousarray(blocks).tobytes())};pcm_rate={RESAMPLED};pcm_crc={zlib.crc32(sound.tobytes())}"
                )
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.select(key, "n_bytes", "media", F.crc32("pcm").alias("pcm_crc")).mapInArrow(run, schema)


def telephony(df: DataFrame) -> DataFrame:
    """Store every text's media and PCM in the shared folder, and read them back."""
    return read(saved(store(df), "telephony-media", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}))
