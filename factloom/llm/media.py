"""Media columns: payloads as 8-bit WAV, read back by the wave module, with spectral-peak pair fingerprints.

``encode`` stores bytes as a mono 8-bit WAV file in a binary column; ``fingerprints`` reads such files, takes the
short-time Fourier transform over half-overlapping frames of 192 samples, keeps the strongest bin of each of five bands in every frame,
and pairs peaks of neighbouring frames: a pair is (time, band bin, next bin) packed in an integer, stored as two arrays,
``times`` and ``codes``, ordered by time.

Edge cases: a null or empty text is an empty payload, padded with bytes 255 to one unit of 576 like any other short
payload. Silence (constant samples) has peaks in the lowest bin of each band. Long texts are transformed in blocks of
frames, so memory is bounded by the text itself. Equal payloads give equal files and features; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are filled up to a multiple of this.
UNIT = 576
FRAME, HOP = 192, 96
PAD = b"\xff"
RATE = 8000
TAIL = 32
#: First bins of the bands in which a peak is sought, and the end of the last.
BANDS = (1, 6, 13, 25, 49, 97)
#: Frames ahead at which a peak is paired with the same and the next band's peaks.
AHEAD = (1,)
_BLOCK = 2048
#: Bytes of payload whose rows are handed over together.
_BATCH = 4 << 20
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(data: bytes) -> bytes:
    """``data`` filled up with bytes 255 to a positive multiple of the unit."""
    return data + PAD * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """Strongest bin of each band in each frame: an array of frames by bands."""
    frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(payload, np.uint8), FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS) - 1), np.int64)
    for at in range(0, len(frames), _BLOCK):
        part = (frames[at : at + _BLOCK].astype(np.float32) - 128) * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        # Rounded, so that the last bits of a sum never decide between two bins.
        power = np.rint(np.abs(spectrum)).astype(np.int32)
        for b in range(len(BANDS) - 1):
            out[at : at + _BLOCK, b] = BANDS[b] + power[:, BANDS[b] : BANDS[b + 1]].argmax(axis=1)
    return out


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pair fingerprints of ``peaks``: (times, codes)."""
    n, bands = found.shape
    times, codes = [], []
    for ahead in AHEAD:
        if n <= ahead:
            break
        for step in (0, 1):
            first = found[: n - ahead, : bands - step]
            then = found[ahead:, step:]
            codes.append(((first << 16) | (then << 8) | ahead).ravel())
            times.append(np.repeat(np.arange(n - ahead), bands - step))
    if not codes:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as UTF-8, padded and stored as a WAV file."""

    @F.pandas_udf("n_bytes long, media binary")
    def wav(text: pd.Series) -> pd.DataFrame:
        data = [(t or "").encode() for t in text]
        return pd.DataFrame({"n_bytes": [len(d) for d in data], "media": [to_wav(pad(d)) for d in data]})

    return docs.select(F.col(id_col), wav(F.col(text_col)).alias("stored")).select(id_col, "stored.n_bytes", "stored.media")


def fingerprints(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per file: sizes and checksums of file and payload as read back; its spectral-peak pairs as two arrays, ``times``
    and ``codes``; and ``feature``, the number of pairs and a hash over both arrays, by which equal fingerprints can be joined."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes"]
    schema = (
        f"`{id_col}` {stored.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for key, n, media in zip(batch["id"], batch["n_bytes"], batch["media"], strict=True):
                payload = from_wav(media)
                t, c = pairs(peaks(payload))
                short = hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).hexdigest()
                out.append((
                    key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]),
                    len(media), hashlib.sha256(media).hexdigest(), f"{len(c)}:{short}", t, c,
                ))
                held += len(payload)
                if held > _BATCH:
                    yield pd.DataFrame(out, columns=[id_col, *names])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=[id_col, *names])

    return stored.select(F.col(f"`{id_col}`").alias("id"), "n_bytes", "media").mapInPandas(rows, schema)

