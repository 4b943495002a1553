"""Media columns: a document's bytes as a WAV file, and time-coded fingerprints of its spectral peaks.

The bytes of a text, padded to whole frames, are stored without loss as 8-bit mono samples by the ``wave`` module, and read
back from the stored file. A short-time Fourier transform over the samples gives a spectrum for each hop; the strongest
frequencies of each spectrum are its peaks; each peak is paired with the weaker ones of its own hop and with the peaks of the
next few. A pair's code holds both frequencies and their distance in time, and goes with the hop where it begins, as landmark
fingerprints of audio do; so a text of a single frame has one, too.

Defined results: null and empty texts are one frame of padding; long texts are stored and transformed whole, the spectra in
steps of bounded size; equal texts give equal files, codes and features; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, lean, texts_of

FRAME = 576
HOP = 288
RATE = 8000
PEAKS = 2
FAN = 2
#: Spectra that are held at a time.
STEP = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str, frame: int = FRAME) -> bytes:
    """UTF-8, then bytes 255 up to a positive multiple of the frame."""
    data = text.encode("utf-8")
    return data + b"\xff" * (max(1, -(-len(data) // frame)) * frame - len(data))


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getnchannels() != 1 or r.getsampwidth() != 1:
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """The PEAKS strongest frequencies (bins, constant part left out) of the spectrum at each hop, strongest first."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), PEAKS), np.int32)
    for lo in range(0, len(frames), STEP):
        x = frames[lo : lo + STEP].astype(np.float32) - 128.0
        power = np.abs(np.fft.rfft(x * _WINDOW, axis=1))[:, 1:]
        for k in range(PEAKS):
            best = power.argmax(axis=1)
            out[lo : lo + STEP, k] = best + 1
            # The next peak has to lie apart from this one.
            for d in (-1, 0, 1):
                power[np.arange(len(power)), np.clip(best + d, 0, power.shape[1] - 1)] = -1
    return out


def landmarks(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (hops) and codes of all pairs of a peak with the weaker ones of its hop, and with those of the next FAN hops."""
    a, b = np.triu_indices(peaks.shape[1], 1)
    own = peaks[:, a].astype(np.int64) << 16 | peaks[:, b].astype(np.int64) << 4
    times, codes = [np.repeat(np.arange(len(peaks), dtype=np.int32), own.shape[1])], [own.ravel()]
    for gap in range(1, FAN + 1):
        if len(peaks) > gap:
            a, b = peaks[:-gap, :, None].astype(np.int64), peaks[gap:, None, :].astype(np.int64)
            code = (a << 16 | b << 4 | gap).reshape(len(peaks) - gap, -1)
            codes.append(code.ravel())
            times.append(np.repeat(np.arange(len(code), dtype=np.int32), code.shape[1]))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def media_columns(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with: n_bytes of the text; the WAV file ``media``; of the bytes read back from it
    payload_bytes, payload_sha256 and tail_crc32 (of the last 32); and the fingerprint arrays ``times`` and ``codes``."""
    arrow_batches(docs.sparkSession)
    added = "n_bytes long,media binary,payload_bytes long,payload_sha256 string,tail_crc32 long,times array<int>,codes array<long>"
    schema = docs.select(*keep).schema.simpleString()[7:-1] + "," + added
    names = [x.split()[0] for x in added.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for text in texts_of(batch.column("_llm_text")):
                payload = payload_of(text)
                media = write_wav(payload)
                back = read_wav(media)
                times, codes = landmarks(spectral_peaks(np.frombuffer(back, np.uint8)))
                n_bytes = len(text.encode("utf-8"))
                for to, value in zip(rows, (n_bytes, media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), times, codes), strict=True):
                    to.append(value)
            ends = pa.array(np.cumsum([0, *map(len, rows[5])]), pa.int32())
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.int64())]
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *rows[5]]))))
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *rows[6]]))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + arrays, names=[*keep, *names])

    return docs.select(*keep, F.col("text").alias("_llm_text")).mapInArrow(lean(run), schema)
