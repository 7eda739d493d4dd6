"""Readers of recordings: WAV files, framed captures, clip archives; and the WAV writer."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from utterloom.operators.codec import open_archive

RATE = 16_000
#: Fixed values of the wire format: what starts a capture, ends it, and starts an error line.
START, STOP, ERROR = b"\xa5\x5aREC1", b"\xa5\x5aEND1", b"\xa5\x5aERR1"
SECONDS = 60


def wav_samples(data: bytes) -> np.ndarray:
    """Samples of a mono 16-bit file at 16 kHz; another format is an error."""
    with wave.open(io.BytesIO(data)) as f:
        if (f.getnchannels(), f.getsampwidth(), f.getframerate()) != (1, 2, RATE):
            raise ValueError(f"{f.getnchannels()} channels, {8 * f.getsampwidth()} bits, {f.getframerate()} Hz")
        return np.frombuffer(f.readframes(f.getnframes()), "<i2")


def wav_bytes(samples) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(np.clip(np.asarray(samples), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def capture(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of a framed capture. What stands before the start is noise; a bad header, a short body, and an error line are errors."""
    if (e := data.find(ERROR)) >= 0 and (data.find(START) < 0 or e < data.find(START)):
        raise ValueError("device: " + data[e + len(ERROR) :].split(b"\n")[0].decode("utf-8", "replace").strip())
    at = data.find(START)
    if at < 0:
        raise ValueError("no start")
    at += len(START)
    if len(data) < at + 8:
        raise ValueError("no header")
    rate, count = struct.unpack_from("<II", data, at)
    if not rate or count > SECONDS * rate:
        raise ValueError(f"header of {rate} Hz and {count} samples")
    body = data[at + 8 : at + 8 + 2 * count]
    if len(body) < 2 * count:
        raise ValueError(f"{len(body) // 2} of {count} samples")
    if data[at + 8 + 2 * count :][: len(STOP)] != STOP:
        raise ValueError("no end")
    return rate, np.frombuffer(body, "<i2")


def parsed(files: DataFrame, parse) -> DataFrame:
    """path, rate, samples, error of binary files (path, content); a file that can't be parsed has an error and no samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rate, x = parse(bytes(content))
                    rows.append((path, rate, x.astype(np.int32), None))
                except (ValueError, EOFError, wave.Error, struct.error) as e:
                    rows.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<int>, error string")


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return parsed(files, lambda data: (RATE, wav_samples(data)))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.format("binaryFile").load(path), capture)


def write_wavs(utterances: DataFrame, path: str) -> None:
    """A WAV as a binary column of a table (utt_id, wav) under path, through Spark's writer, which survives lost executors."""
    kind = dict(utterances.dtypes)["utt_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"utt_id": b["utt_id"], "wav": [wav_bytes(x) for x in b["samples"]]})

    utterances.select("utt_id", "samples").mapInPandas(run, f"utt_id {kind}, wav binary").write.parquet(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, id, n_samples, blob of every clip of the archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, content in zip(b["path"], b["content"]):
                clips = open_archive(bytes(content))[1]
                yield pd.DataFrame([(at, key, n, blob) for key, blob, n in clips], columns=["path", "id", "n_samples", "blob"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, id string, n_samples int, blob binary")
