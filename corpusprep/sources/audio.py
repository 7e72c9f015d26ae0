"""Read 16-bit PCM WAV files in bulk (``binaryFile`` + a pandas UDF that
decodes with the standard ``wave`` module and numpy), and a writer used by
tests and the registered query to lay clips down as WAV files.

Only PCM WAV is decoded; compressed codecs are out of scope.
"""

from __future__ import annotations

import io
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.session import arrow_fs

AUDIO_TYPE = T.StructType([
    T.StructField("array", T.ArrayType(T.FloatType()), True),
    T.StructField("sampling_rate", T.IntegerType(), True),
    T.StructField("channels", T.IntegerType(), True),
])


def pcm16(samples: np.ndarray) -> np.ndarray:
    """Float samples in [-1, 1] to int16 (round half up, clipped)."""
    q = np.floor(np.asarray(samples, np.float64) * 32767.0 + 0.5)
    return np.clip(q, -32768, 32767).astype("<i2")


def wav_bytes(samples, sampling_rate: int, channels: int = 1) -> bytes:
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sampling_rate)
        w.writeframes(pcm16(samples).tobytes())
    return buf.getvalue()


def _decode(content: bytes):
    with wave.open(io.BytesIO(content), "rb") as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM WAV is supported")
        ch, sr = w.getnchannels(), w.getframerate()
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768.0
    return {"array": x.tolist(), "sampling_rate": sr, "channels": ch}


@F.pandas_udf(AUDIO_TYPE)
def decode_wav(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_decode(b) for b in content])


def read_audio(spark: SparkSession, path_glob: str) -> DataFrame:
    """``(path, audio struct<array, sampling_rate, channels>)``; the array is
    interleaved when channels > 1 (frames x channels)."""
    raw = spark.read.format("binaryFile").load(path_glob)
    return raw.select("path", decode_wav("content").alias("audio"))


def write_wavs(df: DataFrame, out_dir: str, name_col: str, samples_col: str,
               sampling_rate: int, channels: int = 1) -> int:
    """Write one WAV per row (file name from ``name_col``) from the executors;
    returns the number of files."""
    def part(batches):
        fs, root = arrow_fs(out_dir)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            for name, samples in zip(pdf[name_col], pdf[samples_col]):
                final = f"{root.rstrip('/')}/{name}.wav"
                tmp = f"{final}.{uuid.uuid4().hex[:6]}.tmp"
                with fs.open_output_stream(tmp) as f:
                    f.write(wav_bytes(samples, sampling_rate, channels))
                fs.move(tmp, final)  # idempotent under task retries
            yield pd.DataFrame({"n": [len(pdf)]})

    written = df.select(name_col, samples_col).mapInPandas(part, "n long")
    return int(written.agg(F.sum("n")).first()[0] or 0)
