"""Loudness and spectral flatness of sample arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def rms_db(samples: Column) -> Column:
    """Loudness in dB full scale; an empty array is -120, silence stays finite."""
    energy = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rms = F.sqrt(energy / F.size(samples))
    return F.when(F.size(samples) == 0, -120.0).otherwise(20.0 * F.log10(F.greatest(rms, F.lit(FLOOR))))


def flatness_of(block: np.ndarray) -> np.ndarray:
    """Flatness of each row of a matrix of samples; 0 for silence and for fewer than 32 samples."""
    size = block.shape[1]
    if size < 32:
        return np.zeros(len(block))
    power = (np.abs(np.fft.rfft(block * np.hanning(size), axis=1)) ** 2)[:, 1:]
    silent = ~(power > 0).any(axis=1)
    power = np.maximum(power, FLOOR)
    ratio = np.exp(np.log(power).mean(axis=1)) / np.maximum(power.mean(axis=1), FLOOR)
    return np.where(silent, 0.0, np.clip(ratio, 0.0, 1.0))


def rms_db_of(energy: float, n: int) -> float:
    """``rms_db`` from a sum of squares."""
    return 20.0 * math.log10(max(math.sqrt(energy / n), FLOOR)) if n else -120.0


def spectral_flatness(waves: DataFrame, key: str, samples: str) -> DataFrame:
    """Geometric over arithmetic mean of the Hann-windowed power spectrum without DC.

    The transform of one array is one row's work, so rows stay where they are and whole
    Arrow batches go through numpy; arrays of equal length share one call.
    """
    def flatness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch))
            sizes = batch[samples].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                out[at] = flatness_of(np.stack([np.asarray(batch[samples].iloc[i], dtype=np.float64) for i in at]))
            yield pd.DataFrame({key: batch[key].to_numpy(), "flatness": out})

    kind = waves.schema[key].dataType.simpleString()
    return waves.select(key, samples).mapInPandas(flatness, f"{key} {kind}, flatness double")
