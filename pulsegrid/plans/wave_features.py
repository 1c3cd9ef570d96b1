"""Queries of whole-signal features and detectors; tests hold them against synthetic signals."""

from ..operators import wave_features as op
from . import query
from .images import pixels
from .kernels import RATE, signals, spectrum_sql

EMG_BANDS, SCG_BANDS = (1.0, 4.0, 8.0, 16.0, 24.0, 32.0), (0.0, 0.8, 5.0, 25.0, 32.0)


@query("ppg_multiscale_peaks")
def ppg_multiscale_peaks(spark, sf_dir):
    return op.pulse_votes(signals(spark, sf_dir), 16.0)


@query("ppg_respiration")
def ppg_respiration(spark, sf_dir):
    return op.pulse_respiration(signals(spark, sf_dir), 2.5)


@query("pcg_murmur_features")
def pcg_murmur_features(spark, sf_dir):
    return op.murmur_features(signals(spark, sf_dir), 16.0, (1.0, 2.0, 4.0, 5.5, 7.0))


@query("emg_spectrum", spectrum_sql(EMG_BANDS))
def emg_spectrum(spark, sf_dir):
    return op.spectrum_features(signals(spark, sf_dir), RATE, EMG_BANDS)


@query("scg_spectrum", spectrum_sql(SCG_BANDS))
def scg_spectrum(spark, sf_dir):
    return op.spectrum_features(signals(spark, sf_dir), RATE, SCG_BANDS)


@query("resp_features")
def resp_features(spark, sf_dir):
    return op.breathing_features(signals(spark, sf_dir), 2.0)


@query("image_fragment_trace")
def image_fragment_trace(spark, sf_dir):
    return op.fragment_trace(pixels(spark, sf_dir))
