"""Finding unusual objects in collections of irregular time series, and preparing training corpora, on PySpark."""

from faintlight.curves import canonical, clean, main_band, valid_curves, validity
from faintlight.functions.features import CORE, core_features, fourier_features
from faintlight.operators.detect import control_forest, detect, detect_against_classes, detect_global, detect_per_class, detect_self
from faintlight.sources.registry import Source, available, register, tabular
from faintlight.sources.scans import read_curves

__all__ = [
    "CORE", "Source", "available", "canonical", "clean", "control_forest", "core_features", "detect", "detect_against_classes", "detect_global",
    "detect_per_class", "detect_self", "fourier_features", "main_band", "read_curves", "register", "tabular", "valid_curves", "validity",
]
