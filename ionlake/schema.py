"""Canonical schemas and errors of the imaging data model."""

from __future__ import annotations

from dataclasses import dataclass, field

PEAK = "struct<mz:double,intensity:double,fwhm:double,shape_r2:double,snr:double,prominence:double>"
SPECTRA = f"spectrum_id long, x int, y int, native_id string, sample_type string, mode string, mz array<double>, intensity array<double>, peaks array<{PEAK}>"
POINTS = "spectrum_id long, x int, y int, pos int, mz double, intensity double"
STATS = "SpectrumID long, TIC double, BPI double, BasePeakMZ double, NumPoints int, MinMZ double, MaxMZ double, Mode string"
CENTROID, PROFILE, UNKNOWN = "CENTROID", "PROFILE", "UNKNOWN"


class FileFormatError(ValueError):
    """A file lacks what its format requires."""


class SpectrumNotFoundError(KeyError):
    """No spectrum at that index or pixel."""


class InvalidSpectrumError(ValueError):
    """Arrays of unequal length, non-finite numbers or an m/z axis out of order."""


@dataclass
class InstrumentMetadata:
    """What a file's header says of the instrument; fields it doesn't name keep their defaults."""

    resolution: float | None = None
    acquisition_mode: str = UNKNOWN
    mz_axis_type: str = "unknown"
    calibration_status: str = "uncalibrated"
    instrument_model: str = "Unknown"
    mass_accuracy_ppm: float | None = None
    laser_settings: dict[str, float] = field(default_factory=dict)
    polarity: str = "unknown"
    vendor_steps: list[str] = field(default_factory=list)
