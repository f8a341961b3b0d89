"""Thresholds, dataset names and settings from INI files with a fallback to the environment."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field, fields
from datetime import date


@dataclass(frozen=True)
class Thresholds:
    """Limits of plausibility; seconds, metres and g. Fixed values of the study."""

    max_session_s: int = 36_000
    max_daily_session_s: int = 10_800
    max_call_s: int = 43_200
    axis_limit_g: float = 20.0
    gravity: float = 9.81
    vigorous_g: float = 0.4
    max_norm_g: float = 20.0
    stay_s: int = 600
    earth_radius_m: float = 6_371_000.0
    night_from_hour: int = 22
    night_to_hour: int = 8
    max_distance_m: float = 2_000_000.0
    slot_s: int = 21_600
    day_s: int = 86_400
    max_percentage: float = 100.0
    min_days: int = 5


@dataclass(frozen=True)
class Settings:
    """Where things are. Each value may come from a file's section, else from DIURNA_<NAME>."""

    root: str = "data"
    catalogue: str = "sensing"
    decryption_key: str = ""
    run_date: str = field(default_factory=lambda: date.today().strftime("%Y%m%d"))


def load_settings(path: str | None = None, section: str = "diurna") -> Settings:
    parser = configparser.ConfigParser()
    if path:
        parser.read(path)
    found = {}
    for f in fields(Settings):
        value = parser.get(section, f.name, fallback=None) or os.environ.get(f"DIURNA_{f.name.upper()}")
        if value:
            found[f.name] = value
    return Settings(**found)


#: Names of all datasets, so that writers and readers agree.
DATASETS = (
    "location", "lookup_timezone", "events_screen_android", "events_screen_ios", "events_call_ios", "points_accelerometer_android",
    "points_accelerometer_ios", "daily_accelerometer_android", "daily_accelerometer_ios", "daily_calls_android", "daily_calls_ios",
    "daily_screen_android", "daily_screen_ios", "daily_gps", "daily_sleep", "merged_daily", "participant_features",
)


def dataset_path(settings: Settings, name: str) -> str:
    """Folder of a dataset for the run's date."""
    if name not in DATASETS:
        raise KeyError(name)
    return f"{settings.root}/{name}/run_date={settings.run_date}"
