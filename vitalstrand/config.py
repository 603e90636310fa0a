"""Parameters and fixed values of a study."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from types import MappingProxyType

# Special token ids.
PAD, BOS, EOS, DAY_SEP, ENC_SEP, UNK = 0, 1, 2, 3, 4, 5
SPECIAL_TOKENS = {
    "<PAD>": PAD,
    "<BOS>": BOS,
    "<EOS>": EOS,
    "<DAY_SEP>": DAY_SEP,
    "<ENC_SEP>": ENC_SEP,
    "<UNK>": UNK,
}

# Inclusive id range reserved for each stream.
ID_RANGES = {
    "HR": (100, 109),
    "STEPS": (110, 119),
    "HRV": (120, 129),
    "SLEEP": (130, 159),
    "ECG": (160, 169),
    "WORKOUT": (170, 199),
    "DX10": (1000, 3999),
    "MED": (4000, 4999),
    "PX10": (5000, 5999),
    "LAB": (6000, 7999),
}
ID_SPACE = 8000

# Order in which equal timestamps are read inside a window.
STREAM_ORDER = {"HR": 0, "STEPS": 1, "HRV": 2, "EHR": 3}

# Visit concepts that count as an inpatient encounter.
INPATIENT_VISITS = (9201, 9203, 262)

# Condition statuses of a primary diagnosis (of an admission, in general, at discharge).
PRIMARY_STATUSES = (32901, 32902, 32903)

# Endpoint code sets (ICD-10-CM prefixes).
CARDIO_ENDPOINTS = {
    "afib": ["I48"],
    "mi": ["I21", "I22"],
    "hf": ["I50"],
    "cardio_mortality": [],
}

# LOINC prefixes of the cardiac laboratory panel.
CARDIAC_LOINC = (
    "10839", "30934", "2160-0", "2823-3", "2951-2",
    "33762", "33747", "6598-7", "33914",
)

# Catalogue of phone sample kinds and their class.
SAMPLE_KINDS = {
    "heartRate": "quantity",
    "heartRateVariabilitySDNN": "quantity",
    "restingHeartRate": "quantity",
    "walkingHeartRateAverage": "quantity",
    "oxygenSaturation": "quantity",
    "respiratoryRate": "quantity",
    "bodyTemperature": "quantity",
    "stepCount": "quantity",
    "activeEnergyBurned": "quantity",
    "appleExerciseTime": "quantity",
    "vo2Max": "quantity",
    "bloodPressureSystolic": "quantity",
    "bloodPressureDiastolic": "quantity",
    "bodyMass": "quantity",
    "height": "quantity",
    "sleepAnalysis": "category",
    "mindfulSession": "category",
    "electrocardiogram": "ecg",
    "workout": "workout",
    "allergyRecord": "clinical",
    "conditionRecord": "clinical",
    "immunizationRecord": "clinical",
    "labResultRecord": "clinical",
    "medicationRecord": "clinical",
    "procedureRecord": "clinical",
    "vitalSignRecord": "clinical",
}

# Audit, calibration and parity gates.
AUDIT_MAX_AUROC = 0.55
AUDIT_MAX_P95_DIFF = 0.02
CALIBRATION_GAP = 0.15
PARITY_TOLERANCE = 0.05

# Upper bounds of the risk bands.
RISK_BANDS = ((0.2, "low"), (0.5, "moderate"), (0.75, "elevated"))
RISK_BAND_TOP = "high"

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class StudyParams:
    """Knobs of one study; the defaults are the reference protocol."""

    min_span_days: int = 180
    min_age: int | None = 40
    window_days: int = 30
    lookahead_days: int = 30
    hr_bin_minutes: int = 5
    max_len: int = 4096
    stride_days: MappingProxyType = field(
        default_factory=lambda: MappingProxyType({"train": 14, "val": 31, "test": 31})
    )
    test_percent: int = 15
    val_percent: int = 15
    split_seed: int = 20260606
    reference_seed: int = 42
    #: None: every training person, every bin. A number draws a seeded sample of that size.
    reference_persons: int | None = None
    reference_rows: int | None = None
    pool_hours: bool = True
    calendar_positions: bool = False
    incident_only: bool = False
    shard_rows: int = 5000

    def with_(self, **changes) -> "StudyParams":
        return replace(self, **changes)


def uniform_stride(days: int) -> MappingProxyType:
    return MappingProxyType(dict.fromkeys(SPLITS, days))
