"""What the engine must know about a catalogue: the roles of its columns and its named conditions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Fixed values -----------------------------------------------------------------------------------
# Column names, flag names and conditions of the published catalogue.  They are data, and have to
# be spelled as its files and users spell them.

PIPELINE_COLUMN = "pipeline"
TARGET_ID = "sdss_id"
TARGET_FLAGS_COLUMN = "sdss5_target_flags"
TARGET_FLAG_BYTES = 57
SURVEY = "sdss5"
SURVEY_ONLY = "sdss5 only"
TEXT_IDENTIFIER = "sdss4_apogee"

QUICK_FLAGS = {
    "sdss5 only": "release == 'sdss5'",
    "snr > 50": "snr >= 50",
    "purely non-flagged": "result_flags == 0",
    "no bad flags": "flag_bad == 0",
    "gmag < 17": "g_mag <= 17",
}

IDENTIFIER_COLUMNS = {
    "gaia_dr3": "gaia_dr3_source_id",
    "gaia_dr2": "gaia_dr2_source_id",
    "sdss5": "sdss_id",
    "sdss4_apogee": "sdss4_apogee_id",
    "tic_v8": "tic_v8_id",
}

DEFAULT_DATASETS = {"star": "mwmlite", "visit": "thepayne"}
DATASET_ALIASES = {"best": "mwmlite"}
DEFAULT_RELEASE = "dr19"

WARNING_FREE = "zwarning_flags == 0"
WARNING_ONLY = "zwarning_flags != 0"
# End of fixed values ----------------------------------------------------------------------------


@dataclass(frozen=True)
class CatalogProfile:
    """Column roles and named conditions of one catalogue.

    ``flag_overrides`` maps a dataset to the flags that differ there: another condition, or ``None``
    when the flag does not apply to the dataset and is skipped. ``ordered_identifiers`` are those in whose order the
    catalogue is stored.
    """

    pipeline: str = PIPELINE_COLUMN
    row_key: tuple[str, ...] = (TARGET_ID,)
    target_flags: str = TARGET_FLAGS_COLUMN
    target_bytes: int = TARGET_FLAG_BYTES
    quick_flags: Mapping[str, str] = field(default_factory=lambda: dict(QUICK_FLAGS))
    flag_overrides: Mapping[str, Mapping[str, str | None]] = field(
        default_factory=lambda: {
            "mwmlite": {"purely non-flagged": None},
            "spall": {"purely non-flagged": WARNING_FREE},
            "lineforest": {"purely non-flagged": WARNING_FREE},
        }
    )
    default_flags: tuple[str, ...] = ("purely non-flagged",)
    identifiers: Mapping[str, str] = field(default_factory=lambda: dict(IDENTIFIER_COLUMNS))
    default_identifier: str = "gaia_dr3"
    refused_identifiers: frozenset[tuple[str, str]] = frozenset({("tic_v8", "spall")})
    ordered_identifiers: frozenset[str] = frozenset()
    default_datasets: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_DATASETS))
    dataset_aliases: Mapping[str, str] = field(default_factory=lambda: dict(DATASET_ALIASES))
    default_x: str = "ra"
    default_y: str = "dec"
    default_color: str = "plx"
    default_statistics: tuple[str, ...] = ("g_mag", "snr")
    default_targets: tuple[str, ...] = (TARGET_ID, "gaia_dr3_source_id")

    def with_warning_rows(self) -> CatalogProfile:
        """The older reading of the flag on the two warning datasets: it keeps rows *with* a warning."""
        older = dict(self.flag_overrides)
        for dataset in ("spall", "lineforest"):
            older[dataset] = {"purely non-flagged": WARNING_ONLY}
        return replace(self, flag_overrides=older)

    def default_dataset(self, datatype: str) -> str:
        return self.default_datasets.get(datatype, self.default_datasets["star"])

    def dataset(self, name: str) -> str:
        """The present name of a dataset that users may call by an older one."""
        return self.dataset_aliases.get(name, name)
