"""Fixed schemas and the model's configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "ints": T.ArrayType(T.IntegerType())}
_typed = lambda text: T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(", "))])
_strings = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names.split()])

#: Column names and order of the text formats (fixed values).
READS = T.StructType([*_strings("dataset_id cluster_id read_id read_sequence original_read_sequence read_quality").fields, T.StructField("design_length", T.IntegerType())])
TRUTH = _strings("cluster_id sequence")
TRUTH_KEYED = _strings("row_key dataset_id reference_sequence")
ORDER = _typed("cluster_id string, entropy_bits string, permutation ints")
PREDICTION = _typed("row_key string, dataset_id string, cluster_id string, legacy_prefix_alias int, stop_index long, consumed_reads long, total_reads long, reconstructed_sequence string, status string")
STOP = _typed("dataset string, round_id string, cluster_id string, stop_index long, total_reads long, unused_reads long, stopped_early int, output_status string")

LEAST_K, MOST_K, DEFAULT_K, MOST_LENGTH = 5, 15, 9, 1_000_000


@dataclass(frozen=True)
class Config:
    """Context size, beam width, and prior over lengths (``lognormal`` or ``median_band``).

    ``band``: steps around a cluster's weakest one that have the whole beam, all others keep one path; 0 for no band.
    """

    k: int = DEFAULT_K
    beam: int = 16
    prior: str = "lognormal"
    band: int = 0

    def __post_init__(self):
        if not (LEAST_K <= self.k <= MOST_K and self.beam in (4, 8, 16) and self.prior in ("lognormal", "median_band") and self.band >= 0):
            raise ValueError(f"unsupported configuration: {self}")

    @property
    def name(self) -> str:
        return f"kmc_k{self.k}_b{self.beam}_{self.prior}" + (f"_band{self.band}" if self.band else "")

    @classmethod
    def parse(cls, name: str) -> Config:
        m = re.fullmatch(r"kmc_k(\d+)_b(4|8|16)_(median_band|lognormal)(?:_band([1-9]\d*))?", name)
        if not m:
            raise ValueError(f"not a configuration name: {name!r}")
        return cls(int(m[1]), int(m[2]), m[3], int(m[4] or 0))


def parse_threads(text: str) -> list[int]:
    """A comma-separated list of positive numbers, each once, in order."""
    found = list(dict.fromkeys(int(x) for x in text.split(",") if x.strip()))
    if not found or min(found) < 1:
        raise ValueError(f"expected positive thread counts: {text!r}")
    return found
