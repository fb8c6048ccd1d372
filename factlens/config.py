"""Run configuration, as passed to the operators (the reference's flags)."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: priming formats by flag value and their short names in run paths
PRIMING_NAMES = {"nl": "nl", "{} -> {}": "rarr", "{} => {}": "Rarr", "({}; {})": "par"}


@dataclass(frozen=True)
class RunConfig:
    data: str = "TREx"
    model: str = "bert-base-cased"
    num_predictions: int = 20
    num_priming_examples: int = 0
    priming_type: str = "nl"
    use_close_examples: bool = False
    use_common_vocab: bool = True
    random_seed: int = 0

    def __post_init__(self):
        if self.data not in ("TREx", "ConceptNet", "Google_RE", "BATS"):
            raise ValueError(f"unknown dataset {self.data!r}")
        if self.priming_type not in PRIMING_NAMES:
            raise ValueError(f"unknown priming type {self.priming_type!r}")
        if self.data == "BATS" and self.priming_type == "nl":
            raise ValueError("BATS has no natural-language templates; use a symbolic priming format")

    @property
    def run_path(self) -> str:
        """<data>/<model>/pe-<k>_nl-<name>_ce-<bool>_rs-<seed>.csv"""
        return (f"{self.data}/{self.model}/pe-{self.num_priming_examples}_nl-{PRIMING_NAMES[self.priming_type]}"
                f"_ce-{self.use_close_examples}_rs-{self.random_seed}.csv")
