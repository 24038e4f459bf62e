"""What lowering may do: modes, switches and bounds, frozen and only ever tightened."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

MODES = ("off", "observe", "auto")
#: Patterns proven one by one; each has its own switch.
QUALIFIED = ("links", "copyright", "email", "sentences", "language_id")


@dataclass(frozen=True)
class Policy:
    """``off``: plain UDFs; ``observe``: plan and report, run the UDF; ``auto``: run what is proven."""

    mode: str = "auto"
    disabled: bool = False
    qualified: frozenset = frozenset(QUALIFIED)
    max_nodes: int = 2_000
    max_depth: int = 8
    max_table: int = 256
    dictionary_capacity: int = 16_384
    regions: bool = True  # one opaque call may stay Python inside a lowered function

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r}")
        if not 1 <= self.dictionary_capacity <= 65_536:
            raise ValueError("dictionary_capacity")

    @property
    def effective(self) -> str:
        return "off" if self.disabled else self.mode

    def tighten(self, other: Policy) -> Policy:
        """The stricter of the two in every respect."""
        low = lambda name: min(getattr(self, name), getattr(other, name))
        return replace(
            self, mode=min(self.mode, other.mode, key=MODES.index), disabled=self.disabled or other.disabled, qualified=self.qualified & other.qualified,
            regions=self.regions and other.regions,
            **{n: low(n) for n in ("max_nodes", "max_depth", "max_table", "dictionary_capacity")},
        )


def from_session(spark: SparkSession | None, base: Policy = Policy()) -> Policy:  # noqa: B008
    """``base`` tightened by ``spark.lumenframe.*`` settings: mode, disabled, and one switch a qualified pattern."""
    if spark is None:
        return base
    get = lambda k, d: spark.conf.get(f"spark.lumenframe.{k}", d)
    on = frozenset(q for q in QUALIFIED if get(q, "true").lower() == "true")
    return base.tighten(replace(base, mode=get("mode", base.mode), disabled=get("disabled", "false").lower() == "true", qualified=on, regions=get("regions", "true").lower() == "true"))
