"""Analysis settings, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Least spread that a z-score divides by.
STD_FLOOR = 1e-12

#: Regions by electrode number (fixed values).
REGIONS = {
    "mPFC": [8, 6, 9, 11],
    "motor": [7, 10, 5, 12, 3, 14],
    "somatomotor": [4, 13, 2, 15, 23, 24, 1, 16, 25, 26],
    "visual": [20, 21, 22, 27, 28, 29, 17, 18, 19, 30, 31, 32],
}
ALIASES = {"frontal": "mPFC", "ss": "somatomotor"}
#: Frequency bands in Hz (fixed values).
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}

CYCLES = ("fixed", "adaptive", "hybrid", "custom")
NORMALIZATIONS = ("channel_global", "baseline_cross_event", "baseline_per_event", "none")


@dataclass(frozen=True)
class AnalysisConfig:
    """One analysis: spectral grid, window, normalization and averaging choices.

    baseline_input: "zscored" normalizes each channel over its whole recording before the pre-event baseline is taken,
    "raw" feeds power itself.  session_weighting: "event" averages all events of a subject, "session" averages the
    means of its sessions.  session_montage: "static" uses a subject's own electrode row for all its sessions,
    "per_session" replaces it for the sessions named in montage_exceptions.
    """

    fs: float = 200.0
    freq_min: float = 3.0
    freq_max: float = 8.0
    n_freqs: int = 20
    window: float = 2.0
    baseline: tuple[float, float] = (-1.0, -0.5)
    response: tuple[float, float] = (-0.2, 0.0)
    theta: tuple[float, float] = (3.0, 7.0)
    cycles: str = "custom"
    cycles_fixed: float = 5.0
    cycles_factor: float = 1.0
    cycles_min: float = 6.0
    normalization: str = "baseline_cross_event"
    baseline_input: str = "zscored"
    session_weighting: str = "event"
    session_montage: str = "static"
    montage_exceptions: dict[tuple[str, str], str] = field(default_factory=dict)
    min_events: int = 3
    #: Frequencies themselves, in place of the geometric grid.
    freqs: tuple[float, ...] = ()

    def __post_init__(self):
        if self.freqs and not (min(self.freqs) > 0 and max(self.freqs) <= self.fs / 2):
            raise ValueError(f"frequencies {min(self.freqs)}-{max(self.freqs)} Hz at {self.fs} Hz")
        if not 0 < self.freq_min < self.freq_max <= self.fs / 2:
            raise ValueError(f"frequencies {self.freq_min}-{self.freq_max} Hz at {self.fs} Hz")
        if self.n_freqs < 1 or self.window <= 0:
            raise ValueError("n_freqs and window must be positive")
        if self.cycles not in CYCLES:
            raise ValueError(f"unknown cycles policy {self.cycles!r}")
        if self.normalization not in NORMALIZATIONS:
            raise ValueError(f"unknown normalization {self.normalization!r}")
        if self.baseline_input not in ("zscored", "raw") or self.session_weighting not in ("event", "session") or self.session_montage not in ("static", "per_session"):
            raise ValueError("unknown option")
        if self.normalization.startswith("baseline") and not -self.window / 2 <= self.baseline[0] < self.baseline[1] <= self.window / 2:
            raise ValueError(f"baseline {self.baseline} outside the window of {self.window} s")

    def grid(self) -> list[float]:
        """The frequencies, ascending."""
        if self.freqs:
            return sorted(self.freqs)
        ratio = (self.freq_max / self.freq_min) ** (1 / max(self.n_freqs - 1, 1))
        return [self.freq_min, *[self.freq_min * ratio**i for i in range(1, self.n_freqs - 1)], self.freq_max][: self.n_freqs]

    @property
    def half(self) -> float:
        return self.window / 2

    @property
    def samples(self) -> int:
        return int(self.window * self.fs)

    def summary(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}


def cycles_factor(method: str, factor: float = 1.0) -> float:
    """The factor of a cycles policy: 0.1 for fixed cycles, the set one otherwise."""
    return 0.1 if method == "fixed" else factor


def resolve_region(spec: str | list[int] | tuple[int, ...]) -> list[int]:
    """Electrode numbers of a region name, "8", "8,16" or a list; ValueError for what is unknown or outside 1-32."""
    if isinstance(spec, str):
        name = ALIASES.get(spec, spec)
        if "," in spec:
            numbers = [int(x) for x in spec.split(",")]
        elif name in REGIONS:
            numbers = list(REGIONS[name])
        elif spec.isdigit():
            numbers = [int(spec)]
        else:
            raise ValueError(f"unknown region {spec!r}; known: {sorted([*REGIONS, *ALIASES])}")
    elif isinstance(spec, (list, tuple)):
        numbers = [int(x) for x in spec]
    else:
        raise ValueError(f"a region is a name or a list, not {type(spec).__name__}")
    if bad := [x for x in numbers if not 1 <= x <= 32]:
        raise ValueError(f"electrodes {bad} outside 1-32")
    return numbers


def memory_estimate(n_freqs: int, n_samples: int, n_channels: int = 1, safety: float = 3.0) -> float:
    """Bytes that complex spectra of one recording need: a hint for partition sizing."""
    return n_freqs * n_samples * 16.0 * safety * n_channels
