"""Parameters of the siting pipeline, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    power_per_charger_kw: int = 150
    ev_range_km: float = 300.0
    usable_range: float = 0.80
    max_spacing_km: int = 150
    trunk_spacing_km: int = 60
    sufficient_mw: float = 5.0
    moderate_mw: float = 1.0
    substation_radius_km: float = 25.0
    status_without_substation: str = "Congested"
    charging_probability: float = 0.07
    charge_hours: float = 0.4
    operating_hours: float = 18.0
    min_chargers: int = 2
    max_chargers: int = 8
    buffer_m: float = 2000.0
    snap_km: float = 2.0
    fast_kw: tuple[float, float] = (50.0, 150.0)
    co2_combustion_t: int = 55
    co2_electric_t: int = 39
    #: Vehicles in the whole fleet, the denominator of the EV share; no source gives it.
    fleet_size: float = 25_000_000.0
    #: Road to multiplier in the peak months; all others 1.0.
    peak_multipliers: dict = field(default_factory=lambda: {"AP-7": 2.0, "A-7": 2.0, "A-8": 1.5, "AP-9": 1.5})
    peak_months: tuple[int, ...] = (7, 8)
    status_colors: dict = field(default_factory=lambda: {"Sufficient": "green", "Moderate": "orange", "Congested": "red"})

    @property
    def effective_range_km(self) -> float:
        return self.ev_range_km * self.usable_range


DEFAULT = Config()
