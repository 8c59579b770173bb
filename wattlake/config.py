"""Parameter records: fixed values of the domain, all in one place."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

LOCAL_ZONE = "Europe/Vienna"

# ---- fixed values: market conventions -------------------------------------
PEAK_START_HOUR = 8
PEAK_END_HOUR = 20
WINTER_MONTHS = (11, 12, 1, 2, 3)
HEATING_BASE_C = 18.0
COOLING_BASE_C = 22.0
SPIKE_EUR_MWH = 500.0
SOLAR_MONTHS = (4, 9)
SOLAR_HOURS = (10, 16)
COMPLETE_YEAR_MIN_HOURS = 8700
LOOKBACK_DAYS = 45
FORWARD_CALENDAR_MONTHS = 18
FRESHNESS_LIMIT_DAYS = 40
HISTOGRAM_BIN_EUR = 100_000.0
ROLLING_DAYS = 30

# ---- fixed values: code lists ----------------------------------------------
ZONE_BY_AREA_CODE = {
    "10YAT-APG------L": "AT",
    "10Y1001A1001A82H": "DE_LU",
}
MINUTES_BY_RESOLUTION = {"PT60M": 60, "PT30M": 30, "PT15M": 15}
PLANT_TYPE_NAMES = {
    "B01": "Biomass",
    "B02": "Fossil Brown coal/Lignite",
    "B03": "Fossil Coal-derived gas",
    "B04": "Fossil Gas",
    "B05": "Fossil Hard coal",
    "B06": "Fossil Oil",
    "B09": "Geothermal",
    "B10": "Hydro Pumped Storage",
    "B11": "Hydro Run-of-river and poundage",
    "B12": "Hydro Water Reservoir",
    "B13": "Marine",
    "B14": "Nuclear",
    "B15": "Other renewable",
    "B16": "Solar",
    "B17": "Waste",
    "B18": "Wind Offshore",
    "B19": "Wind Onshore",
    "B20": "Other",
}
PROVENANCE_TAGS = ("VERIFIED", "CALIBRATED", "SIMULATED")

# ---- fixed values: gate bounds ---------------------------------------------
PRICE_BOUNDS = (-500.0, 5000.0)
LOAD_HOURLY_BOUNDS = (3000.0, 13000.0)
LOAD_ANNUAL_BOUNDS = (6000.0, 9000.0)
JOIN_COVERAGE_MIN = 0.995
WEATHER_COVERAGE_MIN = 0.99
TEMPERATURE_BOUNDS = (-30.0, 42.0)
JULY_MEAN_BOUNDS = (15.0, 30.0)
JANUARY_MEAN_BOUNDS = (-10.0, 8.0)
INDEX_CRISIS_MULTIPLE = 3.0
INDEX_MAX_MONTHLY_CHANGE = 0.60
MAX_MISSING_HOURS = 24
DUPLICATE_BUDGET_PER_MONTH = 30
HYBRID_TOLERANCE = 0.005
REGIME_LABELS = ("calm", "elevated", "crisis")
CRISIS_MIN_SHARE = 0.70
CALM_MIN_SHARE = 0.60
ANNUAL_MEAN_BOUNDS = {
    2019: (25.0, 55.0),
    2020: (20.0, 50.0),
    2021: (80.0, 130.0),
    2022: (200.0, 320.0),
    2023: (70.0, 140.0),
    2024: (50.0, 110.0),
    2025: (40.0, 140.0),
}

# ---- fixed values: strategy dimension --------------------------------------
STRATEGY_DIM = (
    ("S1", "FULL_SPOT", "All volume at AT day-ahead hourly price"),
    ("S2", "OESPI_INDEXED", "Monthly price indexed to OESPI (base/peak blended)"),
    ("S3", "FIXED_ANNUAL", "Single annual price locked pre-year via OESPI proxy"),
    ("S4_30", "HYBRID_30", "30% hedged at S3 price + 70% spot"),
    ("S4_50", "HYBRID_50", "50% hedged + 50% spot"),
    ("S4_70", "HYBRID_70", "70% hedged + 30% spot"),
)


@dataclass(frozen=True)
class LoadProfile:
    """Shape of one reference consumer; all weights are relative."""

    name: str
    annual_mwh: float
    weekday: tuple[float, ...]
    weekend: tuple[float, ...]
    shutdown: tuple[float, ...]
    seasonal: tuple[float, ...]
    maintenance_factor: float
    shutdown_start: str
    shutdown_end: str

    def flattened(self, name: str = "flat_baseload") -> LoadProfile:
        """Same volume and calendar with every weight set to one."""
        ones = (1.0,) * 24
        return replace(
            self,
            name=name,
            weekday=ones,
            weekend=ones,
            shutdown=ones,
            seasonal=(1.0,) * 12,
            maintenance_factor=1.0,
        )


# The reference consumer.
MAIN_PROFILE = LoadProfile(
    name="main",
    annual_mwh=50000.0,
    weekday=(
        0.65, 0.65, 0.65, 0.65, 0.65, 0.75, 0.95, 1.00, 1.00, 1.00, 1.00, 1.00,
        0.95, 1.00, 1.00, 1.00, 1.00, 0.95, 0.85, 0.80, 0.75, 0.70, 0.65, 0.65,
    ),
    weekend=(
        0.30, 0.30, 0.30, 0.30, 0.30, 0.30, 0.32, 0.35, 0.35, 0.35, 0.35, 0.35,
        0.35, 0.35, 0.35, 0.35, 0.35, 0.33, 0.32, 0.30, 0.30, 0.30, 0.30, 0.30,
    ),
    shutdown=(0.18,) * 24,
    seasonal=(1.06, 1.05, 1.02, 1.00, 0.98, 0.96, 0.95, 0.95, 0.98, 1.01, 1.04, 1.05),
    maintenance_factor=0.60,
    shutdown_start="12-24",
    shutdown_end="01-01",
)
FLAT_PROFILE = MAIN_PROFILE.flattened()


@dataclass(frozen=True)
class StrategyConfig:
    """Tunables of the procurement strategies. The defaults, which published results rest on."""

    years: tuple[int, ...] = (2021, 2022, 2023, 2024, 2025)
    reference_year: int = 2019
    lock_months: tuple[int, ...] = (7, 8, 9, 10, 11, 12)
    premium: float = 5.0
    hybrid_ratios: tuple[float, ...] = (0.30, 0.50, 0.70)
    peak_available: bool = True
    premium_grid: tuple[float, ...] = (0.0, 10.0)
    lock_months_alternative: tuple[int, ...] = tuple(range(1, 13))
    horizon_months: int = 12
    n_paths: int = 2000
    seed: int = 42
    variants: tuple[str, ...] = field(default=("unconditional", "no_crisis"))

    @property
    def strategy_ids(self) -> tuple[str, ...]:
        return ("S1", "S2", "S3", *(hybrid_id(h) for h in self.hybrid_ratios))


def hybrid_id(ratio: float) -> str:
    """Identifier of the hybrid that hedges ``ratio`` of the volume."""
    return f"S4_{round(ratio * 100)}"
