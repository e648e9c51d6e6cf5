"""Source schemas, header eras, aliases and default parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

@dataclass(frozen=True)
class Era:
    """Half-open range of editions sharing one header: target column -> (source column, factor)."""

    first: float
    before: float
    columns: dict[str, tuple[str, float]] = field(hash=False)


# ---- Fixed values: source schemas and header eras of the published lists ------------------------
# CPU sheet: ten positional columns, the last one is an artefact of a trailing comma.
CPU_SPEC_SCHEMA = (
    "processor string, manufacturer string, family string, model string, cores string, "
    "base_clock_speed string, tdp double, num_cores int, source string, blank string"
)
GPU_SPEC_SCHEMA = (
    "gpu_model string, gpu_tdp double, n_shaders int, n_sm int, second_gpu_tdp double, "
    "second_n_shaders int, second_n_sm int, notes string"
)
# Header spelling differs between files but the column order does not; the last column may be absent.
ZONE_INTENSITY_SCHEMA = (
    "reading_time string, country string, zone_name string, zone_key string, direct double, "
    "life_cycle double, low_carbon_pct double, renewable_pct double, data_source string"
)
ZONE_LIST_SCHEMA = "country string, zone_key string, note string"
LONG_INTENSITY_SCHEMA = (
    "area string, country_code string, date string, area_type string, continent string, "
    "category string, subcategory string, variable string, unit string, value double"
)

PERFORMANCE_ERAS = (
    Era(1993.0, 2008.5, {"cores": ("Processors", 1), "rmax": ("RMax", 1), "rpeak": ("RPeak", 1)}),
    Era(2008.5, 2011.5, {"cores": ("Cores", 1), "rmax": ("RMax", 1), "rpeak": ("RPeak", 1)}),
    Era(2011.5, 2017.0, {"cores": ("Total Cores", 1), "rmax": ("Rmax", 1), "rpeak": ("Rpeak", 1)}),
    Era(2017.0, 2018.0, {"cores": ("Total Cores", 1), "rmax": ("Rmax", 1000), "rpeak": ("Rpeak", 1000)}),
    Era(
        2018.0,
        9999.0,
        {"cores": ("Total Cores", 1), "rmax": ("Rmax [TFlop/s]", 1000), "rpeak": ("Rpeak [TFlop/s]", 1000)},
    ),
)


def _efficiency_era(first, before, top_rank, rank, efficiency, eff_factor, power, tera, cores="Total Cores", early=False):
    speed = ("Rmax [TFlop/s]", 1000), ("Rpeak [TFlop/s]", 1000)
    if not tera:
        speed = (("RMax", 1), ("RPeak", 1)) if early else (("Rmax", 1), ("Rpeak", 1))
    return Era(
        first,
        before,
        {
            "cores": (cores, 1),
            "rmax": speed[0],
            "rpeak": speed[1],
            "top_rank": (top_rank, 1),
            "rank": (rank, 1),
            "gflops_per_watt": (efficiency, eff_factor),
            "power_kw": (power, 1),
        },
    )


EFFICIENCY_ERAS = (
    _efficiency_era(1993.0, 2008.5, "TOP500 Rank", "Rank", "Power Effeciency [GFlops/Watts]", 1, "Power", False, "Processors", True),
    _efficiency_era(2008.5, 2011.5, "TOP500 Rank", "Rank", "Power Effeciency [GFlops/Watts]", 1, "Power", False, "Cores", True),
    _efficiency_era(2011.5, 2014.0, "TOP500 Rank", "Rank", "Power Effeciency [GFlops/Watts]", 1, "Power", False),
    _efficiency_era(2014.0, 2014.5, "Top500_Rank", "green500_rank", "mflops_per_watt", 1e-3, "Power", False),
    _efficiency_era(2014.5, 2015.0, "Top500_Rank", "Green500_Rank", "Mflops/Watt", 1e-3, "Power", False),
    _efficiency_era(2015.0, 2016.0, "top500_rank", "green500_rank", "mflops_per_watt", 1e-3, "total_power", False),
    _efficiency_era(2016.0, 2016.5, "Top500_Rank", "Green500_Rank", "Mflops/Watt", 1e-3, "Power", False),
    _efficiency_era(2016.5, 2017.0, "Rank", "Green500_Rank", "Mflops/Watt", 1e-3, "Power", False),
    _efficiency_era(2017.0, 2020.0, "TOP500 Rank", "Rank", "Power Effeciency [GFlops/Watts]", 1, "Power (kW)", True),
    _efficiency_era(2020.0, 2022.0, "TOP500 Rank", "Rank", "Power Efficiency [GFlops/Watts]", 1, "Power (kW)", True),
    _efficiency_era(2022.0, 9999.0, "TOP500 Rank", "Rank", "Energy Efficiency [GFlops/Watts]", 1, "Power (kW)", True),
)

# Columns whose header never changed: target -> (source header, type).
PERFORMANCE_COLUMNS = {
    "rank": ("Rank", "int"),
    "site": ("Site", "string"),
    "manufacturer": ("Manufacturer", "string"),
    "computer": ("Computer", "string"),
    "country": ("Country", "string"),
    "year": ("Year", "int"),
    "nmax": ("Nmax", "double"),
    "nhalf": ("Nhalf", "double"),
    "processor": ("Processor", "string"),
    "system_family": ("System Family", "string"),
    "operating_system": ("Operating System", "string"),
    "architecture": ("Architecture", "string"),
    "segment": ("Segment", "string"),
    "interconnect_family": ("Interconnect Family", "string"),
    "interconnect": ("Interconnect", "string"),
    "continent": ("Continent", "string"),
    "name": ("Name", "string"),
    "accel_name": ("Accelerator/Co-Processor", "string"),
    "accel_cores": ("Accelerator/Co-Processor Cores", "double"),
}
EFFICIENCY_COLUMNS = {
    "computer": ("Computer", "string"),
    "year": ("Year", "int"),
    "country": ("Country", "string"),
    "name": ("Name", "string"),
    "site": ("Site", "string"),
    "accel_name": ("Accelerator/Co-Processor", "string"),
    "accel_cores": ("Accelerator/Co-Processor Cores", "double"),
}

# One spelling per country, matched on the whole value.
COUNTRY_ALIASES = {
    "Czech Republic": "Czechia",
    "Great Britain": "United Kingdom",
    "Korea, South": "South Korea",
    "Russian Federation (the)": "Russia",
    "Slovak Republic": "Slovakia",
    "USA": "United States of America",
    "United States": "United States of America",
}

PERFORMANCE_LISTING = "Top500"
EFFICIENCY_LISTING = "Green500"
LONG_INTENSITY_CATEGORY = "Power sector emissions"
LONG_INTENSITY_UNIT = "gCO2/kWh"
LONG_INTENSITY_AREA_TYPE = "Country"

# Column of each carbon-intensity provider, by its public name.
PROVIDER_COLUMNS = {"Electricity Maps": "intensity_a", "Ember": "intensity_b"}

LIST_LENGTH = 500
SPAN = (2012.0, 2024.5)
MAX_EDITION = 2024.5
FUZZY_HIT = 99.0
FUZZY_RELATIVE = 0.9
FUZZY_EXPONENT = 8
DEFAULT_TDP = 200.0
Z_THRESHOLD = 3.0
# -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ImpactParams:
    """What a user of the impact queries chooses; ``None`` means all."""

    alpha: float = 0.5
    tau: tuple[float, float] = (0.5, 0.8)
    time_after_drop: float = 5.0
    provider: str = "Electricity Maps"
    country: str | None = None
    segments: tuple[str, ...] | None = None
    listing: str | None = None
    span: tuple[float, float] = SPAN
    idle_scope: str = "chip"

    @property
    def tau_levels(self) -> tuple[float, float, float]:
        low, high = self.tau
        return (low, (low + high) / 2, high)

    @property
    def intensity_column(self) -> str:
        return PROVIDER_COLUMNS[self.provider]
