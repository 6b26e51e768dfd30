"""Vehicle and wear formulas as column expressions."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

G = 9.81
MIN_SPEED = 8.0
MAX_LATERAL_G = 7.0
CORNERS = ("FL", "FR", "RL", "RR")

#: Wear of each mode relative to the middle one; fixed values.
MODE_FACTOR = {"SOFT": 1.55, "MEDIUM": 1.00, "HARD": 0.68, "INTERMEDIATE": 1.20, "WET": 1.10}


@dataclass(frozen=True)
class Vehicle:
    """Masses, geometry and aerodynamics; fixed default values."""

    mass: float = 798.0
    fuel: float = 0.0
    front_share: float = 0.455
    cg_height: float = 0.28
    wheelbase: float = 3.60
    track_width: float = 2.00
    lift_area: float = 5.40
    air_density: float = 1.225

    @property
    def total_mass(self):
        return self.mass + self.fuel


def downforce(speed: Column, v: Vehicle) -> Column:
    return F.lit(0.5 * v.air_density * v.lift_area) * speed * speed


def corner_loads(speed: Column, a_long: Column, a_lat: Column, v: Vehicle) -> dict:
    """Vertical load per corner: weight and downforce, shifted by braking and cornering, never negative."""
    vertical = F.lit(v.total_mass * G) + downforce(speed, v)
    shift = F.lit(v.total_mass * v.cg_height / v.wheelbase) * a_long
    side = F.lit(v.total_mass * v.cg_height / v.track_width) * a_lat
    front = vertical * v.front_share - shift
    rear = vertical * (1.0 - v.front_share) + shift
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return {
        "FL": floor(front * 0.5 - side * 0.5), "FR": floor(front * 0.5 + side * 0.5),
        "RL": floor(rear * 0.5 - side * 0.5), "RR": floor(rear * 0.5 + side * 0.5),
    }


def frictional_power(load: Column, speed: Column, a_long: Column, a_lat: Column) -> Column:
    """Load times demanded acceleration in g times speed: a proxy that ranks, not a measurement."""
    return load * F.hypot(a_long, a_lat) / G * speed


def turn_magnitude(angle: Column) -> Column:
    """Heading change wrapped into 0..180 degrees."""
    a = F.pmod(F.abs(angle), F.lit(360.0))
    return F.least(a, 360.0 - a)


def temperature_multiplier(surface: Column, low=90.0, high=110.0, sensitivity=0.025) -> Column:
    """1 inside the working window, growing with the squared distance outside it, on both sides."""
    out = F.greatest(F.lit(0.0), F.lit(low) - surface, surface - F.lit(high))
    return 1.0 + F.lit(sensitivity) * out * out


def mode_factor(mode: Column) -> Column:
    factors = F.create_map(*[F.lit(v) for kv in MODE_FACTOR.items() for v in kv])
    return F.coalesce(F.try_element_at(factors, F.upper(mode)), F.lit(1.0))


def energy_wear_rate(power: Column, surface: Column, mode: Column, reference=1.0e-8) -> Column:
    """Wear per second from frictional power, temperature and mode."""
    return F.lit(reference) * mode_factor(mode) * temperature_multiplier(surface) * F.greatest(power, F.lit(0.0))


def archard_wear(force: Column, distance: Column, hardness=1.0, coefficient=1.0e-8) -> Column:
    """Aggregate: worn volume from load and sliding distance, blind to temperature."""
    return F.lit(coefficient) * F.sum(force * distance) / max(hardness, 1e-9)


def cliff_loss(rate: Column, age: Column, cliff: Column, severity=0.004) -> Column:
    """Cumulative loss: linear in age, quadratic past the cliff."""
    past = F.greatest(age - cliff, F.lit(0.0))
    return rate * age + F.lit(severity) * past * past


def resample(values: Column, n: int) -> Column:
    """An array stretched or shrunk to n points by linear interpolation over its index."""
    size = F.size(values)
    spot = lambda i: i.cast("double") * (size - 1) / F.lit(max(n - 1, 1))

    def at(i):
        lo = F.floor(spot(i)).cast("int")
        frac = spot(i) - F.floor(spot(i))
        low = F.element_at(values, lo + 1)
        high = F.element_at(values, F.least(lo + 2, size))
        return low + frac * (high - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)
