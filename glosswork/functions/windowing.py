"""Context windows: decay weights and offset tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the decay forms and of the window directions.
DECAYS = ("linear", "harmonic", "exponential", "power", "none")
DIRECTIONS = ("symmetric", "forward", "backward")


def decay_weight(distance: Column, window: int, decay: str, alpha: float = 1.0, tokens_per_minute: float | None = None) -> Column:
    """Weight of a token at ``distance``: 1 at 0, 0 beyond ``window``, between them by the decay form.

    ``tokens_per_minute`` turns distances into minutes for the exponential
    and the power form; the other forms do not depend on the scale.
    """
    if decay not in DECAYS:
        raise ValueError(f"unknown decay {decay!r}; one of {DECAYS}")
    if tokens_per_minute is not None and tokens_per_minute <= 0:
        raise ValueError("tokens_per_minute must be positive")
    d = F.abs(distance).cast("double")
    scaled = d / tokens_per_minute if tokens_per_minute else d
    form = {
        "linear": (F.lit(float(window)) - d) / F.lit(float(window or 1)),
        "harmonic": F.lit(1.0) / d,
        "exponential": F.exp(F.lit(-float(alpha)) * scaled),
        "power": F.pow(F.lit(1.0) + scaled, F.lit(-float(alpha))),
        "none": F.lit(1.0),
    }[decay]
    return F.when(d == 0, 1.0).when(d > window, 0.0).otherwise(form)


def offsets(spark: SparkSession, window: int, decay: str = "none", alpha: float = 1.0, direction: str = "symmetric", include_target: bool = True, tokens_per_minute: float | None = None) -> DataFrame:
    """``(o, wt)``: the offsets of a window with their weights; offsets of weight zero are left out."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}; one of {DIRECTIONS}")
    if window < 0:
        raise ValueError("the window must not be negative")
    low = 0 if direction == "forward" else -window
    high = 0 if direction == "backward" else window
    o = spark.range(low, high + 1).select(F.col("id").cast("int").alias("o"))
    weighted = o.where((F.col("o") != 0) | F.lit(include_target)).withColumn("wt", decay_weight(F.col("o"), window, decay, alpha, tokens_per_minute))
    return weighted.where("wt > 0")


@dataclass(frozen=True)
class Window:
    """What a plan needs to know of an offset table."""

    offsets: tuple[tuple[int, float], ...]

    @property
    def total(self) -> float:
        return sum(w for _, w in self.offsets)

    @property
    def forward(self) -> int:
        return max(0, *(o for o, _ in self.offsets))

    @property
    def backward(self) -> int:
        return max(0, *(-o for o, _ in self.offsets))

    @property
    def trivial(self) -> bool:
        """A window of the position itself only, for which nothing needs to be averaged."""
        return [o for o, _ in self.offsets] == [0]

    def context(self, least: int = 0, block: int | None = None) -> int:
        """Positions that must precede one for its window to be whole."""
        need = max(least, self.backward)
        if block is not None and need + self.forward >= block:
            raise ValueError("context and window do not fit in a block")
        return need


def resolve(table: DataFrame) -> Window:
    """The window of an offset table; a window has at most a few hundred rows."""
    rows = tuple((r["o"], r["wt"]) for r in table.orderBy("o").collect())
    if not rows or sum(w for _, w in rows) <= 0:
        raise ValueError("the window is empty")
    return Window(rows)
