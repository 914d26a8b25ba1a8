"""The tests that a region passes before it is kept, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_failure(of: Callable[[str], Column], limit: Callable[[str], Column], sure: Column, shape_area: float, least_contrast: float) -> Column:
    """The first test that a region fails, or ``kept``.

    ``of`` gives the region's features, ``limit`` area_max, area_min, min_solidity, max_eccentricity and min_circularity. Regions that are
    ``sure`` or smaller than ``shape_area`` skip the shape tests. Contrast is how much darker than its surroundings a region is.
    """
    shaped = ~((of("area") < shape_area) | sure)
    contrast = (of("mean_bg") - of("mean_gray")) / F.nullif(of("mean_bg"), F.lit(0.0))
    return (
        F.when(of("area") > limit("area_max"), "area_too_large")
        .when(of("area") < F.when(sure, 1.0).otherwise(limit("area_min")), "area_too_small")
        .when(shaped & (of("solidity") < limit("min_solidity")), "low_solidity")
        .when(shaped & (of("eccentricity") > limit("max_eccentricity")), "eccentricity")
        .when(shaped & (of("circularity") < limit("min_circularity")), "low_circularity")
        .when((of("mean_bg") > 1) & (contrast < least_contrast), "weak_local_contrast")
        .otherwise("kept")
    )
