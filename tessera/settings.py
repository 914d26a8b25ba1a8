"""Settings of the raster engine; every operator takes the section it needs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The defaults that results are compared under.


@dataclass(frozen=True)
class Tiling:
    size: int = 256
    overlap: int = 32
    max_black: float = 0.5
    min_std: float = 3.0
    min_mean: float = 10.0
    max_noise: float = 4.5  #: 0 is no noise gate

    @property
    def stride(self) -> int:
        return self.size - self.overlap


@dataclass(frozen=True)
class Tuning:
    """Ranges that a patch's own diagnostics choose from."""

    msr_blend: tuple = (0.3, 1.0)
    clahe_clip: tuple = (1.0, 2.0)
    clahe_blend: tuple = (0.3, 1.0)
    unsharp: tuple = (0.1, 0.5)
    bilateral_colour: tuple = (30, 60)
    bilateral_space: tuple = (30, 60)
    block_size: tuple = (11, 51)
    c_offset: tuple = (2, 15)
    open_side: tuple = (1, 3)
    close_side: tuple = (5, 11)
    area_min: tuple = (2, 8)
    area_max: int = 5000
    eccentricity: tuple = (0.80, 0.90)
    solidity: tuple = (0.45, 0.65)
    circularity: tuple = (0.25, 0.40)


@dataclass(frozen=True)
class Filters:
    chain: tuple = ("gray_world_white_balance", "multi_scale_retinex", "clahe_lab", "bilateral_denoise", "sediment_fade", "unsharp_mask")
    illumination_sigma: float = 51.0
    retinex_sigmas: tuple = (5, 20, 80)
    retinex_gain: float = 1.0
    fade_sigma: float = 15.0
    fade_strength: float = 0.6
    fade_threshold: float = 80.0
    unsharp_sigma: float = 2.0
    clahe_grid: int = 8


@dataclass(frozen=True)
class Labels:
    radii: tuple = (1, 2, 4, 8, 12, 16, 20)
    texture_sigma: float = 2.0
    texture_most: float = 18.0
    background_sigma: float = 30.0
    threshold: float = 4.0
    percentiles: tuple = (70, 90)
    dense_threshold: float = 3.0
    dense_share: float = 0.01
    least_contrast: float = 0.02
    bypass: float = 2.0
    split_distance: int = 0  #: least radius of the objects that large regions are split into; 0 splits none


@dataclass(frozen=True)
class Augmentation:
    """Chances and ranges of the training views."""

    flip: float = 0.5
    turn: float = 0.5
    affine: float = 0.5
    degrees: float = 15.0
    zoom: float = 0.1
    shift: float = 0.05
    elastic: float = 0.2
    elastic_alpha: float = 30.0
    elastic_sigma: float = 5.0
    light: float = 0.5
    brightness: float = 0.2
    contrast: float = 0.2
    blur: float = 0.2
    blur_sigma: float = 1.5
    noise: float = 0.2
    noise_std: float = 8.0
    paste: float = 0.5
    paste_most: int = 3
    paste_coverage: float = 2.0


@dataclass(frozen=True)
class Measures:
    meters_per_pixel: float = 0.005
    least_pixels: int = 20
    threshold: float = 0.5
    tolerance: float = 2.0
    sigma_scale: float = 0.125


@dataclass(frozen=True)
class Settings:
    tiling: Tiling = field(default_factory=Tiling)
    tuning: Tuning = field(default_factory=Tuning)
    filters: Filters = field(default_factory=Filters)
    labels: Labels = field(default_factory=Labels)
    augmentation: Augmentation = field(default_factory=Augmentation)
    measures: Measures = field(default_factory=Measures)
    seed: int = 42
    audit_size: int = 150

    def predictor(self) -> Settings:
        """The predictor's tiling: half overlap, and only all but black patches are passed over."""
        t = replace(self.tiling, overlap=self.tiling.size // 2, max_black=0.999, min_std=-1.0, min_mean=-1.0, max_noise=0.0)
        return replace(self, tiling=t)
