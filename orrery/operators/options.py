"""Options of the engine as dataclasses, with defaults and an environment that may override some."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PREFIXES = ("ORRERY_SEG_", "ORRERY_MAP_", "ORRERY_TRAIN_")


@dataclass
class Segmentation:
    threshold: float = 0.50
    min_votes: int = 2
    depth_weight: float = 0.25
    colour_weight: float = 0.10
    target_min: int = 5_000
    target_max: int = 120_000


@dataclass
class Mapper:
    min_inliers: int = 30
    min_inlier_ratio: float = 0.25
    max_rotation_error: float = 10.0
    max_reprojection_error: float = 1e-2
    min_triangulation_angle: float = 1.0
    track_pixels: float = 10.0
    skip_pruning: bool = True


@dataclass
class Training:
    iterations: int = 30_000
    position_start: float = 0.00016
    position_end: float = 0.0000016
    densify_gradient: float = 0.0002
    densify_from: int = 500
    densify_until: int = 15_000
    densify_every: int = 100
    opacity_reset_every: int = 3_000
    dssim_share: float = 0.2


@dataclass
class Options:
    segmentation: Segmentation = field(default_factory=Segmentation)
    mapper: Mapper = field(default_factory=Mapper)
    training: Training = field(default_factory=Training)

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] | None = None) -> Options:
        """ORRERY_SEG_, ORRERY_MAP_ and ORRERY_TRAIN_ with a field's name set that field; what cannot be read keeps its default."""
        env, out = os.environ if environment is None else environment, cls()
        for prefix, part in zip(PREFIXES, (out.segmentation, out.mapper, out.training), strict=True):
            for f in fields(part):
                text, old = env.get(prefix + f.name.upper()), getattr(part, f.name)
                if text is not None:
                    try:
                        setattr(part, f.name, text.strip().lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(text))
                    except ValueError:
                        continue
        return out


def resolved(settings: DataFrame, defaults: Options | None = None) -> DataFrame:
    """One row per job with all options, of settings (job, name, text): what is not set, or cannot be read, keeps its default; of several texts the largest counts."""
    base, columns = defaults or Options(), []
    for prefix, part in zip(PREFIXES, (base.segmentation, base.mapper, base.training), strict=True):
        for f in fields(part):
            old = getattr(part, f.name)
            text = F.trim(F.max(F.when(F.col("name") == prefix + f.name.upper(), F.col("text"))))
            if isinstance(old, bool):
                value = F.when(text.isNotNull(), F.lower(text).isin("1", "true", "yes"))
            else:
                value = text.try_cast("long" if isinstance(old, int) else "double")
            columns.append(F.coalesce(value, F.lit(old)).alias(f.name))
    return settings.groupBy("job").agg(*columns)


def chosen(name: Column, registry: Mapping[str, Callable[[Column], Column]], value: Column) -> Column:
    """The value under the registered function of that name; an unknown name is an error."""
    out = F.raise_error(F.concat(F.lit("not registered: "), F.coalesce(name, F.lit("null")))).cast("double")
    for key, f in registry.items():
        out = F.when(name == key, f(value).cast("double")).otherwise(out)
    return out
