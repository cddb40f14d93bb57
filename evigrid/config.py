"""Parameters: groups of named values with defaults, read from and written to YAML-like text, changed while running."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Uncertainty:
    w_semantic: float = 0.4
    w_spatial: float = 0.2
    w_observation: float = 0.25
    w_temporal: float = 0.15
    spatial_radius: float = 0.2
    min_neighbors: int = 3
    sigma_range: float = 0.5
    sigma_density: float = 0.3
    sigma_angle: float = 0.2

    def normalised(self) -> Uncertainty:
        """Weights that sum to 1; weights that sum to nothing stay."""
        names = [f.name for f in fields(self) if f.name.startswith("w_")]
        total = sum(getattr(self, n) for n in names)
        return replace(self, **{n: getattr(self, n) / total for n in names}) if total > 0 else self


@dataclass(frozen=True)
class Primitives:
    target_primitives: int = 128
    min_points_per_primitive: int = 5
    conflict_threshold: float = 0.3
    regularization: float = 0.001
    uncertainty_weight_lambda: float = 1.0
    use_incremental_updates: bool = True
    incremental_max_distance: float = 0.5
    full_rebuild_interval: int = 0
    num_classes: int = 37


@dataclass(frozen=True)
class Kernel:
    length_scale_min: float = 0.1
    length_scale_max: float = 0.5
    uncertainty_threshold: float = 0.7
    uncertainty_low: float = 0.3
    gamma: float = 2.0
    reachability_lambda: float = 1.0
    traversable_classes: tuple[int, ...] = (1, 19)


@dataclass(frozen=True)
class Map:
    frame_id: str = "map"
    resolution: float = 0.05
    origin_x: float = -10.0
    origin_y: float = -10.0
    origin_z: float = -0.5
    size_x: float = 20.0
    size_y: float = 20.0
    size_z: float = 3.0
    num_classes: int = 37
    log_odds_min: float = -10.0
    log_odds_max: float = 10.0


@dataclass(frozen=True)
class Navigation:
    costmap_height_min: float = 0.0
    costmap_height_max: float = 0.5
    inflation_radius: float = 0.3
    min_confidence: float = 0.3


@dataclass(frozen=True)
class Exploration:
    max_distance: float = 10.0
    min_info_gain: float = 0.1
    max_goals: int = 10
    sensor_range: float = 6.0
    sensor_fov_horizontal: float = 1.2
    sensor_fov_vertical: float = 0.9
    min_obstacle_distance: float = 0.5


@dataclass(frozen=True)
class Processing:
    map_publish_rate: float = 2.0
    costmap_publish_rate: float = 5.0
    downsample_factor: int = 2
    num_threads: int = 4
    use_async_processing: bool = True


@dataclass(frozen=True)
class Sensor:
    min_range: float = 0.1
    max_range: float = 6.0


@dataclass(frozen=True)
class Config:
    uncertainty: Uncertainty = field(default_factory=Uncertainty)
    primitives: Primitives = field(default_factory=Primitives)
    kernel: Kernel = field(default_factory=Kernel)
    map: Map = field(default_factory=Map)
    navigation: Navigation = field(default_factory=Navigation)
    exploration: Exploration = field(default_factory=Exploration)
    processing: Processing = field(default_factory=Processing)
    sensor: Sensor = field(default_factory=Sensor)


GROUPS = {f.name: f.default_factory for f in fields(Config)}


def _value(text: str, default):
    """text as a value of the default's type."""
    text = text.strip()
    if isinstance(default, bool):
        if text.lower() not in ("true", "false"):
            raise ValueError(f"neither true nor false: {text}")
        return text.lower() == "true"
    if isinstance(default, tuple):
        return tuple(int(x) for x in text.strip("[]").split(",") if x.strip())
    return text.strip("\"'") if isinstance(default, str) else type(default)(text)


def _text(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"[{', '.join(map(str, value))}]" if isinstance(value, tuple) else f'"{value}"' if isinstance(value, str) else str(value)


def save(config: Config) -> str:
    """A group a block, a value a line."""
    return "\n\n".join("\n".join([f"{group}:", *(f"  {k}: {_text(v)}" for k, v in asdict(getattr(config, group)).items())]) for group in GROUPS) + "\n"


def load(text: str) -> Config:
    """What save() writes, or a part of it: values that are missing keep their defaults, unknown ones are ignored, and the weights are normalised."""
    given: dict[str, dict[str, str]] = {}
    group = ""
    for line in text.splitlines():
        bare = line.split("#")[0].rstrip()
        name, colon, value = bare.strip().partition(":")
        if colon and not bare.startswith((" ", "\t")) and not value.strip():
            group = name
        elif colon:
            given.setdefault(group if bare.startswith((" ", "\t")) else "", {})[name] = value
    out = {}
    for name, make in GROUPS.items():
        default = make()
        own = {f.name: _value(given[name][f.name], getattr(default, f.name)) for f in fields(default) if f.name in given.get(name, {})}
        out[name] = replace(default, **own)
    config = Config(**out)
    return replace(config, uncertainty=config.uncertainty.normalised())


def from_parameters(parameters: dict[str, object], legacy: dict[str, str]) -> Config:
    """Values by `group/name`; legacy maps `group/name` to an older flat name, which wins where it is set."""
    config = Config()
    for group in GROUPS:
        own = getattr(config, group)
        values = {}
        for f in fields(own):
            path = f"{group}/{f.name}"
            found = parameters.get(legacy.get(path, ""), parameters.get(path))
            if found is not None:
                values[f.name] = _value(str(found), getattr(own, f.name)) if not isinstance(getattr(own, f.name), tuple) else tuple(found)
        config = replace(config, **{group: replace(own, **values)})
    return replace(config, uncertainty=config.uncertainty.normalised())


def update(config: Config, changes: dict[str, dict[str, object]], apply: set[str]) -> tuple[Config, list[str], list[str]]:
    """The config after changes of the groups to apply, and the names that took effect and that failed (unknown, or of a wrong kind)."""
    done, failed = [], []
    for group, values in changes.items():
        if group not in apply:
            continue
        for name, value in values.items():
            own = getattr(config, group, None)
            try:
                new = _value(_text(value), getattr(own, name))
            except (AttributeError, TypeError, ValueError):
                failed.append(f"{group}.{name}")
                continue
            config = replace(config, **{group: replace(own, **{name: new})})
            done.append(f"{group}.{name}")
    if "uncertainty" in apply:
        config = replace(config, uncertainty=config.uncertainty.normalised())
    return config, done, failed
