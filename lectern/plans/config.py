"""Run configurations: closed mappings checked field by field, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


class ConfigError(ValueError):
    pass


def exact(payload: dict, required: set, optional: set = frozenset(), at: str = "config") -> dict:
    """Refuses missing and unknown keys, naming them."""
    missing, unknown = required - payload.keys(), payload.keys() - required - optional
    if missing or unknown:
        raise ConfigError(f"{at}: missing {sorted(missing)}, unknown {sorted(unknown)}")
    return payload


@dataclass(frozen=True)
class DebateConfig:
    """CF1: two agents, four turns by known agents, two contributing turns, a tie-break agent."""

    agents: tuple
    turns: tuple
    contributing: tuple
    tiebreak: str

    def __post_init__(self):
        if len(self.agents) != 2 or len(set(self.agents)) != 2:
            raise ConfigError("debate: exactly two agents")
        if len(self.turns) != 4 or not {t for _, t in self.turns} <= set(self.agents):
            raise ConfigError("debate: exactly four turns of these agents")
        if len(self.contributing) != 2 or not set(self.contributing) <= {i for i, _ in self.turns}:
            raise ConfigError("debate: exactly two contributing turns")
        if self.tiebreak not in self.agents:
            raise ConfigError("debate: the tie-break agent is unknown")


@dataclass(frozen=True)
class SourceConfig:
    """CF3: a source of traces: datasets and, for turn windows alone, the window's sides."""

    name: str
    datasets: tuple
    context_scope: str
    turns_before: int | None = None
    turns_after: int | None = None

    def __post_init__(self):
        window = self.turns_before is not None and self.turns_after is not None
        if self.context_scope not in ("full_interview", "turn_window"):
            raise ConfigError(f"{self.name}: unknown context scope")
        if (self.context_scope == "turn_window") != window or (not window and (self.turns_before, self.turns_after) != (None, None)):
            raise ConfigError(f"{self.name}: a window needs both sides, a full interview has none")


def check_sources(sources: list[SourceConfig]) -> None:
    """CF3: names are unique and a dataset stands in one source."""
    names, sets = [s.name for s in sources], [d for s in sources for d in s.datasets]
    if len(set(names)) < len(names) or len(set(sets)) < len(sets):
        raise ConfigError("sources repeat a name or a dataset")


@dataclass(frozen=True)
class HoldoutConfig:
    """CF4: disjoint train and test datasets, with the records expected of each; a record has four pairs."""

    train: tuple
    test: tuple
    records: dict = field(default_factory=dict)

    def __post_init__(self):
        if set(self.train) & set(self.test):
            raise ConfigError("a dataset is in train and in test")
        if set(self.records) != {*self.train, *self.test}:
            raise ConfigError("expected records must name every dataset")

    def pairs(self) -> dict:
        return {k: 4 * v for k, v in self.records.items()}


@dataclass(frozen=True)
class SplitConfig:
    """CF5: split by groups that keep a transcript on one side."""

    test_fraction: float
    seed: int = 42
    group_fields: tuple = ("dataset", "transcript_id")

    def __post_init__(self):
        if not 0 < self.test_fraction < 1:
            raise ConfigError("test_fraction must lie between 0 and 1")
        if tuple(self.group_fields) != ("dataset", "transcript_id"):
            raise ConfigError("groups are (dataset, transcript_id)")


def from_mapping(kind, payload: dict):
    """A configuration of this kind from a mapping with exactly its fields."""
    names = {f.name for f in fields(kind)}
    needed = {f.name for f in fields(kind) if f.default is f.default_factory}
    exact(payload, needed, names - needed, kind.__name__)
    return kind(**{k: tuple(map(tuple, v)) if k == "turns" else tuple(v) if isinstance(v, list) else v for k, v in payload.items()})
