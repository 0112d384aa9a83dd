"""What a corpus is made of, and how settings files say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions.codes import CRF_LEVELS
from ..functions.light import SOURCE_FORMATS
from ..functions.tone import TONE_OPERATORS
from ..operators.pack import SHARD_BYTES


@dataclass(frozen=True)
class Draw:
    """``count`` members drawn by keyed hashes of ``seed``."""

    count: int
    seed: int = 1


@dataclass(frozen=True)
class Listing:
    """A CSV file that names videos in ``column``, where ``flag`` holds ``value``."""

    path: str
    column: str = "Video"
    flag: str | None = "ref"
    value: str = "1"


@dataclass(frozen=True)
class Choice:
    """Which videos and frames of a folder are taken."""

    listed: Listing | None = None
    only: tuple[str, ...] | None = None
    never: tuple[str, ...] = ()
    frames: int | None = None
    held_out: Draw | None = None


@dataclass(frozen=True)
class Experts:
    """Graded pictures that pair with a source's by position, ``offset`` frames later."""

    path: str
    offset: int = 0


@dataclass(frozen=True)
class Natives:
    """SDR pictures of the same names as a source's HDR pictures; all pairs, or a draw."""

    path: str
    drawn: Draw | None = None


@dataclass(frozen=True)
class Source:
    """A folder of HDR pictures, and at most one kind of given SDR pictures."""

    name: str
    path: str
    signal: str = "pq2020"
    split: str = "train"
    label: str | None = None
    choice: Choice = Choice()
    experts: Experts | None = None
    natives: Natives | None = None
    enabled: bool = True

    @property
    def dataset(self) -> str:
        return self.label or self.name


@dataclass
class Curation:
    """A corpus: its sources, its mastering peak and its degradation grid."""

    sources: list[Source]
    out_dir: str = "data/curated"
    peak_nits: float = 1000.0
    tmos: list[str] = field(default_factory=lambda: sorted(TONE_OPERATORS))
    crf_levels: list[int] = field(default_factory=lambda: list(CRF_LEVELS))
    shard_bytes: int = SHARD_BYTES

    def check(self) -> Curation:
        """Raise what the first broken rule says."""
        for found, said in RULES:
            wrong = sorted({str(x) for x in found(self)})
            if wrong:
                raise ValueError(f"{said}: {wrong}")
        return self


#: What must find nothing, and what to say if it does.
RULES: tuple[tuple[Callable[[Curation], list], str], ...] = (
    (lambda c: [s.signal for s in c.sources if s.signal not in SOURCE_FORMATS], "unknown source formats"),
    (lambda c: [s.name for s in c.sources if s.experts and s.experts.offset < 0], "frame offsets must not be negative"),
    (lambda c: [s.name for s in c.sources if s.experts and s.natives], "sources with both experts and native pairs"),
    (lambda c: [t for t in c.tmos if t not in TONE_OPERATORS], "unknown tone operators"),
    (lambda c: [t for t in c.tmos if c.tmos.count(t) > 1], "tone operators are named twice"),
)

# Names of the settings that existing YAML files have for a source, and what each of
# them fills here. "group.field" is a field of one of the classes above.
SOURCE_SETTINGS = {
    "name": "name",
    "path": "path",
    "enabled": "enabled",
    "format": "signal",
    "split": "split",
    "source_dataset": "label",
    "reference_csv": "listed.path",
    "reference_hash_column": "listed.column",
    "reference_filter_column": "listed.flag",
    "reference_filter_value": "listed.value",
    "include_video_hashes": "choice.only",
    "exclude_video_hashes": "choice.never",
    "max_frames_per_video": "choice.frames",
    "holdout_count": "held_out.count",
    "holdout_seed": "held_out.seed",
    "expert_sdr_path": "experts.path",
    "frame_offset": "experts.offset",
    "sdr_path": "natives.path",
    "max_pairs": "drawn.count",
    "pair_seed": "drawn.seed",
}
# Settings for video containers, which are not read here, and a label nothing uses.
WITHOUT_EFFECT = ("fps", "expert_fps", "category")
MODES = ("derived", "native_pairs")


def source(settings: dict) -> Source:
    """A source from the names of a settings file. A setting that would do nothing is an error."""
    settings = dict(settings)
    mode = settings.pop("mode", "derived")
    if mode not in MODES:
        raise ValueError(f"unknown source modes: {[mode]}")
    idle = sorted(set(settings) & set(WITHOUT_EFFECT))
    if idle:
        raise ValueError(f"settings without effect here: {idle}")
    unknown = sorted(set(settings) - set(SOURCE_SETTINGS))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    groups: dict[str, dict] = {}
    for name, value in settings.items():
        group, _, key = SOURCE_SETTINGS[name].rpartition(".")
        if value is not None or name == "reference_filter_column":
            groups.setdefault(group, {})[key] = tuple(value) if isinstance(value, list) else value

    def made(kind, name: str, needs: str, **more):
        given = groups.pop(name, {}) | {k: v for k, v in more.items() if v is not None}
        return kind(**given) if given.get(needs) else None

    drawn, held = made(Draw, "drawn", "count"), made(Draw, "held_out", "count")
    native = made(Natives, "natives", "path", drawn=drawn)
    if mode == "native_pairs" and native is None:
        raise ValueError(f"native-pair source {settings.get('name')} needs sdr_path")
    listed, experts = made(Listing, "listed", "path"), made(Experts, "experts", "path")
    if settings.get("frame_offset", 0) < 0:
        raise ValueError(f"frame offsets must not be negative: {[settings.get('name')]}")
    choice = Choice(**groups.pop("choice", {}), listed=listed, held_out=held)
    found = Source(**groups.pop("", {}), choice=choice, experts=experts)
    return replace(found, natives=native) if mode == "native_pairs" else found


def from_mapping(settings: dict) -> Curation:
    """Settings as read from YAML; keys that mean nothing here are an error."""
    unknown = sorted(set(settings) - set(Curation.__dataclass_fields__))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    sources = [source(entry) for entry in settings.get("sources", [])]
    return Curation(**{**settings, "sources": sources}).check()


def from_yaml(path: str) -> Curation:
    import yaml

    with open(path) as handle:
        return from_mapping(yaml.safe_load(handle))
