"""Settings from INI and YAML files as dataclasses."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields, replace

#: Spellings of true.
TRUE = frozenset({"TRUE", "True", "true", "t", "T"})


@dataclass(frozen=True)
class Structure:
    species: tuple[str, ...]
    radii: tuple[float, ...]
    repeat: tuple[int, int, int]
    start: int = 0
    stop: int = 1
    step: int = 1

    @property
    def weights(self) -> list[tuple[str, float]]:
        return list(zip(self.species, self.radii, strict=True))


@dataclass(frozen=True)
class Computation:
    """``thickness`` None: chosen from the data (0.1)."""

    n_threads: int = 4
    save_plots: bool = False
    kernel: bool = False
    image: bool = False
    cokernel: bool = False
    thickness: float | None = None
    verbose: bool = False


def _section(path: str, name: str) -> dict[str, str]:
    parser = configparser.ConfigParser()
    parser.read(path)
    if name not in parser:
        raise KeyError(f"{path} has no section {name}")
    return {k.upper(): v for k, v in parser[name].items()}


@dataclass(frozen=True)
class Job:
    """A section that tells what to run: one sample (SINGLE), a range of samples (MULTI), or a range of each file below a
    folder (BATCH), with a structure's section of another file."""

    mode: str
    path: str
    file_format: str
    configuration_file: str
    configuration_name: str
    start: int
    stop: int
    step: int
    ext: str | None = None


def job(path: str, name: str) -> Job:
    """SINGLE takes SAMPLE_TIME, the others SAMPLE_START, SAMPLE_END and SAMPLE_STEP; BATCH takes PARENT_DIR and FILE_EXT."""
    s = _section(path, name)
    mode = s.get("MODE", "SINGLE").strip().upper()
    if mode not in ("SINGLE", "MULTI", "BATCH"):
        raise ValueError(f"MODE is SINGLE, MULTI or BATCH, not {mode}")
    if mode == "SINGLE":
        span = (int(s["SAMPLE_TIME"]), int(s["SAMPLE_TIME"]) + 1, 1)
    else:
        span = (int(s["SAMPLE_START"]), int(s["SAMPLE_END"]), int(s.get("SAMPLE_STEP", 1)))
    batch = mode == "BATCH"
    return Job(mode, s["PARENT_DIR" if batch else "STRUCTURE_FILE"], s.get("FILE_FORMAT", "extxyz"), s["CONFIGURATION_FILE"], s["CONFIGURATION_NAME"], *span, s["FILE_EXT"] if batch else None)


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def structure(path: str, name: str) -> Structure:
    """ATOMS, RADII and REPEAT_X/Y/Z have to be there, the sample range has defaults."""
    s = _section(path, name)
    repeat = tuple(int(s[f"REPEAT_{a}"]) for a in "XYZ")
    return Structure(tuple(_list(s["ATOMS"])), tuple(map(float, _list(s["RADII"]))), repeat, int(s.get("SAMPLE_START", s.get("START", 0))), int(s.get("SAMPLE_END", s.get("END", 1))), int(s.get("SAMPLE_STEP", s.get("STEP", 1))))


def computation(path: str, name: str) -> Computation:
    s = _section(path, name)
    thick = s.get("THICKNESS", "Auto")
    flags = {k: s.get(k.upper(), "") in TRUE for k in ("save_plots", "kernel", "image", "cokernel", "verbose")}
    return Computation(int(s.get("N_THREADS", 4)), thickness=None if thick.strip().lower() == "auto" else float(thick), **flags)


@dataclass(frozen=True)
class Flow:
    """``fat``: how many cell diagonals apart void nodes of a slab still touch. ``stride``, ``verbose``: read for files' sake; they
    bound memory and print elsewhere and change no result. ``print_mean_stucture``, ``save_reeb_backbone`` and ``radii_figures``
    write the mean structure, the Reeb graphs and the radial distributions beside ``output_csv``."""

    trajectory_path: str = ""
    file_format: str = "lammps-dump-text"
    atom_type_map: dict[int, str] = field(default_factory=dict)
    backbone_atoms: tuple[str, ...] = ()
    flow_atoms: tuple[str, ...] = ()
    frame_start: int = 0
    frame_end: int | None = None
    frame_step: int = 1
    grid_spacing: float = 0.2
    fat: float = 1.0
    reeb_stride: int = 2
    stride: int = 20
    periodic: bool = True
    common_backbone: bool = True
    apply_frechet_mean: bool = False
    repeat: tuple[int, int, int] = (1, 1, 1)
    output_csv: str | None = None
    verbose: bool = False
    print_mean_stucture: bool = False
    save_reeb_backbone: bool = False
    radii_figures: bool = False


def flow(path: str, **overrides: object) -> Flow:
    """A YAML file; unknown keys are ignored, type numbers become integers, overrides count unless they are None."""
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    known = {x.name for x in fields(Flow)}
    values = {k: v for k, v in raw.items() if k in known}
    values["atom_type_map"] = {int(k): str(v) for k, v in (values.get("atom_type_map") or {}).items()}
    values |= {k: tuple(values[k]) for k in ("backbone_atoms", "flow_atoms", "repeat") if k in values}
    return replace(Flow(**values), **{k: v for k, v in overrides.items() if v is not None and k in known})


def type_map(text: str) -> dict[int, str]:
    """Lines ``1: Si`` as a map."""
    rows = (line.split(":") for line in text.splitlines() if ":" in line)
    return {int(k): v.strip() for k, v in rows}
