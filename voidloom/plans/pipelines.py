"""Whole analyses from structure files: persistence of a range of samples, and circular flow through a backbone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, wrap
from ..operators import diagrams as D
from ..operators import graph as R
from ..operators import grid as G
from ..operators import points as P
from ..operators import topology as T
from ..operators import trajectory as J
from ..operators.scan import numbered
from ..session import checkpoint
from ..sources import config, sinks, structures


def sample_points(spark: SparkSession, path: str, fmt: str, settings: config.Structure, ext: str | None = None) -> DataFrame:
    """sample, pid, species, x, y, z, w of the chosen frames: species kept, cells repeated, weights from radii.

    The sample is the frame's number; with ``ext`` all files of a folder are read in one plan, and samples are numbered by
    file and frame (``sample_names`` tells which is which).
    """
    atoms = structures.frames_of(spark, path, fmt, ext)
    atoms = atoms.where((F.col("frame_id") >= settings.start) & (F.col("frame_id") < settings.stop))
    atoms = P.keep_species(J.every_nth(atoms, settings.step, settings.start, frame="frame_id"), settings.species)
    if settings.repeat != (1, 1, 1):
        heads = _heads(spark, path, fmt, ext).select("file", "frame_id", "lattice")
        atoms = atoms.join(heads, ["file", "frame_id"])  # a row a frame
        for name, n in zip(("ia", "ib", "ic"), settings.repeat, strict=True):
            atoms = atoms.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        atoms = atoms.withColumns({a: F.col(a) + sum(F.col(i) * F.col("lattice")[3 * r + k] for r, i in enumerate(("ia", "ib", "ic"))) for k, a in enumerate(AXES)})
        image = (F.col("ia") * settings.repeat[1] + F.col("ib")) * settings.repeat[2] + F.col("ic")
    else:
        image = F.lit(0)

    order = Window.partitionBy("file", "frame_id").orderBy("image", "atom_id")
    atoms = atoms.withColumn("image", image).withColumn("pid", (F.row_number().over(order) - 1).cast("int"))
    if ext:
        atoms = atoms.join(sample_names(spark, path, fmt, settings, ext), ["file", "frame_id"])
    else:
        atoms = atoms.withColumn("sample", F.col("frame_id"))
    return P.weigh(atoms.select("sample", "pid", "species", *AXES), settings.weights)


def _heads(spark: SparkSession, path: str, fmt: str, ext: str | None) -> DataFrame:
    return structures.frames_of(spark, path, fmt, ext, headers=True)


def sample_names(spark: SparkSession, path: str, fmt: str, settings: config.Structure, ext: str) -> DataFrame:
    """sample, file, frame_id of the chosen frames of a folder's files."""
    heads = _heads(spark, path, fmt, ext).select("file", "frame_id").where((F.col("frame_id") >= settings.start) & (F.col("frame_id") < settings.stop))
    kept = J.every_nth(heads, settings.step, settings.start, frame="frame_id")
    return numbered(kept, ["file", "frame_id"], "sample").withColumn("sample", F.col("sample").cast("int"))


def persistent_homology(points: DataFrame, compute: config.Computation = config.Computation()) -> dict[str, DataFrame]:
    """simplices, diagrams (with kinds asked for), apf and cycles of each sample."""
    simplices = checkpoint(T.alpha_complex(points))
    plain = checkpoint(T.persistence(simplices))
    diagrams = plain.select("sample", F.lit("full").alias("kind"), "dim", "birth", "death", "birth_simplex", "death_simplex")
    kinds = [k for k in ("kernel", "image", "cokernel") if getattr(compute, k)]
    if kinds:
        slabs = P.auto_slab(points, compute.thickness or 0.1, ["sample"])
        diagrams = diagrams.unionByName(T.kernel_image_cokernel(T.in_subcomplex(simplices, slabs)).where(F.col("kind").isin(kinds)))
    curves = D.apf(diagrams.where("dim > 0"), ["sample", "kind", "dim"], ["birth", "birth_simplex"])
    return {"simplices": simplices, "diagrams": diagrams, "apf": curves, "cycles": T.representative_cycles(plain, simplices)}


def nearest_distances(atoms: DataFrame, mobile: DataFrame, box: tuple[float, float, float], reach: float = 6.0) -> DataFrame:
    """atom, radius: minimum-image distance of each atom to the nearest mobile one. The reach doubles for the atoms that
    are still without one, up to the largest distance in the box."""
    farthest = sum(n * n for n in box) ** 0.5 / 2 * (1 + 1e-9)
    left, found = atoms.select("atom", *AXES), None
    while True:
        near = P.pairs_within(mobile.select(*AXES), left, reach, box)
        least = checkpoint(near.groupBy(F.col("b_atom").alias("atom")).agg(F.min("d").alias("radius")))
        found = least if found is None else found.unionByName(least)
        left = checkpoint(left.join(least, "atom", "left_anti"))
        if reach >= farthest or left.isEmpty():
            return found
        reach = min(2 * reach, farthest)


@dataclass(frozen=True)
class Backbone:
    """What a flow starts from: balls (bid, species, x, y, z, radius), the mobile atoms moved back by the backbone's
    displacement (atom, frame, x, y, z), and the radial distributions that gave the radii (None without ``common_backbone``)."""

    balls: DataFrame
    ions: DataFrame
    rdf: DataFrame | None


def backbone_of(frames: DataFrame, settings: config.Flow, box: tuple[float, float, float]) -> Backbone:
    """The mean backbone: unwrapped means over all frames (circular means of every ``reeb_stride``-th) and, for each species, the
    onset of the radial distribution of its distances to the mobile atoms of every ``reeb_stride``-th frame, or without
    ``common_backbone`` each atom's own least distance. Every backbone atom is kept; a species without a mobile atom within 6,
    or a trajectory without mobile atoms, raises. frames: frame, atom, species, x, y, z."""
    whole = frames.where(F.col("species").isin(list(settings.backbone_atoms)))
    kept = J.every_nth(frames, settings.reeb_stride)
    backbone = kept.where(F.col("species").isin(list(settings.backbone_atoms)))
    if settings.apply_frechet_mean:
        means = J.frechet_means(backbone, box).drop("cost")
    else:
        means = J.mean_positions(J.unwrap(whole, box), box)
    means = checkpoint(means)
    ions = checkpoint(J.ion_shift(kept.where(F.col("species").isin(list(settings.flow_atoms))), backbone.select("atom", "frame", *AXES), means, box))
    named = means.join(whole.select("atom", "species").distinct(), "atom")
    rdf = None
    if settings.common_backbone:
        near = P.pairs_within(ions.select("frame", *AXES), named.select("atom", "species", *AXES), 6.0, box)
        volume = box[0] * box[1] * box[2]
        rdf = checkpoint(P.radial_distribution(near.select(F.col("b_species").alias("species"), "d"), volume, keys=["species"]))
        radii = P.rdf_onset(rdf, keys=["species"]).select("species", F.col("r_onset").alias("radius"))
        met = named.join(F.broadcast(radii), "species", "left")  # a row a species
    else:
        met = named.join(nearest_distances(named, ions, box), "atom", "left")
    lost = F.raise_error(F.concat(F.lit("no mobile atom near backbone atom "), F.col("atom").cast("string"), F.lit(" of "), "species"))
    balls = met.select(F.col("atom").alias("bid"), "species", *AXES, F.coalesce("radius", lost.cast("double")).alias("radius"))
    return Backbone(balls, ions, rdf)


def flow_backbone(frames: DataFrame, settings: config.Flow, box: tuple[float, float, float]) -> DataFrame:
    """The balls of ``backbone_of``."""
    return backbone_of(frames, settings, box).balls


def circular_flow(balls: DataFrame, box: tuple[float, float, float], settings: config.Flow, volume: float | None = None, graphs: str | None = None) -> DataFrame:
    """flow (mean over three axes, as an area), slice_area and norm_flow of a backbone of balls. ``volume`` (of the box, if
    none is given) tells how many nodes of the given spacing an axis has; ``graphs`` is a folder for the directions' Reeb graphs."""
    n = int((volume or box[0] * box[1] * box[2]) ** (1 / 3) / settings.grid_spacing)
    n += 1 - n % 2
    out = None
    for direction in range(3):
        relax = 2 if settings.periodic else 0
        g = G.Grid((n, n, n), box, (True, True, False), relax)
        members = checkpoint(G.labelled(g, G.level_sets(checkpoint(G.void(g, balls, open_ends=not settings.periodic)), settings.reeb_stride), reach=settings.fat))
        edges = checkpoint(G.reeb_edges(members, G.norm_of(settings.reeb_stride)))
        if graphs:
            sinks.write_graph(G.reeb_nodes(members, G.norm_of(settings.reeb_stride), g), edges, members, f"{graphs}/dir_{direction}")
        span = g.shape[0] * g.shape[1] * g.nz
        e = edges.select("level", (F.col("level") * span + F.col("src")).alias("src"), ((F.col("level") + 1) * span + F.col("dst")).alias("dst"), "capacity")
        low, high = e.agg(F.min("level"), F.max("level")).first()
        bottom = e.where(F.col("level") == low).select(F.col("src").alias("node")).distinct()
        top = e.where(F.col("level") == high).select(F.col("dst").alias("node")).distinct()
        wraps = P.rank_pairs(bottom, top, "node").select(F.lit(direction).alias("dir"), "bottom", "top")
        area = box[0] * box[1] / (n * n)
        found = R.circular_flow(e.select(F.lit(direction).alias("dir"), "src", "dst", "capacity"), wraps, ["dir"]).withColumn("area", F.col("flow") * area)
        out = found if out is None else out.unionByName(found)
        balls, box = P.rotate_axes(balls), (box[2], box[0], box[1])
    slice_area = box[0] * box[1]
    return checkpoint(out).agg(F.avg("area").alias("flow")).select("flow", F.lit(slice_area).alias("slice_area"), (F.col("flow") / slice_area).alias("norm_flow"))


def flow_of_file(spark: SparkSession, settings: config.Flow) -> DataFrame:
    """``circular_flow`` of the mean backbone of an orthorhombic trajectory file."""
    def chosen(df: DataFrame) -> DataFrame:
        return J.every_nth(df, settings.frame_step, settings.frame_start, settings.frame_end, frame="frame_id")

    heads = chosen(_heads(spark, settings.trajectory_path, settings.file_format, None))
    lattice = heads.orderBy("frame_id").select("lattice").first()["lattice"]
    sides = heads.select(*[F.col("lattice")[4 * i].alias(name) for i, name in enumerate(("lx", "ly", "lz"))])
    volume = J.mean_volume(sides).first()["volume"]
    frames = chosen(structures.frames_of(spark, settings.trajectory_path, settings.file_format))
    frames = P.remap_types(frames, settings.atom_type_map) if settings.atom_type_map else frames
    number = ((F.col("frame_id") - settings.frame_start) / settings.frame_step).cast("int")
    frames = checkpoint(frames.select(number.alias("frame"), F.col("atom_id").alias("atom"), "species", *AXES))
    box = (float(lattice[0]), float(lattice[4]), float(lattice[8]))
    frames, box = repeated(frames, box, settings.repeat)
    found = backbone_of(frames, settings, box)
    beside = (settings.output_csv or "flow").rstrip("/") + "-"
    if settings.print_mean_stucture:
        first = found.ions.where(F.col("frame") == 0)
        after = found.balls.agg(F.max("bid")).first()[0] + 1
        mobile = first.join(frames.select("atom", "species").distinct(), "atom").select((F.col("atom") + after).alias("bid"), "species", *AXES)
        sinks.write_structure(found.balls.select(F.col("bid").cast("long").alias("bid"), "species", *AXES).unionByName(mobile), box, f"{beside}mean_structure")
    if settings.radii_figures and found.rdf is not None:
        sinks.write_table(found.rdf, f"{beside}radii")
    return circular_flow(found.balls, box, settings, volume, f"{beside}reeb_graphs" if settings.save_reeb_backbone else None)


def repeated(frames: DataFrame, box: tuple[float, float, float], times: tuple[int, int, int]) -> tuple[DataFrame, tuple[float, float, float]]:
    """Frames (frame, atom, species, x, y, z) and box repeated along each axis; an image's atoms have numbers of their own.

    Ways are unwrapped in the cell first, since a larger box does not see where they cross the cell's boundary, and the
    images are wrapped into the larger box.
    """
    if tuple(times) == (1, 1, 1):
        return frames, box
    large = tuple(n * k for n, k in zip(box, times, strict=True))
    frames = J.unwrap(frames, box)
    for name, n in zip(("ia", "ib", "ic"), times, strict=True):
        frames = frames.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    image = (F.col("ia") * times[1] + F.col("ib")) * times[2] + F.col("ic")
    moved = [wrap(F.col(a) + F.col(i) * n, m).alias(a) for a, i, n, m in zip(AXES, ("ia", "ib", "ic"), box, large, strict=True)]
    return frames.select("frame", (F.col("atom") * (times[0] * times[1] * times[2]) + image).alias("atom"), "species", *moved), large
