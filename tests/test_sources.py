"""Structure files, settings and sinks."""

import textwrap

from pyspark.sql import functions as F

from voidloom.plans import pipelines
from voidloom.sources import config, sinks, structures


def xyz(frames, n=5):
    out = []
    for f in range(frames):
        out += [str(n), f'Lattice="2 0 0 0 2 0 0 0 2" Properties=species:S:1:pos:R:3 i={f} pbc="T T T"']
        out += [f"{'Si' if i % 2 else 'O'} {0.3 * i + 0.01 * f:.4f} {0.2 * i * i % 2:.4f} {(0.7 * i) % 2:.4f}" for i in range(n)]
    return "\n".join(out) + "\n"


def test_extxyz(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(xyz(4))
    structures.register(spark)
    atoms = spark.read.format("extxyz").load(str(tmp_path / "a.xyz"))
    assert atoms.count() == 20 and atoms.where("frame_id = 2").count() == 5
    assert atoms.where("frame_id = 1 and species = 'O'").count() == 3
    head = spark.read.format("extxyz").option("frames", "true").load(str(tmp_path)).orderBy("frame_id").collect()
    assert len(head) == 4 and head[3]["info"]["i"] == "3" and head[0]["lattice"][4] == 2.0 and head[0]["pbc"] == [True] * 3


def test_lammps_dump_is_sorted_and_wrapped(spark, tmp_path):
    text = ""
    for t in range(2):
        text += f"ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n1 5\n0 4\n0 4\nITEM: ATOMS id type x y z\n2 5 5.5 1 1\n1 1 1 2 {3 + t}\n"
    (tmp_path / "d.lammpstrj").write_text(text)
    structures.register(spark)
    rows = spark.read.format("lammps-dump-text").load(str(tmp_path / "d.lammpstrj")).orderBy("frame_id", "atom_id").collect()
    assert [(r["atom_id"], r["type_id"], r["x"], r["z"]) for r in rows] == [(1, 1, 0.0, 3.0), (2, 5, 0.5, 1.0), (1, 1, 0.0, 0.0), (2, 5, 0.5, 1.0)]


def test_settings(tmp_path):
    (tmp_path / "s.ini").write_text("[X]\nATOMS = O, Si\nRADII = 0.5, 1.0\nREPEAT_X = 1\nREPEAT_Y = 1\nREPEAT_Z = 2\nKERNEL = TRUE\nTHICKNESS = 0.25\n")
    assert config.structure(str(tmp_path / "s.ini"), "X") == config.Structure(("O", "Si"), (0.5, 1.0), (1, 1, 2))
    made = config.computation(str(tmp_path / "s.ini"), "X")
    assert made.kernel and not made.image and made.thickness == 0.25 and made.n_threads == 4
    (tmp_path / "f.yaml").write_text(textwrap.dedent("""
        atom_type_map: {1: Si, 5: O}
        backbone_atoms: [Si]
        unknown: 3
        grid_spacing: 0.5
    """))
    flow = config.flow(str(tmp_path / "f.yaml"), grid_spacing=None, reeb_stride=4)
    assert flow.atom_type_map == {1: "Si", 5: "O"} and flow.grid_spacing == 0.5 and flow.reeb_stride == 4
    assert config.type_map("1: Si\n 2: O \n") == {1: "Si", 2: "O"}


def test_homology_of_a_file_and_sinks(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(xyz(2, 8))
    settings = config.Structure(("O", "Si"), (0.1, 0.2), (2, 1, 1), 0, 2, 1)
    points = pipelines.sample_points(spark, str(tmp_path / "a.xyz"), "extxyz", settings)
    assert points.count() == 32 and points.agg(F.max("pid")).first()[0] == 15
    found = pipelines.persistent_homology(points, config.Computation(kernel=True))
    assert found["diagrams"].where("kind = 'full' and dim = 0").count() <= 32
    sinks.write_diagrams(found["diagrams"], str(tmp_path / "out"))
    back = sinks.read_diagrams(spark, str(tmp_path / "out"))
    assert back.count() == found["diagrams"].count() and back.where("death = double('inf')").count() >= 2


def test_flow_through_an_empty_channel(spark, tmp_path):
    balls = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.1)], "bid long, x double, y double, z double, radius double")
    result = pipelines.circular_flow(balls, (1.0, 1.0, 1.0), config.Flow(grid_spacing=0.2, reeb_stride=1))
    row = result.first()
    assert 0 < row["norm_flow"] <= 1.5 and abs(row["flow"] - row["norm_flow"] * row["slice_area"]) < 1e-12
    sinks.write_flow(result, str(tmp_path / "flow"))
    assert spark.read.csv(str(tmp_path / "flow"), header=True).columns == ["Flow", "Slice Area", "Normalized Flow"]


def test_command_line_flow(spark, tmp_path):
    import numpy as np

    from voidloom import __main__ as cli

    rng = np.random.default_rng(0)
    rows, text = [(i + 1, 1, *map(float, rng.uniform(0, 4, 3))) for i in range(12)] + [(13, 2, 2.0, 2.0, 2.0), (14, 2, 1.0, 3.0, 0.5)], ""
    for t in range(4):
        text += f"ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n14\nITEM: BOX BOUNDS pp pp pp\n0 4\n0 4\n0 4\nITEM: ATOMS id type x y z\n"
        text += "".join(f"{i} {k} {x + 0.01 * t:.4f} {y:.4f} {z:.4f}\n" for i, k, x, y, z in rows)
    (tmp_path / "d.lammpstrj").write_text(text)
    (tmp_path / "f.yaml").write_text(f"trajectory_path: {tmp_path}/d.lammpstrj\natom_type_map: {{1: Si, 2: Na}}\nbackbone_atoms: [Si]\nflow_atoms: [Na]\ngrid_spacing: 0.8\nreeb_stride: 1\ncommon_backbone: false\n")
    cli.main(["flow", str(tmp_path / "f.yaml"), "--output-csv", str(tmp_path / "o")])
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 1


def test_batches_are_one_plan_and_jobs_tell_the_mode(spark, tmp_path):
    from voidloom import __main__ as cli

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.xyz").write_text(xyz(3, 8))
    (tmp_path / "in" / "deep" / "b.xyz").write_text(xyz(2, 6))
    (tmp_path / "in" / "c.txt").write_text("no structure")
    (tmp_path / "structures.ini").write_text("[S]\nATOMS = O, Si\nRADII = 0.1, 0.2\nREPEAT_X = 1\nREPEAT_Y = 1\nREPEAT_Z = 1\n")
    common = f"CONFIGURATION_FILE = {tmp_path}/structures.ini\nCONFIGURATION_NAME = S\nKERNEL = TRUE\n"
    (tmp_path / "jobs.ini").write_text(
        f"[B]\nMODE = BATCH\nPARENT_DIR = {tmp_path}/in\nFILE_EXT = .xyz\nSAMPLE_START = 0\nSAMPLE_END = 3\nSAMPLE_STEP = 1\n{common}"
        f"[M]\nMODE = MULTI\nSTRUCTURE_FILE = {tmp_path}/in/a.xyz\nSAMPLE_START = 0\nSAMPLE_END = 3\nSAMPLE_STEP = 2\n{common}"
        f"[O]\nMODE = SINGLE\nSTRUCTURE_FILE = {tmp_path}/in/a.xyz\nSAMPLE_TIME = 1\n{common}"
    )
    for name, samples in (("B", set(range(5))), ("M", {0, 2}), ("O", {1})):
        cli.main(["run", str(tmp_path / "jobs.ini"), name, str(tmp_path / name)])
        back = sinks.read_diagrams(spark, str(tmp_path / name / "diagrams"))
        assert {r["sample"] for r in back.select("sample").distinct().collect()} == samples
    named = spark.read.csv(str(tmp_path / "B" / "samples"), header=True).collect()
    assert {(r["file"].rsplit("/", 1)[-1], int(r["frame_id"]), int(r["sample"])) for r in named} == {("a.xyz", 0, 0), ("a.xyz", 1, 1), ("a.xyz", 2, 2), ("b.xyz", 0, 3), ("b.xyz", 1, 4)}


def test_structures_and_graphs_are_written_and_read_back(spark, tmp_path):
    atoms = spark.createDataFrame([(i, "Si", 0.1 * i, 0.2, 0.3) for i in (2, 0, 1)], "bid long, species string, x double, y double, z double")
    sinks.write_structure(atoms, (2.0, 3.0, 4.0), str(tmp_path / "mean"))
    (part,) = (tmp_path / "mean").glob("part-*")
    structures.register(spark)
    back = spark.read.format("extxyz").load(str(part)).orderBy("atom_id").collect()
    assert [(r["species"], r["x"]) for r in back] == [("Si", 0.0), ("Si", 0.1), ("Si", 0.2)]
    assert spark.read.format("extxyz").option("frames", "true").load(str(part)).first()["lattice"] == [2.0, 0, 0, 0, 3.0, 0, 0, 0, 4.0]
    sinks.write_graph(atoms, atoms.limit(1), atoms, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "edges")).count() == 1 and spark.read.parquet(str(tmp_path / "graph" / "nodes")).count() == 3


def test_repeated_frames(spark):
    frames = spark.createDataFrame([(0, 1, "Si", 0.5, 0.0, 0.0)], "frame int, atom int, species string, x double, y double, z double")
    got, box = pipelines.repeated(frames, (2.0, 3.0, 4.0), (2, 1, 2))
    assert box == (4.0, 3.0, 8.0) and {(r["atom"], r["x"], r["z"]) for r in got.collect()} == {(4, 0.5, 0.0), (5, 0.5, 4.0), (6, 2.5, 0.0), (7, 2.5, 4.0)}


def test_repeats_follow_ways_through_the_cells_boundary(spark):
    """An atom between 9.9 and 0.1 of a cell of 10 has its mean at the boundary, and its images in theirs."""
    data = [(f, 1, "Si", 9.9 if f % 2 == 0 else 0.1, 1.0, 1.0) for f in range(10)]
    frames = spark.createDataFrame(data, "frame int, atom int, species string, x double, y double, z double")
    for n in (1, 2, 3):
        got, box = pipelines.repeated(frames, (10.0, 10.0, 10.0), (n, 1, 1))
        means = sorted(r["x"] for r in pipelines.J.mean_positions(pipelines.J.unwrap(got, box), box).collect())
        assert all(min(abs(x - 10.0 * (i + k)) for k in (0, n, -n)) < 1e-9 for i, x in enumerate(means)), means


def test_means_take_all_frames_and_radii_every_nth(spark):
    """Steps of 4 in a cell of 10: every second frame alone would unwrap the wrong way and miss half of the positions."""
    rows = []
    for f in range(6):
        rows += [(f, 0, "Si", (0.5 + 4.0 * f) % 10, 2.0, 2.0), (f, 1, "Si", 5.0, 5.0, 5.0), (f, 2, "Na", 5.0, 5.0, 6.0 if f % 2 == 0 else 5.1)]
    frames = spark.createDataFrame(rows, "frame int, atom int, species string, x double, y double, z double")
    settings = config.Flow(backbone_atoms=("Si",), flow_atoms=("Na",), reeb_stride=2, common_backbone=False)
    balls = {r["bid"]: r for r in pipelines.flow_backbone(frames, settings, (10.0, 10.0, 10.0)).collect()}
    assert abs(balls[0]["x"] - (0.5 + 4.0 * 2.5) % 10) < 1e-9 and 0.9 < balls[1]["radius"] < 1.3


def test_flow_writes_what_its_settings_ask_for(spark, tmp_path):
    text = ""
    for t in range(3):
        text += "ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n3\nITEM: BOX BOUNDS pp pp pp\n0 4\n0 4\n0 4\nITEM: ATOMS id type x y z\n" % t
        text += "1 1 1 1 1\n2 1 3 3 3\n3 2 2 2 2.5\n"
    (tmp_path / "d.lammpstrj").write_text(text)
    settings = config.Flow(str(tmp_path / "d.lammpstrj"), atom_type_map={1: "Si", 2: "Na"}, backbone_atoms=("Si",), flow_atoms=("Na",), grid_spacing=1.0, reeb_stride=1, fat=1.5,
                           output_csv=str(tmp_path / "o"), print_mean_stucture=True, save_reeb_backbone=True, radii_figures=True)
    assert pipelines.flow_of_file(spark, settings).count() == 1
    assert spark.read.parquet(str(tmp_path / "o-reeb_graphs" / "dir_2" / "edges")).count() > 0
    assert spark.read.csv(str(tmp_path / "o-radii"), header=True).count() > 0
    assert spark.read.text(str(tmp_path / "o-mean_structure")).count() == 5


def test_wider_reach_joins_what_is_apart(spark):
    from voidloom.operators import grid as G

    g = G.Grid((8, 8, 8), (8.0, 8.0, 8.0))
    kept = G.nodes(spark, g).where("ix = 2 and iy = 2 and iz in (2, 4)")
    assert G.neighbours(g, kept).count() == 0 and G.neighbours(g, kept, 1.0).count() == 0 and G.neighbours(g, kept, 1.5).count() == 2
    flat = G.Grid((8, 8, 8), (8.0, 8.0, 4.0))  # two cells of 0.5 are nearer than a diagonal of 1.5
    assert G.neighbours(flat, kept, 1.0).count() == 2
    whole = G.nodes(spark, g)
    assert G.neighbours(g, whole, 1.0).exceptAll(G.neighbours(g, whole)).isEmpty()


def dump(frames, n=4):
    out = ""
    for t in range(frames):
        out += f"ITEM: TIMESTEP\n{10 * t}\nITEM: NUMBER OF ATOMS\n{n}\nITEM: BOX BOUNDS pp pp pp\n1 5\n0 4\n0 4\nITEM: ATOMS id type x y z\n"
        out += "".join(f"{n - i} {i % 2 + 1} {1 + 0.1 * i + 0.01 * t:.4f} {0.2 * i:.4f} {0.3 * t:.4f}\n" for i in range(n))
    return out


def same_rows(a, b, drop="file"):
    return a.drop(drop).exceptAll(b.drop(drop)).isEmpty() and b.drop(drop).exceptAll(a.drop(drop)).isEmpty()


def test_frames_cut_by_byte_ranges_are_read_once(spark, tmp_path):
    """Ranges of every small size, so that each line of a frame begins one somewhere, against the reader of whole files."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.xyz").write_text(xyz(5, 3))
    (tmp_path / "in" / "deep" / "b.xyz").write_text("2\n7\nO 0 0 0\nSi 1 1 1\n1\n\nO 0 0 1\n\n")  # headers that look like a count, or are empty
    (tmp_path / "in" / "d.lammpstrj").write_text(dump(4).rstrip("\n"))
    structures.register(spark)
    whole = {f: spark.read.format(fmt).option("ext", f).load(str(tmp_path / "in")) for f, fmt in ((".xyz", "extxyz"), (".lammpstrj", "lammps-dump-text"))}
    assert {f: d.count() for f, d in whole.items()} == {".xyz": 18, ".lammpstrj": 16}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for size in (17, 40, 61, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            for ext, fmt in ((".xyz", "extxyz"), (".lammpstrj", "lammps-dump-text")):
                got = structures.frames_of(spark, f"file://{tmp_path}/in", fmt, ext)
                assert same_rows(got, whole[ext]), (size, ext)
        heads = structures.frames_of(spark, f"{tmp_path}/in/d.lammpstrj", "lammps-dump-text", headers=True).orderBy("frame_id").collect()
        assert [h["info"]["timestep"] for h in heads] == ["0", "10", "20", "30"] and heads[0]["lattice"][0] == 4.0 and heads[0]["pbc"] == [True] * 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_stream_of_frames_goes_on_where_it_stopped(spark, tmp_path):
    from voidloom.operators import trajectory as J
    from voidloom.streaming.unwrap import unwrap_frames

    structures.register(spark)
    source = tmp_path / "run.lammpstrj"
    whole = dump(7)
    cuts = [len(dump(2)), len(dump(5)) - 9, len(whole)]  # the second write ends within a frame
    for i, cut in enumerate(cuts):
        source.write_text(whole[:cut])
        stream = spark.readStream.format("lammps-dump-text").load(str(source))
        q = unwrap_frames(stream, (4.0, 4.0, 4.0)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == [8, 16, 28][i]
    frames = spark.read.format("lammps-dump-text").load(str(source)).select(F.col("atom_id").cast("long").alias("atom"), F.col("frame_id").alias("frame"), "x", "y", "z")
    plain = {(r["atom"], r["frame"]): (r["x"], r["y"], r["z"]) for r in J.unwrap(frames, (4.0, 4.0, 4.0)).collect()}
    assert {(r["atom"], r["frame"]): (r["x"], r["y"], r["z"]) for r in got.collect()} == plain


def test_diagram_files_have_names_numbers_and_a_zero_point(spark, tmp_path):
    rows = [(0, "full", 0, -1.0, float("inf"), 3, 2**63 - 1), (0, "full", 0, -0.5, 0.25, 1, 9), (0, "kernel", 1, 0.5, 0.75, 7, 8), (4, "full", 2, 1.0, 2.0, 5, 6)]
    diagrams = spark.createDataFrame(rows, "sample int, kind string, dim int, birth double, death double, birth_simplex long, death_simplex long")
    names = sinks.write_diagram_files(diagrams, str(tmp_path), "run")
    assert (tmp_path / "run_sample_0_PD_0.csv").read_text() == ",birth,death,birth simplex,death simplex\n0,-0.5,0.25,1,9\n1,-1.0,inf,3,9223372036854775807\n"
    assert (tmp_path / "run_sample_0_kernel_PD_1.csv").read_text().count("\n") == 2
    assert (tmp_path / "run_sample_4_PD_0.csv").read_text().count("\n") == 1 and (tmp_path / "run_sample_4_APF_0.csv").read_text() == ",mean age,lifetime\n0,0,0\n"
    assert len(names) == 9 + 6 and not [p for p in tmp_path.iterdir() if p.is_dir()]


def test_diagrams_of_a_published_sample(spark):
    """Set STRUCTURE_SAMPLES to a folder with ``<name>.xyz``, ``<name>_sample_<s>_PD_<d>.csv`` and RADII ("H=0.1,C=0.2"): diagrams agree to 1e-9."""
    import csv
    import os
    import re
    from pathlib import Path

    import numpy as np
    import pytest

    from voidloom.operators import topology as T

    folder, radii = os.environ.get("STRUCTURE_SAMPLES"), os.environ.get("RADII", "")
    if not folder:
        pytest.skip("no folder with published diagrams is named")
    weights = [(a, float(r)) for a, r in (x.split("=") for x in radii.split(","))]
    settings = config.Structure(tuple(a for a, _ in weights), tuple(r for _, r in weights), (1, 1, 1), 0, 3, 1)
    seen = 0
    for file in sorted(Path(folder).glob("*_sample_*_PD_*.csv")):
        stem, sample, dim = re.fullmatch(r"(.*)_sample_(\d+)_PD_(\d)\.csv", file.name).groups()
        points = pipelines.sample_points(spark, f"{folder}/{stem}.xyz", "extxyz", settings).where(F.col("sample") == int(sample))
        found = T.persistence(T.alpha_complex(points)).where(F.col("dim") == int(dim)).select("birth", "death").collect()
        with file.open() as f:
            told = np.array(sorted((float(r["birth"]), float(r["death"])) for r in csv.DictReader(f)))
        mine = np.array(sorted((r["birth"], r["death"]) for r in found))
        assert mine.shape == told.shape and np.allclose(mine[np.isfinite(mine)], told[np.isfinite(told)], atol=1e-9, rtol=0)
        seen += 1
    assert seen
