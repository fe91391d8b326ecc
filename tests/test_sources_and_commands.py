import math

import pytest
from pyspark.sql import functions as F

from gridloom import session
from gridloom.functions import gauss, potential
from gridloom.operators import grid, robust
from gridloom.plans import commands, file_queries
from gridloom.sources import cif, exports, formats, maps, pdb
from gridloom.sources.store import Store

BASE = """data_TEST
#
loop_
_database_2.database_id
_database_2.database_code
PDB 1ABC
#
loop_
_entity.id
_entity.type
_entity.pdbx_number_of_molecules
1 polymer 1
#
loop_
_struct_asym.id
_struct_asym.entity_id
A 1
#
_em_3d_reconstruction.resolution 2.0
_em_3d_reconstruction.resolution_method 'FSC'
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
ATOM 1 C CA . ALA A 1 0.0 0.0 0.0 1.0 0.0 1
#
"""


def model(spark, tmp_path, text, name="m.cif"):
    (tmp_path / name).write_text(text)
    return formats.read_model(spark, f"file://{tmp_path}/{name}")


VARIANTS = {
    "base": (BASE, {}),
    "no_model": (BASE.replace("_atom_site.pdbx_PDB_model_num\n", "").replace("0.0 1\n#", "0.0\n#"), {"model_number": 1}),
    "model_2": (BASE.replace("0.0 1\n#", "0.0 2\n#"), {"model_number": 2}),
    "double_quote": (BASE.replace(" CA ", ' "CA A" '), {"atom_id": "CA A"}),
    "multi_line": (BASE.replace("1 polymer 1\n", "1\n;polymer\nchain\n;\n1\n").replace(" CA ", " 'CA A'\n "), {"atom_id": "CA A"}),
    "auth": (
        BASE.replace("label_comp", "auth_comp").replace("label_asym", "auth_asym").replace("label_seq", "auth_seq"),
        {"component_id": "ALA", "chain_id": "A", "sequence_id": 1}
    ),
    "missing_numbers": (BASE.replace("1.0 0.0 1\n", "? ? 1\n"), {"occupancy": 1.0, "temperature": 0.0}),
    "alternate_b": (BASE.replace(" CA . ", " CA B "), {"indicator": "B"}),
    "items": (
        BASE.replace(
            "loop_\n_entity.id\n_entity.type\n_entity.pdbx_number_of_molecules\n1 polymer 1\n", "_entity.id 1\n_entity.type polymer\n"
        ).replace("loop_\n_struct_asym.id\n_struct_asym.entity_id\nA 1\n", "_struct_asym.id A\n_struct_asym.entity_id 1\n"),
        {}
    ),
    "prefix": (BASE.replace(" A 1 0.0", " A 10A 0.0"), {"sequence_id": 10}),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_cif(spark, tmp_path, name):
    text, want = VARIANTS[name]
    m = model(spark, tmp_path, text)
    a = m["atom"].collect()
    assert len(a) == 1 and a[0].serial_id == 1 and {k: a[0][k] for k in want} == want
    e = m["entry"].first()
    assert (e.pdb_id, e.emd_id, e.map_resolution, e.resolution_method) == ("1ABC", "X-RAY DIFF", 2.0, "FSC")
    assert [tuple(r)[1:] for r in m["chain_map"].collect()] == [("1", 0, "A")]


def test_cif_atoms_alternates_ranges_and_connections(spark, tmp_path):
    row = "HETATM {} C {} {} LIG A 10A {} 0 0 1 0 1\n"
    atoms = row.format(1, "X1", ".", "0.0") + row.format(2, "X2", "A", "1.2") + row.format(3, "X2", "B", "1.3") + row.format(4, "H1", ".", "2").replace(" C H1", " H H1") + "ATOM 5 C CA\n"
    more = "loop_\n_struct_conf.id\n_struct_conf.beg_label_asym_id\n_struct_conf.end_label_asym_id\n_struct_conf.beg_label_seq_id\n_struct_conf.end_label_seq_id\nH1 A A ? 5\nH2 A A 2 5\n#\n"
    more += "_struct_conn.conn_type_id covale\n_struct_conn.ptnr1_label_asym_id A\n_struct_conn.ptnr1_label_comp_id LIG\n_struct_conn.ptnr1_label_atom_id X1\n_struct_conn.ptnr1_label_seq_id 10A\n_struct_conn.ptnr2_label_asym_id A\n_struct_conn.ptnr2_label_comp_id LIG\n_struct_conn.ptnr2_label_atom_id X2\n_struct_conn.ptnr2_label_seq_id 10A\n_struct_conn.pdbx_value_order sing\n#\n"
    m = model(spark, tmp_path, BASE.replace("ATOM 1 C CA . ALA A 1 0.0 0.0 0.0 1.0 0.0 1\n", atoms) + more)
    got = {r.serial_id: r for r in m["atom"].collect()}
    assert [tuple(r)[1:] for r in m["incomplete"].collect()] == [("atom_site", 14, 4, "ATOM")]
    assert set(got) == {1, 2} and got[2].alternates["B"].x == 1.3 and got[1].is_special_atom and got[1].sequence_id == 10
    assert [(r.range_id, r.low, r.high) for r in m["secondary"].collect()] == [("H2", 2, 5)]
    assert [(r.atom_serial_id_1, r.atom_serial_id_2, r.bond_order) for r in m["connection"].collect()] == [(1, 2, "sing")]


def test_pdb_round_trip(spark, tmp_path):
    m = model(spark, tmp_path, BASE.replace(" CA ", ' "O5\'" '))["atom"]
    exports.write_text(exports.pdb_lines(m), f"file://{tmp_path}/out", tail=["END"])
    exports.write_text(exports.cif_lines(m, "temperature"), f"file://{tmp_path}/out2", head=exports.cif_head(), tail=["#"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    (tmp_path / "x.pdb").write_text(text.replace("END", "ENDMDL\n" + text))
    a = pdb.read_atoms(spark, f"file://{tmp_path}/x.pdb").orderBy("line_number").collect()
    assert [(r.atom_id, r.component_id, r.x, r.model_number) for r in a] == [("O5'", "ALA", 0.0, 1), ("O5'", "ALA", 0.0, 2)]
    back = model(spark, tmp_path, "".join(p.read_text() for p in sorted((tmp_path / "out2").glob("part*"))), "y.cif")["atom"].first()
    assert back.atom_id == "O5'" and back.serial_id == 1
    assert formats.read_model(spark, f"file://{tmp_path}/x.pdb")["atom"].count() == 1
    with pytest.raises(ValueError):
        formats.read_model(spark, "x.txt")


@pytest.mark.parametrize("name", ["a.mrc", "a.map", "a.ccp4"])
def test_maps(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(maps, "SLAB_VALUES", 13)
    g = grid.Grid((3, 4, 5), (0.5, 1.0, 2.0), (1.0, -2.0, 4.0))
    v = grid.voxels(spark, g).withColumn("value", (F.col("gid") * 0.25).cast("float"))
    maps.write_map(v, g, str(tmp_path / name))
    back, h = formats.read_map(spark, str(tmp_path / name))
    assert (h.size, h.spacing, h.origin) == (g.size, g.spacing, g.origin)
    assert sorted(map(tuple, back.collect())) == [(i, i * 0.25) for i in range(60)]
    raw = bytearray((tmp_path / name).read_bytes())
    raw[64:76] = b"\3\0\0\0\1\0\0\0\2\0\0\0"  # stored as z, x, y
    (tmp_path / f"p{name}").write_bytes(raw)
    assert maps.read_header(str(tmp_path / f"p{name}")).grid.size == (4, 5, 3)
    raw[12] = 1
    (tmp_path / f"q{name}").write_bytes(raw)
    with pytest.raises(ValueError):
        maps.read_header(str(tmp_path / f"q{name}"))


@pytest.mark.parametrize("name", ["map_written_back", "mrc_written_back"])
def test_maps_are_the_first_that_a_new_shared_folder_holds(spark, tmp_path, name, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: f"file://{shared}")
    monkeypatch.setattr(session, "_TABLES", [])
    spark.createDataFrame([(2, 0.5), (1001, None), (1002, -3.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.gid: r.value for r in file_queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == 2000 and {i: v for i, v in got.items() if v} == {2: 0.5, 1002: -3.0}
    assert len(list(shared.rglob("*.m??"))) == 1
    session.release()
    assert not list(shared.rglob("*.m??"))


def test_axis_permutation(spark):
    df = spark.range(24).select(F.col("id").alias("gid"), F.col("id").alias("raw"))
    got = {r.gid: r.raw for r in grid.reorder_axes(df, "gid", (2, 3, 4), (3, 1, 2)).collect()}
    assert [got[i] for i in range(7)] == [0, 2, 4, 6, 8, 10, 12] and got[12] == 1 and got[23] == 23


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    atoms = spark.createDataFrame([(1, 0.5), (2, 1.5)], "serial_id int, x double")
    root = spark.createDataFrame([(2,)], "atom_size int")
    assert s.keys() == []
    s.save("b", {"model_object": root, "model_atom": atoms}, "model")
    s.save("a", {"model_object": root, "model_atom": atoms.withColumn("key_tag", F.lit("other"))}, "model")
    assert s.keys() == ["a", "b"] and s.keys("map") == [] and s.load("model_atom", "a").count() == 2 and s.violations().count() == 0
    s.save(
        "a",
        {
            "model_object": root, "model_atom": atoms.limit(1),
            "model_bond": spark.createDataFrame([(1, 7)], "atom_serial_id_1 int, atom_serial_id_2 int")
        },
        "model"
    )
    assert s.load("model_atom", "a").count() == 1 and s.load("model_atom", "b").count() == 2
    assert [(r.table_name, r.rule, r.key_tag) for r in s.violations().collect()] == [("model_bond", "no_parent", "a")]
    s.save("a", {"model_object": root, "model_atom": atoms.union(atoms)}, "model")
    assert [(r.rule, r.n) for r in s.violations().collect()] == [("primary_key", 4)]
    s.delete("a")
    assert s.keys() == ["b"]
    with pytest.raises(ValueError):
        s.save("x", {"model_atom": atoms}, "model")
    with pytest.raises(ValueError):
        s.save("x", {"model_object": root}, "other")


def test_simulate_then_analyze_recovers_the_widths(spark, tmp_path):
    rows = "".join(f"ATOM {i} C CA . ALA A {i} {6.0 * i:.1f} 0.0 0.0 1.0 0.0 1\n" for i in range(1, 4))
    link = "".join(
        f"_struct_conn.ptnr{k}_label_{n} {v}\n" for k in (1, 2) for n,
        v in (("asym_id", "A"), ("comp_id", "ALA"), ("atom_id", "CA"), ("seq_id", k))
    )
    model(
        spark, tmp_path,
        BASE.replace("ATOM 1 C CA . ALA A 1 0.0 0.0 0.0 1.0 0.0 1\n", rows) + "_struct_conn.conn_type_id covale\n" + link + "#\n"
    )
    sim = commands.run(
        spark,
        commands.MapSimulation(
            folder=str(tmp_path), model_file=f"{tmp_path}/m.cif", out=str(tmp_path), potential_model="2", widths=(0.8,), cutoff=4.0,
            spacing=0.25
        )
    )
    assert sim.succeeded, sim.issues
    r = commands.run(
        spark,
        commands.PotentialAnalysis(
            folder=str(tmp_path), model_file=f"{tmp_path}/m.cif", map_file=f"{tmp_path}/sim_map_m_bw0.80.map",
            store=f"file://{tmp_path}/store", samples=150, seed=3, bonds=True
        )
    )
    assert r.succeeded, r.issues
    local = r.tables["local"].collect()
    assert len(local) == 3 and all(abs(x.width - 0.8) < 0.01 for x in local)
    post = r.tables["posterior_estimate"].collect()
    assert len(post) == 9 and all(abs(x.width - 0.8) < 0.01 for x in post)
    assert r.tables["bond_local"].count() == 1 and r.tables["bond_group"].count() == 2
    for printer in ("0", "1", "2", "3"):
        d = commands.run(
            spark,
            commands.ResultDump(
                folder=str(tmp_path / "dump"), store=f"file://{tmp_path}/store", key_tags=("model",), printer=printer,
                map_file=f"{tmp_path}/sim_map_m_bw0.80.map"
            )
        )
        assert d.succeeded and all(t.count() >= 0 for t in d.tables.values()), d.issues
    show = commands.run(
        spark,
        commands.PotentialDisplay(
            store=f"file://{tmp_path}/store", key_tags=("model",), pick_chain="A", veto_component="GLY", reference="model"
        )
    )
    assert show.succeeded and show.tables["series"].count() == 3 and show.tables["ratios"].count() == 0
    sizes = {
        "gaus": {"groups": 3, "group_sizes": 3, "members": 9, "outliers": 0}, "atom": {"local": 3, "curves": 48},
        "comparison": {"ratios": 0, "regression": 1, "groups": 3}, "demo": {"series": 3, "counts": 1},
        "model": {"elements": 3, "ranks": 12, "neighbours": 3}
    }
    for painter, want in sizes.items():
        t = commands.run(
            spark,
            commands.PotentialDisplay(
                store=f"file://{tmp_path}/store", key_tags=("model",), painter=painter, reference="model" if painter == "comparison" else ""
            )
        ).tables
        assert set(t) == set(commands.SUITES[painter]) and {n: t[n].count() for n in want} == want
    assert not commands.run(spark, commands.PotentialDisplay(store="x", key_tags=("model",), painter="9")).succeeded
    view = commands.run(
        spark, commands.MapVisualization(model_file=f"{tmp_path}/m.cif", map_file=f"{tmp_path}/sim_map_m_bw0.80.map", size=5, width=1.0)
    )
    plane = view.tables["plane"].collect()
    assert len(plane) == 25 and max(plane, key=lambda x: x.value)["row"] == 2
    pos = commands.run(
        spark,
        commands.PositionEstimation(
            map_file=f"{tmp_path}/sim_map_m_bw0.80.map", threshold=0.9, radius=1.0, iterations=3, power=1.0, step=0.5
        )
    )
    assert {round(p.x / 6) for p in pos.tables["points"].collect()} == {1, 2, 3}


def test_charged_simulation_adds_up(spark, tmp_path):
    rows = "".join(
        f"ATOM {i} {e} {n} . ALA A 1 {x:.1f} 0.0 0.0 1.0 0.0 1\n" for i,
        (e, n, x) in enumerate((("C", "CA", 0.0), ("N", "N", 1.5), ("XX", "Q", 0.5)), 1)
    )
    model(spark, tmp_path, BASE.replace("ATOM 1 C CA . ALA A 1 0.0 0.0 0.0 1.0 0.0 1\n", rows))
    sets = {("C", 0): (1, 2), ("C", 1): (0.5, 3), ("C", -1): (1.5, 4), ("N", 0): (2, 5)}
    cols = [f"{c}{i}" for c in "ab" for i in range(1, 6)]
    (tmp_path / "f.csv").write_text(
        "element,charge," + ",".join(cols) + "\n" + "".join(f"{e},{q},{a},0,0,0,0,{b},1,1,1,1\n" for (e, q), (a, b) in sets.items())
    )
    (tmp_path / "q.csv").write_text("component_id,atom_id,structure_class,charge\nALA,CA,FREE,-0.5\nALA,N,HELX,0.25\n")
    ask = {
        "model_file": f"{tmp_path}/m.cif", "form_factors": f"{tmp_path}/f.csv", "charge_table": f"{tmp_path}/q.csv", "widths": (0.7,),
        "cutoff": 2.0, "spacing": 0.5
    }
    r = commands.run(spark, commands.MapSimulation(**ask))
    assert r.succeeded, r.issues
    got = {x.gid: x.value for x in r.tables["field"].collect()}
    g = grid.Grid.around((0.0, 0.0, 0.0), (1.5, 0.0, 0.0), 0.5, 2.0)

    def term(a, b, d):
        f = b / (8 * math.pi**2) + 0.49
        return potential.INTRINSIC_SCALE * a * (2 * math.pi * f) ** -1.5 * math.exp(-d * d / f / 2)

    def delta(d):
        return potential.CHARGE_SCALE * (math.erf(d / 0.7 / math.sqrt(2)) / d if d > 1e-5 else math.sqrt(2 / math.pi) / 0.7)

    for gid, v in got.items():
        x, y, z = (
            o + s * i for o, s,
            i in zip(g.origin, g.spacing, (gid % g.size[0], gid // g.size[0] % g.size[1], gid // g.size[0] // g.size[1]))
        )
        dc, dn = math.dist((x, y, z), (0, 0, 0)), math.dist((x, y, z), (1.5, 0, 0))
        want = (
            term(1, 2, dc) - 0.5 * (term(1, 2, dc) - term(1.5, 4, dc) + delta(dc)) if dc <= 2 else 0
        ) + (term(2, 5, dn) if dn <= 2 else 0)
        assert abs(v - want) < 1e-9
    assert any(abs(v) > 1 for v in got.values())
    assert not commands.run(spark, commands.MapSimulation(model_file=f"{tmp_path}/m.cif")).succeeded
    neutral = commands.run(spark, commands.MapSimulation(**ask | {"charge_table": "", "partial_charge": "0", "potential_model": "1"}))
    assert neutral.succeeded and neutral.tables["field"].count() == len(got)


def test_bonds_without_declared_ones(spark, tmp_path):
    atoms = [("N", "N", 1, 0.0), ("C", "CA", 1, 1.4), ("C", "C", 1, 2.9), ("N", "N", 2, 4.2), ("C", "CB", 2, 6.1)]
    rows = "".join(f"ATOM {i} {e} {n} . ALA A {q} {x:.1f} 0.0 0.0 1.0 0.0 1\n" for i, (e, n, q, x) in enumerate(atoms, 1))
    m = model(spark, tmp_path, BASE.replace("ATOM 1 C CA . ALA A 1 0.0 0.0 0.0 1.0 0.0 1\n", rows))
    assert {(r[0], r[1]) for r in commands.bond_pairs(m, m["atom"]).collect()} == {(1, 2), (2, 3), (3, 4)}
    own = m | {"component_bond": spark.createDataFrame([("ALA", "CB", "N")], "component_id string, atom_1 string, atom_2 string")}
    assert {(r[0], r[1]) for r in commands.bond_pairs(own, m["atom"]).collect()} == {(3, 4), (4, 5)}


def test_repeated_alternates(spark):
    rows = [("p", i, x, ind) for i, (x, ind) in enumerate([(0.0, "."), (1.0, "B"), (2.0, "B"), (3.0, "C")])]
    a = spark.createDataFrame(rows, "path string, row_no int, x double, indicator string").selectExpr(
        "*", "1 as model_number", "'A' as chain_id", "'ALA' as component_id", "1 as sequence_id", "'CA' as atom_id", "0.0 as y", "0.0 as z",
        "1.0 as occupancy", "0.0 as temperature"
    )
    (one,) = cif.merge_alternates(a).collect()
    assert {k: v.x for k, v in one.alternates.items()} == {"B": 1.0, "C": 3.0}


def test_requests(spark):
    r = commands.run(spark, commands.PotentialAnalysis(model_file="/nowhere", map_file="/nowhere", samples=0, fit_low=2.0))
    assert not r.succeeded and {i.option for i in r.issues if i.is_error} == {"model_file", "map_file", "fit_low"} and any(
        i.option == "samples" and not i.is_error for i in r.issues
    )
    assert not commands.run(spark, commands.ResultDump()).succeeded and not commands.run(spark, commands.ModelTest(study="no")).succeeded
    t = commands.run(spark, commands.ModelTest(study="0", replicas=20, points=300))
    s = {x.method: x for x in t.tables["summary"].collect()}
    assert s["robust"].n == 20 and abs(s["robust"].width_residual_mean) < 0.2
    m = commands.run(spark, commands.ModelTest(study="member_outlier", replicas=3, points=50)).tables["summary"]
    worst = m.where("scenario = 17").collect()
    by = {x.method: abs(x.b0_residual_mean) for x in worst}
    assert by["robust"] < by["mean"]


def test_potentials(spark):
    one = spark.range(1)
    v = one.select(
        potential.single_gauss(F.lit(6), F.lit(1.0), 0.1).alias("a"), potential.charge_delta(F.lit(1.0), F.lit(1.0), 0.5).alias("b"),
        potential.charge_delta(F.lit(4.0), F.lit(1.0), 0.5).alias("c"), potential.charge_delta(F.lit(0.0), F.lit(1.0), 0.5).alias("d"),
        potential.charge_delta(F.lit(2.0), F.lit(1.0), 0.0).alias("e")
    ).first()
    s2 = 1 / 36 + 0.01
    assert abs(v.a - (2 * math.pi * s2) ** -1.5 * math.exp(-1 / (2 * s2))) < 1e-12
    assert abs(
        v.b - potential.CHARGE_SCALE * math.erf(1 / 0.5 / math.sqrt(2))
    ) < 1e-9 and v.c == 0 and abs(v.d - potential.CHARGE_SCALE * math.sqrt(2 / math.pi) / 0.5) < 1e-9 and v.e == potential.CHARGE_SCALE / 2
    a, b = (
        F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(3.0))
    ), (F.array(F.lit(1.5), F.lit(2.0)), F.array(F.lit(1.0), F.lit(3.0)))
    for q in (-0.5, 0.0, 0.5):
        assert one.select(potential.five_gauss_charged(a, b, a, F.lit(1.0), F.lit(q), 0.5).alias("v")).first().v is not None
    with pytest.raises(ValueError):
        gauss.response(F.lit(1.0), 0.0)


def test_estimator_expectations(spark):
    df = spark.createDataFrame(
        [("a", float(i), y) for i, y in enumerate((1.0, 2.1, 2.9, 4.2))] + [("one", 1.0, 3.0)], "k string, x double, y double"
    )
    r = {x.k: x for x in robust.fit_local(df, ["k"], "x", "y", 0.0).collect()}
    assert abs(r["a"].b0 - 0.99) < 1e-9 and abs(r["a"].b1 - 1.04) < 1e-9 and r["a"].status == "SUCCESS"
    assert (r["one"].status, r["one"].b0, r["one"].b1, r["one"].sigma2) == ("INSUFFICIENT_DATA", 0.0, 0.0, robust.HUGE)
    line = spark.createDataFrame([("k", i, float(i), 1.0 + 2 * i) for i in range(6)], "k string, o int, x double, y double")
    errors = robust.alpha_errors(line, ["k"], "x", "y", "o", [0.0, 0.5], 3).collect()
    assert all(e.error < 1e-6 for e in errors) and robust.best_alpha(
        robust.alpha_errors(line.limit(0), ["k"], "x", "y", "o", [0.0, 0.5])
    ).first().alpha == 0.0
    with pytest.raises(ValueError):
        robust.fit_local(df, ["k"], "x", "y", -1.0)


def test_codes():
    from gridloom.functions import codes

    s = codes.spot_codes()
    assert [
        s[n] for n in ("C", "CA", "CG1", "CH2", "N", "ND1", "NH2", "O", "OXT", "SG", "SD", "HG11", "HA2", "C1'", "O5'", "C8", "N9", "O6")
    ] == [6100, 6200, 6410, 6820, 7100, 7510, 7720, 8100, 8999, 9400, 9500, 411, 220, 11, 25, 48, 59, 66]
    e, r, t = codes.element_codes(), codes.residue_codes(), codes.structure_codes()
    b = codes.bond_codes()
    assert [s.get(n) for n in ("HOP2", "H4'", "H5''", "H1", "H73", "HXT", "CB1", "CH1")] == [5, 32, 37, 71, 84, 999, None, None]
    assert (b["OP2_HOP2"], b["C1'_N9"], b["P_O3'"], b["N_CA"], b["C_N"], b["SD_CE"]) == (1, 8, 61, 62, 69, len(codes.BONDS))
    assert all(n.count("_") == 1 and set(n.split("_")) <= set(s) for n in codes.BONDS)
    assert (
        e["C"], e["ZN"], e["TH"], r["ALA"], r["DT"], t["SHEET"], t["HELX_RH_OT_P"], t["HELX_RH_Z_N"], t["TURN_TY3_P"]
    ) == (6, 30, 90, 1, 28, 3, 27, 61, 107)
