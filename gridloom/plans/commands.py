"""The engine's commands: a request with defaults, its checks, and the lazy plan that it runs."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codes, gauss, keys, potential
from gridloom.functions.charges import partial_charges
from gridloom.operators import grid, group_model, lookup, ordering, reports, robust, samplers, select, spatial, stats, tester
from gridloom.session import materialize
from gridloom.sources import exports, formats, maps
from gridloom.sources.store import Store

log = logging.getLogger("gridloom")

# Names that stand for choices.
ALIASES = {
    "potential_model": {
        "0": "single_gauss", "single": "single_gauss", "1": "five_gauss_charge", "five": "five_gauss_charge", "2": "user_gauss",
        "user": "user_gauss"
    },
    "partial_charge": {"0": "neutral", "neutral": "neutral", "1": "partial", "partial": "partial", "2": "amber", "amber": "amber"},
    "printer": {
        "0": "atom_position", "atom_pos": "atom_position", "1": "map_value", "map": "map_value", "2": "gauss", "gaus": "gauss",
        "3": "atom_outlier", "atom_out": "atom_outlier"
    },
    "painter": {
        "0": "gaus", "gaus": "gaus", "1": "model", "model": "model", "2": "comparison", "comparison": "comparison", "3": "demo",
        "demo": "demo", "4": "atom", "atom": "atom"
    },
    "study": {"0": "benchmark", "1": "data_outlier", "2": "member_outlier", "3": "alpha_data", "4": "alpha_member"},
}


@dataclass
class Issue:
    option: str
    message: str
    is_error: bool = True


@dataclass
class Result:
    succeeded: bool
    issues: list[Issue] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Request:
    """What all commands share. Values out of bounds are put right with a warning, contradictions are errors."""

    folder: str = "."
    verbosity: int = 3  # 0 none, 1 errors, 2 warnings, 3 notes, 4 details

    def normalize(self, issues: list[Issue]) -> None:
        for f in fields(self):
            if f.name in ALIASES:
                v = str(getattr(self, f.name)).lower()
                setattr(self, f.name, ALIASES[f.name].get(v, v))

    def check(self, issues: list[Issue]) -> None:
        pass

    def positive(self, issues: list[Issue], *names: str) -> None:
        """Not positive: the default again, with a warning."""
        for n in names:
            if not getattr(self, n) > 0:
                default = next(f.default for f in fields(self) if f.name == n)
                issues.append(Issue(n, f"must be positive; {default} is used", False))
                setattr(self, n, default)

    def exists(self, issues: list[Issue], *names: str) -> None:
        for n in names:
            if not getattr(self, n) or not Path(str(getattr(self, n)).removeprefix("file://")).exists():
                issues.append(Issue(n, f"file not found: {getattr(self, n)}"))


@dataclass
class PotentialAnalysis(Request):
    model_file: str = ""
    map_file: str = ""
    store: str = ""
    saved_key_tag: str = "model"
    samples: int = 1500
    sample_low: float = 0.0
    sample_high: float = 1.5
    sample_height: float = 0.1
    fit_low: float = 0.0
    fit_high: float = 1.0
    alpha_r: float = 0.1
    alpha_g: float = 0.2
    train_alpha: bool = False
    asymmetric: bool = False
    bonds: bool = False
    simulated: bool = False
    simulated_resolution: float = 0.0
    training_report: str = ""
    seed: int = 0

    def check(self, issues: list[Issue]) -> None:
        self.exists(issues, "model_file", "map_file")
        self.positive(issues, "samples", "sample_high", "sample_height", "fit_high")
        if self.simulated and not self.simulated_resolution > 0:
            issues.append(Issue("simulated_resolution", "a simulated map needs a positive resolution"))
        for lo, hi in (("sample_low", "sample_high"), ("fit_low", "fit_high")):
            if getattr(self, lo) > getattr(self, hi):
                issues.append(Issue(lo, "the range is reversed"))
        if self.alpha_r < 0 or self.alpha_g < 0:
            issues.append(Issue("alpha_r", "must not be negative"))


@dataclass
class MapSimulation(Request):
    model_file: str = ""
    out: str = ""
    map_name: str = "sim_map"
    potential_model: str = "five_gauss_charge"
    partial_charge: str = "partial"
    form_factors: str = ""  # file of scattering parameters, as potential.read_form_factors() reads it
    charge_table: str = ""  # Parquet or CSV file of component_id, atom_id, structure_class, charge
    cutoff: float = 5.0
    spacing: float = 0.5
    widths: tuple[float, ...] = (1.5,)
    drop_unknown: bool = False

    def check(self, issues: list[Issue]) -> None:
        self.exists(issues, "model_file")
        self.positive(issues, "cutoff", "spacing")
        if self.potential_model not in ALIASES["potential_model"].values():
            issues.append(Issue("potential_model", "unknown model"))
        if self.partial_charge not in ALIASES["partial_charge"].values():
            issues.append(Issue("partial_charge", "unknown choice"))
        if self.potential_model == "five_gauss_charge":
            self.exists(issues, "form_factors")
            if self.partial_charge != "neutral":
                self.exists(issues, "charge_table")
        if not self.widths or min(self.widths) < 0:
            issues.append(Issue("widths", "at least one width, none negative"))


@dataclass
class ResultDump(Request):
    store: str = ""
    key_tags: tuple[str, ...] = ()
    printer: str = "gauss"
    map_file: str = ""

    def check(self, issues: list[Issue]) -> None:
        if not self.key_tags:
            issues.append(Issue("key_tags", "at least one key"))
        if self.printer not in ALIASES["printer"].values():
            issues.append(Issue("printer", "unknown printer"))
        if self.printer == "map_value":
            self.exists(issues, "map_file")


@dataclass
class PotentialDisplay(Request):
    store: str = ""
    painter: str = "model"
    key_tags: tuple[str, ...] = ()
    pick_chain: str = ""
    veto_chain: str = ""
    pick_component: str = ""
    veto_component: str = ""
    pick_element: str = ""
    veto_element: str = ""
    reference: str = ""

    def check(self, issues: list[Issue]) -> None:
        if not self.key_tags:
            issues.append(Issue("key_tags", "at least one key"))
        if self.painter not in ALIASES["painter"].values():
            issues.append(Issue("painter", "unknown painter"))
        if self.painter == "comparison" and not self.reference:
            issues.append(Issue("reference", "a comparison needs a reference model"))


@dataclass
class ModelTest(Request):
    study: str = "benchmark"
    replicas: int = 100
    points: int = 1000
    fit_low: float = 0.0
    fit_high: float = 1.0
    alpha_r: float = 0.1
    alpha_g: float = 0.2
    seed: int = 0

    def check(self, issues: list[Issue]) -> None:
        self.positive(issues, "replicas", "points", "fit_high")
        if self.fit_low > self.fit_high or self.fit_low < 0:
            issues.append(Issue("fit_low", "the range is reversed or negative"))
        for name in ("alpha_r", "alpha_g"):
            if not getattr(self, name) >= 0:
                issues.append(Issue(name, "must not be negative"))
        if self.study not in ALIASES["study"].values():
            issues.append(Issue("study", "unknown study"))


@dataclass
class MapVisualization(Request):
    model_file: str = ""
    map_file: str = ""
    serial_id: int = 1
    size: int = 100
    width: float = 5.0

    def check(self, issues: list[Issue]) -> None:
        self.exists(issues, "model_file", "map_file")
        self.positive(issues, "size", "width")


@dataclass
class PositionEstimation(Request):
    map_file: str = ""
    threshold: float = 0.01
    radius: float = 1.0  # reach that the search of neighbours starts with
    neighbours: int = 20
    iterations: int = 15
    power: float = 2.0
    step: float = 0.01

    def check(self, issues: list[Issue]) -> None:
        self.exists(issues, "map_file")
        self.positive(issues, "radius", "neighbours", "iterations", "step")


def _with_numbers(atoms: DataFrame) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in codes.element_codes().items() for x in kv])
    return atoms.withColumn("number", F.coalesce(F.try_element_at(pairs, F.upper("element")), F.lit(0)))


def _keyed(atoms: DataFrame) -> DataFrame:
    """Component, atom and structure codes derived from names, as both structure formats give them."""
    a = atoms
    for column, out, first, fixed in (
        ("component_id", "component_key", 30, codes.residue_codes()), ("atom_id", "atom_key", 10000, codes.spot_codes())
    ):
        known = codes.code_table(a.sparkSession, fixed)
        table = materialize(keys.encode_ids(a, column, "serial_id", known, first))
        a = a.join(table.select(F.col("id").alias(column), F.col("code").alias(out)), column, "left")
    return a.na.fill(0, ["component_key", "atom_key"])


def sample_profiles(atoms: DataFrame, voxel: DataFrame, g: grid.Grid, n: int, low: float, high: float, seed: int) -> DataFrame:
    """serial_id, distance, value of n points around each atom."""
    p = samplers.sphere(atoms.select("serial_id", "x", "y", "z"), "serial_id", n, low, high, seed)
    p = p.withColumn("point", F.col("serial_id") * F.lit(n).cast("long") + F.col("sample_no"))
    v = grid.interpolate(p, voxel, g, "point", ("px", "py", "pz"))
    return p.join(v, "point").select("serial_id", "sample_no", "distance", "value")


def bond_profiles(
    bonds: DataFrame, atoms: DataFrame, voxel: DataFrame, g: grid.Grid, n: int, high: float, height: float, seed: int
) -> DataFrame:
    """bond_no, distance, value of n points in a cylinder around each bond."""
    b = spatial.edge_geometry(bonds, atoms.select("serial_id", "x", "y", "z"), [], ["x", "y", "z"]).where("length > 0")
    b = b.select(
        "bond_no", F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), F.col("mid_z").alias("z"), F.col("vec_x").alias("vx"),
        F.col("vec_y").alias("vy"), F.col("vec_z").alias("vz")
    )
    p = samplers.cylinder(b, "bond_no", n, 0.0, high, height, seed).withColumn(
        "point", F.col("bond_no") * F.lit(n).cast("long") + F.col("sample_no")
    )
    return p.join(grid.interpolate(p, voxel, g, "point", ("px", "py", "pz")), "point").select("bond_no", "sample_no", "distance", "value")


def analyze_bonds(
    bonds: DataFrame, atoms: DataFrame, voxel: DataFrame, g: grid.Grid, r: PotentialAnalysis, height: float = 0.2
) -> dict[str, DataFrame]:
    """The analysis of atoms over bonds: cylinder samples, two-dimensional profiles, groups by bond name and component.

    ``bonds``: bond_no LONG (unique), atom_serial_id_1, atom_serial_id_2, bond_key, component_key, is_special_bond."""
    samples = materialize(bond_profiles(bonds, atoms, voxel, g, r.samples, r.sample_high, height, r.seed))
    rows = gauss.linearize_entities(bonds, samples, "bond_no", "distance", "value", r.fit_low, r.fit_high)
    fits = materialize(robust.fit_local(rows, ["bond_no"], "x1", "y", r.alpha_r))
    member = keys.bond_classes(bonds.select("bond_no", "bond_key", "component_key", "is_special_bond")).join(fits, "bond_no")
    posterior = materialize(group_model.fit_groups(member, ["class_key", "group_key"], "bond_no", r.alpha_g))
    groups = group_model.group_rows(posterior, ["class_key", "group_key"])
    return {
        "bond_sample": samples, "bond_local": reports.estimates(fits, ["bond_no"], 2),
        "bond_posterior": reports.posterior_estimates(posterior, ["class_key", "group_key", "bond_no"], 2),
        "bond_group": reports.group_estimates(groups, ["class_key", "group_key"], 2),
    }


def _labelled(model: dict, atoms: DataFrame) -> DataFrame:
    """Atoms with the structure code of the range that their sequence number is in."""
    numbers = codes.structure_codes()
    if "secondary" not in model:
        return atoms.withColumn("structure", F.lit(numbers["FREE"]))
    ranges = model["secondary"].withColumn(
        "structure", F.when(F.col("label") == "HELX", numbers["HELX_P"]).otherwise(numbers["SHEET"])
    ).withColumn("chain_id", F.explode(F.array_distinct(F.array("chain_1", "chain_2"))))
    return lookup.label_intervals(atoms, ranges, ["chain_id"], "sequence_id", label="structure", default=numbers["FREE"])


def bond_pairs(model: dict, atoms: DataFrame) -> DataFrame:
    """atom_serial_id_1, atom_serial_id_2: the declared connections; for files without any, neighbours within 2 of each other
    whose names form a bond of the file's dictionary (else of the built-in catalogue) or link neighbours of the sequence."""
    spark = atoms.sparkSession
    if "connection" in model:
        named = model["connection"].where("atom_serial_id_1 <> atom_serial_id_2").select("atom_serial_id_1", "atom_serial_id_2").distinct()
        named = materialize(named)
        if not named.isEmpty():
            return named
    links = spark.createDataFrame([(None, a, b) for a, b in codes.LINKS], "component_id string, atom_1 string, atom_2 string")
    known = materialize(model["component_bond"].select("component_id", "atom_1", "atom_2")) if "component_bond" in model else None
    if known is None or known.isEmpty():
        pairs = F.array(*[F.struct(*[F.lit(x).alias(f"atom_{k}") for k, x in enumerate(n.split("_"), 1)]) for n in codes.BONDS])
        names = atoms.select("component_id").where("component_id is not null").distinct()
        known = names.select("component_id", F.explode(pairs).alias("p")).select("component_id", "p.atom_1", "p.atom_2")
    rows = atoms.select(
        F.lit("").alias("key_tag"), F.lit(1).alias("model_number"), "serial_id", "chain_id", "sequence_id", "component_id", "atom_id", "x",
        "y", "z"
    )
    return lookup.build_bonds(rows, known.unionByName(links)).select("atom_serial_id_1", "atom_serial_id_2")


def potential_analysis(spark: SparkSession, r: PotentialAnalysis) -> dict[str, DataFrame]:
    """Normalize the map, sample it around each atom, fit each atom, then each class of groups; optionally store the result."""
    model = formats.read_model(spark, r.model_file)
    voxel, g = formats.read_map(spark, r.map_file)
    voxel = stats.normalize_by_sd(voxel.withColumn("value", F.col("value").cast("double")), "value")
    atoms = model["atom"]
    if "chain_map" in model:
        atoms = select.first_chains(atoms, model["chain_map"].drop("path"), (), r.asymmetric)
    atoms = materialize(_keyed(_labelled(model, atoms)))
    samples = sample_profiles(atoms, voxel, g, r.samples, r.sample_low, r.sample_high, r.seed)
    samples = materialize(samples)
    rows = gauss.linearize_entities(atoms, samples, "serial_id", "distance", "value", r.fit_low, r.fit_high)
    alpha_r, alpha_g = r.alpha_r, r.alpha_g
    grid_ = [i / 10 for i in range(11)]
    if r.train_alpha:
        fit_rows = gauss.linearize(samples, "distance", "value", r.fit_low, r.fit_high)
        enough = select.fit_members(samples, "serial_id", "value").join(
            atoms.where(select.is_main_chain(F.col("atom_id"))), "serial_id", "left_semi"
        )
        errors = robust.alpha_errors(fit_rows.join(enough, "serial_id", "left_semi"), ["serial_id"], "x1", "y", "sample_no", grid_)
        errors = materialize(errors)
        if r.training_report:
            errors.groupBy("alpha").agg(F.sum("error").alias("error")).write.mode("overwrite").csv(
                f"{r.training_report}/alpha_r", header=True
            )
        alpha_r = robust.best_alpha(errors).first()["alpha"]
    fits = materialize(robust.fit_local(rows, ["serial_id"], "x1", "y", alpha_r))
    member = keys.atom_classes(
        atoms.select(
            "serial_id", "atom_id", "atom_key", "component_key", "structure", F.col("is_special_atom").cast("int").alias("is_special_atom")
        )
    ).join(fits, "serial_id")
    if r.train_alpha:
        ok = select.fit_groups(
            member.withColumn("main", select.is_main_chain(F.col("atom_id"))), ["class_key", "group_key"], "serial_id", "main"
        )
        errors = group_model.half_split_errors(
            member.join(ok, ["class_key", "group_key"], "left_semi"), ["class_key", "group_key"], "serial_id", grid_, seed=r.seed
        )
        errors = materialize(errors)
        if r.training_report:
            errors.groupBy("alpha").agg(F.sum("error").alias("error")).write.mode("overwrite").csv(
                f"{r.training_report}/alpha_g", header=True
            )
        alpha_g = robust.best_alpha(errors).first()["alpha"]
    posterior = materialize(group_model.fit_groups(member, ["class_key", "group_key"], "serial_id", alpha_g))
    groups = group_model.group_rows(posterior, ["class_key", "group_key"])
    local = reports.estimates(fits, ["serial_id"]).withColumn("alpha_r", F.lit(float(alpha_r)))
    out = {
        "atom": atoms, "sample": samples, "fit": fits, "local": local, "posterior": posterior,
        "group": groups.withColumn("alpha_g", F.lit(float(alpha_g))),
        "posterior_estimate": reports.posterior_estimates(posterior, ["class_key", "group_key", "serial_id"]),
        "group_estimate": reports.group_estimates(groups, ["class_key", "group_key"]),
    }
    if r.bonds:
        named = bond_pairs(model, atoms)
        names = atoms.select("serial_id", "atom_id", "component_key", "is_special_atom")
        one, two = (
            names.select(
                F.col("serial_id").alias(f"atom_serial_id_{k}"), F.col("atom_id").alias(f"a{k}"),
                F.col("component_key").alias("component_key" if k == 1 else "c2"), F.col("is_special_atom").cast("int").alias(f"f{k}")
            ) for k in (1, 2)
        )
        known = codes.code_table(spark, codes.bond_codes())
        turned = known.select(keys.reversed_bond_id(F.col("id")).alias("bond_name"), F.col("id").alias("as_known"))
        pair = named.join(one, "atom_serial_id_1").join(two, "atom_serial_id_2").withColumn(
            "bond_name", keys.bond_id(F.col("a1"), F.col("a2"))
        )
        # a pair matches in either order; pairs that the catalogue lacks are named in the order of their atoms' names
        listed = known.select(F.col("id").alias("bond_name"), F.lit(True).alias("listed"))
        pair = pair.join(listed, "bond_name", "left").join(turned, "bond_name", "left")
        pair = pair.withColumn(
            "bond_name",
            F.when(F.col("listed"), F.col("bond_name")).otherwise(
                F.coalesce("as_known", F.concat_ws("_", F.least("a1", "a2"), F.greatest("a1", "a2")))
            )
        ).drop("listed", "as_known")
        table = materialize(keys.encode_ids(pair, "bond_name", "atom_serial_id_1", known, 10000))
        pair = pair.join(table.select(F.col("id").alias("bond_name"), F.col("code").alias("bond_key")), "bond_name")
        # bonds of one model: numbered by their ends
        bonds = materialize(
            ordering.numbered(
                pair.withColumn("is_special_bond", F.greatest("f1", "f2")), [], ["atom_serial_id_1", "atom_serial_id_2"], "bond_no"
            ).select("bond_no", "atom_serial_id_1", "atom_serial_id_2", "bond_key", "component_key", "is_special_bond")
        )
        out |= analyze_bonds(bonds, atoms, voxel, g, r, r.sample_height)
    if r.store:
        root = atoms.agg(F.count(F.lit(1)).cast("int").alias("atom_size"))
        if r.simulated:
            root = root.withColumns({"map_resolution": F.lit(float(r.simulated_resolution)), "resolution_method": F.lit("simulation")})
        Store(spark, r.store).save(
            r.saved_key_tag,
            {
                "model_object": root, "model_atom": atoms.drop("path", "alternates"), "model_atom_local_potential": local,
                "model_atom_posterior": out["posterior_estimate"], "model_atom_group_potential": out["group_estimate"]
            },
            "model"
        )
    return out


def _charged_field(spark: SparkSession, r: MapSimulation, model: dict, atoms: DataFrame, g: grid.Grid) -> DataFrame:
    """Fields of five Gaussians an element and of the atoms' partial charges, for each width. Elements without parameters add
    nothing."""
    charges = None
    if r.partial_charge != "neutral":
        charges = spark.read.parquet(r.charge_table) if r.charge_table.rstrip("/").endswith(".parquet") else spark.read.csv(
            r.charge_table, header=True, inferSchema=True
        )
    a = partial_charges(_labelled(model, atoms).withColumn("element", F.upper("element")), charges, r.partial_charge)
    each = a.join(potential.read_form_factors(spark, r.form_factors), "element").select(
        "serial_id", "x", "y", "z", "charge", "a0", "b0", "ap", "bp", "am", "bm"
    )
    out = None
    for w in r.widths:
        sets = [(F.col(f"a{s}"), F.col(f"b{s}")) for s in "0pm"]
        p = potential.five_gauss_charged(*sets, F.col("distance"), F.col("charge"), float(w))
        one = grid.scatter_add(each.withColumn("blur", F.lit(float(w))), g, r.cutoff, p, ["blur"])
        out = one if out is None else out.unionByName(one)
    return out


def option_table(spark: SparkSession) -> DataFrame:
    """The schema of all requests: command, option, kind, default_value, flag."""
    rows = [
        (name, f.name, str(f.type), str(f.default), "--" + f.name.replace("_", "-")) for name,
        (kind, _) in COMMANDS.items() for f in fields(kind)
    ]
    return spark.createDataFrame(rows, "command string, option string, kind string, default_value string, flag string")


def map_simulation(spark: SparkSession, r: MapSimulation) -> dict[str, DataFrame]:
    """Fields of a model for all blurring widths in one job, and a map file for each."""
    model = formats.read_model(spark, r.model_file)
    atoms = _with_numbers(model["atom"])
    if r.drop_unknown:
        atoms = atoms.where("number > 0")
    box = atoms.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    g = grid.Grid((1, 1, 1), (r.spacing,) * 3) if box["lx"] is None else grid.Grid.around(
        [box[f"l{c}"] for c in "xyz"], [box[f"h{c}"] for c in "xyz"], r.spacing, r.cutoff
    )
    if r.potential_model == "five_gauss_charge":
        field_ = materialize(_charged_field(spark, r, model, atoms, g))
    else:
        each = atoms.select("serial_id", "x", "y", "z", "number", F.explode(F.array(*[F.lit(float(w)) for w in r.widths])).alias("blur"))
        p = potential.single_gauss(
            F.col("number"), F.col("distance"), F.col("blur")
        ) if r.potential_model == "single_gauss" else potential.user_gauss(F.col("distance"), 1.0, F.col("blur"))
        field_ = materialize(grid.scatter_add(each, g, r.cutoff, p, ["blur"]))
    if r.out:
        for w in r.widths:
            maps.write_map(field_.where(F.col("blur") == float(w)), g, f"{r.out}/{r.map_name}_{Path(r.model_file).stem}_bw{w:.2f}.map")
    return {"field": field_}


def result_dump(spark: SparkSession, r: ResultDump) -> dict[str, DataFrame]:
    """The chosen list of every key as CSV."""
    s, out = Store(spark, r.store), {}
    for k in r.key_tags:
        load = lambda n: s.load(n, k)  # noqa: B023, E731
        atoms = load("model_atom")
        if atoms is None:
            raise ValueError(f"nothing is stored under {k}")
        if r.printer == "atom_outlier":
            t = {"atom_outlier_list": exports.outlier_list(load("model_atom_posterior").drop("key_tag"), atoms)}
        elif r.printer == "atom_position":
            t = {"atom_position_list": exports.position_list(atoms)}
        elif r.printer == "map_value":
            v, g = formats.read_map(spark, r.map_file)
            t = {"map_value_list": exports.map_value_list(v, g, atoms)}
        else:
            names = atoms.select(
                keys.COMPONENT_ATOM.pack(F.col("component_key"), F.col("atom_key")).alias("group_key"), "component_id", "atom_id"
            ).distinct()
            # by component and then by atom, as their codes are ordered; the key itself has the component in its low bits
            fields = keys.COMPONENT_ATOM.unpack(F.col("group_key"))
            names = names.withColumn("ordinal", fields[0] * F.lit(1 << 16) + fields[1])
            groups = load("model_atom_group_potential").where("class_key = 'component'").withColumnsRenamed(
                {"amplitude_prior": "amplitude", "width_prior": "width"}
            )
            t = {
                "local_gaus_list": exports.local_list(atoms, load("model_atom_local_potential").drop("key_tag")),
                "group_gaus_list": exports.group_list(groups, names)
            }
        for name, df in t.items():
            exports.write_csv(df, f"{r.folder}/{name}_{k}.csv")
            out[f"{name}_{k}"] = df
    return out


#: Tables of each suite of figures.
SUITES = {
    "gaus": ("groups", "group_sizes", "members", "outliers"), "atom": ("local", "curves"),
    "model": ("series", "counts", "elements", "ranks", "neighbours", "members", "groups"), "comparison": ("ratios", "regression", "groups"),
    "demo": ("groups", "group_sizes", "series", "counts", "local"),
}


def potential_display(spark: SparkSession, r: PotentialDisplay) -> dict[str, DataFrame]:
    """The tables behind a suite of figures of the selected atoms; those of a reference model, where one is named, besides."""
    s = Store(spark, r.store)
    atoms, post, groups, local = (
        s.table(n) for n in ("model_atom", "model_atom_posterior", "model_atom_group_potential", "model_atom_local_potential")
    )
    if any(t is None for t in (atoms, post, groups, local)):
        raise ValueError("the store holds no analysed model")
    here = F.col("key_tag").isin(list(r.key_tags))
    names = lambda v: select.parse_names(v)
    chosen = select.pick_veto(
        {"chain_id": names(r.pick_chain), "component_id": names(r.pick_component), "element": names(r.pick_element)},
        {"chain_id": names(r.veto_chain), "component_id": names(r.veto_component), "element": names(r.veto_element)}
    )
    key = ["key_tag", "serial_id"]
    a = atoms.where(here & chosen)
    fits = a.join(local.drop("alpha_r"), key)
    mine = post.where(here).join(a.select(*key), key, "left_semi")
    beta = [x.alias(n) for x, n in zip(gauss.beta_from_gauss(F.col("amplitude"), F.col("width")), ("b0", "b1"))]
    residue = ["key_tag", "model_number", "chain_id", "sequence_id", "component_id"]
    make = {
        "groups": lambda: groups.where(here),
        "group_sizes": lambda: groups.where(here).select(
            "key_tag", "class_key", "group_key", "n_members", "n_outliers",
            "alpha_g" if "alpha_g" in groups.columns else F.lit(None).cast("double").alias("alpha_g")
        ),
        "members": lambda: mine, "outliers": lambda: mine.where("is_outlier"), "series": lambda: reports.chain_series(fits, "amplitude"),
        "counts": lambda: a.groupBy("key_tag", "component_id").agg(F.count(F.lit(1)).alias("n")),
        "elements": lambda: fits.select(*key, "element", "amplitude", "width"),
        "local": lambda: fits.select(*key, "component_id", "atom_id", "amplitude", "width", "intensity"),
        "curves": lambda: reports.curves(fits.select(*key, *beta), key, [i / 10 for i in range(16)]),
        "ranks": lambda: lookup.rank_of_values(fits, residue, "atom_id", list(select.MAIN_CHAIN_AMINO), "amplitude"),
        "neighbours": lambda: reports.neighbours_and_value(
            fits.withColumn("id", F.struct(*key)), "id", "xyz", 2.0, "amplitude", ["key_tag"]
        ).select("id.*", "n_neighbours", "amplitude"),
        "ratios": lambda: reports.compare_groups(
            groups.where(here | (F.col("key_tag") == r.reference)), r.reference, "amplitude_prior", "sigma_amplitude"
        ),
        "regression": lambda: reports.value_regression(
            groups.where(F.col("key_tag") == r.reference), groups.where(here), ["class_key", "group_key"], "amplitude_prior"
        ),
    }
    wanted = dict.fromkeys((*SUITES[r.painter], *(("ratios", "regression") if r.reference else ())))
    return {n: make[n]() for n in wanted}


def model_test(spark: SparkSession, r: ModelTest) -> dict[str, DataFrame]:
    t = tester.scenario_table(spark, r.study)
    if "alpha" not in r.study:  # the studies of alpha bring their own levels
        t = t.withColumn("alpha", F.lit(float(r.alpha_g if "member" in r.study else r.alpha_r)))
    res = tester.member_residuals(spark, t, r.replicas, r.points, r.seed) if "member" in r.study else tester.profile_residuals(
        spark, t, r.replicas, r.points, r.seed, fit_range=(r.fit_low, r.fit_high)
    )
    return {"residuals": res, "summary": tester.summarize(res)}


def map_visualization(spark: SparkSession, r: MapVisualization) -> dict[str, DataFrame]:
    """Map values on the viewing plane of one atom."""
    model = formats.read_model(spark, r.model_file)
    voxel, g = formats.read_map(spark, r.map_file)
    all_ = model["atom"].select("serial_id", "x", "y", "z")
    one = all_.where(F.col("serial_id") == r.serial_id)
    near = spatial.range_join(one, all_, "xyz", 2.0).where("l.serial_id <> r.serial_id").select(
        F.col("l.serial_id").alias("serial_id"), F.col("r.serial_id").alias("order"), F.col("r.x").alias("nx"), F.col("r.y").alias("ny"),
        F.col("r.z").alias("nz")
    )
    p = samplers.plane(samplers.viewing_frame(one, near, ["serial_id"]), r.size, r.width)
    v = grid.interpolate(p, voxel, g, "sample_no", ("px", "py", "pz"))
    return {"plane": p.join(v, "sample_no").select("row", "column", "px", "py", "pz", "value")}


def position_estimation(spark: SparkSession, r: PositionEstimation) -> dict[str, DataFrame]:
    """Local maxima of a map by mean shift from its high voxels."""
    voxel, g = formats.read_map(spark, r.map_file)
    v = voxel.select("gid", *[p.alias(c) for p, c in zip(g.position(F.col("gid")), "xyz")], F.col("value").cast("double").alias("value"))
    high = materialize(select.above_share_of_max(v, "value", r.threshold))
    at = spatial.mean_shift_nearest(high, high, "gid", "xyz", "value", r.radius, r.neighbours, r.power, r.iterations)
    return {"points": spatial.quantized_distinct(at, "xyz", r.step)}


COMMANDS: dict[str, tuple[type[Request], Callable]] = {
    "potential_analysis": (PotentialAnalysis, potential_analysis), "map_simulation": (MapSimulation, map_simulation),
    "result_dump": (ResultDump, result_dump), "potential_display": (PotentialDisplay, potential_display),
    "model_test": (ModelTest, model_test), "map_visualization": (MapVisualization, map_visualization),
    "position_estimation": (PositionEstimation, position_estimation),
}


def run(spark: SparkSession, request: Request) -> Result:
    """Normalize, check, make the output folder, run. Errors stop before any job; warnings are put right and reported."""
    issues: list[Issue] = []
    log.setLevel([logging.CRITICAL + 1, logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG][min(4, max(0, request.verbosity))])
    request.normalize(issues)
    request.check(issues)
    for i in issues:
        log.log(logging.ERROR if i.is_error else logging.WARNING, "%s: %s", i.option, i.message)
    log.debug("%s", request)
    if any(i.is_error for i in issues):
        return Result(False, issues)
    if request.folder != ".":
        Path(request.folder.removeprefix("file://")).mkdir(parents=True, exist_ok=True)
    name, plan = next((n, f) for n, (k, f) in COMMANDS.items() if type(request) is k)
    began = time.monotonic()
    try:
        tables = plan(spark, request)
    except (ValueError, KeyError, OSError) as e:
        return Result(False, [*issues, Issue(name, str(e))])
    log.info("%s: %d tables in %.1f s", name, len(tables), time.monotonic() - began)
    return Result(True, issues, tables)
