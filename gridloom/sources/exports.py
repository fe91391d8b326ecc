"""Text and CSV exports of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordering import numbered

# Header lines of the exported atom loop.
CIF_COLUMNS = [
    "group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x",
    "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num"
]


def quoted(c: Column, missing: str = ".") -> Column:
    """A value as one token: as it is where it reads as plain data, else in the quotes that it can stand in. Values with both
    kinds of closing quotes or with line ends have no one-line form and lose these characters."""
    plain = c.rlike(r"""^[^\s_#$'"\[\];][^\s]*$""") & ~F.lower(c).rlike("^(data_|loop_|save_|stop_|global_)")
    flat = F.regexp_replace(c, r"[\r\n]+", " ")
    single, double = ~flat.rlike(r"'(\s|$)"), ~flat.rlike(r'"(\s|$)')
    text = F.when(single, F.concat(F.lit("'"), flat, F.lit("'"))).when(double, F.concat(F.lit('"'), flat, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(flat, F.lit("'"), F.lit("")), F.lit("'"))
    )
    return F.coalesce(F.when(plain, c).otherwise(text), F.lit(missing))


def cif_lines(atoms: DataFrame, parameter: str) -> DataFrame:
    """One text row an atom in serial order, the column ``parameter`` in place of the temperature; atoms without it are left out."""
    f3 = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    parts = [
        F.when(F.col("is_special_atom").cast("boolean"), "HETATM").otherwise("ATOM"), F.col("serial_id").cast("string"),
        quoted(F.col("element")), quoted(F.col("atom_id")), quoted(F.col("indicator")), quoted(F.col("component_id")),
        quoted(F.col("chain_id")), F.coalesce(F.col("sequence_id").cast("string"), F.lit(".")), f3("x"), f3("y"), f3("z"),
        F.format_string("%.2f", F.col("occupancy").cast("double")), f3(parameter), F.lit("1")
    ]
    return atoms.where(F.col(parameter).isNotNull()).select("serial_id", F.concat_ws(" ", *parts).alias("value"))


def pdb_lines(atoms: DataFrame, parameter: str | None = None) -> DataFrame:
    b = F.coalesce(F.col(parameter), F.col("temperature")) if parameter else F.col("temperature")
    name = F.when(F.length("atom_id") < 4, F.concat(F.lit(" "), F.rpad("atom_id", 3, " "))).otherwise(F.col("atom_id"))
    line = F.format_string(
        "%-6s%5d %4s%1s%3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
        F.when(F.col("is_special_atom").cast("boolean"), "HETATM").otherwise("ATOM"), F.col("serial_id").cast("long"), name,
        F.when(F.col("indicator") == ".", " ").otherwise(F.col("indicator")), F.coalesce("component_id", F.lit("")),
        F.coalesce("chain_id", F.lit("")), F.coalesce(F.col("sequence_id").cast("long"), F.lit(-1)), F.col("x").cast("double"),
        F.col("y").cast("double"), F.col("z").cast("double"), F.col("occupancy").cast("double"), b.cast("double"),
        F.coalesce("element", F.lit(""))
    )
    return atoms.select("serial_id", line.alias("value"))


def write_text(lines: DataFrame, path: str, order: str = "serial_id", head: list[str] | None = None, tail: list[str] | None = None) -> None:
    """Ordered text in the folder ``path``: its part files in the order of their names, as many as the text has ranges."""
    spark = lines.sparkSession
    n = len(head or [])
    before = spark.createDataFrame([(0, i, t) for i, t in enumerate(head or [])], "part int, o long, value string")
    after = spark.createDataFrame([(2, i + n, t) for i, t in enumerate(tail or [])], "part int, o long, value string")
    body = lines.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("o"), "value")
    rows = before.unionAll(body).unionAll(after).repartitionByRange("part", "o").sortWithinPartitions("part", "o")
    rows.select("value").write.mode("overwrite").text(path)


def write_texts(lines: DataFrame, key: str, order: str, path: str, head: str = "", tail: str = "") -> None:
    """One text file for each ``key`` in a folder of its own (key=...), its lines by ``order``; all keys in one job."""
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))), lambda x: x["v"]), "\n"
    )
    lines.groupBy(key).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def cif_head() -> list[str]:
    return ["data_export", "loop_", *[f"_atom_site.{c}" for c in CIF_COLUMNS]]


def outlier_list(posterior: DataFrame, atoms: DataFrame) -> DataFrame:
    return posterior.where("is_outlier").join(atoms, "serial_id").select(
        F.col("serial_id").alias("SerialID"), F.col("class_key").alias("ClassType"), F.col("component_id").alias("Residue"),
        F.col("element").alias("Element"), F.col("atom_id").alias("Spot")
    )


def position_list(atoms: DataFrame) -> DataFrame:
    return atoms.select(
        F.col("serial_id").alias("SerialID"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"),
        F.col("component_id").alias("Residue"), F.col("element").alias("Element"), F.col("atom_id").alias("Spot")
    )


def map_value_list(voxels: DataFrame, grid, atoms: DataFrame, margin: float = 3.0) -> DataFrame:
    """Positive voxels within the atoms' box widened by ``margin``."""
    b = atoms.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    v = voxels.where("value > 0").select(
        F.col("gid").alias("GridID"), *[p.alias(c.upper()) for p, c in zip(grid.position(F.col("gid")), "xyz")],
        F.col("value").alias("MapValue")
    )
    if b["lx"] is None:
        return v.limit(0)
    for c in "xyz":
        v = v.where(F.col(c.upper()).between(b[f"l{c}"] - margin, b[f"h{c}"] + margin))
    return v


def local_list(atoms: DataFrame, local: DataFrame) -> DataFrame:
    return atoms.join(local, "serial_id").select(
        F.col("serial_id").alias("SerialID"), F.col("amplitude").alias("Amplitude"), F.col("width").alias("Width"), F.col("x").alias("X"),
        F.col("y").alias("Y"), F.col("z").alias("Z"), F.col("component_id").alias("Residue"), F.col("element").alias("Element"),
        F.col("atom_id").alias("Spot")
    )


def group_list(groups: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Groups in the order of a catalogue (ordinal, component_id, atom_id, group_key); absent groups are left out."""
    return catalogue.join(groups, "group_key").orderBy("ordinal").select(
        F.col("component_id").alias("Residue"), F.col("atom_id").alias("Spot"), F.col("amplitude").alias("Amplitude"),
        F.col("width").alias("Width")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a head in the folder ``path``, a file for each partition; an ordered frame keeps its order over the files."""
    df.write.mode("overwrite").csv(path, header=True)


def marker_lines(points: DataFrame, order: str, radius: float = 0.1, rgb: tuple[float, float, float] = (1.0, 1.0, 0.0)) -> DataFrame:
    """Marker elements numbered by ``order``; write_text() with marker_ends() makes the file. Runs jobs."""
    return numbered(points, [], [order], "id").select(
        "id",
        F.format_string(
            f'<marker id="%d" x="%.4f" y="%.4f" z="%.4f" r="{rgb[0]}" g="{rgb[1]}" b="{rgb[2]}" radius="{radius}"/>', "id", "x", "y", "z"
        ).alias("value")
    )


def marker_ends(name: str) -> tuple[list[str], list[str]]:
    return [f'<marker_set name="{name}">'], ["</marker_set>"]
