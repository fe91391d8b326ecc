"""Structure files of the loop-and-item kind: parsed to rows by category, then projected to entity tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.strings import float_prefix, int_prefix, missing_to_null
from gridloom.operators.rejects import tokens

ROWS = "path string, category string, row_no int, values map<string,string>"
# Marks of hydrogen and of the primary alternate location; id of structures without a map.
HYDROGEN = ("H", "D")
PRIMARY = (".", "A")
NO_MAP = "X-RAY DIFF"
#: Category of the rows that tell of incomplete ones.
INCOMPLETE = "!incomplete"


def _stream(text: str) -> Iterator[tuple[str, bool]]:
    """Tokens with whether they are data for sure (quoted or multi-line)."""
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.startswith(";"):
            block = [line[1:]]
            i += 1
            while i < len(lines) and not lines[i].startswith(";"):
                block.append(lines[i])
                i += 1
            rest = lines[i][1:] if i < len(lines) else ""
            yield "\n".join(block), True
            i += 1
            for t in tokens(rest) or []:
                yield t, False
            continue
        i += 1
        if line.lstrip().startswith("#"):
            yield "#", False
            continue
        found = tokens(line)
        if found is None:
            found = line.split()
        plain = line.split()
        quoted = len(plain) != len(found) or any(a != b for a, b in zip(plain, found))
        for t in found:
            yield t, quoted and not t.startswith("_")


def parse_document(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(category, row_no, values) of every loop row and of each category's single items (row_no 0).

    A loop's rows may run over several lines; a ``#`` line, a new loop, block or item ends it. A last row with too few values
    isn't a row of its category but one of INCOMPLETE. Categories and names are without the leading underscore.
    """
    items: dict[str, dict[str, str]] = {}
    names: list[str] = []
    values: list[str] = []
    count: dict[str, int] = {}
    state, key = "", ""

    def rows() -> Iterator[tuple[str, int, dict[str, str]]]:
        n = len(names)
        for at in range(0, len(values) - n + 1, n) if n else ():
            category = names[0].partition(".")[0]
            count[category] = count.get(category, 0) + 1
            yield category, count[category], {c.partition(".")[2]: v for c, v in zip(names, values[at : at + n])}
        if n and len(values) % n:
            count[INCOMPLETE] = count.get(INCOMPLETE, 0) + 1
            left = values[len(values) - len(values) % n :]
            yield INCOMPLETE, count[INCOMPLETE], {
                "category": names[0].partition(".")[0], "n_columns": str(n), "n_values": str(len(left)), "first": left[0]
            }

    for token, data in _stream(text):
        low = token.lower()
        if not data and (low == "loop_" or low == "#" or low.startswith("data_") or token.startswith("_") and not (state == "names")):
            yield from rows()
            names, values = [], []
            if low == "loop_":
                state = "names"
            elif token.startswith("_"):
                state, key = "item", token[1:]
            else:
                state = ""
        elif state == "names" and not data and token.startswith("_"):
            names.append(token[1:])
        elif state in ("names", "values"):
            state = "values"
            values.append(token)
        elif state == "item":
            category, _, name = key.partition(".")
            items.setdefault(category, {})[name] = token
            state = ""
    yield from rows()
    for category, found in items.items():
        yield category, 0, found


def parse_texts(docs: DataFrame) -> DataFrame:
    """All rows of whole documents (path, value): path, category, row_no, values. A document must be parsed in order, so it is
    the unit of work; documents are spread over all tasks. Null documents have no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["value"]):
                out = list(parse_document(text or ""))
                yield pd.DataFrame(
                    {"path": path, "category": [c for c, _, _ in out], "row_no": [n for _, n, _ in out], "values": [v for _, _, v in out]}
                )

    return docs.select("path", "value").mapInPandas(run, ROWS)


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """parse_texts() of files."""
    return parse_texts(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def _get(*names: str) -> Column:
    """First of the named values that isn't missing."""
    return F.coalesce(*[missing_to_null(F.try_element_at("values", F.lit(n))) for n in names])


def category(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a category: its loop rows, or its single items where it has no loop."""
    c = rows.where(F.col("category") == name)
    loops = c.where("row_no > 0").select("path").distinct()
    return c.where("row_no > 0").unionByName(c.where("row_no = 0").join(loops, "path", "left_anti"))


def incomplete_rows(rows: DataFrame) -> DataFrame:
    """Last rows of loops that have too few values: path, category, n_columns, n_values, first (their first value)."""
    c = rows.where(F.col("category") == INCOMPLETE)
    get = lambda n: F.try_element_at("values", F.lit(n))
    return c.select(
        "path", get("category").alias("category"), get("n_columns").cast("int").alias("n_columns"),
        get("n_values").cast("int").alias("n_values"), get("first").alias("first")
    )


def entry_ids(rows: DataFrame) -> DataFrame:
    """path, pdb_id, emd_id; structures without a map entry have the fixed id."""
    c = category(rows, "database_2").select("path", _get("database_id").alias("k"), _get("database_code").alias("v"))
    ids = c.groupBy("path").agg(
        F.max(F.when(F.col("k") == "PDB", F.col("v"))).alias("pdb_id"), F.max(F.when(F.col("k") == "EMDB", F.col("v"))).alias("emd_id")
    )
    return rows.select("path").distinct().join(ids, "path", "left").select(
        "path", "pdb_id", F.coalesce("emd_id", F.lit(NO_MAP)).alias("emd_id")
    )


def chain_map(rows: DataFrame) -> DataFrame:
    """path, entity_id, chain_ordinal (from 0, file order), chain_id of entities that are declared."""
    e = category(rows, "entity").select("path", _get("id").alias("entity_id")).distinct()
    s = category(rows, "struct_asym").select("path", "row_no", _get("id").alias("chain_id"), _get("entity_id").alias("entity_id"))
    order = F.row_number().over(W.partitionBy("path", "entity_id").orderBy("row_no")) - 1
    return s.join(e, ["path", "entity_id"], "left_semi").select("path", "entity_id", order.alias("chain_ordinal"), "chain_id")


def resolution(rows: DataFrame) -> DataFrame:
    """path, map_resolution, resolution_method: of the reconstruction, else of the refinement."""
    em = category(rows, "em_3d_reconstruction").groupBy("path").agg(
        F.min_by(float_prefix(_get("resolution")), "row_no").alias("er"), F.min_by(_get("resolution_method"), "row_no").alias("em")
    )
    xr = category(rows, "refine").groupBy("path").agg(F.min_by(float_prefix(_get("ls_d_res_high")), "row_no").alias("xr"))
    ex = category(rows, "exptl").groupBy("path").agg(F.min_by(_get("method"), "row_no").alias("xm"))
    j = rows.select("path").distinct().join(em, "path", "left").join(xr, "path", "left").join(ex, "path", "left")
    return j.select("path", F.coalesce("er", "xr").alias("map_resolution"), F.coalesce("em", "xm").alias("resolution_method"))


def secondary_ranges(rows: DataFrame) -> DataFrame:
    """path, range_id, label (HELX, SHEET), priority, chain_1, chain_2, low, high; rows without both numbers are skipped."""
    cols = [
        "path", "row_no", F.coalesce(_get("beg_label_asym_id"), _get("beg_auth_asym_id")).alias("chain_1"),
        F.coalesce(_get("end_label_asym_id"), _get("end_auth_asym_id")).alias("chain_2"),
        int_prefix(_get("beg_label_seq_id", "beg_auth_seq_id")).alias("low"),
        int_prefix(_get("end_label_seq_id", "end_auth_seq_id")).alias("high")
    ]
    h = category(rows, "struct_conf").select(*cols, _get("id").alias("range_id"), F.lit("HELX").alias("label"), F.lit(1).alias("priority"))
    s = category(rows, "struct_sheet_range").select(
        *cols, F.concat(F.coalesce(_get("sheet_id"), F.lit("")), F.coalesce(_get("id"), F.lit(""))).alias("range_id"),
        F.lit("SHEET").alias("label"), F.lit(2).alias("priority")
    )
    return h.unionByName(s).where("low is not null and high is not null").drop("row_no")


def components(rows: DataFrame) -> DataFrame:
    return category(rows, "chem_comp").select(
        "path", _get("id").alias("id"), _get("name").alias("name"), _get("type").alias("type"), _get("formula").alias("formula"),
        float_prefix(_get("formula_weight")).alias("molecular_weight"),
        (F.lower(_get("mon_nstd_flag")) == "y").cast("int").alias("is_standard_monomer")
    )


def component_atoms(rows: DataFrame) -> DataFrame:
    return category(rows, "chem_comp_atom").select(
        "path", _get("comp_id").alias("component_id"), _get("atom_id").alias("atom_id"), _get("type_symbol").alias("element"),
        _get("pdbx_aromatic_flag").alias("aromatic_flag"), _get("pdbx_stereo_config").alias("stereo_config")
    )


def component_bonds(rows: DataFrame) -> DataFrame:
    return category(rows, "chem_comp_bond").select(
        "path", _get("comp_id").alias("component_id"), _get("atom_id_1").alias("atom_1"), _get("atom_id_2").alias("atom_2"),
        _get("value_order").alias("bond_order"), _get("pdbx_aromatic_flag").alias("aromatic_flag")
    )


def all_atoms(rows: DataFrame) -> DataFrame:
    """Atom rows with label names (else auth names) and defaults: occupancy 1, temperature 0, model 1, sequence -1, serial =
    row number. Rows without atom id or coordinates, and hydrogens, are dropped."""
    a = category(rows, "atom_site").select(
        "path", "row_no", (_get("group_PDB") == "HETATM").alias("is_special_atom"),
        F.coalesce(int_prefix(_get("id")), F.col("row_no").cast("long")).alias("serial_id"), _get("type_symbol").alias("element"),
        _get("label_atom_id", "auth_atom_id").alias("atom_id"),
        F.coalesce(F.try_element_at("values", F.lit("label_alt_id")), F.lit(".")).alias("indicator"),
        _get("label_comp_id", "auth_comp_id").alias("component_id"), _get("label_asym_id", "auth_asym_id").alias("chain_id"),
        F.coalesce(int_prefix(_get("label_seq_id", "auth_seq_id")), F.lit(-1)).alias("sequence_id"),
        _get("label_seq_id", "auth_seq_id").alias("sequence_token"), *[float_prefix(_get(f"Cartn_{c}")).alias(c) for c in "xyz"],
        F.coalesce(float_prefix(_get("occupancy")), F.lit(1.0)).alias("occupancy"),
        F.coalesce(float_prefix(_get("B_iso_or_equiv")), F.lit(0.0)).alias("temperature"),
        F.coalesce(int_prefix(_get("pdbx_PDB_model_num")), F.lit(1)).alias("model_number"),
    )
    return a.where(
        F.col("atom_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & ~F.coalesce(
            F.upper("element").isin(*HYDROGEN), F.lit(False)
        )
    )


def merge_alternates(atoms: DataFrame) -> DataFrame:
    """Alternate locations folded into their primary atom as a map indicator -> (x, y, z, occupancy, temperature).

    A row marked ``.`` or ``A`` is an atom of its own; another joins the latest one before it of the same model, chain,
    component, sequence and name, or becomes an atom if there is none. Of several rows of one indicator the one of least
    coordinates counts.
    """
    w = W.partitionBy("path", "model_number", "chain_id", "component_id", "sequence_id", "atom_id").orderBy("row_no")
    lead = F.col("indicator").isin(*PRIMARY) | (F.row_number().over(w) == 1)
    a = atoms.withColumn("__lead", lead).withColumn("__n", F.sum(F.col("__lead").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    key = ["path", "model_number", "chain_id", "component_id", "sequence_id", "atom_id", "__n"]
    rest = [c for c in atoms.columns if c not in key]
    alt = F.struct("indicator", F.struct("x", "y", "z", "occupancy", "temperature"))
    g = a.groupBy(*key).agg(
        F.min_by(F.struct(*rest), "row_no").alias("__a"), F.sort_array(F.collect_list(F.when(~F.col("__lead"), alt))).alias("__alts")
    )
    # the map needs distinct keys: of repeated rows the first in order counts
    first = lambda x, i: F.array_position(F.transform("__alts", lambda a: a["indicator"]), x["indicator"]) == i + 1
    return g.select(
        *[c for c in key if c != "__n"], "__a.*", F.map_from_entries(F.filter("__alts", first)).alias("alternates")
    ).select(*atoms.columns, "alternates")


def of_model(atoms: DataFrame, preferred: int = 1) -> DataFrame:
    """The atoms of the preferred model of each file, else of its lowest."""
    m = atoms.groupBy("path").agg(
        F.coalesce(F.max(F.when(F.col("model_number") == preferred, preferred)), F.min("model_number")).alias("__m")
    )
    return atoms.join(m, "path").where("model_number = __m").drop("__m")


def connections(rows: DataFrame, atoms: DataFrame) -> DataFrame:
    """Declared bonds: path, atom_serial_id_1, atom_serial_id_2, bond_type, bond_order. Hydrogen bonds, partners that no atom
    matches and pairs of different models are skipped; partners match by their sequence token."""
    c = category(rows, "struct_conn").where(~F.coalesce(F.lower(_get("conn_type_id")) == "hydrog", F.lit(False)))
    end = lambda k: [
        F.coalesce(
            _get(f"ptnr{k}_label_{n}"), _get(f"ptnr{k}_auth_{n}")
        ).alias(f"{n}_{k}") for n in ("asym_id", "comp_id", "atom_id", "seq_id")
    ]
    c = c.select("path", "row_no", _get("conn_type_id").alias("bond_type"), _get("pdbx_value_order").alias("bond_order"), *end(1), *end(2))
    for k in (1, 2):
        t = atoms.groupBy(
            "path", F.col("chain_id").alias(f"asym_id_{k}"), F.col("component_id").alias(f"comp_id_{k}"),
            F.col("atom_id").alias(f"atom_id_{k}"), F.coalesce("sequence_token", F.lit("")).alias(f"__s{k}")
        ).agg(F.min(F.struct("model_number", "serial_id")).alias(f"__a{k}"))
        c = c.withColumn(f"__s{k}", F.coalesce(f"seq_id_{k}", F.lit(""))).join(
            t, ["path", f"asym_id_{k}", f"comp_id_{k}", f"atom_id_{k}", f"__s{k}"]
        )
    return c.where("__a1.model_number = __a2.model_number").select(
        "path", F.col("__a1.serial_id").alias("atom_serial_id_1"), F.col("__a2.serial_id").alias("atom_serial_id_2"), "bond_type",
        "bond_order"
    )


def read_model(spark: SparkSession, paths: str | list[str], preferred_model: int = 1) -> dict[str, DataFrame]:
    """The entity tables of structure files."""
    rows = read_rows(spark, paths)
    atoms = of_model(merge_alternates(all_atoms(rows)), preferred_model)
    return {
        "entry": entry_ids(rows).join(resolution(rows), "path"), "chain_map": chain_map(rows), "atom": atoms, "component": components(rows),
        "component_atom": component_atoms(rows), "component_bond": component_bonds(rows), "secondary": secondary_ranges(rows),
        "connection": connections(rows, atoms), "incomplete": incomplete_rows(rows)
    }
