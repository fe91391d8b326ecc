"""Queries that write and read files and stored tables: what comes back is compared with the tables it was written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grid, rejects
from gridloom.plans.data_queries import _r, _unique_atoms
from gridloom.plans.record_queries import _parsed
from gridloom.plans.record_sql import P1_REASONS, _cif, _pdb
from gridloom.session import materialize, scratch, table
from gridloom.sources import cif, exports, formats, maps, pdb
from gridloom.sources.store import Store, violations

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# structure files


def _loop(rows: DataFrame, path: str, order: str, category: str, columns: dict[str, Column]) -> DataFrame:
    """path, value: for each ``path`` a document of one loop, its rows by ``order``."""
    line = F.concat_ws(" ", *[exports.quoted(c.cast("string"), "?") for c in columns.values()])
    head = "\n".join(["data_x", "loop_", *[f"_{category}.{c}" for c in columns]]) + "\n"
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("v")))), lambda x: x["v"]), "\n"
    )
    return rows.groupBy(F.col(path).cast("string").alias("path")).agg(F.concat(F.lit(head), body, F.lit("\n#\n")).alias("value"))


@query(
    """select distinct file_name, case when regexp_matches(lower(file_name), '\\.(cif|mmcif|mcif)$') then 'cif' when regexp_matches(lower(file_name), '\\.pdb$') then 'pdb' when regexp_matches(lower(file_name), '\\.(mrc|map|ccp4)$') then 'map' end as kind from raw_record"""
)
def model_formats(spark: SparkSession, d: str) -> DataFrame:
    """The reader of each file by its extension."""
    return table(spark, d, "raw_record").select("file_name").distinct().withColumn("kind", formats.format_of(F.col("file_name")))


def _own(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(nullif(nullif({_cif(n)}, ''), '.'), '?')" for n in names) + ", null)"


@query(P1_REASONS + f""" select file_name, {_own('id')}::bigint as serial_id, {_own('label_atom_id', 'auth_atom_id')} as atom_id, {_own('label_comp_id', 'auth_comp_id')} as component_id, {_own('label_asym_id', 'auth_asym_id')} as chain_id,
coalesce(try_cast(regexp_extract({_own('label_seq_id', 'auth_seq_id')}, '^\\s*([+-]?\\d+)', 1) as bigint), -1) as sequence_id, {_cif('Cartn_x')}::double as x, {_cif('Cartn_y')}::double as y, coalesce({_own('occupancy')}::double, 1) as occupancy, coalesce({_own('B_iso_or_equiv')}::double, 0) as temperature, coalesce({_own('pdbx_PDB_model_num')}::bigint, 1) as model_number
from judged where reason is null and source_format = 'cif' and not coalesce(upper({_own('type_symbol')}) in ('H', 'D'), false)""")
def cif_file_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The valid raw records put back into files of loops, written, and read as structure files."""
    good = rejects.atoms(_parsed(spark, d)).where("source_format = 'cif'").select("record_id")
    lines = table(spark, d, "raw_record").join(good, "record_id", "left_semi").select(
        "file_name", "loop_no", "record_id", F.col("raw_text").alias("value")
    )
    heads = table(spark, d, "raw_loop").select(
        "file_name", "loop_no", F.lit(-1).cast("long").alias("record_id"),
        F.concat(F.lit("loop_\n"), F.array_join("column_name_list", "\n")).alias("value")
    )
    path = scratch(spark)
    exports.write_texts(
        heads.unionByName(lines).withColumn("at", F.struct("loop_no", "record_id")), "file_name", "at", path, "data_x\n", "\n#\n"
    )
    rows = cif.read_rows(spark, path).withColumn("path", F.regexp_extract("path", r"file_name=([^/]+)/", 1))
    a = cif.all_atoms(rows)
    return a.select(
        F.col("path").alias("file_name"), "serial_id", "atom_id", "component_id", "chain_id", "sequence_id", "x", "y", "occupancy",
        "temperature", "model_number"
    )


@query(P1_REASONS + f""" select file_name, line_number, {_pdb(7, 11)}::bigint as serial_id, {_pdb(13, 16)} as atom_id, {_pdb(18, 20)} as component_id, {_pdb(22, 22)} as chain_id, {_pdb(23, 26)}::bigint as sequence_id, {_pdb(31, 38)}::double as x, {_pdb(39, 46)}::double as y, {_pdb(47, 54)}::double as z,
coalesce(try_cast(nullif({_pdb(55, 60)}, '') as double), 1) as occupancy, coalesce(try_cast(nullif({_pdb(61, 66)}, '') as double), 0) as temperature, {_pdb(77, 78)} as element from judged where reason is null and source_format = 'pdb' and substr(txt, 1, 6) in ('ATOM  ', 'HETATM')""")
def pdb_file_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The valid fixed-width records as lines of their files."""
    good = rejects.atoms(_parsed(spark, d)).where("source_format = 'pdb'").select("record_id")
    lines = table(spark, d, "raw_record").join(good, "record_id", "left_semi").select(
        F.col("file_name").alias("path"), "line_number", F.regexp_replace("raw_text", r"\r$", "").alias("t")
    )
    return pdb.parse_lines(lines).select(
        F.col("path").alias("file_name"), "line_number", "serial_id", "atom_id", "component_id", "chain_id", "sequence_id", "x", "y", "z",
        "occupancy", "temperature", "element"
    )


@query(
    "select key_tag, nullif(id, '') as id, nullif(name, '') as name, nullif(type, '') as type, nullif(formula, '') as formula, molecular_weight, is_standard_monomer from model_component"
)
def cif_components(spark: SparkSession, d: str) -> DataFrame:
    """The component dictionary of each model as a document, parsed again."""
    c = table(spark, d, "model_component")
    flag = F.when(F.col("is_standard_monomer") == 1, "y").when(F.col("is_standard_monomer") == 0, "n")
    docs = _loop(
        c, "key_tag", "row_id", "chem_comp",
        {
            "id": F.col("id"), "name": F.col("name"), "type": F.col("type"), "formula": F.col("formula"),
            "formula_weight": F.col("molecular_weight"), "mon_nstd_flag": flag
        }
    )
    return cif.components(cif.parse_texts(docs)).withColumnRenamed("path", "key_tag")


@query(
    "select key_tag, component_key::varchar as component_id, nullif(atom_id, '') as atom_id, element_type::varchar as element, aromatic_atom_flag::varchar as aromatic_flag, stereo_config::varchar as stereo_config from model_component_atom"
)
def cif_component_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The atoms of the components as a document of each model, parsed again."""
    c = table(spark, d, "model_component_atom")
    docs = _loop(
        c, "key_tag", "row_id", "chem_comp_atom",
        {
            "comp_id": F.col("component_key"), "atom_id": F.col("atom_id"), "type_symbol": F.col("element_type"),
            "pdbx_aromatic_flag": F.col("aromatic_atom_flag"), "pdbx_stereo_config": F.col("stereo_config")
        }
    )
    return cif.component_atoms(cif.parse_texts(docs)).withColumnRenamed("path", "key_tag")


@query(
    "select key_tag, bond_key::varchar as component_id, atom_serial_id_1::varchar as atom_1, atom_serial_id_2::varchar as atom_2, bond_order::varchar as bond_order, is_special_bond::varchar as aromatic_flag from model_bond"
)
def cif_component_bonds(spark: SparkSession, d: str) -> DataFrame:
    """Bonds as a document of each model, parsed again."""
    b = table(spark, d, "model_bond")
    docs = _loop(
        b, "key_tag", "row_id", "chem_comp_bond",
        {
            "comp_id": F.col("bond_key"), "atom_id_1": F.col("atom_serial_id_1"), "atom_id_2": F.col("atom_serial_id_2"),
            "value_order": F.col("bond_order"), "pdbx_aromatic_flag": F.col("is_special_bond")
        }
    )
    return cif.component_bonds(cif.parse_texts(docs)).withColumnRenamed("path", "key_tag")


@query(
    """select row_id::varchar as row_id, nullif(pdb_id, '') as pdb_id, coalesce(nullif(emd_id, ''), 'X-RAY DIFF') as emd_id, case when isfinite(map_resolution) then map_resolution end as map_resolution, nullif(resolution_method, '') as resolution_method from model_object"""
)
def cif_entries(spark: SparkSession, d: str) -> DataFrame:
    """Ids and resolution of each entry as single items and a loop: of the reconstruction for every second row, else of the
    refinement."""
    m = table(spark, d, "model_object")
    q = lambda c: exports.quoted(F.col(c).cast("string"), "?")
    ids = F.concat(
        F.lit("data_x\nloop_\n_database_2.database_id\n_database_2.database_code\nPDB "), q("pdb_id"), F.lit("\nEMDB "), q("emd_id"),
        F.lit("\n#\n")
    )
    em = F.concat(
        F.lit("_em_3d_reconstruction.resolution "), q("map_resolution"), F.lit("\n_em_3d_reconstruction.resolution_method "),
        q("resolution_method"), F.lit("\n#\n")
    )
    xr = F.concat(F.lit("_refine.ls_d_res_high "), q("map_resolution"), F.lit("\n_exptl.method "), q("resolution_method"), F.lit("\n#\n"))
    docs = m.select(
        F.col("row_id").cast("string").alias("path"), F.concat(ids, F.when(F.col("row_id") % 2 == 0, em).otherwise(xr)).alias("value")
    )
    rows = materialize(cif.parse_texts(docs))
    return cif.entry_ids(rows).join(cif.resolution(rows), "path").withColumnRenamed("path", "row_id")


_CHAINS = "select key_tag, structure, chain_id, min(row_id) as first from model_atom where structure is not null and nullif(chain_id, '') is not null group by 1, 2, 3"


@query(
    f"select key_tag, structure::varchar as entity_id, (row_number() over (partition by key_tag, structure order by first) - 1)::int as chain_ordinal, chain_id from ({_CHAINS})"
)
def cif_chain_map(spark: SparkSession, d: str) -> DataFrame:
    """Chains of each entity (structure codes stand for entities) as loops of two categories, parsed again."""
    c = table(spark, d, "model_atom").where(
        "structure is not null and nullif(chain_id, '') is not null"
    ).groupBy("key_tag", "structure", "chain_id").agg(F.min("row_id").alias("first"))
    entity = _loop(
        c.select("key_tag", "structure").distinct(), "key_tag", "structure", "entity", {"id": F.col("structure"), "type": F.lit("polymer")}
    )
    asym = _loop(
        c, "key_tag", "first", "struct_asym", {"id": F.col("chain_id"), "entity_id": F.col("structure")}
    ).withColumnRenamed("value", "more")
    docs = entity.join(asym, "path").select("path", F.concat("value", "more").alias("value"))
    return cif.chain_map(materialize(cif.parse_texts(docs))).withColumnRenamed("path", "key_tag")


@query(
    """select key_tag, row_id::varchar as range_id, case when row_id % 2 = 0 then 'HELX' else 'SHEET' end as label, (1 + row_id % 2)::int as priority, nullif(id, '') as chain_1, component_key::bigint as low, (component_key + 5)::bigint as high from model_component where component_key is not null"""
)
def cif_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of helices (even rows) and sheets (odd rows) as loops, parsed again."""
    c = table(spark, d, "model_component")
    ends = {
        "beg_label_asym_id": F.col("id"), "end_label_asym_id": F.col("id"), "beg_label_seq_id": F.col("component_key"),
        "end_label_seq_id": F.col("component_key") + 5
    }
    helix = _loop(c.where("row_id % 2 = 0"), "key_tag", "row_id", "struct_conf", {"id": F.col("row_id"), **ends})
    sheet = _loop(c.where("row_id % 2 = 1"), "key_tag", "row_id", "struct_sheet_range", {"sheet_id": F.col("row_id"), **ends})
    return cif.secondary_ranges(materialize(cif.parse_texts(helix.unionByName(sheet)))).select(
        F.col("path").alias("key_tag"), "range_id", "label", "priority", "chain_1", "low", "high"
    )


def _atom_loop(a: DataFrame) -> DataFrame:
    """A document for each model with its atoms in row order, loads as model numbers."""
    return _loop(
        a, "key_tag", "row_id", "atom_site",
        {"group_PDB": F.when(F.col("is_special_atom") == 1, "HETATM").otherwise("ATOM"), "id": F.col("row_id"), "type_symbol": F.concat(F.lit("Z"), F.col("element").cast("string")), "label_atom_id": F.col("atom_id"), "label_alt_id": F.coalesce(F.nullif("indicator", F.lit("")), F.lit(".")),
         "label_comp_id": F.col("component_id"), "label_asym_id": F.col("chain_id"), "label_seq_id": F.col("sequence_id"), "Cartn_x": F.col("position_x"), "Cartn_y": F.col("position_y"), "Cartn_z": F.col("position_z"), "pdbx_PDB_model_num": F.col("load_id")},
    )


@query("""with a as (select key_tag, row_id, load_id, nullif(chain_id, '') as c, nullif(component_id, '') as n, coalesce(sequence_id, -1) as s, atom_id, coalesce(nullif(indicator, ''), '.') as ind
from model_atom where nullif(atom_id, '') is not null and position_x is not null and position_y is not null and position_z is not null),
m as (select key_tag, coalesce(max(load_id) filter (load_id = 1), min(load_id)) as load_id from a group by 1),
l as (select a.*, (ind in ('.', 'A') or row_number() over (partition by a.key_tag, a.load_id, c, n, s, atom_id order by row_id) = 1)::int as lead
from a join m on a.key_tag = m.key_tag and a.load_id = m.load_id),
g as (select *, sum(lead) over (partition by key_tag, c, n, s, atom_id order by row_id) as no from l)
select key_tag, min(row_id) as serial_id, atom_id, count(distinct ind) filter (lead = 0) as n_alternates from g group by key_tag, c, n, s, atom_id, no""")
def cif_alternates(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the first load (else the earliest) of each model with the number of alternate places folded into them."""
    rows = materialize(cif.parse_texts(_atom_loop(table(spark, d, "model_atom"))))
    a = cif.of_model(cif.merge_alternates(cif.all_atoms(rows)))
    return a.select(F.col("path").alias("key_tag"), "serial_id", "atom_id", F.size("alternates").cast("long").alias("n_alternates"))


_NAMED = "nullif(chain_id, '') as c, nullif(component_id, '') as n, nullif(atom_id, '') as t, coalesce(sequence_id::varchar, '') as s"


@query(f"""with u as (select m.* from model_atom m join (select key_tag, serial_id, min(row_id) as row_id from model_atom group by 1, 2) f on m.row_id = f.row_id),
a as (select key_tag, serial_id, {_NAMED} from u where position_x is not null and position_y is not null and position_z is not null and nullif(atom_id, '') is not null),
k as (select key_tag, c, n, t, s, min(serial_id) as hit from a where c is not null and n is not null group by 1, 2, 3, 4, 5)
select b.key_tag, k1.hit::bigint as atom_serial_id_1, k2.hit::bigint as atom_serial_id_2, b.bond_type::varchar as bond_type, b.bond_order::varchar as bond_order
from model_bond b
join a a1 on a1.key_tag = b.key_tag and a1.serial_id = b.atom_serial_id_1 join a a2 on a2.key_tag = b.key_tag and a2.serial_id = b.atom_serial_id_2
join k k1 on k1.key_tag = b.key_tag and (k1.c, k1.n, k1.t, k1.s) = (a1.c, a1.n, a1.t, a1.s) join k k2 on k2.key_tag = b.key_tag and (k2.c, k2.n, k2.t, k2.s) = (a2.c, a2.n, a2.t, a2.s)""")
def cif_connections(spark: SparkSession, d: str) -> DataFrame:
    """Bonds declared by the names of their ends, found again among the atoms of the same documents."""
    u = _unique_atoms(spark, d)
    atoms = u.where("position_x is not null and position_y is not null and position_z is not null and nullif(atom_id, '') is not null")
    sites = _loop(
        atoms, "key_tag", "serial_id", "atom_site",
        {
            "id": F.col("serial_id"), "label_atom_id": F.col("atom_id"), "label_comp_id": F.col("component_id"),
            "label_asym_id": F.col("chain_id"), "label_seq_id": F.col("sequence_id"), "Cartn_x": F.col("position_x"),
            "Cartn_y": F.col("position_y"), "Cartn_z": F.col("position_z")
        }
    )
    b = table(spark, d, "model_bond").select("key_tag", "row_id", "atom_serial_id_1", "atom_serial_id_2", "bond_type", "bond_order")
    for k in (1, 2):
        e = atoms.select(
            "key_tag", F.col("serial_id").alias(f"atom_serial_id_{k}"),
            *[F.col(c).alias(f"{c}_{k}") for c in ("chain_id", "component_id", "atom_id", "sequence_id")]
        )
        b = b.join(e, ["key_tag", f"atom_serial_id_{k}"])
    ends = {
        f"ptnr{k}_label_{n}": F.col(f"{c}_{k}") for k in (1, 2) for n,
        c in (("asym_id", "chain_id"), ("comp_id", "component_id"), ("atom_id", "atom_id"), ("seq_id", "sequence_id"))
    }
    links = _loop(
        b, "key_tag", "row_id", "struct_conn", {"conn_type_id": F.col("bond_type"), "pdbx_value_order": F.col("bond_order"), **ends}
    ).withColumnRenamed("value", "more")
    rows = materialize(cif.parse_texts(sites.join(links, "path").select("path", F.concat("value", "more").alias("value"))))
    return cif.connections(rows, materialize(cif.all_atoms(rows))).withColumnRenamed("path", "key_tag")


_WRITTEN = "position_x is not null and position_y is not null and position_z is not null and nullif(atom_id, '') is not null and element is not null and abs(occupancy) < 1e300"


def _writable(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "model_atom").where(F.expr(_WRITTEN))
    return a.select(
        "key_tag", F.col("row_id").alias("serial_id"), "is_special_atom",
        F.concat(F.lit("Z"), F.col("element").cast("string")).alias("element"), "atom_id", "indicator", "component_id", "chain_id",
        "sequence_id", *[F.col(f"position_{c}").alias(c) for c in "xyz"], "occupancy", F.lit(0.0).alias("temperature")
    )


@query(
    f"select key_tag, row_id as serial_id, atom_id, nullif(component_id, '') as component_id, nullif(chain_id, '') as chain_id, coalesce(sequence_id, -1)::bigint as sequence_id, round(position_x, 3) as x, round(position_z, 3) as z, round(occupancy, 3) as temperature from model_atom where {_WRITTEN}"
)
def cif_written_back(spark: SparkSession, d: str) -> DataFrame:
    """All atoms written as a file of each model, the occupancy in place of the temperature, and read again."""
    path, a = scratch(spark), _writable(spark, d)
    lines = exports.cif_lines(a, "occupancy").join(a.select("serial_id", "key_tag"), "serial_id")
    exports.write_texts(lines, "key_tag", "serial_id", path, "\n".join(exports.cif_head()) + "\n", "\n#\n")
    b = cif.all_atoms(cif.read_rows(spark, path))
    return b.select(
        F.regexp_extract("path", "key_tag=([^/]+)/", 1).alias("key_tag"), "serial_id", "atom_id", "component_id", "chain_id", "sequence_id",
        _r(F.col("x"), "x", 3), _r(F.col("z"), "z", 3), _r(F.col("temperature"), "temperature", 3)
    )


_FITS = "row_id < 100000 and length(atom_id) <= 4 and length(component_id) <= 3 and length(chain_id) <= 1 and sequence_id between -999 and 9999 and element < 10 and occupancy between 0 and 99 and length(coalesce(indicator, '')) <= 1"


@query(
    f"select key_tag, row_id as serial_id, trim(atom_id) as atom_id, trim(component_id) as component_id, chain_id, sequence_id::bigint as sequence_id, round(position_x, 3) as x, round(position_y, 3) as y, round(occupancy, 2) as temperature from model_atom where {_WRITTEN} and {_FITS} and component_id <> '' and chain_id <> ''"
)
def pdb_written_back(spark: SparkSession, d: str) -> DataFrame:
    """The atoms whose values fit the fixed columns, written as a file of each model and read again."""
    path = scratch(spark)
    a = _writable(spark, d).withColumnRenamed("serial_id", "row_id").withColumn(
        "indicator", F.coalesce(F.nullif("indicator", F.lit("")), F.lit("."))
    )
    a = a.where(
        F.expr(_FITS.replace("element < 10", "length(element) <= 2") + " and component_id <> '' and chain_id <> ''")
    ).withColumnRenamed("row_id", "serial_id")
    lines = exports.pdb_lines(a, "occupancy").join(a.select("serial_id", "key_tag"), "serial_id")
    exports.write_texts(lines, "key_tag", "serial_id", path, "", "\nEND")
    b = pdb.read_atoms(spark, path)
    return b.select(
        F.regexp_extract("path", "key_tag=([^/]+)/", 1).alias("key_tag"), "serial_id", "atom_id", "component_id", "chain_id", "sequence_id",
        _r(F.col("x"), "x", 3), _r(F.col("y"), "y", 3), _r(F.col("temperature"), "temperature", 2)
    )


# maps


def _map_back(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("gid"), "value")
    g = grid.Grid((100, 10, e.agg(F.max("gid")).first()[0] // 1000 + 1), (0.5, 1.0, 2.0), (-10.0, 0.0, 6.0))
    path = f"{scratch(spark)}/events{suffix}"  # inside the folder, so that release() takes it along
    maps.write_map(e, g, path)
    back, h = formats.read_map(spark, path)
    return back.select(
        "gid", "value", F.lit(h.size[2]).alias("nz"),
        *[F.lit(float(v)).alias(n) for n, v in (("dx", h.spacing[0]), ("ox", h.origin[0]), ("oz", h.origin[2]))]
    )


def _map_sql() -> str:
    return """with n as (select (max(event_id) // 1000 + 1)::int as nz
from events) select g.gid, coalesce(e.value, 0)::float as value, n.nz, 0.5::double as dx, -10.0::double as ox, 6.0::double as oz
    from n, (select unnest(range(1000 * (select nz from n)))::bigint as gid) g left join (select event_id, value from events) e on e.event_id = g.gid"""


@query(_map_sql())
def map_written_back(spark: SparkSession, d: str) -> DataFrame:
    """All events as a grid, written as a map file by the workers and read again by slabs."""
    return _map_back(spark, d, ".map")


@query(_map_sql())
def mrc_written_back(spark: SparkSession, d: str) -> DataFrame:
    """The same in the format whose origin is a position."""
    return _map_back(spark, d, ".mrc")


# stored tables


def _stored(spark: SparkSession, d: str) -> Store:
    s = Store(spark, scratch(spark))
    roots = table(spark, d, "model_object").groupBy("key_tag").agg(
        F.min_by(F.struct("atom_size", "pdb_id", "emd_id"), "row_id").alias("m")
    ).select("key_tag", "m.*")
    s.save_all(
        {
            "model_object": roots, "model_atom": _unique_atoms(spark, d),
            "model_bond": table(spark, d, "model_bond").groupBy(
                "key_tag", "atom_serial_id_1", "atom_serial_id_2"
            ).agg(F.min("row_id").alias("row_id"))
        },
        "model"
    )
    return s


@query(
    "select m.key_tag, m.serial_id, m.atom_id, m.position_x from model_atom m join (select key_tag, serial_id, min(row_id) as row_id from model_atom group by 1, 2) f on m.row_id = f.row_id where m.key_tag is not null"
)
def stored_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each atom, stored under its key and read back in the order of keys and serial ids."""
    return _stored(spark, d).table("model_atom").where("key_tag is not null").select(
        "key_tag", "serial_id", "atom_id", "position_x"
    ).orderBy("key_tag", "serial_id")


@query(
    "select key_tag, (row_number() over (order by key_tag))::int as place from (select distinct key_tag from model_object where key_tag is not null and key_tag <> (select min(key_tag) from model_object))"
)
def stored_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the store in order, after the first of them was deleted."""
    s = _stored(spark, d)
    s.delete([k for k in s.keys() if k is not None][0])
    return spark.createDataFrame(
        [(k, i) for i, k in enumerate((k for k in s.keys("model") if k is not None), 1)], "key_tag string, place int"
    )


def _violation_sql() -> str:
    keys = {
        "object_catalog": (), "model_object": (), "model_component": ("component_key",),
        "model_component_atom": ("component_key", "atom_key"), "model_atom": ("serial_id",),
        "model_bond": ("atom_serial_id_1", "atom_serial_id_2")
    }
    out = []
    for t, k in keys.items():
        by = ", ".join(("key_tag", *k))
        out.append(
            f"select '{t}' as table_name, 'primary_key' as rule, key_tag, sum(n)::bigint as n from (select {by}, count(*) as n from {t} group by {by} having count(*) > 1) group by key_tag"
        )
        if t != "object_catalog":
            out.append(
                f"select '{t}', 'no_catalog', key_tag, count(*) from {t} c where not exists (select 1 from object_catalog p where p.key_tag = c.key_tag) group by key_tag"
            )
    out.append(
        "select 'object_catalog', 'no_payload', key_tag, count(*) from object_catalog c where object_type = 'model' and not exists (select 1 from model_object p where p.key_tag = c.key_tag) group by key_tag"
    )
    out.append("select 'object_catalog', 'no_payload', key_tag, count(*) from object_catalog c where object_type = 'map' group by key_tag")
    for c in ("atom_serial_id_1", "atom_serial_id_2"):
        out.append(
            f"select 'model_bond', 'no_parent', key_tag, count(*) from model_bond b where not exists (select 1 from model_atom a where a.key_tag = b.key_tag and a.serial_id = b.{c}) group by key_tag"
        )
    return " union all ".join(f"({x})" for x in out)


@query(_violation_sql())
def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """Repeated keys, rows without a catalog entry, entries without rows and bonds without their atoms in the given tables."""
    names = ("object_catalog", "model_object", "model_component", "model_component_atom", "model_atom", "model_bond")
    return violations(spark, {n: table(spark, d, n) for n in names})


# result lists


def _named_atoms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_atom").select(
        F.col("row_id").alias("serial_id"), *[F.col(f"position_{c}").alias(c) for c in "xyz"], "component_id",
        F.col("element").cast("string").alias("element"), "atom_id", "temperature", "occupancy", "structure"
    )


@query(
    """select row_id as "SerialID", 'simple' as "ClassType", component_id as "Residue", element::varchar as "Element", atom_id as "Spot" from model_atom where temperature > 60 and not isnan(temperature)"""
)
def outlier_listing(spark: SparkSession, d: str) -> DataFrame:
    """Atoms marked as outliers (here by temperature) with their names."""
    a = _named_atoms(spark, d)
    post = a.select(
        "serial_id", F.lit("simple").alias("class_key"), ((F.col("temperature") > 60) & ~F.isnan("temperature")).alias("is_outlier")
    )
    return exports.outlier_list(post, a)


@query(
    """select row_id as "SerialID", position_x as "X", position_y as "Y", position_z as "Z", component_id as "Residue", element::varchar as "Element", atom_id as "Spot" from model_atom"""
)
def position_listing(spark: SparkSession, d: str) -> DataFrame:
    return exports.position_list(_named_atoms(spark, d))


@query(
    """select row_id as "SerialID", coalesce(occupancy, 0) * 2 as "Amplitude", structure / 4.0::double as "Width", position_x as "X", position_y as "Y", position_z as "Z", component_id as "Residue", element::varchar as "Element", atom_id as "Spot" from model_atom where abs(coalesce(occupancy, 0)) < 1e300"""
)
def local_listing(spark: SparkSession, d: str) -> DataFrame:
    """Amplitude and width (stood for by other columns) of each atom with its place and names."""
    a = _named_atoms(spark, d).where("abs(coalesce(occupancy, 0)) < 1e300")
    return exports.local_list(
        a,
        a.select(
            "serial_id", (F.coalesce("occupancy", F.lit(0.0)) * 2).alias("amplitude"), (F.col("structure") / F.lit(4.0)).alias("width")
        )
    )


@query(
    """select component_id as "Residue", atom_id as "Spot", count(*) as "Amplitude", round(avg(position_x), 6) as "Width" from model_atom where component_id in (select id from model_component) and atom_id is not null group by 1, 2"""
)
def group_listing(spark: SparkSession, d: str) -> DataFrame:
    """Groups of component and atom name in the order of their names; groups that the dictionary lacks are left out."""
    a = table(spark, d, "model_atom").where("component_id is not null and atom_id is not null").withColumn(
        "group_key", F.concat_ws("/", "component_id", "atom_id")
    )
    groups = a.groupBy("group_key").agg(F.count(F.lit(1)).alias("amplitude"), F.round(F.avg("position_x"), 6).alias("width"))
    known = table(spark, d, "model_component").select(F.col("id").alias("component_id")).distinct()
    names = a.select(
        "group_key", "component_id", "atom_id"
    ).distinct().join(known, "component_id", "left_semi").withColumn("ordinal", F.col("group_key"))
    return exports.group_list(groups, names)


@query("""with b as (select min(position_x) - 3 as lx, max(position_x) + 3 as hx, min(position_y) - 3 as ly, max(position_y) + 3 as hy, min(position_z) - 3 as lz, max(position_z) + 3 as hz
from model_atom where element = 8),
v as (select event_id as gid, event_id % 100 * 5.0::double as x, event_id // 100 % 10 * 40.0::double as y, event_id // 1000 * 4.0::double as z, value
from events where value > 0)
select gid as "GridID", x as "X", y as "Y", z as "Z", value as "MapValue" from v, b where x between lx and hx and y between ly and hy and z between lz and hz""")
def map_value_listing(spark: SparkSession, d: str) -> DataFrame:
    """Positive voxels of the event grid in the box of the oxygens."""
    e = table(spark, d, "events").select(F.col("event_id").alias("gid"), "value")
    g = grid.Grid((100, 10, 1000), (5.0, 40.0, 4.0))
    return exports.map_value_list(e, g, _named_atoms(spark, d).where("element = '8'"))


@query(
    """select row_number() over (order by row_id) as id, printf('<marker id="%d" x="%.4f" y="%.4f" z="%.4f" r="1.0" g="1.0" b="0.0" radius="0.1"/>', row_number() over (order by row_id), position_x, position_y, position_z) as value from model_atom where position_x is not null and position_y is not null and position_z is not null"""
)
def marker_listing(spark: SparkSession, d: str) -> DataFrame:
    """A marker element for each atom, numbered in row order."""
    p = table(spark, d, "model_atom").where("position_x is not null and position_y is not null and position_z is not null")
    return exports.marker_lines(p.select("row_id", *[F.col(f"position_{c}").alias(c) for c in "xyz"]), "row_id")
