"""SQL that gives the rows of the queries p1, p3, p4 and p5 another way."""

from __future__ import annotations


def _cif(name: str) -> str:
    return f"toks[list_position(column_name_list, '_atom_site.{name}')]"


_NUM = "'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'"
_ATOM = """'[A-Z0-9''"*]([A-Z0-9''"* ]{0,2}[A-Z0-9''"*])?'"""
_TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def _full(x: str, form: str) -> str:
    return f"regexp_full_match(coalesce({x}, ''), {form})"


def _or_missing(x: str, form: str) -> str:
    return f"(coalesce({x}, '') in ('', '.', '?') or {_full(x, form)})"


def _pdb(a: int, b: int) -> str:
    return f"trim(substr(txt, {a}, {b - a + 1}), {_TRIM})"


P1_REASONS = f"""
with rec as (
  select r.*, l.column_name_list, coalesce(raw_text, '') as body, regexp_replace(coalesce(raw_text, ''), '\\r$', '') as txt
  from raw_record r left join raw_loop l on r.file_name = l.file_name and r.loop_no = l.loop_no
), cut as (
  select *, list_transform(regexp_extract_all(body, '''([^'']|''+[^\\s''])*''+(\\s|$)|"([^"]|"+[^\\s"])*"+(\\s|$)|[^\\s]+'), lambda x: rtrim(x, {_TRIM})) as parts
from rec
), tok as (
  select *, len(list_filter(parts, lambda x: x[1] in ('''', '"') and (len(x) < 2 or x[-1] <> x[1]))) > 0 as is_open,
    list_transform(parts, lambda x: case when x[1] in ('''', '"') then x[2:-2] else x end) as toks from cut
), judged as (
  select record_id, file_name, line_number, case
    when source_format = 'cif' then case
      when is_open then 'quoting'
      when len(toks) <> coalesce(len(column_name_list), -1) then 'column_count'
      when not (
        coalesce({_cif("group_PDB")}, '') in ('ATOM', 'HETATM') and {_full(_cif("id"), "'[+-]?[0-9]+'")}
        and {_full(f"trim(coalesce({_cif('label_atom_id')}, {_cif('auth_atom_id')}), {_TRIM})", _ATOM)}
        and {_full(_cif("Cartn_x"), _NUM)} and {_full(_cif("Cartn_y"), _NUM)} and {_full(_cif("Cartn_z"), _NUM)}
        and {_or_missing(_cif("occupancy"), _NUM)} and {_or_missing(_cif("B_iso_or_equiv"), _NUM)}
        and {_or_missing(_cif("type_symbol"), "'[A-Za-z]{1,2}'")} and {_or_missing(_cif("pdbx_PDB_model_num"), "'[+-]?[0-9]+'")}
      ) then 'bad_value' end
    when source_format = 'pdb' and substr(txt, 1, 6) in ('ATOM  ', 'HETATM') then case
      when length(txt) < 78 then 'column_count'
      when not (
        {_full(_pdb(7, 11), "'[+-]?[0-9]+'")} and {_full(_pdb(23, 26), "'[+-]?[0-9]+'")} and {_full(_pdb(13, 16), _ATOM)}
        and {_full(_pdb(31, 38), _NUM)} and {_full(_pdb(39, 46), _NUM)} and {_full(_pdb(47, 54), _NUM)}
        and ({_pdb(55, 60)} = '' or {_full(_pdb(55, 60), _NUM)}) and ({_pdb(61, 66)} = '' or {_full(_pdb(61, 66), _NUM)})
        and ({_pdb(77, 78)} = '' or {_full(_pdb(77, 78), "'[A-Za-z]{1,2}'")})
      ) then 'bad_value' end
    end as reason, toks, column_name_list, txt, source_format, loop_no from tok
)"""


def _atom_row() -> str:
    """Typed columns of a record that doesn't fail."""
    def pick(cif: list[str], pdb: tuple[int, int] | None) -> str:
        c = "coalesce(" + ", ".join(_cif(n) for n in cif) + ")" if len(cif) > 1 else _cif(cif[0])
        return f"nullif(case when source_format = 'cif' then {c} else {_pdb(*pdb) if pdb else 'null'} end, '')"

    def number(x: str, kind: str = "double") -> str:
        return f"try_cast(nullif(nullif({x}, '.'), '?') as {kind})"

    coordinates = [f"{number(pick([f'Cartn_{c}'], p))} as position_{c}" for c, p in (("x", (31, 38)), ("y", (39, 46)), ("z", (47, 54)))]
    symbol = pick(["type_symbol"], (77, 78))
    return ", ".join([
        "record_id", "file_name", "source_format", "loop_no", "line_number", f"{pick(['group_PDB'], (1, 6))} as group_pdb",
        f"{number(pick(['id'], (7, 11)), 'bigint')} as serial_id",
        f"trim({pick(['label_atom_id', 'auth_atom_id'], (13, 16))}, {_TRIM}) as atom_id",
        f"{pick(['label_alt_id'], (17, 17))} as indicator", f"{pick(['label_comp_id', 'auth_comp_id'], (18, 20))} as component_id",
        f"{pick(['label_asym_id', 'auth_asym_id'], (22, 22))} as chain_id",
        f"{pick(['label_seq_id', 'auth_seq_id'], (23, 26))} as sequence_id", *coordinates,
        f"coalesce({number(pick(['occupancy'], (55, 60)))}, 1.0) as occupancy",
        f"coalesce({number(pick(['B_iso_or_equiv'], (61, 66)))}, 0.0) as temperature",
        f"nullif(nullif({symbol}, '.'), '?') as element_symbol",
        f"coalesce({number(pick(['pdbx_PDB_model_num'], None), 'bigint')}, 1) as model_number",
    ])


_VALID = {
    "map_resolution": "map_resolution between 0.5 and 50 and not isnan(map_resolution)",
    "emd_id": "regexp_full_match(emd_id, 'EMD-[0-9]{4,6}|X-RAY DIFF')",
    "resolution_method": "resolution_method in (select m.resolution_method from method_code m)",
    "occupancy": "occupancy between 0 and 1 and not isnan(occupancy)",
}
_TABLE = {"map_resolution": "model_object", "emd_id": "model_object", "resolution_method": "model_object", "occupancy": "model_atom"}


def _p4() -> str:
    out = [
        f"select '{_TABLE[c]}' as table_name, '{c}' as column_name, 'value' as kind, row_id as ref_id from {_TABLE[c]} where {c} is not null and not ({v})" for c,
        v in _VALID.items()
    ]
    for c, v in _VALID.items():
        t = _TABLE[c]
        gap = {"map_resolution": 0.75, "occupancy": 0.10}.get(c)
        mean = f"avg({c}) filter ({v})" if gap else "0"
        or_mean = f" or abs(b.m - a.m) > {gap}" if gap else ""
        or_share = ""
        if c == "resolution_method":
            or_share = f""" or (
              select sum(abs(coalesce(y.s, 0) - coalesce(x.s, 0))) / 2 from (select {c} as k, count(*) / sum(count(*)) over () as s from {t}
where load_id = 1 and {v} group by 1) x
              full join (select {c} as k, count(*) / sum(count(*)) over () as s from {t} where load_id = b.load_id and {v} group by 1) y on x.k = y.k) > 0.25"""
        out.append(
            f"""select '{t}', '{c}', 'shift', b.load_id::bigint from
            (select load_id, count(*) as n, avg(({c} is null)::int) as nulls, {mean} as m from {t} group by 1) b,
            (select count(*) as n, avg(({c} is null)::int) as nulls, {mean} as m from {t} where load_id = 1) a
            where b.load_id >= 2 and a.n >= 20 and b.n >= 20 and (abs(b.nulls - a.nulls) > 0.15{or_mean}{or_share})"""
        )
    return " union all ".join(f"({x})" for x in out)


def _gaps() -> str:
    out = []
    for t, columns in _COLUMNS.items():
        for c in (x.rstrip("*@") for x in columns.split()):
            if c in ("row_id", "load_id", "loaded_at"):
                continue
            mean = f"avg({c}) filter ({_VALID[c]})" if c in ("map_resolution", "occupancy") else "null::double"
            share = "null::double"
            if c == "resolution_method":
                of = f"select {c} as k, count(*) / sum(count(*)) over () as s from {t} where load_id = "
                share = f"""(select sum(abs(coalesce(y.s, 0) - coalesce(x.s, 0))) / 2 from ({of} 1 and {_VALID[c]} group by 1) x
                full join ({of} b.load_id and {_VALID[c]} group by 1) y on x.k = y.k)"""
            load = f"select load_id, count(*) as n, avg(({c} is null)::int) as nulls, {mean} as m from {t} group by 1"
            out.append(
                f"""select '{t}' as table_name, '{c}' as column_name, b.load_id::bigint as load_id, b.n, round(b.nulls - a.nulls, 9) as null_gap,
                round(b.m - a.m, 9) as mean_gap, round({share}, 9) as share_gap from ({load}) b, ({load}) a
                where a.load_id = 1 and b.load_id > 1 and a.n >= 20 and b.n >= 20"""
            )
    return " union all ".join(f"({x})" for x in out)


_COLUMNS = {
    "model_object": "row_id key_tag* atom_size pdb_id* emd_id* map_resolution resolution_method* load_id loaded_at@",
    "model_atom": "row_id key_tag* serial_id sequence_id component_id* atom_id* chain_id* indicator* occupancy temperature element structure is_special_atom position_x position_y position_z component_key atom_key load_id loaded_at@",
}


def _profile() -> str:
    out = []
    for t, columns in _COLUMNS.items():
        for c in columns.split():
            kind, c = c[-1], c.rstrip("*@")
            number = {"*": "null::double", "@": f"epoch({c})"}.get(kind, f"{c}::double")
            text = c if kind == "*" else "null::varchar"
            broken = f"count(*) filter ({c} is not null and not ({_VALID[c]}))" if _TABLE.get(c) == t else "0"
            out.append(
                f"""select '{t}' as table_name, '{c}' as column_name, count(*) as n_rows, count(*) filter ({c} is null) as n_null, count(distinct {c}) as n_distinct, min({number}) as min_number, max({number}) as max_number,
                min({text}) as min_text, max({text}) as max_text, {broken}::bigint as n_broken, coalesce((select max(k) from (select count(*) as k
from {t} where {c} is not null group by {c})), 0) as top_count from {t}"""
            )
    return " union all ".join(f"({x})" for x in out)


def _orphans(
    child: str, column: str, keys: list[str], parent: str, parent_keys: list[str], deleted: bool, where: str = "true", strict: bool = False
) -> str:
    on = " and ".join(f"p.{b} = c.{a}" for a, b in zip(keys, parent_keys))
    gone = "p.deleted_at is not null and p.deleted_at <= c.loaded_at" if deleted else "false"
    here = " and ".join(f"c.{a} is not null" for a in keys)
    kinds = f"""case when not exists (select 1 from {parent} p where {on}) then 'missing'""" + ("" if strict else f"""
      when not exists (select 1 from {parent} p where {on} and not ({gone})) then 'deleted'
      when not exists (select 1 from {parent} p where {on} and not ({gone}) and p.loaded_at <= c.loaded_at) then 'late'""") + " end"  # fmt: skip
    return f"select '{child}' as child_table, '{column}' as child_column, row_id, loaded_at, {kinds} as kind from {child} c where {where} and {here}"


P5 = "with found as (select * from (" + " union all ".join([
    _orphans("model_object", "key_tag", ["key_tag"], "object_catalog", ["key_tag"], True),
    _orphans("object_catalog", "key_tag", ["key_tag"], "model_object", ["key_tag"], False, "object_type = 'model'", True),
    _orphans("model_atom", "component_key", ["key_tag", "component_key"], "model_component", ["key_tag", "component_key"], True),
    _orphans("model_component_atom", "component_key", ["key_tag", "component_key"], "model_component", ["key_tag", "component_key"], True),
    _orphans("model_bond", "atom_serial_id_1", ["key_tag", "atom_serial_id_1"], "model_atom", ["key_tag", "serial_id"], False),
    _orphans("model_bond", "atom_serial_id_2", ["key_tag", "atom_serial_id_2"], "model_atom", ["key_tag", "serial_id"], False),
]) + ") where kind is not null)"

_KEYS = " union all ".join(
    f"select '{c}' as column_name, {c}::varchar as key_value, occupancy, temperature from model_atom" for c in ("component_id", "element")
)


def _stat(v: str) -> str:
    ok = f"filter ({v} is not null and not isnan({v}))"
    return f"count(*) {ok} as {v}_n, count(*) filter (isnan({v})) as {v}_nan, round(avg({v}) {ok}, 6) as {v}_mean, min({v}) {ok} as {v}_min, max({v}) {ok} as {v}_max"


SQL = {
    "p1_found": P1_REASONS + " select record_id, reason from judged where reason is not null",
    "p1_atoms": P1_REASONS + f" select {_atom_row()} from judged where reason is null and (source_format = 'cif' or substr(txt, 1, 6) in ('ATOM  ', 'HETATM'))",
    "p1_rejects": P1_REASONS + " select file_name, line_number, record_id, reason from judged where reason is not null",
    "p3_found": f"select column_name, key_value from ({_KEYS}) where key_value is not null group by all having count(*) * 100 >= 8 * (select count(*) from model_atom)",
    "p3_stats": f"select column_name, key_value, count(*) as n_rows, {_stat('occupancy')}, {_stat('temperature')} from ({_KEYS}) group by all",
    "p4_found": _p4(),
    "p4_gaps": _gaps(),
    "p4_profile": _profile(),
    "p5_found": P5 + " select child_table, child_column, row_id, kind from found",
    "p5_by_month": P5 + " select child_table, child_column, kind, strftime(loaded_at, '%Y-%m') as month, count(*) as n_orphans from found group by all",
}
