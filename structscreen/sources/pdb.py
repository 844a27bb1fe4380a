"""Fixed-width atom records, mmCIF atom loops and multi-model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structscreen.sources.lines import id_of, running_model, with_line_idx

# --- fixed values: column layout of an atom record, (name, first column, width, type) --
ATOM_FIELDS = (
    ("record", 1, 6, "string"), ("atom_number", 7, 5, "int"), ("atom_name", 13, 4, "string"),
    ("altloc", 17, 1, "raw"), ("resname", 18, 3, "string"), ("chain", 22, 1, "raw"),
    ("resid", 23, 4, "int"), ("insertion", 27, 1, "raw"), ("x", 31, 8, "double"),
    ("y", 39, 8, "double"), ("z", 47, 8, "double"), ("occupancy", 55, 6, "double"),
    ("b_factor", 61, 6, "double"), ("element", 77, 2, "string"), ("charge", 79, 2, "string"),
)
WATER = ("HOH", "WAT")

ATOM_COLUMNS = (
    "model", "record", "atom_number", "atom_name", "altloc", "resname", "chain", "hetero",
    "resid", "insertion", "x", "y", "z", "occupancy", "b_factor", "element", "charge", "line_idx",
)


def atom_fields(line: Column) -> dict[str, Column]:
    out = {}
    for name, first, width, kind in ATOM_FIELDS:
        cut = F.substring(line, first, width)
        if kind == "string":
            cut = F.trim(cut)
        elif kind != "raw":
            cut = F.trim(cut).try_cast(kind)
        out[name] = cut
    return out


def hetero_flag(record: Column, resname: Column) -> Column:
    """' ' for polymer residues, 'W' for water, 'H_<name>' for other hetero groups."""
    return (
        F.when(record == "ATOM", F.lit(" "))
        .when(resname.isin(*WATER), F.lit("W"))
        .otherwise(F.concat(F.lit("H_"), resname))
    )


def parse_atom_lines(lines: DataFrame, by=("file",)) -> DataFrame:
    """Atom table from numbered lines (``line_idx``, ``line``)."""
    numbered = running_model(lines, by)
    atoms = numbered.where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    atoms = atoms.withColumns(atom_fields(F.col("line")))
    # an empty element column is read from the atom name, as structure parsers do
    guess = F.regexp_extract("atom_name", r"^[0-9]*([A-Za-z])", 1)
    atoms = atoms.withColumn("element", F.upper(F.when(F.col("element") == "", guess).otherwise(F.col("element"))))
    atoms = atoms.withColumn("hetero", hetero_flag(F.col("record"), F.col("resname")))
    return atoms.select(*by, *ATOM_COLUMNS)


def read_pdb(spark: SparkSession, paths, id_pattern: str | None = None) -> DataFrame:
    atoms = parse_atom_lines(with_line_idx(spark, paths))
    return atoms.select(id_of(F.col("file"), id_pattern).alias("structure_id"), *ATOM_COLUMNS)


def _fixed(value: Column, width: int, digits: int) -> Column:
    text = F.format_string(f"%{width}.{digits}f", value.cast("double"))
    return F.when(F.length(text) > width, F.trim(text)).otherwise(text)


def format_atom_line() -> Column:
    """80-column record from the columns of an atom table."""
    c = F.col
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(
        F.rpad("atom_name", 4, " ")
    )
    charge = F.coalesce(F.nullif(F.trim("charge"), F.lit("")), F.lit(""))
    line = F.concat(
        F.rpad("record", 6, " "), F.format_string("%5s", c("atom_number").cast("string")), F.lit(" "),
        name, F.rpad(F.coalesce("altloc", F.lit(" ")), 1, " "), F.lpad("resname", 3, " "), F.lit(" "),
        F.rpad("chain", 1, " "), F.format_string("%4s", c("resid").cast("string")),
        F.rpad(F.coalesce("insertion", F.lit(" ")), 1, " "), F.lit("   "),
        _fixed(c("x"), 8, 3), _fixed(c("y"), 8, 3), _fixed(c("z"), 8, 3),
        _fixed(c("occupancy"), 6, 2), _fixed(c("b_factor"), 6, 2), F.lit(" " * 10),
        F.lpad("element", 2, " "), charge,
    )
    # pad short lines, never cut long ones
    return F.when(F.length(line) < 80, F.rpad(line, 80, " ")).otherwise(line)


def pdb_lines(atoms: DataFrame, by=("structure_id",)) -> DataFrame:
    """Records plus MODEL/ENDMDL frames as ordered lines: (by, model, part, line_idx, line)."""
    body = atoms.select(*by, "model", F.lit(1).alias("part"), "line_idx", format_atom_line().alias("line"))
    models = atoms.select(*by, "model").distinct()
    frame = models.select(
        *by, "model",
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.concat(F.lit("MODEL "), F.col("model") + 1).alias("line")),
            F.struct(F.lit(2).alias("part"), F.lit("ENDMDL").alias("line")),
        )).alias("f"),
    ).select(*by, "model", "f.part", F.lit(0).cast("long").alias("line_idx"), "f.line")
    return body.unionByName(frame)


def write_pdb(atoms: DataFrame, path: str, by=("structure_id",), mode="errorifexists") -> None:
    """One text directory per structure, lines in record order."""
    by = list(by)
    lines = pdb_lines(atoms, by)
    (
        lines.repartition(*by)
        .sortWithinPartitions(*by, "model", "part", "line_idx")
        .select(*by, F.col("line").alias("value"))
        .write.mode(mode).partitionBy(*by).text(path)
    )


def rewrite_altloc_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Blank an 'A' alternate-location mark, drop lines with any other mark.

    Lines shorter than 17 characters stay as they are (the reference counts the line
    break as a character, so 16 visible characters or fewer).
    """
    mark = F.substring(line, 17, 1)
    kept = lines.where((F.length(line) < 17) | mark.isin("A", " "))
    fixed = F.when(
        (F.length(line) >= 17) & (mark == "A"), F.overlay(F.col(line), F.lit(" "), F.lit(17), F.lit(1))
    ).otherwise(F.col(line))
    return kept.withColumn(line, fixed)


def format_models(blocks: DataFrame, by=("structure_id",)) -> DataFrame:
    """Multi-model text per structure.

    Input: ``by``, part, step, repeat, line_idx, line.  Order: parts ascending, inside a
    part the steps >= 0 ascending, then the negative ones ascending; each block
    ``repeat`` times between MODEL and ENDMDL; CONECT lines only in the very first copy.
    Output rows are lines with their place, (``by``, copy_no, line_no, line): the text of
    one structure is never gathered in one row.
    """
    by = list(by)
    order = F.struct("part", (F.col("step") < 0).alias("negative"), "step")
    heads = blocks.groupBy(*by, order.alias("place")).agg(F.max("repeat").alias("repeat"))
    from structscreen.plans.skew import attach, over_groups

    numbered = over_groups(heads, by, ["place"], __upto=("sum", "repeat")).withColumn(
        "__from", F.col("__upto") - F.col("repeat") + 1
    )
    body = blocks.withColumn("place", order).select(*by, "place", "line_idx", "line")
    body = attach(body, numbered.drop("repeat"), [*by, "place"], "inner")
    body = body.select(*by, F.explode(F.sequence("__from", "__upto")).alias("copy_no"), "line_idx", "line").where(
        (F.col("copy_no") == 1) | ~F.contains("line", F.lit("CONECT"))
    ).select(*by, "copy_no", F.lit(1).alias("section"), F.col("line_idx").alias("line_no"), "line")
    frame = numbered.where("repeat > 0").select(
        *by, F.explode(F.sequence("__from", "__upto")).alias("copy_no"),
    ).select(
        *by, "copy_no",
        F.explode(F.array(
            F.struct(F.lit(0).alias("section"), F.lit("MODEL").alias("line")),
            F.struct(F.lit(2).alias("section"), F.lit("ENDMDL").alias("line")),
        )).alias("f"),
    ).select(*by, "copy_no", "f.section", F.lit(0).cast("long").alias("line_no"), "f.line")
    return body.unionByName(frame)


# ------------------------------------------------------------------------------- mmCIF
_CIF_SCHEMA_TAIL = (
    "model int, record string, atom_number int, atom_name string, altloc string, resname string, "
    "chain string, resid int, insertion string, x double, y double, z double, "
    "occupancy double, b_factor double, element string, charge string, line_idx long"
)
# --- fixed values: dictionary item behind each atom column, first match wins --------------
_CIF_ITEMS = {
    "model": ("pdbx_PDB_model_num",), "record": ("group_PDB",), "atom_number": ("id",),
    "atom_name": ("auth_atom_id", "label_atom_id"), "altloc": ("label_alt_id",),
    "resname": ("auth_comp_id", "label_comp_id"), "chain": ("auth_asym_id", "label_asym_id"),
    "resid": ("auth_seq_id", "label_seq_id"), "insertion": ("pdbx_PDB_ins_code",),
    "x": ("Cartn_x",), "y": ("Cartn_y",), "z": ("Cartn_z",), "occupancy": ("occupancy",),
    "b_factor": ("B_iso_or_equiv",), "element": ("type_symbol",), "charge": ("pdbx_formal_charge",),
}


def parse_cif_lines(lines: DataFrame, by=("file",)) -> DataFrame:
    """Atom table from the ``_atom_site`` loop of numbered mmCIF lines.

    The loop header gives each item its column number; rows are split on blanks with
    quoted values kept whole.  All of it is column work, so a file may be split.
    """
    by = list(by)
    from structscreen.plans.skew import attach, over_groups

    text = F.trim("line")
    is_item = text.startswith("_atom_site.")
    starts = F.when(is_item, F.lit(1)).when(
        text.startswith("loop_") | text.startswith("_") | text.startswith("#") | text.startswith("data_"), F.lit(0)
    )
    marked = over_groups(
        lines.withColumn("__mark", starts), by, ["line_idx"], __in=("ffill", "__mark")
    ).where(F.col("__in") == 1)
    items = marked.where(is_item).select(
        *by, "line_idx", F.regexp_extract("line", r"_atom_site\.(\S+)", 1).alias("item")
    )
    items = over_groups(items, by, ["line_idx"], at=("row_number",))
    wanted = [i for names in _CIF_ITEMS.values() for i in names]
    header = items.groupBy(*by).agg(  # at most one entry per dictionary item and file
        F.map_from_entries(
            F.collect_list(F.when(F.col("item").isin(wanted), F.struct("item", "at")))
        ).alias("cols")
    )
    rows = marked.where(~is_item & (text != "")).select(
        *by, "line_idx", F.regexp_extract_all("line", F.lit(r"('[^']*'|\"[^\"]*\"|\S+)"), F.lit(1)).alias("v")
    )
    rows = attach(rows, header, by, "inner")

    def value(names):
        found = F.coalesce(*[F.try_element_at("v", F.try_element_at("cols", F.lit(n)).cast("int")) for n in names])
        found = F.regexp_replace(found, "^['\"]|['\"]$", "")
        return F.when(found.isin(".", "?"), F.lit(None)).otherwise(found)

    types = dict(p.rsplit(" ", 1) for p in _CIF_SCHEMA_TAIL.split(", "))
    out = rows.select(
        *by, "line_idx",
        *[value(n).try_cast(types[c]).alias(c) for c, n in _CIF_ITEMS.items()],
    )
    out = out.withColumns({
        "model": F.coalesce(F.col("model") - 1, F.lit(0)),
        "altloc": F.coalesce("altloc", F.lit(" ")), "insertion": F.coalesce("insertion", F.lit(" ")),
        "element": F.upper("element"), "charge": F.coalesce("charge", F.lit("")),
        "hetero": hetero_flag(F.col("record"), F.col("resname")),
    })
    return out.select(*by, *ATOM_COLUMNS)


def read_mmcif(spark: SparkSession, paths, id_pattern: str | None = None) -> DataFrame:
    atoms = parse_cif_lines(with_line_idx(spark, paths))
    return atoms.select(id_of(F.col("file"), id_pattern).alias("structure_id"), *ATOM_COLUMNS)


__all__ = [
    "parse_atom_lines", "read_pdb", "pdb_lines", "write_pdb", "rewrite_altloc_lines", "format_models",
    "parse_cif_lines", "read_mmcif", "format_atom_line",
]
