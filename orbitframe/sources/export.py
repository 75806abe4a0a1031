"""Tables as structure files, sequences and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.text import csv_safe, fixed
from orbitframe.operators.selection import one_letter


def pdb_lines(atoms: DataFrame, serial: str = "serial", keep: list[str] | None = None) -> DataFrame:
    """value: an 80-column ATOM or HETATM record per atom."""
    number = lambda c, width, places: F.lpad(fixed(F.col(c), places), width, " ")
    name = F.rpad(F.when(F.length("name") < 4, F.concat(F.lit(" "), "name")).otherwise(F.col("name")), 4, " ")
    line: list[Column] = [
        F.when(F.col("is_hetero"), "HETATM").otherwise("ATOM  "), F.lpad(F.col(serial).cast("string"), 5, " "), F.lit(" "), name, F.lit(" "),
        F.lpad("resname", 3, " "), F.lit(" "), F.col("chain"), F.lpad(F.col("residue").cast("string"), 4, " "), F.lit("    "),
        number("x", 8, 3), number("y", 8, 3), number("z", 8, 3), number("occupancy", 6, 2), number("b_factor", 6, 2), F.lit(" " * 10), F.lpad("element", 2, " "), F.lit("  "),
    ]
    return atoms.select(F.concat(*line).alias("value"), F.col(serial).alias("serial"), *(keep or []))


def export_pdb(atoms: DataFrame, path: str, serial: str = "serial", by: list[str] | None = None) -> None:
    """Records in order of their serial numbers, in one folder or in one per values of columns. A folder is written by one task, so it
    should hold no more than the serial numbers can tell apart."""
    if by is None:
        pdb_lines(atoms, serial).orderBy("serial").select("value").write.text(path)
        return
    lines = pdb_lines(atoms, serial, by).repartition(*by).sortWithinPartitions(*by, "serial")
    lines.select("value", *by).write.partitionBy(*by).text(path)


def export_fasta(atoms: DataFrame, keys: list[str], width: int = 60) -> DataFrame:
    """Per chain the letters of its residues in order, in lines of 60."""
    rows = atoms.select(*keys, "chain", "residue", one_letter(F.col("resname")).alias("letter")).distinct()
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("residue", "letter"))), lambda x: x["letter"]), "")
    return rows.groupBy(*keys, "chain").agg(F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")).alias("sequence"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with text that no spreadsheet takes for a formula."""
    kinds = dict(df.dtypes)
    df.select(*[csv_safe(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns]).write.csv(path, header=True)


def export_gro(atoms: DataFrame, path: str, by: str, lengths: tuple[str, str, str] = ("lx", "ly", "lz")) -> None:
    """Fixed-width GRO text in nanometres, a folder per value of a column: title, number of atoms, atoms by serial, box."""
    nm = lambda c: F.lpad(F.format_string("%.3f", F.col(c) / 10), 8, " ")
    line = F.concat(F.lpad(F.col("residue").cast("string"), 5, " "), F.rpad("resname", 5, " "), F.lpad("name", 5, " "), F.lpad(F.col("serial").cast("string"), 5, " "), *[nm(n) for n in "xyz"])
    rows = atoms.groupBy(F.col(by).alias("folder_")).agg(F.array_sort(F.collect_list(F.struct("serial", line.alias("line")))).alias("a"), *[F.first(n).alias(n) for n in lengths])
    box = F.concat(*[F.lpad(F.format_string("%.5f", F.col(n) / 10), 10, " ") for n in lengths])
    text = F.concat_ws("\n", F.concat(F.lit("structure "), F.col("folder_").cast("string")), F.lpad(F.size("a").cast("string"), 5, " "), F.array_join(F.transform("a", lambda x: x["line"]), "\n"), box)
    rows.select(text.alias("value"), F.col("folder_").alias(by)).write.partitionBy(by).text(path)


def roundtrip_check(original: DataFrame, again: DataFrame, tolerance: float = 1e-3, keys: tuple[str, ...] = ("serial",)) -> DataFrame:
    """Whether an exported structure reads back: atoms on one side only, and the greatest difference."""
    a = original.select(*keys, *[F.col(n).alias(f"{n}_a") for n in "xyz"])
    joined = a.join(again.select(*keys, *"xyz"), list(keys), "full_outer")
    worst = F.max(F.greatest(*[F.abs(F.col(n) - F.col(f"{n}_a")) for n in "xyz"]))
    lost = F.count_if(F.col("x").isNull() | F.col("x_a").isNull())
    return joined.agg(F.count(F.lit(1)).alias("n"), lost.alias("n_unmatched"), worst.alias("max_diff")).withColumn("ok", (F.col("n_unmatched") == 0) & (F.col("max_diff") <= tolerance))
