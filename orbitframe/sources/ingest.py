"""Structure and result files as tables: many files in one job, one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.input_file_name().alias("file"))


def _cut(start: int, end: int) -> Column:
    return F.trim(F.substring("value", start + 1, end - start))


def ingest_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms by fixed columns; a blank chain is A. Lines that are no ATOM or HETATM are left out."""
    rows = _lines(spark, path).filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    return rows.select(
        "file",
        _cut(6, 11).try_cast("int").alias("serial"),
        _cut(12, 16).alias("name"),
        _cut(17, 20).alias("resname"),
        F.when(_cut(21, 22) == "", "A").otherwise(_cut(21, 22)).alias("chain"),
        _cut(22, 26).try_cast("int").alias("residue"),
        *[_cut(a, a + 8).try_cast("double").alias(n) for a, n in ((30, "x"), (38, "y"), (46, "z"))],
        _cut(54, 60).try_cast("double").alias("occupancy"),
        _cut(60, 66).try_cast("double").alias("b_factor"),
        _cut(76, 78).alias("element"),
        (F.substring("value", 1, 6) == "HETATM").alias("is_hetero"),
    )


def ingest_pdb_cell(spark: SparkSession, path: str) -> DataFrame:
    """Cell lengths and angles per file, from CRYST1."""
    rows = _lines(spark, path).filter(F.substring("value", 1, 6) == "CRYST1")
    spans = [(6, 15, "lx"), (15, 24, "ly"), (24, 33, "lz"), (33, 40, "alpha"), (40, 47, "beta"), (47, 54, "gamma")]
    return rows.select("file", *[_cut(a, b).try_cast("double").alias(n) for a, b, n in spans])


def ingest_gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of fixed-width GRO files in angstrom; each file is read whole, so that its lines can be numbered."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"), F.size(F.split(F.rtrim("value"), "\n")).alias("n"))
    rows = files.filter((F.col("line") >= 2) & (F.length("value") >= 44))
    return rows.select("file", _cut(0, 5).try_cast("int").alias("residue"), _cut(5, 10).alias("resname"), _cut(10, 15).alias("name"), _cut(15, 20).try_cast("int").alias("serial"), *[(_cut(a, a + 8).try_cast("double") * 10).alias(n) for a, n in ((20, "x"), (28, "y"), (36, "z"))])


def ingest_conect(spark: SparkSession, path: str) -> DataFrame:
    """Bonds from CONECT records; the order follows from how often both directions name the bond."""
    rows = _lines(spark, path).filter(F.substring("value", 1, 6) == "CONECT")
    ends = rows.select("file", _cut(6, 11).try_cast("int").alias("a"), F.explode(F.array(*[_cut(a, a + 5).try_cast("int") for a in (11, 16, 21, 26)])).alias("b")).filter("b is not null and a <> b")
    counted = ends.groupBy("file", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("file", "i", "j", F.when(F.col("n") >= 6, 3).when(F.col("n") >= 4, 2).otherwise(1).alias("bond_order"))


HITS = "query string, target string, identity double, length int, mismatch int, gapopen int, qstart int, qend int, tstart int, tend int, evalue double, bits double, tm double"


def ingest_alignment_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits; comments and rows that don't fit are left out."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=HITS, mode="PERMISSIVE")
    return rows.filter("bits is not null and target is not null")


def hits_filter_join(hits: DataFrame, targets: DataFrame, evalue: float, identity: float) -> DataFrame:
    return hits.filter((F.col("evalue") <= evalue) & (F.col("identity") >= identity)).join(targets, "target")


def ingest_pocket_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pocket tables whose header names vary."""
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip().lower().replace(" ", "_"): c for c in df.columns}

    def pick(*choices: str) -> Column:
        found = [F.col(f"`{names[c]}`") for c in choices if c in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.select(
        pick("rank", "pocket_id", "id", "name").alias("pocket_id"),
        pick("score", "pocket_score").try_cast("double").alias("score"),
        pick("probability", "prob").try_cast("double").alias("probability"),
        *[pick(f"center_{n}", n).try_cast("double").alias(n) for n in "xyz"],
        F.split(F.trim(pick("residue_ids", "residues")), r"\s+").alias("residue_ids"),
    )


def _bare(part: int) -> Column:
    return F.regexp_replace(F.get(F.split("value", ":", 2), F.lit(part - 1)), r"^\s+|\s+$", "")


def ingest_pocket_info(spark: SparkSession, path: str) -> DataFrame:
    """Blocks 'Pocket N :' of 'key : value' lines as (file, pocket, key, value)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    header = F.regexp_extract("value", r"^\s*Pocket\s+(\d+)\s*:", 1)
    w = Window.partitionBy("file").orderBy("line")
    rows = files.withColumn("pocket", F.last(F.when(header != "", header.cast("int")), ignorenulls=True).over(w)).filter((header == "") & F.col("pocket").isNotNull() & F.contains("value", F.lit(":")))
    return rows.select("file", "pocket", _bare(1).alias("key"), _bare(2).try_cast("double").alias("value"))


SEGMENTS = "array<struct<chain:string,unp_start:int,unp_end:int,pdb_start:int>>"


def ingest_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """Sequence-to-structure segments {"accession", "length", "segments"} as one row per residue."""
    rows = spark.read.schema(f"accession string, length int, segments {SEGMENTS}").json(path, multiLine=True)
    spans = rows.select("accession", "length", F.inline("segments"))
    return spans.select("accession", "length", "chain", F.explode(F.sequence("unp_start", "unp_end")).alias("position"), "unp_start", "pdb_start").select("accession", "length", "chain", "position", (F.col("pdb_start") + F.col("position") - F.col("unp_start")).alias("residue"))


def mapping_coverage(mapped: DataFrame) -> DataFrame:
    """Share in percent of a sequence's positions that are mapped, however often each. Positions are bits of words of 64, which tasks
    put together before the shuffle."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("position").bitwiseAND(63).cast("int"))
    words = mapped.groupBy("accession", "length", F.shiftright("position", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    n = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    return words.groupBy("accession", "length").agg((100.0 * n / F.col("length")).alias("coverage"))


def ingest_interaction_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = "resnr int, restype string, reschain string, dist_h_a double, dist_d_a double, don_angle double, donoridx int, acceptoridx int"
    return spark.read.format("xml").option("rowTag", "hydrogen_bond").schema(schema).load(path)


def folder_value(key: str) -> Column:
    """The value of key=value in a row's file path, for files in a folder per value."""
    return F.regexp_extract("file", f"{key}=([^/]*)", 1)


def verify_provenance(spark: SparkSession, path: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """Size and digest of files against a manifest (name, size_bytes, sha256). A file's name is the end of its path unless given as an
    expression of the column `path`."""
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name.alias("name"), F.col("length").alias("size_found"), F.sha2("content", 256).alias("sha256_found"))
    rows = manifest.join(files, "name", "full_outer")
    return rows.select("name", F.when(F.col("sha256").isNull(), "UNLISTED").when(F.col("sha256_found").isNull(), "MISSING").when((F.col("size_bytes") == F.col("size_found")) & (F.col("sha256") == F.col("sha256_found")), "OK").otherwise("CHANGED").alias("status"))


#: Positions of a stretch: what a feature is copied for.
STRETCH = 64


def uniprot_features_join(features: DataFrame, residues: DataFrame) -> DataFrame:
    """Feature ranges (accession, kind, begin, end) on mapped residues: a range stands in each stretch of positions that it touches, so that
    the range join is an equi-join. Spark takes the copies for as large as the ranges, and would broadcast them."""
    at = lambda n: F.floor(F.col(n) / STRETCH)
    spread = features.filter("begin <= end").select("accession", "kind", "begin", "end", F.explode(F.sequence(at("begin"), at("end"))).alias("stretch"))
    return residues.withColumn("stretch", at("position")).join(spread.hint("merge"), ["accession", "stretch"]).filter("position BETWEEN begin AND end").drop("stretch", "begin", "end")
