"""Sequences, keys, digests, identifiers and metadata as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of amino acids.
AMINO_LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def reverse_complement(seq: Column) -> Column:
    """Upper case without white space, complemented and reversed; unknown letters become N."""
    s = F.regexp_replace(F.upper(F.regexp_replace(seq, r"\s+", "")), "[^ACGT]", "N")
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def validate_sequence(seq: Column, least: int = 5, most: int = 2000) -> tuple[Column, Column]:
    """(status, number of letters that are no amino acid)."""
    bad = F.length(F.regexp_replace(seq, f"[{AMINO_LETTERS}]", ""))
    return F.when(F.length(seq) < least, "TOO_SHORT").when(F.length(seq) > most, "TOO_LONG").when(bad > 0, "BAD_LETTERS").otherwise("VALID"), bad


#: White space, letters of amino acids in either case with the two that have one as their capital, nucleic alphabets.
WHITE = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITE_LETTERS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
AMINO_ANY = f"{AMINO_LETTERS}{AMINO_LETTERS.lower()}\u0131\u017f"
NUCLEIC = {"DNA": "ACGTN", "RNA": "ACGUN", "ANY": "ACGTUIN"}


def validate_fasta(raw: Column, least: int = 5, most: int = 2000, headers: bool = True) -> Column:
    """struct(status, header, sequence, n_residues, n_bad, bad) of a raw protein sequence, with or without a header line.

    status is the first that applies of EMPTY, HEADER_NOT_ALLOWED, HEADER_ONLY, NO_RESIDUES, BAD_LETTERS, TOO_SHORT, TOO_LONG, VALID. White
    space counts nowhere. bad names the first five letters that are no amino acid, by place from 1, and how many more there are;
    sequence is there for VALID ones only."""
    bare = lambda c: F.btrim(c, F.lit(WHITE_LETTERS))
    known, other = f"[{AMINO_ANY}]", f"[^{AMINO_ANY}]"
    text = bare(F.coalesce(raw, F.lit("")))
    titled, end = F.startswith(text, F.lit(">")), F.instr(text, "\n")
    header = F.when(titled & (end > 0), bare(F.substr(text, F.lit(2), end - 2)))
    body = F.regexp_replace(F.when(titled & (end > 0), F.substr(text, end + 1)).when(titled, "").otherwise(text), f"[{WHITE}]+", "")

    def counted(x: Column) -> Column:
        return F.struct(*[x[n].alias(n) for n in ("empty", "titled", "header", "body")], F.length(x["body"]).alias("n"), F.length(F.regexp_replace(x["body"], f"{known}+", "")).alias("n_bad"))

    def judged(x: Column) -> Column:
        n, n_bad = x["n"], x["n_bad"]

        def named(k: int) -> Column:
            """The bad letter after k others; no more of the sequence is read than what is before it."""
            found = lambda group: F.regexp_extract(x["body"], f"^((?:{known}*+{other}){{{k}}}{known}*+)({other})", group)
            return F.when(n_bad > k, F.concat(F.lit("'"), found(2), F.lit("' at position "), (F.length(found(1)) + 1).cast("string")))

        bad = F.concat(F.array_join(F.array(*map(named, range(5))), ", "), F.when(n_bad > 5, F.concat(F.lit(" (+"), (n_bad - 5).cast("string"), F.lit(" more)"))).otherwise(""))
        status = F.when(x["empty"], "EMPTY").when(x["titled"] & F.lit(not headers), "HEADER_NOT_ALLOWED").when(x["titled"] & x["header"].isNull(), "HEADER_ONLY").when(n == 0, "NO_RESIDUES")
        status = status.when(n_bad > 0, "BAD_LETTERS").when(n < least, "TOO_SHORT").when(n > most, "TOO_LONG").otherwise("VALID")
        return F.struct(status.alias("status"), x["header"].alias("header"), F.when(status == "VALID", F.upper(x["body"])).alias("sequence"), n.alias("n_residues"), n_bad.alias("n_bad"), F.when(n_bad > 0, bad).alias("bad"))

    # A function of an array's one element reads what is made once; a column's expression would be made again wherever it stands.
    given = F.struct((F.length(text) == 0).alias("empty"), titled.alias("titled"), header.alias("header"), body.alias("body"))
    return F.get(F.transform(F.transform(F.array(given), counted), judged), F.lit(0))


def validate_nucleic(seq: Column, mode: str = "ANY") -> tuple[Column, Column]:
    """(whether all letters are of the mode's alphabet, the sequence in capitals without white space); an empty one is not valid."""
    clean = F.upper(F.regexp_replace(F.coalesce(seq, F.lit("")), f"[{WHITE}]+", ""))
    return clean.rlike(f"^[{NUCLEIC[mode]}]+$"), clean


def sequence_identity(a: Column, b: Column) -> Column:
    """Equal letters at equal positions of the common prefix, over the longer length."""
    n = F.least(F.length(a), F.length(b))
    hits = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, hits / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def periodicity(seq: Column, lag: int = 7) -> Column:
    """Share of positions whose letter comes again `lag` further on: equal letters of the sequence and its shifted self."""
    n = F.length(seq) - lag
    hits = F.aggregate(F.zip_with(F.split(F.substring(seq, 1, 1 << 30), ""), F.split(F.substr(seq, F.lit(lag + 1)), ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, hits / n).otherwise(0.0)


def polynomial_hash(seq: Column, base: int = 31, modulus: int = 2_147_483_647) -> Column:
    return F.aggregate(F.split(seq, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * base + F.ascii(c)) % modulus))


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def atom_key(chain: str, residue: str, name: str) -> Column:
    return F.concat_ws(":", chain, F.col(residue).cast("string"), name)


def bond_key(a: Column, b: Column) -> Column:
    """The same for both directions."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def fixed(value: Column, places: int) -> Column:
    """A double in so many decimals, as C's printf rounds it: by its exact binary value, a tie to the even digit. format_string rounds the
    shortest decimal instead, so that 1.0005, which is a little less in binary, becomes 1.001."""
    # The halves of a double have few enough bits for their products with the scale to be exact, so that signs of the sums below are.
    x, scale = value.cast("double"), 10.0**places
    high = x.cast("float").cast("double")
    a, b = high * scale, (x - high) * scale
    n = F.rint(a + b)
    odd = F.abs(n) % 2 == 1
    over, under = (a - (n + 0.5)) + b, (a - (n - 0.5)) + b
    digits = F.abs(F.when((over > 0) | ((over == 0) & odd), n + 1).when((under < 0) | ((under == 0) & odd), n - 1).otherwise(n)).cast("long")
    unit = F.lit(10**places).cast("long")
    # The sign of zero counts as well.
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    text = F.concat(sign, F.format_string(f"%d.%0{places}d", F.floor(digits / unit).cast("long"), digits % unit))
    return F.when(F.abs(x) < 2.0**31, text).otherwise(F.format_string(f"%.{places}f", x))


#: Methods in the order in which their words are looked for.
METHODS = {
    "NEUTRON_DIFFRACTION": ["NEUTRON"],
    "ELECTRON_CRYSTALLOGRAPHY": ["ELECTRON CRYSTALLOGRAPHY"],
    "ELECTRON_MICROSCOPY": ["ELECTRON MICROSCOPY", "CRYO-EM", "CRYO EM"],
    "SOLUTION_NMR": ["SOLUTION NMR"],
    "SOLID_STATE_NMR": ["SOLID-STATE NMR", "SOLID STATE NMR", "SSNMR"],
    "SOLUTION_NMR ": ["NMR"],
    "X_RAY_DIFFRACTION": ["X-RAY", "DIFFRACTION", "SYNCHROTRON"],
    "COMPUTED_PREDICTION": ["ALPHAFOLD", "ESMFOLD", "PREDICTION", "COMPUTED", "IN SILICO", "DEEP LEARNING"],
}
KINDS_OF_MODELS = {"predicted": "COMPUTED_PREDICTION", "designed": "DE_NOVO_DESIGN", "synthetic": "SYNTHETIC_BENCHMARK", "trajectory": "SYNTHETIC_BENCHMARK"}
WITH_RESOLUTION = ["X_RAY_DIFFRACTION", "ELECTRON_MICROSCOPY", "NEUTRON_DIFFRACTION", "ELECTRON_CRYSTALLOGRAPHY"]
WITH_RFACTOR = ["X_RAY_DIFFRACTION", "NEUTRON_DIFFRACTION"]


def _mentions(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def classify_method(text: Column, kind: Column | None = None) -> Column:
    """The method that made a structure, by the kind of model if it says so, else by the words of its description."""
    t = F.upper(text)
    kinds = [F.when(kind == k, v) for k, v in KINDS_OF_MODELS.items()] if kind is not None else []
    return F.coalesce(*kinds, *[F.when(_mentions(t, words), name.strip()) for name, words in METHODS.items()], F.lit("UNKNOWN"))


def first_number(text: Column) -> Column:
    n = F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1)
    return F.when(n != "", n.cast("double"))


def parse_resolution(text: Column, method: Column) -> Column:
    """Angstrom to two places, over 0 and under 30; null for methods without a diffraction limit and for confidence scores."""
    value = first_number(text)
    fits = method.isin(WITH_RESOLUTION) & ~F.upper(text).rlike("PLDDT|SCORE") & (value > 0) & (value < 30)
    return F.when(fits, F.round(value, 2))


def parse_rfactor(text: Column, method: Column) -> Column:
    """A fraction to four places, percent taken as such; null where it does not apply."""
    value = first_number(text)
    share = F.when(value > 1, value / 100).otherwise(value)
    return F.when(method.isin(WITH_RFACTOR) & share.between(0, 1), F.round(share, 4))


def rfactor_note(work: Column, free: Column, year: Column) -> Column:
    """ATYPICAL if the free R-factor is under the working one, else VALID; without a free one, whether it came too early for it."""
    return F.when(free < work, "ATYPICAL").when(free.isNotNull() & work.isNotNull(), "VALID").when(free.isNull() & (year < 1992), "PREDATES_R_FREE").when(free.isNull(), "NOT_RECORDED").otherwise("VALID")


def parse_number(text: Column, low: float, high: float) -> Column:
    """The first number in a text, null outside the range."""
    value = first_number(text)
    return F.when(value.between(low, high), value)


def normalize_accession(text: Column, kind: Column) -> Column:
    """A structure code, a protein accession (also of a predicted model's id) or a model archive id, by kind; null if it is none.

    Structure codes have four characters or are extended ones, of which only the code counts."""
    t = F.trim(text)
    up = F.upper(t)
    code = F.when(up.rlike("^PDB_0000.{4}$"), F.substring(up, 9, 4)).otherwise(F.regexp_replace(up, "^PDB_", ""))
    structure = F.when(up.rlike("^([0-9A-Z]{4}|PDB_[0-9A-Z]{4,28})$"), code)
    protein = F.when(up.rlike("^AF-[A-Z0-9]{6,10}(-[0-9]+)?-F[0-9]+$"), F.regexp_extract(up, "^AF-(.*)-F[0-9]+$", 1)).when(up.rlike("^[A-Z0-9]{6,10}(-[0-9]+)?$"), up)
    return F.when(kind == "structure", structure).when(kind == "protein", protein).when((kind == "archive") & t.rlike("^ma-[a-z0-9-]{1,32}$"), t)


def classify_mutation(code: Column, wild: Column, tag: Column) -> Column:
    return F.when(tag, "EXPRESSION_TAG").when(code == wild, "WILD_TYPE").otherwise("NATURAL_VARIANT")


#: States by the number of copies, and words that tell of software.
OLIGOMERS = {2: "dimer", 4: "tetramer", 6: "hexamer"}
SOFTWARE_WORDS = ["PISA", "PQS", "SOFTWARE", "PREDICTED", "ALGORITHM"]


def oligomer_label(n: Column) -> Column:
    """The state by the number of copies, monomer where none is named."""
    return F.coalesce(*[F.when(n == k, w) for k, w in OLIGOMERS.items()], F.lit("monomer"))


def assembly_origin(details: Column) -> Column:
    return F.when(_mentions(F.upper(F.coalesce(details, F.lit(""))), SOFTWARE_WORDS), "software").otherwise("author")


def stoichiometry(n: Column) -> Column:
    return F.when(n > 1, F.concat(F.lit("A"), n.cast("string"))).otherwise("A")


def trajectory_authenticity(synthetic: Column, engine: Column, temperature: Column, pressure: Column) -> Column:
    """A real simulation names its engine and has a finite temperature or pressure on record."""
    known = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (temperature, pressure)]
    real = (F.coalesce(engine, F.lit("")) != "") & (known[0] | known[1])
    return F.when(F.coalesce(synthetic, F.lit(False)), "SYNTHETIC_COORDINATE_TRAJECTORY").when(real, "REAL_MD_SIMULATION").otherwise("UNKNOWN")


def unverifiable_claims(synthetic: Column, force_field: Column, ensemble: Column, temperature: Column, coordinates_only: Column) -> Column:
    """What a trajectory's record asserts but cannot show, as an array: a force field or an ensemble beside bare coordinates, and a
    temperature that was not recorded. Synthetic trajectories claim nothing."""
    real, bare = ~F.coalesce(synthetic, F.lit(False)), F.coalesce(coordinates_only, F.lit(False))
    known = F.coalesce(temperature.isNotNull() & ~F.isnan(temperature) & (F.abs(temperature) < float("inf")), F.lit(False))
    said = {"FORCE_FIELD": bare & (F.coalesce(force_field, F.lit("")) != ""), "ENSEMBLE": bare & (F.coalesce(ensemble, F.lit("")) != ""), "TEMPERATURE": ~known}
    return F.array_compact(F.array(*[F.when(real & c, k) for k, c in said.items()]))
