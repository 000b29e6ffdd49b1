"""Structure files: a data source of atom rows and category rows, and crops of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token: quoted text, or what stands between blanks.
TOKEN = r"""'([^']*)'(?=\s|$)|"([^"]*)"(?=\s|$)|(\S+)"""


#: Where a file's blocks begin.
STARTS = r"(?m)^(?=loop_|#)"


def raw_cells(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(rf"({TOKEN})"), 1)


def bare(x: Column) -> Column:
    first = F.left(x, F.lit(1))
    quoted = (F.length(x) > 1) & first.isin("'", '"') & F.endswith(x, first)
    return F.when(x.isin(".", "?"), "").when(quoted, F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def cells(line: Column) -> Column:
    return F.transform(raw_cells(line), bare)


def blocks(texts: DataFrame, prefix: str) -> DataFrame:
    return texts.select("file", F.posexplode(F.split("text", STARTS)).alias("block", "body")).where(F.contains("body", F.lit(f"{prefix}.")))


def keyed(prefix: str) -> Column:
    return F.regexp_extract_all("body", F.lit(rf"(?m)^{prefix.replace('.', chr(92) + '.')}\.(\S+)"), 1)


def looped(found: DataFrame, prefix: str) -> DataFrame:
    """(file, n, keys, row) for each row of the loops among blocks."""
    rows = F.filter(F.split("body", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^(loop_|_|#)"))
    each = found.where(F.startswith("body", F.lit("loop_"))).select("file", "block", keyed(prefix).alias("keys"), F.posexplode(rows).alias("i", "row"))
    return each.select("file", (F.col("block").cast("long") * (1 << 32) + F.col("i")).alias("n"), "keys", "row")


def single(found: DataFrame, prefix: str) -> DataFrame:
    """(file, n, values: map) for each block that is no loop."""
    flat, keys = F.regexp_replace("body", r"\r?\n", " "), keyed(prefix)
    values = F.transform(F.regexp_extract_all(flat, F.lit(rf"{prefix}\.\S+\s+('[^']*'|\"[^\"]*\"|\S+)"), 1), lambda x: F.get(cells(x), 0))
    return found.where(~F.startswith("body", F.lit("loop_"))).select("file", (F.col("block").cast("long") * (1 << 32)).alias("n"), F.map_from_arrays(keys, F.slice(F.concat(values, F.array_repeat(F.lit(""), F.size(keys))), F.lit(1), F.size(keys))).alias("values"))


def category(texts: DataFrame, prefix: str) -> DataFrame:
    """(file, n, values: map) of a category, whether it is a loop or single keys with values after them."""
    found = blocks(texts, prefix)
    values = F.slice(F.concat(cells(F.col("row")), F.array_repeat(F.lit(""), F.size("keys"))), F.lit(1), F.size("keys"))
    return looped(found, prefix).select("file", "n", F.map_from_arrays("keys", values).alias("values")).unionByName(single(found, prefix))


def atoms(texts: DataFrame) -> DataFrame:
    """Atom rows with a whole-number residue: asym, auth, entity, residue.

    A row of a loop is split into cells once, and those that are asked for are read at their keys' places: no map is made for it.
    """
    names = ("group_PDB", "label_asym_id", "auth_asym_id", "label_entity_id", "label_seq_id")
    found = blocks(texts, "_atom_site")
    # a map refuses a key that stands twice, and so does this
    row = F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.raise_error(F.lit("a key of _atom_site stands twice"))).otherwise(F.col("row"))
    split = looped(found, "_atom_site").select("file", "n", "keys", F.explode(F.array(raw_cells(row))).alias("c"))
    at = lambda k: F.array_position("keys", k).cast("int")
    many = split.select("file", "n", *(F.when(at(k) > 0, F.coalesce(bare(F.get("c", at(k) - 1)), F.lit(""))).otherwise("").alias(k) for k in names))
    few = single(found, "_atom_site").select("file", "n", *(F.coalesce(F.col("values")[k], F.lit("")).alias(k) for k in names))
    rows = many.unionByName(few).where(F.col("group_PDB").isin("ATOM", "HETATM"))
    return rows.select("file", "n", F.col("label_asym_id").alias("asym"), F.col("auth_asym_id").alias("auth"), F.col("label_entity_id").alias("entity"), F.col("label_seq_id").try_cast("int").alias("residue")).where("residue is not null")


def chains(texts: DataFrame) -> DataFrame:
    """Observed residues of each (asym, auth, entity)."""
    return atoms(texts).groupBy("file", "asym", "auth", "entity").agg(F.array_sort(F.collect_set("residue")).alias("residues"))


def cropped(atoms_: DataFrame, ranges: Column, chain_ids: list[str]) -> DataFrame:
    """Atom rows within the ranges, of chains named by either id; all chains if none is named."""
    inside = F.exists(ranges, lambda r: F.col("residue").between(r["lo"], r["hi"]))
    named = F.col("asym").isin(*chain_ids) | F.col("auth").isin(*chain_ids) if chain_ids else F.lit(True)
    return atoms_.where(inside & named)


def cropped_text(text: Column, ranges: Column, chain_ids: Column) -> Column:
    """struct(text, kept): a file with those atom rows alone that lie in the ranges, in named chains (all if none is named).

    All other lines stay as they are. Atom rows that are short, have an odd quote or no whole residue number go.
    """
    word = r"""(?:[^\s'"\\]|\\.|'[^']*'|"(?:[^"\\]|\\.)*")+"""
    head = lambda x: F.startswith(F.trim(x), F.lit("_atom_site."))
    bare = lambda x: F.when(x.isin(".", "?"), "").otherwise(F.regexp_replace(x, r"""^['"]+|['"]+$""", ""))
    once = lambda value, f: F.transform(F.array(value), f)[0]

    def of_block(block: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            keys = F.transform(F.filter(lines, head), lambda x: F.regexp_extract(x, r"^\s*_atom_site\.(\S*)", 1))
            first = F.array_position(F.transform(lines, head), True)

            def of_keys(k: Column) -> Column:
                place = lambda name: (F.array_position(k, name) - 1).cast("int")

                def wanted(line: Column) -> Column:
                    cells = F.regexp_extract_all(line, F.lit(f"({word})"), 1)
                    cell = lambda c, name: F.coalesce(bare(F.get(c, place(name))), F.lit(""))

                    def test(c: Column) -> Column:
                        residue = F.when(cell(c, "label_seq_id").rlike(r"^[+-]?\d+$"), cell(c, "label_seq_id").try_cast("int"))
                        inside = F.exists(ranges, lambda r: residue.between(r["lo"], r["hi"]))
                        named = (F.size(chain_ids) == 0) | F.array_contains(chain_ids, cell(c, "label_asym_id")) | F.array_contains(chain_ids, cell(c, "auth_asym_id"))
                        return (F.size(c) >= F.size(k)) & F.coalesce(inside, F.lit(False)) & named

                    return line.rlike(rf"^\s*(?:{word}\s*)*$") & once(cells, test)

                kind = lambda x, i: F.when(head(x) | (i + 1 < first), 0).when(wanted(x), 1).otherwise(2)
                return F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), kind(x, i).alias("kind"))), lambda s: s["kind"] < 2)

            kept = once(keys, of_keys)
            return once(kept, lambda s: F.struct(F.array_join(F.transform(s, lambda x: x["line"]), "").alias("text"), F.size(F.filter(s, lambda x: x["kind"] == 1)).alias("kept")))

        plain = F.struct(block.alias("text"), F.lit(0).alias("kept"))
        return F.when(block.rlike(r"(?m)^\s*_atom_site\."), once(F.split(block, r"(?<=\n)"), of_lines)).otherwise(plain)

    blocks = F.split(text, r"(?m)^(?=[ \t]*(?:loop_[ \t]*\r?$|#|_(?!atom_site\.)))")
    return once(F.transform(blocks, of_block), lambda b: F.struct(F.array_join(F.transform(b, lambda x: x["text"]), "").alias("text"), F.aggregate(b, F.lit(0), lambda a, x: a + x["kept"]).alias("kept")))
