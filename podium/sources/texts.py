"""Readers of odd text formats. Parsers take (file, text) rows, so that files and columns are parsed alike."""

from __future__ import annotations

import os
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import lenient_float, primary
from ..functions.sequences import TARGET_TOKEN, base_target, sequence_kind, target_of_model

# fixed values: how ids of structures are written in texts and in links
PDB_ID = r"\b([0-9](?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{3})\b"
LINK_ID = r"(?i)(?:structureId=|/structure/)([0-9][A-Za-z0-9]{3})"


def fetched(url: str, path: str, *, force: bool = False, timeout: float = 60.0) -> str:
    """The path of a landed copy of a URL's text, fetched unless it is there."""
    if force or not os.path.exists(path):
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            body = r.read().decode("utf-8", "replace")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)
    return path


def delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table whose columns are all text; empty fields are empty text."""
    return spark.read.options(sep=sep, header=True, quote='"', escape='"', multiLine=True, inferSchema=False).csv(path).na.fill("")


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def lines(texts: DataFrame) -> DataFrame:
    """(file, n, line): trimmed lines that aren't empty, numbered from 0 within the file."""
    split = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    return split.select("file", "n", F.trim("line").alias("line")).where("line <> ''")


def target_list(rows: DataFrame) -> DataFrame:
    """A read target list: header cells trimmed, rows without a target dropped, id and prefix added."""
    clean = rows.toDF(*(c.strip() for c in rows.columns)).select(*(F.trim(F.col(f"`{c.strip()}`")).alias(c.strip()) for c in rows.columns))
    return clean.where(F.col("Target") != "").withColumns({"target_id": F.col("Target"), "target_prefix": F.substring("Target", 1, 1)})


def fasta(texts: DataFrame) -> DataFrame:
    """Records of sequence files: id, target ids, kind, sequence, length, header; empty sequences are dropped."""
    body = lines(texts).withColumn("head", F.startswith("line", F.lit(">")))
    order = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    numbered = body.withColumn("record", F.sum(F.col("head").cast("int")).over(order)).where("record > 0")
    per = numbered.groupBy("file", "record").agg(
        F.max(F.when(F.col("head"), F.trim(F.substr("line", F.lit(2))))).alias("header"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "line")))).alias("parts"),
    )
    sequence = F.upper(F.replace(F.array_join(F.transform("parts", lambda p: p["line"]), ""), F.lit(" "), F.lit("")))
    out = per.select("file", "record", "header", sequence.alias("sequence")).where("sequence <> ''")
    record_id = F.regexp_replace(F.get(F.split("header", r"\s+"), 0), r"^[,;|]+|[,;|]+$", "")
    out = out.withColumn("record_id", record_id)
    tokens = F.transform(F.regexp_extract_all(F.concat_ws(" ", "record_id", "header"), F.lit(TARGET_TOKEN), 1), lambda x: F.upper(x))
    ids = F.array_join(F.array_sort(F.array_distinct(F.concat(tokens, F.transform(tokens, base_target)))), ",")
    return out.select("file", "record_id", ids.alias("target_ids"), sequence_kind(F.col("record_id"), F.col("header"), F.col("sequence")).alias("sequence_kind"), "sequence", F.length("sequence").alias("length"), "header")


def aligned(header: Column, values: Column) -> Column:
    """Values under header cells: short rows are filled up, what runs over is joined into the last cell."""
    n = F.size(header)
    cut = F.concat(F.slice(values, 1, n - 1), F.array(F.array_join(F.slice(values, n, F.greatest(F.size(values), F.lit(1))), " ")))
    full = F.when(F.size(values) > n, cut).otherwise(F.concat(values, F.array_repeat(F.lit(""), n - F.size(values))))
    return F.map_from_arrays(header, full)


def score_table(texts: DataFrame, category: str) -> DataFrame:
    """Sectioned score tables: the target and the header given last hold for the rows that follow."""
    body = lines(texts)
    told = F.when(F.startswith("line", F.lit("Target:")), F.regexp_extract("line", r"^Target:\s*(\S+)", 1))
    cells = F.split(F.trim(F.regexp_replace("line", r"^#+", "")), r"\s+")
    header = F.when(F.startswith("line", F.lit("#")) & F.array_contains(cells, "Model"), cells)
    so_far = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    full = body.withColumns({"target": F.last(told, ignorenulls=True).over(so_far), "header": F.last(header, ignorenulls=True).over(so_far)})
    return scores(full.where("not startswith(line, 'Target:') and not startswith(line, '#') and header is not null"), category)


def scores(told: DataFrame, category: str) -> DataFrame:
    """Scores in the lines (file, n, target, header, line) of sectioned tables; lines that are no rows are passed over."""
    rows = told.withColumn("first", F.get(F.split("line", r"\s+"), 0)).where(F.col("first").rlike(r"^\d+$") | F.contains("first", F.lit("TS")))
    ranked, parts = F.col("first").rlike(r"^\d+$"), F.split("line", r"\s+")
    rows = rows.withColumn("metrics", aligned(F.col("header"), F.when(ranked, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)))
    cell = lambda k: F.coalesce(F.element_at("metrics", F.lit(k)), F.lit(""))
    best = primary(F.lit(category), F.col("metrics"))
    group = F.coalesce(*(F.nullif(cell(k), F.lit("")) for k in ("GR#", "Gr.Code", "GR.Code")), F.lit(""))
    return rows.select("file", "n", F.lit(category).alias("category"), F.coalesce("target", target_of_model(cell("Model"))).alias("target_id"), cell("Model").alias("model"), group.alias("group"), F.when(ranked, F.col("first")).otherwise("").alias("submitted_rank"), F.coalesce(best["metric"], F.lit("")).alias("primary_metric"), best["score"].alias("primary_score"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metrics")))).alias("metric_json"))


def anchored_references(texts: DataFrame) -> DataFrame:
    """Structure ids between one target's link and the next; the first segment of a target that has any counts."""
    marked = F.regexp_replace("text", r'(?i)(<a[^>]+href="target\.cgi[^"]*"[^>]*>\s*[THRDML]\d{4}(?:s\d+|v\d+)?\s*</a>)', "\u0001$1")
    chunks = texts.select("file", F.posexplode(F.split(marked, "\u0001")).alias("n", "chunk")).where("n > 0")
    chunks = chunks.withColumn("target_id", F.upper(F.regexp_extract("chunk", r"(?i)^<a[^>]*>\s*([THRDML]\d{4}(?:s\d+|v\d+)?)\s*</a>", 1)))
    linked = F.filter(F.regexp_extract_all("chunk", F.lit(LINK_ID), 1), lambda x: x.rlike(PDB_ID))
    phrase = F.regexp_extract(F.regexp_replace("chunk", r"<[^>]+>", " "), r"(?i)PDB codes?:?\s*([0-9A-Za-z,\s]+)", 1)
    ids = F.when(F.size(linked) > 0, linked).otherwise(F.regexp_extract_all(phrase, F.lit(PDB_ID), 1))
    out = chunks.withColumn("ids", F.array_sort(F.array_distinct(F.transform(ids, lambda x: F.lower(x))))).where(F.size("ids") > 0)
    return out.groupBy("file", "target_id").agg(F.array_join(F.min_by("ids", "n"), ",").alias("pdb_ids"))


def table_cells(texts: DataFrame) -> DataFrame:
    """(file, row, cells: array of (text, hrefs)) of every table row of HTML, by a table function."""
    from html.parser import HTMLParser

    class Rows(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.cells, self.cell = [], None, None

        def handle_starttag(self, tag, attrs):
            if tag == "tr":
                self.cells, self.cell = [], None
            elif tag in ("td", "th") and self.cells is not None:
                self.cell = ([], [])
            elif tag == "a" and self.cell is not None:
                self.cell[1].extend(v for k, v in attrs if k == "href" and v)

        def handle_data(self, data):
            if self.cell is not None:
                self.cell[0].append(data)

        def handle_endtag(self, tag):
            if tag in ("td", "th") and self.cell is not None:
                self.cells.append((" ".join("".join(self.cell[0]).split()), self.cell[1]))
                self.cell = None
            elif tag == "tr" and self.cells is not None:
                if self.cells:
                    self.rows.append(self.cells)
                self.cells = None

    @F.udtf(returnType="row int, cells array<struct<text:string,hrefs:array<string>>>")
    class Parse:
        def eval(self, html: str):
            parser = Rows()
            parser.feed(html or "")
            for i, cells in enumerate(parser.rows):
                yield i, cells

    return texts.lateralJoin(Parse(F.col("text").outer())).select("file", "row", "cells")


def domain_summary(texts: DataFrame) -> DataFrame:
    """Domain definitions from HTML tables: six cells or more, the first a number, the fourth an id and its ranges."""
    rows = table_cells(texts).where(F.size("cells") >= 6).where(F.regexp_replace(F.col("cells")[0]["text"], r"\.+$", "").rlike(r"^\d+$"))
    named = rows.withColumn("domain_id", F.upper(F.regexp_extract(F.col("cells")[3]["text"], r"(?i)\b([A-Z]\d{4}(?:S\d+|V\d+)?-D\d+)\s*:", 1))).where("domain_id <> ''")
    from_text = F.flatten(F.transform("cells", lambda c: F.regexp_extract_all(c["text"], F.lit(PDB_ID), 1)))
    from_links = F.flatten(F.transform("cells", lambda c: F.flatten(F.transform(c["hrefs"], lambda h: F.regexp_extract_all(h, F.lit(LINK_ID), 1)))))
    ids = F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat(from_text, from_links), lambda x: F.lower(x)))), ",")
    text = lambda i: F.col("cells")[i]["text"]
    return named.select("file", F.split_part("domain_id", F.lit("-D"), F.lit(1)).alias("target_id"), text(2).alias("target_len"), "domain_id", F.trim(F.regexp_extract(text(3), r":\s*(.+)$", 1)).alias("residue_ranges"), text(4).alias("domain_len"), text(5).alias("difficulty"), ids.alias("pdb_ids"))


TASKS = "array<struct<name:string,sequences:array<map<string,struct<sequence:string,count:int,id:array<string>>>>>>"


def tasks(texts: DataFrame, *, strict: bool = True) -> DataFrame:
    """(file, place, name, sequences) of task lists. Strict: a file that is no list, or a name that is empty or repeated, stops the query."""
    parsed = texts.select("file", F.from_json("text", TASKS).alias("all"))
    if strict:
        parsed = parsed.withColumn("all", F.when(F.col("all").isNull(), F.raise_error(F.concat(F.lit("no task list: "), "file"))).otherwise(F.col("all")))
    rows = parsed.select("file", F.posexplode("all").alias("place", "t")).select("file", "place", "t.name", "t.sequences")
    if not strict:
        return rows.where("name is not null")
    n = F.count(F.lit(1)).over(W.partitionBy("file", "name"))
    return rows.withColumn("n", n).withColumn("name", F.when((F.coalesce("name", F.lit("")) == "") | (F.col("n") > 1), F.raise_error(F.concat(F.lit("bad task name: "), F.coalesce("name", F.lit(""))))).otherwise(F.col("name"))).drop("n")


def materialized(wanted: DataFrame, there: DataFrame, fetched: DataFrame, *, statuses: tuple[str, ...] = ("candidate",), force: bool = False) -> DataFrame:
    """A row for each target and structure of the review rows wanted (target_id, pdb_ids, status): cached, downloaded or download_failed:<why>.

    there: files (pdb_id, length, sha256) that lie in the landing folder; fetched: what a download brought (pdb_id, length, sha256, error). A file that is there is
    kept unless force is set; one that is neither there nor fetched failed as not_fetched.
    """
    rows = wanted.withColumn("status", F.lower(F.trim("status"))).where(F.col("status").isin(*(s.strip().lower() for s in statuses)))
    each = rows.select(F.upper(F.trim("target_id")).alias("target_id"), "status", F.explode(F.array_distinct(F.filter(F.transform(F.split("pdb_ids", "[,;]"), lambda x: F.upper(F.trim(x))), lambda x: x != ""))).alias("pdb_id"))
    had = there.select(F.upper("pdb_id").alias("pdb_id"), F.struct("length", "sha256").alias("had"))
    new = fetched.select(F.upper("pdb_id").alias("pdb_id"), F.struct("length", "sha256").alias("new"), F.coalesce("error", F.lit("")).alias("error"), F.lit(True).alias("tried"))
    full = each.join(had, "pdb_id", "left").join(new, "pdb_id", "left")
    fine = F.col("tried") & (F.col("error") == "")
    keep = F.col("had").isNotNull() & ~F.lit(force)
    told = F.when(keep, "cached").when(fine, "downloaded").otherwise(F.concat(F.lit("download_failed:"), F.coalesce("error", F.lit("not_fetched"))))
    file = F.when(keep, F.col("had")).when(fine, F.col("new")).otherwise(F.col("had"))
    return full.select("target_id", "pdb_id", "status", told.alias("download_status"), file["length"].alias("bytes"), F.coalesce(file["sha256"], F.lit("")).alias("sha256"))


def run_specs(spark: SparkSession, pattern: str, schema: str, *, registered: DataFrame | None = None) -> DataFrame:
    """One spec for each file, with its folder; only registered runs if a register is given."""
    specs = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1))
    return specs if registered is None else specs.join(registered.select("run_id").distinct(), "run_id", "left_semi")


def metric_values(text: Column) -> dict[str, Column]:
    """Numbers in the output of metric programs; null where they aren't told."""
    # fixed values: how each program names its numbers
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("double")
    gdt = number(r"(?i)GDT[-_ ]?TS(?:-score)?\s*=\s*([0-9.]+)")
    return {
        "gdt_ts": F.when(gdt > 1, gdt / 100).otherwise(gdt),
        "tm_score": number(r"(?i)\bTM-score\s*=\s*([0-9.]+)"),
        "dockq": F.coalesce(number(r"(?i)\bTotal\s+DockQ\b[^\n:=]*[=:]\s*([0-9.]+)"), number(r"(?i)\bDockQ(?:_Avg)?\s*[=:]\s*([0-9.]+)"), number(r"(?i)\bDockQ\s+([0-9.]+)")),
        "qsglob": F.coalesce(*(number(rf"(?i)\bQS{name}\b[^0-9+\-.]*([0-9.]+)") for name in ("glob", "[-_ ]?global", "[-_ ]?score"))),
    }


def qs_json(text: Column) -> Column:
    """struct(qsglob, diagnostic) of a JSON report, under any of the names that the score goes by."""
    at = lambda k: F.get_json_object(text, f"$.{k}")
    value = F.coalesce(at("qs_global"), at("QSglob"), at("qsglob")).try_cast("double")
    unmapped = F.from_json(at("mdl_chains_without_chem_mapping"), "array<string>")
    notes = F.array_compact(F.array(F.when(F.size(unmapped) > 0, F.concat(F.lit("unmapped_model_chains:"), F.array_join(unmapped, ","))), F.when((at("chain_mapping") == "{}") & at("model_chains").isNotNull(), "empty_chain_mapping")))
    return F.struct(value.alias("qsglob"), F.array_join(notes, ";").alias("diagnostic"))


def lenient(column: str) -> Column:
    return lenient_float(F.col(column))
