"""Delimited-file ingestion: read, header normalisation, fingerprints, column mapping.

Excel workbooks are not read (no workbook reader in this environment);
convert them to delimited files first.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import parse as P
from quarry.sources import spanning

# Text read as missing (the common CSV missing-value tokens).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SUPPORTED = (".csv", ".tsv", ".txt")


def _separator(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def _decoded(path: str) -> str:
    """Path part of a file URI with its escapes undone (Spark reports ``c%20d.csv`` for ``c d.csv``)."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme else path


def file_traits(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file, in one splittable pass over its lines: header line, valid UTF-8 throughout, and whether a
    quoted field spans lines (some line holds an odd number of quotes)."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    return lines.groupBy("path").agg(
        F.min_by("value", "at").alias("header"),
        F.bool_and(F.is_valid_utf8(F.col("value").cast("binary"))).alias("utf8"),
        F.bool_or(quotes % 2 == 1).alias("spans_lines"))


def read_delimited(spark: SparkSession, paths: Sequence[str], check_files: bool = True, normalize: bool = False, places: bool = False) -> DataFrame:
    """A1: header row, every column as text, NA tokens -> NULL.

    Separator: ',' for .csv/.txt and tab for .tsv.  Quotes inside a quoted
    field are doubled.  Encoding: UTF-8, or ISO-8859-1 for files that are not
    valid UTF-8 (the fallback never fails).  Files are read in groups of equal
    separator, encoding, header and need for fields that span lines, and the
    groups are united by column name (``normalize``: by normalised name, A2, as
    files may spell a header differently).  Files with fields that span lines
    are split too (``spanning``); only those with quotes that are neither an end
    of a field nor doubled are read by one task a file.
    ``check_files=False`` skips the pass over the lines for files known to be
    plain UTF-8 with one header and no field that spans lines.  ``places`` adds
    each row's file and its place there (``_file``, ``_pos``).
    """
    paths = list(paths)
    for p in paths:
        if os.path.splitext(_decoded(p))[1].lower() not in SUPPORTED:
            raise ValueError(f"unsupported file type: {p}")
    groups: dict[tuple, list[str]] = {}
    if check_files:
        traits = {_decoded(r["path"]): r for r in file_traits(spark, paths).collect()}  # one row per file
        for p in paths:
            own = _decoded(p) if urlparse(p).scheme else os.path.abspath(p)
            t = traits.get(own) or traits.get(p)
            if t is not None:  # a file without any line has no columns either
                groups.setdefault((_separator(p), t["utf8"], t["header"], t["spans_lines"]), []).append(p)
    else:
        for p in paths:
            groups.setdefault((_separator(p), True, None, False), []).append(p)
    if not groups:
        raise ValueError("no lines in any file")
    out = None
    for (sep, utf8, _, spans_lines), ps in groups.items():
        for df in _read_group(spark, ps, sep, utf8, spans_lines, places):
            df = normalize_columns(df) if normalize else df
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    where = ["_file", "_pos"]
    cells = [F.when(F.col(f"`{c}`").isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in out.columns if c not in where]
    return out.select(*cells, *(where if places else []))


def _read_group(spark: SparkSession, paths: list[str], sep: str, utf8: bool, spans_lines: bool, places: bool) -> list[DataFrame]:
    """Files of equal traits; those whose fields span lines apart by how they can be read, in the order of the file unless rows carry their places."""
    def reader(by_file: bool):
        return (spark.read.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"')
                .option("multiLine", str(by_file).lower()).option("encoding", "UTF-8" if utf8 else "ISO-8859-1").option("inferSchema", "false"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_file": F.input_file_name(), "_pos": F.monotonically_increasing_id()})

    if not spans_lines:
        return [placed(reader(False).csv(paths))]
    # kept on the executors' disks: the test of the quotes, the records' lines and places, and the ranges of their order
    # all read them; a mark of this call, as a file may have changed since an earlier one
    marked = spanning.placed_lines(spark, paths, utf8).withColumn("_call", F.lit(uuid.uuid4().hex))
    lines = marked.persist(StorageLevel.DISK_ONLY).drop("_call")
    named = [r["path"] for r in spanning.misquoted(lines, sep).collect()]      # at most one row a file
    bad = {_decoded(p) for p in named}
    apart = [p for p in paths if (_decoded(p) if urlparse(p).scheme else os.path.abspath(p)) in bad]
    out = [placed(reader(True).csv(apart))] if apart else []
    fine = [p for p in paths if p not in apart]
    if fine:
        if apart:
            lines = lines.where(~F.col("path").isin(named))
        rows = spanning.parsed(spanning.joined_records(lines), reader(False).csv(fine[0]).columns, sep)
        out.append(rows if places else rows.repartitionByRange("_file", "_pos").sortWithinPartitions("_file", "_pos"))
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    """A2: strip, lower-case, blanks/dashes -> '_'; duplicate results raise."""
    names = [P.normalize_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after normalisation: {names}")
    return df.toDF(*names)


_PRIME = (1 << 61) - 1


def file_fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A3: MD5 of each file's bytes (one task per file, up to the 2 GiB of a binary value; see ``line_fingerprints``)."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.md5("content").alias("md5"), "length")


_PLACE = (1 << 33) - 1    # monotonically_increasing_id: place in the partition below, partition above


def line_fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A3 for files of any size, in one splittable pass: digest of a file's lines and their order, and its characters.

    A line weighs its hash with its number in the file.  Per split the sums of
    hashes, and of hashes times the place in the split, are enough: the lines of
    earlier splits of the file shift all places of a split alike.  The digest
    does not depend on where the splits lie.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().bitwiseAND(_PLACE).cast("decimal(20,0)").alias("at"), F.xxhash64("value").alias("h"), F.length("value").alias("n"))
    low, high = F.col("h").bitwiseAND((1 << 31) - 1), F.shiftrightunsigned("h", 33)
    parts = [x.cast("decimal(20,0)") for x in (low, high)]
    sums = lines.groupBy("path", "split").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("n").alias("n"), F.min("at").alias("first"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(parts)], *[F.sum((x * F.col("at")).cast("decimal(38,0)")).alias(f"w{i}") for i, x in enumerate(parts)])
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("shift", (before + 1 - F.col("first")).cast("decimal(20,0)"))      # one row a split
    # modulo a prime, so that no product outgrows a decimal
    weight = lambda i: F.sum(F.pmod(F.col(f"w{i}") + F.pmod(F.col(f"s{i}"), F.lit(_PRIME)) * F.col("shift"), F.lit(_PRIME)))
    return placed.groupBy("path").agg(
        F.md5(F.concat_ws("|", F.sum("lines"), F.sum("n"), F.sum("s0"), F.sum("s1"), weight(0), weight(1)).cast("binary")).alias("md5"), F.sum("n").alias("length"))


def new_files(fingerprints: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose fingerprint is not registered yet (left anti join)."""
    return fingerprints.join(registry.select("md5").distinct(), "md5", "left_anti")


def column_validity(df: DataFrame, minimum: int = 3) -> DataFrame:
    """A4: per column, whether at least ``minimum`` values parse as datetime / as numbers."""
    aggs = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        dt_any = P.parse_any_datetime(col)
        aggs += [F.count(dt_any).alias(f"d_{c}"), F.count(P.parse_numeric(col, False)).alias(f"n_{c}")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(f"d_{c}") >= minimum).alias("valid_datetime"),
                 (F.col(f"n_{c}") >= minimum).alias("valid_numeric")) for c in df.columns])).alias("s")).select("s.*")


# Semantic fields, their display labels and keyword hints.
SEMANTIC_FIELDS = {
    "date": "Date", "sales": "Sales Volume", "stock": "Stock Level", "production": "Production Volume",
    "error_rate": "Error Rate", "category": "Category", "location": "Store Location",
}
KEYWORD_HINTS = {
    "production": ("production", "output", "produced", "units_produced"),
    "stock": ("stock", "inventory", "closing_stock", "on_hand"),
    "defect": ("defect", "reject", "defect_rate", "quality"),
    "category": ("category", "sku", "product", "brand", "segment"),
    "date": ("date", "time", "period", "week", "month", "year", "day"),
}


def suggest_mapping(columns: Sequence[str]) -> dict[str, str]:
    """A8 auto-match: source column -> semantic field when lower/underscored names agree."""
    out: dict[str, str] = {}
    for c in columns:
        key = c.lower().replace(" ", "_")
        for fld, label in SEMANTIC_FIELDS.items():
            if fld not in out.values() and key in (fld, fld.replace("_", ""), label.lower()):
                out[c] = fld
    return out


def map_columns(df: DataFrame, mapping: dict[str, str], date_field: str = "date", date_format: str | None = None) -> DataFrame:
    """Rename source -> semantic field and parse the date field."""
    out = df.withColumnsRenamed(mapping)
    if date_field in out.columns and dict(out.dtypes)[date_field] == "string":
        field = F.col(date_field)
        out = out.withColumn(date_field, P.parse_datetime(field, date_format) if date_format else P.parse_any_datetime(field))
    return out


def suggest_columns(df: DataFrame, datetime_column: str | None = None, numeric: Sequence[str] | None = None,
                    text: Sequence[str] | None = None) -> dict[str, str | None]:
    """A column per role, from names and types (no job).

    Sales is the first numeric column; production, stock and defect are the
    first numeric column whose name holds one of the role's keywords, category
    the first text column, date the given datetime column or the first name
    that matches.  ``numeric`` / ``text`` name the columns of detected roles
    when the table itself is still all text.
    """
    def kind(*names: str) -> list[str]:
        return [f.name for f in df.schema.fields if f.dataType.typeName() in names]

    numeric = list(numeric) if numeric is not None else kind("byte", "short", "integer", "long", "float", "double", "decimal")
    text = list(text) if text is not None else kind("string")
    allowed = {"production": numeric, "stock": numeric, "defect": numeric, "category": text, "date": df.columns}
    out: dict[str, str | None] = {
        role: next((c for c in allowed[role] if any(h in c.lower() for h in hints)), None) for role, hints in KEYWORD_HINTS.items()}
    out["sales"] = numeric[0] if numeric else None
    if datetime_column:
        out["date"] = datetime_column
    return out


# A text column whose values are numbers (or dates) in this share of its rows takes that role.
ROLE_SHARE = 0.8


def column_kinds(df: DataFrame) -> DataFrame:
    """(ordinal, column, values, kind) from one aggregation of the whole table: ``date``, ``number``, ``text`` or ``empty``.

    A typed column has its type's kind; a text column is what at least
    ROLE_SHARE of its non-null values parse as, numbers first.
    """
    fixed = {"byte": "number", "short": "number", "integer": "number", "long": "number", "float": "number", "double": "number", "decimal": "number",
             "date": "date", "timestamp": "date", "timestamp_ntz": "date"}
    aggs, parts = [], []
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), fixed.get(f.dataType.typeName())
        aggs.append(F.count(c).alias(f"v{i}"))
        seen = F.col(f"v{i}")
        if kind is None and f.dataType.typeName() == "string":
            number = P.parse_numeric(c, False)
            aggs += [F.count(number).alias(f"n{i}"), F.count(F.when(number.isNull(), P.parse_any_datetime(c))).alias(f"d{i}")]
            found = F.when(F.col(f"n{i}") >= ROLE_SHARE * seen, "number").when(F.col(f"d{i}") >= ROLE_SHARE * seen, "date").otherwise("text")
        else:
            found = F.lit(kind or "text")
        parts.append(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), seen.alias("values"),
                              F.when(seen > 0, found).otherwise("empty").alias("kind")))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def suggest_roles(df: DataFrame) -> DataFrame:
    """A9 from the data: (role, column) with a column for each role that has one.

    Kinds come from the values of the whole table (``column_kinds``).  Sales is
    the first column of numbers; production, stock and defect the first one
    whose name holds a keyword of the role; category the first text column with
    one; date the first column of dates, by keyword before any other.
    """
    kinds = column_kinds(df)
    named = lambda role: F.exists(F.array(*[F.lit(h) for h in KEYWORD_HINTS[role]]), lambda h: F.contains(F.lower("column"), h))
    fits = [
        F.when(F.col("kind") == "number", F.struct(F.lit("sales").alias("role"), F.lit(0).alias("rank"))),
        *[F.when((F.col("kind") == "number") & named(r), F.struct(F.lit(r).alias("role"), F.lit(0).alias("rank"))) for r in ("production", "stock", "defect")],
        F.when((F.col("kind") == "text") & named("category"), F.struct(F.lit("category").alias("role"), F.lit(0).alias("rank"))),
        F.when(F.col("kind") == "date", F.struct(F.lit("date").alias("role"), F.when(named("date"), 0).otherwise(1).alias("rank"))),
    ]
    found = kinds.select("ordinal", "column", F.inline(F.array_compact(F.array(*fits))))
    return found.groupBy("role").agg(F.min_by("column", F.struct("rank", "ordinal")).alias("column"))


def preview(df: DataFrame, n: int = 10, order_by: Sequence | None = None) -> DataFrame:
    """A10: the first ``n`` rows in a given order (top-n: each task keeps n rows)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
