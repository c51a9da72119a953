"""Where a page's text comes from: the text layer, recognised words, or a model; faults as rows; stored records.

Recognition and models lie outside; their results are columns here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_CHARS, SURE = 50, 60.0
BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, BLANK, "")


def without_copies(text: Column, sep: str = "\n\n") -> Column:
    """A text's blocks, stripped, each at its first place only; empty ones go."""
    blocks = F.filter(F.transform(F.split(text, sep), stripped), lambda b: b != "")
    return F.array_join(F.array_distinct(blocks), sep)


def recognised(words: DataFrame) -> DataFrame:
    """doc_id, page, ocr_text, ocr_confidence of recognised words (doc_id, page, ord, text, conf): the words that are no
    blanks and have some confidence; the mean confidence, one decimal, over blanks too, 0 if nothing counts."""
    counts = F.col("conf") > 0
    said = F.when(counts & (stripped(F.col("text")) != ""), F.struct("ord", "text"))
    each = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(said)).alias("held"), F.avg(F.when(counts, F.col("conf"))).alias("mean"))
    return each.select("doc_id", "page", F.array_join(F.col("held.text"), " ").alias("ocr_text"), F.round(F.coalesce("mean", F.lit(0.0)), 1).alias("ocr_confidence"))


def cascaded(pages: DataFrame) -> DataFrame:
    """pages (raw_text, ocr_text, ocr_confidence, vision_text, error and more) with text, tier, confidence.

    Tier 1 is a text layer of more than TEXT_CHARS characters, without copies of blocks; tier 2 recognised words of SURE
    or more confidence; tier 3 what a model made ('' if it failed), with the recognition's low confidence. A page with
    an error is an empty text of no tier, so one page's fault ends no run. Null texts count as empty.
    """
    one = F.length(stripped(F.coalesce("raw_text", F.lit("")))) > TEXT_CHARS
    two = F.col("ocr_confidence") >= SURE
    failed = F.col("error").isNotNull()
    text = F.when(failed, "").when(one, without_copies(F.col("raw_text"))).when(two, F.coalesce("ocr_text", F.lit(""))).otherwise(F.coalesce("vision_text", F.lit("")))
    tier = F.when(failed, F.lit(None).cast("int")).when(one, 1).when(two, 2).otherwise(3)
    return pages.withColumns({"text": text, "tier": tier, "confidence": F.when(~failed & ~one, F.col("ocr_confidence"))})


def tier_counts(pages: DataFrame) -> DataFrame:
    """tier (as text, 'None' where there is none), n_pages, in the order of that text."""
    return pages.groupBy(F.coalesce(F.col("tier").cast("string"), F.lit("None")).alias("tier")).agg(F.count("*").alias("n_pages")).orderBy("tier")


def cited(spans: DataFrame) -> DataFrame:
    """doc_id, page: each page that a span of spans (doc_id, page) stands on; null pages are left out."""
    return spans.where("page IS NOT NULL").select("doc_id", "page").distinct()


def file_name(name: Column, most: int = 80) -> Column:
    """The last part of a path in safe characters, ending in .pdf; 'document.pdf' if nothing is left."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r".*[/\\]", "")
    plain = F.substring(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), 1, most)
    plain = F.when(plain == "", "document").otherwise(plain)
    return F.when(F.lower(plain).endswith(".pdf"), plain).otherwise(F.concat(plain, F.lit(".pdf")))


def is_pdf_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\.pdf$"), F.lit(False))


# --- stored records -----------------------------------------------------------------------------------------------

SPAN = "struct<page: int, quote: string, verified: boolean, char_start: int, char_end: int, bbox: array<double>, page_size: array<double>>"
ASSEMBLY = (
    f"title string, source_document string, "
    f"parts array<struct<id: string, name: string, qty: int, part_number: string, mesh: string, provenance: {SPAN}>>, "
    f"steps array<struct<id: string, index: int, text: string, source_number: int, installs: array<string>, depends_on: array<string>, tool: string, torque_nm: double, warning: string, provenance: {SPAN}>>"
)
MANIFEST = "id string, title string, source string, pages int, parts int, steps int, torqueSpecs int, verifiedSpans int, totalSpans int, ok boolean, ingestedAt timestamp, document string"
ENTRY = "struct<name: string, forms: array<string>, attaches_to: array<string>, part_number: string>"


def read_assemblies(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ASSEMBLY, file and error of JSON files, one assembly each.

    Values are read as they come and cast: a figure may be 3, 3.0 or "3". Absent or null lists are empty, an absent
    quantity is 1, an absent text is '' and a null one null; what no cast fits is null. A file that is no JSON object is
    a row with an error and empty lists. Partition columns of the path stay.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()).withColumn("v", F.try_parse_json("value"))
    get = lambda v, field, kind: F.try_variant_get(v, f"$.{field}", kind)
    each = lambda field: F.coalesce(get(F.col("v"), field, "array<variant>"), F.array().cast("array<variant>"))
    words = lambda v, field: F.coalesce(get(v, field, "array<string>"), F.array().cast("array<string>"))

    figure = lambda v, field, kind="int": get(v, field, "double").cast(kind)

    def span(v: Column) -> Column:
        own = get(v, "provenance", "variant")
        quote, sure = F.coalesce(get(own, "quote", "string"), F.lit("")), F.coalesce(get(own, "verified", "boolean"), F.lit(False))
        held = F.struct(figure(own, "page"), quote, sure, figure(own, "char_start"), figure(own, "char_end"), get(own, "bbox", "array<double>"), get(own, "page_size", "array<double>"))
        return F.when(get(own, "page", "variant").isNotNull(), held.cast(SPAN)).alias("provenance")

    parts = F.transform(each("parts"), lambda v: F.struct(get(v, "id", "string").alias("id"), get(v, "name", "string").alias("name"), F.coalesce(figure(v, "qty"), F.lit(1)).alias("qty"), get(v, "part_number", "string").alias("part_number"), get(v, "mesh", "string").alias("mesh"), span(v)))
    said = lambda v: F.when(get(v, "text", "variant").isNull(), F.lit("")).otherwise(get(v, "text", "string"))
    steps = F.transform(each("steps"), lambda v: F.struct(get(v, "id", "string").alias("id"), figure(v, "index").alias("index"), said(v).alias("text"), figure(v, "source_number").alias("source_number"), words(v, "installs").alias("installs"), words(v, "depends_on").alias("depends_on"), get(v, "tool", "string").alias("tool"), figure(v, "torque_nm", "double").alias("torque_nm"), get(v, "warning", "string").alias("warning"), span(v)))
    error = F.when(F.coalesce(F.schema_of_variant("v"), F.lit("VOID")).startswith("OBJECT"), F.lit(None)).otherwise("no JSON object")
    more = [c for c in files.columns if c not in ("value", "file", "v")]
    return files.select(*more, get(F.col("v"), "title", "string").alias("title"), get(F.col("v"), "source_document", "string").alias("source_document"), parts.alias("parts"), steps.alias("steps"), "file", error.cast("string").alias("error"))


def part_of(parts: Column, part_id: Column) -> Column:
    """The first of an assembly's parts (or steps) with that id, or null."""
    return F.get(F.filter(parts, lambda p: p["id"] == part_id), F.lit(0))


def write_assemblies(rows: DataFrame, path: str, by: str = "proc_id") -> None:
    """One folder for each value of `by`, its assembly as a line of JSON with all fields, nulls too; folders of values that rows lack stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy(by).json(path)


def read_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(part_id, name, forms, attaches_to, part_number; tool) of a lexicon file: parts by id, and a list of tools."""
    held = spark.read.schema(f"parts map<string, {ENTRY}>, tools array<string>").option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    parts = held.select(F.explode("parts").alias("part_id", "e")).select("part_id", "e.name", F.coalesce("e.forms", none).alias("forms"), F.coalesce("e.attaches_to", none).alias("attaches_to"), "e.part_number")
    return parts, held.select(F.explode("tools").alias("tool"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest of MANIFEST; a file that is absent or no such JSON has none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(MANIFEST + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], MANIFEST)
    return rows.where("_bad IS NULL AND id IS NOT NULL").drop("_bad")
