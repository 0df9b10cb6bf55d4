"""Sources and sinks of a corpus: files to documents, pages and cells to texts with exact offsets, frozen corpora, data sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ragspark.functions import text as tx

#: What can be ingested, by file suffix.
SUFFIXES = {".pdf": "pdf", ".md": "markdown", ".ipynb": "notebook", ".png": "image", ".jpg": "image", ".jpeg": "image"}
FOLDERS = {"arxiv": "arxiv", "course": "course_notes", "notebook": "notebook", "image": "image"}
OCR_BELOW, LONGEST_OUTPUT, MOST_MB = 100, 500, 100
CORPUS_VERSION = 1

#: Files as a stream of them has to be told.
FILES = "path string, modificationTime timestamp, length long, content binary"
SEGMENTS = "array<struct<start:int,end:int,extraction:string,page:int>>"
OUTPUT = "struct<output_type:string,ename:string,evalue:string,text:string,data:map<string,string>>"
NOTEBOOK = f"cells array<struct<cell_type:string,source:string,outputs:array<{OUTPUT}>>>"
SPAN = "struct<doc_id:string,char_start:int,char_end:int,quote:string,grade:int>"
DATASET = f"id string, query string, query_type string, source_type string, answerable boolean, paraphrased boolean, split string, relevant_spans array<{SPAN}>, reference_answer string, verified_by string, notes string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def type_by_suffix(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv)), suffix(path)), F.lit("unknown"))


def type_by_folder(path: Column) -> Column:
    """By the beginning of the parent folder's name."""
    folder = F.lower(F.try_element_at(F.split(path, "/"), F.lit(-2)))
    out = F.lit("unknown")
    for beginning, kind in FOLDERS.items():
        out = F.when(folder.startswith(beginning), kind).otherwise(out)
    return out


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the supported files below a folder, whatever the case of their suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(suffix(F.col("path")).isin(*SUFFIXES))


def gate(files: DataFrame, most_mb: int = MOST_MB) -> DataFrame:
    """files with reject_reason: null where accepted. Needs path and length."""
    return files.withColumn("reject_reason", F.when(~suffix(F.col("path")).isin(*SUFFIXES), F.lit("unsupported type; allowed: " + ", ".join(SUFFIXES))).when(F.col("length") > most_mb << 20, F.lit(f"larger than {most_mb} MB")))


def markdown(files: DataFrame, *others: str) -> DataFrame:
    """(path, others, text, segments) of Markdown files: one segment, or none for a blank file. Bytes that aren't UTF-8 are replaced."""
    text = tx.strip(F.make_valid_utf8(F.col("content").cast("string")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("text").alias("extraction"), F.lit(None).cast("int").alias("page")))
    return files.select("path", *others, text.alias("text")).withColumn("segments", F.when(F.length("text") > 0, whole).otherwise(F.slice(whole, 1, 0)))


def read_from() -> Column:
    """The file that a row was read from, as it is named: Spark gives it as a URI, with blanks and the like escaped."""
    return F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))


def joined_lines(source: Column) -> Column:
    """A notebook field that is a string or a JSON list of strings."""
    return F.coalesce(F.array_join(F.from_json(source, "array<string>"), ""), source)


def useful_output(outputs: Column) -> Column:
    """Errors as name and value, and texts of 1 to 500 characters, line by line."""
    def text(o: Column) -> Column:
        plain = joined_lines(F.when(o["output_type"] == "stream", o["text"]).otherwise(o["data"]["text/plain"]))
        plain = tx.strip(F.coalesce(plain, F.lit("")))
        error = tx.strip(F.concat(F.coalesce(o["ename"], F.lit("Error")), F.lit(": "), F.coalesce(o["evalue"], F.lit(""))))
        shown = o["output_type"].isin("stream", "execute_result", "display_data") & F.length(plain).between(1, LONGEST_OUTPUT)
        return F.when(o["output_type"] == "error", error).when(shown, plain)

    return F.array_join(F.filter(F.transform(F.coalesce(outputs, F.array().cast(f"array<{OUTPUT}>")), text), lambda x: x.isNotNull()), "\n")


def notebook_parts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text) of the cells of notebooks: page counts all cells from 1; cells of other kinds and blank ones go."""
    cells = spark.read.schema(NOTEBOOK).option("multiLine", True).json(path).select(read_from().alias("_path"), F.posexplode("cells").alias("_at", "c"))
    source, output = tx.strip(F.coalesce(joined_lines(F.col("c.source")), F.lit(""))), useful_output(F.col("c.outputs"))
    code = F.when(output != "", tx.strip(F.concat(source, F.lit("\n\n"), output))).otherwise(source)
    text = F.when(F.col("c.cell_type") == "markdown", source).when(F.col("c.cell_type") == "code", code)
    name = F.regexp_extract("_path", r"([^/]+)\.[^./]+$", 1)
    return cells.select(tx.slug(name).alias("doc_id"), (F.col("_at") + 1).alias("page"), text.alias("text")).filter(F.length("text") > 0)


def notebook_texts(files: DataFrame, *others: str) -> DataFrame:
    """(path, others, text, segments, error) of notebook files, as `notebook_parts` and `assemble` give them, each in one row: a
    file that is no notebook has an error and stops no other."""
    read = F.from_json(F.make_valid_utf8(F.col("content").cast("string")), f"{NOTEBOOK}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})

    def part(c: Column, at: Column) -> Column:
        source, output = tx.strip(F.coalesce(joined_lines(c["source"]), F.lit(""))), useful_output(c["outputs"])
        code = F.when(output != "", tx.strip(F.concat(source, F.lit("\n\n"), output))).otherwise(source)
        return F.struct(F.when(c["cell_type"] == "markdown", source).when(c["cell_type"] == "code", code).otherwise("").alias("text"), (at + 1).cast("int").alias("page"))

    def lay(state: Column, p: Column) -> Column:
        end = state["at"] + F.length(p["text"])
        segment = F.struct(state["at"].alias("start"), end.alias("end"), F.lit("notebook").alias("extraction"), p["page"].alias("page"))
        return F.struct((end + 2).alias("at"), F.concat(state["out"], F.array(segment)).alias("out"))

    rows = files.select("path", *others, read.alias("_r"))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | F.col("_r.cells").isNull()
    rows = rows.select("path", *others, bad.alias("_bad"), F.filter(F.transform("_r.cells", part), lambda p: F.coalesce(p["text"], F.lit("")) != "").alias("_p"))
    segments = F.aggregate("_p", F.struct(F.lit(0).alias("at"), F.array().cast(SEGMENTS).alias("out")), lay, lambda s: s["out"])
    return rows.select("path", *others, F.when(~F.col("_bad"), F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n")).alias("text"), F.when(~F.col("_bad"), segments).alias("segments"), F.when(F.col("_bad"), "ValueError: not a notebook").alias("error"))


def parsed(files: DataFrame) -> DataFrame:
    """(path, doc_id, source_type, content_hash, text, segments, error) of files (path, length, content): Markdown and notebooks as
    text with segments. Every other file has an error, be it too large, of no known type, or of a type that needs a model. Files are told apart
    by their names, and nothing of them is shuffled."""
    rows = gate(files).withColumns({"source_type": type_by_suffix(F.col("path")), "content_hash": F.sha2("content", 256)})
    name = F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1)
    told = rows.select("path", tx.slug(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).alias("doc_id"), "source_type", "content_hash", "content", F.when(F.col("reject_reason").isNotNull(), F.concat(F.lit("ValueError: "), "reject_reason")).alias("_refused"))
    kind, others = F.when(F.col("_refused").isNull(), F.col("source_type")), ("doc_id", "source_type", "content_hash")
    texts = markdown(told.filter(kind == "markdown"), *others).withColumn("error", F.lit(None).cast("string")).unionByName(notebook_texts(told.filter(kind == "notebook"), *others))
    none = F.coalesce("_refused", F.concat(F.lit("NotImplementedError: no reader of "), "source_type"))
    rest = told.filter(~F.coalesce(kind.isin("markdown", "notebook"), F.lit(False))).select("path", *others, F.lit(None).cast("string").alias("text"), F.lit(None).cast(SEGMENTS).alias("segments"), none.alias("error"))
    return texts.unionByName(rest)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes (name, content) as files of their own; returns how many. A task that runs again writes the same files anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def route_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with extraction: `text` where the page's text layer is long enough, else `ocr`."""
    enough = F.length(tx.strip(F.coalesce(F.col(text), F.lit("")))) >= OCR_BELOW
    return pages.withColumn("extraction", F.when(enough, "text").otherwise("ocr"))


def assemble(parts: DataFrame, key: str = "doc_id", page: str = "page", extraction: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) from parts: stripped, blank ones dropped, joined by a blank line in page order. Segments carry
    the offsets; they come from a running sum, not from a loop. Documents hold a part's text once, in one row, as a document does."""
    p = parts.select(key, page, tx.strip(F.coalesce(F.col("text"), F.lit(""))).alias("text"), (extraction if extraction is not None else F.lit("text")).alias("extraction")).filter("text <> ''")
    w = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("int")
    segments = p.select(key, F.col(page).alias("page"), "extraction", F.length("text").alias("_n"), start.alias("start")).withColumn("end", F.col("start") + F.col("_n")).drop("_n")
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), "text")))
    return p.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["text"]), "\n\n").alias("text")), segments


def page_range(pages: DataFrame, first: int, last: int, key: str = "doc_id", page: str = "page") -> DataFrame:
    """(key, text): pages first to last joined by a space and cleaned."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), "text")))
    return pages.filter(F.col(page).between(first, last)).groupBy(key).agg(tx.clean_plain(F.array_join(F.transform(listed, lambda s: s["text"]), " ")).alias("text"))


def freeze(docs: DataFrame, path: str, text: str = "text", version: int = CORPUS_VERSION) -> None:
    """Writes documents with hash, length and version; those without text go to a table of rejects beside them."""
    out = docs.withColumns({"text_sha256": F.sha2(text, 256), "n_chars": F.length(text), "version": F.lit(version)})
    out.filter(F.col(text).isNotNull()).write.mode("overwrite").parquet(f"{path}/documents")
    docs.filter(F.col(text).isNull()).withColumn("reason", F.lit("no text")).write.mode("overwrite").parquet(f"{path}/rejects")


def in_order(docs: DataFrame, kind: str = "source_type", key: str = "doc_id") -> DataFrame:
    """Documents sorted by their type, then by id: a range-partitioned sort, as all sorts of Spark."""
    return docs.orderBy(kind, key)


def drift(frozen: DataFrame, text: str = "text") -> DataFrame:
    """Rows of a frozen corpus whose text no longer has the hash that it was frozen with."""
    return frozen.filter(~F.sha2(text, 256).eqNullSafe(F.col("text_sha256")))


def read_frozen(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """The documents of a frozen corpus. A row whose text has drifted fails the job that reads it."""
    docs = spark.read.parquet(f"{path}/documents")
    same = F.sha2(text, 256) == F.col("text_sha256")
    return docs.withColumn(text, F.when(same, F.col(text)).otherwise(F.raise_error(F.concat(F.lit("frozen text has drifted: "), F.col("doc_id").cast("string")))))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files. A file is read in as many splits as it has; a line's number is its place in its
    split plus the lines of the splits before, which are counted first. No file is ever one row."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    blocks = rows.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_path", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int")
    name = F.url_decode(F.replace(F.col("_path"), F.lit("+"), F.lit("%2B")))
    return rows.join(blocks, ["_path", "_block"]).select(name.alias("file"), number.alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of files with one JSON object a line. Rows have the line's number; problems name file and line."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "").select("file", "line_no", "line")
    lines = lines.select("file", "line_no", F.from_json("line", DATASET + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "line")
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | F.col("r.id").isNull()
    return lines.filter(~bad).select("line_no", "r.*").drop("_corrupt"), lines.filter(bad).select("file", "line_no", "line")


def write_dataset(rows: DataFrame, path: str) -> int:
    """One JSON object a line; returns how many."""
    seen = Observation()
    rows.select(F.to_json(F.struct("*")).alias("value")).observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def first_by_hash(arrivals: DataFrame, stored: DataFrame | None = None, digest: str = "content_hash", order: tuple[str, ...] = ("arrival", "doc_id")) -> DataFrame:
    """Arrivals without those whose content came before, in this batch or in the store. Of equal content the first stays:
    a minimum by hash, summed before the shuffle, so a content that a third of all rows share is not one task's work."""
    first = arrivals.groupBy(digest).agg(F.min(F.struct(*order)).alias("_first"))
    kept = first.select(digest, *(F.col(f"_first.{c}").alias(c) for c in order))
    out = arrivals.join(kept, [digest, *order], "left_semi").dropDuplicates([digest, *order])
    return out if stored is None else out.join(stored.select(digest), digest, "left_anti")


def id_collisions(arrivals: DataFrame, stored: DataFrame | None = None, key: str = "doc_id", digest: str = "content_hash") -> DataFrame:
    """(key, digest) of arrivals whose id stands for other content already, in the store or in the batch."""
    every = arrivals.select(key, digest) if stored is None else arrivals.select(key, digest).unionByName(stored.select(key, digest))
    taken = every.groupBy(key).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).filter("_a <> _b").select(key)
    return arrivals.select(key, digest).distinct().join(taken, key, "left_semi")
