"""Files as tables: program sources, dependency lists, findings, JSON lines, coverage, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

c = F.col
#: File kinds by extension.
KINDS = (("s", "program"), ("x", "program"), ("l", "dependencies"), ("z", "dependencies"))


def discover_sources(spark: SparkSession, root: str, kinds: tuple = KINDS, ignored: tuple = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """(path, stem, kind, content) of the program and dependency files under root; stem is lower-cased; ignored directories are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(y for e, _ in kinds for y in (e, e.upper())) + "}").load(root)
    f = f.where(~F.rlike("path", F.lit("/(" + "|".join(x.replace(".", r"\.") for x in ignored) + ")/")))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return f.select("path", F.lower(F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1)).alias("stem"), F.coalesce(*(F.when(ext == e, F.lit(k)) for e, k in kinds)).alias("kind"), "content")


#: What Windows-1252 has in place of the control characters 80 to 9F of Latin-1; five of them it doesn't know.
_C1 = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_UNKNOWN = r"[\x81\x8d\x8f\x90\x9d]"


def _decoded(content):
    """Built-in functions only, so that no bytes leave the JVM. Latin-1 has a character for every byte; Windows-1252 differs from it in _C1."""
    utf8, latin = content.cast("string"), F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, _C1)), "".join(_C1.values()))
    return F.when(F.is_valid_utf8(utf8), utf8).when(F.rlike(latin, F.lit(_UNKNOWN)), latin).otherwise(windows)


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `text`: bytes as UTF-8, else Windows-1252, else Latin-1; null stays null."""
    return files.withColumn("text", _decoded(c(content)))


def dependency_edges(files: DataFrame) -> DataFrame:
    """(source, target): one dependency name a line, trimmed and lower-cased; blank lines are skipped. files: (stem, text)."""
    x = files.select(F.lower("stem").alias("source"), F.explode(F.split("text", "\r?\n")).alias("target"))
    return x.select("source", F.lower(F.trim("target")).alias("target")).where("target <> ''")


FINDING = "rule_id string, severity string, message string, location struct<path:string,line:int,symbol:string>"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of collections like {"findings": [...]}: one row each, the location flattened."""
    x = spark.read.schema(f"findings array<struct<{FINDING.replace(' string', ':string').replace('location struct', 'location:struct')}>>").json(path, multiLine=True)
    return x.select(F.explode("findings").alias("f")).select("f.rule_id", "f.severity", "f.message", "f.location.path", "f.location.line", "f.location.symbol")


def read_jsonl(texts: DataFrame, schema: str) -> DataFrame:
    """(file, line_no, bad, row) of JSON lines: blank lines are skipped; bad holds a line that isn't an object. texts: (file, text)."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("trim(line) <> ''")
    x = lines.withColumn("row", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.when(c("row").isNull() | c("row._bad").isNotNull() | ~F.startswith(F.trim("line"), F.lit("{")), c("line"))
    return x.select("file", (c("n") + 1).alias("line_no"), bad.alias("bad"), c("row").dropFields("_bad").alias("row"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits) of coverage XML, files under src/ only."""
    schema = "_filename string, lines struct<line: array<struct<_number:int,_hits:int>>>"
    x = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    return x.where(F.startswith("_filename", F.lit("src/"))).select(c("_filename").alias("path"), F.explode("lines.line").alias("l")).select("path", c("l._number").alias("line"), c("l._hits").alias("hits"))


def write_report(df: DataFrame, path: str, by: str = "program", kind: str = "parquet") -> None:
    """Write a report, a directory for each value of `by`; a second write replaces it."""
    df.write.partitionBy(by).mode("overwrite").format(kind).save(path)
