"""Readers and writers of spectra and tables; only Spark opens paths."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanforge import schemas
from scanforge.functions.binary import decode_array
from scanforge.functions.scalar import bare_sequence, nan_to_null

_PARAM = T.ArrayType(T.StructType([T.StructField("_accession", T.StringType()), T.StructField("_name", T.StringType()), T.StructField("_value", T.StringType())]))
_CV = T.StructField("cvParam", _PARAM)
_REF = T.StructField("referenceableParamGroupRef", T.ArrayType(T.StructType([T.StructField("_ref", T.StringType())])))
SPECTRUM = T.StructType(
    [
        T.StructField("_index", T.LongType()), _CV, _REF,
        T.StructField("scanList", T.StructType([T.StructField("scan", T.ArrayType(T.StructType([_CV, _REF])))])),
        T.StructField("binaryDataArrayList", T.StructType([T.StructField("binaryDataArray", T.ArrayType(T.StructType([_CV, _REF, T.StructField("binary", T.StringType())])))])),
    ]
)
GROUP = T.StructType([T.StructField("_id", T.StringType()), _CV])


def parameter_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(file, groups)``: the parameters that a file's spectra can refer to, by name of the group; one row for each file that has any."""
    rows = spark.read.format("xml").option("rowTag", "referenceableParamGroup").schema(GROUP).load(path).where("_id is not null and cvParam is not null")
    each = rows.select(F.col("_metadata.file_path").alias("file"), "_id", "cvParam").dropDuplicates(["file", "_id"])
    return each.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("_id", "cvParam"))).alias("groups"))


def read_mzml(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """Spectra of one level from mzML; Spark's XML reader splits files by spectrum, tasks decode the arrays.

    Parameters may stand in the spectrum, the scan or the array, or in a group of the file that it refers to; its own come first. Arrays are raw or
    compressed as in ``functions.binary``; an unknown compression is an error, but only in spectra of the level.
    """
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(SPECTRUM).load(path)
    groups = parameter_groups(spark, path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file")).join(groups, "file", "left")

    def params(x):
        """The parameters of an element and of the groups that it refers to."""
        referred = F.flatten(F.transform(x("referenceableParamGroupRef"), lambda r: F.coalesce(F.try_element_at("groups", r["_ref"]), F.array().cast(_PARAM))))
        return F.concat(F.coalesce(x("cvParam"), F.array().cast(_PARAM)), F.coalesce(referred, F.array().cast(_PARAM)))

    def param(own, name: str, kind: str):
        return F.get(F.filter(own, lambda p: p["_name"] == name), F.lit(0))["_value"].cast(kind)

    inside = lambda e: lambda c: e[c]
    own = raw.withColumn("own", params(F.col)).where(param(F.col("own"), "ms level", "int") == level).select(
        F.col("_index").alias("ind"), param(F.col("own"), "ms level", "int").alias("mslev"), param(F.col("own"), "base peak m/z", "double").alias("bpmz"),
        param(F.col("own"), "base peak intensity", "double").alias("bpint"), param(F.flatten(F.transform("scanList.scan", lambda s: params(inside(s)))), "scan start time", "double").alias("starttime"),
        F.transform("binaryDataArrayList.binaryDataArray", lambda a: F.struct(F.transform(params(inside(a)), lambda p: p["_name"]).alias("names"), a["binary"].alias("data"))).alias("arrays"),
    )

    def decode(batches):
        for b in batches:
            mz, intensity = [], []
            for arrays in b.column("arrays").to_pylist():
                found = {"m/z array": [], "intensity array": []}
                for a in arrays or []:
                    wanted = [n for n in found if n in a["names"]]
                    if wanted:
                        found |= dict.fromkeys(wanted, decode_array(base64.b64decode(a["data"] or ""), a["names"]))
                mz.append(found["m/z array"])
                intensity.append(found["intensity array"])
            kind = pa.list_(pa.float64())
            keep = ["ind", "mslev", "bpmz", "bpint", "starttime"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(mz, kind), pa.array(intensity, kind)], [*keep, "mzarray", "intarray"])

    kept = T.StructType([f for f in schemas.SCANS if f.name != "scan_idx"])
    return own.mapInArrow(decode, kept).withColumn("scan_idx", F.col("ind")).select(*schemas.SCANS.names)


def scan_header(scans: DataFrame) -> DataFrame:
    return scans.select(*schemas.SCAN_HEADER.names)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated text with a header; NaN becomes null. Without a schema all columns are strings."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "").option("nanValue", "NaN")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*(nan_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Tab-separated text with a header, in a folder for each value of ``by``."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_fasta(df: DataFrame, path: str, id_col: str, sequence_col: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(sequence_col)).alias("value")).write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(id, sequence)``; a sequence may run over several lines. Only ``>`` at the start of a line starts a record."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    rows = rows.select(F.regexp_replace("value", r"\A>", "").alias("value")).where(F.regexp_replace("value", r"\s", "") != "")
    parts = F.split(F.col("value"), "\n", 2)
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("id"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"))


def write_sparse(df: DataFrame, path: str) -> None:
    """A sparse matrix as rows (row, col, value); zeros are left out."""
    df.select("row", "col", "value").where("value <> 0").write.mode("overwrite").parquet(path)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of change of all files at ``paths``; files that Spark skips don't count."""
    seen = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                seen.append((path, f.getPath().toUri().getPath(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


def cached(spark: SparkSession, path: str, make, inputs: list[str] = ()) -> DataFrame:
    """The table at ``path``, made and written there first if it is not there yet.

    With ``inputs``, a fingerprint of the files that it is made from is stored beside it; if they have changed since, it is made again. The mark is written
    last, so what a lost run left half done is not taken for whole.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done, mark = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in ("_SUCCESS", "_inputs"))
    fs = done.getFileSystem(conf)
    now = fingerprint(spark, *inputs) if inputs else ""

    def stored() -> str:
        if not fs.exists(mark):
            return ""
        reader = fs.open(mark)
        try:
            return reader.readUTF()
        finally:
            reader.close()

    if not fs.exists(done) or (inputs and stored() != now):
        make().write.mode("overwrite").parquet(path)
        if inputs:
            writer = fs.create(mark, True)
            writer.writeUTF(now)
            writer.close()
    return spark.read.parquet(path)


def read_json_config(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def peptide_records(df: DataFrame, sequence_col: str = "Modified sequence", time_col: str = "Calibrated retention time") -> DataFrame:
    """``(seq, modifications, tr)``: bare sequence, ``place|name`` of each modification, median time.

    Carbamidomethylation is fixed on C; oxidation and N-terminal acetylation are read from the markers.
    """
    trimmed = F.regexp_replace(F.col(sequence_col), "_", "")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, r"\(ac\)", "a"), r"M\(ox\)", "m"), "C", "c")
    residues = F.split(F.regexp_replace(marked, "^a", ""), "")
    start = F.when(marked.startswith("a"), F.array(F.lit("0|Acetyl"))).otherwise(F.array().cast("array<string>"))
    names = F.create_map(F.lit("m"), F.lit("|Oxidation"), F.lit("c"), F.lit("|Carbamidomethyl"))
    own = F.filter(F.transform(residues, lambda r, i: F.concat((i + 1).cast("string"), F.try_element_at(names, r))), lambda x: x.isNotNull())
    rows = df.where(F.col(sequence_col).isNotNull()).select(bare_sequence(F.col(sequence_col)).alias("seq"), F.array_join(F.concat(start, own), "|").alias("modifications"), F.col(time_col).alias("t"))
    return rows.groupBy("seq", "modifications").agg(F.median("t").alias("tr"))


def write_dense(df: DataFrame, path: str, row: str, col: str, value: str, columns: list) -> None:
    """A dense matrix as one row for each ``row``, with its values in order of ``columns`` as an array, zeros included."""
    values = F.map_from_entries(F.collect_list(F.struct(F.col(col), F.col(value).cast("double"))))
    out = df.groupBy(F.col(row).alias("row")).agg(values.alias("m")).select("row", F.array(*(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in columns)).alias("values"))
    out.write.mode("overwrite").parquet(path)


def read_dense(spark: SparkSession, path: str, columns: list) -> DataFrame:
    """``(row, col, value)`` of every cell of a dense matrix."""
    names = F.array(*(F.lit(c) for c in columns))
    cells = F.explode(F.arrays_zip(names.alias("col"), F.col("values").alias("value")))
    return spark.read.parquet(path).select("row", cells.alias("c")).select("row", "c.col", "c.value")


def path_stem(path) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def task_parameters(grid: DataFrame, task: int, id_col: str = "ArrayTaskID") -> dict:
    """The row of a parameter grid with a task's number."""
    found = grid.where(F.col(id_col) == task).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} rows for task {task}")
    return found[0].asDict()


def parameter_grid(spark: SparkSession, id_col: str = "ArrayTaskID", **values: list) -> DataFrame:
    """All combinations of the given values, the last varying fastest, numbered from 1."""
    rows = [(i + 1, *combination) for i, combination in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, [id_col, *values])


def isotope_patterns(df: DataFrame, sequence_col: str = "Modified sequence", charge_col: str = "Charge", threshold: float = 0.01) -> DataFrame:
    """``df`` with ``IsoMZ`` and ``IsoAbundance``; each distinct sequence and charge is computed once.

    What the kernel returns is far larger than Spark assumes, so the join is hinted to merge: a broadcast would bring all patterns to the driver.
    """
    from scanforge.functions.kernels import isotope_pattern

    keys = df.select(F.col(sequence_col).alias("_s"), F.col(charge_col).alias("_c")).where("_s is not null and _c is not null").distinct()

    def compute(batches):
        for b in batches:
            found = [isotope_pattern(s, c, threshold) for s, c in zip(b.column("_s").to_pylist(), b.column("_c").to_pylist(), strict=True)]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("_s"), b.column("_c"), pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], ["_s", "_c", "IsoMZ", "IsoAbundance"])

    patterns = keys.mapInArrow(compute, T.StructType([*keys.schema.fields, T.StructField("IsoMZ", T.ArrayType(T.DoubleType())), T.StructField("IsoAbundance", T.ArrayType(T.DoubleType()))]))
    return df.join(patterns.hint("merge"), (F.col(sequence_col) == F.col("_s")) & (F.col(charge_col) == F.col("_c")), "left").drop("_s", "_c")
