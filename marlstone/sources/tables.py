"""Tables from files and from constants; each row gets a row_id where order carries meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas

#: Cells that a CSV scan reads as null.
NA_TOKENS = (
    *("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN"),
    *("<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"),
)
BOTH_ENCODERS = ("FremyCompany/BioLORD-2023", "cross-encoder/stsb-distilroberta-base", "neuml/pubmedbert-base-embeddings", "sentence-transformers/all-MiniLM-L12-v2")
BI_ENCODERS = (*BOTH_ENCODERS, "distilbert-base-nli-mean-tokens")
CROSS_ENCODERS = BOTH_ENCODERS
#: What models put around a CSV answer, taken away one after another, and only where it stands word by word.
BOILERPLATE: tuple[str, ...] = (
    "Here is the extracted recommendation list in CSV format:\n\n",
    "\nNote: The strength of recommendations and level "
    "of confidence in estimates of effect may vary "
    "depending on the specific guideline document and "
    "the context in which they are used. "
    "These recommendations are based on the provided "
    "text and may not reflect the full range "
    "of recommendations or evidence available for each condition.",
    "\nNote that some recommendations are conditional or "
    "have a low level of confidence in estimates of effect.",
    "\nNote: The recommendations are based on the provided guideline text.",
)


def with_row_id(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """Adds numbers that grow in the order of the columns, which files don't have; with gaps.

    Where no column tells rows apart their order is that of their hashes. Without columns
    it is the order in which the files are read. A sort by ranges, no single task.
    """
    if order:
        df = df.orderBy(*(F.col(c).asc_nulls_first() for c in order), F.xxhash64(*df.columns))
    return df.withColumn(name, F.monotonically_increasing_id())


def nulled(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """String cells that hold a token for missing become null."""
    strings = [f.name for f in df.schema.fields if f.dataType == schemas.S]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) for c in strings})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Sentence pairs from a headless TSV file, or all *.txt files of a folder, with row_id.

    Rows are in the order of file names, then of lines. A folder without such
    files fails, as there is nothing to read.
    """
    reader = spark.read.schema(schemas.PAIRS).option("sep", "\t").option("quote", "")
    rows = reader.csv(path) if path.endswith((".txt", ".tsv")) else reader.option("pathGlobFilter", "*.txt").csv(path)
    keys = [F.col("_metadata.file_path").alias("mst_f"), F.col("_metadata.file_block_start").alias("mst_s"), F.monotonically_increasing_id().alias("mst_i")]
    placed = rows.select("*", *keys).orderBy("mst_f", "mst_s", "mst_i")
    return placed.withColumn("row_id", F.monotonically_increasing_id()).drop("mst_f", "mst_s", "mst_i")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: recommendation, class and LOE as strings, other columns too, and row_id."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    missing = [f.name for f in schemas.RECOMMENDATIONS.fields if f.name not in rows.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return nulled(rows).withColumn("row_id", F.monotonically_increasing_id())


def constants(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A relation of literals with their positions."""
    return spark.createDataFrame(list(enumerate(values)), f"pos int, `{name}` string")


def model_names(spark: SparkSession) -> DataFrame:
    """Names of the eleven models, their kind, and whether they can be trained."""
    rows = [("spacy", "document", False), ("angle", "embedding", True)]
    rows += [(f"sentence_transformer_{m}", "bi-encoder", False) for m in BI_ENCODERS]
    rows += [(f"cross_encoder_{m}", "cross-encoder", False) for m in CROSS_ENCODERS]
    return spark.createDataFrame(rows, "model string, kind string, trainable boolean")
