"""Metadata and CSV sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions.text import format_ordinal

# Schemas of the input files.
METADATA_SCHEMA = T.StructType([T.StructField("competitions", T.ArrayType(T.StructType([
    T.StructField("year", T.StringType()),
    T.StructField("round", T.ArrayType(T.StructType([
        T.StructField("desc", T.StringType()),
        T.StructField("contest", T.StringType()),
        T.StructField("numPlayers", T.StringType()),
        T.StructField("problems", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()), T.StructField("id", T.StringType())]))),
    ]))),
])))])


def read_contest_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: the nested contest JSON flattened to
    rounds (contest, year, round_label) and problems (contest, problem_id, problem_label).

    Round numbers restart per competition (``'%03d desc'``); problem numbers are
    global in document order (competition, round, problem position).  The
    metadata is small and read once (the reference re-read it per file).
    """
    doc = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(path)
    comp = doc.select(F.posexplode("competitions").alias("c_pos", "c"))
    rnd = comp.select("c_pos", F.col("c.year").alias("year"), F.posexplode("c.round").alias("r_pos", "r"))
    rounds = rnd.select(F.col("r.contest").alias("contest"), "year",
                        format_ordinal(F.col("r_pos"), F.col("r.desc")).alias("round_label"))
    prob = rnd.select("c_pos", "r_pos", F.col("r.contest").alias("contest"),
                      F.posexplode_outer("r.problems").alias("p_pos", "p")).where(F.col("p").isNotNull())
    w = Window.orderBy("c_pos", "r_pos", "p_pos")  # metadata-sized (hundreds of rows)
    problems = prob.select("contest", F.col("p.id").alias("problem_id"),
                           format_ordinal(F.row_number().over(w) - 1, F.col("p.name")).alias("problem_label"))
    return rounds, problems


def enrich_with_metadata(subs: DataFrame, rounds: DataFrame, problems: DataFrame,
                         unique_unknown: bool = False) -> DataFrame:
    """Year and round by contest, problem label by (contest, problem); an
    unknown problem gets ``'NNN unknown_name'`` with NNN = the number of known
    problems (the reference's constant), or a fresh number per unknown problem
    with ``unique_unknown``.  Both metadata tables are tiny: broadcast."""
    n_known = problems.count()
    out = (subs.join(F.broadcast(rounds), "contest", "left")
           .join(F.broadcast(problems.withColumnRenamed("problem_id", "problem")), ["contest", "problem"], "left"))
    if unique_unknown:
        unknown = (out.where(F.col("problem_label").isNull()).select("contest", "problem").distinct()
                   .withColumn("_u", F.dense_rank().over(Window.orderBy("contest", "problem")) - 1 + n_known))
        out = out.join(unknown, ["contest", "problem"], "left")
        label = F.coalesce(F.col("problem_label"), format_ordinal(F.col("_u"), F.lit("unknown_name")))
        return out.withColumn("problem_label", label).drop("_u")
    return out.withColumn("problem_label", F.coalesce(
        F.col("problem_label"), format_ordinal(F.lit(n_known), F.lit("unknown_name"))))


PROBLEM_CSV_SCHEMA = ("submission_id STRING, problem_id STRING, user_id STRING, date STRING, language STRING, "
                      "original_language STRING, filename_ext STRING, status STRING, cpu_time STRING, "
                      "memory STRING, code_size INT, accuracy STRING")


def read_problem_catalog(spark: SparkSession, root: str, dataset: str | None = None,
                         language: str | None = None, min_size: int = 100,
                         csv_schema: str = PROBLEM_CSV_SCHEMA) -> DataFrame:
    """S4 + F2 + F4 + F10 + F11: ``problem_list.csv`` (id, dataset) selects the
    problems, their ``metadata/<id>.csv`` files are read in one multi-path scan;
    rows with ``code_size <= min_size`` are rejected.
    Output (problem_id, username BIGINT, language, filepath, submission_id, code_size)."""
    cat = spark.read.option("header", True).csv(f"{root}/problem_list.csv")
    if dataset is not None:
        cat = cat.where(F.col("dataset") == dataset)
    ids = [r["id"] for r in cat.select("id").collect()]  # the catalog: one row per problem
    if not ids:
        return spark.createDataFrame([], "problem_id string, username bigint, language string, "
                                         "filepath string, submission_id string, code_size int")
    meta = spark.read.option("header", True).schema(csv_schema).csv([f"{root}/metadata/{i}.csv" for i in ids])
    if language is not None:
        meta = meta.where(F.col("language") == language)
    meta = meta.where(F.col("code_size") > min_size)
    return meta.select(
        "problem_id", F.substring("user_id", 2, 1 << 30).cast("bigint").alias("username"), "language",
        F.concat_ws("/", "problem_id", "language", F.concat_ws(".", "submission_id", "filename_ext")).alias("filepath"),
        "submission_id", "code_size")


def read_tokens_csv(spark: SparkSession, path: str) -> DataFrame:
    """``class,token`` rows in Latin-1; repeated header rows dropped."""
    df = spark.read.schema("class STRING, token STRING").option("encoding", "ISO-8859-1").csv(path)
    return df.where(F.col("class") != "class")


def parse_id_list(text) -> Column:
    """``"[1, 2, ]"`` -> [1, 2]."""
    ids = F.split(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\[\] ]", ""), ",")
    return F.transform(F.filter(ids, lambda x: x != ""), lambda x: x.cast("int"))


def read_encoded_csv(spark: SparkSession, path: str) -> DataFrame:
    """``username|filename|"[1, 2, ]"`` -> (username, filename, file_content array<int>)."""
    df = spark.read.option("header", True).option("sep", "|").csv(path)
    return df.select("username", "filename", parse_id_list("file_content").alias("file_content"))


def read_experiments(spark: SparkSession, paths: list[str], header_fallback: list[str] | None = None) -> DataFrame:
    """Experiment result CSVs with differing columns.  Every file is read
    with its own header (a file whose first cell is numeric has none and gets
    ``header_fallback``) and the frames are united by name; ``experiment`` is
    the folder of the file."""
    out = None
    for p in paths:
        first = spark.read.text(p).limit(1).collect()
        has_header = bool(first) and not first[0][0].split(",")[0].strip().lstrip("-").replace(".", "").isdigit()
        if has_header:
            df = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True) \
                .option("escape", '"').csv(p)
        else:
            df = spark.read.option("header", False).option("inferSchema", True).option("escape", '"').csv(p)
            if header_fallback:
                df = df.toDF(*header_fallback[:len(df.columns)])
        df = df.withColumn("experiment", F.element_at(F.split(F.input_file_name(), "/"), -2))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# ---- fixed values: language groups of the batch corpus builds ----------------
LANGUAGE_GROUPS = (
    [("python", "py")]
    + [("cpp", e) for e in "cxx cc cpp c++ C".split()]
    + [("c_cpp", e) for e in "c cxx cc cpp c++ C".split()]
    + [("java", "java")]
    + [("c_cpp_h", e) for e in "c cxx cc cpp c++ C h hh H hxx hpp h++".split()]
)
# ------------------------------------------------------------------------------


def batch_language_builds(files: DataFrame, path_col: str = "filepath", groups=LANGUAGE_GROUPS) -> DataFrame:
    """One ingest for all language groups: an extension may belong to
    several groups, so the group table is joined (broadcast, a handful of rows)."""
    spark = files.sparkSession
    g = spark.createDataFrame(groups, "language_group string, ext string")
    from penprint.functions.text import file_extension
    return files.withColumn("ext", file_extension(F.col(path_col))).join(F.broadcast(g), "ext")
