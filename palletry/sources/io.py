"""Readers and writers with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from palletry.functions.text import route_line

L, D, S, I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


ITEM_ROWS = schema(dispatch_id=L, length=I, width=I, height=I)
ITEM_TYPES = schema(dispatch_id=L, if_loaded=I, n_types=L, dim_s=I, dim_m=I, dim_l=I, n_items=L)
ERROR_ROWS = schema(
    order_id=L, distance_to_hyperplane=D, predicted_label=I, actual_label=I, prediction_probability=D, is_false_positive=S, is_false_negative=S, error_type=S
)
LINEAR_MODEL = schema(
    scaler_min=T.ArrayType(D), scaler_max=T.ArrayType(D), feature_names=T.ArrayType(S), drop_cols=T.ArrayType(S), coef=T.ArrayType(T.ArrayType(D)), intercept=T.ArrayType(D), model_C=D, model_kernel=S
)
RULES = schema(id=S, code=S, fn_corr=L, fp_corr=L, fn_miss=L, fp_over=L, score=D, fitness_history=T.ArrayType(D), island_id=L, easy_overrides=L)
PROGRESS = schema(iteration=L, step_ok=T.BooleanType(), best_score=D, n_rules=L, failure_kind=S, failure_message=S, failure_detail=S, response_preview=S)
_METRICS = schema(name=S, accuracy=D, precision=D, recall=D, auc=D, tn=L, fp=L, fn=L, tp=L, fpr=D, fnr=D, tpr_at_fpr1pct=D, best_rule_score=D)
RESULTS = schema(
    baseline=_METRICS, svm=_METRICS, hybrid=_METRICS, llm_model=S, timestamp=S, resumed=T.BooleanType(), resume_start_iteration=L, n_hard_cases=schema(fn=L, fp=L, easy_tn=L, easy_tp=L)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """`df`, or an error that names the columns it lacks."""
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def read_csv(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """The columns of `kind` of CSV files with a header line, by name, in whatever order they stand; others are left out.

    A missing name is an error, and so is a file whose header differs from that of the first one. A byte order mark in front
    is no part of the first name.
    """
    header = [c.removeprefix("\ufeff") for c in spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns]
    known = {f.name: f for f in kind}
    found = T.StructType([known.get(c, T.StructField(c, S)) for c in header])
    rows = spark.read.schema(found).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    return require_columns(rows, kind.names).select(*kind.names)


def read_linear_model(spark: SparkSession, path: str) -> DataFrame:
    """One row (nth, feature, low, high, weight) for each feature of a stored linear model, with its intercept."""
    m = spark.read.schema(LINEAR_MODEL).option("multiLine", True).json(path)
    parts = F.arrays_zip(m["feature_names"].alias("feature"), m["scaler_min"].alias("low"), m["scaler_max"].alias("high"), m["coef"][0].alias("weight"))
    return m.select(F.posexplode(parts).alias("nth", "p"), F.col("intercept")[0].alias("intercept")).select("nth", "p.*", "intercept")


def read_rules(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stored rules, as data only, of a JSON array or of `lines`; lacking counts are zero."""
    r = spark.read.schema(RULES).option("multiLine", not lines).json(path)
    return r.fillna({"fn_corr": 0, "fp_corr": 0, "fn_miss": 0, "fp_over": 0, "score": 0.0, "island_id": 0, "easy_overrides": 0})


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All results.json below a folder, once each, with their path and run name."""
    r = spark.read.schema(RESULTS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").json(root)
    r = r.withColumn("path", F.col("_metadata.file_path")).dropDuplicates(["path"])
    return r.withColumn("run", F.regexp_extract("path", r"/([^/]+)/results\.json$", 1)).orderBy("path")


def experiments(runs: DataFrame) -> DataFrame:
    """Of `read_runs` those in folders `exp_...` somewhere below a folder `by_model`."""
    return runs.where(F.col("run").startswith("exp_") & F.col("path").contains("/by_model/"))


def with_rule_counts(runs: DataFrame, root: str) -> DataFrame:
    """`read_runs` with `n_rules`: the length of the evolved_rules.json beside each results.json; null without one or if it is no list.

    Both file trees are joined by the parent folder.
    """
    spark = runs.sparkSession
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "evolved_rules.json").text(root)
    folder = lambda path: F.regexp_replace(path, r"/[^/]*$", "")
    counts = files.select(folder(F.col("_metadata.file_path")).alias("_folder"), F.json_array_length("value").cast("long").alias("n_rules"))
    return runs.withColumn("_folder", folder(F.col("path"))).join(counts, "_folder", "left").drop("_folder")


def write_linear_model(spark: SparkSession, features, intercept: float, path: str, c: float = 10.0, drop: tuple[str, ...] = ()) -> None:
    """A linear model, (name, low, high, weight) for each feature, as the JSON document that `read_linear_model` reads."""
    names, low, high, weight = ([f[i] for f in features] for i in range(4))
    row = ([float(v) for v in low], [float(v) for v in high], names, [*drop], [[float(v) for v in weight]], [float(intercept)], float(c), "linear")
    spark.createDataFrame([row], LINEAR_MODEL).coalesce(1).write.mode("overwrite").json(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rules as JSON lines, a rule a line, for `read_rules(..., lines=True)`; those of many islands need no single task."""
    rules.select(*RULES.fieldNames()).write.mode("overwrite").json(path)


def last_snapshot(spark: SparkSession, root: str, pattern: str = r"iter_(\d+)") -> DataFrame:
    """The largest iteration number found in file names below a folder (-1 if there is none)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path"))
    nth = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    return files.agg(F.coalesce(F.max(F.nullif(nth, F.lit("")).cast("int")), F.lit(-1)).alias("iteration"))


def read_tsplib(spark: SparkSession, path: str) -> DataFrame:
    """(instance, node, x, y) of TSPLIB coordinate files, scaled by the larger range; headers and EOF are no points."""
    return tsplib_points(spark.read.text(path).withColumn("instance", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsp$", 1)))


def tsplib_points(lines: DataFrame) -> DataFrame:
    """`read_tsplib` for lines (instance, value) already read."""
    parts = F.split(F.trim("value"), r"\s+")
    points = lines.select("instance", F.try_element_at(parts, F.lit(1)).try_cast("int").alias("node"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("x"), F.try_element_at(parts, F.lit(3)).try_cast("double").alias("y"))
    points = points.where("node is not null and x is not null and y is not null")
    own = Window.partitionBy("instance")
    size = F.greatest(F.max("x").over(own) - F.min("x").over(own), F.max("y").over(own) - F.min("y").over(own))
    return points.select("instance", "node", ((F.col("x") - F.min("x").over(own)) / size).alias("x"), ((F.col("y") - F.min("y").over(own)) / size).alias("y"))


def read_tours(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, pos, x, y, node): lines of coordinates, the word `output` and a tour of 1-based nodes."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), F.split("value", r"\s*output\s*").alias("half"))
    t = t.where(F.size("half") == 2)
    numbers = F.transform(F.split(F.trim(F.col("half")[0]), r"\s+"), lambda x: x.cast("double"))
    tour = F.transform(F.split(F.trim(F.col("half")[1]), r"\s+"), lambda x: x.cast("int"))
    t = t.select("file", "line", numbers.alias("xy"), F.posexplode(tour).alias("pos", "node"))
    return t.select("file", "line", "pos", "node", F.try_element_at("xy", F.col("node") * 2 - 1).alias("x"), F.try_element_at("xy", F.col("node") * 2).alias("y"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, depot, customers, capacity, demand, cost, node_flag) of route files, a line an instance."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), route_line(F.col("value")).alias("r"))
    return t.select("file", "line", "r.*").where("customers is not null")


def append_progress(df: DataFrame, path: str) -> None:
    """Adds rows to a JSON lines log."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).options(header=True).save(path) if kind == "csv" else df.write.mode("overwrite").format(kind).save(path)


def report_json(row: DataFrame) -> str:
    """A one-row frame as a JSON document."""
    first = row.select(F.to_json(F.struct("*")).alias("text")).first()
    return json.dumps(json.loads(first.text), ensure_ascii=False, indent=2) if first else "{}"


#: Rows of a task where keys are many and small.
TASK_ROWS = 500_000


def tasks(df: DataFrame) -> int | None:
    """How many tasks rows like those of `df`, a stored table, should be dealt to; None if the session's number will do.

    Sorts and windows of a task take memory by its rows. With a number that grows with the table, a task's share doesn't.
    """
    n = -(-df.count() // TASK_ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """`df` dealt by its keys to `n` tasks; as it is without a number, as Spark then shuffles where it must."""
    return df if n is None else df.repartition(n, *keys)
