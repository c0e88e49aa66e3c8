"""Reading tables by format, previews, file facts, chunked processing, and writing results."""

from __future__ import annotations

import json
import pickle
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime
from pathlib import PurePosixPath

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import q
from ..plans.ordering import checkpointed

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".parquet": "parquet", ".feather": "feather", ".xlsx": "excel", ".xls": "excel", ".orc": "orc"}
#: Taken where all lines are valid, and else; the second accepts any byte.
ENCODINGS = ("utf-8", "iso-8859-1")


#: Rows that one task fetches from a database, about.
FETCHED = 1_000_000


class UnsupportedFormat(ValueError):
    """The suffix names no readable format; pickles are never read, as they run code."""


def supported_formats() -> list[str]:
    return sorted(FORMATS)


def is_supported(path: str) -> bool:
    return PurePosixPath(path).suffix.lower() in FORMATS


def _encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, unless a line of any file under path is not valid in it; lines are checked where they lie."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return ENCODINGS[0] if broken.isEmpty() else ENCODINGS[1]


def load(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None, where: str | None = None, **options) -> DataFrame:
    """A table by its suffix; column list and filter reach the scan."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise UnsupportedFormat(f"{suffix or path}: expected one of {', '.join(supported_formats())}")
    kind = FORMATS[suffix]
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        options = {"header": True, "inferSchema": schema is None, "encoding": options.pop("encoding", None) or _encoding(spark, path), **({"sep": "\t"} if kind == "tsv" else {}), **options}
        df = reader.options(**options).csv(path)
    elif kind == "json":
        df = reader.options(**{"multiLine": True, **options}).json(path)
        for envelope in ("data", "records"):
            if envelope in df.columns and df.schema[envelope].dataType.typeName() == "array":
                df = df.select(F.inline(q(envelope)))
                break
    elif kind in ("parquet", "orc"):
        df = reader.options(**options).format(kind).load(path)
    elif kind == "feather":
        import pyarrow.feather as feather

        df = spark.createDataFrame(feather.read_table(path))
    else:
        df = spark.createDataFrame(pd.read_excel(path, **options))
    df = df.where(where) if where else df
    return df.select(*(q(c) for c in columns)) if columns else df


def _literal(value) -> str:
    """A value as SQL text; whole numbers, decimals, dates and times."""
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return repr(value) if isinstance(value, (int, float)) else str(value)


def range_predicates(column: str, low, high, parts: int) -> list[str]:
    """Conditions that split a column between low and high into parts of equal width: every value, also beyond the bounds, and null meet exactly one."""
    if low is None or high is None or parts < 2 or low == high:
        return ["1 = 1"]
    whole = isinstance(low, int) and isinstance(high, int)
    steps = [low + (high - low) * i // parts if whole else low + (high - low) * i / parts for i in range(1, parts)]
    cuts = [_literal(c) for c in dict.fromkeys(steps) if c > low]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts[:-1], cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def hash_predicates(expression: str, parts: int) -> list[str]:
    """Conditions by the remainder of a whole-number expression (such as a database's hash of a key), for skewed or unordered keys; null goes to the first."""
    if parts < 2:
        return ["1 = 1"]
    each = [f"MOD(MOD({expression}, {parts}) + {parts}, {parts}) = {i}" for i in range(parts)]
    return [f"{each[0]} OR ({expression}) IS NULL", *each[1:]]


def load_jdbc(spark: SparkSession, url: str, sql: str, column: str | None = None, parts: int | None = None, hashed: bool = False, **options) -> DataFrame:
    """The rows of a query, read by parts tasks at once if a column is named; selected columns and filters reach the database.

    Parts are ranges between the column's bounds, which a query of one row finds first, or remainders of the column (or an
    expression of it) if hashed. Without a number of parts, one is taken for each FETCHED rows.
    """
    if column is None:
        return spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    bounds = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS n FROM ({sql}) b", **options).load().first()
    parts = parts or -(-int(bounds[2]) // FETCHED)
    conditions = hash_predicates(column, parts) if hashed else range_predicates(column, bounds[0], bounds[1], parts)
    return spark.read.jdbc(url, f"({sql}) q", predicates=conditions, properties={k: str(v) for k, v in options.items()})


def preview(spark: SparkSession, path: str, n: int = 1000) -> DataFrame:
    return load(spark, path).limit(n)


def file_info(spark: SparkSession, path: str) -> dict:
    """Name, suffix, bytes, columns and types; sizes come from Spark's own file source, so any store works."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] if FORMATS.get(PurePosixPath(path).suffix.lower()) != "parquet" else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0]
    df = load(spark, path)
    return {"name": PurePosixPath(path).name, "suffix": PurePosixPath(path).suffix.lower(), "bytes": size, "columns": df.columns, "dtypes": dict(df.dtypes)}


def process_in_chunks(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk_rows: int = 100_000) -> DataFrame:
    """func over chunks of about chunk_rows rows, each within one partition; aggregate the result with DataFrame operations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= chunk_rows:
                yield func(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if held:
            yield func(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)


#: States that one task merges.
MERGED = 32


def aggregate_in_chunks(df: DataFrame, partial: Callable[[pd.DataFrame], object], merge: Callable[[object, object], object], finish: Callable[[object], object] | None = None, chunk_rows: int = 100_000, progress: Callable[[int, int], None] | None = None, every: float = 0.5):
    """A user's aggregate: partial makes a state of a chunk of rows, merge joins two states, finish makes the result.

    A task folds its chunks into one state; states are merged in rounds of tasks until one is left, so the driver gets one
    state whatever the rows. Merging must not depend on the order. progress(tasks done, tasks) is called while the first
    round runs, and progress(rows, rows) with the rows that were folded at its end. No rows give finish(None).
    """
    spark = df.sparkSession

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, some, held, n, rows = None, False, [], 0, 0

        def close() -> None:
            nonlocal state, some, held, n, rows
            if n:
                own = partial(pd.concat(held, ignore_index=True))
                state, some, held, n, rows = merge(state, own) if some else own, True, [], 0, rows + n

        for b in batches:
            while len(b):
                fits = chunk_rows - n
                held.append(b.iloc[:fits])
                n, b = n + min(fits, len(b)), b.iloc[fits:]
                if n == chunk_rows:
                    close()
        close()
        if some:
            yield pd.DataFrame({"state": [pickle.dumps(state)], "rows": [rows]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, some = None, False
        for b in batches:
            for raw in b["state"]:
                state, some = (merge(state, pickle.loads(raw)) if some else pickle.loads(raw)), True
        if some:
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

    with _watched(spark, progress, every):
        states = checkpointed(df.mapInPandas(fold, "state binary, rows long"))
    n, rows = states.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if progress:
        progress(rows, rows)
    states = states.select("state")
    while n > 1:
        n = -(-n // MERGED)
        states = checkpointed(states.repartition(n).mapInPandas(join, "state binary"))
        n = states.count()
    got = states.first()
    state = pickle.loads(bytes(got["state"])) if got else None
    return finish(state) if finish else state


class _watched:
    """Calls progress with the tasks done and known of the jobs that run inside, from a thread."""

    def __init__(self, spark: SparkSession, progress: Callable[[int, int], None] | None, every: float):
        self.sc, self.progress, self.every, self.over = spark.sparkContext, progress, every, threading.Event()

    def __enter__(self) -> None:
        if self.progress:
            self.tag = f"chunks-{uuid.uuid4().hex}"
            self.sc.setJobGroup(self.tag, "aggregate in chunks")
            self.thread = threading.Thread(target=self._poll, daemon=True)
            self.thread.start()

    def _poll(self) -> None:
        tracker, last = self.sc.statusTracker(), None
        while not self.over.wait(self.every):
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.tag)]
            stages = [s for j in jobs if j for i in j.stageIds if (s := tracker.getStageInfo(i))]
            now = (sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))
            if now != last and now[1]:
                self.progress(*now)
                last = now

    def __exit__(self, *_: object) -> None:
        if self.progress:
            self.over.set()
            self.thread.join()
            self.sc.setLocalProperty("spark.jobGroup.id", None)


def apply_rows(df: DataFrame, func: Callable, schema: str) -> DataFrame:
    """A Python function of a row's dict that returns a dict, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([func(r) for r in b.to_dict("records")])

    return df.mapInPandas(run, schema)


def plain(value):
    """Rows, numpy values and containers as JSON-ready values; NaN and infinities become null."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, str):
        value = value.item()
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    df.write.format(kind).mode(mode).save(path)


def write_json(result: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(plain(result), f, indent=1)


def export_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def scoring_code(model_path: str, output: str) -> str:
    """A script that scores a parquet table with a saved pipeline."""
    return f'''from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

spark = SparkSession.builder.getOrCreate()
PipelineModel.load({model_path!r}).transform(spark.read.parquet("input.parquet")).write.parquet({output!r})
'''
