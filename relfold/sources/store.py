"""Tables and profiles kept between runs, by what their files are.

A delimited file is parsed once per change: its texts are written as Parquet while the types of its columns and its
rows are observed, and later runs read that copy. Key columns are sketched once per file, so an added file costs the
reading of that file; exact counts are kept, too, where a key may be unique. A copy or a sketch is named by a digest of
its files' names, sizes and times of change, and is only used once it has been written whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from relfold.functions.columns import distinct_value, field_of, is_integral, present, quoted
from relfold.operators.checks import Counts
from relfold.operators.profile import PROFILE_SCHEMA, SKETCH_ERROR, SKETCH_LOG_BUCKETS
from relfold.sources.files import SourceFile, as_types, csv_texts, declared_types, type_checks, types_found

FACTS = "file string, column_name string, row_count bigint, non_null_count bigint, low bigint, high bigint, sketch binary"
EXACT = "files string, column_name string, distinct_count bigint"


@dataclass(frozen=True)
class FileState:
    path: str
    size: int
    changed: int

    @property
    def digest(self) -> str:
        return hashlib.sha256(f"{self.path}|{self.size}|{self.changed}".encode()).hexdigest()


def file_states(spark: SparkSession, path: str) -> list[FileState]:
    """The files of a table, hidden ones aside, by name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listing = [], fs.listFiles(target, True)
    while listing.hasNext():
        status = listing.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append(FileState(status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found, key=lambda f: f.path)


def digest_of(files: Sequence[FileState], *settings: object) -> str:
    return hashlib.sha256(json.dumps([[f.digest for f in files], *map(str, settings)]).encode()).hexdigest()


@dataclass(frozen=True)
class StoredTable:
    """Files of a table, and how to read some of them alike."""

    files: list[FileState]
    read: Callable[[Sequence[str]], DataFrame]


@dataclass
class TableStore:
    """A store below ``folder``, which must outlive the runs and be shared by all executors."""

    spark: SparkSession
    folder: str
    counts: dict[str, Counts] = field(default_factory=dict)
    tables: dict[str, StoredTable] = field(default_factory=dict)

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def read(self, source: SourceFile, schema: str | None = None, default_sep: str | None = None, **options) -> DataFrame:
        """A table as ``read_table`` gives it, a delimited one from its copy."""
        if source.format == "parquet":
            whole = self.spark.read.parquet(source.path)
            self.tables[source.name] = StoredTable(file_states(self.spark, source.path), lambda paths: self.spark.read.schema(whole.schema).parquet(*paths))
            return whole
        settings = sorted({"schema": schema, "default_sep": default_sep, **options}.items(), key=str)
        copy = f"{self.folder.rstrip('/')}/tables/{source.name}-{digest_of(file_states(self.spark, source.path), settings)[:32]}"
        if not self._exists(f"{copy}/about/_SUCCESS"):
            self._copy(source, schema, default_sep, options, copy)
        about = json.loads(self.spark.read.text(f"{copy}/about").first()[0])
        self.counts[source.name] = Counts(about["rows"])

        def typed(paths: Sequence[str]) -> DataFrame:
            # The copy's columns have numbers, as any name may stand in the file.
            texts = self.spark.read.schema(", ".join(f"c{i} string" for i in range(len(about["names"])))).parquet(*paths)
            return as_types(texts.toDF(*about["names"]), about["types"])

        self.tables[source.name] = StoredTable(file_states(self.spark, f"{copy}/texts"), typed)
        return typed([f"{copy}/texts"])

    def _copy(self, source: SourceFile, schema: str | None, default_sep: str | None, options: Mapping, copy: str) -> None:
        """Parse a file once: the texts are written while their types and rows are observed."""
        texts = csv_texts(self.spark, source.path, default_sep=default_sep, **options)
        kinds = declared_types(self.spark, texts, schema, source.path) if schema else None
        names, observed = texts.columns, Observation()
        watched = texts.observe(observed, F.count(F.lit(1)).alias("rows"), *([] if kinds else type_checks(texts)))
        watched.toDF(*[f"c{i}" for i in range(len(names))]).write.mode("overwrite").parquet(f"{copy}/texts")
        found = observed.get
        about = json.dumps({"rows": found["rows"], "names": names, "types": kinds or types_found(names, found)})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{copy}/about")

    # Profiles -----------------------------------------------------------------------------------------

    def key_profile(self, is_key: Callable[[str, str], bool], names: Sequence[str], threshold: float = 0.98) -> DataFrame:
        """The key profile of tables that this store has read, in the order of ``names``: what
        ``relfold.operators.profile.key_profile`` gives. Only files without sketches are read, and for keys near the
        threshold, files without exact counts; where the files' ranges of such a key overlap, its whole column is."""
        rows = []
        for ordinal, name in enumerate(names):
            stored = self.tables[name]
            columns = stored.read([f.path for f in stored.files]).schema.fields
            keys = [f.name for f in columns if is_key(name, f.name)]
            if not keys:
                continue
            facts = self._facts(name, stored, keys)
            exact = self._exact(name, stored, facts, threshold)
            for position, key in enumerate(keys):
                fact = facts[key]
                distinct = exact.get(key, fact["distinct"])
                n = fact["rows"]
                rows.append((name, ordinal, key, position, field_type(columns, key), n, fact["filled"], distinct, *[(v / n if n else None) for v in (fact["filled"], distinct)], key in exact))
        return self.spark.createDataFrame(rows, PROFILE_SCHEMA + ", is_exact boolean")

    def _facts(self, name: str, stored: StoredTable, keys: Sequence[str]) -> dict[str, dict]:
        """Rows, values, estimated distinct values and disjointness of ranges of each key, merged over the files."""
        place = f"{self.folder.rstrip('/')}/facts/{name}"
        wanted = [(f.digest, key) for f in stored.files for key in keys]
        known = set()
        if self._exists(place):
            known = {(r["file"], r["column_name"]) for r in self.spark.read.schema(FACTS).parquet(place).select("file", "column_name").collect()}
        new = [f for f in stored.files if any((f.digest, key) not in known for key in keys)]
        if new:
            self._sketch(stored, new, keys).write.mode("append").parquet(place)
        listed = self.spark.createDataFrame(wanted, "file string, column_name string")
        mine = self.spark.read.schema(FACTS).parquet(place).join(F.broadcast(listed), ["file", "column_name"])
        mine = mine.dropDuplicates(["file", "column_name"])
        ranges = F.array_sort(F.collect_list(F.when(F.col("non_null_count") > 0, F.struct("low", "high"))))
        apart = F.forall(F.sequence(F.lit(2), F.greatest(F.size("ranges"), F.lit(2))), lambda k: (F.size("ranges") < k) | (F.get("ranges", k - 2)["high"] < F.get("ranges", k - 1)["low"]))
        merged = mine.groupBy("column_name").agg(
            F.sum("row_count").alias("rows"), F.sum("non_null_count").alias("filled"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct"), ranges.alias("ranges"),
            F.bool_and(F.col("low").isNotNull() | (F.col("non_null_count") == 0)).alias("ranged"),
        )
        found = merged.select("column_name", "rows", "filled", "distinct", (F.col("ranged") & apart).alias("apart")).collect()
        return {r["column_name"]: r.asDict() for r in found}

    def _sketch(self, stored: StoredTable, files: Sequence[FileState], keys: Sequence[str]) -> DataFrame:
        """FACTS of some files, from one pass over them."""
        df = stored.read([f.path for f in files])
        parts = []
        for key in keys:
            number = quoted(key).cast("bigint") if is_integral(field_of(df, key).dataType) else F.lit(None).cast("bigint")
            sketch = F.hll_sketch_agg(distinct_value(df, key).cast("string"), SKETCH_LOG_BUCKETS)
            parts.append(
                F.struct(
                    F.lit(key).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count(present(df, key)).alias("non_null_count"),
                    F.min(number).alias("low"), F.max(number).alias("high"), sketch.alias("sketch"),
                )
            )
        by_file = df.select("*", F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.array(*parts).alias("facts"))
        digests = self.spark.createDataFrame([(_plain(f.path), f.digest) for f in files], "path string, file string")
        found = digests.join(by_file.withColumn("path", F.regexp_replace("__file", "^file:/*", "/")), "path", "left")
        empty = F.array(*[
            F.struct(
                F.lit(k).alias("column_name"), F.lit(0).cast("bigint").alias("row_count"), F.lit(0).cast("bigint").alias("non_null_count"),
                F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high"), F.lit(None).cast("binary").alias("sketch"),
            )
            for k in keys
        ])
        return found.select("file", F.inline(F.coalesce("facts", empty)))

    def _exact(self, name: str, stored: StoredTable, facts: Mapping[str, Mapping], threshold: float) -> dict[str, int]:
        """Exact distinct values of the keys whose estimate is near the threshold or above."""
        margin = threshold * (1 - 10 * SKETCH_ERROR)
        near = [k for k, f in facts.items() if f["rows"] and f["distinct"] / f["rows"] >= margin]
        if not near:
            return {}
        place = f"{self.folder.rstrip('/')}/exact/{name}"
        known: dict[tuple[str, str], int] = {}
        if self._exists(place):
            known = {(r["files"], r["column_name"]): r["distinct_count"] for r in self.spark.read.schema(EXACT).parquet(place).collect()}
        whole = digest_of(stored.files)
        out = {}
        for key in near:
            if (whole, key) in known:
                out[key] = known[whole, key]
                continue
            # Values of files whose ranges do not meet are different, so their counts add up.
            groups = [[f] for f in stored.files] if facts[key]["apart"] else [stored.files]
            names = [digest_of(g) for g in groups]
            todo = [g for g, n in zip(groups, names) if (n, key) not in known]
            if todo:
                df = stored.read([f.path for g in todo for f in g])
                group = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/") if facts[key]["apart"] else F.lit(0)
                values = df.select(group.alias("g"), distinct_value(df, key).cast("string").alias("v")).where("v is not null")
                counted = {r["g"]: r["n"] for r in values.distinct().groupBy("g").agg(F.count("*").alias("n")).collect()}
                new = [(digest_of(g), key, counted.get(_plain(g[0].path) if facts[key]["apart"] else 0, 0)) for g in todo]
                self.spark.createDataFrame(new, EXACT).coalesce(1).write.mode("append").parquet(place)
                known |= {(n, k): c for n, k, c in new}
            out[key] = sum(known[n, key] for n in names)
        return out


def _plain(path: str) -> str:
    """A path as the regular expression above makes it; local paths come with one to three slashes."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def field_type(fields: Sequence[T.StructField], name: str) -> str:
    return next(f.dataType.simpleString() for f in fields if f.name == name)
