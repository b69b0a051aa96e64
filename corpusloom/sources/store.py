"""A corpus of documents, sections and chunks in a folder, written in versions.

Every change appends one folder ``<table>/version=N`` of full rows or
tombstones; a read takes the last version of each id.  Version numbers are
claimed by creating a file that must not exist, so two writers never share
one, and a retried write overwrites its own folder only.  :meth:`Corpus.compact` folds a table's versions.

Defined results: adding an id that exists or occurs twice raises ``ValueError``; updating a
missing id does nothing; rows without an id raise ``ValueError``; deleting a document deletes its sections
and chunks; settings and cached values are last write wins.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "documents": "id string, name string, source_type string, source_path string, content_type string, raw_markdown string, title string, author string, created_date timestamp, tags array<string>, metadata_json string, enriched_at timestamp, section_count int, chunk_count int, token_count int, ingested_at timestamp, updated_at timestamp",
    "sections": "id string, document_id string, parent_id string, level int, path string, position int, title string, content string, summary string, key_terms array<string>, hypothetical_questions array<string>, entities array<map<string,string>>, semantic_type string, importance_score double, start_line int, end_line int, token_count int",
    "chunks": "id string, document_id string, section_id string, chunk_index int, section_path string, content string, enriched_content string, embedding array<float>, section_title string, section_summary string, semantic_type string, char_offset_start int, char_offset_end int",
    "meta": "id string, value string",
    "cache": "id string, cache_type string, cache_key string, value string, created_at timestamp",
}
ENRICHMENT = ("summary", "key_terms", "hypothetical_questions", "semantic_type", "entities", "importance_score")


class Corpus:
    """An existing corpus; :meth:`create` makes one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if not self._exists("_corpus"):
            raise FileNotFoundError(f"no corpus at {path}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str | None = None, embedding_model: str | None = None) -> Corpus:
        """A new, empty corpus; an existing one raises ``FileExistsError``."""
        self = cls.__new__(cls)
        self.spark, self.path = spark, path.rstrip("/")
        if self._exists("_corpus"):
            raise FileExistsError(f"a corpus exists at {path}")
        now = datetime.datetime.now(datetime.UTC).isoformat()
        self._claim("_corpus")
        values = {"name": name or self.path.rsplit("/", 1)[-1], "created_at": now, "updated_at": now, "embedding_model": embedding_model}
        self._write("meta", spark.createDataFrame([(k, v) for k, v in values.items() if v], SCHEMAS["meta"]))
        return self

    # -- files

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        fs, p = self._fs(name)
        return fs.exists(p)

    def _claim(self, name: str) -> bool:
        fs, p = self._fs(name)
        if fs.exists(p):
            return False
        try:
            fs.create(p, False).close()
        except Exception:
            return False  # another writer was faster
        return True

    def _next(self, table: str) -> int:
        fs, p = self._fs(f"_versions/{table}")
        last = max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0
        while not self._claim(f"_versions/{table}/{last + 1}"):
            last += 1
        return last + 1

    def _write(self, table: str, rows: DataFrame, deleted: bool = False) -> int:
        fields = StructType.fromDDL(SCHEMAS[table])
        have = set(rows.columns)
        full = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], F.lit(deleted).alias("_deleted"))
        n = self._next(table)
        full.write.mode("overwrite").parquet(f"{self.path}/{table}/version={n}")
        return n

    # -- reading

    def read(self, table: str) -> DataFrame:
        """The current rows of a table."""
        schema = SCHEMAS[table] + ", _deleted boolean, version long"
        if not self._exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").schema(schema).parquet(f"{self.path}/{table}")
        fs, p = self._fs(table)
        if sum(1 for s in fs.listStatus(p) if s.isDirectory()) > 1:
            last = rows.select("id", "version").groupBy("id").agg(F.max("version").alias("version"))  # ids and numbers only
            rows = rows.join(last, ["id", "version"])
        return rows.where(~F.col("_deleted")).select(*StructType.fromDDL(SCHEMAS[table]).names)

    def get(self, table: str, ident: str) -> DataFrame:
        """The row of one id."""
        return self.read(table).where(F.col("id") == ident)

    def sections_of(self, document_id: str) -> DataFrame:
        """Sections of a document by path (as text)."""
        return self.read("sections").where(F.col("document_id") == document_id).orderBy("path", "id")

    def chunks_of(self, document_id: str) -> DataFrame:
        """Chunks of a document by index."""
        return self.read("chunks").where(F.col("document_id") == document_id).orderBy("chunk_index", "id")

    # -- writing

    def add(self, table: str, rows: DataFrame) -> None:
        """Insert new rows (one or many)."""
        if rows.where("id is null").limit(1).count():
            raise ValueError("a row has no id")
        twice = rows.groupBy("id").count().where("count > 1").select("id").unionByName(rows.select("id").join(self.read(table).select("id"), "id", "left_semi"))
        bad = [r[0] for r in twice.limit(3).collect()]
        if bad:
            raise ValueError(f"ids exist or occur twice in {table}: {bad}")
        if table == "chunks" and "embedding" in rows.columns and not self.get_meta("embedding_model") and rows.where("embedding is not null").limit(1).count():
            raise ValueError("set the embedding model before adding vectors")
        if table == "chunks" and "embedding" in rows.columns:  # an empty vector is no vector
            rows = rows.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding")))
        self._write(table, rows)

    def update(self, table: str, changes: DataFrame, columns: list[str] | tuple[str, ...] | None = None) -> None:
        """Overwrite *columns* (default: all given) of the rows whose ids exist; the last of repeated ids is not defined, so they raise."""
        names = [c for c in (columns or changes.columns) if c not in ("id", "ingested_at")]
        if changes.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("an id is changed twice")
        new = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in names])
        now = self.read(table).join(new, "id")
        out = now.select(*[F.col(f"_new_{c}").alias(c) if c in names else F.col(c) for c in StructType.fromDDL(SCHEMAS[table]).names])
        if table == "documents":
            out = out.withColumn("updated_at", F.current_timestamp())
        self._write(table, out)

    def update_enrichment(self, changes: DataFrame) -> None:
        """Only the enrichment columns of sections."""
        self.update("sections", changes, [c for c in ENRICHMENT if c in changes.columns])

    def update_embeddings(self, changes: DataFrame) -> None:
        """Vectors of chunks ``(id, embedding)``."""
        self.update("chunks", changes, ["embedding"])

    def delete_documents(self, ids: DataFrame) -> None:
        """Delete documents ``(id)`` with their sections and chunks."""
        gone = ids.select("id").distinct()
        for table, key in (("chunks", "document_id"), ("sections", "document_id"), ("documents", "id")):
            rows = self.read(table)
            self._write(table, rows.join(gone.withColumnRenamed("id", key), key, "left_semi").select("id"), deleted=True)

    def compact(self, table: str) -> None:
        """Fold the versions of a table into one; readers of old versions must have ended."""
        fs, p = self._fs(table)
        old = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        rows = self.read(table)
        self._write(table, rows)
        for x in old:
            fs.delete(x, True)

    # -- settings and cache

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        row = self.get("meta", key).first()
        return row["value"] if row else default

    def set_meta(self, key: str, value: str) -> None:
        self._write("meta", self.spark.createDataFrame([(key, value)], SCHEMAS["meta"]))

    def get_cache(self, cache_type: str, cache_key: str) -> str | None:
        row = self.get("cache", f"{cache_type}\x1f{cache_key}").first()
        return row["value"] if row else None

    def set_cache(self, cache_type: str, cache_key: str, value: str) -> None:
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        self._write("cache", self.spark.createDataFrame([(f"{cache_type}\x1f{cache_key}", cache_type, cache_key, value, now)], SCHEMAS["cache"]))

    def clear_cache(self, cache_type: str | None = None) -> int:
        """Forget cached values of a type, or all; returns how many there were."""
        rows = self.read("cache")
        if cache_type is not None:
            rows = rows.where(F.col("cache_type") == cache_type)
        n = rows.count()
        if n:
            self._write("cache", rows.select("id"), deleted=True)
        return n

    def check_model(self, configured: str) -> str:
        """The corpus's embedding model: stored at first use; another one raises ``ValueError``."""
        stored = self.get_meta("embedding_model")
        if stored is None:
            self.set_meta("embedding_model", configured)
            return configured
        if stored != configured:
            raise ValueError(f"embedding model mismatch: the corpus uses {stored!r}, configured is {configured!r}")
        return stored

    def info(self) -> dict[str, object]:
        """Counts, size and settings, with their defaults."""
        fs, p = self._fs("")
        meta = {r["id"]: r["value"] for r in self.read("meta").limit(1000).collect()}
        now = datetime.datetime.now(datetime.UTC).isoformat()
        return {
            "name": meta.get("name", self.path.rsplit("/", 1)[-1]),
            "path": self.path,
            **{f"{t[:-1]}_count": self.read(t).count() for t in ("documents", "sections", "chunks")},
            "size_bytes": fs.getContentSummary(p).getLength(),
            "created_at": meta.get("created_at", now),
            "updated_at": meta.get("updated_at", now),
            "embedding_model": meta.get("embedding_model", "unknown"),
        }


def cached_expansion(corpus: Corpus, query: str, expand) -> dict[str, object]:
    """``{lex, vec, hyde}`` of a query from the cache, else from *expand(query)*, which is then cached."""
    from corpusloom.functions.config import cache_key

    kind, key = cache_key(query)
    held = corpus.get_cache(kind, key)
    if held:
        return json.loads(held)
    made = expand(query)
    out = {"lex": list(made.get("lex") or []), "vec": list(made.get("vec") or []), "hyde": made.get("hyde") or ""}
    corpus.set_cache(kind, key, json.dumps(out))
    return out


def variants(query: str, expansion: dict[str, object]) -> tuple[list[str], list[str]]:
    """Text variants and (non-empty) vector variants of an expanded query."""
    return [query, query, *expansion["lex"]], [q for q in (query, query, *expansion["vec"], expansion["hyde"]) if q]
