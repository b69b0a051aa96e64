"""Conversion, enrichment and embedding by functions the user provides, in batches on the executors.

A provider is a plain picklable function; this library ships none that needs a network.
Conversion: ``(path, content) -> Markdown``; enrichment: ``section dict -> dict``; embedding: ``list of texts -> list of vectors``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types a directory is searched for (fixed values).
SUFFIXES = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".odt", ".odp", ".ods", ".png", ".jpg", ".jpeg", ".md", ".txt")
TEXT, IMAGE = (".md", ".markdown", ".txt"), (".png", ".jpg", ".jpeg", ".gif", ".webp")
BATCH, LONGEST, LEAST_CONTENT = 8, 15_000, 50
_TRUNCATED = "\n\n[Content truncated...]"


def suffix(path: str | Column) -> Column:
    """Lower-case suffix of a path, with its dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``(path, suffix, content)`` of the files of a folder that can be ingested."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", suffix("path").alias("suffix"), "content").where(F.col("suffix").isin(*SUFFIXES))


def convert(found: DataFrame, providers: dict[str, Callable[[str, bytes], str]] | None = None) -> DataFrame:
    """``(path, markdown, error)`` of ``found(path, suffix, content)``.

    Text is decoded as UTF-8; other types go to the provider of their suffix.
    A type without a provider, or a provider that raises, gives an error and no text.
    """
    given = dict(providers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, error = [], []
            for path, kind, content in zip(*(b.column(c).to_pylist() for c in ("path", "suffix", "content"))):
                try:
                    if kind in TEXT:
                        text.append((content or b"").decode("utf-8"))
                    elif kind in given:
                        text.append(given[kind](path, content))
                    else:
                        raise ValueError(f"Unsupported file type: {kind}")
                    error.append(None)
                except Exception as e:
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["path", "markdown", "error"])

    return found.select("path", "suffix", "content").mapInArrow(run, "path string, markdown string, error string")


def merge_pages(pages: str | Column) -> Column:
    """The pages of a document under page headings; a single page stays as it is."""
    pages = F.col(pages) if isinstance(pages, str) else pages
    marked = F.transform(pages, lambda p, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), p))
    return F.when(F.size(pages) == 1, pages[0]).otherwise(F.array_join(marked, "\n\n---PAGE BREAK---\n\n"))


def enrich(sections: DataFrame, provider: Callable[[dict], dict]) -> DataFrame:
    """``(id, summary, key_terms, hypothetical_questions, semantic_type, entities, importance_score, error)`` per section worth it.

    Sections of level 1 or more with at least ``LEAST_CONTENT`` characters
    besides blanks at the ends; content above ``LONGEST`` characters is cut and marked.  A
    provider that raises, or an importance outside 0 to 1, gives the default row with the error.
    """
    rows = sections.where((F.col("level") > 0) & (F.length(F.regexp_replace("content", r"(?U)^\s+|\s+$", "")) >= LEAST_CONTENT))
    cut = F.when(F.length("content") > LONGEST, F.concat(F.substring("content", 1, LONGEST), F.lit(_TRUNCATED))).otherwise(F.col("content"))
    schema = "id string, summary string, key_terms array<string>, hypothetical_questions array<string>, semantic_type string, entities array<map<string,string>>, importance_score double, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                made = {"summary": "", "key_terms": [], "hypothetical_questions": [], "semantic_type": "other", "entities": [], "importance_score": 0.5, "error": None}
                try:
                    got = provider({k: row[k] for k in ("path", "title", "content")})
                    if not 0 <= got.get("importance_score", 0.5) <= 1:
                        raise ValueError("importance_score must be between 0 and 1")
                    made |= {k: v for k, v in got.items() if k in made}
                except Exception as e:
                    made["error"] = f"{type(e).__name__}: {e}"
                out.append({"id": row["id"], **made, "entities": [[(k, str(v)) for k, v in x.items()] for x in made["entities"]]})
            yield pa.RecordBatch.from_pylist(out, schema=_ENRICHED)

    return rows.select("id", "path", "title", cut.alias("content")).mapInArrow(run, schema)


_ENRICHED = pa.schema([
    ("id", pa.string()), ("summary", pa.string()), ("key_terms", pa.list_(pa.string())), ("hypothetical_questions", pa.list_(pa.string())), ("semantic_type", pa.string()),
    ("entities", pa.list_(pa.map_(pa.string(), pa.string()))), ("importance_score", pa.float64()), ("error", pa.string()),
])


def embed(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, configured: str, batch: int = BATCH) -> DataFrame:
    """``(id, embedding)`` of ``texts(id, text)``, *batch* (at least 1) texts a call; null texts have no vector.

    *model* must be the configured one; a provider that returns another number of vectors raises.
    """
    if model != configured:
        raise ValueError(f"requested embedding model {model!r} is not the configured {configured!r}")
    size = max(1, batch)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("text").to_pylist()
            at = [i for i, t in enumerate(every) if t is not None]
            out: list[list[float] | None] = [None] * len(every)
            for i in range(0, len(at), size):
                part = at[i : i + size]
                made = provider([every[j] for j in part])
                if len(made) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(made)} vectors")
                for j, v in zip(part, made):
                    out[j] = list(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")


def dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """Number of components of the first vector found."""
    row = vectors.where(F.size(column) > 0).select(F.size(column)).limit(1).first()
    return row[0] if row else None


def parse_detection(payload: str) -> dict[str, object]:
    """The five fields of a PDF detector's JSON; a missing or wrongly typed one raises ``ValueError``."""
    try:
        found = json.loads(payload)
    except json.JSONDecodeError as e:
        raise ValueError(f"no valid JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError("the JSON must be an object")
    if "error" in found:
        raise ValueError(f"the detector reported: {found['error']}")

    def number(x: object) -> bool:
        return isinstance(x, (int, float)) and not isinstance(x, bool)

    checks = {
        "pdf_type": lambda x: isinstance(x, str),
        "confidence": number,
        "ocr_recommended": lambda x: isinstance(x, bool),
        "page_count": lambda x: number(x) and isinstance(x, int),
        "pages_needing_ocr": lambda x: isinstance(x, list) and all(number(p) and isinstance(p, int) for p in x),
    }
    for name, ok in checks.items():
        if not ok(found.get(name)):
            raise ValueError(f"field {name!r} is missing or of another type")
    return {name: float(found[name]) if name == "confidence" else found[name] for name in checks}


def parse_markdown(payload: str) -> str:
    """The text of a PDF extractor's JSON; anything but a non-blank string raises ``ValueError``."""
    found = json.loads(payload)
    text = found.get("markdown") if isinstance(found, dict) else None
    if not isinstance(text, str) or not text.strip():
        raise ValueError("the extractor gave no text")
    return text
