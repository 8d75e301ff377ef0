"""Chunks of documents, by the extension of their path: markdown sections or symbols of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import DOC_EXTENSIONS, LANGUAGES
from quarry.operators import codechunks, markdownchunks

SCHEMA = (
    "document_id bigint, position int, chunk_type string, context_path string, title string, preview string, language string, "
    "symbol_name string, symbol_type string, symbol_id string, symbol_part_index int, symbol_part_count int, "
    "line_start int, line_end int, token_count int, content string, chunk_sha string"
)
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]


def extension() -> Column:
    return F.substring_index(F.lower(F.substring_index("path", "/", -1)), ".", -1)


def holds_code(docs: DataFrame) -> bool:
    """Whether a path is not that of documentation."""
    return not docs.filter(~extension().isin(DOC_EXTENSIONS)).isEmpty()


def chunk_documents(docs: DataFrame, *carried: str, code: bool = True) -> DataFrame:
    """Chunks of documents (document_id, path, title, prefix array<string>, content), with the columns ``carried`` of their document; null content is empty. Where all paths are documentation, ``code`` may be off: the many reads of source files are left out."""
    ext = extension()
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    files = docs.select(
        "document_id", "path", "title", F.coalesce("prefix", F.array().cast("array<string>")).alias("prefix"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce(F.try_element_at(known, ext), ext).alias("language"), ext.isin(DOC_EXTENSIONS).alias("is_doc"), *carried,
    )
    made = markdownchunks.markdown_chunks(files.filter("is_doc"), *carried)
    if code:
        sources = files.filter("not is_doc")
        cut = codechunks.code_chunks(sources.drop("title", "is_doc", *carried))
        made = made.unionByName(cut.join(sources.select("document_id", *carried), "document_id") if carried else cut)
    sha = F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.col("position").cast("string"), F.col("content")), 256)
    return made.withColumn("chunk_sha", sha).select(*COLUMNS, *carried)


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id, a hash of document and position: replays give the same ids."""
    return chunks.withColumn("chunk_id", F.xxhash64("document_id", "position"))
