"""Table functions for SQL: parse_blocks(text, markdown) and chunk_text(text, markdown, target, overlap, least)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.operators.passages import Chunking, blocks_of, passages
from lectern.session import ship


@udtf(returnType="block_no int, kind string, start int, `end` int, level int, label string")
class ParseBlocks:
    def eval(self, text: str, markdown: bool):
        for k, block in enumerate(blocks_of(text or "", markdown)):
            yield (k, *block)


@udtf(returnType="ordinal int, passage string, token_count int, char_start int, char_end int, heading_path string")
class ChunkText:
    def eval(self, text: str, markdown: bool, target: int, overlap: int, least: int):
        how = Chunking(target, overlap, least)
        for ordinal, start, end, tokens, path in passages(text or "", blocks_of(text or "", markdown), how):
            yield ordinal, text[start:end], tokens, start, end, path


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    ship(spark).udtf.register("parse_blocks", ParseBlocks)
    spark.udtf.register("chunk_text", ChunkText)
