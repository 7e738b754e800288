"""Table functions for SQL: the tags of entities, reduced while they stream by, and the sections of a text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: What a table of tags must have beside the entity's column.
TAG_COLUMNS = ["tag", "tag_type", "source_bucket", "score"]


class MaxTags:
    """``max_tags(TABLE(t), 'entity')``: one row for each tag, type and bucket of an entity, with its highest score and number.

    Rows come partitioned by the entity and ordered by tag, so a partition keeps one tag at a time, however many it has.
    Null scores are below all others; blank tags are no tags; a null entity is an entity.
    """

    def __init__(self):
        self.now = self.entity = None
        self.score, self.n = None, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, entity: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not entity.isConstantExpression or not isinstance(entity.value, str):
            raise ValueError("max_tags takes a table and the name of its entity column")
        have = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [c for c in (entity.value, *TAG_COLUMNS) if c not in have]
        if missing:
            raise ValueError(f"max_tags: the table lacks {', '.join(missing)}")
        schema = StructType().add(entity.value, have[entity.value]).add("tag", StringType()).add("tag_type", StringType()).add("source_bucket", StringType()).add("score", DoubleType()).add("n", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{entity.value}`")], orderBy=[OrderingColumn(c) for c in TAG_COLUMNS[:3]])

    def eval(self, row, entity: str):
        tag = row["tag"]
        if tag is None or not tag.strip():
            return
        key = (tag, row["tag_type"], row["source_bucket"])
        if self.now is not None and key != self.now:
            yield self._row()
            self.score, self.n = None, 0
        self.now, self.entity = key, row[entity]
        score = None if row["score"] is None else float(row["score"])
        self.score = score if self.score is None or score is not None and score > self.score else self.score
        self.n += 1

    def _row(self):
        return (self.entity, *self.now, self.score, self.n)

    def terminate(self):
        if self.now is not None:
            yield self._row()


@udtf(returnType=StructType().add("place", IntegerType()).add("heading", StringType()).add("body", StringType()))
class Sections:
    """``sections(text, headings)``: the parts of a text that lines of these headings (separated by |) begin; what stands before the first has none."""

    def eval(self, text: str, headings: str):
        if text is None:
            return
        names = {h.strip().lower() for h in (headings or "").split("|") if h.strip()}
        place, heading, held = 0, None, []
        for line in text.split("\n"):
            if line.strip().rstrip(":").lower() in names:
                if held or heading is not None:
                    yield place, heading, "\n".join(held).strip()
                    place += 1
                heading, held = line.strip().rstrip(":").lower(), []
            else:
                held.append(line)
        yield place, heading, "\n".join(held).strip()


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    from ..shipping import ship

    ship(spark)
    spark.udtf.register("max_tags", udtf(MaxTags))
    spark.udtf.register("sections", Sections)
