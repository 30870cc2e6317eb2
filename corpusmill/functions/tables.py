"""Table functions for SQL: one row to many, and the rows of a group to pairs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class TextChunks:
    """text_chunks(TABLE(t), 'column', words, shared): a row for each run of words of a text, with the other columns of its row.

    The result's columns follow from the table that is given: all but the text, then chunk, n_words and words."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, words: AnalyzeArgument, shared: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in rows.dataType.fields]
        if column.value not in names:
            raise ValueError(f"no column {column.value!r} among {names}")
        if not 0 <= shared.value < words.value:
            raise ValueError("chunks share fewer words than they have")
        kept = [f for f in rows.dataType.fields if f.name != column.value]
        return AnalyzeResult(T.StructType([*kept, T.StructField("chunk", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("words", T.StringType())]))

    def eval(self, row: Row, column: str, words: int, shared: int) -> Iterator[tuple]:
        found = (row[column] or "").split(" ")
        found = [w for w in found if w]
        kept = [row[name] for name in row.__fields__ if name != column]
        for chunk, at in enumerate(range(0, max(len(found) - shared, 1 if found else 0), words - shared)):
            part = found[at : at + words]
            yield (*kept, chunk, len(part), " ".join(part))


@udtf
class TurnPairs:
    """turn_pairs(TABLE(t) PARTITION BY conversation ORDER BY turn): question and answer, from each user turn that an assistant turn follows.

    A conversation's rows come one by one, and only the last is held."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        missing = {"conv_id", "turn", "role", "text"} - set(kinds)
        if missing:
            raise ValueError(f"no columns {sorted(missing)}")
        return AnalyzeResult(T.StructType([T.StructField("conv_id", kinds["conv_id"]), T.StructField("pair", T.IntegerType()), T.StructField("turn", kinds["turn"]), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]))

    def __init__(self) -> None:
        self.last, self.pair = None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.last is not None and self.last["role"] == "user" and row["role"] == "assistant":
            yield row["conv_id"], self.pair, self.last["turn"], self.last["text"], row["text"]
            self.pair += 1
        self.last = row


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("turn_pairs", TurnPairs)
